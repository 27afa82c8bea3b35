"""Options of a run: one immutable value, validated when made.

Options with a command-line flag keep its meaning; `noisy_merge_dis` is accepted
and has no effect on results, as clustering goes by labels alone.
"""
from __future__ import annotations

from dataclasses import dataclass

TECHNOLOGIES = ("hifi", "ont", "short-reads")
#: Window of the noise detector by technology, in bases.
NOISE_WINDOW = {"hifi": 100, "ont": 25, "short-reads": 25}


@dataclass(frozen=True)
class Options:
    technology: str = "hifi"
    # Input and tiling
    regions: tuple[str, ...] = ()
    region_file: str | None = None
    autosome: bool = False
    chunk_size: int = 500_000
    threads: int = 1
    # Read filters
    min_mapq: int = 30
    include_filtered: bool = False
    max_var_ratio: float = 0.05
    max_noisy_frac: float = 0.5
    # Sites
    min_bq: int = 10
    min_depth: int = 5
    min_alt_depth: int = 2
    min_af: float = 0.20
    max_af: float = 0.80
    strand_bias_pval: float = 0.01
    # Noise
    noisy_slide_win: int = 0
    noisy_max_xgaps: int = 5
    noisy_merge_dis: int = 500
    min_sv_len: int = 30
    min_noisy_reg_total_depth: int = 0
    noisy_flank: int = 10
    max_noisy_reg_len: int = 50_000
    max_noisy_reg_reads: int = 1_000
    min_hap_full_reads: int = 1
    min_hap_reads: int = 2
    sampling_reg_len: int = 10_000
    partial_ratio: float = 1.1
    # Reference context
    ref_flank: int = 50_000
    dust_threshold: int = 5
    dust_window: int = 20
    end_clip: int = 30
    end_clip_flank: int = 100
    # Alignment scores
    match: int = 2
    mismatch: int = 6
    gap_open1: int = 6
    gap_ext1: int = 2
    gap_open2: int = 24
    gap_ext2: int = 1
    # Outputs
    amb_base: bool = False
    read_support: bool = False
    refine_aln: bool = False
    output_alignment: bool = False
    # Graph threads
    sidecar_file: str | None = None
    thread_primary_margin: int = 2
    thread_primary_min_winning: int = 2
    thread_cleanup_pass: bool = True
    thread_cleanup_margin: int = 2
    thread_cleanup_min_winning: int = 1
    thread_relaxed_cleanup_pass: bool = True
    thread_relaxed_cleanup_margin: int = 1
    thread_relaxed_cleanup_min_winning: int = 1
    verbose: int = 0

    def __post_init__(self):
        if self.technology not in TECHNOLOGIES:
            raise ValueError(f"technology is one of {', '.join(TECHNOLOGIES)}")
        for name in ("chunk_size", "threads", "min_depth"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("min_mapq", "min_bq", "min_alt_depth", "noisy_slide_win", "noisy_max_xgaps", "min_sv_len", "min_noisy_reg_total_depth", "thread_primary_margin", "thread_cleanup_margin", "thread_relaxed_cleanup_margin"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if not 0 <= self.min_af <= self.max_af <= 1:
            raise ValueError("0 <= min_af <= max_af <= 1 must hold")
        if not 0 <= self.strand_bias_pval <= 1:
            raise ValueError("strand_bias_pval must be a probability")
        if self.refine_aln and not self.output_alignment:
            raise ValueError("refine_aln needs an alignment output")

    @property
    def is_ont(self) -> bool:
        return self.technology == "ont"

    @property
    def noise_window(self) -> int:
        return self.noisy_slide_win or NOISE_WINDOW[self.technology]


def parse_arguments(argv: list[str]) -> tuple[Options, dict]:
    """Options and paths of a command line: reference, inputs, regions and outputs."""
    import argparse

    p = argparse.ArgumentParser(prog="collect-variation", description="Collect, classify and phase variation from aligned reads.")
    p.add_argument("reference")
    p.add_argument("input")
    p.add_argument("region", nargs="*")
    p.add_argument("-L", "--input-is-list", action="store_true")
    p.add_argument("-X", "--extra-bam", action="append", default=[])
    p.add_argument("-r", "--region", dest="more_regions", action="append", default=[])
    p.add_argument("-R", "--region-file")
    p.add_argument("-a", "--autosome", action="store_true")
    tech = p.add_mutually_exclusive_group()
    for t in TECHNOLOGIES:
        tech.add_argument(f"--{t}", dest="technology", action="store_const", const=t)
    numbers = {
        "chunk-size": int, "t/threads": int, "q/min-mapq": int, "j/max-var-ratio": float, "max-noisy-frac": float, "B/min-bq": int, "D/min-depth": int, "min-alt-depth": int, "min-af": float, "max-af": float,
        "strand-bias-pval": float, "noisy-slide-win": int, "noisy-max-xgaps": int, "noisy-merge-dis": int, "min-sv-len": int, "min-noisy-reg-total-depth": int, "pgbam-primary-margin": int,
        "pgbam-primary-min-winning": int, "pgbam-cleanup-margin": int, "pgbam-cleanup-min-winning": int, "pgbam-relaxed-cleanup-margin": int, "pgbam-relaxed-cleanup-min-winning": int, "V/verbose": int,
    }
    for name, kind in numbers.items():
        short, _, long = name.rpartition("/")
        p.add_argument(*([f"-{short}"] if short else []), f"--{long}", type=kind)
    p.add_argument("-f", "--include-filtered", action="store_true")
    p.add_argument("--amb-base", action="store_true")
    p.add_argument("--refine-aln", action="store_true")
    p.add_argument("--no-pgbam-cleanup-pass", action="store_true")
    p.add_argument("--no-pgbam-relaxed-cleanup-pass", action="store_true")
    p.add_argument("--pgbam-file")
    outputs = ("o/output", "v/vcf-output", "phased-vcf-output", "read-support", "phase-read-tsv", "S/out-sam", "b/out-bam", "C/out-cram")
    for name in outputs:
        short, _, long = name.rpartition("/")
        p.add_argument(*([f"-{short}"] if short else []), f"--{long}")
    a = p.parse_args(argv)
    values = {k.rpartition("/")[2].replace("-", "_"): None for k in numbers}
    values = {k.replace("pgbam_", "thread_"): v for k in values if (v := getattr(a, k)) is not None}
    aligned = bool(a.out_sam or a.out_bam or a.out_cram)
    options = Options(
        technology=a.technology or "hifi", regions=tuple(a.region + a.more_regions), region_file=a.region_file, autosome=a.autosome, include_filtered=a.include_filtered, amb_base=a.amb_base,
        refine_aln=a.refine_aln, output_alignment=aligned, read_support=bool(a.read_support), sidecar_file=a.pgbam_file, thread_cleanup_pass=not a.no_pgbam_cleanup_pass,
        thread_relaxed_cleanup_pass=not a.no_pgbam_relaxed_cleanup_pass, **values,
    )
    paths = {"reference": a.reference, "input": a.input, "input_is_list": a.input_is_list, "extra": a.extra_bam} | {n.rpartition("/")[2].replace("-", "_"): getattr(a, n.rpartition("/")[2].replace("-", "_")) for n in outputs}
    return options, paths
