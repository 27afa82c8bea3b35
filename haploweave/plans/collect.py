"""The whole run: alignments and reference to candidates, read evidence and phase.

Tiles are the unit of work. Reads are dealt to the tiles they touch by a binned
range join; a tile's reads and its piece of reference meet in one grouped Arrow
function that does what depends on order (merge walk, clustering, phasing,
consensus); everything before and after it is DataFrame code. Stitching folds
over one small row a tile, contig by contig, and its outcome is joined back.
Tiles bound the memory of a task; a tile with very deep coverage needs a smaller
chunk_size.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.dust import low_complexity
from ..functions.repeats import Window
from ..operators.classify import classify, contain, post_process, pre_process
from ..operators.digars import needs_reference, parse_alignments, read_filter
from ..operators.phase import Phaser, genotype, phase, profiles, read_order
from ..operators.recall import recall
from ..operators.sites import collect_sites, count, distinct_sites, site_order
from ..operators.stitch import fold, thread_support
from ..options import Options
from ..schemas import CATEGORY_BIT, CLEAN, DROPPED_CATEGORIES
from ..sources import text
from . import tiles

SITE = "struct<pos:bigint,type:string,ref_len:int,alt:string,total_cov:int,ref_cov:int,alt_cov:int,low_qual_cov:int,forward_ref:int,reverse_ref:int,forward_alt:int,reverse_alt:int,af:double,category:string,init_category:string,phase_set:bigint,cons0:int,cons1:int,cons2:int,alt_ref_base:int,region_pass:boolean>"
PHASED_READ = "struct<read_id:bigint,qname:string,input_idx:int,beg:bigint,fin:bigint,mapq:int,rev:boolean,skipped:boolean,in_prev:boolean,in_next:boolean,hap:int,phase_set:bigint,hs:array<bigint>>"
SUPPORT = "struct<pos:bigint,type:string,ref_len:int,alt:string,qname:string,is_alt:int,low_qual:int,rev:boolean,mapq:int>"
CHUNK = f"chunk_id bigint, tid int, beg bigint, fin bigint, sites array<{SITE}>, reads array<{PHASED_READ}>, support array<{SUPPORT}>, noisy array<struct<beg:bigint,fin:bigint,label:int>>"

#: So many tiles are broadcast at most, about 100 bytes each.
MOST_TILES = 1 << 18


def process_tile(reads: list[dict], window: Window, beg: int, fin: int, options: Options) -> dict:
    """Sites, phased reads, observations and noisy intervals of a tile."""
    o = options
    reads = read_order(reads)
    found = collect_sites(reads, beg, fin, o.min_sv_len)
    log = count(reads, found, o)
    support = [{"pos": found[i]["pos"], "type": found[i]["type"], "ref_len": found[i]["ref_len"], "alt": found[i]["alt"], "qname": r["qname"], "is_alt": int(a), "low_qual": int(q), "rev": r["rev"], "mapq": r["mapq"]} for r, i, a, q in log] if o.read_support else []
    lo, hi = max(beg, window.beg), min(fin, window.fin)
    masks = [(b - 1, e, 1) for b, e in low_complexity(window.seq[lo - window.beg : hi - window.beg + 1], o.dust_threshold, o.dust_window, lo)] if hi >= lo else []
    noisy = [(x["beg"] - 1, x["fin"], max(1, x["label"])) for r in reads if not r["skipped"] for x in r["noisy"] if x["beg"] <= x["fin"] and x["beg"] <= fin and x["fin"] >= beg]
    noisy = pre_process(noisy, masks, reads, o) if noisy else []
    noisy = classify(found, reads, noisy, masks, window, beg, fin, o) if found else noisy
    noisy = post_process(noisy, found, o) if noisy else []
    contain(found, noisy)
    found = [s for s in found if s["category"] not in DROPPED_CATEGORIES]
    p: Phaser | None = None
    if found or noisy:
        p = phase(found, reads, o, CLEAN, profiles(reads, found, o))
        p = recall(found, reads, p, noisy, window, o)
        found = p.sites
    for s in found:
        at = s["pos"] - (s["type"] != "SNP")
        s["region_pass"] = beg <= at <= fin
        s.setdefault("cons", [-1, -1, -1])
        s.setdefault("phase_set", -1)
        s["cons0"], s["cons1"], s["cons2"] = s["cons"]
        s.setdefault("alt_ref_base", 4)
    for k, r in enumerate(reads):
        r["hap"], r["phase_set"] = (p.hap[k], p.phase_set[k]) if p else (0, -1)
    return {"sites": found, "reads": reads, "support": support, "noisy": [{"beg": b, "fin": e, "label": n} for b, e, n in noisy]}


@dataclass
class Result:
    """DataFrames of a run. ``tiles`` has what each tile gave, kept as ``kept`` says; ``grid`` is the tiling."""

    tiles: DataFrame
    candidates: DataFrame
    reads: DataFrame
    support: DataFrame
    contigs: DataFrame
    reference: DataFrame
    options: Options
    grid: DataFrame


def told(grid: DataFrame) -> DataFrame:
    """grid, for a join with reads. A row of a few numbers a tile: told to all tasks while they are few, or reads would go through
    an exchange more; sent by key beyond, as what is made of contigs is planned as a few rows."""
    return F.broadcast(grid) if grid.count() <= MOST_TILES else text.moved(grid)


def with_reference(alignments: DataFrame, reference: DataFrame) -> DataFrame:
    """Alignments beside their piece of reference, where only that tells matches from mismatches."""
    needs = F.coalesce(needs_reference(), F.lit(False)) & F.col("cs").isNull() & F.col("md").isNull()
    some, rest = alignments.filter(needs), alignments.filter(~needs)
    span = F.coalesce(F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda n, x: n + x.cast("long")), F.lit(1).cast("long"))
    pieces = text.slices(some.select("read_id", "chrom", (F.col("pos") + 1).alias("beg"), (F.col("pos") + F.greatest(span, F.lit(1))).alias("fin")), reference, ["read_id"])
    # Only those that need it are moved beside it.
    return rest.select("*", F.lit(None).cast("string").alias("ref_seq"), F.lit(None).cast("long").alias("ref_beg")).unionByName(some.join(pieces, "read_id", "left"))


def collect_variation(spark: SparkSession, alignments: DataFrame, reference: DataFrame, contigs: DataFrame, options: Options = Options(), regions: DataFrame | None = None, sidecar: DataFrame | None = None, spelled: bool = False) -> Result:
    """alignments: schemas.ALIGNMENT; reference: chrom, tile, beg, seq; contigs: tid, name, len; regions: chrom, beg, fin;
    sidecar: set_id, thread. Regions of the argument and all that the options name are united, as they are. spelled: all
    alignments tell matches from mismatches themselves, so none is read beside the reference."""
    o = options
    names = {r["name"]: r["len"] for r in contigs.collect()}  # one row a contig
    asked = [regions] if regions is not None else []
    if o.regions:
        asked.append(text.regions(spark, list(o.regions)))
    if o.region_file:
        asked.append(text.bed(spark, o.region_file))
    if o.autosome:
        asked.append(text.autosomes(contigs, reference.filter("tile = 0").select(F.col("chrom").alias("name"))))
    if not asked:
        asked = [contigs.select(F.col("name").alias("chrom"), F.lit(1).cast("long").alias("beg"), F.col("len").alias("fin"))]
    regions = reduce(DataFrame.unionByName, asked)
    grid = tiles.number(tiles.cut(text.resolve(regions, contigs), o.chunk_size))
    usable = alignments.filter(read_filter(o))
    reads = parse_alignments(usable if spelled else with_reference(usable, reference), names, o)
    dealt = tiles.load_reads(reads, told(grid))
    spans = dealt.filter(~F.col("skipped")).groupBy("chunk_id").agg(F.min("beg").alias("lo"), F.max("fin").alias("hi"))
    named = F.broadcast(contigs.select(F.col("tid").alias("ctid"), F.col("name").alias("chrom"), "len"))
    windows = grid.join(spans, "chunk_id", "left").join(named, F.col("tid") == F.col("ctid")).select(
        "chunk_id", "chrom", F.greatest(F.coalesce("lo", "beg") - o.ref_flank, F.lit(1)).alias("beg"), F.least(F.coalesce("hi", "fin") + o.ref_flank, F.col("len")).alias("fin")
    )
    pieces = text.slices(windows, reference, ["chunk_id"]).select(F.col("chunk_id").alias("w_chunk"), "ref_seq", "ref_beg")
    schema = to_arrow_schema(StructType.fromDDL(CHUNK))

    def tile(key, mine, ref):
        rows = mine.to_pylist()
        if not rows:
            return schema.empty_table()
        seq, start = (ref.column("ref_seq")[0].as_py(), ref.column("ref_beg")[0].as_py()) if ref.num_rows else ("", 1)
        beg, fin, tid = rows[0]["chunk_beg"], rows[0]["chunk_fin"], rows[0]["tid"]
        made = process_tile(rows, Window(seq, start), beg, fin, o)
        return pa.Table.from_pylist([{"chunk_id": key[0].as_py(), "tid": tid, "beg": beg, "fin": fin} | made], schema=schema)

    done = dealt.groupBy("chunk_id").cogroup(pieces.groupBy("w_chunk")).applyInArrow(tile, CHUNK)
    done = kept(done)
    folded = fold(summaries(done, sidecar), o, sidecar is not None)
    return Result(done, candidates(done, folded), phased_reads(done, folded), observations(done), contigs, reference, o, grid)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once: cut from lineage in the session's checkpoint folder (spark.checkpoint.dir), or, where there is none,
    in executors' memory and disks, so that a lost executor's share is computed again."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.persist() if sc._jsc.sc().getCheckpointDir().isEmpty() else df.checkpoint()


def summaries(done: DataFrame, sidecar: DataFrame | None) -> DataFrame:
    """One row a tile for stitching: its phase sets and the reads that it shares with neighbours."""
    shared = F.filter("reads", lambda r: (r["in_prev"] | r["in_next"]) & ~r["skipped"] & (r["hap"] > 0))
    brief = F.transform(shared, lambda r: F.struct(r["read_id"].alias("read_id"), r["hap"].alias("hap"), r["phase_set"].alias("phase_set"), r["in_prev"].alias("in_prev"), r["in_next"].alias("in_next")))
    sets = F.array_distinct(F.concat(F.transform("sites", lambda s: s["phase_set"]), F.transform("reads", lambda r: r["phase_set"])))
    out = done.select("tid", "chunk_id", F.array_sort(F.filter(sets, lambda x: x >= 0)).alias("phase_sets"), brief.alias("reads"))
    if sidecar is None:
        return out
    r = done.select("chunk_id", F.explode("reads").alias("r")).select("chunk_id", "r.*").filter("NOT skipped AND phase_set >= 0")
    hs = r.select("read_id", F.explode("hs").alias("set_id"))
    counted = thread_support(r, hs, sidecar, ["chunk_id", "phase_set"]).groupBy("chunk_id").agg(F.collect_list(F.struct("phase_set", "thread", "h1", "h2")).alias("support"))
    rows = out.join(counted, "chunk_id", "left")
    return rows.withColumn("support", F.coalesce("support", F.array().cast("array<struct<phase_set:bigint,thread:bigint,h1:bigint,h2:bigint>>"))).withColumn("support", F.transform("support", lambda x: F.array(x["phase_set"], x["thread"], x["h1"], x["h2"])))


def candidates(done: DataFrame, folded: DataFrame) -> DataFrame:
    """One row a site over all tiles, with the phase after stitching, in the total order. hap_alt and hap_ref are those of the tile."""
    rows = done.select("chunk_id", "tid", F.posexplode("sites").alias("ord", "s")).select("chunk_id", "tid", "ord", "s.*")
    before = genotype()
    rows = rows.withColumn("hap_alt", before["hap_alt"]).withColumn("hap_ref", before["hap_ref"])
    moved = folded.filter("NOT of_reads").select("chunk_id", "phase_set", "new_phase_set", "flip")
    rows = rows.join(moved, ["chunk_id", "phase_set"], "left")
    turned = F.coalesce("flip", F.lit(False))
    rows = rows.withColumn("c1", F.when(turned, F.col("cons2")).otherwise(F.col("cons1"))).withColumn("cons2", F.when(turned, F.col("cons1")).otherwise(F.col("cons2"))).withColumn("cons1", F.col("c1"))
    rows = rows.withColumn("phase_set", F.coalesce("new_phase_set", "phase_set")).drop("new_phase_set", "flip", "c1")
    one = distinct_sites(rows, ["tid", "pos", "type", "ref_len", "alt"])
    return one.orderBy(*site_order()).drop("ord")


def phased_reads(done: DataFrame, folded: DataFrame) -> DataFrame:
    """Reads of each tile with haplotype and phase set; renamed by stitching where reads are followed."""
    rows = done.select("chunk_id", "tid", F.col("beg").alias("chunk_beg"), F.col("fin").alias("chunk_fin"), F.explode("reads").alias("r")).select("chunk_id", "tid", "chunk_beg", "chunk_fin", "r.*")
    moved = folded.filter("of_reads").select("chunk_id", "phase_set", "new_phase_set", "flip")
    rows = rows.join(moved, ["chunk_id", "phase_set"], "left")
    hap = F.when(F.coalesce("flip", F.lit(False)) & (F.col("hap") > 0) & ~F.col("skipped"), 3 - F.col("hap")).otherwise(F.col("hap"))
    return rows.withColumn("hap", hap).withColumn("phase_set", F.coalesce("new_phase_set", "phase_set")).drop("new_phase_set", "flip")


def observations(done: DataFrame) -> DataFrame:
    return done.select("tid", F.col("beg").alias("chunk_beg"), F.col("fin").alias("chunk_fin"), F.explode("support").alias("s")).select("tid", "chunk_beg", "chunk_fin", "s.*")


def with_bases(result: Result, rows: DataFrame | None = None) -> DataFrame:
    """Candidates with chrom, ref_seq (from the anchor on for indels) and anchor, as records need them."""
    rows = rows if rows is not None else result.candidates
    named = F.broadcast(result.contigs.select(F.col("tid").alias("ctid"), F.col("name").alias("chrom")))
    rows = rows.join(named, F.col("tid") == F.col("ctid")).drop("ctid")
    first = F.when(F.col("type") == "SNP", F.col("pos")).otherwise(F.greatest(F.col("pos") - 1, F.lit(1)))
    last = F.when(F.col("type") == "SNP", F.col("pos")).when(F.col("type") == "INS", first).otherwise(F.col("pos") + F.col("ref_len") - 1)
    key = ["tid", "pos", "type", "ref_len", "alt"]
    bases = text.slices(rows.select(*key, "chrom", first.alias("beg"), last.alias("fin")), result.reference, key).drop("ref_beg")
    return rows.join(bases, key, "left").withColumn("ref_seq", F.coalesce("ref_seq", F.lit("N"))).withColumn("anchor", F.substring("ref_seq", 1, 1))


def summary(result: Result) -> dict[str, int]:
    """Numbers of a run: tiles, reads, skipped reads, candidates by category."""
    reads = result.reads.agg(F.count("*"), F.count_if("skipped")).first()
    kinds = {r["category"]: r["count"] for r in result.candidates.groupBy("category").count().collect()}
    return {"tiles": result.tiles.count(), "reads": reads[0], "skipped": reads[1]} | {c: kinds.get(c, 0) for c in CATEGORY_BIT if c in kinds}
