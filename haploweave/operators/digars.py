"""Alignments to events ("digars") and noisy intervals, read by read.

Each encoding of an alignment (=/X CIGAR, cs tag, MD tag, or M with reference) is
turned into one stream of segments; a single builder walks the stream, keeps both
coordinates, makes the events and feeds the noise detector. Runs on Arrow batches
in one narrow pass.
"""
from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.repeats import Window
from ..options import Options

CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
CS = re.compile(r":(\d+)|=([A-Za-z]+)|\*([A-Za-z])([A-Za-z])|\+([A-Za-z]+)|-([A-Za-z]+)|~([A-Za-z0-9]*)")
MD = re.compile(r"(\d+)|\^([A-Za-z]+)|([A-Za-z])")
UNMAPPED, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY, REVERSE = 0x4, 0x100, 0x200, 0x400, 0x800, 0x10


class Malformed(ValueError):
    """A tag that does not describe its alignment."""


def cigar_ops(cigar: str | None) -> list[tuple[str, int]]:
    return [(op, int(n)) for n, op in CIGAR.findall(cigar or "")]


def reference_length(ops: list[tuple[str, int]]) -> int:
    return sum(n for op, n in ops if op in "MDN=X")


def read_base(seq: str, i: int) -> str:
    c = seq[i].upper() if 0 <= i < len(seq) else "N"
    return c if c in "ACGT" else "N"


class Noise:
    """Sliding window over events; where it holds more than ``most`` bases of difference, a noisy interval is open."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.held: deque[tuple[int, int, int]] = deque()
        self.total = 0
        self.events: list[tuple[int, int, int]] = []
        self.first = 0  # number of the oldest event in the window
        self.open: list[int] | None = None  # beg, fin, first event, last event
        self.found: list[tuple[int, int, int]] = []

    def observe(self, pos: int, size: int, count: int) -> None:
        self.events.append((pos, size, count))
        self.held.append((pos, size, count))
        self.total += count
        while self.held and self.held[0][0] + self.held[0][1] - 1 <= pos - self.window:
            self.total -= self.held.popleft()[2]
            self.first += 1
        if count <= 0 or self.total <= self.most:
            return
        beg, fin, last = self.held[0][0], pos + size, len(self.events) - 1
        if self.open is None:
            self.open = [beg, fin, self.first, last]
        elif beg <= self.open[1]:
            self.open[1], self.open[3] = fin, last
        else:
            self.close()
            self.open = [beg, fin, self.first, last]

    def close(self) -> None:
        if self.open is None:
            return
        beg, fin, a, b = self.open
        self.found.append((beg, fin, max(sum(e[2] for e in self.events[a : b + 1]), fin - beg + 1)))
        self.open = None


Segment = tuple[str, int, str]


def eqx_segments(ops) -> Iterator[Segment]:
    for op, n in ops:
        yield (op, n, "")


def reference_segments(ops, seq: str, pos: int, window: Window) -> Iterator[Segment]:
    """M split where the read differs from the reference."""
    qi = 0
    for op, n in ops:
        if op in "M=X":
            same = 0
            for j in range(n):
                if op == "X" or (op == "M" and read_base(seq, qi + j) != window.base(pos + j)):
                    if same:
                        yield ("=", same, "")
                    same = 0
                    yield ("X", 1, "")
                else:
                    same += 1
            if same:
                yield ("=", same, "")
            qi, pos = qi + n, pos + n
        else:
            yield (op, n, "")
            qi += n if op in "IS" else 0
            pos += n if op in "DN" else 0


def md_segments(ops, md: str) -> Iterator[Segment]:
    """M cut up by an MD tag. A number may go on over several operations."""
    tokens = deque()
    at = 0
    for m in MD.finditer(md):
        if m.start() != at:
            raise Malformed(md)
        at = m.end()
        tokens.append(("n", int(m[1])) if m[1] else ("d", m[2]) if m[2] else ("x", m[3]))
    if at != len(md):
        tokens.append(("bad", ""))
    left = 0
    for op, n in ops:
        if op in "=X":
            raise Malformed(md)
        if op != "M":
            if op == "D" and not left:
                while tokens and tokens[0] == ("n", 0):
                    tokens.popleft()
                if tokens and tokens[0][0] == "d":
                    tokens.popleft()
            yield (op, n, "")
            continue
        while n:
            if left:
                take = min(left, n)
                yield ("=", take, "")
                left, n = left - take, n - take
            elif not tokens or tokens[0][0] in ("d", "bad"):
                raise Malformed(md)
            elif (token := tokens.popleft())[0] == "n":
                left = token[1]
            else:
                yield ("X", 1, "")
                n -= 1


def cs_segments(ops, cs: str) -> Iterator[Segment]:
    """A cs tag, between the clips at both ends of the CIGAR. Bases keep the tag's letter case; a splice moves nothing."""
    if ops and ops[0][0] in "SH":
        yield (*ops[0], "")
    at = 0
    while at < len(cs):
        m = CS.match(cs, at)
        if not m:
            raise Malformed(cs)
        at = m.end()
        if m[1]:
            yield ("=", int(m[1]), "")
        elif m[2]:
            yield ("=", len(m[2]), "")
        elif m[4]:
            yield ("X", 1, m[4].upper() if m[4].upper() in "ACGT" else "N")
        elif m[5]:
            yield ("I", len(m[5]), m[5])
        elif m[6]:
            yield ("D", len(m[6]), "")
    if ops and ops[-1][0] in "SH":
        yield (*ops[-1], "end")


def is_palindrome(chrom: str, beg: int, fin: int, sa: str | None) -> bool:
    """Whether a supplementary alignment on the same contig overlaps the primary one."""
    for entry in (sa or "").split(";"):
        f = entry.split(",")
        if len(f) < 6 or f[0] != chrom or not f[1].lstrip("-").isdigit():
            continue
        start = int(f[1])
        if start + sum(n for op, n in cigar_ops(f[3]) if op in "MD=X") >= beg and start <= fin:
            return True
    return False


class Builder:
    """Walks segments; collects events, noisy intervals and the number of events."""

    def __init__(self, seq: str, qual: bytes, pos: int, contig_len: int, palindrome: bool, reverse: bool, options: Options):
        self.seq, self.qual, self.start, self.contig_len, self.o = seq, qual, pos, contig_len, options
        self.quiet_left, self.quiet_right = palindrome and reverse, palindrome and not reverse
        self.events = 0

    def quality(self, i: int) -> int:
        return self.qual[i] if 0 <= i < len(self.qual) else 0

    def run(self, segments: Iterator[Segment]) -> None:
        o, pos, qi, first = self.o, self.start, 0, True
        self.digars: list[dict] = []
        self.clipped: list[tuple[int, int, int]] = []
        self.noise = Noise(o.noise_window, o.noisy_max_xgaps)
        for op, n, text in segments:
            if op in "X":
                for _ in range(n):
                    low = self.quality(qi) < o.min_bq
                    self.event(pos, "SNP", 1, qi, low, text or read_base(self.seq, qi), None if low else (pos, 1, 1))
                    pos, qi = pos + 1, qi + 1
            elif op in "=M":
                self.add(pos, "EQ", n, qi, False, "")
                pos, qi = pos + n, qi + n
            elif op == "I":
                low = all(self.quality(i) < o.min_bq for i in range(qi, qi + n))
                self.event(pos, "INS", n, qi, low, text or "".join(read_base(self.seq, i) for i in range(qi, qi + n)), None if low else (pos, 0, n))
                qi += n
            elif op == "D":
                # Low if either base beside it is; where there is none, that side is good.
                low = (qi > 0 and self.quality(qi - 1) < o.min_bq) or (qi < len(self.seq) and self.quality(qi) < o.min_bq)
                self.event(pos, "DEL", n, qi, low, "", None if low else (pos, n, n))
                pos += n
            elif op in "SH":
                self.add(pos, "SOFT" if op == "S" else "HARD", n, qi, False, "")
                self.clip(pos, n, first)
                qi += n if op == "S" else 0
            elif op == "N":
                pos += n
            first = False
        self.noise.close()

    def add(self, pos, kind, n, qi, low, alt) -> None:
        if n > 0:
            self.digars.append({"pos": pos, "type": kind, "len": n, "qi": qi, "low_quality": low, "alt": alt})

    def event(self, pos, kind, n, qi, low, alt, seen) -> None:
        self.add(pos, kind, n, qi, low, alt)
        self.events += 1
        if seen:
            self.noise.observe(*seen)

    def clip(self, pos: int, n: int, left: bool) -> None:
        """A long clip away from the contig's ends makes what is next to it noisy."""
        o = self.o
        if n <= o.end_clip or not (pos > 10 if left else pos < self.contig_len - 10) or (self.quiet_left if left else self.quiet_right):
            return
        if left and pos > 1:
            self.clipped.append((pos, pos + o.end_clip_flank, 0))
        elif not left and pos < self.contig_len:
            self.clipped.append((pos - o.end_clip_flank, pos, 0))
        self.events += 1

    def noisy(self) -> list[tuple[int, int, int]]:
        return self.clipped + self.noise.found


def parse(aln: dict, contig_len: int, window: Window | None, options: Options) -> dict:
    """digars, noisy, events, palindrome, beg, fin, skipped of an alignment (columns of schemas.ALIGNMENT)."""
    ops, seq, qual = cigar_ops(aln["cigar"]), aln["seq"] or "", bytes(aln["qual"] or b"")
    beg = aln["pos"] + 1
    fin = beg + max(1, reference_length(ops)) - 1
    reverse = bool(aln["flag"] & REVERSE)
    palindrome = options.is_ont and is_palindrome(aln["chrom"], beg, fin, aln.get("sa"))
    b = Builder(seq, qual, beg, contig_len, palindrome, reverse, options)
    plain = lambda: reference_segments(ops, seq, beg, window or Window("", beg))
    kind = next((op for op, _ in ops if op in "=XM"), "")
    if kind in ("=", "X"):
        b.run(eqx_segments(ops))
    elif aln.get("cs") is not None or aln.get("md") is not None:
        try:
            b.run(cs_segments(ops, aln["cs"]) if aln.get("cs") is not None else md_segments(ops, aln["md"]))
        except Malformed:
            b.run(plain())  # events counted so far stay counted
    else:
        b.run(plain())
    noisy = b.noisy()
    return {"digars": b.digars, "noisy": noisy, "events": b.events, "palindrome": palindrome, "beg": beg, "fin": fin, "skipped": too_many(b.events, noisy, beg, fin, options)}


def too_many(events: int, noisy: list[tuple[int, int, int]], beg: int, fin: int, options: Options) -> bool:
    """Whether a read has too many events or noisy bases for its span to be used; a threshold of 0 is off."""
    span = max(1, fin - beg + 1)
    bases = sum(f - b + 1 for b, f, _ in noisy if f >= b)
    return (options.max_var_ratio > 0 and events > span * options.max_var_ratio) or (options.max_noisy_frac > 0 and bases > span * options.max_noisy_frac)


def read_filter(options: Options, flag: str = "flag", mapq: str = "mapq", tid: str | None = "tid"):
    """Predicate of reads that take part: it is made of plain columns, so it reaches the scan."""
    kept = (F.col(flag).bitwiseAND(UNMAPPED | SECONDARY | SUPPLEMENTARY) == 0) & (F.col(mapq) >= options.min_mapq)
    if tid:
        kept &= F.col(tid) >= 0
    if not options.include_filtered:
        kept &= F.col(flag).bitwiseAND(QC_FAIL | DUPLICATE) == 0
    return kept


def needs_reference():
    """Whether an alignment can only be read beside the reference."""
    return ~F.regexp_extract("cigar", "[M=X]", 0).isin("=", "X")


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch by so many rows: what a task holds of them as Python objects is small, however many rows a batch has."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def parse_alignments(alignments: DataFrame, contigs: dict[str, int], options: Options) -> DataFrame:
    """Reads (schemas.READ) of alignments that pass the filters. Columns ref_seq and ref_beg, where there, give reference."""
    from ..schemas import READ

    rows = alignments.filter(read_filter(options))
    has_ref = "ref_seq" in rows.columns
    schema = to_arrow_schema(StructType.fromDDL(READ))

    def run(batches):
        for batch in (part for whole in batches for part in pieces(whole)):
            out = []
            for a in batch.to_pylist():
                window = Window(a["ref_seq"], a["ref_beg"]) if has_ref and a.get("ref_seq") else None
                p = parse(a, contigs.get(a["chrom"], 0), window, options)
                p["noisy"] = [{"beg": b, "fin": f, "label": n} for b, f, n in p["noisy"]]
                out.append({k: a[k] for k in ("read_id", "qname", "tid", "mapq", "flag", "nm", "input_idx", "seq", "qual", "hs")} | p | {"rev": bool(a["flag"] & REVERSE)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, READ)
