"""Stitching phase sets across tiles, and by graph threads.

The votes are aggregations over reads; what they decide goes from left to right,
as a fold over one row a tile or phase block (``fold_*``), run once a contig. The
outcome is a small table (tile, phase set) to (new phase set, flip) that is joined
back to sites and reads.
"""
from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import Options
from .phase import Phaser


def boundary_votes(left: DataFrame, right: DataFrame, pair: list[str], read: list[str]) -> DataFrame:
    """Votes of reads that two neighbouring tiles share: one row a pair of tiles.

    left and right: the pair's key, the read's key, hap and phase_set; reads without a haplotype must be left out.
    score: reads that disagree less those that agree; left_ps: highest phase set on the left, right_ps: lowest on the
    right. Reads are joined by identity, not by their place in a list."""
    r = right.select(*pair, *read, F.col("hap").alias("r_hap"), F.col("phase_set").alias("r_ps"))
    both = left.join(r, [*pair, *read])
    return both.groupBy(*pair).agg(
        F.sum(F.when(F.col("hap") == F.col("r_hap"), -1).otherwise(1)).cast("long").alias("score"), F.max("phase_set").alias("left_ps"), F.min("r_ps").alias("right_ps"), F.count("*").alias("n_reads")
    )


def thread_support(reads: DataFrame, hs: DataFrame, sidecar: DataFrame, block: list[str]) -> DataFrame:
    """Reads by thread and haplotype in each phase block: block, thread, h1, h2. Set ids that the sidecar lacks are ignored.

    A read counts once a thread, whatever the number of its sets that hold it."""
    threads = hs.join(sidecar, "set_id").select("read_id", "thread").distinct()
    phased = reads.filter(F.col("hap").isin(1, 2)).select("read_id", "hap", *block)
    n = lambda h: F.count_if(F.col("hap") == h).alias(f"h{h}")
    return phased.join(threads, "read_id").groupBy(*block, "thread").agg(n(1), n(2))


def polarity(margin: int):
    """Haplotype a thread belongs to by a margin of reads, or null."""
    return F.when(F.col("h1") - F.col("h2") >= margin, 1).when(F.col("h2") - F.col("h1") >= margin, 2)


def concordance(left: DataFrame, right: DataFrame, key: list[str], margin: int, least: int) -> DataFrame:
    """Shared threads of two blocks that are on the same haplotype or on opposite ones, and what follows: merge, flip.

    left and right: key, thread, h1, h2."""
    a = left.withColumn("p", polarity(margin)).filter("p IS NOT NULL").select(*key, "thread", "p")
    b = right.withColumn("q", polarity(margin)).filter("q IS NOT NULL").select(*key, "thread", "q")
    scored = a.join(b, [*key, "thread"]).groupBy(*key).agg(F.count_if(F.col("p") == F.col("q")).alias("same"), F.count_if(F.col("p") != F.col("q")).alias("crossed"))
    return scored.withColumn("merge", (F.col("same") != F.col("crossed")) & (F.greatest("same", "crossed") >= least)).withColumn("flip", F.col("merge") & (F.col("crossed") > F.col("same")))


# --- One contig: folds ---

Support = dict[int, list[int]]  # thread to reads on haplotype 1 and 2


def polarized(support: Support, margin: int) -> dict[int, int]:
    return {t: 1 if a - b >= margin else 2 for t, (a, b) in support.items() if abs(a - b) >= margin}


def decide(left: Support, right: Support, margin: int, least: int) -> bool | None:
    """Whether the right block has to be flipped to go with the left one; None if they are not to be merged."""
    a, b = polarized(left, margin), polarized(right, margin)
    same = sum(b.get(t) == p for t, p in a.items())
    crossed = sum(b.get(t) == 3 - p for t, p in a.items())
    return None if same == crossed or max(same, crossed) < least else crossed > same


def merged(left: Support, right: Support, flip: bool) -> Support:
    out = {t: list(c) for t, c in left.items()}
    for t, (a, b) in right.items():
        x = out.setdefault(t, [0, 0])
        x[0] += b if flip else a
        x[1] += a if flip else b
    return out


def fold_blocks(blocks: list[tuple[int, Support]], margin: int, least: int) -> dict[int, tuple[int, bool]]:
    """Phase blocks by anchor, left to right: each goes to the block before if their threads say so. Returns anchor to (new anchor, flip)."""
    out: dict[int, tuple[int, bool]] = {}
    blocks = sorted(blocks, key=lambda b: b[0])
    for i in range(1, len(blocks)):
        (left, a), (right, b) = blocks[i - 1], blocks[i]
        flip = decide(a, b, margin, least)
        if flip is not None:
            out[right] = (left, flip)
            blocks[i] = (left, merged(a, b, flip))
    return out


class Tile:
    """What stitching needs of a tile: per site phase set and consensus, per read haplotype and phase set."""

    def __init__(self, sites: list[dict], reads: list[dict], hap: list[int], phase_set: list[int], up: list[int] = (), down: list[int] = (), support: dict[int, Support] | None = None):
        self.sites, self.reads, self.hap, self.phase_set = sites, reads, hap, phase_set
        self.support = support  # of phase sets, where it was counted before
        self.up, self.down = list(up), list(down)  # reads shared with the tile before and after, paired in order

    @classmethod
    def of(cls, p: Phaser, up=(), down=()) -> Tile:
        return cls(p.sites, p.reads, p.hap, p.phase_set, up, down)

    def rename(self, old: int, new: int | None, flip: bool, touch_reads: bool) -> None:
        for s in self.sites:
            if s["phase_set"] == old:
                if flip:
                    s["cons"][1], s["cons"][2] = s["cons"][2], s["cons"][1]
                if new is not None:
                    s["phase_set"] = new
        if touch_reads:
            if self.support is not None and old in self.support:
                own = merged({}, self.support.pop(old), flip)
                at = old if new is None else new
                self.support[at] = merged(self.support.get(at, {}), own, False)
            for r in range(len(self.reads)):
                if self.phase_set[r] == old:
                    if flip and self.hap[r] and not self.reads[r]["skipped"]:
                        self.hap[r] = 3 - self.hap[r]
                    if new is not None:
                        self.phase_set[r] = new

    def blocks(self, threads: dict[int, list[int]]) -> dict[int, Support]:
        """Thread support of each phase set; threads: by set id."""
        if self.support is not None:
            return {ps: merged({}, s, False) for ps, s in self.support.items()}
        out: dict[int, Support] = defaultdict(dict)
        for r, read in enumerate(self.reads):
            if read["skipped"] or self.hap[r] not in (1, 2) or self.phase_set[r] < 0:
                continue
            for t in sorted({t for h in read.get("hs") or () for t in threads.get(h, ())}):
                out[self.phase_set[r]].setdefault(t, [0, 0])[self.hap[r] - 1] += 1
            out[self.phase_set[r]]
        return out


def vote(left: Tile, right: Tile) -> tuple[int, int, int]:
    """Score (disagreeing less agreeing reads), highest phase set on the left, lowest on the right."""
    if len(left.down) != len(right.up):
        raise RuntimeError("neighbouring tiles do not share the same reads")
    score, high, low = 0, -1, None
    for a, b in zip(left.down, right.up):
        if left.reads[a]["skipped"] or right.reads[b]["skipped"] or not left.hap[a] or not right.hap[b]:
            continue
        score += -1 if left.hap[a] == right.hap[b] else 1
        high = max(high, left.phase_set[a])
        low = right.phase_set[b] if low is None else min(low, right.phase_set[b])
    return score, high, -1 if low is None else low


def stitch_pair(left: Tile, right: Tile, touch_reads: bool) -> bool:
    """Joins the right tile's first phase set to the left tile's last one; whether the reads decided."""
    if not right.up and not left.down or not left.sites or not right.sites:
        if len(left.down) != len(right.up):
            raise RuntimeError("neighbouring tiles do not share the same reads")
        return False
    score, high, low = vote(left, right)
    if score == 0:
        return False
    right.rename(low, None, score > 0 and low != -1, touch_reads)
    if high != -1 and low != -1:
        right.rename(low, high, False, touch_reads)
    return True


def stitch(tiles: list[Tile], options: Options, threads: dict[int, list[int]] | None = None) -> None:
    """All passes over the tiles of a contig, in order."""
    o = options

    def by_threads(group: list[Tile], margin: int, least: int) -> None:
        support: dict[int, Support] = {}
        for t in group:
            for anchor, s in t.blocks(threads).items():
                support[anchor] = merged(support.get(anchor, {}), s, False)
        for old, (new, flip) in fold_blocks(list(support.items()), margin, least).items():
            for t in group:
                t.rename(old, new, flip, True)

    if threads is not None:
        for t in tiles:
            by_threads([t], o.thread_primary_margin, o.thread_primary_min_winning)
    for left, right in zip(tiles, tiles[1:]):
        if not stitch_pair(left, right, o.output_alignment) and threads is not None:
            a, b = left.blocks(threads), right.blocks(threads)
            if a and b:
                last, first = max(a), min(b)
                flip = decide(a[last], b[first], o.thread_primary_margin, o.thread_primary_min_winning) if last != first else None
                if flip is not None:
                    right.rename(first, last, flip, True)
    if threads is not None and o.thread_cleanup_pass:
        by_threads(tiles, o.thread_cleanup_margin, o.thread_cleanup_min_winning)
    if threads is not None and o.thread_relaxed_cleanup_pass:
        by_threads(tiles, o.thread_relaxed_cleanup_margin, o.thread_relaxed_cleanup_min_winning)


FOLDED = "tid int, chunk_id long, phase_set long, new_phase_set long, flip boolean, of_reads boolean"


def fold_contig(tiles: list[dict], options: Options, by_threads: bool) -> list[tuple]:
    """Stitches the tiles of a contig from summaries: rows of FOLDED, for sites and for reads.

    A tile: tid, chunk_id, phase_sets (of its sites), and reads that it shares with a neighbour: read_id, hap, phase_set, in_prev,
    in_next; with threads also support, (phase_set, thread, h1, h2). Shared reads are paired by identity."""
    tiles = sorted(tiles, key=lambda t: t["chunk_id"])
    made = []
    for n, t in enumerate(tiles):
        sites = [{"phase_set": ps, "cons": [0, 1, 2], "origin": ps} for ps in t["phase_sets"]]
        blank = {"skipped": False}
        reads, hap, ps = [], [], []
        for x in t["phase_sets"]:  # one read a phase set shows what becomes of reads
            reads.append(blank), hap.append(1), ps.append(x)
        number = {}
        for r in t["reads"]:
            number[r["read_id"]] = len(reads)
            reads.append(blank), hap.append(r["hap"]), ps.append(r["phase_set"])
        before = {r["read_id"] for r in tiles[n - 1]["reads"] if r["in_next"]} if n else set()
        after = {r["read_id"] for r in tiles[n + 1]["reads"] if r["in_prev"]} if n + 1 < len(tiles) else set()
        up = [number[i] for i in sorted(r["read_id"] for r in t["reads"] if r["in_prev"]) if i in before]
        down = [number[i] for i in sorted(r["read_id"] for r in t["reads"] if r["in_next"]) if i in after]
        support: dict[int, Support] = {}
        for x, thread, h1, h2 in t.get("support") or ():
            support.setdefault(x, {})[thread] = [h1, h2]
        made.append(Tile(sites, reads, hap, ps, up, down, support))
    stitch(made, options, {} if by_threads else None)
    out = []
    for t, tile in zip(tiles, made):
        for k, s in enumerate(tile.sites):
            out.append((t["tid"], t["chunk_id"], s["origin"], s["phase_set"], s["cons"][1] == 2, False))
            out.append((t["tid"], t["chunk_id"], s["origin"], tile.phase_set[k], tile.hap[k] == 2, True))
    return out


def fold(summaries: DataFrame, options: Options, by_threads: bool = False) -> DataFrame:
    """fold_contig for each contig; summaries has one row a tile (tid, chunk_id, phase_sets, reads, support)."""
    columns = [c.split()[0] for c in FOLDED.split(", ")]
    kinds = {"tid": "int32", "chunk_id": "int64", "phase_set": "int64", "new_phase_set": "int64", "flip": "bool", "of_reads": "bool"}

    def run(rows):
        tiles = [{k: v if isinstance(v, (int, float)) else list(v) for k, v in r.items()} for r in rows.to_dict("records")]
        return pd.DataFrame(fold_contig(tiles, options, by_threads), columns=columns).astype(kinds)

    return summaries.groupBy("tid").applyInPandas(run, FOLDED)
