"""Minimax contiguous partition into shards, with DataFrame operations only.

Atomic groups are equal texts, in the order of their smallest doc_id. The least
capacity is found by binary search: a capacity is feasible if filling shards
greedily, group after group, needs no more than the given number of shards. Within
that capacity the groups are then cut evenly: each cut is the group boundary nearest
to an equal division, no further than the capacity lets the shard reach, and no
earlier than the greedy filling from the other end needs for what remains. So the
largest shard is the least possible and the last is not left short.

The driver never sees the groups. It holds a histogram of them along the order
(``cells`` cells at most: first key, bytes, largest group), and searches with
it twice, once as if a cell were one indivisible group (an upper bound) and once
as if it were divisible (a lower bound). Only cells in which a cut can fall for
some capacity between both bounds stay open; they are divided and counted again,
with whatever lies between them as one closed run, until each open cell is one
group and both bounds agree; then, likewise, the cells in which the even cuts fall.
Every round divides the doubt by about the number of
cells a shard, so a handful of rounds settles any number of groups.

The order starts with what fits: a group larger than an equal share of what it and
all smaller ones hold would leave shards empty, so such groups (fewer than there
are shards) come last and get a shard each; the search is over the others.

Rows find their group by the text's SHA-256 through one plain join that adaptive
execution can split where a group is hot (groups are a row each, aggregated
before the shuffle), and their shard by comparing the group's key with the cuts.
Slots are numbered in two levels: rows in a bucket of a shard, buckets in a
shard, with as many buckets a shard as the session has shuffle partitions.

Defined results: null texts are one group of size 8 a row, apart from the empty
text; groups that share their smallest doc_id (only where a doc_id repeats) are
cut as one; a null doc_id comes first; repeated rows are rows of their own; an
empty table gives no rows; more shards than groups leaves shards empty. Columns
of the input are passed on whatever their names.
"""
from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions

LEAST = -(2**63)


class Cells:
    """Runs of the order, each with first and last key, bytes, its largest group and its number of groups."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.rows = sorted(rows)
        self.before = [0]
        for _, _, size, _, _ in self.rows:
            self.before.append(self.before[-1] + size)
        self.total = self.before[-1]

    def fill(self, capacity: int, shards: int, early: bool) -> list[int] | None:
        """Where greedy filling starts each shard after the first, in bytes from the start; None if the shards don't suffice.

        In a cell of several groups only bounds are known: a shard ends no later than its capacity, and, as the next
        group did not fit, less than the cell's largest group before that. ``early`` takes the earlier bound."""
        at, cuts = 0, []
        while at + capacity < self.total:
            if len(cuts) == shards - 1:
                return None
            i = bisect_right(self.before, at + capacity) - 1
            _, _, _, most, groups = self.rows[i]
            at = self.before[i] if groups == 1 else max(self.before[i], at + capacity - most + 1) if early else at + capacity
            cuts.append(at)
        return cuts

    def least(self, low: int, shards: int, early: bool) -> int:
        """Binary search for the least capacity, from low up, that suffices."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, early) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def needed(self, capacity: int, shards: int, late: bool) -> list[int]:
        """Where each shard after the first may start at the earliest, for the rest to fit: greedy filling from the end. In a
        cell of several groups only bounds are known; ``late`` takes the later one."""
        at, out = self.total, []
        for _ in range(shards - 1):
            at = max(0, at - capacity)
            i = bisect_right(self.before, at) - 1
            if i < len(self.rows) and self.before[i] < at:
                _, _, _, most, groups = self.rows[i]
                at = self.before[i + 1] if groups == 1 else min(self.before[i + 1], at + most - 1) if late else at
            out.append(at)
        return out[::-1]

    def even(self, capacity: int, needed: list[int], shards: int) -> tuple[list[int], set[int]]:
        """Starts of the shards after the first, near equal and none above a capacity that suffices; and the cells of several
        groups that a start was looked for in, without which the starts are not settled."""
        at, cuts, doubtful = 0, [], set()
        for j, least in enumerate(needed, 1):
            ideal = self.total * j // shards
            i = min(bisect_right(self.before, ideal), len(self.rows)) - 1
            new = min(self.before[i : i + 2], key=lambda x: (abs(x - ideal), x))
            if new < least:
                new, i = least, -1
            if new <= at:  # the shard before ended beyond its share: one group at least
                i = bisect_right(self.before, at) - 1
                new = self.before[min(i + 1, len(self.rows))]
            if new > at + capacity:
                i = bisect_right(self.before, at + capacity) - 1
                new = self.before[i]
            if 0 <= i < len(self.rows) and self.rows[i][4] > 1:
                doubtful.add(i)
            if not at < new < self.total:
                break
            cuts.append(new)
            at = new
        return cuts, doubtful

    def between(self, a: int, b: int) -> range:
        """Cells that bytes a to b fall into."""
        return range(bisect_right(self.before, a) - 1, min(bisect_right(self.before, b), len(self.rows)))


def cuts_of(groups: DataFrame, shards: int, cells: int = 4096) -> list[int]:
    """First keys of the shards after the first. groups: key long, size long, one row a group, keys distinct."""
    first, last, total, most = groups.agg(F.min("key"), F.max("key"), F.sum("size"), F.max("size")).first()
    if first is None:
        return []
    spans, settled, capacity = [(first, last)], [], None
    while True:
        each = max(2, cells // len(spans))
        steps = [-(-(hi - lo + 1) // each) for lo, hi in spans]
        los, his, widths = (F.array(*[F.lit(x) for x in xs]) for xs in ([lo for lo, _ in spans], [hi for _, hi in spans], steps))
        span = groups.select("key", "size", (F.size(F.filter(los, lambda x: x <= F.col("key"))) - 1).alias("span"))
        inside = span.filter((F.col("span") >= 0) & (F.col("key") <= F.get(his, F.col("span"))))
        cell = inside.select("key", "size", "span", F.get(los, F.col("span")).alias("lo"), F.get(widths, F.col("span")).alias("step")).withColumn(
            "cell", F.expr("CAST((CAST(key AS DECIMAL(20, 0)) - CAST(lo AS DECIMAL(20, 0))) div CAST(step AS DECIMAL(20, 0)) AS BIGINT)")
        )
        # At most ``cells`` rows, whatever the number of groups.
        counted = cell.groupBy("span", "cell").agg(F.min("key"), F.max("key"), F.sum("size"), F.max("size"), F.count("*")).collect()
        state = Cells(settled + [tuple(r)[2:] for r in counted])
        if capacity is None:
            low = state.least(max(most, -(-total // shards)), shards, early=False)
            high = state.least(low, shards, early=True)
            furthest = state.fill(high, shards, early=False)
            # For the true capacity, between low and high, a shard starts between these bounds.
            from_ = _padded(state, low, shards)
            open_cells = {i for a, b in zip(from_, furthest + [state.total] * shards) for i in state.between(a, b) if state.rows[i][4] > 1}
            if not open_cells:
                capacity = high
        if capacity is not None:
            early, late = state.needed(capacity, shards, False), state.needed(capacity, shards, True)
            open_cells = {i for a, b in zip(early, late) if a < b for i in state.between(a, b) if state.rows[i][4] > 1}
            cuts, looked = state.even(capacity, late, shards)
            open_cells |= looked
            if not open_cells:
                return [state.rows[bisect_right(state.before, a) - 1][0] for a in cuts]
        spans = [state.rows[i][:2] for i in sorted(open_cells)]
        settled = [r for i, r in enumerate(state.rows) if i not in open_cells]


def _padded(state: Cells, capacity: int, shards: int) -> list[int]:
    """Early starts at a capacity that may not suffice: as many as there are shards."""
    return state.fill(capacity, state.total + shards, early=True)[: shards - 1]


def giants(groups: DataFrame, shards: int) -> list[int]:
    """Keys of the groups that are larger than an equal share of what they and the smaller ones hold: fewer than shards."""
    rest, found = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], []
    while shards - len(found) > 1:
        left = shards - len(found)
        more = groups.filter((F.col("size") * left > rest) & ~F.col("key").isin(found)).orderBy(F.desc("size"), "key").limit(left - 1).collect()
        if not more:
            break
        for key, size in more:
            if size * (shards - len(found)) > rest and len(found) < shards - 1:
                found.append(key)
                rest -= size
    return found


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, cells: int = 4096) -> DataFrame:
    """docs' id (as doc_id), size, text_crc32, shard, slot: one row for each row of docs; sizes of shards are near equal."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.sha2(raw, 256)).alias("group"),
    )
    by_text = rows.groupBy("group").agg(F.coalesce(F.min("doc_id"), F.lit(LEAST)).alias("key"), F.sum("size").alias("size"))
    by_text = checkpoint(by_text)
    groups = by_text.groupBy("key").agg(F.sum("size").alias("size"))
    alone = giants(groups, shards)
    cuts = cuts_of(groups.filter(~F.col("key").isin(alone)) if alone else groups, shards - len(alone), cells)
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(F.col("key") >= F.lit(cut), 1).otherwise(0)
    for i, key in enumerate(alone):
        number = F.when(F.col("key") == F.lit(key), shards - len(alone) + i).otherwise(number)
    placed = rows.join(by_text.select("group", number.cast("int").alias("shard")), "group")
    buckets = partitions(docs.sparkSession)
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"))
    # A row a shard and bucket: shards times shuffle partitions.
    per = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"))
    )
