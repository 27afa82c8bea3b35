"""Interval joins and merges.

Intervals are 1-based and closed. A range join is planned by Spark as one task a
contig, so it goes over bins here: both sides are exploded to the bins that they
touch, joined by contig and bin, and a pair is kept only in the bin where its
overlap begins, so no pair comes twice and nothing has to be made distinct.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 12
#: Bases of a contig that one task sums over.
STRETCH = 1 << 18


def _bins(df: DataFrame, beg: str, fin: str, size: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(beg) / size), F.floor(F.col(fin) / size))))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str] = ("tid",), left_span: tuple[str, str] = ("beg", "fin"), right_span: tuple[str, str] = ("beg", "fin"), prefix: str = "r_", bin_size: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals: left's columns, then right's with the prefix."""
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    rb, rf = prefix + right_span[0], prefix + right_span[1]
    left_bins = _bins(left.filter(F.col(left_span[0]) <= F.col(left_span[1])), *left_span, bin_size, "__bin")
    right_bins = _bins(r.filter(F.col(rb) <= F.col(rf)), rb, rf, bin_size, "__rbin")
    condition: Column = F.col("__bin") == F.col("__rbin")
    for c in on:
        condition &= F.col(c) == F.col(prefix + c)
    condition &= (F.col(left_span[0]) <= F.col(rf)) & (F.col(left_span[1]) >= F.col(rb))
    condition &= F.floor(F.greatest(F.col(left_span[0]), F.col(rb)) / bin_size) == F.col("__bin")
    return left_bins.join(right_bins, condition).drop("__bin", "__rbin")


def containment_semi_join(inner: DataFrame, outer: DataFrame, on: Sequence[str] = ("tid",), span: tuple[str, str] = ("beg", "fin"), outer_span: tuple[str, str] = ("beg", "fin"), bin_size: int = BIN) -> DataFrame:
    """Rows of inner whose interval lies within one of outer. Only the bin of the inner interval's beginning counts."""
    o = outer.select(*[F.col(c).alias("o_" + c) for c in outer.columns])
    ob, of = "o_" + outer_span[0], "o_" + outer_span[1]
    o = _bins(o, ob, of, bin_size, "__rbin")
    condition = (F.floor(F.col(span[0]) / bin_size) == F.col("__rbin")) & (F.col(ob) <= F.col(span[0])) & (F.col(of) >= F.col(span[1]))
    for c in on:
        condition &= F.col(c) == F.col("o_" + c)
    return inner.join(o, condition, "left_semi")


def islands(intervals: DataFrame, on: Sequence[str] = ("tid",), beg: str = "beg", fin: str = "fin", gap: int = 1, label: str | None = None, stretch: int = 1 << 20) -> DataFrame:
    """Merges intervals that overlap or are at most ``gap`` apart in bases counted as next - end; n: how many an island holds;
    label: the largest of an island.

    Twice: first within stretches of a contig, so that a contig with most of the rows is spread over many tasks, then over
    what is left of them."""
    rows = intervals.select(*on, beg, fin, F.lit(1).cast("long").alias("n"), *([label] if label else [])).withColumn("__stretch", F.floor(F.col(beg) / stretch))
    return _merged(_merged(rows, [*on, "__stretch"], beg, fin, gap, label), list(on), beg, fin, gap, label)


def _merged(rows: DataFrame, on: list[str], beg: str, fin: str, gap: int, label: str | None) -> DataFrame:
    order = Window.partitionBy(*on).orderBy(beg, fin)
    before = F.max(fin).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col(beg) > before + gap), 1).otherwise(0)
    numbered = rows.withColumn("__new", starts).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    extra = [F.max(label).alias(label)] if label else []
    return numbered.groupBy(*on, "__island").agg(F.min(beg).alias(beg), F.max(fin).alias(fin), F.sum("n").alias("n"), *extra).drop("__island")


def extend_over(intervals: DataFrame, masks: DataFrame, on: Sequence[str] = ("tid",), span: tuple[str, str] = ("beg", "fin"), mask_span: tuple[str, str] = ("beg", "fin"), key: Sequence[str] | None = None, bin_size: int = BIN) -> DataFrame:
    """Grows each interval over the masks that it overlaps, in one pass (masks reached only by growing don't count)."""
    key = list(key or intervals.columns)
    pairs = overlap_join(intervals.select(*dict.fromkeys([*key, *on, *span])), masks.select(*on, *mask_span), on, span, mask_span, "m_", bin_size=bin_size)
    grown = pairs.groupBy(*[F.col(c).alias(f"__k_{c}") for c in key]).agg(F.min("m_" + mask_span[0]).alias("__beg"), F.max("m_" + mask_span[1]).alias("__fin"))
    match = None
    for c in key:
        x = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        match = x if match is None else match & x
    joined = intervals.join(grown, match, "left")
    out = [F.col(c) for c in intervals.columns if c not in span]
    return joined.select(*out, F.least(F.col(span[0]), F.coalesce("__beg", F.col(span[0]))).alias(span[0]), F.greatest(F.col(span[1]), F.coalesce("__fin", F.col(span[1]))).alias(span[1])).select(*intervals.columns)


def overlap_counts(intervals: DataFrame, others: DataFrame, key: Sequence[str], on: Sequence[str] = ("tid",), span: tuple[str, str] = ("beg", "fin"), other_span: tuple[str, str] = ("beg", "fin"), name: str = "n_ov", stretch: int = STRETCH) -> DataFrame:
    """key columns and how many of others each interval overlaps; 0 for none.

    Counted, not paired: those that begin up to its end, less those that end before its beginning. Both are running
    counts along a contig, so work grows with the intervals, however densely they lie."""
    left = intervals.select(*dict.fromkeys([*key, *on, *span]))
    asked = left.filter(F.col(span[0]) <= F.col(span[1])).select(*key, *[c for c in (*on, *span) if c not in key])
    given = others.filter(F.col(other_span[0]) <= F.col(other_span[1]))
    for c in on:  # as in a join, an unknown contig is none
        asked, given = asked.filter(F.col(c).isNotNull()), given.filter(F.col(c).isNotNull())
    none = [F.lit(None).cast(dict(asked.dtypes)[c]).alias(f"__k_{c}") for c in key]
    own = [F.col(c).alias(f"__k_{c}") for c in key]

    def points(df, at, turn, begun, ended, keys, sign):
        """Points of a contig; at one place those that ask for ends, then begins, ends, and those that ask for begins."""
        return df.select(*[F.col(c).alias(f"__on_{i}") for i, c in enumerate(on)], F.col(at).cast("long").alias("__at"), F.lit(turn).alias("__turn"), F.lit(begun).alias("__begun"), F.lit(ended).alias("__ended"), F.lit(sign).alias("__sign"), *keys)

    rows = points(given, other_span[0], 1, 1, 0, none, 0).unionByName(points(given, other_span[1], 2, 0, 1, none, 0))
    rows = rows.unionByName(points(asked, span[1], 3, 0, 0, own, 1)).unionByName(points(asked, span[0], 0, 0, 0, own, -1))
    places = [f"__on_{i}" for i in range(len(on))]
    summed = running_sums(rows, places, ["__at", "__turn"], {"__begun": "__b", "__ended": "__e"}, stretch)
    told = summed.filter("__sign <> 0").groupBy(*[F.col(f"__k_{c}") for c in key]).agg(F.sum(F.when(F.col("__sign") == 1, F.col("__b")).otherwise(-F.col("__e"))).alias("__n"))
    match = None
    for c in key:
        x = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        match = x if match is None else match & x
    return left.join(told, match, "left").select(*key, F.coalesce("__n", F.lit(0)).cast("long").alias(name))


def stretched(rows: DataFrame, on: Sequence[str], place: Column, stretch: int) -> DataFrame:
    """rows with __stretch and __part, a hash of group and stretch. Dealt to tasks by __part, rows need no other exchange for
    what is worked out within stretches and for a join with a row a stretch (``beside``)."""
    cut = rows.withColumn("__stretch", F.floor(place / stretch))
    return cut.withColumn("__part", F.xxhash64(*on, "__stretch"))


def beside(rows: DataFrame, stretches: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows of ``stretched``, dealt by __part, joined with a row a stretch, whose group, stretch and part are named __of_<name>.
    Only parts are the join's keys, so rows stay where they are."""
    match = (F.col("__part") == F.col("__of___part")) & _alike("__stretch")
    for c in on:
        match &= _alike(c)
    return rows.join(stretches, match)


def _alike(c: str) -> Column:
    """Equal, or both null, in a form that is no key of a join."""
    a, b = F.col(c), F.col(f"__of_{c}")
    return ((a >= b) & (a <= b)) | (a.isNull() & b.isNull())


def running_sums(rows: DataFrame, on: Sequence[str], order: Sequence, sums: dict[str, str], stretch: int = STRETCH) -> DataFrame:
    """rows with sums of columns over all rows of a group up to and with the own; order begins with a place along the group.

    In two levels, within stretches of the group and over the stretches' totals, so that no task holds a group."""
    cut = stretched(rows, on, order_column(order[0]), stretch)
    keys = [*on, "__stretch", "__part"]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*[f"__of_{c}" for c in on]).orderBy("__of___stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys).agg(*[F.sum(c).alias(f"__sum_{i}") for i, c in enumerate(sums)]).select(*[F.col(c).alias(f"__of_{c}") for c in keys], *[f"__sum_{i}" for i in range(len(sums))])
    # A row a stretch.
    offsets = totals.select(*[f"__of_{c}" for c in keys], *[F.coalesce(F.sum(f"__sum_{i}").over(before), F.lit(0)).alias(f"__off_{i}") for i in range(len(sums))])
    summed = beside(cut.repartition("__part").withColumns({f"__in_{i}": F.sum(c).over(within) for i, c in enumerate(sums)}), offsets, on)
    return summed.select(*rows.columns, *[(F.col(f"__in_{i}") + F.col(f"__off_{i}")).alias(name) for i, name in enumerate(sums.values())])


def order_column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def numbered(rows: DataFrame, on: Sequence[str], order: Sequence, name: str, stretch: int = STRETCH) -> DataFrame:
    """rows numbered from 1 within their group; order is total and begins with a place along the group."""
    one = running_sums(rows.withColumn("__one", F.lit(1)), on, order, {"__one": name}, stretch)
    return one.drop("__one").withColumn(name, F.col(name).cast("int"))


def cluster(intervals: list[tuple[int, int, int]], window: int | None = None) -> list[tuple[int, int, int]]:
    """Clusters (start, end, label) half-open intervals to a fixpoint.

    One pass goes through the intervals by start; each that is left takes in every later one that begins within reach
    of its growing end: the smaller of both labels, or ``window`` where given. Labels grow to the largest. Passes are
    repeated until the number of intervals stays the same."""
    now = sorted(intervals, key=lambda x: x[0])
    while True:
        out, used = [], [False] * len(now)
        for i, (beg, end, label) in enumerate(now):
            if used[i]:
                continue
            for j in range(i + 1, len(now)):
                if now[j][0] > end + (label if window is None else window):
                    break  # starts rise, and no label reaches further than the own
                if not used[j] and end + (min(label, now[j][2]) if window is None else window) >= now[j][0]:
                    used[j] = True
                    beg, end, label = min(beg, now[j][0]), max(end, now[j][1]), max(label, now[j][2])
            out.append((beg, end, label))
        out.sort(key=lambda x: x[0])
        if len(out) == len(now):
            return out
        now = out
