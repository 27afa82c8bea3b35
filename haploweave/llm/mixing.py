"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule w_s(t) over training time t in [0, 1]: a
piecewise linear curve given by its values at evenly spaced knots, integrated
exactly. Its share of the training words is its constant weight times the integral;
a source's target is its share of all words, at most ``most_repeats`` times the source's size, and
what exceeds that is shared out again by weight until no source is above. A
source is read in a fixed shuffled order (hash of the row), over and over, until
its demand is met; the last document is cut at a word. A reading that starts
after x words of its source gets the training time t at which the cumulative
demand of the source, target * W_s(t) / W_s(1), reaches x; readings (in ``mix``)
or documents by their first reading (in ``ordered``) are range-sorted by that
position, ties by place in the source, source and row.

Distribution. Word counts come from one scan; a source's running sums are built
in two levels, ranges of the row's hash within a source and rows within a range.
There are as many ranges as shuffle partitions, but as they follow the order of
the hash, neither the order nor what is taken depends on their number. So a source
with a third of all rows is spread over all tasks, and what is summed in one place
is a row a source and range. The driver gets one row a source, for at most
``MOST_SOURCES`` of them; more are refused with an error.

Defined results: a null text has size 0; documents of size 0 are taken once a
full pass of their source and add nothing; null is a source of its own (after all
others); repeated rows are documents of their own, in an order that depends on
their content only; no rows give no rows. All of the caller's columns travel
inside one struct column, ``row``, so no name of theirs can clash.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, partitions

#: Sources that the driver works out shares for: a row of a name and two numbers each.
MOST_SOURCES = 1_000_000


def source_weights(sources: Sequence[str | None], pattern: Sequence[float] = (1.0, 2.0, 3.0)) -> dict[str | None, float]:
    """Sources by code point, null last, weigh as the pattern says, repeating."""
    order = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    return {s: pattern[i % len(pattern)] for i, s in enumerate(order)}


def share_out(sizes: dict, weights: dict, total: float, most_repeats: float = 3.0) -> dict:
    """Targets by weight that add up to total, none above most_repeats times its size; the excess goes to the others by weight."""
    left, target, rest = {s for s in sizes if weights[s] > 0}, {s: 0.0 for s in sizes}, float(total)
    while left:
        per = rest / sum(weights[s] for s in left)
        full = {s for s in left if per * weights[s] >= most_repeats * sizes[s]}
        if not full:
            target |= {s: per * weights[s] for s in left}
            break
        for s in full:
            target[s] = most_repeats * sizes[s]
            rest -= target[s]
        left -= full
    return target


@dataclass(frozen=True)
class Schedule:
    """A weight curve: values at evenly spaced times from 0 to 1, straight lines between."""

    knots: tuple[float, ...] = (1.0, 1.0)

    def integral(self) -> float:
        return sum((a + b) / 2 for a, b in zip(self.knots, self.knots[1:])) / (len(self.knots) - 1)

    def inverse(self, part):
        """Column: the time at which the given part (0 to 1) of the integral is reached."""
        n, done, whole = len(self.knots) - 1, 0.0, self.integral()
        out = F.lit(1.0)
        pieces = []
        for i, (a, b) in enumerate(zip(self.knots, self.knots[1:])):
            area = (a + b) / 2 / n
            rest = (part * whole - done) * n  # area still to cover, in units of the piece's width
            slope = b - a
            root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0)))
            x = F.coalesce(F.try_divide(2 * rest, a + root), F.lit(0.0))
            pieces.append((done + area, (i + F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))) / n))
            done += area
        for end, t in reversed(pieces):
            out = F.when(part * whole <= end, t).otherwise(out)
        return out


def inverse_sql(schedule: Schedule, part: str) -> str:
    """``Schedule.inverse`` in SQL, operation for operation."""
    n, done, whole, out = len(schedule.knots) - 1, 0.0, schedule.integral(), "1e0"
    pieces = []
    for i, (a, b) in enumerate(zip(schedule.knots, schedule.knots[1:])):
        rest = f"((({part}) * {whole!r}e0 - {done!r}e0) * {n})"
        root = f"sqrt(greatest({a * a!r}e0 + {2 * (b - a)!r}e0 * {rest}, 0e0))"
        x = f"coalesce(2 * {rest} / nullif({a!r}e0 + {root}, 0), 0e0)"
        done += (a + b) / 2 / n
        pieces.append((done, f"({i} + least(greatest({x}, 0e0), 1e0)) / {n}"))
    for end, t in reversed(pieces):
        out = f"CASE WHEN ({part}) * {whole!r}e0 <= {end!r}e0 THEN {t} ELSE {out} END"
    return out


#: Early sources fade, late sources rise, others hold: the curriculum that weights repeat over.
CURRICULUM = (Schedule((2.0, 1.0, 0.0)), Schedule((1.0, 1.0)), Schedule((0.0, 1.0, 2.0)))


def plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1.0, 2.0, 3.0), schedules: Sequence[Schedule] = CURRICULUM, most_repeats: float = 3.0, keep: Sequence[str] | None = None) -> DataFrame:
    """row (a struct of docs' columns, or of those of ``keep``) and source, size, source_size, target, start (words of its
    source before it), full (whole readings), part (words of the cut one), demand, schedule, key (hash of the row)."""
    ranges = partitions(docs.sparkSession)
    kept = list(docs.columns if keep is None else keep)
    hashed = [F.col(f"`{c}`").cast("string") for c, t in docs.dtypes if c in (text_col, source_col) or t in ("bigint", "int", "string")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{source_col}`").alias("source"), _number(F.md5(F.concat_ws("\x1f", *hashed))).alias("key"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )
    per_source = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["source"]: r["n"] for r in per_source}
    weight = source_weights(list(sizes), weights)
    order = list(source_weights(list(sizes), range(len(sizes))).items())
    share = {s: weight[s] * schedules[i % len(schedules)].integral() for s, i in order}
    target = share_out(sizes, share, sum(sizes.values()), most_repeats)
    facts = [(s, sizes[s], target[s], round(target[s]), i % len(schedules)) for s, i in order]
    table = docs.sparkSession.createDataFrame(facts, "of string, source_size long, target double, demand long, schedule int")
    # Ranges of the hash, in its order: its upper 32 of 60 bits, scaled.
    rows = rows.withColumn("range", F.shiftright(F.shiftright("key", 28) * ranges, 32).cast("int"))
    per_range = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A row a source and range: as many as sources times shuffle partitions.
    offsets = per_range.select(F.col("source").alias("of_source"), F.col("range").alias("of_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if len(facts) * ranges <= 100_000:  # an upper bound of its rows
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_range", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("range") == F.col("of_range")), "left")
    # A row a source, and the driver has them: broadcast while they are few.
    placed = placed.join(F.broadcast(table) if len(facts) <= 100_000 else table, F.col("source").eqNullSafe(F.col("of")), "left")
    start = F.col("in_range") + F.col("offset")
    full = F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(F.lit(0))
    rest = F.col("demand") - full * F.col("source_size")
    part = F.greatest(F.least(rest - start, F.col("size")), F.lit(0))
    return placed.select("row", "source", "size", "source_size", "target", start.alias("start"), full.alias("full"), part.alias("part"), "demand", "schedule", "key")


def _number(digest):
    """The first 60 bits of a digest in hexadecimal digits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def timed(planned: DataFrame, schedules: Sequence[Schedule] = CURRICULUM) -> DataFrame:
    """Planned columns and readings: epoch, words and position of each reading of the document, in order."""
    none = F.array().cast("array<bigint>")
    whole = F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).otherwise(none)
    epochs = F.concat(whole, F.when(F.col("part") > 0, F.array(F.col("full"))).otherwise(none))

    def reading(epoch):
        part = F.when(F.col("demand") > 0, (epoch * F.col("source_size") + F.col("start")) / F.col("demand")).otherwise(F.lit(0.0))
        place = F.lit(None).cast("double")
        for i, s in enumerate(schedules):
            place = F.when(F.col("schedule") == i, s.inverse(part)).otherwise(place)
        words = F.when(epoch < F.col("full"), F.col("size")).otherwise(F.col("part"))
        return F.struct(epoch.alias("epoch"), words.alias("words"), place.alias("position"))

    return planned.withColumn("readings", F.transform(epochs, reading))


def readings(planned: DataFrame, schedules: Sequence[Schedule] = CURRICULUM) -> DataFrame:
    """A row for each reading of a document: planned columns, epoch, words (taken in it), position in [0, 1]."""
    rows = timed(planned, schedules).withColumn("reading", F.explode("readings"))
    return rows.select(*planned.columns, "reading.epoch", "reading.words", "reading.position")


def ordered(docs: DataFrame, text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """A row for each document, range-sorted by its first reading (unread ones last): planned columns, taken (words of all its
    readings) and positions, the training times of its readings."""
    rows = timed(plan(docs, text_col, source_col, **options), options.get("schedules", CURRICULUM))
    taken = F.aggregate("readings.words", F.lit(0).cast("bigint"), lambda n, w: n + w)
    rows = rows.withColumn("taken", taken).withColumn("positions", F.col("readings.position"))
    order = [F.get("positions", F.lit(0)).asc_nulls_last(), "start", "source", "key"]
    return rows.drop("readings").repartitionByRange(*order).sortWithinPartitions(*order)


#: What readings are sorted by.
ORDER = ("position", "start", "epoch", "source", "key")


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", length_col: str | None = None, **options) -> DataFrame:
    """The training order: docs' columns, a row for each reading, range-sorted by position. A source's last reading ends
    where its demand ends, after a word; ``length_col`` (characters) follows the text."""
    rows = readings(plan(docs, text_col, source_col, **options), options.get("schedules", CURRICULUM))
    cut, text = F.col("words") < F.col("size"), F.col("row")[text_col]
    made = {text_col: F.when(cut, _first_words(text)).otherwise(text)}
    if length_col:
        made[length_col] = F.when(cut, F.length(made[text_col]).cast(dict(docs.dtypes)[length_col])).otherwise(F.col("row")[length_col])
    out = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _first_words(text):
    """The first ``words`` words of a text, with a space between."""
    return F.array_join(F.slice(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), 1, F.col("words").cast("int")), " ")
