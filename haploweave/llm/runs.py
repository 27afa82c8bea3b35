"""Periodic runs of words by an all-lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) that is at least ``min_length`` words and ``min_exp`` periods long and
that no neighbouring word extends. The words of a text become an array of ids; the
array is compared with each shift of itself, up to a ``min_exp``-th of its length,
many shifts at once (rows of a view of the array, no copies). What is equal is
read eight cells at a time: a stretch that is long enough fills one such piece
at least, so only shifts that have a full piece are run-length coded. A stretch of
k equal cells at shift q is a run of k + q words of period q; of the shifts that
find the same stretch the least is its smallest period, as by the theorem of Fine
and Wilf that divides all others from two periods on.

Distribution. The work of a text is the square of its words. Texts of at most
``long_bytes`` are scanned where they are read. A longer one is cut into ranges
of lags that compare ``cells`` cells each; its ids go to one task for each range,
what the ranges find is aggregated by text and stretch, and the runs, fewer than
the text has words, meet their text again. So no task holds a whole long text's
work, whatever its length.

Defined results: a null text has no words, as an empty one; repeated rows are
texts of their own; no rows give no rows. The columns of ``keep`` travel in one
struct, so no name of the caller's can clash.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_binary, checkpoint, partitions

#: Eight cells that are equal, one byte each.
FULL = 0x0101010101010101
RUN = "array<struct<start:long,length:long,period:long>>"
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_ids(words: Sequence[bytes]) -> np.ndarray:
    """Numbers for words, alike for like words, in the narrowest type that leaves two numbers free."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    kind = np.uint16 if len(number) < 2**16 - 2 else np.uint32
    return np.fromiter(map(number.__getitem__, words), kind, len(words))


def lag_ranges(n: int, cells: int, min_exp: int = 3) -> list[tuple[int, int]]:
    """Ranges (from, to excluded) of the lags 1 to n/min_exp that compare about so many cells each."""
    out, low, top = [], 1, n // min_exp
    while low <= top:
        high = min(top + 1, low + max(1, cells // (n - low)))
        out.append((low, high))
        low = high
    return out


def stretches(ids: np.ndarray, low: int, high: int, min_length: int = 24, min_exp: int = 3, at_once: int = 1 << 19) -> np.ndarray:
    """Rows (start, length, lag) of all stretches that repeat at the lags from low up to high (excluded), as long as asked."""
    n, found = len(ids), []
    high = min(high, n // min_exp + 1)
    if low >= high:
        return np.empty((0, 3), np.int64)
    lags = np.arange(low, high)
    least = np.maximum(min_length - lags, (min_exp - 1) * lags)  # equal cells that a run has at least
    in_pieces = least.min() >= 15  # such a stretch has a full piece
    kind, free = ids.dtype.type, int(ids.max()) + 1
    width = -(-n // 8) * 8
    mine = np.concatenate([ids, np.full(width - n, free, kind)])
    shifts = sliding_window_view(np.concatenate([ids, np.full(width - n + high, free + 1, kind)]), width)
    while low < high:
        size = -(-(n - low) // 8) * 8
        rows = min(high - low, max(1, at_once // size))
        equal = shifts[low : low + rows, :size] == mine[:size]
        hit = (equal.view(np.uint64) == FULL).any(axis=1) if in_pieces else equal.any(axis=1)
        for row in np.flatnonzero(hit):
            lag = low + int(row)
            edge = np.flatnonzero(np.diff(equal[row, : n - lag].view(np.int8), prepend=0, append=0))
            start, k = edge[::2], edge[1::2] - edge[::2]
            good = k >= max(1, min_length - lag, (min_exp - 1) * lag)
            if good.any():
                found.append(np.stack([start[good], k[good] + lag, np.full(good.sum(), lag)], axis=1))
        low += rows
    return np.concatenate(found).astype(np.int64) if found else np.empty((0, 3), np.int64)


def smallest(found: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) by start, then period: of each stretch that with the least lag."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: Sequence[bytes], runs) -> bytes:
    """Words that are in no run, or in the first period of each run that they are in, joined by one space."""
    runs = np.asarray(runs, np.int64).reshape(-1, 3)
    if not len(runs):
        return b" ".join(words)
    over = np.zeros(len(words) + 1, np.int64)
    np.add.at(over, runs[:, 0] + runs[:, 2], 1)
    np.add.at(over, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, np.cumsum(over[:-1]) == 0))


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 24, min_exp: int = 3, keep: Sequence[str] | None = None, rewrite: Callable | None = None, rewrite_by: str | None = None, long_bytes: int = 1 << 15, cells: int = 1 << 28) -> DataFrame:
    """The columns of keep, and n_words, runs (start, length, period; by start, then period) and collapsed (the text
    without what its runs repeat). ``rewrite(words, value of the column rewrite_by)`` may give other words to work on."""
    if min_exp < 2:
        raise ValueError("a run has two periods at least")
    kept = list(docs.columns if keep is None else keep)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    by = F.col(f"`{rewrite_by}`") if rewrite_by else F.lit(None).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(0)).alias("row"), by.alias("by"), text.alias("text"))
    change = rewrite or (lambda words, by: words)

    def words_in(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
        for raw, value in zip(as_binary(batch.column(batch.schema.get_field_index("text"))), batch.column(batch.schema.get_field_index("by")).to_pylist()):
            yield change(raw.as_py().split(), value)

    made = f"n_words long, runs {RUN}, collapsed string"

    def result(batch: pa.RecordBatch, words: list, runs: list) -> pa.RecordBatch:
        as_rows = [[{"start": s, "length": k, "period": q} for s, k, q in np.asarray(r).reshape(-1, 3).tolist()] for r in runs]
        texts = pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(as_rows, FOUND), texts], ["row", "n_words", "runs", "collapsed"])

    def scan(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                words = list(words_in(batch))
                yield result(batch, words, [smallest(stretches(word_ids(w), 1, len(w), min_length, min_exp)) if w else [] for w in words])

    def cut(batches):
        for whole in batches:
            for k in range(whole.num_rows):
                batch = whole.slice(k, 1)
                words = next(words_in(batch))
                ids = word_ids(words)
                raw, name = ids.tobytes(), ids.dtype.str
                for low, high in lag_ranges(len(words), cells, min_exp):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([name]), pa.array([raw], pa.binary())], ["number", "low", "high", "kind", "ids"])

    def scan_range(batches):
        for batch in batches:
            for x in batch.to_pylist():
                found = stretches(np.frombuffer(x["ids"], x["kind"]), x["low"], x["high"], min_length, min_exp)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x["number"])), *(pa.array(found[:, i]) for i in range(3))], ["number", "start", "length", "period"])

    def merged(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                batch = whole.slice(at, 16)
                words = list(words_in(batch))
                found = [[(r["start"], r["length"], r["period"]) for r in x or []] for x in batch.column(batch.schema.get_field_index("runs")).to_pylist()]
                yield result(batch, words, found)

    out = StructType([rows.schema["row"], *StructType.fromDDL(made).fields])
    is_long = F.octet_length("text") > long_bytes
    short = rows.filter(~is_long).mapInArrow(scan, out)
    # Numbered once and kept, so that a lost task can't number rows anew.
    long = checkpoint(rows.filter(is_long).withColumn("number", F.monotonically_increasing_id()))
    pieces = long.select("number", "by", "text").mapInArrow(cut, "number long, low long, high long, kind string, ids binary")
    found = pieces.repartition(partitions(docs.sparkSession), "number", "low").mapInArrow(scan_range, "number long, start long, length long, period long")
    runs = found.groupBy("number", "start", "length").agg(F.min("period").alias("period")).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    told = long.join(runs, "number", "left").select("row", "by", "text", "runs").mapInArrow(merged, out)
    both = short.unionByName(told)
    return both.select(*[F.col("row")[c].alias(c) for c in kept], "n_words", "runs", "collapsed")
