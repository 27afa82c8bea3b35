"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (orders 1..``order`` into
``buckets`` buckets, add-one smoothed): one of target text, one of raw text. A
document's importance weight is the ratio of the probabilities they give it, and
k documents are drawn without replacement in proportion to their weights by
Gumbel top-k: the k largest log weights plus Gumbel noise. The noise is a hash of
the document's id and text, so a rerun draws the same.

The raw model counts every document; counting is map-side into one vector a task,
summed by slices of it. The target model is fitted on at most ``max_target``
labelled target rows (a documented bound; the ids are broadcast). The k-th key is
found by counting keys, whole doubles in their order as longs, in 65,536 cells of
ever finer ranges (four rounds settle 64 bits), never by sorting or collecting keys.

Defined results: null texts are empty texts of weight 1 (log 0); equal keys go to
the smaller doc_id (null first), rows alike in both go together only as far as k
allows: they are numbered in each partition, after a count of each, so no task gets
them all. No rows give no rows; without target rows all weights are those of a
uniform target; texts of any length are counted whole; further columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_binary, checkpoint, words_of
from .lm import mix


class Keys(dict):
    """Word to key, forgotten when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word, 0)
        return key


def features(raw: bytes | None, keys: Keys, order: int, buckets: int) -> np.ndarray:
    """Buckets of all n-grams of a text, repeats included."""
    w = words_of(raw)
    one = np.fromiter(map(keys.__getitem__, w), np.uint64, len(w))
    grams, out = one, [one]
    for _ in range(1, order):
        grams = mix(grams[:-1], one[len(one) - len(grams) + 1 :])
        out.append(grams)
    return (np.concatenate(out) % np.uint64(buckets)).astype(np.int64)


def counts_of(docs: DataFrame, text_col: str, order: int, buckets: int) -> np.ndarray:
    """Feature counts over all rows. What reaches the driver is the vector itself, of fixed size."""

    def run(batches):
        total, keys = np.zeros(buckets, np.int64), Keys()
        for batch in batches:
            for raw in as_binary(batch.column(0)).to_pylist():
                total += np.bincount(features(raw, keys, order, buckets), minlength=buckets)
        cut = 256
        for i in range(0, buckets, cut):
            yield pa.RecordBatch.from_arrays([pa.array([i // cut], pa.int32()), pa.array([total[i : i + cut].tolist()], pa.list_(pa.int64()))], ["slice", "n"])

    slices = docs.select(text_col).mapInArrow(run, "slice int, n array<long>").select("slice", F.posexplode("n"))
    out = np.zeros(buckets, np.int64)
    for r in slices.groupBy("slice", "pos").agg(F.sum("col").alias("n")).collect():
        out[r["slice"] * 256 + r["pos"]] = r["n"]
    return out


def place_of(keys: np.ndarray) -> np.ndarray:
    """Doubles as longs in the same order: the bits, all but the sign turned over below zero."""
    bits = (keys + 0.0).view(np.int64)  # -0.0 is 0.0
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def weigh(docs: DataFrame, target: np.ndarray, raw: np.ndarray, id_col: str, text_col: str, order: int, seed: int, into: str) -> DataFrame:
    """docs and a struct: n_features, log_weight, key (log weight plus Gumbel noise), place (the key as a long of the same order)."""
    names, places = list(docs.columns), (docs.columns.index(id_col), docs.columns.index(text_col))
    buckets = len(raw)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    struct = T.StructType([T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("key", T.DoubleType()), T.StructField("place", T.LongType())])

    def run(batches):
        log_ratio, keys = sent.value, Keys()
        for batch in batches:
            n, weight, key = [], [], []
            for i, text in zip(batch.column(places[0]).to_pylist(), as_binary(batch.column(places[1])).to_pylist()):
                f = features(text, keys, order, buckets)
                w = float(log_ratio[f].sum())
                u = (xxhash.xxh64_intdigest(str(i).encode() + b" " + (text or b""), seed) + 0.5) / 2**64
                n.append(len(f)), weight.append(w), key.append(w - float(np.log(-np.log(u))) if u < 1 else w + 45.0)
            column = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array(key, pa.float64()), pa.array(place_of(np.array(key, float)))], ["n_features", "log_weight", "key", "place"])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, struct)]))


def kth_key(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """The k-th largest of long column ``o`` and how many rows equal to it are among the k. None if there are no k rows."""
    low, need = -(2**63), k
    for shift in (48, 32, 16, 0):
        # Rows still in doubt lie in [low, low + 2^(shift + 16)); count them in 65,536 cells.
        top = low + (1 << (shift + 16)) - 1
        cells = keys.filter(F.col("o").between(low, top)).groupBy(F.shiftright(F.col("o"), shift).alias("c")).count().collect()
        for c, n in sorted(cells, reverse=True):
            if n >= need:
                low = c << shift
                break
            need -= n
        else:
            return None
    return low, need


def resample(docs: DataFrame, target_ids: DataFrame, k: int | None = None, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = 2, buckets: int = 65_536, max_target: int = 20_000, seed: int = 1) -> DataFrame:
    """id and n_features, log_weight, key, kept for each row; k rows are kept, or share of all rows."""
    chosen = target_ids.select(F.col(id_col)).dropna().distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_target)
    target = counts_of(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col, "left_semi"), text_col, order, buckets)
    raw = counts_of(docs, text_col, order, buckets)
    scored = weigh(docs.select(id_col, text_col), target, raw, id_col, text_col, order, seed, "s")
    rows = checkpoint(scored.select(F.col(id_col).alias("id"), "s.n_features", "s.log_weight", "s.key", F.col("s.place").alias("o")))
    k = k if k is not None else int((share if share is not None else 0.5) * rows.count())
    found = kth_key(rows, k) if k > 0 else None
    if found is None:
        kept = rows.withColumn("kept", F.lit(k > 0))
    else:
        at, room = found
        ties = rows.filter(F.col("o") == at)
        sure = rows.filter(F.col("o") != at).withColumn("kept", F.col("o") > at)
        # Rows that tie at the very key: by id, and rows of one id by partition (the rows are a checkpoint, so these are fixed).
        ties = ties.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id())
        counts = ties.groupBy("id", "part").count()  # a row a tied id and partition
        before = Window.orderBy("id", "part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(F.col("id").alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
        within = F.row_number().over(Window.partitionBy("id", "part").orderBy("nth"))
        ties = ties.withColumn("within", within).join(counts, F.col("id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
        kept = sure.unionByName(ties.withColumn("kept", F.col("before") + F.col("within") <= room).select(sure.columns))
    return kept.select(F.col("id").alias(id_col), "n_features", "log_weight", "key", "kept")
