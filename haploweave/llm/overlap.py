"""All pairs of texts whose shingle sets have a Jaccard similarity of at least so much: none is missed.

Shingles have one order, rare ones first. Sets of n and m shingles with a similarity of t share at least t (n + m) / (1 + t)
of them, so one of the first n - ceil(t n) + 1 of each is shared (the prefix), and all but ceil(t n) - 1 of the shared ones,
with the greater of n and m, are in both prefixes (``needed``). The order is made of the counts in a sample of texts, a fixed
share of them (``ORDER_SHARE``, or ``order_rows`` where that is more), so that a shingle is known as frequent at the same
frequency however large the table; any order gives the same pairs, a worse one only more candidates.

Candidates. A shingle in few prefixes (``few``) gives all its pairs. A crowded one first gives a star, about the text that
has most shingles in common with others. When the pairs found so far (and those that the caller knows) are joined to
components, crowded shingles give the pairs between components, so a large group of near copies is not held pair by pair.
These pairs share no shingle that is in few prefixes, or they were found before, so they have ``needed`` crowded ones in
common. The first of all that they share stands, in either text, before as many others as they share at least (``first``): what a
copy has of its own comes before what its group has in common, so copies that differ too much meet at no shingle.
Each candidate is held against the two texts.

Defined results: texts without words are alike; fewer words than a shingle are one shingle.
"""
from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_binary, checkpoint, maybe, pieces, words_of
from .components import components

TINY = 1e-9
#: One text in so many tells of the shingles' order.
ORDER_SHARE = 8


def shingles_of(raw: bytes | None, words: int) -> set[bytes]:
    w = words_of(raw)
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def hashed(raw: bytes | None, words: int) -> np.ndarray:
    """The hashes of the distinct shingles, sorted."""
    w = words_of(raw)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)] if w else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(5)), np.uint64))


def least_shared(n: int, similarity: float) -> int:
    """How many of its n shingles a set shares at least with one that is so similar."""
    return math.ceil(similarity * n - TINY)


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """key (hash of the text, null as empty) and text."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), text.alias("text"))


def frequent(texts: DataFrame, words: int, order_rows: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that several texts of a sample have; the ``most`` most frequent."""

    def run(batches):
        for batch in (part for whole in batches for part in pieces(whole)):
            found, n = np.unique(np.concatenate([hashed(t, words) for t in as_binary(batch.column(0)).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["token", "n"])

    # A filter by the key: the sample grows with the table and goes through no single task.
    part = min(1 / ORDER_SHARE if (total := texts.count()) > ORDER_SHARE * order_rows else order_rows / max(1, total), 1.0)
    some = texts if part == 1 else texts.filter(F.xxhash64("key", F.lit(11)) < F.lit(int(part * 2**64) - 2**63))
    found = some.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    at = np.argsort(token)
    return token[at], n[at]


def prefixes(texts: DataFrame, words: int, similarity: float, order_rows: int) -> DataFrame:
    """token, key, n, nth: the prefix of each text's shingles; n is how many shingles it has, nth the shingle's place among them
    (from 0). Texts without words have token 0."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent(texts, words, order_rows))

    def run(batches):
        known, counts = sent.value
        for batch in (part for whole in batches for part in pieces(whole)):
            tokens, sizes = [], []
            for t in as_binary(batch.column(1)).to_pylist():
                h = hashed(t, words)
                sizes.append(len(h))
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, counts[at], 0), kind="stable")]
                tokens.append(h[: len(h) - least_shared(len(h), similarity) + 1] if len(h) else np.zeros(1, np.uint64))
            each = [len(x) for x in tokens]
            key = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), each)
            nth = np.concatenate([np.arange(e, dtype=np.int32) for e in each])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(key), pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(nth)], ["token", "key", "n", "nth"])

    return texts.select("key", "text").mapInArrow(run, "token long, key long, n int, nth int")


def alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float, most: int = 512) -> DataFrame:
    """The pairs (a, b of keys) whose texts' shingle sets are so similar. Only texts in a pair are moved: to their key, and on
    beside the text a, whose pairs are in parts of about ``most``."""
    part = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("a")) / most))).cast("int")
    dealt = checkpoint(pairs.select("a", "b", part.alias("part")))
    ends = dealt.select("a", "part", F.col("b").alias("end"), F.lit(1).alias("nth")).unionByName(dealt.select("a", "part", F.col("a").alias("end"), F.lit(0).alias("nth")).distinct())
    found = maybe(texts, ends.select(F.col("end").alias("key")), "key").filter("maybe").groupBy("key").agg(F.first("text").alias("text"))
    rows = ends.join(found.hint("shuffle_hash"), F.col("end") == F.col("key")).select("a", "part", "nth", "key", "text").repartition("a", "part").sortWithinPartitions("a", "part", "nth")

    def run(batches):
        mine = set()
        for batch in (part for whole in batches for part in pieces(whole)):
            good = []
            for first, t in zip(batch.column(2).to_pylist(), as_binary(batch.column(4)).to_pylist()):
                own = shingles_of(t, words)
                if first == 0:
                    mine = own
                good.append(first == 1 and len(mine & own) >= similarity * len(mine | own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def both_have(similarity: float):
    """How many shingles texts of n and m shingles share at least, if they are so similar."""
    return F.ceil((F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - TINY)


def needed(similarity: float):
    """How many shingles the prefixes of texts of n and m shingles share, if they are so similar."""
    least = lambda c: F.ceil(F.col(c) * similarity - TINY)
    return F.greatest(F.lit(1), both_have(similarity) - F.greatest(least("n"), least("m")) + 1)


def first(similarity: float):
    """Whether the first shingle that texts of n and m shingles share can be nth_a of the one and nth_b of the other: as many
    as they share are left in both."""
    return F.least(F.col("n") - F.col("nth_a"), F.col("m") - F.col("nth_b")) >= both_have(similarity)


def fit(similarity: float):
    """Whether texts of n and m shingles can be so similar."""
    return F.least("n", "m") >= F.greatest("n", "m") * similarity - TINY


def candidates(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of rows (a, n, spare_a, b, m, spare_b), one a shared shingle, the pairs that share enough, with what may be
    shared besides (the least of the spares of their rows)."""
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), *[F.min(c).alias(c) for c in ("n", "m", "spare_a", "spare_b")])
    return counted.filter(F.col("c") + F.least("spare_a", "spare_b") >= needed(similarity)).select("a", "b")


def joined(rows: DataFrame, spare: str, similarity: float, label: bool = False) -> DataFrame:
    """Pairs of rows (token, key, n) of one token whose sizes go together. With label, of rows that have nth and label: whose
    labels differ, and which may be the first that they share."""
    side = lambda k, n, x: rows.select("token", F.col("key").alias(k), F.col("n").alias(n), F.col(spare).alias(f"spare_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("label", "nth") if label])
    both = side("a", "n", "a").join(side("b", "m", "b"), "token").filter("a < b").filter(fit(similarity))
    return both.filter("label_a <> label_b").filter(first(similarity)) if label else both


def similar_components(texts: DataFrame, words: int, similarity: float, known: DataFrame | None = None, few: int = 32, order_rows: int = 8192) -> DataFrame:
    """node, root of the texts (key, text; may repeat) that are so similar to another, directly or over others. known: pairs
    (a, b of keys) that may be so."""
    per = Window.partitionBy("token")
    rows = prefixes(texts, words, similarity, order_rows).withColumn("lo", F.min("key").over(per)).withColumn("hi", F.max("key").over(per)).filter("lo <> hi").select("token", "key", "n", "nth").distinct()
    rows = checkpoint(rows.withColumn("crowded", F.count("*").over(per) > few))
    each = rows.groupBy("key").agg(F.count_if("crowded").alias("in_crowded"), F.count_if(~F.col("crowded")).alias("in_few"))
    rows = checkpoint(rows.join(each, "key"))
    crowded = rows.filter("crowded")
    shared = F.col("in_crowded") + F.col("in_few")
    hub = crowded.groupBy("token").agg(F.max_by(F.struct("key", "n", shared.alias("shared")), F.struct(shared, "key")).alias("hub"))
    star = crowded.join(hub, "token").select(F.col("key").alias("a"), "n", shared.alias("shared"), F.col("hub.key").alias("b"), F.col("hub.n").alias("m"), F.col("hub.shared").alias("of_b"))
    star = star.filter(F.col("a") != F.col("b")).filter(fit(similarity)).filter(F.least("shared", "of_b") >= needed(similarity)).select("a", "b")
    found = candidates(joined(rows.filter("NOT crowded"), "in_crowded", similarity), similarity).unionByName(star)
    if known is not None:
        found = found.unionByName(known.filter("a <> b"))
    found = checkpoint(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = checkpoint(alike(found, texts, words, similarity))
    label = components(links)
    named = crowded.join(label, F.col("key") == F.col("node"), "left").select("token", "key", "n", "nth", F.coalesce("root", "key").alias("label"))
    apart = named.withColumn("lo", F.min("label").over(per)).withColumn("hi", F.max("label").over(per)).filter("lo <> hi").drop("lo", "hi")
    # What two texts share beyond the last row that joins them is among what either has left.
    apart = checkpoint(apart.withColumn("left", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("nth"))) - 1))
    rest = checkpoint(candidates(joined(apart, "left", similarity, label=True), similarity).join(found, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return label
    return components(links.unionByName(alike(rest, texts, words, similarity)))
