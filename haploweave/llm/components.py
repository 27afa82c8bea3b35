"""Connected components of an edge table by alternating large and small stars.

Each round is made of aggregations and joins on node ids, so a hub with many
neighbours is pre-aggregated before its shuffle and its join can be split. Links
and labels stay distributed; the driver sees one count and one checksum a round.

Defined results: edges may repeat, point either way and to themselves; an edge with
a null end is none; no edges give no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns. Returns node, root (the least node it reaches); only nodes with an edge to another node."""
    left, right = edges.columns[:2]
    a, b = F.col(left), F.col(right)
    now = checkpoint(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = _signature(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = checkpoint(small)
        if (sign := _signature(now)) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
