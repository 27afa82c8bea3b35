"""Relational forms of the noise detector and of base quality statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def noise_window(events: DataFrame, window: int, on: list[str], pos: str = "pos", count: str | None = None, name: str = "n_window") -> DataFrame:
    """Bases of difference within the window that ends at each event, for events of one base."""
    w = Window.partitionBy(*on).orderBy(pos).rangeBetween(-(window - 1), 0)
    return events.withColumn(name, F.sum(F.col(count) if count else F.lit(1)).over(w).cast("long"))


def quality_histogram(observations: DataFrame, on: list[str], quality: str) -> DataFrame:
    """Counts of quality values, and whether a value has a share of at least 0.01 %."""
    counted = observations.groupBy(*on, F.col(quality).alias("q")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*on))
    return counted.withColumn("valid", F.col("n") * 10000 >= total)


def quality_stats(observations: DataFrame, on: list[str], quality: str) -> DataFrame:
    """Least, first quartile, median, third quartile and largest over the distinct values with share enough (not over bases)."""
    values = quality_histogram(observations, on, quality).filter("valid").groupBy(*on).agg(F.array_sort(F.collect_list("q")).alias("v"))
    n = F.size("v")
    at = lambda i, name: F.get("v", i).alias(name)
    return values.select(*on, at(F.lit(0), "q_min"), at(F.floor(n / 4).cast("int"), "q_first"), at(F.floor(n / 2).cast("int"), "q_median"), at(F.floor(n * 3 / 4).cast("int"), "q_third"), at(n - 1, "q_max"))
