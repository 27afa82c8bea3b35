"""Tiles of the genome: regions cut to size, numbered, with their neighbours."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(regions: DataFrame, size: int) -> DataFrame:
    """Regions (tid, beg, fin) cut into tiles of at most ``size`` bases."""
    return regions.filter("beg <= fin").withColumn("beg0", F.explode(F.sequence("beg", "fin", F.lit(size)))).select("tid", F.col("beg0").cast("long").alias("beg"), F.least(F.col("beg0") + size - 1, F.col("fin")).cast("long").alias("fin"))


def number(tiles: DataFrame) -> DataFrame:
    """chunk_id over all tiles by (tid, beg, fin), reg_chunk_i a contig, reg_i within it, and the tiles before and after on the contig.

    Numbered contig by contig; only one row a contig goes to a single task."""
    w = Window.partitionBy("tid").orderBy("beg", "fin")
    per = tiles.groupBy("tid").agg(F.count("*").alias("n"))
    whole = Window.orderBy("tid")
    contig = per.select("tid", (F.row_number().over(whole) - 1).alias("reg_chunk_i"), F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = tiles.withColumn("reg_i", F.row_number().over(w) - 1)
    rows = rows.select("*", *[f(c).over(w).alias(f"{p}_{c}") for p, f in (("prev", F.lag), ("next", F.lead)) for c in ("beg", "fin")])
    chunk = (F.col("before") + F.col("reg_i")).cast("long")
    beside = lambda p, d: F.when(F.col(f"{p}_beg").isNotNull(), chunk + d).alias(f"{p}_chunk_id")
    return rows.join(contig, "tid").select(chunk.alias("chunk_id"), "reg_chunk_i", "reg_i", "tid", "beg", "fin", beside("prev", -1), "prev_beg", "prev_fin", beside("next", 1), "next_beg", "next_fin")


def load_reads(reads: DataFrame, tiles: DataFrame) -> DataFrame:
    """Reads of each tile (chunk_id, chunk_beg, chunk_fin added), and whether they reach into the tiles before and after."""
    from ..operators.ranges import overlap_join

    t = tiles.select("tid", "chunk_id", "beg", "fin", "prev_beg", "prev_fin", "next_beg", "next_fin")
    rows = overlap_join(reads, t, prefix="chunk_", bin_size=1 << 16)
    reach = lambda p: F.coalesce((F.col("beg") <= F.col(f"chunk_{p}_fin")) & (F.col("fin") >= F.col(f"chunk_{p}_beg")), F.lit(False))
    return rows.select(F.col("chunk_chunk_id").alias("chunk_id"), "chunk_beg", "chunk_fin", reach("prev").alias("in_prev"), reach("next").alias("in_next"), *reads.columns)


def skipped_overlaps(alignments: DataFrame, tiles: DataFrame, kept) -> DataFrame:
    """Reads that the filter drops, by tile, which reach into the tiles before and after."""
    rows = load_reads(alignments.filter(~kept), tiles)
    return rows.groupBy("chunk_id").agg(F.count_if("in_prev").alias("up"), F.count_if("in_next").alias("down"))
