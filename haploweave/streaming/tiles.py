"""A stream of alignment files: tiles that new reads touch are computed again.

The batch plan is the definition; the stream only finds which tiles changed, with
foreachBatch, so each micro-batch ends in a table of whole tiles.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.digars import read_filter
from ..operators.ranges import overlap_join
from ..options import Options
from ..schemas import ALIGNMENT


def touched(alignments: DataFrame, tiles: DataFrame, options: Options) -> DataFrame:
    """Tiles that usable reads of a batch overlap."""
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))
    reads = alignments.filter(read_filter(options)).select("tid", (F.col("pos") + 1).alias("beg"), (F.col("pos") + F.greatest(span, F.lit(1))).alias("fin"))
    return tiles.join(overlap_join(reads, tiles, prefix="t_", bin_size=1 << 16).select(F.col("t_chunk_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi")


def stream(spark: SparkSession, path: str, tiles: DataFrame, options: Options, recompute: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, once: bool = False):
    """Starts a query over Parquet alignments that arrive in path. recompute(new alignments, touched tiles, batch number)."""

    def batch(rows: DataFrame, number: int) -> None:
        recompute(rows, touched(rows, tiles, options), number)

    writer = spark.readStream.schema(ALIGNMENT).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
