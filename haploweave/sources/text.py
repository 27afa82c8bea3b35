"""Small text inputs: regions, BED, path lists, contig dictionaries, FASTA."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fasta

REGION = re.compile(r"^(?P<chrom>[^:]+)(?::(?P<beg>[\d,]+)(?:-(?P<fin>[\d,]+))?)?$")
REGIONS = "chrom string, beg long, fin long"


def parse_region(text: str) -> tuple[str, int, int]:
    """chr, chr:pos (from pos to the contig's end) or chr:a-b, commas allowed. An end of -1 is the contig's end."""
    m = REGION.match(text.strip())
    if not m:
        raise ValueError(f"not a region: {text}")
    number = lambda s: int(s.replace(",", ""))
    beg = number(m["beg"]) if m["beg"] else 1
    fin = number(m["fin"]) if m["fin"] else -1
    if beg < 1 or (fin != -1 and fin < beg):
        raise ValueError(f"not a region: {text}")
    return m["chrom"], beg, fin


def regions(spark: SparkSession, literals: list[str]) -> DataFrame:
    return spark.createDataFrame([parse_region(x) for x in literals], REGIONS)


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a BED file, 1-based and closed. Blank lines and comments are skipped, bad rows fail the job."""
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    cell = F.split(F.trim("value"), r"\s+")
    good = (F.size(cell) >= 3) & F.get(cell, F.lit(1)).rlike(r"^\d+$") & F.get(cell, F.lit(2)).rlike(r"^\d+$")
    beg, fin = F.get(cell, F.lit(1)).try_cast("long"), F.get(cell, F.lit(2)).try_cast("long")
    good = good & (fin > beg)
    fail = F.raise_error(F.concat(F.lit("bad BED row: "), F.col("value"))).cast("long")
    return rows.select(cell[0].alias("chrom"), F.when(good, beg + 1).otherwise(fail).alias("beg"), F.when(good, fin).otherwise(fail).alias("fin"))


def path_list(spark: SparkSession, path: str) -> list[str]:
    """Paths in a list file, in order; an empty list is an error. A list of inputs is short."""
    rows = spark.read.text(path).select(F.trim("value").alias("p")).filter("p <> '' AND NOT p LIKE '#%'")
    found = [r["p"] for r in rows.collect()]
    if not found:
        raise ValueError(f"no path in {path}")
    return found


def contigs_of(index: DataFrame) -> DataFrame:
    """tid, name, len of the text of a FASTA index (column value)."""
    cell = F.split("value", "\t")
    rows = index.select(cell[0].alias("name"), cell[1].cast("long").alias("len"), cell[2].cast("long").alias("at"))
    from pyspark.sql import Window

    return rows.select((F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("tid"), "name", "len")


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, len of a FASTA index file; where there is none, of the FASTA file beside it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return contigs_of(spark.read.text(path))
    return fasta.index(spark, path.removesuffix(".fai")).select("tid", "name", "len")


def autosomes(contigs: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Whole autosomes as regions, each under the name that both dictionaries have for it: chr1 to chr22, or else 1 to 22."""
    both = contigs.join(others.select("name"), "name", "left_semi") if others is not None else contigs
    named = both.select("name", "len", F.regexp_extract("name", r"^(?:chr)?([1-9]|1\d|2[0-2])$", 1).alias("number")).filter("number <> ''")
    one = named.groupBy("number").agg(F.min_by(F.struct("name", "len"), F.when(F.col("name").startswith("chr"), 0).otherwise(1)).alias("c"))
    return one.select(F.col("c.name").alias("chrom"), F.lit(1).cast("long").alias("beg"), F.col("c.len").alias("fin"))


def resolve(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Regions with contig numbers, open ends closed; unknown contigs are left out. tid, beg, fin."""
    rows = regions.join(F.broadcast(contigs), F.col("chrom") == F.col("name"))
    fin = F.when(F.col("fin") == -1, F.col("len")).otherwise(F.least("fin", "len"))
    return rows.select("tid", "beg", fin.alias("fin")).filter("beg <= fin")


def fasta_tiles(spark: SparkSession, path: str, tile: int = 10_000) -> DataFrame:
    """chrom, tile, beg (1-based), seq: a FASTA file cut into tiles, bases normalised."""
    return fasta.tiles(spark, path, tile)


def moved(rows: DataFrame) -> DataFrame:
    """rows, for a join that sends them to tasks by key. The planner takes a string for 20 bytes and what is made of a contig's
    length for a row, so it would broadcast a whole reference, by way of the driver."""
    return rows.hint("merge")


def slices(spans: DataFrame, tiles: DataFrame, key: list[str], tile: int = 10_000, name: str = "ref_seq", start: str = "ref_beg") -> DataFrame:
    """spans (key, chrom, beg, fin) with the reference between beg and fin; what lies outside a contig is left out."""
    want = spans.select(*key, "chrom", F.greatest(F.col("beg"), F.lit(1)).alias("b"), F.col("fin").alias("f")).withColumn("tile", F.explode(F.sequence(F.floor((F.col("b") - 1) / tile), F.floor((F.col("f") - 1) / tile))))
    pieces = want.join(moved(tiles.select("chrom", "tile", F.col("beg").alias("tb"), "seq")), ["chrom", "tile"])
    cut = F.substring("seq", F.greatest(F.col("b") - F.col("tb") + 1, F.lit(1)).cast("int"), (F.least(F.col("f"), F.col("tb") + F.length("seq") - 1) - F.greatest("b", "tb") + 1).cast("int"))
    # Cut before they are grouped: a group's rows are sorted, and would be with whole tiles in them.
    parts = pieces.select(*key, F.greatest("b", "tb").alias("__from"), F.col("tile").alias("__tile"), cut.alias("__s")).repartition(*key)
    joined = parts.groupBy(*key).agg(F.min("__from").alias(start), F.array_sort(F.collect_list(F.struct("__tile", "__s"))).alias("__p"))
    return joined.select(*key, start, F.array_join(F.transform("__p", lambda x: x["__s"]), "").alias(name))


def bases_at(points: DataFrame, tiles: DataFrame, key: list[str], tile: int = 10_000) -> DataFrame:
    """points (key, chrom, pos) with the reference base; N outside of the contig."""
    rows = points.withColumn("tile", F.floor((F.col("pos") - 1) / tile)).join(moved(tiles.select("chrom", "tile", F.col("beg").alias("tb"), "seq")), ["chrom", "tile"], "left")
    base = F.substring("seq", (F.col("pos") - F.col("tb") + 1).cast("int"), F.lit(1))
    return rows.select(*key, F.when(base.isNull() | (base == ""), "N").otherwise(base).alias("base"))
