"""FASTA files: their index, and tiles of bases, with no contig in one task.

Lines are read by the text source, split by split. What a line's place is, in the
file and in its contig, follows from sums in two levels: within a split in the
order in which its lines come, and over the splits, of which there is a row each
for what goes before the first header and a row for each header.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_base

#: Of a split's n-th stretch (0: before its first header): name, where it begins and its first base is in the split, bases, the
#: first full line's bases and bytes, and the bytes of the whole split.
STRETCH = "file string, split long, n int, name string, first long, bases long, line_bases int, line_width int, size long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _by_split(batches) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, split), line) in order."""
    for batch in batches:
        for line, file, split in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            yield (file, split), line


def stretches(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stretch of lines of one contig in one split."""
    names = [c.split()[0] for c in STRETCH.split(", ")]

    def run(batches):
        key, size, rows = None, 0, []

        def told():
            return pa.RecordBatch.from_pylist([dict(zip(names, (*key, i, *r, size))) for i, r in enumerate(rows)], schema=pa.schema([(n, t) for n, t in zip(names, [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()])]))

        for at, line in _by_split(batches):
            if at != key:
                if rows:
                    yield told()
                key, size, rows = at, 0, [[None, 0, 0, 0, 0]]
            width = len(line.encode()) + 1
            if line.startswith(">"):
                rows.append([(line[1:].split() or [""])[0], size + width, 0, 0, 0])
            else:
                n = len(line.strip())
                if n and not rows[-1][3]:
                    rows[-1][3:] = [n, width]
                rows[-1][2] += n
            size += width
        if rows:
            yield told()

    return _lines(spark, path).mapInArrow(run, STRETCH)


def placed(found: DataFrame) -> DataFrame:
    """Stretches with contig (its number in the file), before (bases of the contig before the stretch) and at (the place in the
    file of the stretch's first line of bases)."""
    splits = found.groupBy("file", "split").agg(F.max("n").alias("headers"), F.max("size").alias("size"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.select("file", "split", F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("earlier"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begins"))
    rows = found.join(splits, ["file", "split"]).withColumn("contig", F.col("earlier") + F.col("n"))
    within = Window.partitionBy("file", "contig").orderBy("split", "n").rowsBetween(Window.unboundedPreceding, -1)  # of a contig a row a split
    return rows.select("file", "split", "n", "contig", "name", "bases", "line_bases", "line_width", (F.col("begins") + F.col("first")).alias("at"), F.coalesce(F.sum("bases").over(within), F.lit(0)).alias("before"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, len, and at, line_bases, line_width as an index file has them: the first base's place in the file, bases and
    bytes of a line."""
    rows = placed(stretches(spark, path)).filter("contig > 0")
    order = F.struct("split", "n")
    lines = F.min(F.when(F.col("line_bases") > 0, F.struct("split", "n", "line_bases", "line_width")))
    one = rows.groupBy("file", "contig").agg(F.min_by("name", order).alias("name"), F.sum("bases").alias("len"), F.min_by("at", order).alias("at"), lines.alias("line"))
    return one.select((F.col("contig") - 1).cast("int").alias("tid"), "name", "len", "at", F.coalesce("line.line_bases", F.lit(0)).alias("line_bases"), F.coalesce("line.line_width", F.lit(0)).alias("line_width"))


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an index file, in order, as one column."""
    return index(spark, path).orderBy("tid").select(F.concat_ws("\t", "name", "len", "at", "line_bases", "line_width").alias("value"))


def tiles(spark: SparkSession, path: str, tile: int = 10_000) -> DataFrame:
    """chrom, tile, beg (1-based), seq: the bases of a FASTA file in tiles, normalised.

    A tile that lies in one split is made where it is read; only the parts of tiles at borders of splits are put together."""
    starts = placed(stretches(spark, path)).withColumn("label", F.max("name").over(Window.partitionBy("file", "contig")))
    first = starts.filter("n = 0 AND contig > 0").select("file", "split", F.col("label").alias("chrom"), "before")
    lines = _lines(spark, path)
    # A row a split: what its first lines go on with.
    known = {(r["file"], r["split"]): (r["chrom"], r["before"]) for r in first.collect()}
    names = ["chrom", "tile", "from", "seq", "whole"]
    kinds = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()])))

    def run(batches):
        key, chrom, at, held, begun, out = None, None, 0, [], 0, []

        def put(ends: bool):
            """What is held, cut at the borders of tiles; the last tile stays if it may go on."""
            nonlocal held, begun
            seq, start = "".join(held), begun
            while seq:
                size = tile - start % tile
                if len(seq) < size and not ends:
                    break
                part, seq = seq[:size], seq[size:]
                out.append((chrom, start // tile, start, part, len(part) == tile))
                start += len(part)
            held, begun = [seq] if seq else [], start

        n = 0
        for where, line in _by_split(batches):
            if where != key or line.startswith(">"):
                put(True)
                if where != key:
                    key, (chrom, at) = where, known.get(where, (None, 0))
                if line.startswith(">"):
                    chrom, at = (line[1:].split() or [""])[0], 0
                begun = at
                if line.startswith(">"):
                    continue
            bases = line.strip()
            if chrom is None or not bases:
                continue
            held.append(bases)
            n += len(bases)
            if n >= 1 << 20:
                put(False)
                n = 0
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=kinds)
                out.clear()
        put(True)
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=kinds)

    parts = lines.mapInArrow(run, "chrom string, tile long, `from` long, seq string, whole boolean")
    border = parts.filter("NOT whole").groupBy("chrom", "tile").agg(F.array_sort(F.collect_list(F.struct("from", "seq"))).alias("p"))
    made = parts.filter("whole").select("chrom", "tile", "seq").unionByName(border.select("chrom", "tile", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq")))
    return made.select("chrom", "tile", (F.col("tile") * tile + 1).alias("beg"), normal_base(F.col("seq")).alias("seq"))
