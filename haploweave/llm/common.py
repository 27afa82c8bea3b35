"""Pieces that the operators of this subpackage share."""
from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space, [^\x20\x09-\x0D]+.
#: bytes.split() splits on just these six bytes and bytes.lower() folds A-Z only.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a UTF-8 text; none for null."""
    return raw.lower().split() if raw else []


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_binary(column: pa.Array) -> pa.Array:
    """A string column as its UTF-8 bytes, without copying."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary())


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch by so many rows, so that what a task holds of its texts as Python objects is small."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


#: Bytes of texts in an Arrow batch, about. Spark's own limit is 10,000 rows, some 32 MB of texts of 3 KB a column: more than its pool
#: of buffers hands out, so each task takes them from the system, on the JVM's side and in Python, and little of that is given back.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends Python batches of about BATCH_BYTES, unless it has been given a limit (a row is never parted).
    Plans read it when they run, so it stays set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has: operators size their own groups by it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_labels(spark: SparkSession, n: int, most: int = 4096) -> list[int]:
    """n group labels that a hash partitioning into n parts deals one to each part (plain numbers would leave some parts
    empty and others with several). Beyond ``most`` labels, whose list would weigh on the plan, plain numbers."""
    if n > most:
        return list(range(n))
    tried = spark.range(0, 40 + n * 16).select(F.col("id").cast("int").alias("id"))
    first = {r["p"]: r["id"] for r in tried.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()}
    spare = iter(range(40 + n * 16, 41 + n * 17))
    return [first[p] if p in first else next(spare) for p in range(n)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session shares between driver and executors, spark.checkpoint.dir.

    Where that is unset a temporary folder is used if driver and executors are one process (tests); a cluster without it is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sampled(df: DataFrame, total: int, rows: int, *key: str) -> DataFrame:
    """About ``rows`` of df's ``total`` rows, by a hash of their key; twice as many at most, even if one key is hot.

    A filter, not a sort: no task sends the driver more than its share of the sample."""
    if total <= rows:
        return df
    return df.filter(F.xxhash64(*key, F.lit(11)) < F.lit(rows * 2**64 // total - 2**63)).limit(2 * rows)


#: Words of the bit map that ``maybe`` broadcasts, a power of two: 2^17 rows of two longs at most, whatever the size of the table.
FILTER_WORDS = 1 << 17


def maybe(rows: DataFrame, among: DataFrame, *key: str) -> DataFrame:
    """rows and ``maybe``: false where the row's key is surely not among the keys of ``among`` (columns of the same names).

    The keys are told to all tasks by a bit map of fixed size, so rows need no shuffle to be told apart; where there are
    very many keys the map fills up and more rows than need be are in doubt."""
    word = lambda: F.xxhash64(*key).bitwiseAND(FILTER_WORDS - 1)
    bit = lambda: F.shiftrightunsigned(F.xxhash64(*key), 40).bitwiseAND(63).cast("int").alias("bit")
    bits = among.select(word().alias("word"), F.expr("1L").alias("one"), bit()).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
    found = rows.select("*", word().alias("word"), bit()).join(F.broadcast(bits), "word", "left")
    return found.withColumn("maybe", F.coalesce(F.expr("shiftrightunsigned(bits, bit) & 1 = 1"), F.lit(False))).drop("word", "bit", "bits")
