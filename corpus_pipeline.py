"""A corpus pipeline over ``documents``: toxic rows go, exact and near copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns documents' columns; the last returns a row for each reading of the
mix, with its token ids and its place in training order (``position``, from 0).
``run`` writes what a stage returns as Parquet in the session's shared folder and
reads it again, so that a lost executor costs at most a stage. A scan gives files
in any order, so the order of the mix is taken from the names of its files and the
rows' places in them. What a stage has read goes when the next has written.

Defined results: null texts are empty ones, never toxic, and copies of one another;
a row without a doc_id is never an exact copy's keeper if another is there, and the
near-copy stage keeps it; rows that repeat id and text count once after the second
stage; null is a source of its own; empty texts have no words, so the mix gives them
once a pass; no documents give no rows; further columns of documents are passed on
by all stages but the last, whatever their names.
"""
from __future__ import annotations

import hashlib
import uuid
from array import array

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haploweave.llm.bpe import Decoder, Vocabulary, transcode
from haploweave.llm.common import read, shared_folder
from haploweave.llm.exact_dedup import exact_dedup
from haploweave.llm.mixing import mix
from haploweave.llm.simhash import near_dedup
from haploweave.llm.toxicity import classify


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain does not call toxic."""
    # By place, so that columns may have any names and a text goes through Python once.
    places = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias(places["doc_id"]), "quality", "toxic")
    scored = classify(docs.toDF(*places.values()), labels, places["doc_id"], places["text"])
    return scored.filter(~F.col("scores.is_toxic")).select(*[F.col(k).alias(c) for c, k in places.items()])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, all pairs of similarity 0.8 and more; of each group the document with the least id stays."""
    return near_dedup(docs, words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of the mix, range-sorted by training time."""
    return mix(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


class Encoded:
    """A text's ids, and the digests of what they decode to: joined tokens, and the text of the byte-to-text machine."""

    def __init__(self, vocabulary: Vocabulary):
        self.found, self.of_text, self.of_bytes, self.machine = array("i"), hashlib.sha256(), hashlib.sha256(), Decoder(vocabulary)

    def ids(self, raw: bytes) -> None:
        before = len(self.found)
        self.found.frombytes(raw)
        for at in range(before, len(self.found), 8192):
            self.of_bytes.update(self.machine.feed(self.found[at : at + 8192]).encode())

    def text(self, text: str) -> None:
        self.of_text.update(text.encode())

    def result(self):
        self.of_bytes.update(self.machine.finish().encode())
        return len(self.found), np.array(self.found, np.int32), hashlib.sha256(self.found.tobytes()).hexdigest(), self.of_text.hexdigest(), self.of_bytes.hexdigest()


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, source and text of docs, read from range-sorted files, and place: a row's number in the order in which they
    were written."""
    rows = docs.select("doc_id", "source", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("nth"))
    # A row a file, and a shuffle partition wrote each; names begin with the partition's number, in five digits or more.
    files = rows.groupBy("file").agg(F.max("nth").alias("last")).collect()
    first, before = [], 0
    for f in sorted(files, key=lambda f: (int(f["file"].split("-")[1]), f["file"])):
        first.append((f["file"], before))
        before += f["last"] + 1
    table = docs.sparkSession.createDataFrame(first, "file string, first long")
    small = F.broadcast(table) if len(first) <= 100_000 else table
    return rows.join(small, "file").select("doc_id", "source", "text", (F.col("first") + F.col("nth")).alias("place"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token ids of each reading, digests of ids and decoded text, and its place in training order."""
    columns = "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string, bytes_sha256 string"
    encoded = transcode(numbered(docs), path or public_tokenizers.path("word_bpe_49k.json"), Encoded, columns, keep=["doc_id", "source", "place"], joined=True)
    return encoded.select(*[c for c in encoded.columns if c != "place"], F.col("place").alias("position"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("curriculum_mixing", mixing),
    ("bpe_encode_decode", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                spent = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                spent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(spent, True)
    return docs


#: SQL can't express fitted classifiers, XXH64 fingerprints and BPE; tests/llm holds run() against brute force.
ORACLE_SQL = None
