"""What goes to Python at once: batches of texts are small, and the pipeline's first stage sends a text once."""
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from haploweave.llm import bpe, simhash, toxicity  # noqa: E402

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def texts(spark):
    return spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word ', id, ' '), 400)").alias("text"))


@pytest.mark.parametrize("step", ["toxicity", "simhash", "bpe"])
def test_small_batches(spark, step):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    spark.conf.unset(LIMIT)
    docs = texts(spark)
    if step == "toxicity":
        toxicity.classify(docs, spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    elif step == "simhash":
        simhash.fingerprints(docs)
    else:
        bpe.transcode(docs, "", None, "n long")
    found = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 3000 and max(r.bytes for r in found) < 3e6 and len(found) > 3
    spark.conf.unset(LIMIT)


def test_limit_of_the_session_stays(spark):
    spark.conf.set(LIMIT, "1m")
    simhash.fingerprints(texts(spark))
    assert spark.conf.get(LIMIT) == "1m"
    spark.conf.unset(LIMIT)


def test_toxicity_sends_a_text_once(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(corpus_pipeline, "classify", lambda docs, *a: sent.append(docs) or toxicity.classify(docs, *a))
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"scores": F.lit(1), "a.b": F.lit("x"), "quality": F.lit(2)})
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    assert [t for _, t in sent[0].dtypes] == [t for _, t in docs.dtypes]
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert kept.exceptAll(docs).count() == 0
