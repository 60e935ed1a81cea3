"""What a worker holds: Arrow batches bounded in bytes, words forgotten where other operators need the worker."""

import pyarrow as pa
from pyspark.sql import functions as F

from ramify.llm import packing
from ramify.llm.common import BATCH_BYTES, Scratch


def test_batches_of_long_rows_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    rows = spark.range(0, 300, 1, 1).select("id", F.expr("repeat('x', 100000)").alias("text"))
    out = Scratch(spark).put(rows.mapInArrow(sizes, "bytes long"), "sizes")
    assert out.agg(F.max("bytes")).first()[0] < BATCH_BYTES + 200_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(BATCH_BYTES)


def test_packing_forgets_words():
    encode = packing._encoder(packing.default_vocabulary())
    before = encode([b"some words here"])
    encode.forget()
    assert encode([b"some words here"]) == before


def test_packing_without_kept_words(spark):
    docs = spark.createDataFrame([(k, f"word{k} and more words") for k in range(50)], "doc_id long, text string")
    rows = [sorted(map(tuple, packing.pack(docs, keep_words=keep).collect())) for keep in (True, False)]
    assert rows[0] == rows[1]
