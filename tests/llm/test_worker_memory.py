"""What steps leave behind or make by the row on executors: workers' tables, copies of bitmaps."""

import pandas as pd
from pyspark.sql import functions as F
from test_bpe import PATTERN, RANKS

from prefixloom.llm.bpe import encode_documents, encoder
from prefixloom.llm.common import key_bitmap, maybe_flag

ROWS = 200_000


def allocated(spark) -> int:
    """Bytes that the JVM's living threads have allocated so far."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    beans, longs = jvm.java.lang.management.ManagementFactory.getThreadMXBean(), jvm.java.lang.Class.forName("[J")
    kinds, values = new(jvm.java.lang.Class, 1), new(jvm.java.lang.Object, 1)
    kinds[0], values[0] = longs, beans.getAllThreadIds()
    method = jvm.java.lang.Class.forName("com.sun.management.ThreadMXBean").getMethod("getThreadAllocatedBytes", kinds)
    return sum(max(0, x) for x in method.invoke(beans, values))


def test_bitmap_tells_every_cell(spark):
    keys = [0, 7, 8, 63, 64, 127, 32767, 32768, 65535, 1 << 19, (1 << 20) - 1, *range(98_304, 98_304 + 64)]
    bitmap = key_bitmap(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 20)
    got = maybe_flag(spark.range(1 << 20).withColumnRenamed("id", "k"), "k", bitmap, 20)
    assert {r["k"] for r in got.filter("__maybe").collect()} == set(keys)
    negative = maybe_flag(spark.createDataFrame([(k - (1 << 20),) for k in (8, 9, 63)], "k long"), "k", bitmap, 20)
    assert {r["k"] + (1 << 20): r["__maybe"] for r in negative.collect()} == {8: True, 9: False, 63: True}
    assert not maybe_flag(spark.range(5), "id", key_bitmap(spark.range(0), "id")).filter("__maybe").count()


def test_rows_do_not_copy_pages(spark):
    bitmap = key_bitmap(spark.range(0, 1 << 20, 3), "id", 20).localCheckpoint()
    asked = maybe_flag(spark.range(0, ROWS, 1, 4), "id", bitmap, 20).agg(F.sum(F.col("__maybe").cast("long")))
    assert asked.first()[0] == (ROWS + 2) // 3
    before = allocated(spark)
    assert asked.first()[0] == (ROWS + 2) // 3
    assert allocated(spark) - before < ROWS * 1024  # a page has 4,096 bytes


def test_workers_of_bpe_keep_few_units(spark):
    words = [(i, " ".join(f"w{i}x{j}" for j in range(2_000))) for i in range(40)]
    docs = spark.createDataFrame(pd.DataFrame(words, columns=["doc_id", "text"])).coalesce(1)
    assert encode_documents(docs, RANKS, PATTERN).agg(F.min("n_tokens")).first()[0] >= 2_000

    def kept(batches):
        for _ in batches:
            yield pd.DataFrame({"n": [len(encoder(RANKS, PATTERN).known)]})

    found = [r["n"] for r in spark.range(0, 32, 1, 32).mapInPandas(kept, "n long").collect()]
    assert 0 < max(found) <= 50_000
