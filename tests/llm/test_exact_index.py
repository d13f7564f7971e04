"""Operator 8 through its directory: small buckets, splits, owners, and ties of rows equal in id and text."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prefixloom.llm.common import written
from prefixloom.llm.exact_dedup import build_directory, chained, entries, exact_dedup, located, owned_groups


def table(spark):
    rows = [(i, f"text  {i % 90}" if i % 3 else f"own {i}") for i in range(400)] + [(1000 + i, "hot") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


@pytest.mark.parametrize("capacity", [4, 16384])
def test_result_does_not_depend_on_the_capacity(spark, capacity):
    df = table(spark)
    groups = defaultdict(list)
    for r in df.collect():
        groups[" ".join(r["text"].split())].append(r["doc_id"])
    want = sorted((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted(map(tuple, exact_dedup(df, capacity=capacity).collect())) == want


def test_every_key_has_one_bucket_and_buckets_split(spark):
    chains = written(chained(entries(table(spark))), "test-chains")
    directory, depths = build_directory(chains, 4)
    assert len(depths) > 1  # uneven cells made it double
    got = located(chains, directory, depths)
    assert got.count() == chains.count() == got.select("key").distinct().count()
    sizes = got.groupBy("bucket", "local_depth").count().agg(F.max("count")).first()[0]
    assert sizes <= 4


def test_owners_stop_on_texts_that_differ(spark):
    key = "1L as bucket, 0 as local_depth, 5L as key, x'00' as digest"
    index = spark.sql(f"select {key}, 2L as n")
    same = spark.sql(f"select {key}, 'a' as __norm, 2L as group_size, 1L as keep_id")
    assert [(r["keep_id"], r["group_size"]) for r in owned_groups(index, same).collect()] == [(1, 2)]
    other = spark.sql(f"select {key}, 'b' as __norm, 2L as group_size, 1L as keep_id")
    with pytest.raises(Exception, match="differ in their bytes"):
        owned_groups(index, same.union(other)).collect()


def test_rows_equal_in_id_and_text_keep_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "q"), (None, "q"), (7, "z")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["group_size"], r["kept"]) for r in exact_dedup(df).collect())
    assert got == [("1", 3, False), ("1", 3, True), ("2", 3, False), ("7", 1, True), ("None", 2, False), ("None", 2, True)]
