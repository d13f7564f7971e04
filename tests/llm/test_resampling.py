"""Operator 3 against a version in plain Python, and whether it tells bad documents."""

import math
from collections import Counter

import pytest
import xxhash

from prefixloom.llm.resampling import Grams, kth_largest, resample


def test_weights_and_selection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    grams, raw, target = Grams(16384), Counter(), Counter()
    found = {i: Counter(grams.of(t).tolist()) for i, t in texts.items()}
    for i, c in found.items():
        raw.update(c)
        if i in good:
            target.update(c)
    rn, tn = sum(raw.values()) + 16384, sum(target.values()) + 16384
    weight = {i: sum(n * (math.log((target[b] + 1) / tn) - math.log((raw[b] + 1) / rn)) for b, n in c.items()) for i, c in found.items()}
    got = {r["doc_id"]: r for r in resample(docs, labels.filter("quality = 1").select("doc_id"), 0.8).collect()}
    assert all(math.isclose(got[i]["log_weight"], w, rel_tol=1e-9, abs_tol=1e-6) for i, w in weight.items())
    order = sorted(got.values(), key=lambda r: -r["gumbel_key"])
    assert [r["selected"] for r in order] == [True] * 800 + [False] * 200
    bad = [r["doc_id"] for r in labels.collect() if r["quality"] == 0]
    kept = lambda ids: sum(got[i]["selected"] for i in ids) / len(ids)
    assert kept(good) > 0.85 and kept(bad) < 0.3


@pytest.mark.parametrize("k", [1, 3, 50, 100])
def test_kth_largest(spark, k):
    values = [(x * 2654435761 % 2**40 - 2**39) * (x % 5) for x in range(100)] + [2**62, -(2**62)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_noise_is_gumbel(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    keys = [r["gumbel_key"] for r in resample(df, df.limit(0).select("doc_id"), 0.5).collect()]
    assert abs(sum(keys) / len(keys) - 0.5772) < 0.1


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "a b", 1), (3, "a b", 1), (None, "c", 1), (4, "x " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    ids = spark.createDataFrame([(3,), (3,), (None,)], "id long")
    assert resample(df, ids, 0.5).count() == 6
    assert resample(df.limit(0), ids, 0.5).count() == 0
    assert not any(r["selected"] for r in resample(df, ids, 0.0).collect())
    assert xxhash.VERSION


def test_buckets_written_out_again():
    """Words and neighbouring pairs as plain integers modulo 2**64."""
    top = 2**64
    for text in ["", "a", "A b  c\nA b", "é字 é字 x " * 3, "one two three two one"]:
        w = [xxhash.xxh3_64_intdigest(x.encode()) for x in text.lower().split()]
        pairs = [(a * 0x9E3779B97F4A7C15 % top) ^ ((b + 0x632BE59BD9B4E019) % top) for a, b in zip(w, w[1:], strict=False)]
        want = [x % 16384 for x in w] + [(p ^ (p >> 29)) % 16384 for p in pairs]
        assert Grams(16384).of(text).tolist() == want
