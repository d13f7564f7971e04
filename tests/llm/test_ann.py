"""Operator 10 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.llm.ann import Tree, nearest


def brute(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in (i for i in ok if i % 20 == 0):
        near = sorted((-float((ok[q] * v).sum()), i) for i, v in ok.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("leaf,cell,block", [(128, 4096, 2048), (16, 64, 7)])
def test_recall_and_scores(spark, leaf, cell, block):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, 20)
    got = by_query(nearest(df, F.col("vec_id") % 20 == 0, leaf=leaf, cell=cell, block=block))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert all(abs(s - float(vectors[q] @ vectors[i])) < 1e-12 for i, s in near)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_all_leaves_are_exact_with_hot_vector_ties_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 520)]
    rows += [(600, None), (601, [0.0] * 8), (602, [None] * 8), (603, [float("nan")] * 8), (604, [float("inf")] * 8), (620, [1.0, None] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = by_query(nearest(df, F.col("vec_id") % 20 == 0, recall=1.0, leaf=20, cell=50, block=4, calibration=10_000))
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [1.0])], schema)
    assert [i for i, _ in by_query(nearest(few, F.col("vec_id") % 20 == 0))[0]] == [1, 2]
    assert nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(few.filter("vec_id > 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_best_bins_give_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(500, 6))
    tree = Tree(x, 4, 10)
    order = tree.best_bins(x[0], 10_000)
    assert sorted(order) == list(range(len(tree.leaves)))
    assert set(tree.assign(x)) <= set(order)
