"""Operator 10 where the calibrated number of leaves holds fewer than k rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.llm.ann import Tree, nearest


def test_small_leaves_still_give_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 20 == 0, leaf=8, recall=0.05).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"))
    assert sorted((r["query_id"], r["n"], r["ids"]) for r in got.collect()) == [(i, 20, 20) for i in range(0, 400, 20)]


@pytest.mark.parametrize("k", [20, 399, 1000])
def test_all_candidates_where_they_are_few(spark, k):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(30)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") == 0, k=k, leaf=4, recall=0.05).collect()
    assert len({r["vec_id"] for r in got}) == len(got) == min(k, 29)


def test_best_bins_go_on_to_the_rows_asked_for():
    x = np.random.default_rng(1).normal(size=(500, 6))
    tree = Tree(x, 4, 10)
    sizes = dict(zip(*np.unique(tree.assign(x), return_counts=True), strict=True))
    for least in (0, 21, 200, 500):
        order = tree.best_bins(x[0], 2, sizes, least)
        held = np.cumsum([sizes.get(i, 0) for i in order])
        assert held[-1] >= least and (len(order) == 2 or held[-2] < least)
    assert len(tree.best_bins(x[0], 2, sizes, 501)) == len(tree.leaves)
