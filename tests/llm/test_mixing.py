"""Operator 9 against a row-by-row version and its own targets."""

from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from prefixloom.llm.mixing import bisect, entropy, mix, mixed_documents, mixture, repetitions, tokens_of, weights


def test_bisection_meets_its_targets():
    tokens = [1000, 100, 100, 50, 0]
    t = bisect(tokens, None, 2.0, None)
    assert 0 < t < 1 and abs(max(repetitions(tokens, t, None)) - 2.0) < 1e-6
    most = entropy(weights(tokens, 0.0))
    target = (most + entropy(weights(tokens, 1.0))) / 2
    assert abs(entropy(weights(tokens, bisect(tokens, target, None, None))) - target) < 1e-6
    assert bisect(tokens, most + 1, None, None) == 0.0
    assert min(r for r in repetitions(tokens, t, None) if r) == pytest.approx(1.0)


@pytest.mark.parametrize("how", [{"max_repeats": 1.5}, {"max_repeats": 3.0}, {"max_repeats": None, "target_entropy": 4.0, "budget": 150_000.0}])
def test_tokens_meet_the_plan(spark, how):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    args = {"target_entropy": None, "max_repeats": None, "budget": None} | how
    plan = {r["s"]["name"]: r for r in mixture(df, "text", "source", block_tokens=3000, **args).collect()}
    tokens = {r["doc_id"]: len(r["text"].split()) for r in df.collect()}
    got = mix(df, block_tokens=3000, **how).collect()
    used, uses = defaultdict(int), Counter()
    ranks = defaultdict(dict)
    for r in got:
        used[r["source"]] += tokens[r["doc_id"]]
        uses[r["source"], r["doc_id"]] += 1
        assert ranks[r["source"], r["mix_pass"]].setdefault(r["mix_block"], r["mix_rank"]) == r["mix_rank"]
    for s, p in plan.items():
        want = p["repetitions"] * p["tokens"]
        longest = max(tokens[r["doc_id"]] for r in df.filter(df.source == s).collect())
        assert want - longest - 1 <= used[s] <= want + 1
        n = [uses[s, r["doc_id"]] for r in df.filter(df.source == s).collect()]
        assert set(n) <= {p["whole"], p["whole"] + 1}
    for (s, k), order in ranks.items():
        assert sorted(order.values()) == list(range(1, len(order) + 1))
    if how.get("max_repeats"):
        assert max(p["repetitions"] for p in plan.values()) <= how["max_repeats"] + 1e-6
        assert {r["doc_id"] for r in got} == set(tokens)
        orders = {s: [tuple(b for b, _ in sorted(ranks[s, k].items(), key=lambda x: x[1])) for (x, k) in ranks if x == s] for s in plan}
        assert any(len(set(o)) > 1 for o in orders.values())


def test_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "x y", None, 1), (3, "x y", None, 1), (None, "z z z", "", 1), (4, None, "none", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_pass int")
    got = Counter(map(tuple, mixed_documents(df, max_repeats=1.0).collect()))
    assert got == Counter(rows)
    assert mix(df.limit(0)).count() == 0
    assert [r[0] for r in spark.createDataFrame([(" a  b\n",), ("",), (None,), ("x",)], "text string").select(tokens_of()).collect()] == [2, 0, 0, 1]


def simulated(rows, limit, block_tokens, seed, spark):
    """Row by row: exponent by halving steps, blocks, passes, and the documents of each use.  Only the hashes are Spark's."""
    sources = sorted({s for _, _, s in rows})
    tokens = {s: sum(len(t.split()) for _, t, own in rows if own == s) for s in sources}
    total = sum(tokens.values())

    def uses(e):
        w = {s: (tokens[s] / total) ** e for s in sources}
        least = min(w[s] / tokens[s] for s in sources)
        return {s: w[s] / tokens[s] / least for s in sources}

    e, step = 1.0, 0.5
    while step > 1e-15:  # the smallest exponent whose most repeated source is within the limit
        while e - step >= 0 and max(uses(e - step).values()) <= limit:
            e -= step
        step /= 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("d", F.col("doc_id").cast("string"))
    th = F.xxhash64("text")
    deal = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("d", th, F.lit(seed))).collect()}
    out = Counter()
    for s in sources:
        times = uses(e)[s]
        times = float(round(times)) if abs(times - round(times)) < 1e-9 else times
        whole, own = int(times), [(d, len(t.split())) for d, t, x in rows if x == s]
        n = max(1, -(-tokens[s] // block_tokens))
        block = {d: deal[d] % n for d, _ in own}
        for d, _ in own:
            for k in range(whole):
                out[d, k] += 1
        left = int((times - whole) * tokens[s])
        order = spark.range(n).select("id", F.xxhash64(F.lit(s), F.lit(whole), "id", F.lit(seed)).alias("h")).collect()
        within = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("d", th, F.lit(whole), F.lit(seed))).collect()}
        for b in (r["id"] for r in sorted(order, key=lambda r: (r["h"], r["id"]))):
            running = 0
            for d, size in sorted((x for x in own if block[x[0]] == b), key=lambda x: (within[x[0]], str(x[0]))):
                running += size
                if running <= left:
                    out[d, whole] += 1
            left = max(0, left - running)
    return out


def test_against_a_row_by_row_simulation(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)) + f" {i}", "abc"[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for limit in (1.3, 1.7, 2.6):
        got = Counter((r["doc_id"], r["mix_pass"]) for r in mix(df, max_repeats=limit, block_tokens=150, seed=17).collect())
        assert got == simulated(rows, limit, 150, 17, spark)


def test_targets_that_no_mixture_meets(spark):
    with pytest.raises(ValueError, match="no mixture"):
        bisect([1000, 10], None, 1.2, 5000.0)
    with pytest.raises(ValueError, match="no mixture"):
        bisect([1000, 1000], 0.5, None, None)
    df = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="more than 4 sources"):
        mix(df, most_sources=4)
