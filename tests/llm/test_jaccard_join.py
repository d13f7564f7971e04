"""Operator 5 against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from prefixloom.llm.common import components
from prefixloom.llm.jaccard_join import CELLS, PartEnum, Shingler, cells_of, common_counts, forest, frequent_cells, jaccard_components, keep_one, shingle_counts


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """rows: (id, text) -> sorted (id, size, component)"""
    sets = [shingle_set(t) for _, t in rows]
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in by[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(rng):
    vocab = [f"w{i}" for i in range(2000)]
    rows, doc = [], 0
    for size in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 80, 130, 300, 700, 1500]:
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            for _ in range(6):
                t = list(base)
                for _ in range(rng.randint(0, max(1, size // 22))):
                    k = rng.randrange(len(t))
                    if rng.random() < 0.5:
                        t[k] = rng.choice(vocab)
                    elif len(t) > 1:
                        del t[k]
                if rng.random() < 0.5:
                    t += [rng.choice(vocab) for _ in range(rng.randint(0, size // 3))]
                rows.append((doc, rng.choice([" ", "\n", " \t"]).join(t).upper() if rng.random() < 0.2 else " ".join(t)))
                doc += 1
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    for _ in range(60):
        rows.append((doc, passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 80)))))
        doc += 1
    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(80):  # a chain: each is close to the one before
        base = base[3:] + [rng.choice(vocab) for _ in range(3)]
        rows.append((doc, " ".join(base)))
        doc += 1
    return rows


@pytest.mark.parametrize("seed,n2,k2,frequent", [(1, 2, 1, 6), (2, 2, 1, 3), (3, 3, 1, 10**9)])
def test_against_all_pairs(spark, seed, n2, k2, frequent):
    rows = near_copies(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard_components(df, n2=n2, k2=k2, frequent=frequent).collect()))
    assert got == brute(rows)


@pytest.mark.parametrize("how", [{"signatures": None}, {"signatures": None, "n2": 3, "k2": 1, "group": 4, "elements": 900}, {"group": 2, "block": 16}])
def test_exact_scheme_and_blocks_against_all_pairs(spark, how):
    """The whole enumeration, and groups so small that most sets are compared block against block."""
    rows = [r for r in near_copies(random.Random(4)) if len(r[1]) < 500]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard_components(df, **how).collect()))
    assert got == brute(rows)


def test_exact_scheme_misses_no_pair():
    """Pairs exactly at the threshold, the shared part as rare as the scheme allows: always a common signature."""
    rng = np.random.default_rng(1)
    pe = PartEnum(75, None, 2, 1)
    for size in [2, 3, 4, 5, 6, 7, 8, 9, 11, 15, 16, 28, 64, 200]:
        for _ in range(60):
            union = rng.integers(0, 2**63, size, dtype=np.uint64)
            common = -(-3 * size // 4)
            cut = rng.integers(0, size - common + 1)
            a, b = union[: common + cut], np.concatenate([union[:common], union[common + cut :]])
            if len(a) > 3 or len(b) > 3:
                assert set(pe.sign(a)) & set(pe.sign(b)), (size, cut)


def test_forest_joins_what_the_links_join():
    rng = np.random.default_rng(5)
    base = np.arange(60)
    sets = [np.sort(np.concatenate([base[rng.random(60) < 0.9], rng.integers(1000, 9000, rng.integers(0, 9))])) for _ in range(70)]
    sets = [np.unique(x) for x in sets]
    ids = list(range(70))

    def groups(edges):
        root = list(ids)
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    every = []
    for i in ids:
        for j in ids[:i]:
            c = len(np.intersect1d(sets[i], sets[j]))
            assert common_counts([sets[i]], [sets[j]], 7)[0, 0] == c
            if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                every.append((i, j))
    got = forest(ids, ids, sets, ids, ids, sets, 75)
    assert groups(got) == groups(every) and len(got) < 70
    half = forest(ids[:30], ids[:30], sets[:30], ids[30:], ids[30:], sets[30:], 75)
    assert groups(half) == groups([e for e in every if e[0] >= 30 > e[1]])


def test_rows_equal_in_id_and_text_have_a_rule(spark):
    near = " ".join(f"w{i}" for i in range(50))
    rows = [(1, near, "q"), (1, near, "p"), (1, near, None), (2, near + " x", "a")]
    for parts in (1, 3):
        got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)).collect()
        assert [tuple(r) for r in got] == [(1, near, "p")]


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, jaccard_components(df).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "a b", 1), (5, "A  b", 1), (6, "a b c d e", 1), (6, "a b c d e", 1), (None, "a b c d e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(map(str, map(tuple, jaccard_components(df).collect())))
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (None, 1, 6)]
    assert got == sorted(map(str, want))
    assert jaccard_components(df.limit(0)).count() == 0


def test_signatures_meet_at_the_threshold():
    rng = np.random.default_rng(0)
    pe = PartEnum(75, 64, 2, 1)
    for size in [3, 4, 5, 7, 8, 12, 20, 40, 100, 400, 2000]:
        for _ in range(40):
            union = rng.integers(0, 2**63, size, dtype=np.uint64)
            common = -(-3 * size // 4)
            rest = size - common
            cut = rng.integers(0, rest + 1)
            a, b = union[: common + cut], np.concatenate([union[:common], union[common + cut :]])
            assert set(pe.sign(a)) & set(pe.sign(b)), (size, cut)


def test_one_of_each_component_stays(spark):
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(3, near, 1), (2, near + " x", 1), (2, near + " x", 1), (None, "a b", 2), (9, "A b", 2), (5, None, 3), (5, None, 3), (7, "q", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(map(str, map(tuple, keep_one(df).collect())))
    assert got == sorted(map(str, [(2, near + " x", 1), (None, "a b", 2), (5, None, 3), (5, None, 3), (7, "q", 4)]))


def test_lower_case_and_spaces_are_ascii_only():
    sh = Shingler(5)
    assert np.array_equal(sh.shingles("A\x0bb\x0cC d E"), sh.shingles("a b c d e"))
    assert not np.array_equal(sh.shingles("É b c d e"), sh.shingles("é b c d e"))
    assert len(sh.shingles("a\xa0b c")) == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}


def test_frequent_shingles_are_counted_over_all_documents(spark):
    """A passage in 40 of 12,000 documents, more than the 8,192 that a sample once had, and every cell's count by brute force."""
    passage = "this very passage stands in some of the documents"
    rows = [(i, f"own{i} words{i} of{i} text{i} here{i}" + (f" {passage}" if i % 300 == 0 else "")) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    counts = shingle_counts(docs, 5)
    want = np.zeros(CELLS, dtype=np.int64)
    for _, text in rows:
        want[np.unique(cells_of(Shingler(5).shingles(text)))] += 1
    assert (counts == want).all()
    shared = cells_of(Shingler(5).shingles(passage))
    assert (counts[shared] >= 40).all()
    often = frequent_cells(docs, 5, 20, 8192)
    assert often[shared].all() and (often == (want >= 20 * 12_000 / 8192)).all()
    assert not frequent_cells(docs, 5, 40, 8192)[cells_of(Shingler(5).shingles(rows[1][1]))].any()
    s = Shingler(5).shingles(rows[0][1])
    rare = PartEnum(75, 64, 2, 1).sign(s, np.zeros(CELLS, dtype=bool))
    assert set(PartEnum(75, 64, 2, 1).sign(s)) == set(rare) != set(PartEnum(75, 64, 2, 1).sign(s, often))
    assert not frequent_cells(docs.limit(0), 5, 6, 8192).any()
