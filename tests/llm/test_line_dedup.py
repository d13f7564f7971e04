"""Operator 7 against a version that holds all lines in memory, and its guarantee."""

import random

import numpy as np
import pytest
import xxhash

from prefixloom.llm.line_dedup import dedup_lines, fingerprints, lines_of, runs


def brute(rows, gram_words):
    """rows: (id, text), ids distinct, in order of id -> id -> (text, deleted)"""
    docs = {i: lines_of(t or "") for i, t in sorted(rows)}
    first, marks = {}, []
    for i, (_, _, h, w) in docs.items():
        for g, p, n in sorted(fingerprints(h, w, gram_words), key=lambda x: x[1]):
            if g in first:
                marks.append((i, p, n, *first[g]))
            else:
                first[g] = (i, p)
    gone = {i: set() for i in docs}
    for i, p, n, j, q in marks:
        a, b = docs[i][2], docs[j][2]
        lo = 0
        while lo < min(p, q) and a[p - lo - 1] == b[q - lo - 1]:
            lo += 1
        hi = 0
        while p + hi < len(a) and q + hi < len(b) and a[p + hi] == b[q + hi]:
            hi += 1
        assert hi >= n
        gone[i] |= {int(docs[i][1][k]) for k in range(p - lo, p + hi)}
    text = {i: t for i, t in rows}
    out = {}
    for i, (lines, *_) in docs.items():
        out[i] = (text[i] if not gone[i] else "\n".join(x for k, x in enumerate(lines) if k not in gone[i]), len(gone[i]))
    return out


def corpus(rng):
    line = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    passages = [[line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))] for _ in range(12)]
    short = [line(3) for _ in range(4)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 8)):
            lines += rng.choice([[line(rng.randint(1, 40))], rng.choice(passages), [rng.choice(short)], [""], ["  "]])
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, "\n".join(["same short line"] * 60)), (301, None), (302, "x" * 5000)]
    return rows


def plain(rows, gram_words):
    """The operator written out again, with lines as tuples of words and nothing of the module but its hash, since the
    smallest hash in a window is what is chosen."""
    h64 = xxhash.xxh3_64_intdigest
    docs = {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        docs[i] = [(k, tuple(x.split())) for k, x in enumerate(lines) if x.split()]
    chosen = {}
    for i, lines in docs.items():
        grams = []
        for a in range(len(lines)):
            b, n = a, 0
            while b < len(lines) and n < gram_words:
                n += len(lines[b][1])
                b += 1
            if n >= gram_words:
                each = [h64(" ".join(w).encode()) for _, w in lines[a:b]]
                grams.append((each[0] if b == a + 1 else h64(b"".join(x.to_bytes(8, "little") for x in each)), a, b))
        last, picks = None, []
        for k, (_, a, b) in enumerate(grams):
            window = grams[k : k + b - a]
            least = min(g for g, _, _ in window)
            if last is None or last[1] < a or last[0] != least:
                last = [g for g in window if g[0] == least][-1]
                picks.append(last)
        chosen[i] = picks
    first, gone = {}, {i: set() for i in docs}
    for i in sorted(docs):
        for g, a, b in sorted(chosen[i], key=lambda x: x[1]):
            if g not in first:
                first[g] = (i, a)
                continue
            j, c = first[g]
            mine, theirs = [w for _, w in docs[i]], [w for _, w in docs[j]]
            lo = next((d for d in range(min(a, c)) if mine[a - d - 1] != theirs[c - d - 1]), min(a, c))
            most = min(len(mine) - a, len(theirs) - c)
            hi = next((d for d in range(most) if mine[a + d] != theirs[c + d]), most)
            gone[i] |= {docs[i][k][0] for k in range(a - lo, a + hi)}
    return {i: (t if not gone[i] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in rows}


def test_written_out_again(spark):
    rows = corpus(random.Random(7))
    long = [f"line {k} of a long text with some words" for k in range(400)]
    rows += [(400, "\n".join(long)), (401, "\n".join(long)), (402, "\n".join(long[:150] + ["between"] + long[150:])), (403, "\n".join(long[200:] + long[:200]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in dedup_lines(df, gram_words=25, removed_col="gone").collect()}
    assert got == plain(rows, 25)
    assert got[401] == ("", 400) and got[402] == ("between", 400)


def test_a_pair_of_long_copies_is_one_row():
    lines = np.arange(5000, dtype=np.uint64)
    matches = [(p, p, 3) for p in range(0, 4990, 7)]
    assert runs(lines, lines, matches) == [(0, 5000)]
    assert runs(lines, np.roll(lines, -2000), [(2000, 0, 3), (2100, 100, 3), (0, 3000, 3)]) == [(0, 2000), (2000, 5000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_memory(spark, seed):
    rows = corpus(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in dedup_lines(df, gram_words=10, removed_col="gone").collect()}
    assert got == brute(rows, 10)
    # no run of 20 words stays twice
    seen = {}
    for i, (t, _) in sorted(got.items()):
        _, _, h, w = lines_of(t or "")
        for a in range(len(h)):
            b = a
            while b < len(h) and w[a:b].sum() < 20:
                b += 1
            if w[a:b].sum() >= 20:
                key = tuple(h[a:b])
                assert key not in seen or seen[key] == i and set(h[a:b]) == {h[a]}, (i, seen[key])
                seen[key] = i


def test_every_long_repeat_has_a_common_fingerprint():
    rng = np.random.default_rng(3)
    for _ in range(200):
        words = rng.integers(1, 30, 40)
        hashes = rng.integers(0, 2**63, 40).astype(np.uint64)
        a, b = sorted(rng.choice(41, 2, replace=False))
        if words[a:b].sum() < 50:
            continue
        other_h = np.concatenate([rng.integers(0, 2**63, 7).astype(np.uint64), hashes[a:b], rng.integers(0, 2**63, 5).astype(np.uint64)])
        other_w = np.concatenate([rng.integers(1, 30, 7), words[a:b], rng.integers(1, 30, 5)])
        one = {g for g, p, n in fingerprints(hashes, words, 25) if a <= p and p + n <= b}
        two = {g for g, p, n in fingerprints(other_h, other_w, 25) if p >= 7 and p + n <= 7 + b - a}
        assert one & two


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y", "c"), (None, "z " * 40, "d"), (5, "z " * 40, "e"), (5, "z " * 40, "e"), (6, "q " * 30 + "\n" + "z " * 40, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted(map(str, map(tuple, dedup_lines(df).collect())))
    want = [(1, None, "a"), (2, "", "b"), (3, "x y", "c"), (None, "z " * 40, "d"), (5, "", "e"), (5, "", "e"), (6, "q " * 30, "f")]
    assert got == sorted(map(str, want))
    assert dedup_lines(df.limit(0)).count() == 0
