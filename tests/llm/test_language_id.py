"""Operator 4: the forward sum against enumeration, held-out accuracy, and odd rows."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from prefixloom.llm.language_id import Lattice, fit, parts_of, predict_languages, vocabulary, words_of

VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, vocab, longest):
    if not word:
        yield []
    for n in range(1, min(longest, len(word)) + 1):
        piece = vocab.get(word[:n], 0 if n == 1 else None)
        if piece is not None:
            for rest in segmentations(word[n:], vocab, longest):
                yield [piece, *rest]


def test_forward_and_expected_counts_against_all_segmentations():
    vocab = vocabulary(VOCAB)
    longest = max(map(len, vocab))
    words = [p for w in ["the", "thering", "été", "xqz", "Straße".lower(), "字a", "a"] for p in parts_of(w)]
    rng = np.random.default_rng(1)
    prob = rng.random((len(vocab) + 1, 2))
    prob /= prob.sum(axis=0)
    lattice = Lattice(words, vocab, longest)
    mass = lattice.log_mass(prob)
    counts = np.zeros_like(prob)
    for k, w in enumerate(words):
        ways = list(segmentations(w, vocab, longest))
        for lang in range(2):
            each = [math.prod(prob[p, lang] for p in way) for way in ways]
            assert math.isclose(math.log(sum(each)), mass[k, lang], rel_tol=1e-9)
            for way, x in zip(ways, each, strict=True):
                for p in way:
                    counts[p, lang] += x / sum(each)
    assert np.allclose(lattice.expected(prob, np.ones((len(words), 2))), counts)


def test_words_cover_all_letters():
    assert [p for w in words_of("A b2c ½ " + "x" * 70) for p in parts_of(w)] == ["▁a", "▁b", "▁c", "▁" + "x" * 31, "x" * 32, "x" * 7]
    assert [p for w in words_of("12 ½ ²!") for p in parts_of(w)] == []


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), VOCAB)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = predict_languages(docs, model).select("doc_id", "lang", "lang_pred", "score").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark, model):
    rows = [(1, None, 5.0), (2, "", None), (3, "12 !!", 1.0), (None, "the " * 50_000, 1.0), (2**60 + 1, "der und die", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = predict_languages(df, model).collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert all(r["score"] == 0.0 for r in got if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in got if r["doc_id"] == 2**60 + 1} == {"de"} and len(got) == 5


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert predict_languages(empty, fit(empty, VOCAB)).count() == 0
    blank = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert predict_languages(blank, fit(blank, VOCAB)).first()["lang_pred"] == "und"


def test_fit_and_prediction_against_enumeration(spark, monkeypatch):
    """Four rounds of expectation-maximisation and the scores, summed over every segmentation one by one."""
    from prefixloom.llm import language_id

    vocab = {p: i + 1 for i, p in enumerate(["a", "b", "ab", "ba", "\u2581", "\u2581a", "\u2581ab", "aba", "c"])}
    monkeypatch.setattr(language_id, "vocabulary", lambda path: vocab)
    monkeypatch.setattr(language_id, "LATTICE_WORDS", 2)
    texts = [("x", "ab aba ab"), ("x", "aab, ABA b"), ("y", "ba bab c ba"), ("y", "cab bba"), ("x", "ab zab"), ("y", "ccc ba 12")]
    rows, i = [], 0
    for lang, text in texts:
        while zlib.crc32(str(i).encode()) % 3 == 1:
            i += 1
        rows.append((i, text, lang))
        i += 1
    asked = next(k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 3 == 1)
    df = spark.createDataFrame([*rows, (asked, "ab ba zc", "y")], "doc_id long, text string, lang string").repartition(3)
    model = fit(df, "", rounds=4, smoothing=0.02)

    letters = lambda t: ["\u2581" + w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    ways = lambda w: list(segmentations(w, vocab, 3))
    weight = {(lang, w): 0 for lang, t in texts for w in letters(t)}
    for lang, t in texts:
        for w in set(letters(t)):
            weight[lang, w] += 1
    want = {}
    for lang in "xy":
        prob = [0.1] * 10
        for _ in range(4):
            counts = [0.02] * 10
            for (own, w), n in weight.items():
                if own == lang:
                    each = [math.prod(prob[p] for p in way) for way in ways(w)]
                    for way, m in zip(ways(w), each, strict=True):
                        for p in way:
                            counts[p] += n * m / sum(each)
            prob = [c / sum(counts) for c in counts]
        want[lang] = prob
    assert model.languages == ["x", "y"]
    assert np.allclose(model.prob, np.array([want["x"], want["y"]]).T)
    for r in predict_languages(df, model).collect():
        parts = letters(r["text"])
        mass = {lang: sum(math.log(sum(math.prod(want[lang][p] for p in way) for way in ways(w))) for w in parts) for lang in "xy"}
        best = max("xy", key=lambda lang: mass[lang])
        score = 1 / sum(math.exp((m - mass[best]) / math.sqrt(len(parts))) for m in mass.values())
        assert r["lang_pred"] == best and math.isclose(r["score"], score, rel_tol=1e-9)


def test_bounds_and_column_names(spark):
    rows = [(i, f"wort {i} und", f"l{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df, VOCAB, sample_documents=3, most_languages=2)
    assert len(model.languages) == 2
    got = predict_languages(df.withColumn("score", F.lit("mine")), model, pred_col="p", score_col="s")
    assert got.columns == ["doc_id", "text", "lang", "score", "p", "s"] and {r["score"] for r in got.collect()} == {"mine"}
