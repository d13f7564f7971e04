"""The pipeline's stages on their own input, against the brute-force versions of the operators' tests."""

import hashlib
from collections import Counter

import pytest
from test_bpe import PATTERN, RANKS
from test_jaccard_join import brute as all_pairs
from test_line_dedup import brute as in_memory

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    extra = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "123 !!", None, None, 6), (-3, "", "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(COLUMNS).unionByName(extra)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], "/root/testdata/sf0.001").write.parquet(f"file://{base}/{name}")
        out.append(spark.read.parquet(f"file://{base}/{name}"))
    return out


def test_columns(stages):
    assert [s.columns for s in stages[:-1]] == [COLUMNS] * 5


def test_language_id_drops_only_texts_without_letters(stages):
    assert {r["doc_id"] for r in stages[0].collect()} - {r["doc_id"] for r in stages[1].collect()} == {-1, -2, -3}


def test_line_dedup(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    got = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    assert got == {i: t for i, (t, _) in in_memory(before, 25).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = {i for i, n, c in all_pairs(before) if i == c}
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(want)


def test_mixing_repeats_and_keeps_all(stages):
    uses = Counter(r["doc_id"] for r in stages[4].collect())
    assert uses.keys() == {r["doc_id"] for r in stages[3].collect()} and set(uses.values()) <= {1, 2}


def test_bpe(stages):
    text = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    got = stages[5].collect()
    assert len(got) == stages[4].count()
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in got)


def test_run_is_the_stages_in_order(spark, stages):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0 and PATTERN and RANKS
