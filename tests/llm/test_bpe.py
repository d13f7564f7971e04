"""Operator 6 against the tiktoken library on whole texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from prefixloom.llm.bpe import encode_documents, starts, stitch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
rng = random.Random(5)
LONG = "".join(rng.choice(["the", " they'", "re", " \n", "  ", "Été", "12", "!!", "\t\t", " x", "\u3000", "'ve", "\x1c", "字"]) for _ in range(4000))
TEXTS = [None, "", " ", "a  b", "don't", LONG, LONG, " " * 700 + "x", "a" * 3000, "x\n\n\ny" * 300, "word " * 900, "tail \n \n", "😀 é\xa0 z"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [64, 500, 100_000])
def test_ids_and_bytes(spark, library, chunk):
    rows = [(i if i else None, t, "extra") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = []
    for i, t, _ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((str(i), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = encode_documents(df, RANKS, PATTERN, chunk=chunk, overlap=24).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in got)


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (100, 30), (333, 5)])
def test_stitch_gives_the_whole_texts_starts(chunk, overlap):
    pattern = regex.compile(PATTERN)
    for text in filter(None, TEXTS):
        begins = range(0, len(text), chunk)
        parts = [(b, min(len(text), b + chunk + overlap), np.array(starts(text[b : b + chunk + overlap], pattern, b))) for b in begins]
        assert stitch(text, parts, pattern) == starts(text, pattern)


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS, PATTERN).count() == 0
