"""Operator 2 on a whole table against the library at its default setting; its dictionary, files and pre-token pattern."""

import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefixloom.llm.token_files import TokenFile, UnitEncoder, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def crc(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def test_whole_table(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    want = [(r["doc_id"], *crc(tok, r["text"])) for r in df.orderBy("doc_id").collect()]
    manifest = write_token_files(df, f"file://{tmp_path}/ids", PATH, added_tokens=True, shard_bytes=1 << 19)
    got = read_token_files(manifest).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    assert [r["start"] for r in got] == [0, *np.cumsum([n for _, n, _ in want])[:-1].tolist()]
    rows = manifest.collect()
    assert len(rows) > 3 and all(r["file"].startswith("file:///") for r in rows)
    assert sum(r["documents"] for r in rows) == len(want) and all(TokenFile(r["file"]).documents == r["documents"] for r in rows)
    names = sorted(x.name for x in (tmp_path / "ids").iterdir())
    assert [n[:5] for n in names] == ["dicti"] + ["shard"] * len(rows)
    assert (tmp_path / "ids" / names[0]).read_bytes()[:4] == bytes.fromhex("37a430ec")  # a trained dictionary
    plain = sum(TokenFile(r["file"]).index["length"].sum() for r in rows)
    assert plain < 2 * sum(n for _, n, _ in want)


@pytest.mark.parametrize("texts", [["a"], ["some words"] * 3, [None, ""]])
def test_sample_too_small_to_train_on(spark, tmp_path, texts):
    tok = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = read_token_files(write_token_files(df, f"file://{tmp_path}/ids", PATH)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [crc(tok, t) for t in texts]


def test_every_character_by_itself_and_in_words():
    """Classes of characters in the hand-written pattern, for every code point below the bound and some above."""
    tok, own = Tokenizer.from_file(PATH), UnitEncoder(PATH, True)
    for c in [*range(0x600), *range(0x2000, 0x2100), *range(0xFF00, 0xFF20), 0x1F600, 0x3042, sys.maxunicode]:
        for text in (chr(c), f"ab{chr(c)}cd 1{chr(c)}2", f" x {chr(c)} {chr(c)}y.{chr(c)}, z{chr(c)}"):
            assert np.frombuffer(own.encode(text), own.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, (hex(c), text)
