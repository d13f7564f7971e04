"""Operators 1, 2 and 8 against brute force on small tables with nulls, empty, long and repeated texts."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from prefixloom.llm.exact_dedup import build_index, entries, exact_dedup
from prefixloom.llm.sharding import shard_rows
from prefixloom.llm.common import units
from prefixloom.llm.token_files import TokenFile, read_token_files, write_token_files

SCHEMA = "doc_id long, text string, size string, shard string, key string"
TEXTS = [
    None, "", " ", "a", "a b  c", "a\tb c", "a b c", "Été à la plage\n\n  fin ", "x" * 3000, "word " * 4000, "a b\x0bc",
    "don't 's  '  ll   x", "a  ", "\n\n\n", "<|endoftext|> y", "a b", "12 345\r\n  6", "   lead", "a\n b\n  c\n   d",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "z", None, "k") for i, t in enumerate(TEXTS)] + [(100 + i, "hot text  here", "z", None, "k") for i in range(40)]
    rows += [(None, "no id", None, None, None), (3, "a", None, None, None), (-5, "a", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def jump(key: int, n: int) -> int:
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 40, 1000])
def test_sharding(spark, docs, n):
    got = shard_rows(docs, n).collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    text = defaultdict(list)
    for r in docs.collect():
        text[r["doc_id"]].append((r["text"] or "").encode())
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, n) and r["grown_shard"] == jump(r["doc_id"] or 0, n + 1)
        assert r["grown_shard"] in (r["shard"], n) and r["law"] == "key"
        assert (r["size"], r["text_crc32"]) in [(len(t) + 16, zlib.crc32(t)) for t in text[r["doc_id"]]]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shard_rows(empty).count() == 0
    assert exact_dedup(empty).count() == 0


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r["text"])].append(r["doc_id"])
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(docs).collect())
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(str(i), str(keep), len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert got == sorted(want)


def test_directory_doubling(spark, docs):
    many = spark.range(500).selectExpr("id as doc_id", "concat('text ', id) as text")
    index = build_index(entries(many), capacity=16).collect()
    assert len(index) == 500
    buckets = defaultdict(list)
    for r in index:
        assert r["bucket"] == (r["key"] % 2**64) >> (64 - r["local_depth"])
        buckets[r["local_depth"], r["bucket"]].append(r["key"])
    assert max(map(len, buckets.values())) <= 16 and len({d for d, _ in buckets}) > 1
    spans = sorted((b << (64 - d), (b + 1) << (64 - d)) for d, b in buckets)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    manifest = write_token_files(docs, f"file://{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    want = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows)
    got = read_token_files(manifest).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: -(2**63) if x is None else x)
    m = manifest.orderBy("shard").first()
    shard = TokenFile(m["file"])
    last = len(shard.index) - 1
    assert len(shard.ids(last)) == shard.index[last]["n_tokens"]


def test_units_join_to_the_text():
    for t in filter(None, TEXTS):
        assert "".join(units(t)) == t
