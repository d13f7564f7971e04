"""Operator 2 on the executors' side: processes that they start while texts are encoded, garbage that they keep, words encoded twice."""

import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefixloom.llm.token_files import UnitEncoder, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
RUN = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession
from prefixloom.llm.token_files import read_token_files, write_token_files
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{sys.argv[1]}/shared").getOrCreate()
df = spark.range(600).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 20) AS text")
log = Path(sys.argv[1], "started")
lines = lambda: log.read_text().splitlines() if log.exists() else []
df.count()
before = len(lines())  # the checkpoint folder
manifest = write_token_files(df, f"file://{sys.argv[1]}/ids", sys.argv[2], shard_bytes=1 << 13)
print("shards", manifest.count())
print("started", len(lines()) - before)
spark.range(2).write.parquet(f"file://{sys.argv[1]}/other")
print("seen", log.exists())
"""


def test_shards_start_no_processes(tmp_path):
    (tmp_path / "bin").mkdir()
    shim = tmp_path / "bin/chmod"
    shim.write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/started\nexec /bin/chmod "$@"\n')
    shim.chmod(0o755)
    env = os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}", "PYTHONPATH": f"{Path(__file__).parents[2]}:{os.environ.get('PYTHONPATH', '')}"}
    run = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), PATH], env=env, capture_output=True, text=True, timeout=240)
    said = dict(x.split() for x in run.stdout.splitlines() if x.startswith(("shards", "started", "seen")))
    assert not run.returncode, run.stderr[-2000:]
    if said["seen"] == "False":
        pytest.skip("Hadoop's native library is there, which starts no processes")
    assert int(said["shards"]) >= 4 and int(said["started"]) == 0, said


def test_garbage_is_collected_after_the_shards(spark, tmp_path):
    def whole() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))

    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    before = whole()
    manifest = write_token_files(df, f"file://{tmp_path}/ids", PATH)
    assert whole() > before
    assert read_token_files(manifest).count() == 50


def test_manifest_starts(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words " * (i % 7)) for i in range(300)], "doc_id long, text string")
    rows = write_token_files(df, f"file://{tmp_path}/ids", PATH, shard_bytes=1 << 11).orderBy("shard").collect()
    assert len(rows) > 2 and [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    empty = write_token_files(df.limit(0), f"file://{tmp_path}/none", PATH)
    assert empty.columns == ["shard", "file", "documents", "n_tokens", "bytes", "start"] and not read_token_files(empty).count()


def test_words_around_breaks_and_marks_are_encoded_once():
    tok, own, pieces = Tokenizer.from_file(PATH), UnitEncoder(PATH), []
    inner = own.piece
    own.piece = lambda piece: pieces.append(piece) or inner(piece)
    words = [f"{a}{b}lix" for a in "abcdéf" for b in "rstuñ"]
    lines = "".join(f"{a}.\n{b} {a}!!,\n{b}***\n" for a in words for b in words)
    assert np.frombuffer(own.encode(lines), own.dtype).tolist() == tok.encode(lines, add_special_tokens=False).ids
    assert len(pieces) < 4 * len(words)  # by line breaks and marks it were thousands


def test_white_space_and_marks_as_the_library():
    tok, own, rng = Tokenizer.from_file(PATH), UnitEncoder(PATH), random.Random(5)
    parts = [*" \n\t\r\0\x0b\x1c\x85\xa0\u2028\u3000'.,!*_$%-()", "  ", "\n\n", " \n", "\n ", "'s", "'re", "''", "word", "Élan", "ß", "x1", "42", "½", "日本", "й", "\u0301"]
    for n in range(6000):
        text = "".join(rng.choices(parts, k=n % 12))
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
