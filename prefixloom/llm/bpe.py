"""Operator 6, byte-level BPE by ranks, with overlapping chunks for long texts.

Short texts are encoded where they are.  A text of more than `chunk` characters is cut into chunks that overlap by
`overlap` characters, dealt to all tasks.  Each chunk is pre-tokenised by itself and gives the places where a pre-token
starts.  What the pattern matches at a place depends on the text from there on only, so once two neighbours agree on one
start inside their overlap, they agree from there on: the stitch keeps the left chunk's starts up to the first one that
the right chunk has too, and the right chunk's from there.  Starts that a chunk found in its last overlap may have
been cut short by the chunk's end and are never trusted beyond the stitch.  Where no start in the overlap agrees
(one pre-token longer than it), the stitch matches on by itself, from the last sure start, until one agrees.
The stitched text is dealt out again as pieces that end at pre-token starts before white space; pieces are encoded in parallel, and
the ids of the pieces in order are the text's.  Decoding concatenates the raw bytes of the ids.

Null text counts as empty and has no ids.  Repeated rows are encoded once and counted.  Null and repeated ids pass
through.  An empty table gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, idle_memory, text_or_empty, units

MOST_UNITS = 400_000
#: Units that a worker keeps between tasks.
KEPT_UNITS = 50_000
#: Characters that the pattern may look at beyond a match: the longest alternative of fixed text has three.
MARGIN = 4


class RankEncoder:
    """tiktoken's ids for whole texts, by way of a bounded table of white-space units."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.raw = {b: a for a, b in ranks.items()}

    def unit(self, unit: str) -> bytes:
        if len(unit) <= 10_000:
            out = np.array(self.encoding.encode_ordinary(unit), dtype="<u4").tobytes()
            if len(unit) <= 64:
                if len(self.known) >= MOST_UNITS:
                    self.known.clear()
                self.known[unit] = out
            return out
        # pre-token by pre-token: the library's own pattern engine gives up on very long runs
        single = self.encoding._core_bpe.encode_single_piece
        return b"".join(np.array(single(m.group().encode()), dtype="<u4").tobytes() for m in self.pattern.finditer(unit))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, unit = self.known.get, self.unit
        return b"".join([get(u) or unit(u) for u in units(text)])

    def trim(self) -> None:
        """Forget all units but the first KEPT_UNITS and give their memory back: an idle worker, which later stages use again, holds little."""
        if len(self.known) > KEPT_UNITS:
            self.known = dict(islice(self.known.items(), KEPT_UNITS))
        idle_memory()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> RankEncoder:
    return RankEncoder(ranks_path, pattern)


def starts(text: str, pattern, offset: int = 0) -> list[int]:
    return [m.start() + offset for m in pattern.finditer(text)]


def stitch(text: str, chunks: list[tuple[int, int, np.ndarray]], pattern) -> list[int]:
    """Starts of the whole text's pre-tokens.  chunks: (begin, end, starts found between), overlapping, in order."""
    n, at, out = len(text), 0, []
    sets = [set(found.tolist()) for _, _, found in chunks]
    for k, (_, end, found) in enumerate(chunks):
        last = k == len(chunks) - 1
        sure = n if last else end - MARGIN  # a match that ends later may have been cut short
        begin_next, nxt = (n, set()) if last else (chunks[k + 1][0], sets[k + 1])
        while at < sure and at not in sets[k]:  # out of step: match on until a start agrees
            out.append(at)
            at = pattern.match(text, at).end()
        if at >= sure:
            continue
        i = int(np.searchsorted(found, at))
        while not (at >= begin_next and at in nxt):
            to = int(found[i + 1]) if i + 1 < len(found) else end
            if to > sure:
                break
            out.append(at)
            at, i = to, i + 1
            if at >= n:
                return out
    while at < n:
        out.append(at)
        at = pattern.match(text, at).end()
    return out


def _digests(ids: bytes, known: RankEncoder, keep_ids: bool) -> tuple:
    return len(ids) // 4, ids if keep_ids else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(known.decode(ids)).hexdigest()


OUT = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
OUT_SCHEMA = "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def encode_documents(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = 32768, overlap: int = 256, keep_ids: bool = True,
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian uint32; null without keep_ids), ids_sha256, decoded_sha256."""
    if overlap <= MARGIN or chunk < 1:
        raise ValueError("the overlap must exceed the pattern's look-ahead")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    white = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                done = [_digests(known.encode(t), known, keep_ids) for t in part.column(1).to_pylist()]
                kinds = (pa.int64(), pa.binary(), pa.string(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, part.column(0)], names=[*OUT, "doc_id"])
        known.trim()

    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, f"{OUT_SCHEMA}, doc_id long")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                begins = list(range(0, len(text), chunk))
                yield pd.DataFrame({"key": key, "begin": begins, "part": [text[b : b + chunk + overlap] for b in begins]})

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pat = encoder(ranks_path, pattern).pattern
        for pdf in batches:
            found = [np.array(starts(t, pat, b), "<i8").tobytes() for t, b in zip(pdf["part"], pdf["begin"], strict=True)]
            ends = [b + len(t) for t, b in zip(pdf["part"], pdf["begin"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "begin": pdf["begin"], "end": ends, "found": found})

    def join_up(text: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        whole_text, key = text["text"].iloc[0], text["key"].iloc[0]
        parts = parts.sort_values("begin")
        chunks = [(int(b), int(e), np.frombuffer(f, "<i8")) for b, e, f in zip(parts["begin"], parts["end"], parts["found"], strict=True)]
        # pieces end at starts where white space follows something else: their ids don't depend on what follows
        found_at = stitch(whole_text, chunks, encoder(ranks_path, pattern).pattern)
        at = np.array([s for s in found_at if s and whole_text[s] in white and whole_text[s - 1] not in white] + [len(whole_text)])
        cuts = [0]
        while cuts[-1] < len(whole_text):  # the last such start within a chunk's length, or one unit that is longer
            i = int(np.searchsorted(at, cuts[-1] + chunk, side="right")) - 1
            cuts.append(int(at[i]) if i >= 0 and at[i] > cuts[-1] else int(at[i + 1]))
        pieces = [whole_text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame({"key": key, "piece": range(len(pieces)), "text": pieces})

    def encode_piece(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(ranks_path, pattern)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "piece": pdf["piece"], "ids": [known.encode(t) for t in pdf["text"]]})
        known.trim()

    def concatenate(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(pdf.sort_values("piece")["ids"])
        out = pd.DataFrame([_digests(ids, encoder(ranks_path, pattern), keep_ids)], columns=OUT)
        return out.assign(key=pdf["key"].iloc[0])

    long = rows.filter(F.length("text") > chunk).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    texts = long.select("key", "text").distinct()
    spread = texts.sparkSession.sparkContext.defaultParallelism * 4
    found = (
        texts.mapInPandas(cut, "key string, begin long, part string")
        .repartition(spread, "key", "begin")
        .mapInPandas(pretokenise, "key string, begin long, end long, found binary")
    )
    pieces = texts.groupBy("key").cogroup(found.groupBy("key")).applyInPandas(join_up, "key string, piece int, text string")
    encoded = pieces.repartition(spread, "key", "piece").mapInPandas(encode_piece, "key string, piece int, ids binary")
    done = encoded.groupBy("key").applyInPandas(concatenate, f"{OUT_SCHEMA}, key string")
    columns = ["doc_id", *OUT]
    return short.select(columns).unionByName(long.select("doc_id", "key").join(done, "key").select(columns))
