"""Operator 3, quality by importance resampling (after Xie et al., 2023): hashed n-gram generative models of target and raw
text, and Gumbel top-k.

Words (lower-cased, cut at white space) and pairs of neighbouring words are hashed to `buckets`.  The target model is counted over all documents
with the target's ids, the raw model over all documents, both with add-one smoothing; counts cover every document and
all of its text.  A document's log weight is the sum over its n-grams of log target minus log raw probability.
Its key is the log weight plus Gumbel noise drawn from its id and text, and the `keep` share of the documents with the largest keys
is a sample without replacement in proportion to the weights.

The k-th largest key is found without a global sort: keys are mapped to integers in the same order, and the
k-th is narrowed down by 16 bits at a time, from counts of at most 65,536 groups.

Null and empty texts have log weight 0.  Rows equal in id and text draw the same noise and are kept or dropped together; all
rows that tie with the k-th are kept.  Without target rows all weights are 0.  An empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_bitmap, maybe_in, text_or_empty, written

MOST_WORDS = 400_000


class Grams:
    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if len(self.known) >= MOST_WORDS:
            self.known.clear()
        out = self.known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out

    def of(self, text: str) -> np.ndarray:
        """Buckets of the text's words and pairs."""
        get, new = self.known.get, self._hash
        w = np.array([get(x) or new(x) for x in text.lower().split()], dtype=np.uint64)
        pairs = (w[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:] + np.uint64(0x632BE59BD9B4E019))
        both = np.concatenate([w, pairs ^ (pairs >> np.uint64(29))])
        return (both % np.uint64(self.buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket over all the texts; a task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                sums += np.bincount(grams.of(text), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    got = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets)
    out[got["bucket"].astype(int)] = got["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.any():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())


def _scores(docs: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # `buckets` doubles

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        grams = Grams(len(own))
        for batch in batches:
            weights, keys, bits = [], [], []
            for doc_id, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column("text").to_pylist(), strict=True):
                weight = float(own[grams.of(text)].sum())
                u = (xxhash.xxh3_64_intdigest(f"{doc_id}/{th}", seed=seed) + 0.5) / 2**64
                key = weight - math.log(-math.log(min(max(u, 1e-300), 1 - 2**-53)))
                (b,) = struct.unpack("<q", struct.pack("<d", key + 0.0))
                weights.append(weight)
                keys.append(key)
                bits.append(b if b >= 0 else -(b & (2**63 - 1)) - 1)
            columns = [batch.column(0), batch.column(1), pa.array(weights, pa.float64()), pa.array(keys, pa.float64()), pa.array(bits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "log_weight", "key", "bits"])

    return docs.select("doc_id", "th", "text").mapInArrow(score, "doc_id long, th long, log_weight double, key double, bits long")


def kth_largest(rows: DataFrame, col: str, k: int) -> int:
    """The k-th largest of a long column, by 16 bits a step."""
    prefix, left = None, k
    for step in range(4):
        shift = 48 - 16 * step
        cell = F.shiftright(col, shift)
        some = rows if prefix is None else rows.filter(F.shiftright(col, shift + 16) == prefix)
        counts = some.groupBy(cell.alias("c")).count().orderBy(F.desc("c")).collect()  # at most 65,536 rows
        for r in counts:
            if left <= r["count"]:
                prefix = r["c"]
                break
            left -= r["count"]
    return prefix


def resample(
    df: DataFrame, target: DataFrame, keep: float, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16384, seed: int = 3
) -> DataFrame:
    """Per row: doc_id, log_weight, gumbel_key, selected.  target: one column of ids; keep: share of the documents."""
    text = text_or_empty(text_col)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    ids = target.select(F.col(target.columns[0]).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    # labelled rows are found by a bitmap of bounded size, so that only texts that may be labelled are shuffled
    may = maybe_in(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("__h")), "__h", key_bitmap(ids.select(F.xxhash64("doc_id").alias("__h")), "__h"))
    labelled = may.join(ids, "doc_id", "left_semi")
    ratio = log_ratio(bucket_counts(labelled, buckets), bucket_counts(docs, buckets))
    scored = written(_scores(docs, ratio, seed), "resampling")
    total = scored.count()
    k = min(total, max(0, round(keep * total)))
    border = kth_largest(scored, "bits", k) if k else None
    chosen = F.col("bits") >= border if k else F.lit(False)
    return scored.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), chosen.alias("selected"))
