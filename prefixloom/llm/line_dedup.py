"""Operator 7, line dedup by winnowing over line hashes (after Schleimer, Wilkerson and Aiken, 2003).

A document is its sequence of lines that hold a word; a line's hash is of its words, so white space doesn't matter.  From every
line on, a gram is the fewest lines that hold `gram_words` words together.  A window is as many neighbouring
lines; the smallest gram hash in a window is a fingerprint (of equals the one chosen before, else the last).  So every repeated run of
2 * gram_words words, and every repeated line of gram_words words, holds a fingerprint.

Fingerprints join on their hash: every later occurrence (in order of document, then line) meets the first one.  A match is
extended both ways, line by line, as far as the two documents agree, and the later run is deleted.  As every fingerprint but
a first one goes with its gram, no run of whole lines with 2 * gram_words words stays twice, and a first occurrence always
stays.  Left as they are: passages of any length that lie inside longer lines or begin or end within one (only their whole
lines can match), and runs of fewer words than gram_words, such as a repeated short line alone, however many documents share it.

A hash with a third of all occurrences meets its first one by broadcast (such hashes are few by count); nothing is gathered by hash.
Matches of one document with one other are gathered before lines are fetched, so the two documents' line hashes travel once a pair of
documents, not once a match, and matches on one diagonal are extended once.  Per document, only its own runs are gathered.

Null texts stay null and empty texts empty.  Rows of one id are told apart by their texts, in order of text hash; rows equal in id
and text are one occurrence and edited alike.  A text that loses all its lines becomes empty.  An empty table gives an
empty result.  All of the table's columns come through; only the text changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import attach, dropped, idle_memory, key_bitmap, maybe_flag, maybe_in, text_or_empty, written


def lines_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All lines, and of those with words: their place, hash and number of words."""
    lines = text.split("\n")
    words = [x.split() for x in lines]
    at = [i for i, w in enumerate(words) if w]
    hashes = np.array([xxhash.xxh3_64_intdigest(" ".join(words[i]).encode("utf-8", "surrogatepass")) for i in at], dtype=np.uint64)
    return lines, np.array(at, dtype=np.int64), hashes, np.array([len(words[i]) for i in at], dtype=np.int64)


def fingerprints(hashes: np.ndarray, words: np.ndarray, gram_words: int) -> list[tuple[int, int, int]]:
    """(gram hash, first line, lines) of the chosen grams, lines counted among those with words."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:n] + gram_words, side="left")  # lines i..ends-1 hold enough words
    full = int(np.searchsorted(ends, n, side="right"))  # grams from here on would run out of lines
    grams = [int(hashes[i]) if ends[i] == i + 1 else xxhash.xxh3_64_intdigest(hashes[i : ends[i]].tobytes()) for i in range(full)]
    chosen: list[int] = []
    for i in range(full):
        window = range(i, min(int(ends[i]), full))
        least = min(grams[j] for j in window)
        if not (chosen and chosen[-1] >= i and grams[chosen[-1]] == least):  # the last choice stands while it is least
            chosen.append(max(j for j in window if grams[j] == least))
    return [(grams[i], i, int(ends[i]) - i) for i in chosen]


def runs(own: np.ndarray, other: np.ndarray, matches: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The runs of own that extended matches (p, q, length) give; a match within a run of its diagonal gives no new one."""
    out, reached = [], {}
    for p, q, length in sorted(matches):
        if p + length > reached.get(p - q, -1):
            a, b = run(own, other, p, q, length)
            out.append((a, b))
            reached[p - q] = b
    return out


def run(own: np.ndarray, other: np.ndarray, p: int, q: int, length: int) -> tuple[int, int]:
    """The match of own[p:p+length] with other[q:q+length], extended both ways."""
    a = 0
    back = min(p, q)
    if back:
        differ = np.flatnonzero(own[p - back : p][::-1] != other[q - back : q][::-1])
        a = int(differ[0]) if len(differ) else back
    ahead = min(len(own) - p, len(other) - q)
    differ = np.flatnonzero(own[p : p + ahead] != other[q : q + ahead])
    b = int(differ[0]) if len(differ) else ahead
    return p - a, p + max(b, min(length, ahead))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = 25, removed_col: str | None = None
) -> DataFrame:
    """df with later repeated runs of lines deleted from the text; removed_col, if given, is added: lines deleted."""
    doc = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("th"))
    texts = df.select(doc.getField("id").alias("id"), doc.getField("th").alias("th"), text_or_empty(text_col).alias("text"))
    texts = texts.filter(F.col("text").rlike(r"\S"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("len", pa.int32())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                hashes, chosen = [], []
                for text in part.column(2).to_pylist():
                    _, _, h, w = lines_of(text)
                    hashes.append(h.tobytes())
                    chosen.append([{"h": g - 2**64 if g >= 2**63 else g, "pos": p, "len": n} for g, p, n in fingerprints(h, w, gram_words)])
                columns = [part.column(0), part.column(1), pa.array(hashes, pa.binary()), pa.array(chosen, grams)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "hashes", "grams"])
        idle_memory()

    gram_type = "array<struct<h:long,pos:int,len:int>>"
    seen = written(texts.mapInArrow(describe, f"id long, th long, hashes binary, grams {gram_type}"), "line-hashes")
    marks = seen.select("id", "th", F.explode("grams").alias("g")).select("g.h", "id", "th", "g.pos", "g.len")
    place_of = F.struct("id", "th", "pos")
    first = marks.groupBy("h").agg(F.min(place_of).alias("f"), F.max(place_of).alias("l"), F.count(F.lit(1)).alias("__w"))
    first = written(first.filter("f <> l").select("h", "f", "__w"), "line-firsts")
    repeated = maybe_in(marks, "h", key_bitmap(first, "h"))
    later = attach(repeated, first, ["h"], "__w", first.agg(F.coalesce(F.sum("__w"), F.lit(0))).first()[0])
    later = later.filter(F.col("f").isNotNull() & (F.struct("id", "th", "pos") != F.col("f")))
    match = F.struct("pos", F.col("f.pos").alias("spos"), "len")
    pairs = later.groupBy("id", "th", F.col("f.id").alias("sid"), F.col("f.th").alias("sth")).agg(F.collect_set(match).alias("matches"))
    pairs = written(pairs, "line-matches")
    dropped(first)
    source = seen.select(F.col("id").alias("sid"), F.col("th").alias("sth"), F.col("hashes").alias("other")).dropDuplicates(["sid", "sth"])
    own = seen.select("id", "th", F.col("hashes").alias("own")).dropDuplicates(["id", "th"])
    asked = pairs.join(source, ["sid", "sth"]).join(own, ["id", "th"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for row in batch.slice(at, 512).to_pylist():
                    mine, theirs = np.frombuffer(row["own"], np.uint64), np.frombuffer(row["other"], np.uint64)
                    for p, q in runs(mine, theirs, [(m["pos"], m["spos"], m["len"]) for m in row["matches"]]):
                        for column, value in zip(out, (row["id"], row["th"], p, q), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "th", "a", "b"])

    found = asked.select("id", "th", "matches", "own", "other").mapInArrow(extend, "id long, th long, a int, b int")
    cuts = found.distinct().groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("__cuts"))
    cuts = written(cuts, "line-cuts")

    # texts without a cut, found by a bitmap of bounded size, aren't shuffled
    keyed = df.withColumn("__id", doc.getField("id")).withColumn("__th", doc.getField("th")).withColumn("__h", F.xxhash64("__id", "__th"))
    flagged = maybe_flag(keyed, "__h", key_bitmap(cuts.select(F.xxhash64("id", "th").alias("__h")), "__h"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != removed_col]
    place = [c for c in df.columns if c != removed_col].index(text_col)
    named = cuts.select(F.col("id").alias("__cid"), F.col("th").alias("__cth"), "__cuts")
    touched = flagged.filter("__maybe").join(named, (F.col("__id") == F.col("__cid")) & (F.col("__th") == F.col("__cth")), "left")
    untouched = flagged.filter("not __maybe").select(*kept)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, cut in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                gone = set()
                if cut:
                    lines, at, _, _ = lines_of(text)
                    gone = {int(at[i]) for c in cut for i in range(c["a"], c["b"])}
                    text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                texts.append(text)
                removed.append(len(gone))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[place] = pa.array(texts, pa.string())
            names = batch.schema.names[:-1]
            if removed_col:
                columns, names = [*columns, pa.array(removed, pa.int64())], [*names, removed_col]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        idle_memory()

    out = StructType(list(untouched.schema.fields))
    if removed_col:
        out, untouched = out.add(removed_col, LongType()), untouched.withColumn(removed_col, F.lit(0).cast("long"))
    return untouched.unionByName(touched.select(*kept, "__cuts").mapInArrow(edit, out))
