"""Operator 8, exact dedup with an extendible-hash index on shared files, in DataFrame operations only.

1. Every row becomes a narrow entry (id, 64-bit key, digest, length, copies) in a table on shared files; texts stay out.  Rows equal in
   all of these are one entry with their number.
2. Entries of equal (key, digest) are pre-aggregated to one chain entry, so a group of copies is one however large it is.
   The directory starts at a global depth for the number of chain entries and doubles while a bucket is overfull: overfull buckets
   split by the next bit of the key, the others keep their local depth, until none holds more than `capacity`.  It is a table on
   shared files of (depth, cell), a row a bucket, and every key has exactly one bucket in it.
3. Owner tasks: chain entries, and the distinct texts of keys that more than one row has (found by a bitmap of bounded size), look up
   their bucket in the directory and are dealt to tasks by bucket, whole buckets to a task.  There, within a bucket, chains of equal
   key and digest meet their texts: a group is what has the same bytes, its size must be the chain's, and two texts of one digest that
   differ in a byte stop the run.  So a group exists only where its bucket's owner found it.
4. Entries take their group from the owners' results; groups with a large share of the rows are few by count and are broadcast.

Null text counts as empty.  Equal texts keep the smallest id (a null id sorts last).  Of rows equal in id and text, one counts as the
row that stays, the others are dropped.  Empty tables give empty results.  Only the two named columns are read, so further columns and
clashing names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, attach, dropped, key_bitmap, maybe_in, text_or_empty, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


def entries(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow entries: doc_id, key, digest (binary), bytes."""
    norm = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_or_empty(text_col)).alias("__norm"))
    return norm.select("doc_id", *_key_columns())


def _key_columns() -> tuple[Column, ...]:
    return (
        F.xxhash64("__norm").alias("key"), F.unhex(F.sha2(F.col("__norm").cast("binary"), 256)).alias("digest"),
        F.octet_length("__norm").cast("long").alias("bytes"),
    )


def _cell(key: Column, depth: int) -> Column:
    """Directory cell: the key's first `depth` bits."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(chains: DataFrame, capacity: int, max_depth: int = 48) -> tuple[DataFrame, list[int]]:
    """(depth, bucket) of every bucket that holds a chain entry, bucket being the first `depth` bits of its keys, and the depths."""
    total = chains.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / capacity)))
    rest, parts, depths = chains.select("key"), [], []
    while True:
        sizes = rest.groupBy(_cell(F.col("key"), depth).alias("bucket")).agg(F.count(F.lit(1)).alias("__n"))
        sizes = written(sizes, f"dedup-directory-{depth}")
        last = depth >= max_depth
        full = sizes.filter(F.lit(last) | (F.col("__n") <= capacity)).select(F.lit(depth).alias("depth"), "bucket")
        parts.append(full)
        depths.append(depth)
        over = sizes.filter(F.col("__n") > capacity).select("bucket")
        if last or over.isEmpty():
            break
        # the directory doubles: only overfull buckets get the new bit
        rest = rest.withColumn("__cell", _cell(F.col("key"), depth)).join(over.withColumnRenamed("bucket", "__cell"), "__cell", "left_semi").select("key")
        depth += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, depths


def located(df: DataFrame, directory: DataFrame, depths: list[int]) -> DataFrame:
    """df (with key) and its bucket and local_depth, by lookup of the key's cell at every depth that the directory has; one is there."""
    cells = F.array(*(F.struct(F.lit(d).alias("depth"), _cell(F.col("key"), d).alias("bucket")) for d in depths))
    asked = df.withColumn("__c", F.explode(cells)).select(*df.columns, F.col("__c.depth").alias("depth"), F.col("__c.bucket").alias("bucket"))
    return asked.join(directory, ["depth", "bucket"]).withColumnRenamed("depth", "local_depth").select(*df.columns, "bucket", "local_depth")


def chained(ent: DataFrame) -> DataFrame:
    copies = F.sum("copies") if "copies" in ent.columns else F.count(F.lit(1))
    return ent.groupBy("key", "digest", "bytes").agg(F.min("doc_id").alias("keep_id"), copies.alias("n"))


def build_index(ent: DataFrame, capacity: int = 16384, max_depth: int = 48) -> DataFrame:
    """Index entries (key, digest, bytes, keep_id, n) with their bucket and its local depth."""
    chains = written(chained(ent), "dedup-chains")
    return located(chains, *build_directory(chains, capacity, max_depth))


def owned_groups(index: DataFrame, texts: DataFrame) -> DataFrame:
    """What the owners of the buckets find: (key, digest, keep_id, group_size, local_depth) of every chain of more than one row.

    index: chain entries with bucket; texts: distinct texts with bucket, their rows and smallest id.  Both are dealt by bucket alone,
    and grouped there without another exchange."""
    deal = ["bucket", "local_depth", "key", "digest"]
    none = F.lit(None)
    entry = index.filter("n > 1").select(*deal, F.col("n").alias("rows"), none.cast("long").alias("size"), none.cast("long").alias("least"), none.cast("string").alias("text"))
    text = texts.select(*deal, none.cast("long").alias("rows"), F.col("group_size").alias("size"), F.col("keep_id").alias("least"), F.col("__norm").alias("text"))
    met = entry.unionByName(text).repartition("bucket").groupBy(*deal).agg(
        F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.min("least").alias("keep_id"), F.min("text").alias("a"), F.max("text").alias("z")
    )
    met = met.filter("rows is not null")  # a bitmap lets a few texts through that have no chain
    clash = F.raise_error(F.lit("texts of one digest differ in their bytes, or a chain lacks its texts")).cast("long")
    sound = (F.col("a") == F.col("z")) & (F.col("size") == F.col("rows"))
    return met.select("key", "digest", "keep_id", F.when(sound, F.col("size")).otherwise(clash).alias("group_size"), "local_depth")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 16384) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    ent = entries(df, id_col, text_col).groupBy("doc_id", "key", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    ent = written(ent, "dedup-entries")
    chains = written(chained(ent), "dedup-chains")
    directory, depths = build_directory(chains, capacity)
    index = written(located(chains, directory, depths), "dedup-index")
    dropped(chains)
    # texts of keys that repeat; copies collapse before the shuffle, so an owner gets a text once
    repeated = key_bitmap(index.filter("n > 1").select("key"), "key")
    norm = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_or_empty(text_col)).alias("__norm"))
    cand = maybe_in(norm.withColumn("__key", F.xxhash64("__norm")), "__key", repeated).drop("__key")
    texts = cand.groupBy("__norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.filter("group_size > 1").select("__norm", "keep_id", "group_size", *_key_columns())
    groups = written(owned_groups(index, located(texts, directory, depths)), "dedup-groups")
    rows = ent.agg(F.sum("copies")).first()[0] or 0
    found = attach(ent, groups.select("key", "digest", "keep_id", "group_size"), ["key", "digest"], "group_size", rows, keep_weight=True)
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = found.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), "digest", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"))
    return out.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
