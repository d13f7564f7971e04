"""Operator 1, sharding by jump consistent hashing (Lamping and Veach, 2014), in column expressions only.

The hash needs no ring table: a key's shard follows from the key and the number of shards, and with one more
shard a row either stays or moves into the new one, which takes 1/(n+1) of the rows.

Nulls and odd input: a null id counts as 0; a null text has no bytes (size 16, crc 0); repeated ids share a
shard and get different slots in order of (id, crc, size); an empty table gives an empty result.  Columns other
than the two named are never read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

# Fixed values of the published algorithm: the multiplier of its 64-bit generator, in a 32-bit high part
# and two 16-bit low parts (Spark's longs must not overflow).
MUL_HIGH, MUL_LOW_1, MUL_LOW_0 = 0x27BB2EE6, 0x87B0, 0xB0FD
TWO_31 = float(1 << 31)


def _jump(state: Column, shards: int) -> Column:
    """One draw: state is (high, low) of the generator, bucket, the bucket before it, and the next candidate."""
    low, high = state["low"], state["high"]
    t0 = low * MUL_LOW_0 + 1
    t1 = low * MUL_LOW_1 + F.shiftright(t0, 16)
    new_low = F.shiftleft(t1.bitwiseAND(0xFFFF), 16).bitwiseOR(t0.bitwiseAND(0xFFFF))
    high_part = high * MUL_LOW_0 + F.shiftleft((high * MUL_LOW_1).bitwiseAND(0xFFFF), 16)
    new_high = (F.shiftright(t1, 16) + (low * MUL_HIGH).bitwiseAND(0xFFFFFFFF) + high_part).bitwiseAND(0xFFFFFFFF)
    # the generator's top 31 bits plus one, as a share of 2**31, stretch the candidate
    reach = (state["next"] + 1).cast("double") * (F.lit(TWO_31) / (F.shiftright(new_high, 1) + 1).cast("double"))
    drawn = F.struct(
        new_high.alias("high"), new_low.alias("low"), state["next"].alias("bucket"), state["bucket"].alias("before"),
        F.least(reach, F.lit(4e18)).cast("long").alias("next"),
    )
    return F.when(state["next"] < shards, drawn).otherwise(state)


def _walk(key: Column, shards: int) -> Column:
    """State after the last draw below `shards`.  Candidates rise by one at least, so `shards` draws suffice;
    later and longer folds are only evaluated for the few rows that the shorter ones leave unfinished."""
    minus = F.lit(-1).cast("long")
    state = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(0xFFFFFFFF).alias("low"),
        minus.alias("bucket"), minus.alias("before"), F.lit(0).cast("long").alias("next"),
    )
    done, length = 0, 8
    while done < shards:
        steps = F.sequence(F.lit(1), F.lit(min(length, shards - done)))
        fold = lambda s, steps=steps: F.aggregate(steps, s, lambda acc, _: _jump(acc, shards))
        state = fold(state) if not done else F.when(state["next"] < shards, fold(state)).otherwise(state)
        done, length = done + length, length * 8
    return state


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key among `shards` shards."""
    if shards < 1:
        raise ValueError("at least one shard")
    return _walk(F.coalesce(key.cast("long"), F.lit(0).cast("long")), shards)["bucket"].cast("int")


def shard_rows(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number a shard's rows from 0 without gaps, in id order, in two levels: narrow rows (no text), equal ones as one with
    their number, are range-partitioned by id and written once; counts per (shard, range) give each range's offset; ranks are
    taken inside (shard, range).  So no task holds a whole shard, ids that repeat are split by the further keys, and equal
    rows, however many, collapse before the shuffle and are told apart again in place.
    """
    text = text_or_empty(text_col)
    narrow = df.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("__copies"))
    state = _walk(F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), shards + 1)
    ranged = (
        narrow.repartitionByRange(F.col("doc_id"), F.col("text_crc32"), F.col("size"))
        .withColumn("__s", state)
        .select(
            "doc_id", "size", "text_crc32", "__copies",
            F.when(F.col("__s.bucket") == shards, F.col("__s.before")).otherwise(F.col("__s.bucket")).cast("int").alias("shard"),
            F.col("__s.bucket").cast("int").alias("grown_shard"), F.spark_partition_id().alias("__range"),
        )
    )
    rows = written(ranged, "sharding")
    counts = rows.groupBy("shard", "__range").agg(F.sum("__copies").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("shard", "__range").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__start", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
        .join(offsets, ["shard", "__range"])
        .withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("__offset") + F.col("__start") + F.col("__copy")).alias("slot"), "grown_shard",
        )
    )
