"""Interval algebra over ranges (keys..., lo, end), half open, any orderable type.

Ranges go in two levels, so that one category of any size is spread over tasks: ranges are cut at the borders of
buckets and merged per (keys, bucket); then only the ranges that touch a bucket's border are merged again per keys, at most two a
bucket.  An IPv4 bucket has 2**16 addresses; an IPv6 bucket is what shares the first 20 bits, so blocks of one such
prefix are still one task's sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixloom.functions import cidr

BUCKET_BITS = 16
#: Hexadecimal digits of a 17-byte bound that name its IPv6 bucket: two of the byte that makes 2**128 fit, five of the address.
BUCKET_DIGITS = 7


def ranges4(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Masked ranges of the valid IPv4 entries (fam, pfx, ip)."""
    valid = entries.filter((F.col("fam") == 4) & (F.col("pfx") <= 32))
    num, pfx = cidr.v4_num(F.col("ip")), F.col("pfx")
    return valid.select(*keys, cidr.v4_lo(num, pfx).alias("lo"), cidr.v4_end(num, pfx).alias("end"))


def ranges6(entries: DataFrame, keys: list[str]) -> DataFrame:
    valid = entries.filter((F.col("fam") == 6) & (F.col("pfx") <= 128))
    return valid.select(*keys, cidr.v6_range("ip", "pfx").alias("r")).select(*keys, "r.lo", "r.end")


def islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merge overlapping and touching ranges within keys by one sort: a range that starts beyond all before it opens an island."""
    first = df.groupBy(*keys, "lo").agg(F.max("end").alias("end"))
    order = Window.partitionBy(*keys).orderBy("lo")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = first.withColumn("__start", F.when(reach.isNull() | (F.col("lo") > reach), F.col("lo")))
    running = F.last("__start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("__lo", running).groupBy(*keys, F.col("__lo")).agg(F.max("end").alias("end")).select(*keys, F.col("__lo").alias("lo"), "end")


def clipped(df: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """IPv4 ranges cut at bucket borders, with their bucket."""
    size = F.lit(1 << bits).cast("long")
    spread = df.filter("lo < end").withColumn("__b", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright(F.col("end") - 1, bits))))
    lo, end = F.greatest("lo", F.col("__b") * size), F.least("end", (F.col("__b") + 1) * size)
    return spread.withColumn("__lo", lo).withColumn("end", end).drop("lo").withColumnRenamed("__lo", "lo")


def _bucket6(bound: str) -> Column:
    return F.conv(F.substring(F.hex(bound), 1, BUCKET_DIGITS), 16, 10).cast("long")


def _on_border6(bound: str) -> Column:
    return F.substring(F.hex(bound), BUCKET_DIGITS + 1, 34) == "0" * (34 - BUCKET_DIGITS)


def clipped6(df: DataFrame) -> DataFrame:
    """IPv6 ranges cut at bucket borders, with their bucket."""
    last = _bucket6("end") - F.when(_on_border6("end"), 1).otherwise(0)
    spread = df.filter("lo < end").withColumn("__b", F.explode(F.sequence(_bucket6("lo"), last)))
    border = lambda b: F.unhex(F.rpad(F.lpad(F.hex(b), BUCKET_DIGITS, "0"), 34, "0"))
    lo, end = F.greatest("lo", border(F.col("__b"))), F.least("end", border(F.col("__b") + 1))
    return spread.withColumn("__lo", lo).withColumn("end", end).drop("lo").withColumnRenamed("__lo", "lo")


def _stitch(merged: DataFrame, keys: list[str], v4: bool = True, bits: int = BUCKET_BITS) -> DataFrame:
    """Second level: ranges that touch a bucket's border, at most two a bucket, are merged across buckets."""
    low = (1 << bits) - 1
    touches = ((F.col("lo").bitwiseAND(low) == 0) | (F.col("end").bitwiseAND(low) == 0)) if v4 else _on_border6("lo") | _on_border6("end")
    edge = islands(merged.filter(touches).select(*keys, "lo", "end"), keys)
    return merged.filter(~touches).select(*keys, "lo", "end").unionByName(edge)


def merge_ranges(df: DataFrame, keys: list[str], v4: bool = True) -> DataFrame:
    """Sorted, disjoint, non-touching ranges per keys."""
    return _stitch(islands(clipped(df) if v4 else clipped6(df), [*keys, "__b"]), keys, v4)


def sweep(a: DataFrame, b: DataFrame, keys: list[str], v4: bool = True) -> DataFrame:
    """Segments (keys, side, lo, end) with side onlyA, onlyB or common, merged again per side."""
    both = a.select(*keys, "lo", "end", F.lit(1).alias("__a"), F.lit(0).alias("__z")).unionByName(
        b.select(*keys, "lo", "end", F.lit(0).alias("__a"), F.lit(1).alias("__z"))
    )
    within = [*keys, "__b"]
    both = clipped(both) if v4 else clipped6(both)
    events = both.select(*within, F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("__a").alias("a"), F.col("__z").alias("b")), F.struct(F.col("end").alias("x"), (-F.col("__a")).alias("a"), (-F.col("__z")).alias("b")))).alias("e"))
    points = events.groupBy(*within, F.col("e.x").alias("x")).agg(F.sum("e.a").alias("a"), F.sum("e.b").alias("b"))
    order = Window.partitionBy(*within).orderBy("x")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    level = points.select(*within, F.col("x").alias("lo"), F.lead("x").over(order).alias("end"), F.sum("a").over(so_far).alias("a"), F.sum("b").over(so_far).alias("b"))
    side = F.when((F.col("a") > 0) & (F.col("b") > 0), "common").when(F.col("a") > 0, "onlyA").when(F.col("b") > 0, "onlyB")
    segments = level.withColumn("side", side).filter("side is not null and end is not null")
    return _stitch(islands(segments.select(*within, "side", "lo", "end"), [*within, "side"]), [*keys, "side"], v4)


def subtract(a: DataFrame, b: DataFrame, keys: list[str], v4: bool = True) -> DataFrame:
    return sweep(a, b, keys, v4).filter("side = 'onlyA'").drop("side")


def intersect(a: DataFrame, b: DataFrame, keys: list[str], v4: bool = True) -> DataFrame:
    return sweep(a, b, keys, v4).filter("side = 'common'").drop("side")


def emit4(df: DataFrame, keys: list[str]) -> DataFrame:
    """Minimal aligned blocks (keys, num, pfx) of merged IPv4 ranges."""
    return df.select(*keys, F.explode(cidr.blocks(F.col("lo"), F.col("end"))).alias("k")).select(*keys, "k.num", "k.pfx")


def emit6(df: DataFrame, keys: list[str]) -> DataFrame:
    """Minimal aligned blocks (keys, ip, pfx) of merged IPv6 ranges."""
    return df.select(*keys, F.explode(cidr.v6_blocks("lo", "end")).alias("k")).select(*keys, "k.ip", "k.pfx")


def address_count(lo: Column, end: Column) -> Column:
    return F.sum(end - lo).cast("long")


def aggregate(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries as minimal blocks: (keys, fam, pfx, ip), IPv4 and IPv6; invalid entries are left out."""
    four = emit4(merge_ranges(ranges4(entries, keys), keys), keys).select(*keys, F.lit(4).cast("byte").alias("fam"), F.col("pfx").cast("short"), cidr.v4_bytes(F.col("num")).alias("ip"))
    six = emit6(merge_ranges(ranges6(entries, keys), keys, v4=False), keys).select(*keys, F.lit(6).cast("byte").alias("fam"), "pfx", "ip")
    return four.unionByName(six)


def covering(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Containment join of IPv4 blocks (num, pfx): every block that contains a query's, by equality on its ancestors at the prefixes
    that blocks have, 33 at most.  Those are the only rows broadcast: what a join of ancestors needs in memory can't be told from
    the size of the files, so it is always sorted, and large keys are split by adaptive execution."""
    lengths = blocks.select(F.col("pfx").cast("int").alias("__p")).filter("__p >= 0").distinct()
    up = queries.join(F.broadcast(lengths), F.col("__p") <= F.col("pfx"))
    up = up.withColumn("__lo", cidr.v4_lo(F.col("num"), F.col("__p")))
    right = blocks.select(cidr.v4_lo(F.col("num"), F.col("pfx")).alias("__lo"), F.col("pfx").cast("int").alias("__p"), F.struct(*blocks.columns).alias("block"))
    return up.join(right.hint("merge"), ["__p", "__lo"]).drop("__p", "__lo")
