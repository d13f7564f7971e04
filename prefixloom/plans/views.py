"""Entry tables derived from the driver's tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.functions import cidr

ATTRS = "array<struct<k:string,b:boolean,i:bigint>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ip4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks from events: one category an event type, file 0 or 1 by the id's parity."""
    num = F.lit(167772160).cast("long") + F.pmod(F.col("user_id") * 7919 + F.col("event_id") * 131, F.lit(65536))
    return table(spark, sf_dir, "events").select(
        F.lit("a").alias("file"), F.lit(0).alias("cat_ord"), F.col("event_type").alias("cat"), F.col("event_id").alias("ord"), F.lit(4).cast("byte").alias("fam"),
        (F.lit(26) + F.col("event_id") % 7).cast("short").alias("pfx"), cidr.v4_bytes(num).alias("ip"), (F.col("event_id") % 2).cast("int").alias("side"),
    )


IP4 = """ip4 AS (SELECT event_type AS cat, event_id AS ord, CAST(26 + event_id % 7 AS INTEGER) AS pfx,
  167772160 + (user_id * 7919 + event_id * 131) % 65536 AS num, CAST(event_id % 2 AS INTEGER) AS side FROM events),
r4 AS (SELECT cat, ord, pfx, num, side, num - num % (1::BIGINT << (32 - pfx)) AS lo,
  num - num % (1::BIGINT << (32 - pfx)) + (1::BIGINT << (32 - pfx)) AS hi FROM ip4)"""


def ip6(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.pmod(F.col("user_id") * 7919 + F.col("event_id") * 131, F.lit(65536))
    text = F.concat(F.lit("20010DB8"), F.lpad(F.hex(F.col("user_id") % 16), 8, "0"), F.lpad(F.hex(low), 16, "0"))
    return table(spark, sf_dir, "events").select(
        F.lit("a").alias("file"), F.lit(0).alias("cat_ord"), F.col("event_type").alias("cat"), F.col("event_id").alias("ord"), F.lit(6).cast("byte").alias("fam"),
        (F.lit(118) + F.col("event_id") % 11).cast("short").alias("pfx"), F.unhex(text).alias("ip"), (F.col("event_id") % 2).cast("int").alias("side"),
    )


IP6 = """r6 AS (SELECT cat, ord, side, u, x - x % (1::BIGINT << (128 - pfx)) AS lo, x - x % (1::BIGINT << (128 - pfx)) + (1::BIGINT << (128 - pfx)) AS hi
  FROM (SELECT event_type AS cat, event_id AS ord, event_id % 2 AS side, user_id % 16 AS u, CAST(118 + event_id % 11 AS INTEGER) AS pfx,
    (user_id * 7919 + event_id * 131) % 65536 AS x FROM events))"""


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from pages: the host by a type that the id gives; every seventh has an attribute."""
    attr = F.array(F.struct(F.lit("ads").alias("k"), F.lit(True).alias("b"), F.lit(None).cast("long").alias("i")))
    return table(spark, sf_dir, "pages").select(
        F.lit("a").alias("file"), (F.col("page_id") % 3).cast("int").alias("cat_ord"), F.concat(F.lit("C"), (F.col("page_id") % 3).cast("string")).alias("cat"),
        F.col("page_id").alias("ord"), (F.col("page_id") % 5).cast("short").alias("type"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("val"),
        F.when(F.col("page_id") % 7 == 0, attr).cast(ATTRS).alias("attrs"),
    )


SITE = """site AS (SELECT CAST(page_id % 3 AS INTEGER) AS cat_ord, 'C' || CAST(page_id % 3 AS VARCHAR) AS cat, page_id AS ord,
  CAST(page_id % 5 AS SMALLINT) AS type, regexp_extract(url, '^https?://([^/]+)', 1) AS val, page_id % 7 = 0 AS has_attr FROM pages)"""


def categories(df: DataFrame, kind: str) -> DataFrame:
    """Categories of a view: reverse for those with an odd number."""
    return df.select("file", F.lit(kind).alias("kind"), "cat_ord", F.col("cat").alias("name"), (F.col("cat_ord") % 2 == 1).alias("reverse")).distinct()


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every sort from events: IPv4 over the whole address space, IPv6, addresses of odd length (fam 0), bad prefixes."""
    e, u = F.col("event_id"), F.col("user_id")
    odd, six, bad = e % 13 == 0, e % 5 == 0, e % 11 == 0
    four = cidr.v4_bytes(F.pmod(u * 28657 + e * 429497, F.lit(1 << 32)))
    part = lambda c: F.lpad(F.hex(c % 65535 + 1), 4, "0")
    long = F.unhex(F.concat(F.lit("20010DB8"), part(u * 7919), F.lpad(F.hex(u % 9 + 1), 4, "0"), F.lit("0" * 12), part(e * 131)))
    pfx = F.when(odd, e % 9).when(bad, 200).when(six, 20 + e % 109).otherwise(14 + e % 19)
    return table(spark, sf_dir, "events").select(
        F.lit("a").alias("file"), F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(1000)).cast("int").alias("cat_ord"), F.col("event_type").alias("cat"), e.alias("ord"),
        F.when(odd, 0).when(six, 6).otherwise(4).cast("byte").alias("fam"), pfx.cast("short").alias("pfx"),
        F.when(odd, F.unhex(F.lpad(F.hex(e % 1000), 6, "0"))).when(six, long).otherwise(four).alias("ip"), (e % 2).cast("int").alias("side"),
    )


MIXED = """mixed0 AS (SELECT event_type AS cat, event_id AS ord, CAST(event_id % 2 AS INTEGER) AS side,
  CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 6 ELSE 4 END AS fam,
  CAST(CASE WHEN event_id % 13 = 0 THEN event_id % 9 WHEN event_id % 11 = 0 THEN 200 WHEN event_id % 5 = 0 THEN 20 + event_id % 109 ELSE 14 + event_id % 19 END AS INTEGER) AS pfx,
  user_id * 7919 % 65535 + 1 AS g3, user_id % 9 + 1 AS g4, event_id * 131 % 65535 + 1 AS g8, event_id % 1000 AS odd, (user_id * 28657 + event_id * 429497) % 4294967296 AS num FROM events),
mixed AS (SELECT *, (fam = 4 AND pfx <= 32) OR (fam = 6 AND pfx <= 128) AS valid, CASE fam WHEN 4 THEN 32 WHEN 6 THEN 128 ELSE 0 END AS bits,
  CASE fam WHEN 0 THEN odd::HUGEINT WHEN 4 THEN num::HUGEINT ELSE (536939960::HUGEINT << 96) + (g3::HUGEINT << 80) + (g4::HUGEINT << 64) + g8 END AS x,
  CASE fam WHEN 0 THEN printf('%06X', odd) WHEN 4 THEN printf('%08X', num) ELSE '20010DB8' || printf('%04X', g3) || printf('%04X', g4) || '000000000000' || printf('%04X', g8) END AS ip FROM mixed0),
sized AS (SELECT *, CASE WHEN valid THEN 1::HUGEINT << (bits - pfx) ELSE 1::HUGEINT END AS size FROM mixed),
rm AS (SELECT cat, ord, side, fam, bits, pfx, x - x % size AS lo, x - x % size + size AS hi FROM sized WHERE valid),
km AS (SELECT cat, ord, side, fam, pfx, ip, valid, x, x - x % size AS net FROM sized)"""
