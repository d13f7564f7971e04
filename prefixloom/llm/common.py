"""Helpers shared by the training-data operators: the shared folder, written tables, bounded bitmaps."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white-space class and the word pattern that the contracts name.
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Pages of Spark's bitmap_construct_agg hold so many bits.
PAGE_BITS = 32768


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir.

    Only where that setting is unset (tests on one machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    base = base or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="prefixloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/prefixloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more.  Where there is no JVM at hand, they stay."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_written_to", None)
        if path and getattr(spark, "_jvm", None) is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now; by itself it waits for the driver's garbage
    collection, which a small driver heap may put off for half an hour."""
    gc.collect()
    if getattr(spark, "_jvm", None) is not None:
        spark._jvm.System.gc()


def heaps_collected(spark: SparkSession) -> None:
    """Collect the executors' garbage now, two tasks a core so that none is left out: Java gives the system back what a step needed of its heap and of generated
    classes only then, and the next step would add its own to it."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc') AS done").collect()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, steps that run send so many rows to Python at once: whole texts by the ten thousand are tens of megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def idle_memory() -> None:
    """Give a Python worker's freed memory back to the system: a reused worker otherwise holds on to what earlier stages needed."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_or_empty(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def key_bitmap(keys: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """Bitmap of the cells (key mod 2**bits) that hold one of the keys: at most 2**bits / 8 bytes, whatever the data.

    Returns (page, bitmap).  A clear bit proves that a key is absent; a set bit proves nothing.  A page is an array of 64-bit words: Spark
    reads an array where it lies, but copies a whole binary value for every row that looks into it.
    """
    cell = F.pmod(F.col(key), F.lit(1 << bits))
    words = F.transform(F.expr("regexp_extract_all(hex(__bytes), '.{16}', 0)"), lambda x: F.conv(x, 16, -10).cast("long"))
    return (
        keys.select((cell / PAGE_BITS).cast("long").alias("__page"), F.pmod(cell, F.lit(PAGE_BITS)).alias("__pos"))
        .groupBy("__page")
        .agg(F.expr("bitmap_construct_agg(__pos)").alias("__bytes"))
        .select("__page", words.alias("__bitmap"))
    )


def maybe_flag(df: DataFrame, key: str, bitmap: DataFrame, bits: int = 24, flag: str = "__maybe") -> DataFrame:
    """df with a boolean: may the key be among the bitmap's?  The broadcast side is bounded by key_bitmap()."""
    cell = F.pmod(F.col(key), F.lit(1 << bits))
    word = F.expr("get(__bitmap, cast(__pos div 64 as int))")
    place = F.expr("cast((7 - __pos div 8 % 8) * 8 + __pos % 8 as int)")  # a word's first byte is its highest
    marked = df.withColumn("__page", (cell / PAGE_BITS).cast("long")).withColumn("__pos", F.pmod(cell, F.lit(PAGE_BITS)))
    marked = marked.join(F.broadcast(bitmap), "__page", "left")
    found = F.when(F.col("__bitmap").isNotNull(), F.getbit(word, place) == 1)
    return marked.withColumn(flag, F.coalesce(found, F.lit(False))).drop("__page", "__pos", "__bitmap")


def maybe_in(df: DataFrame, key: str, bitmap: DataFrame, bits: int = 24) -> DataFrame:
    """Rows of df whose key may be among the bitmap's keys."""
    return maybe_flag(df, key, bitmap, bits).filter("__maybe").drop("__maybe")


# Unicode's White_Space, which is what byte-level tokenizers call white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: White space followed by a space: such a text can't be cut at its spaces alone.
_ODD_SPACE = re.compile(f"[{WHITE}] ")


def units(text: str) -> list[str]:
    """White space plus the characters up to the next white space.  No pre-token of a byte-level pattern goes from
    a character that isn't white space into white space, so the ids of a text are those of its units in order.
    Cutting at single spaces is a faster way to such units for most texts."""
    if _ODD_SPACE.search(text):
        return _UNIT.findall(text)
    head, *rest = text.split(" ")
    return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]


#: Groups with more than this share of the rows are hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1024


def attach(left: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int, keep_weight: bool = False) -> DataFrame:
    """left join of groups (one row per key, `weight` rows of left each) without a hot key in the shuffle.

    Groups with more than total * HOT_SHARE rows number 1 / HOT_SHARE at most, so they are broadcast; all others
    are joined by key.
    """
    most = F.lit(max(1.0, total * HOT_SHARE))
    values = [c for c in groups.columns if c not in keys and (keep_weight or c != weight)]
    hot = groups.filter(F.col(weight) > most).select(*keys, F.struct(*values).alias("__hot"))
    cold = groups.filter(F.col(weight) <= most).select(*keys, F.struct(*values).alias("__cold"))
    marked = left.join(F.broadcast(hot), keys, "left")
    done = marked.filter(F.col("__hot").isNotNull()).select(*left.columns, *(F.col(f"__hot.{v}").alias(v) for v in values))
    rest = marked.filter(F.col("__hot").isNull()).select(*left.columns).join(cold, keys, "left")
    return done.unionByName(rest.select(*left.columns, *(F.col(f"__cold.{v}").alias(v) for v in values)))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node.

    Large-star and small-star steps (Kiveris et al., 2014) until nothing changes; every step is a pre-aggregated
    minimum and a join in which hubs are broadcast (attach), and is written to the shared folder.  Only counts reach the driver.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = written(pairs, name)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    before = mark(pairs)
    while before[0]:
        old = pairs
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("__w"))
        large = attach(both.filter("v > u"), least, ["u"], "__w", 2 * before[0])
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__w"))
        small = attach(large, least, ["u"], "__w", before[0])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        pairs = written(small.select("e.u", "e.v").filter("u <> v").distinct(), name)
        dropped(old, large)
        now = mark(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


class Memo(dict):
    """Values of a function of a text, remembered for up to twice `most` short texts; those in use outlive the rest."""

    def __init__(self, make: Callable, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out
