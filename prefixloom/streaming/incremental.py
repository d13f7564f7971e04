"""Entries that arrive as a stream: new ones by key within a watermark, and a file kept optimal batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefixloom.operators import entries, fold
from prefixloom.sources.routedat import _store


def new_entries(stream: DataFrame, kind: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first entry of every category and normalised key within the watermark; state is dropped behind it."""
    keyed = stream.withColumn("__k", entries.key_of(kind)).withWatermark(time, late)
    return keyed.dropDuplicatesWithinWatermark(["cat", "__k"]).drop("__k")


def keep_optimal(stream: DataFrame, kind: str, path: str, checkpoint: str, once: bool = True, keep: int = 2, **how) -> StreamingQuery:
    """Merge every batch behind the newest version under `path` and optimise; versions are folders numbered by batch, so a
    repeated batch writes the same version again and readers never see a half-written one.  The last `keep` versions stay."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            old = spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}")
            # a batch's places come behind all that the version has
            behind = old.groupBy("cat_ord").agg((F.max("ord") + 1).alias("__behind"))
            later = rows.join(behind, "cat_ord", "left").withColumn("ord", F.col("ord") + F.coalesce("__behind", F.lit(0)))
            rows = old.unionByName(later.select(old.columns))
        fold.optimize(rows, kind, **how).select(batch.columns).write.mode("overwrite").parquet(f"{path}/v={number}")
        store, at = _store(path)
        for old_number in _versions(path):
            if old_number <= number - keep:
                store.delete_dir(f"{at}/v={old_number}")

    writer = stream.select(*entries.SLOT, *[c for c in stream.columns if c not in entries.SLOT])
    writer = writer.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _versions(path: str) -> list[int]:
    from pyarrow import fs

    store, at = _store(path)
    return sorted(int(f.base_name[2:]) for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith("v="))


def last_version(spark: SparkSession, path: str) -> int:
    return max(_versions(path))


def current(spark: SparkSession, path: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={batch}")
