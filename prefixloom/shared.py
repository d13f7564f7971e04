"""The folder that the driver and all executors see, and tables stored in it to cut a plan."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir, or None where it is unset."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = getattr(spark, "sparkContext", None)
    conf = conf or (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() if sc is not None else None)
    return conf.rstrip("/") if conf else None


def stored(df: DataFrame, name: str) -> DataFrame | None:
    """df written to the shared folder and read back, so that what is built on it doesn't repeat its plan and a lost executor costs no
    more than a read; None where there is no shared folder.  Such tables are deleted when the program ends."""
    spark, base = df.sparkSession, shared_dir(df.sparkSession)
    if base is None:
        return None
    path = f"{base}/prefixloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _forget() -> None:
    from pyarrow import fs

    for path in _made:
        try:
            store, at = fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else f"file://{path}")
            store.delete_dir(at)
        except (OSError, ValueError):  # gone already, or in a store that only Spark reaches
            continue
