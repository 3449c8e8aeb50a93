"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Written tables: path to session.
_made: dict[str, SparkSession] = {}
#: Seconds between two requests that Spark forget what is no longer referred to.
TIDY = 3.0
_tidied = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A folder of our own only where that is unset and all runs on this machine, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    if time.monotonic() - _tidied[0] > TIDY:
        # Spark deletes shuffle files once the driver has collected what refers to them, which it may not do for half an hour.
        spark.sparkContext._jvm.System.gc()
        _tidied[0] = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """`df` stored, unless it is a stored table already: for what several branches of a report read."""
    return df if hasattr(df, "_stored_at") else stored(df, name)


def released(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave, when nothing that is still to run reads them."""
    for t in tables:
        if (path := getattr(t, "_stored_at", None)) in _made:
            _delete(_made.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def remove_stored() -> None:
    """Deletes what stored() has written."""
    while _made:
        path, spark = _made.popitem()
        try:
            _delete(spark, path)
        except Exception:  # that session has ended, or the folder is out of reach; the others may still go
            continue
