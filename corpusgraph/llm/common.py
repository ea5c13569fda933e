"""Things that all operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The bytes that end a word.  ``bytes.split()`` splits at exactly these.
SPACE = r"[\x20\x09-\x0D]+"

_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver runs from its source tree."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: that of spark.checkpoint.dir.

    Where none is set, a folder of our own serves a local master; a cluster has
    no folder that this could be, so that is an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="corpusgraph-")
        sc.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df``, computed once, written to the shared folder and read from there.

    Lost executors then cost only the tasks they ran: nothing upstream of the
    written table is computed again, and its rows keep the values they got."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(*frames: DataFrame) -> None:
    """Delete the tables behind ``frames`` (as ``written`` returned them), which no later plan reads."""
    for df in frames:
        path = _paths.pop(df, None)
        if path:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended; then its cluster owns the folder
        pass


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a worker holds the Python objects of few texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan can reach any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
