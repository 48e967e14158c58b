"""Session-level helpers: table access and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table; raises AnalysisException when the path is missing."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of this machine's where that is unset and Spark runs on this machine only."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"spanloom-{uuid.uuid4().hex}")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor costs a re-read, not a recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> str:
    """Write a table to the shared folder, for tasks that read it themselves, part by part; gives its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: they go with the end of each query and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def open_store(folder: str, missing: bool = False):
    """A folder of the shared store as Python workers read it: (file system, its parquet files in order); missing: one that isn't there has none."""
    from pyarrow import fs

    if folder.startswith("file:"):
        store, path = fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    elif "://" in folder:
        store, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    else:
        store, path = fs.LocalFileSystem(), folder
    return store, sorted(x.path for x in store.get_file_info(fs.FileSelector(path, allow_not_found=missing)) if x.path.endswith(".parquet"))


def u01(*cols) -> "F.Column":
    """A uniform in [0, 1) from the md5 of the joined columns; equal on every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hkey(*cols) -> "F.Column":
    """A pseudo-random sort key (md5 hex) from the joined columns."""
    return F.md5(F.concat_ws("|", *cols))
