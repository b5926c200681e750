"""Tables in the folder that driver and executors share: they end a lineage and outlive a lost executor."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets a temporary one, removed at exit; on a
    cluster, where each machine would write to its own disk, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="nodeloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/nodeloom-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder, read again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nodeloom_path = path
    return out


def forgotten(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` made and nothing reads any more; what reads one all the same fails, its files being gone.
    Frames that are no such tables, and None, are left alone."""
    for t in tables:
        path = None if t is None else vars(t).get("_nodeloom_path")
        if path:
            t.sparkSession.createDataFrame([], t.schema).coalesce(1).write.mode("overwrite").parquet(path)
