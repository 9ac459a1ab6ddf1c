"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "tidewatch", master: str | None = None, **conf) -> SparkSession:
    """Session with UTC timestamps and adaptive execution.

    Shuffle partition counts are left to the cluster and to adaptive coalescing unless
    passed in ``conf``; keys use ``__`` for dots (``spark__sql__shuffle__partitions=8``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _LOCAL_ROOTS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tidewatch-"))


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/tidewatch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage. Frames that read it end here."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has written to the shared folder."""
    remove_path(spark, _scratch_root(spark))


@contextmanager
def scratch_group(spark: SparkSession, label: str) -> Iterator[str]:
    """A label under which frames are written together; they are removed at the end, with their shuffles."""
    name, cleanup = f"{label}-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        yield f"{name}/part"
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
        remove_path(spark, f"{_scratch_root(spark)}/{name}")


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Survives executor loss, stops plans from growing in loops, and gives the next join
    true file sizes to choose its strategy from.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
