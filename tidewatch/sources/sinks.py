"""Sinks: snapshots, tables, reports, graph upserts, exports and retention."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.basics import coerce_keys, safe_timestamp
from tidewatch.operators.graph.model import Graph


#: Rows of a snapshot's file.
FILE_ROWS = 1_000_000


def write_snapshot(activities: DataFrame, path: str, stamp: str, workspaces: DataFrame | None = None, items: DataFrame | None = None) -> dict[str, str]:
    """Activities by day, plus the workspace and item lists, as one stamped snapshot.

    Text times are parsed, bad ones become null. Rows are clustered by day before writing. Days are counted first,
    and a day is as many tasks as its rows fill files of ``FILE_ROWS``, so a heavy day is spread and files stay few.
    """
    times = {c: safe_timestamp(c) for c in ("start_time", "end_time", "creation_time") if dict(activities.dtypes).get(c) == "string"}
    df = activities.withColumns(times) if times else activities
    out = {"activities": f"{path}/activities_{stamp}"}
    dated = df.withColumn("date", F.to_date("start_time"))
    # One row per day of the log.
    sizes = dated.groupBy(F.col("date").alias("_day")).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"))
    dealt = dated.join(F.broadcast(sizes), F.col("date").eqNullSafe(F.col("_day"))).withColumn("_file", F.pmod(F.xxhash64("event_id"), F.col("_files")))
    dealt.repartition("date", "_file").drop("_day", "_files", "_file").write.mode("overwrite").partitionBy("date").parquet(out["activities"])
    for name, frame in (("workspaces", workspaces), ("items", items)):
        if frame is not None:
            out[name] = f"{path}/{name}_{stamp}"
            frame.write.mode("overwrite").parquet(out[name])
    return out


def save_table(df: DataFrame, path: str, name: str, partition: str | None = None, mode: str = "overwrite") -> str:
    """Write with every ``*_sk`` column as a nullable bigint."""
    writer = coerce_keys(df).write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/{name}")
    return f"{path}/{name}"


def publish(spark: SparkSession, tables: dict[str, DataFrame], source: str = "parquet", database: str | None = None) -> list[str]:
    """Register frames as catalog tables, replacing older ones."""
    names = []
    for name, df in tables.items():
        full = f"{database}.{name}" if database else name
        df.write.mode("overwrite").format(source).saveAsTable(full)
        names.append(full)
    return names


def publish_folder(spark: SparkSession, path: str, names: Sequence[str], source: str = "parquet") -> list[str]:
    return publish(spark, {n: spark.read.parquet(f"{path}/{n}") for n in names}, source)


def write_reports(reports: dict[str, DataFrame], path: str) -> dict[str, str]:
    """CSV with a header per report; an empty report keeps its header."""
    for name, df in reports.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in reports}


def write_run_summary(df: DataFrame, days: int, path: str) -> str:
    from tidewatch.operators.reports import run_summary

    run_summary(df, days).write.mode("overwrite").json(path)
    return path


def merge_nodes(existing: DataFrame, new: DataFrame, key: str = "id", on_match: Sequence[str] | str = "all") -> DataFrame:
    """Upsert by key. ``on_match`` lists the columns that a match overwrites: ``"all"``, or
    none of them for nodes that are only set when created."""
    cols = [c for c in existing.columns if c != key]
    fresh = new.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_new"))
    joined = existing.withColumn("_old", F.lit(True)).join(fresh, key, "full")
    overwrite = set(cols if on_match == "all" else on_match)
    value = lambda c: F.when(F.col("_old").isNull() | (F.col("_new").isNotNull() & F.lit(c in overwrite)), F.col(f"_n_{c}")).otherwise(F.col(c))
    return joined.select(key, *[value(c).alias(c) for c in cols])


def merge_edges(existing: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Add edges that are not there yet; with ``nodes`` only between known nodes."""
    fresh = new.dropDuplicates(["src", "dst", "rel"])
    if nodes is not None:
        ids = nodes.select("id")
        fresh = fresh.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    added = fresh.join(existing.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti")
    return existing.unionByName(added, allowMissingColumns=True)


def export_graph(g: Graph, path: str) -> str:
    """Nodes and edges as JSON lines, told apart by a ``kind`` field."""
    pack = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value"))
    pack(g.nodes, "node").unionByName(pack(g.edges, "edge")).write.mode("overwrite").text(path)
    return path


def export_jobs(jobs: DataFrame, path: str) -> dict[str, str]:
    """All jobs and the failed ones as CSV; nested columns as JSON text."""
    flat = jobs.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in jobs.dtypes])
    return write_reports({"jobs_all": flat, "jobs_failed": flat.filter(F.col("job_status") == "Failed")}, path)


def retained(df: DataFrame, as_of, days: int = K.RETENTION_DAYS, column: str = "date") -> DataFrame:
    """Rows not older than ``days``; rows without a date stay."""
    return df.filter(F.col(column).isNull() | (F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days)))


def apply_retention(spark: SparkSession, path: str, days: int = K.RETENTION_DAYS, as_of=None, column: str = "date") -> None:
    """Drop the day partitions of a table that are older than ``days``; no row is read or written."""
    today = datetime.date.fromisoformat(str(as_of)) if as_of else datetime.datetime.now(datetime.timezone.utc).date()
    keep_from = (today - datetime.timedelta(days=days)).isoformat()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in fs.listStatus(root):
        day = entry.getPath().getName().removeprefix(f"{column}=")
        if entry.isDirectory() and re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) and day < keep_from:
            fs.delete(entry.getPath(), True)
