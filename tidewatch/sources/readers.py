"""Scans of landed files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidewatch import constants as K
from tidewatch.functions.basics import backfill_activity_id, ensure_columns, rename_coalesce, safe_timestamp
from tidewatch.operators.analysis import encode_labels
from tidewatch.sources.landed import file_catalogue, scan_csv

FAILURE_REASON = "struct<message: string, errorCode: string, messageParameters: map<string, string>>"
JOB_JSON = (
    "id string, itemId string, startTimeUtc string, endTimeUtc string, status string, failureReason string, "
    "jobType string, invokeType string, rootActivityId string, invoker string, _itemName string, _itemType string, _workspaceName string"
)


def read_csv_union(spark: SparkSession, glob: str, multi_line: bool | None = None) -> DataFrame:
    """CSV files with differing headers, as strings, matched by column name.

    The first block of each file gives its header; files of one header are one scan, and headers are few, whatever
    the number of files. See :func:`scan_csv` for ``multi_line``.
    """
    files = file_catalogue(spark, glob)
    frames = []
    for r in files.select("header").distinct().orderBy("header").collect():
        frames.append(scan_csv(spark, files.filter(F.col("header") == r["header"]), json.loads(r["header"]), multi_line))
    if not frames:
        raise FileNotFoundError(f"no CSV file with a header matches {glob}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def normalise_activities(raw: DataFrame) -> DataFrame:
    """Landed activity rows to the activity schema: renames, backfills, numbers, times."""
    df = ensure_columns(rename_coalesce(raw))
    time = lambda *names: F.coalesce(*[safe_timestamp(n) for n in names if n in df.columns])
    return backfill_activity_id(df).withColumns(
        {
            "duration_seconds": F.coalesce(F.col("duration_seconds").try_cast("double"), F.lit(0.0)),
            "start_time": time("start_time", "creation_time"),
            "end_time": time("end_time", "completion_time"),
        }
    )


def load_activities(spark: SparkSession, directory: str) -> DataFrame:
    """Daily activity exports of a folder."""
    return normalise_activities(read_csv_union(spark, f"{directory}/daily/fabric_activities_*.csv"))


def standardise_events(df: DataFrame, drop_empty: bool = False, ordered: bool = False) -> DataFrame:
    """Raw events to the export columns, with alternate names, UTC text dates and numbers: a projection.

    ``drop_empty`` removes columns without any value, which takes a pass over the log; ``ordered`` sorts it by time.
    """
    present = set(df.columns)

    def source(name: str):
        for candidate in [name, *K.RAW_EVENT_ALTERNATES.get(name, [])]:
            if candidate in present:
                return F.col(f"`{candidate}`")
        return F.lit(None).cast("string")

    out = df.select(*[source(c).alias(c) for c in K.RAW_EVENT_COLUMNS])
    stamp = lambda c: F.date_format(safe_timestamp(c), "yyyy-MM-dd HH:mm:ss 'UTC'")
    out = out.withColumns({c: stamp(c) for c in ("CreationTime", "StartTime", "EndTime", "_extraction_date")}).withColumns(
        {c: F.col(c).try_cast("double") for c in ("DurationMs", "Duration")}
    )
    if drop_empty:
        counts = out.agg(*[F.count(c).alias(c) for c in out.columns]).first().asDict()
        out = out.select(*[c for c in out.columns if counts[c]])
    return out.orderBy("CreationTime") if ordered and "CreationTime" in out.columns else out


def load_jobs(spark: SparkSession, directory: str, keep_bad: bool = False) -> DataFrame:
    """Job history: JSON array files of a folder (or a glob), one job per element. A file that does
    not parse gives one row with its text in ``_corrupt_record``, which is dropped unless ``keep_bad``."""
    schema = StructType.fromDDL(JOB_JSON + ", _corrupt_record string")
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(directory if "*" in directory else f"{directory}/*.json")
    if keep_bad:
        return raw
    return normalise_jobs(raw.filter("_corrupt_record is null").drop("_corrupt_record"))


def normalise_jobs(raw: DataFrame) -> DataFrame:
    """Friendly names and times; the failure reason becomes a struct (plain text is its message)."""
    renames = {k: v for k, v in K.JOB_RENAMES.items() if k in raw.columns}
    df = raw.withColumnsRenamed(renames)
    reason = F.from_json("job_failure_reason", FAILURE_REASON)
    as_struct = F.when(F.col("job_failure_reason").startswith("{"), reason).when(
        F.col("job_failure_reason").isNotNull(),
        F.struct(F.col("job_failure_reason").alias("message"), F.lit(None).cast("string").alias("errorCode"), F.lit(None).cast("map<string,string>").alias("messageParameters")),
    )
    out = df.withColumns({"job_start_time": safe_timestamp("job_start_time"), "job_end_time": safe_timestamp("job_end_time"), "job_failure_reason": as_struct})
    return out.withColumnRenamed("invoker", "job_invoker") if "invoker" in out.columns else out


def load_snapshot(spark: SparkSession, directory: str, name: str = "activities") -> DataFrame:
    """The newest snapshot of a table: Parquet folders named ``<name>_<stamp>``; where there
    is none, CSV files of that name pattern."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [s.getPath().getName() for s in fs.listStatus(fs_path)]
    hits = sorted(n for n in listed if n.startswith(f"{name}_") and not n.endswith(".csv"))
    if hits:
        return spark.read.parquet(f"{directory}/{hits[-1]}")
    csvs = sorted(n for n in listed if n.startswith(f"{name}_") and n.endswith(".csv"))
    if not csvs:
        raise FileNotFoundError(f"no snapshot of {name} in {directory}")
    return normalise_activities(spark.read.option("header", True).csv(f"{directory}/{csvs[-1]}"))


def load_workspaces(spark: SparkSession, path: str) -> DataFrame:
    """Workspace lookup in either naming, one row per id."""
    from tidewatch.operators.inventory import normalise_workspaces

    return normalise_workspaces(spark.read.parquet(path))


def load_gated_csv(spark: SparkSession, glob: str, cols: Sequence[str], multi_line: bool | None = None) -> DataFrame:
    """Rows of the files whose header is exactly ``cols``; of other files only the first block is read."""
    accepted = file_catalogue(spark, glob).filter(F.col("header") == json.dumps(list(cols)))
    return scan_csv(spark, accepted, cols, multi_line)


def load_lineage(spark: SparkSession, path: str) -> DataFrame:
    """Lineage records from JSON ``{"lineage": [...]}`` or CSV, by suffix, with an order column."""
    from tidewatch.schemas import table_schemas

    schema = table_schemas()["lineage_records"]
    if path.endswith(".csv"):
        text = read_csv_union(spark, path)
        return text.withColumn("seq", F.monotonically_increasing_id())
    wrapped = StructType([StructField("lineage", ArrayType(schema))])
    rows = spark.read.schema(wrapped).option("multiLine", True).json(path)
    # Records keep their order inside a file; files follow each other by name. Their list is sent to the records.
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"))
    places = encode_labels(names, "_file").select("_file", F.shiftleft(F.col("_file_code").cast("bigint"), 31).alias("_first"))
    placed = rows.select(F.col("_metadata.file_path").alias("_file"), F.posexplode("lineage").alias("_pos", "r")).join(F.broadcast(places), "_file")
    return placed.select("r.*", (F.col("_first") + F.col("_pos")).alias("seq"))


def rebuild_reports(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The reports of a stored snapshot, after renames and id backfill."""
    from tidewatch.operators import reports as R

    acts = normalise_activities(spark.read.parquet(path))
    return {
        "activities_master": R.activities_master(acts), "key_measurables": R.measurables_long(acts, K.DEFAULT_PERIOD_DAYS),
        "user_performance": R.user_performance(acts), "domain_performance": R.domain_performance(acts),
        "failure_analysis": R.failure_analysis(acts), "daily_trends": R.daily_trend_report(acts), "compute_analysis": R.compute_analysis(acts),
    }
