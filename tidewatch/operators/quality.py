"""Data quality checks, each one aggregate over one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.operators.ranking import grand_total


def _share(c) -> object:
    return F.avg(c.isNotNull().cast("int"))


def pre_merge_checks(acts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Duplicate ids, missing starts, ends before starts, and join-key coverage."""
    ids = acts.filter("activity_id is not null").groupBy("activity_id").agg(F.count(F.lit(1)).alias("n"))
    duplicates = F.coalesce(grand_total(ids, F.sum(F.col("n") - 1)), F.lit(0))
    return acts.agg(
        F.count(F.lit(1)).alias("activities"),
        F.count_if(F.col("start_time").isNull()).alias("null_starts"),
        F.count_if(F.col("end_time") < F.col("start_time")).alias("ends_before_start"),
        _share(F.col("item_id")).alias("activity_key_coverage"),
    ).withColumns({"duplicate_ids": duplicates, "job_key_coverage": grand_total(jobs, _share(F.col("item_id")))})


def post_merge_checks(merged: DataFrame) -> DataFrame:
    return merged.agg(
        _share(F.col("job_instance_id")).alias("match_rate"),
        _share(F.col("error_message")).alias("error_coverage"),
        _share(F.col("duration_seconds")).alias("duration_coverage"),
    )


def column_checks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per required column: present, and how many rows are null or empty."""
    present = [c for c in cols if c in df.columns]
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(empty(c)).alias(c) for c in present])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(c in present).alias("present"),
                (F.col(c) if c in present else F.lit(None).cast("bigint")).alias("empty_rows"),
                (F.try_divide(F.col(c), F.col("_n")) * 100 if c in present else F.lit(None).cast("double")).alias("empty_percent"),
            )
            for c in cols
        ]
    )
    return wide.select(F.inline(rows))


def coverage(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of rows with a value, per column."""
    cols = list(cols or df.columns)
    wide = df.agg(*[_share(F.col(c)).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "coverage")


def check_config(df: DataFrame, schema: StructType, required: Sequence[str] = ()) -> DataFrame:
    """Configuration problems as data: one row per missing column, wrong type, or required
    column with nulls. Empty when all is well."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    static = [(f.name, "missing column") for f in schema.fields if f.name not in actual]
    static += [
        (f.name, f"expected {f.dataType.simpleString()}, got {actual[f.name].simpleString()}")
        for f in schema.fields
        if f.name in actual and actual[f.name] != f.dataType
    ]
    names = [c for c in required if c in actual]
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"), F.lit(None).cast("bigint").alias("rows")) for c, p in static],
        *[F.struct(F.lit(c).alias("column"), F.lit("null in required column").alias("problem"), F.col(f"_{c}").alias("rows")) for c in names],
    )
    if not static and not names:
        rows = F.array().cast("array<struct<column:string,problem:string,rows:bigint>>")
    nulls = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in names])
    return nulls.select(F.inline(rows)).filter("rows is null or rows > 0")
