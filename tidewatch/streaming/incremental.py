"""High-water marks, incremental appends and their Structured Streaming form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewatch.operators.facts import daily_metrics
from tidewatch.session import cut_lineage, remove_path
from tidewatch.sources.versions import Conflict, Store, append, replace_partitions

HISTORY_LENGTH = 100
#: Rows of a batch that one task compares by id.
ROWS_A_TASK = 250_000
STATE_SCHEMA = "entity string, high_water_mark timestamp, records_processed bigint, duration_seconds double, loaded_at timestamp"


# ---- I1, I2, I7: marks and state ---------------------------------------------------
def above_hwm(df: DataFrame, hwm, column: str = "start_time") -> DataFrame:
    """Rows later than the mark; a null mark lets everything through."""
    mark = hwm if isinstance(hwm, Column) else F.lit(hwm)
    return df if hwm is None else df.filter(mark.isNull() | (F.col(column) > mark))


def allow_late(df: DataFrame, hwm, lateness: str, column: str = "start_time", key: str = "event_id", seen: DataFrame | None = None) -> DataFrame:
    """Rows later than the mark minus ``lateness`` (such as ``"2 hours"``), each id once.

    ``seen`` holds ids loaded before; only its rows within the lateness need be given.
    """
    start = F.lit(hwm).cast(df.schema[column].dataType) - F.expr(f"interval {lateness}")
    fresh = df if hwm is None else df.filter(F.col(column).isNull() | (F.col(column) > start))
    fresh = fresh.dropDuplicates([key])
    return fresh if seen is None else fresh.join(seen.select(key), key, "left_anti")


def high_water_mark(df: DataFrame, column: str = "start_time") -> DataFrame:
    """The greatest event time, which is what the next load compares with."""
    return df.agg(F.max(column).alias("high_water_mark"))


class LoadState:
    """Marks and load history as an append-only table; one row per load."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def history(self, n: int = HISTORY_LENGTH) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(self.path).orderBy(F.desc("loaded_at")).limit(n)

    def get_hwm(self, entity: str, default=None):
        if not self._exists():
            return default
        state = self.spark.read.schema(STATE_SCHEMA).parquet(self.path)
        value = state.filter(F.col("entity") == entity).agg(F.max("high_water_mark").alias("m")).first()["m"]
        return default if value is None else value

    def record_load(self, entity: str, hwm, records: int, seconds: float) -> None:
        row = self.spark.createDataFrame([(entity, hwm, records, float(seconds))], "entity string, high_water_mark timestamp, records_processed bigint, duration_seconds double")
        row.withColumn("loaded_at", F.current_timestamp()).select(*[c.split()[0] for c in STATE_SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(self.path)


# ---- I3: facts ---------------------------------------------------------------------
def in_days(days: list, column: str = "activity_date") -> Column:
    """Rows of the listed days, null among them: a literal filter that prunes partitions."""
    known = [d for d in days if d is not None]
    hit = F.col(column).isin(known) if known else F.lit(False)
    return F.coalesce(hit, F.lit(False)) | F.col(column).isNull() if len(known) < len(days) else hit


def days_of(df: DataFrame, column: str = "activity_date") -> list:
    """The distinct days of a load; a calendar's worth at most."""
    return [r[0] for r in df.select(column).distinct().collect()]


def new_facts(new: DataFrame, existing: DataFrame, key: str = "event_id") -> DataFrame:
    """Facts whose event is not loaded yet, each once. Only the partitions of their days are read."""
    return _unseen(new, existing, key)[0]


def _unseen(new: DataFrame, existing: DataFrame, key: str = "event_id") -> tuple[DataFrame, int]:
    """The rows of :func:`new_facts` and the number of their ids.

    Ids are counted and compared alone. Rows only meet them where some of the load's ids go and others stay, and only rows
    whose id repeats are compared with each other. A null id matches none that is loaded.
    """
    near = existing.filter(in_days(days_of(new))).select(key)
    counted = new.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    fresh = cut_lineage(counted.join(near, key, "left_anti"), "fresh-ids")
    sums = fresh.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0)), F.count_if(F.col(key).isNull()), F.count_if(F.col(key).isNotNull() & (F.col("_n") > 1)))
    ids, rows, unnamed, repeated = sums.first()
    if not ids:
        return new.join(near, key, "left_anti"), 0
    if ids == rows == new.count():
        return new, ids
    hit = new.join(fresh, key)
    found = hit.where("_n = 1")
    if repeated:
        found = found.unionByName(hit.where("_n > 1").dropDuplicates([key]))
    found = found.select(*new.columns)
    return (found.unionByName(new.where(F.col(key).isNull()).limit(1)) if unnamed else found), ids


def recompute_daily(facts: DataFrame, daily: DataFrame, touched: DataFrame) -> DataFrame:
    """The daily aggregate with only the touched days computed again. ``touched`` has date_sk."""
    days = touched.select("date_sk").distinct()
    return daily.join(days, "date_sk", "left_anti").unionByName(daily_metrics(facts.join(days, "date_sk", "left_semi")))


def append_facts(spark: SparkSession, new: DataFrame, fact_path: str, daily_path: str) -> None:
    """Append unseen facts and compute the daily aggregate of the load's days again.

    Facts are partitioned by ``activity_date``, the aggregate by ``date_sk``; only the load's days are
    read and replaced. Whatever a stopped run has left, running it again with the same rows completes
    it: facts that are there are not added, and the days are computed from the stored facts.
    """
    staged = _stage(new)
    touched = in_days(days_of(staged))
    existing = spark.read.schema(new.schema).parquet(fact_path)
    new_facts(staged, existing).write.mode("append").partitionBy("activity_date").parquet(fact_path)
    replace_daily(spark, spark.read.schema(new.schema).parquet(fact_path).filter(touched), daily_path)


def load_facts(store: Store, new: DataFrame, tries: int = 3) -> int:
    """Add unseen facts to a store and compute their days again, as one new state of ``facts`` and ``daily``.

    Readers see the facts and the daily rows of a load together. A stopped load leaves the state as it was; one that
    another load has overtaken starts again from the newer state. Only the partitions of the load's days are read.
    """
    staged = _stage(new)
    days = days_of(staged)
    for left in reversed(range(tries)):
        base = store.snapshot()
        facts = store.read("facts", base["version"], like=staged)
        fresh, ids = _unseen(staged, facts)
        fresh = (fresh if fresh is staged else _stage(fresh)) if ids else staged.limit(0)
        touched = fresh.unionByName(facts.filter(in_days(days)))
        daily = daily_metrics(touched)
        keys = [r[0] for r in touched.select("date_sk").filter("date_sk is not null").distinct().collect()]
        try:
            return store.publish({"facts": append(fresh, "activity_date"), "daily": replace_partitions(daily, "date_sk", keys)}, base)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def replace_daily(spark: SparkSession, facts: DataFrame, daily_path: str) -> None:
    """Replace the partitions of the aggregate for the days that ``facts`` holds completely."""
    daily_metrics(facts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_sk").parquet(daily_path)


def _stage(df: DataFrame) -> DataFrame:
    return cut_lineage(df, "facts")


# ---- I4, I5 ------------------------------------------------------------------------
def new_jobs(jobs: DataFrame, last_end, column: str = "job_end_time") -> DataFrame:
    """Jobs that ended after the last one seen; jobs without a readable end are kept."""
    return jobs if last_end is None else jobs.filter(F.col(column).isNull() | (F.col(column) > F.lit(last_end).cast(jobs.schema[column].dataType)))


def pending_days(days: DataFrame, done: DataFrame, column: str = "date") -> DataFrame:
    return days.select(column).distinct().join(done.select(column).distinct(), column, "left_anti")


# ---- I6: windows -------------------------------------------------------------------
def hourly_window(df: DataFrame, ts: str = "start_time", width: str = "1 hour") -> DataFrame:
    """Adds ``window_start``; works on batches and streams alike."""
    return df.withColumn("window", F.window(ts, width)).withColumn("window_start", F.col("window.start"))


# ---- streams -----------------------------------------------------------------------
def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def deduplicated(stream: DataFrame, lateness: str = "2 hours", ts: str = "start_time", key: str = "event_id") -> DataFrame:
    """Each event once within the lateness; state older than that is dropped."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, width: str = "1 hour", lateness: str = "2 hours", ts: str = "start_time", by: tuple[str, ...] = ("activity_type",)) -> DataFrame:
    """Activity and failure counts per window in the stream's state, which drops rows later than ``lateness``.

    :class:`WindowCounts` keeps them.
    """
    from tidewatch.functions.labels import is_failed

    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width), *by)
        .agg(F.count(F.lit(1)).alias("activities"), F.count_if(is_failed()).alias("failures"))
        .select(F.col("window.start").alias("window_start"), *by, "activities", "failures")
    )


def window_partials(batch: DataFrame, width: str = "1 hour", ts: str = "start_time", by: tuple[str, ...] = ("activity_type",)) -> DataFrame:
    """Counts of a batch's own rows per window: sums that any number of batches can be folded from."""
    from tidewatch.functions.labels import is_failed

    counted = batch.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("activities"), F.count_if(is_failed()).alias("failures"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "activities", "failures")


class WindowCounts:
    """Windowed counts of a stream, kept as partial sums per batch and folded on reading.

    There is no watermark and no state, so a row counts in its window however late it comes. A batch that runs twice
    replaces its own sums. ``compact`` folds old batches into one file; readers take the newest complete fold and the
    batches after it, so stopping anywhere loses and doubles nothing.
    """

    def __init__(self, spark: SparkSession, path: str, width: str = "1 hour", ts: str = "start_time", by: tuple[str, ...] = ("activity_type",)):
        self.spark, self.path, self.width, self.ts, self.by = spark, path.rstrip("/"), width, ts, by

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        window_partials(batch, self.width, self.ts, self.by).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return run_available(stream, self.sink, checkpoint)

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        """Numbers of the folders that were written to their end, ascending."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = [p.getName() for p in found if p.getName().startswith(prefix) and fs.exists(p.suffix("/_SUCCESS"))]
        return sorted(int(n.removeprefix(prefix)) for n in done)

    def _parts(self) -> tuple[list[str], int | None]:
        """Folders whose sums make the counts, and the last batch among them."""
        folds, batches = self._numbers("folds", "upto="), self._numbers("batches", "batch=")
        at = folds[-1] if folds else -1
        later = [b for b in batches if b > at]
        parts = [f"{self.path}/folds/upto={at}"] * bool(folds) + [f"{self.path}/batches/batch={b}" for b in later]
        return parts, (later[-1] if later else at) if parts else None

    def read(self) -> DataFrame:
        parts, _ = self._parts()
        if not parts:
            raise FileNotFoundError(f"no batch has been counted in {self.path}")
        sums = self.spark.read.parquet(*parts)
        return sums.groupBy("window_start", *self.by).agg(F.sum("activities").alias("activities"), F.sum("failures").alias("failures"))

    def compact(self) -> None:
        """Fold everything into one; what a complete fold holds is removed, also if an earlier run stopped before that."""
        parts, last = self._parts()
        if len(parts) > 1:
            self.read().write.mode("overwrite").parquet(f"{self.path}/folds/upto={last}")
        folds = self._numbers("folds", "upto=")
        held = folds[-1] if folds else -1
        old = [f"folds/upto={n}" for n in folds[:-1]] + [f"batches/batch={n}" for n in self._numbers("batches", "batch=") if n <= held]
        for folder in old:
            remove_path(self.spark, f"{self.path}/{folder}")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has landed, batch by batch, and stop. Progress is kept in
    ``checkpoint``, a shared folder; the sink must accept a repeated batch."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batch_overwriting_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch goes to its own folder, so a batch that runs twice replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def unseen_sink(path: str, to_fact: Callable[[DataFrame], DataFrame], key: str = "event_id") -> Callable[[DataFrame, int], None]:
    """Facts of a batch that no other batch holds, in the batch's own folder.

    Rows are compared with the stored ones of their days, so nothing is late: there is no watermark and
    no state. A batch that runs twice leaves itself out of the comparison and replaces its folder. A batch is
    dealt to as many tasks as its rows need, since a stream's plan keeps its number of partitions.
    """
    sink = batch_overwriting_sink(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        dealt = to_fact(batch).repartition(batch.count() // ROWS_A_TASK + 1, key)
        facts = _stage(dealt.dropDuplicates([key]))
        if batch_id:
            stored = batch.sparkSession.read.option("basePath", path).schema(f"{key} string, activity_date date, batch_id int").parquet(path)
            near = stored.filter((F.col("batch_id") != batch_id) & in_days(days_of(facts))).select(key)
            facts = facts.join(near, key, "left_anti")
        sink(facts, batch_id)

    return write


def stream_facts(spark: SparkSession, path: str, schema, to_fact: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, lateness: str | None = None, files_per_trigger: int | None = None) -> StreamingQuery:
    """Landed activities to facts as a stream that stops when it has caught up.

    Each event is stored once, however late it comes. With ``lateness`` duplicates are found in the
    stream's state instead, which drops rows that are later than that.
    """
    events = read_stream(spark, path, schema, files_per_trigger)
    if lateness is None:
        return run_available(events, unseen_sink(out, to_fact), checkpoint)
    sink = batch_overwriting_sink(out)
    return run_available(deduplicated(events, lateness), lambda batch, i: sink(to_fact(batch), i), checkpoint)
