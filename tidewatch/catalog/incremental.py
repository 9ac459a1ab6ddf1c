"""Incremental loads, versioned dimensions and streams."""

from functools import reduce

from pyspark.sql import functions as F

from tidewatch.catalog.base import act, fact, query
from tidewatch.catalog.star import DAILYF, FACT_COLS, X
from tidewatch.operators import dimensions as D
from tidewatch.operators import facts as FA
from tidewatch.session import cut_lineage, scratch_path
from tidewatch.sources.adapters import activities as A, jobs as J, table
from tidewatch.sources.versions import Store
from tidewatch.streaming import incremental as I

MID = "2024-01-15 12:00:00"


@query("above_high_water_mark", act(f"SELECT event_id FROM act WHERE start_time > TIMESTAMP '{MID}'"))
def _(s, d):
    return I.above_hwm(A(s, d), F.lit(MID).cast("timestamp_ntz")).select("event_id")


@query("high_water_mark", act("SELECT max(start_time) AS high_water_mark FROM act"))
def _(s, d):
    return I.high_water_mark(A(s, d))


@query("late_arrivals", act(f"SELECT event_id FROM act WHERE start_time > TIMESTAMP '{MID}' - INTERVAL 2 HOURS AND status <> 'Failed'"))
def _(s, d):
    a = A(s, d)
    again = a.unionByName(a.filter("status = 'Completed'"))
    return I.allow_late(again, MID, "2 hours", seen=a.filter("status = 'Failed'")).select("event_id")


@query("new_jobs", "SELECT 'job_'||event_id AS job_instance_id FROM (SELECT *, ts + to_seconds(CAST((event_id*37) % 800 - 400 + event_id % 1000 AS BIGINT)) AS e FROM events WHERE event_type IN ('purchase','error')) WHERE event_id % 7 = 0 OR e > TIMESTAMP '2024-01-15 12:00:00'")
def _(s, d):
    return I.new_jobs(J(s, d), MID).select("job_instance_id")


@query("pending_days", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag='A')")
def _(s, d):
    days = table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return I.pending_days(days, table(s, d, "lineitem").filter("l_returnflag = 'A'").select(F.to_date("l_shipdate").alias("date")))


@query("incremental_facts", fact(f"SELECT {FACT_COLS} FROM fact"))
def _(s, d):
    """Half the events are loaded, then everything again: each event is there once."""
    path = scratch_path(s, "facts")
    facts = X(s, d)
    facts.filter("activity_date < date'2024-01-15'").write.partitionBy("activity_date").parquet(f"{path}/fact")
    I.replace_daily(s, s.read.parquet(f"{path}/fact"), f"{path}/daily")
    I.append_facts(s, facts, f"{path}/fact", f"{path}/daily")
    I.append_facts(s, facts, f"{path}/fact", f"{path}/daily")
    return s.read.parquet(f"{path}/fact")


@query("incremental_daily_metrics", fact(DAILYF))
def _(s, d):
    path = scratch_path(s, "daily")
    facts = X(s, d)
    facts.filter("activity_date < date'2024-01-15'").write.partitionBy("activity_date").parquet(f"{path}/fact")
    I.replace_daily(s, s.read.parquet(f"{path}/fact"), f"{path}/daily")
    I.append_facts(s, facts.filter("activity_date >= date'2024-01-10'"), f"{path}/fact", f"{path}/daily")
    return s.read.parquet(f"{path}/daily").select(FA.daily_metrics(facts).columns)


def _published(s, d):
    """Three loads into a store: the first half, everything from the tenth on, and again everything."""
    store, facts = Store(s, scratch_path(s, "store")), cut_lineage(X(s, d), "facts")
    for part in (facts.filter("activity_date < date'2024-01-15'"), facts.filter("activity_date >= date'2024-01-10'"), facts):
        I.load_facts(store, part)
    return store


@query("published_facts", fact(f"SELECT {FACT_COLS} FROM fact"))
def _(s, d):
    return _published(s, d).read("facts")


@query("published_daily_metrics", fact(DAILYF))
def _(s, d):
    return _published(s, d).read("daily").select(FA.daily_metrics(X(s, d)).columns)


@query("published_versions", fact("""SELECT * FROM (VALUES (1, DATE '2024-01-15'), (2, DATE '2999-01-01'), (3, DATE '2999-01-01'), (4, DATE '2999-01-01')) v(version, until),
 LATERAL (SELECT count(*) AS facts, count(DISTINCT date_sk) FILTER (WHERE workspace_sk IS NOT NULL) AS days FROM fact WHERE activity_date < until AND (version < 4 OR activity_date >= DATE '2024-01-20'))""").replace("SELECT * FROM (VALUES", "SELECT version, facts, days FROM (VALUES"))
def _(s, d):
    """Facts and days with a daily row as of each state; the last state has dropped the facts and daily rows of old days."""
    store = _published(s, d)
    store.drop_before("facts", "2024-01-20")
    frames = []
    for v in store.versions():
        facts, daily = store.read("facts", v), store.read("daily", min(v, 3))
        kept = daily.join(facts.select("date_sk").distinct(), "date_sk", "left_semi")
        frames.append(facts.agg(F.lit(v).alias("version"), F.count("*").alias("facts")).withColumn("days", kept.agg(F.countDistinct("date_sk")).scalar()))
    return reduce(lambda a, b: a.unionByName(b), frames)


def _members(s, d, changed):
    bump = "upper(c_mktsegment)" if not changed else "if(c_custkey % 3 = 0, 'MOVED', upper(c_mktsegment))"
    c = table(s, d, "customer").selectExpr("concat('u', c_custkey) as user_principal_name", f"{bump} as department", "c_custkey as k")
    c = c if changed else c.filter("k % 2 = 0")
    return D._versioned(c.drop("k"), F.lit("2024-01-01" if not changed else "2024-02-01").cast("date"))


@query("dimension_insert_new", "SELECT 'u'||c_custkey AS user_principal_name, CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS department, true AS is_current, CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS effective_from, CAST(NULL AS DATE) AS effective_to, 1 AS version FROM customer")
def _(s, d):
    return D.upkeep(_members(s, d, True), _members(s, d, False), "user_principal_name")


SCD = """SELECT 'u'||c_custkey AS user_principal_name, c_mktsegment AS department, c_custkey % 3 <> 0 AS is_current, DATE '2024-01-01' AS effective_from, CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-01-31' END AS effective_to, 1 AS version FROM customer WHERE c_custkey % 2 = 0
 UNION ALL SELECT 'u'||c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END, true, DATE '2024-02-01', NULL, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0"""


@query("dimension_scd2", SCD)
def _(s, d):
    return D.upkeep(_members(s, d, True), _members(s, d, False), "user_principal_name", "scd2", "2024-02-01")


@query("dimension_scd2_repeated", SCD)
def _(s, d):
    new = _members(s, d, True)
    once = cut_lineage(D.upkeep(new, _members(s, d, False), "user_principal_name", "scd2", "2024-02-01"), "scd2")
    return D.upkeep(new, once, "user_principal_name", "scd2", "2024-03-01")


@query("new_members", "SELECT 'u'||c_custkey AS user_principal_name FROM customer WHERE c_custkey % 2 = 1")
def _(s, d):
    return D.new_members(_members(s, d, True), _members(s, d, False), "user_principal_name").select("user_principal_name")


@query("hourly_windows", act("SELECT date_trunc('hour', start_time) AS window_start, activity_type, count(*) AS activities FROM act GROUP BY 1,2"))
def _(s, d):
    return I.hourly_window(A(s, d)).groupBy("window_start", "activity_type").agg(F.count(F.lit(1)).alias("activities"))


def _files(rows):
    """Landed files for so many rows, each of which one task can hold."""
    return rows // I.ROWS_A_TASK + 1


def _landed(s, d):
    """Four quarters by time, each of one file or more; (path, schema, files of a quarter)."""
    path = scratch_path(s, "landed")
    a = A(s, d).drop("object_url", "error_message").withColumn("start_time", F.col("start_time").cast("timestamp")).withColumn("end_time", F.col("end_time").cast("timestamp"))
    files = _files(table(s, d, "events").count() // 4)
    a.repartitionByRange(4 * files, "start_time").write.parquet(path)
    return path, s.read.parquet(path).schema, files


@query("stream_windows", act("SELECT date_trunc('hour', start_time) AS window_start, activity_type, count(*) AS activities, count(*) FILTER (WHERE status='Failed') AS failures FROM act GROUP BY 1,2"))
def _(s, d):
    """Hourly counts as a stream; update mode rewrites a window, so the last batch wins."""
    path, schema, _ = _landed(s, d)
    out, ckpt = scratch_path(s, "windows"), scratch_path(s, "ckpt")
    counts = I.windowed_counts(I.read_stream(s, path, schema), lateness="60 days")
    write = lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)
    q = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    last = s.read.parquet(out).groupBy("window_start", "activity_type").agg(F.max_by(F.struct("activities", "failures"), "batch").alias("r"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "activity_type", "r.*")


@query("late_windows", act("SELECT date_trunc('hour', start_time) AS window_start, activity_type, count(*) AS activities, count(*) FILTER (WHERE status='Failed') AS failures FROM act GROUP BY 1,2"))
def _(s, d):
    """Every second event lands first; the others are older than what was seen and land in a second run, after a compaction."""
    path, ckpt = scratch_path(s, "late"), scratch_path(s, "ckpt")
    a = A(s, d).drop("object_url", "error_message").withColumns({c: F.col(c).cast("timestamp") for c in ("start_time", "end_time")})
    counts = I.WindowCounts(s, scratch_path(s, "windows"))
    odd = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 1
    for part in (a.filter(odd), a.filter(~odd)):
        part.repartition(2).write.mode("append").parquet(path)
        counts.run(I.read_stream(s, path, a.schema, 1), ckpt)
        counts.compact()
    return counts.read().withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_facts", fact("SELECT event_id, date_sk, workspace_sk, item_sk, is_failed, duration_seconds FROM fact"))
def _(s, d):
    """Four quarters in as many batches; the earliest third of the events lands again at last, a month late."""
    path, schema, files = _landed(s, d)
    early = s.read.parquet(path).filter("start_time < timestamp'2024-01-10'")
    early.repartition(_files(early.count())).write.mode("append").parquet(path)
    out, ckpt = scratch_path(s, "stream"), scratch_path(s, "ckpt")
    names = cut_lineage(FA.workspace_names(A(s, d)), "names")
    I.stream_facts(s, path, schema, lambda batch: FA.fact_from_log(batch, names=names), out, ckpt, files_per_trigger=files)
    return s.read.parquet(out).select("event_id", "date_sk", "workspace_sk", "item_sk", "is_failed", "duration_seconds")


@query("late_stream_rows", act("SELECT event_id FROM act"))
def _(s, d):
    """Every second event lands first, the others, all older than what was seen, in a second run of the stream."""
    path, out, ckpt = (scratch_path(s, x) for x in ("late", "stream", "ckpt"))
    a = A(s, d).drop("object_url", "error_message").withColumns({c: F.col(c).cast("timestamp") for c in ("start_time", "end_time")})
    odd = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 1
    names = cut_lineage(FA.workspace_names(A(s, d)), "names")
    for part in (a.filter(odd), a.filter(~odd)):
        part.repartition(_files(part.count())).write.mode("append").parquet(path)
        I.stream_facts(s, path, a.schema, lambda batch: FA.fact_from_log(batch, names=names), out, ckpt)
    return s.read.parquet(out).select("event_id")


@query("load_history", act("SELECT entity, max(start_time) AS high_water_mark, count(*) AS records_processed FROM (SELECT 'facts' AS entity, start_time FROM act UNION ALL SELECT 'errors', start_time FROM act WHERE status='Failed') GROUP BY 1"))
def _(s, d):
    """Two loads an entity; the second one's mark and count are asked for."""
    state = I.LoadState(s, scratch_path(s, "state"))
    a = A(s, d).withColumn("start_time", F.col("start_time").cast("timestamp"))
    for entity, rows in (("facts", a), ("errors", a.filter("status = 'Failed'"))):
        for part in (rows.filter(f"start_time <= timestamp'{MID}'"), rows):
            hwm, n = part.agg(F.max("start_time"), F.count("*")).first()
            state.record_load(entity, hwm, n, 1.0)
    last = state.history().groupBy("entity").agg(F.max("high_water_mark").alias("high_water_mark"), F.max("records_processed").alias("records_processed"))
    return last.withColumn("high_water_mark", F.col("high_water_mark").cast("timestamp_ntz"))


@query("build_schema_full", fact("SELECT (SELECT count(*) FROM fact) AS facts, (SELECT count(*) FROM dim_ws) AS workspaces, (SELECT count(*) FROM dim_item) AS items, (SELECT count(*) FROM dim_user) AS users, (SELECT count(*) FROM days) AS days"))
def _(s, d):
    return _model_counts(FA.build_schema(A(s, d)))


@query("build_schema_incremental", fact(f"SELECT (SELECT count(*) FROM act WHERE start_time > TIMESTAMP '{MID}') AS facts, (SELECT count(*) FROM dim_ws) AS workspaces, (SELECT count(*) FROM dim_item) AS items, (SELECT count(*) FROM dim_user) AS users, (SELECT count(*) FROM days) AS days"))
def _(s, d):
    """The first half builds the dimensions, the whole log extends them; only events above the mark become facts."""
    a = A(s, d)
    first = FA.build_schema(a.filter(F.col("start_time") <= F.lit(MID).cast("timestamp_ntz")))
    return _model_counts(FA.build_schema(a, incremental=True, existing=first.dims, hwm=F.lit(MID).cast("timestamp_ntz")))


def _model_counts(m):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    tables = {"facts": m.fact_activity, "workspaces": m.dims.workspace, "items": m.dims.item, "users": m.dims.user, "days": m.dim_date}
    return m.fact_activity.sparkSession.range(1).select(*[one(df, name).scalar().alias(name) for name, df in tables.items()])
