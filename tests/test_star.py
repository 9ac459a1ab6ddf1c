import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from tidewatch.operators import dimensions as D
from tidewatch.operators import facts as FA
from tidewatch.plans import measures as B
from tidewatch.streaming import incremental as I

T = dt.datetime(2024, 1, 10, 9, 20)
ACT = "event_id string, activity_id string, workspace_id string, workspace_name string, item_id string, item_name string, item_type string, submitted_by string, activity_type string, status string, start_time timestamp_ntz, end_time timestamp_ntz, duration_seconds double, domain string, location string"


def acts(df):
    return df(
        [
            ("1", "1", "w1", "DEV - Analytics", "i1", "NB", "Notebook", "ann@example.com", "RunArtifact", "Succeeded", T, None, 4000.0, "d", "l"),
            ("2", "2", "w1", "DEV - Analytics", "i1", "NB", "Notebook", "bob", "Odd", "Failed", T, None, None, "d", "l"),
            ("3", "3", None, "PROD - Sales", None, None, None, None, "Refresh", "Weird", None, T, 5.0, "d", "l"),
            ("4", "4", "w2", "PROD - Sales", "i2", "LH", "Lakehouse", "6f9619ff-8b86-d011-b42d-00c04fc964ff", "Refresh", "Cancelled", T, None, 1.0, "d", "l"),
        ],
        ACT,
    )


def test_dim_date_and_time(spark):
    d = D.dim_date(spark, "2024-06-28", "2024-07-07")
    assert d.count() == 10
    by = {r["date_sk"]: r for r in d.collect()}
    assert (by[20240630]["fiscal_year"], by[20240630]["fiscal_quarter"]) == (2024, 4)
    assert (by[20240701]["fiscal_year"], by[20240701]["fiscal_quarter"]) == (2025, 1)
    assert (by[20240701]["day_of_week"], by[20240701]["day_of_week_name"], by[20240706]["is_weekend"]) == (1, "Monday", True)
    t = D.dim_time(spark)
    assert t.count() == 96 and t.filter("is_business_hours").count() == 32
    assert rows(t.filter("hour_24 in (0, 13) and minute = 0"), "hour_24", "hour_12", "am_pm", "time_period") == [(0, 12, "AM", "Night"), (13, 1, "PM", "Afternoon")]


def test_reference_dims(spark):
    t = D.dim_activity_type(spark)
    assert t.count() == 70 and t.filter("activity_type_sk = 999").count() == 1
    assert rows(D.dim_status(spark).filter("status_code in ('Failed', 'Unknown')"), "status_sk", "severity") == [(3, 2), (8, 1)]


def test_growing_dims(df):
    a = acts(df)
    assert rows(D.dim_workspace(a), "workspace_id", "environment") == [("w1", "DEV"), ("w2", "PRD")]
    assert rows(D.dim_item(a), "item_id", "item_category", "platform") == [("i1", "Compute", "Fabric"), ("i2", "Storage", "Fabric")]
    assert [r[1] for r in rows(D.dim_user(a), "user_principal_name", "user_type")] == ["ServicePrincipal", "User", "User"]


def test_fact_keys_flags_and_fallbacks(df):
    a = acts(df)
    fact = FA.fact_activity(a, FA.build_dims(a))
    by = {r["event_id"]: r for r in fact.collect()}
    assert by["3"]["workspace_sk"] == by["4"]["workspace_sk"]  # by name
    assert (by["3"]["item_sk"], by["3"]["user_sk"], by["3"]["date_sk"], by["3"]["time_sk"]) == (None, None, 20240110, 915)
    assert (by["2"]["activity_type_sk"], by["3"]["status_sk"], by["2"]["duration_seconds"]) == (999, 8, 0.0)
    assert [by[i]["is_failed"] for i in "1234"] == [0, 1, 0, 1] and by["1"]["is_long_running"] == 1
    assert rows(fact) == rows(FA.fact_from_log(a))


def test_fact_high_water_mark(df):
    a = acts(df)
    fact = FA.fact_activity(a, FA.build_dims(a), hwm=F.lit("2024-01-10 09:20:00").cast("timestamp_ntz"))
    assert rows(fact, "event_id") == [("3",)]  # without a start


def test_daily_metrics_drop_null_keys(df):
    f = FA.fact_from_log(acts(df))
    got = rows(FA.daily_metrics(f), "total_activities", "failed_activities", "unique_users", "success_rate")
    assert got == [(2, 1, 1, 0.0), (2, 1, 2, 50.0)]


def test_key_completeness(df):
    a = acts(df)
    dims = FA.build_dims(a)
    got = rows(FA.key_completeness(FA.fact_from_log(a), {"item": (dims.item, "item_sk"), "user": (dims.user.limit(0), "user_sk")}))
    assert got == [("item", 4, 1, 0), ("user", 4, 1, 3)]


def test_build_schema_incremental(df):
    a = acts(df)
    first = FA.build_schema(a.filter("event_id < '3'"))
    both = FA.build_schema(a, incremental=True, existing=first.dims)
    assert both.dims.workspace.count() == 2 and both.fact_activity.count() == 4


def member(df, rows_):
    return df(rows_, "k string, v string, is_current boolean, effective_from date, effective_to date, version int")


def test_scd2_closes_opens_and_repeats(df):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    old = member(df, [("a", "x", True, d1, None, 1), ("b", "y", True, d1, None, 1), ("z", "gone", True, d1, None, 1)])
    new = member(df, [("a", "x2", True, d2, None, 1), ("b", "y", True, d2, None, 1), ("c", "n", True, d2, None, 1)])
    out = D.upkeep(new, old, "k", "scd2", "2024-02-01")
    want = [
        ("a", "x", False, d1, dt.date(2024, 1, 31), 1), ("a", "x2", True, d2, None, 2), ("b", "y", True, d1, None, 1),
        ("c", "n", True, d2, None, 1), ("z", "gone", True, d1, None, 1),
    ]
    assert rows(out) == want
    assert rows(D.upkeep(new, out, "k", "scd2", "2024-03-01")) == want
    assert rows(D.upkeep(new, old, "k"), "k", "v") == [("a", "x"), ("b", "y"), ("c", "n"), ("z", "gone")]


def fact_rows(df):
    days = ["2024-03-31", "2024-03-30", "2024-03-25", "2024-03-20", "2024-02-29", "2024-02-01", "2023-12-31"]
    return df([(dt.date.fromisoformat(x), 1, 0, 1.0, 0) for x in days], "activity_date date, record_count int, is_failed int, duration_seconds double, is_long_running int")


def test_periods(df):
    f = fact_rows(df)
    assert tuple(B.day_values(f, "2024-03-31").first()) == (1, 1)
    assert tuple(B.period_values(f, "2024-03-31").first()) == (3, 4, 1)
    assert tuple(B.to_date_values(f, "2024-03-31").first()) == (4, 2, 6)
    r = B.mom_pct(f, "2024-03-31").first()  # previous month is clamped to its end
    assert (r["activities_mtd"], r["previous_mtd"], r["mom_change_pct"]) == (4, 2, 100.0)
    r = B.change_pct(f, "2024-03-31").first()
    assert (r["dod_change_pct"], r["wow_change_pct"]) == (0.0, 200.0)


def test_blank_rules(df):
    f = df([(None, 5, 6, 1, 0), (1, 5, 6, 1, 0)], "user_sk bigint, workspace_sk bigint, item_sk bigint, record_count int, is_failed int")
    assert tuple(B.active_counts(f).first()) == (2, 1, 1)
    assert tuple(B.rates(f).first()) == (100.0, None)


def test_incremental_append_is_idempotent(df, spark, tmp_path):
    a = acts(df)
    facts = FA.fact_from_log(a)
    fp, dp = f"{tmp_path}/fact", f"{tmp_path}/daily"
    facts.limit(0).write.partitionBy("activity_date").parquet(fp)
    FA.daily_metrics(facts).limit(0).write.parquet(dp)
    for _ in range(2):
        I.append_facts(spark, facts, fp, dp)
    assert spark.read.schema(facts.schema).parquet(fp).count() == 4
    assert rows(spark.read.parquet(dp), *FA.daily_metrics(facts).columns) == rows(FA.daily_metrics(facts))


def test_a_load_that_stopped_between_its_writes_is_completed(df, spark, tmp_path, monkeypatch):
    facts = FA.fact_from_log(acts(df))
    fp, dp = f"{tmp_path}/fact", f"{tmp_path}/daily"
    facts.limit(0).write.partitionBy("activity_date").parquet(fp)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(I, "replace_daily", stop)
        try:
            I.append_facts(spark, facts, fp, dp)
        except RuntimeError:
            pass
    assert spark.read.schema(facts.schema).parquet(fp).count() == 4
    I.append_facts(spark, facts, fp, dp)
    assert spark.read.schema(facts.schema).parquet(fp).count() == 4
    assert rows(spark.read.parquet(dp), *FA.daily_metrics(facts).columns) == rows(FA.daily_metrics(facts))


def test_a_load_reads_its_days_only(df, spark, tmp_path):
    facts = FA.fact_from_log(acts(df))
    facts.write.partitionBy("activity_date").parquet(f"{tmp_path}/fact")
    stored = spark.read.schema(facts.schema).parquet(f"{tmp_path}/fact")
    plan = I.new_facts(facts, stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan.split("tmp_path")[0].split("Scan parquet")[-1]


def test_load_state(spark, tmp_path):
    state = I.LoadState(spark, f"{tmp_path}/state")
    assert state.get_hwm("facts") is None and state.history().count() == 0
    state.record_load("facts", T, 10, 1.234)
    state.record_load("facts", T + dt.timedelta(hours=1), 5, 1.0)
    assert state.get_hwm("facts") == T + dt.timedelta(hours=1)
    assert state.get_hwm("other", "x") == "x" and state.history(1).count() == 1
