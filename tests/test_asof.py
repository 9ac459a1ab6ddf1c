"""As-of merge: literal cases, the property against pandas, hot keys, conflict resolution."""

import datetime as dt
import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewatch.operators import asof as S

DAY = dt.datetime(2024, 1, 15)
ACT = "event_id string, activity_id string, item_id string, start_time timestamp, end_time timestamp, status string, submitted_by string, failure_reason string, duration_seconds double"
JOB = "job_instance_id string, item_id string, job_start_time timestamp, job_end_time timestamp, job_status string, job_failure_reason string"


def at(h, m=0, s=0):
    return DAY + dt.timedelta(hours=h, minutes=m, seconds=s)


def act(i, item, start, end=None, status="Completed", reason=None, duration=None):
    return (i, i, item, start, end, status, "u", reason, duration)


def job(i, item, start, end=None, status="Succeeded", reason=None):
    return (i, item, start, end, status, reason)


def merged(df, acts, jobs):
    out = S.smart_merge(df(acts, ACT), df(jobs, JOB)).collect()
    return {r["event_id"]: r for r in out}


def test_match_inside_tolerance(df):
    assert merged(df, [act("a", "i", at(10))], [job("j", "i", at(10, 1))])["a"]["job_status"] == "Succeeded"


def test_failed_job_overrides(df):
    r = merged(df, [act("a", "i", at(10))], [job("j", "i", at(10, 0, 30), status="Failed", reason="boom")])["a"]
    assert (r["status"], r["failure_reason"], r["error_message"]) == ("Failed", "boom", "boom")


def test_activity_reason_wins_over_job(df):
    r = merged(df, [act("a", "i", at(10), reason="mine")], [job("j", "i", at(10), status="Failed", reason="theirs")])["a"]
    assert r["failure_reason"] == "mine"


def test_missing_end_filled_and_duration(df):
    r = merged(df, [act("a", "i", at(10))], [job("j", "i", at(10), at(10, 15))])["a"]
    assert (r["end_time"], r["duration_seconds"]) == (at(10, 15), 900.0)


def test_durations_kept_when_no_end_is_missing(df):
    r = merged(df, [act("a", "i", at(10), at(10, 5), duration=7.0)], [job("j", "i", at(10), at(10, 15))])["a"]
    assert r["duration_seconds"] == 7.0


def test_negative_duration_is_zero(df):
    out = merged(df, [act("a", "i", at(10), at(9)), act("b", "i", at(11))], [job("j", "k", at(1))])
    assert out["a"]["duration_seconds"] == 0.0 and out["b"]["duration_seconds"] == 0.0


def test_outside_window_other_item_and_null_keys(df):
    acts = [act("far", "i", at(10)), act("other", "k", at(12)), act("noitem", None, at(14)), act("nostart", "i", None), act("ok", "i", at(20))]
    jobs = [job("j1", "i", at(10, 10)), job("j2", "i", at(12)), job("j3", None, at(14)), job("j4", "i", at(20))]
    out = merged(df, acts, jobs)
    assert len(out) == 5
    assert [out[k]["job_instance_id"] for k in ("far", "other", "noitem", "nostart", "ok")] == [None, None, None, None, "j4"]


def test_tie_goes_backward_and_boundary_matches(df):
    out = merged(df, [act("tie", "i", at(10)), act("edge", "k", at(10))], [job("b", "i", at(9, 58)), job("f", "i", at(10, 2)), job("e", "k", at(10, 5))])
    assert (out["tie"]["job_instance_id"], out["edge"]["job_instance_id"]) == ("b", "e")


def test_equal_job_times(df):
    jobs = [job("a1", "i", at(10)), job("a2", "i", at(10)), job("b1", "k", at(10, 1)), job("b2", "k", at(10, 1))]
    out = merged(df, [act("back", "i", at(10)), act("fwd", "k", at(10))], jobs)
    assert (out["back"]["job_instance_id"], out["fwd"]["job_instance_id"]) == ("a2", "b1")


def test_two_and_two(df):
    out = merged(df, [act("a", "i", at(10)), act("b", "i", at(11))], [job("j", "i", at(10, 0, 30)), job("k", "i", at(11, 0, 30), status="Failed")])
    assert (out["a"]["status"], out["b"]["status"]) == ("Completed", "Failed")


def test_null_status_becomes_unknown_and_empty_sides(df):
    assert merged(df, [act("a", "i", at(10), status=None)], [])["a"]["status"] == "Unknown"
    assert merged(df, [], [job("j", "i", at(10))]) == {}


@pytest.mark.parametrize("direction,tolerance,cell", [("nearest", 300, 60), ("nearest", 300, 7), ("nearest", 7200, 60), ("nearest", None, 60), ("backward", 600, 60)])
def test_equals_pandas_on_random_data(df, direction, tolerance, cell):
    """Half of all rows share one key."""
    rnd = random.Random(7)
    key = lambda: "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(20)}"
    left = [(f"a{i}", key(), DAY + dt.timedelta(seconds=rnd.randrange(40000))) for i in range(1500)]
    seen, right = set(), []
    for i in range(400):
        k, t = key(), DAY + dt.timedelta(seconds=rnd.randrange(40000))
        if (k, t) not in seen:
            seen.add((k, t))
            right.append((f"j{i:04d}", k, t))
    got = S.asof_join(df(left, "id string, k string, t timestamp"), df(right, "job string, k string, jt timestamp"), "t", "jt", "k", tolerance, direction, "job", cell)
    a = pd.DataFrame(left, columns=["id", "k", "t"]).sort_values("t")
    b = pd.DataFrame(right, columns=["job", "k", "jt"]).sort_values("jt")
    tol = None if tolerance is None else pd.Timedelta(seconds=tolerance)
    want = pd.merge_asof(a, b, left_on="t", right_on="jt", by="k", tolerance=tol, direction=direction)
    expected = sorted((r.id, None if pd.isna(r.job) else r.job) for r in want.itertuples())
    assert rows(got, "id", "job") == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("direction", ["nearest", "backward"])
def test_unlimited_join_of_a_hot_key(df, monkeypatch, direction):
    """95 % of the rows share a key, and its cells make many blocks with gaps of whole blocks between right rows."""
    monkeypatch.setattr(S, "BLOCK_CELLS", 8)
    rnd = random.Random(11)
    key = lambda: "hot" if rnd.random() < 0.95 else f"k{rnd.randrange(5)}"
    left = [(f"a{i}", key(), DAY + dt.timedelta(seconds=rnd.randrange(900_000))) for i in range(1200)]
    right = [(f"j{i:04d}", key(), DAY + dt.timedelta(seconds=s)) for i, s in enumerate(sorted(rnd.sample(range(200_000, 700_000), 60)))]
    got = S.asof_join(df(left, "id string, k string, t timestamp"), df(right, "job string, k string, jt timestamp"), "t", "jt", "k", None, direction, "job")
    a, b = pd.DataFrame(left, columns=["id", "k", "t"]).sort_values("t"), pd.DataFrame(right, columns=["job", "k", "jt"]).sort_values("jt")
    want = pd.merge_asof(a, b, left_on="t", right_on="jt", by="k", direction=direction)
    expected = sorted(((r.id, None if pd.isna(r.job) else r.job) for r in want.itertuples()), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows(got, "id", "job") == expected


def test_no_window_holds_all_cells_of_a_key(df):
    """Windows over cells are dealt by block; those over a key alone hold one row per block."""
    cells = df([("hot", c, c % 3 == 0) for c in range(20_000)], "_k string, _cell bigint, _last boolean")
    found = S._neighbours(cells.withColumn("_block", F.floor(F.col("_cell") / S.BLOCK_CELLS)), ["_k", "_block"], "_cell", "_last", "_last")
    assert found.groupBy("_k", "_block").count().agg(F.max("count")).first()[0] == S.BLOCK_CELLS


def test_name_clash_gets_suffix(df):
    a = df([("a", "i", at(10), "x")], "id string, k string, t timestamp, note string")
    b = df([("i", at(10), "y")], "k string, jt timestamp, note string")
    assert rows(S.asof_join(a, b, "t", "jt", "k"), "note", "note_job") == [("x", "y")]


def test_plan_has_no_cross_join(df):
    out = S.smart_merge(df([act("a", "i", at(10))], ACT), df([job("j", "i", at(10))], JOB))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_enrich_errors_from_struct(df):
    ddl = "failure_reason string, error_message string, error_code string, status string, job_status string, job_failure_reason struct<message:string,errorCode:string>, item_name string, _item_name string"
    got = S.enrich_errors(df([(None, None, None, "Ok", "Failed", ("m", "c"), None, "n")], ddl), nested_reason=True).first()
    assert (got["error_message"], got["error_code"], got["status"], got["item_name"]) == ("m", "c", "Failed", "n")
