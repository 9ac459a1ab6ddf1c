"""Atomic publication and counts that late rows change: jobs are stopped between any two writes."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewatch.operators.facts import daily_metrics
from tidewatch.sources import versions as V
from tidewatch.streaming import incremental as I

FACT = (
    "event_id string, activity_date date, date_sk int, workspace_sk bigint, user_sk bigint, item_sk bigint, record_count int, is_success int, is_failed int, "
    "is_long_running int, duration_seconds double"
)


def fact(i, day, failed=0):
    return (f"e{i}", dt.date(2024, 1, day), 20240100 + day, i % 2, i % 3, i % 4, 1, 1 - failed, failed, 0, float(i))


def facts(df, *some):
    return df(list(some), FACT)


def state(store):
    return rows(store.read("facts"), "event_id"), rows(store.read("daily"), "date_sk", "workspace_sk", "total_activities", "failed_activities")


class Stopped(Exception):
    pass


class Stopping:
    """A file system or store that stops before or after its n-th call of a kind."""

    def __init__(self, real, name, n, after):
        self._real, self._name, self._n, self._after = real, name, n, after

    def __getattr__(self, name):
        found = getattr(self._real, name)
        if name != self._name:
            return found

        def call(*args):
            self._n -= 1
            if self._n == 0 and not self._after:
                raise Stopped
            out = found(*args)
            if self._n == 0:
                raise Stopped
            return out

        return call


def test_facts_and_days_change_together(spark, df, tmp_path):
    store = V.Store(spark, str(tmp_path))
    assert I.load_facts(store, facts(df, *[fact(i, 1 + i % 3) for i in range(9)])) == 1
    assert I.load_facts(store, facts(df, *[fact(i, 3, 1) for i in range(8, 12)])) == 2
    every = facts(df, *[fact(i, 1 + i % 3) for i in range(9)], *[fact(i, 3, 1) for i in range(9, 12)])
    assert state(store)[0] == rows(every, "event_id")
    assert state(store)[1] == rows(daily_metrics(every), "date_sk", "workspace_sk", "total_activities", "failed_activities")
    assert store.read("facts", 1).count() == 9 and store.read("daily", 1).count() == 6
    plan = store.read("facts").filter("activity_date = date'2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(activity_date" in plan


@pytest.mark.parametrize("stop", [("_stage", 1, False), ("_stage", 1, True), ("_stage", 2, False), ("_stage", 2, True), ("create", 1, False), ("create", 1, True), ("rename", 1, False), ("rename", 1, True)])
def test_stops_between_any_two_writes(spark, df, tmp_path, monkeypatch, stop):
    """Readers find the state before the load or after it, and running the load again completes it."""
    name, n, after = stop
    store = V.Store(spark, str(tmp_path))
    I.load_facts(store, facts(df, *[fact(i, 1) for i in range(4)]))
    before = state(store)
    more = facts(df, *[fact(i, 1 + i % 2, 1) for i in range(2, 8)])
    if name == "_stage":
        monkeypatch.setattr(store, "_stage", getattr(Stopping(V.Store(spark, str(tmp_path)), name, n, after), name))
    else:
        monkeypatch.setattr(store, "_fs", Stopping(store._fs, name, n, after))
    with pytest.raises(Stopped):
        I.load_facts(store, more)
    fresh = V.Store(spark, str(tmp_path))
    done = name == "rename" and after
    assert (state(fresh) == before) is not done
    I.load_facts(fresh, more)
    whole = facts(df, *[fact(i, 1) for i in range(4)], *[fact(i, 1 + i % 2, 1) for i in range(4, 8)])
    assert state(fresh) == (rows(whole, "event_id"), rows(daily_metrics(whole), "date_sk", "workspace_sk", "total_activities", "failed_activities"))
    fresh.expire(keep=1, abandoned=0)
    assert state(fresh)[0] == rows(whole, "event_id") and len(fresh.versions()) == 1


def test_a_load_that_was_overtaken_starts_again(spark, df, tmp_path, monkeypatch):
    store, other = V.Store(spark, str(tmp_path)), V.Store(spark, str(tmp_path))
    base = store.snapshot()
    other.publish({"t": V.append(df([(1,)], "a int"))})
    with pytest.raises(V.Conflict):
        store.publish({"t": V.append(df([(2,)], "a int"))}, base)
    assert rows(store.read("t")) == [(1,)]
    real, calls = store.publish, []

    def late(changes, base):
        if not calls:
            calls.append(other.publish({"t": V.append(df([(3,)], "a int"))}))
        return real(changes, base)

    monkeypatch.setattr(store, "publish", late)
    assert I.load_facts(store, facts(df, fact(1, 1))) == 3
    assert rows(store.read("t")) == [(1,), (3,)] and store.read("facts").count() == 1


def test_replacing_overwriting_dropping_and_expiry(spark, df, tmp_path):
    store = V.Store(spark, str(tmp_path))
    put = lambda *r: df(list(r), "v string, day string")
    store.publish({"t": V.append(put(("a", "01"), ("b", "02"), ("n", None)), "day"), "u": V.overwrite(put(("x", "y")))})
    store.publish({"t": V.replace_partitions(put(("c", "02"), ("m", None)), "day", ["02", None])})
    assert rows(store.read("t")) == [("a", "01"), ("c", "02"), ("m", None)] and rows(store.read("u")) == [("x", "y")]
    store.publish({"u": V.overwrite(put())})
    assert store.read("u").count() == 0 and store.read("u").columns == ["v", "day"]
    store.drop_before("t", "02")
    assert rows(store.read("t")) == [("c", "02"), ("m", None)] and store.read("t", 1).count() == 3
    store.expire(keep=2)
    assert store.versions() == [3, 4] and rows(store.read("t", 3)) == [("a", "01"), ("c", "02"), ("m", None)]
    with pytest.raises(Exception, match="1.json"):
        store.read("t", 1)
    with pytest.raises(KeyError):
        store.read("nothing")


EVENT = "start_time timestamp, activity_type string, status string"


def event(hour, kind="a", status="Ok"):
    return (dt.datetime(2024, 1, 1, hour, 30), kind, status)


def test_late_rows_count_in_their_window(spark, df, tmp_path):
    counts = I.WindowCounts(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        counts.read()
    counts.sink(df([event(20), event(20, status="Failed"), event(21, "b")], EVENT), 0)
    counts.sink(df([event(1), event(20)], EVENT), 1)
    got = lambda: rows(counts.read().select(F.hour("window_start").alias("h"), "activity_type", "activities", "failures"))
    want = [(1, "a", 1, 0), (20, "a", 3, 1), (21, "b", 1, 0)]
    assert got() == want
    counts.sink(df([event(1), event(20)], EVENT), 1)
    assert got() == want, "a batch that runs twice replaces itself"
    counts.compact()
    assert got() == want and len(list((tmp_path / "batches").iterdir())) == 0
    counts.sink(df([event(2)], EVENT), 2)
    assert got() == [(1, "a", 1, 0), (2, "a", 1, 0), *want[1:]]


def test_a_stopped_compaction_changes_nothing(spark, df, tmp_path, monkeypatch):
    counts = I.WindowCounts(spark, str(tmp_path))
    for i in range(3):
        counts.sink(df([event(i), event(7)], EVENT), i)
    want = rows(counts.read())
    with monkeypatch.context() as stopped:
        stopped.setattr(I, "remove_path", lambda *_: (_ for _ in ()).throw(Stopped()))
        with pytest.raises(Stopped):
            counts.compact()
    assert rows(counts.read()) == want, "batches that the fold holds are not counted again"
    (tmp_path / "folds" / "upto=9").mkdir()
    assert rows(counts.read()) == want, "an incomplete fold is not read"
    counts.compact()
    assert rows(counts.read()) == want and list((tmp_path / "batches").iterdir()) == []


def test_only_repeated_ids_are_compared_as_rows(spark, df, tmp_path):
    """A load without repeated ids is not aggregated by row; with them each id comes once, and a null id once a load."""
    plain = df([fact(i, 1 + i % 2) for i in range(9)], FACT)
    known = df([fact(i, 1) for i in (2, 5)], FACT)
    plan = I.new_facts(plain, known)._jdf.queryExecution().executedPlan().toString()
    assert "first(" not in plan and "Sort" not in plan.replace("SortMergeJoin", "").replace("Sort [event_id", "")
    assert rows(I.new_facts(plain, known), "event_id") == [(f"e{i}",) for i in range(9) if i not in (2, 5)]
    assert rows(I.new_facts(plain, known.limit(0))) == rows(plain)
    assert I.new_facts(plain, plain).count() == 0
    none = (None, *fact(3, 1)[1:])
    odd = df([fact(1, 1), fact(1, 1), fact(2, 1), fact(2, 2), fact(4, 2), none, none], FACT)
    assert rows(I.new_facts(odd, df([fact(2, 1), none], FACT)), "event_id") == [("e1",), ("e4",), (None,)]
    store = V.Store(spark, str(tmp_path))
    for part in (plain, odd, plain):
        I.load_facts(store, part)
    assert rows(store.read("facts"), "event_id") == [*((f"e{i}",) for i in range(9)), (None,)]
