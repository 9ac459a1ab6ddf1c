import datetime as dt
import itertools
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewatch.operators import analysis as N
from tidewatch.operators import ranking as RK
from tidewatch.operators import reports as R
from tidewatch.operators.quantiles import exact_quantiles

ACT = "event_id string, activity_id string, item_id string, item_name string, item_type string, submitted_by string, domain string, status string, duration_seconds double, start_time timestamp_ntz"
T = dt.datetime(2024, 1, 1)


def compute_rows(df):
    return df(
        [
            ("1", "1", "i", "Daily Processing", "SparkJob", "u", "d", "Succeeded", 120.0, T), ("2", "2", "i", "Daily Processing", "SparkJob", "u", "d", "Failed", 30.0, T),
            ("3", "3", "k", "Analysis NB", "Notebook", "u", "d", "Succeeded", 300.0, T), ("4", "4", "r", "Report", "Report", "u", "d", "Succeeded", None, T),
        ],
        ACT,
    )


def test_compute_report_golden(df):
    got = rows(R.compute_analysis(compute_rows(df)), "item_name", "total_runs", "failed_runs", "failure_rate_percent", "avg_duration_seconds")
    assert got == [("Analysis NB", 1, 0, 0.0, 300.0), ("Daily Processing", 2, 1, 50.0, 75.0)]


def test_compute_report_unknown_labels_and_durations(df):
    d = df([("1", "1", "i", None, "Notebook", None, "d", None, None, T)], ACT)
    r = R.compute_analysis(d).first()
    assert (r["user"], r["item_name"], r["unknown_runs"], r["avg_duration_seconds"]) == ("Unknown", "Unknown", 1, 0.0)


def test_empty_input_keeps_schema(df):
    empty = df([], ACT)
    assert R.key_measurables(empty).first()["success_rate_percent"] == 0.0
    assert R.failure_analysis(empty).count() == 0 and "severity" in R.failure_analysis(empty).columns
    assert R.daily_trends(empty).count() == 0
    assert R.recommendations(R.key_measurables(empty), R.high_failure_items(empty), R.problem_domains(empty), R.user_volume(empty)["top"], R.domain_summary(empty)).count() == 1


def test_null_keys_are_dropped(df):
    d = df([("1", "1", None, "n", "Notebook", None, None, "Failed", 1.0, None)], ACT)
    assert R.high_failure_items(d).count() == 0 and R.user_volume(d)["all"].count() == 0 and R.daily_trends(d).count() == 0
    assert R.dimension_stats(d, {"domain": "domain", "time_date": "start_time"}).count() == 0


def test_quantiles_equal_numpy_with_a_hot_key(df):
    rng = np.random.default_rng(3)
    hot = rng.integers(0, 500, 3000) / 4
    cold = rng.integers(0, 50, 31) / 4
    data = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("none", None)]
    probs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(df(data, "k string, v double"), ["k"], "v", probs).collect()}
    for name, values in (("hot", hot), ("cold", cold)):
        for p in probs:
            assert abs(got[(name, p)] - np.quantile(values, p)) < 1e-9
    assert len(got) == 12
    whole = {r["prob"]: r["quantile"] for r in exact_quantiles(df(data, "k string, v double"), [], "v", [0.5]).collect()}
    assert abs(whole[0.5] - np.quantile(np.concatenate([hot, cold]), 0.5)) < 1e-9


@pytest.mark.parametrize("shape", ["uniform", "skewed", "constant", "close", "signed"])
def test_quantiles_by_refinement(df, shape):
    """So few values a task that every shape takes rounds of refinement, down to values that differ in their last digits."""
    rng = np.random.default_rng(7)
    values = {
        "uniform": rng.random(3000), "skewed": np.exp(rng.normal(0, 12, 3000)), "constant": np.array([2.5] * 500 + [7.0]),
        "close": 1e9 + rng.integers(0, 4000, 3000) * 2.0**-22, "signed": np.concatenate([-np.exp(rng.normal(0, 30, 1500)), np.exp(rng.normal(0, 30, 1500)), [0.0, 1e308, -1e308]]),
    }[shape]
    probs = [0.0, 0.001, 0.31, 0.5, 0.77, 1.0]
    frame = df([(float(v), "a" if i % 5 else "b") for i, v in enumerate(values)], "v double, k string")
    whole = {r["prob"]: r["quantile"] for r in exact_quantiles(frame, [], "v", probs, most=20).collect()}
    assert np.allclose([whole[p] for p in probs], np.quantile(values, probs), rtol=1e-12, atol=0)
    keyed = {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(frame, ["k"], "v", probs, most=20).collect()}
    part = np.array([v for i, v in enumerate(values) if i % 5])
    assert np.allclose([keyed[("a", p)] for p in probs], np.quantile(part, probs), rtol=1e-12, atol=0)


def test_quantiles_of_nothing(df):
    assert exact_quantiles(df([], "v double"), [], "v", [0.5]).collect() == []
    assert exact_quantiles(df([(None, "a")], "v double, k string"), ["k"], "v", [0.5]).collect() == []


def brute_pairs(seen, k):
    groups, counts = {}, {}
    for user, hour, message in seen:
        groups.setdefault((user, hour), set()).add(message)
    for g in groups.values():
        for a, b in itertools.combinations(sorted(g), 2):
            counts[a, b] = counts.get((a, b), 0) + 1
    return sorted(((-n, a, b) for (a, b), n in counts.items()))[:k]


@pytest.mark.parametrize("leading,block", [(64, 256), (3, 2), (1, 1)])
def test_cooccurrence_equals_brute_force(df, leading, block):
    rnd = random.Random(5)
    seen = [(f"u{rnd.randrange(6)}", rnd.randrange(5), f"m{min(rnd.randrange(40), rnd.randrange(40)):02d}") for _ in range(600)]
    frame = df([(u, dt.datetime(2024, 1, 1, h, 5), m) for u, h, m in seen], "user_name string, start_time timestamp, error_message string")
    got = [(-r["pair_count"], r["error_message"], r["other_message"]) for r in N.error_cooccurrence(frame, k=12, leading=leading, block=block).collect()]
    assert got == brute_pairs(seen, 12)


def test_cooccurrence_with_a_very_full_hour(spark, df):
    """One user and hour with 20,000 messages beside ordinary ones: its rare messages are pruned before they are paired."""
    busy = spark.range(20_000).selectExpr("'hot' as user_name", "timestamp '2024-01-01 01:00:00' as start_time", "concat('x', id) as error_message")
    rest = df([(f"u{i}", dt.datetime(2024, 1, 1, 2), f"m{(i + j) % 4}") for i in range(30) for j in range(3)], "user_name string, start_time timestamp, error_message string")
    got = N.error_cooccurrence(busy.unionByName(rest), k=3).collect()
    assert sorted((-r["pair_count"], r["error_message"], r["other_message"]) for r in got) == [(-16, "m1", "m2"), (-15, "m0", "m1"), (-15, "m0", "m2")]
