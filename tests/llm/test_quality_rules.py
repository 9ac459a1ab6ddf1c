import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import quality_rules as q


def by_hand(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_all_documents(spark, sf, documents):
    got = q.query(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    for r in got:
        assert tuple(r[c] for c in q.STATS) == by_hand(documents[r["doc_id"]]["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_odd_rows(odd, nothing):
    got = {r["doc_id"]: r for r in q.judge(q.statistics(odd)).collect()}
    assert all(tuple(r[c] for c in q.STATS) == by_hand(r["text"]) for r in got.values())
    assert all(r["n"] == -1 and r["key"] == "kept" for r in got.values())
    assert q.reject_outliers(nothing).collect() == []
    assert q.reject_outliers(odd).columns == odd.columns


def test_filters_do_not_compute_statistics_inside_one_another(spark):
    """A text of equal words: without a fence its nested arrays are evaluated for each mention in the filter."""
    texts = [(1, "word " * 400), (2, " ".join(f"w{i % 37}" for i in range(3000)))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = q.statistics(frame).where(~q.base_failed() | (F.col("n_dup_lines") > 5)).collect()
    assert got == [] and q.statistics(frame).where("n_repeat_words > 0").count() == 2
    plan = q.statistics(frame).where(~q.base_failed())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1


def test_dotted_columns_pass(spark, odd):
    named = odd.withColumn("a.b", odd["n"])
    assert q.reject_outliers(named).columns == named.columns
    assert q.reject_outliers(named).count() == q.reject_outliers(odd).count()


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(400, 5)) @ np.diag([3, 1, 1, 2, 1])
    z[:40] += 30
    frame = spark.createDataFrame([(None, "s", *map(float, r)) for r in z], "g_lang string, g_source string, z0 double, z1 double, z2 double, z3 double, z4 double")
    shapes = q.estimates(frame)
    shape = shapes.first()
    low = np.array([[shape[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    centre = np.array([shape[f"m{i}"] for i in range(5)])
    assert np.abs(centre - z[40:].mean(axis=0)).max() < 0.5, "the shifted tenth of the rows must not move the centre"
    expect = np.sum(np.linalg.solve(low, (z - centre).T) ** 2, axis=0) / shape["scale"]
    got = q._with_distance(frame, shapes, "d").select("z0", "d").collect()
    assert np.allclose(sorted(r["d"] for r in got), sorted(expect))
    assert expect[:40].min() > q.CUTOFF > np.quantile(expect[40:], 0.99)


def test_junk_goes_and_clean_documents_stay(spark):
    plain = [(i, " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(100 + i % 50)), "en", "s") for i in range(200)]
    junk = [(900 + i, " ".join(f"w{(i * 11 + k * k) % 997}###" for k in range(120)), "en", "s") for i in range(12)]
    kept = {r["doc_id"] for r in q.reject_outliers(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(200))


def test_only_builtin_functions(odd):
    plan = q.statistics(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
