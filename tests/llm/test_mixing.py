import numpy as np
import pytest

from tidewatch.llm import mixing as m


@pytest.fixture()
def cells(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", None if j == 2 else f"l{j}", f"t{k}", int(rng.integers(1, 1000)), 1) for i in range(4) for j in range(3) for k in range(3) if (i + j + k) % 4]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long")


def test_raking_meets_all_marginals(spark, cells):
    goals = {d: m.tempered(cells, d) for d in m.MARGINALS}
    got = m.rake(cells, goals).toPandas()
    assert abs(got["weight"].sum() - 1) < 1e-3
    for d, goal in goals.items():
        share = got.groupby(d, dropna=False)["weight"].sum()
        for level, target in ((r["level"], r["target"]) for r in goal.collect()):
            assert abs(share[share.index.isna()].iloc[0] if level is None else share[level]) == pytest.approx(target, abs=5e-4)


def test_raking_equals_numpy(cells):
    """The same rounds with arrays, from the same start."""
    goals = {d: m.tempered(cells, d) for d in m.MARGINALS}
    got = m.rake(cells, goals, rounds=3, tolerance=0).toPandas()
    w = got["tokens"].to_numpy(float)
    targets = {d: {r["level"]: r["target"] for r in g.collect()} for d, g in goals.items()}
    for _ in range(3):
        for d in m.MARGINALS:
            level = got[d].where(got[d].notna(), None).to_numpy()
            for x in set(level):
                w[level == x] *= targets[d][x] / w[level == x].sum()
    assert np.allclose(got["weight"], w)


def test_calibration_meets_the_budget(cells):
    got = m.calibrate(m.rake(cells, {d: m.tempered(cells, d) for d in m.MARGINALS}), 0.6).toPandas()
    assert (got["probability"] * got["tokens"]).sum() == pytest.approx(0.6 * got["tokens"].sum(), rel=1e-6)
    assert got["probability"].max() <= 1 and got["probability"].min() > 0
    free = got[got["probability"] < 1]
    rate = free["probability"] * free["tokens"] / free["weight"]
    assert rate.max() == pytest.approx(rate.min()), "cells that are not full keep their weights' proportions"


def test_draw_is_repeatable_and_follows_the_probability(spark, sf):
    one, two = (sorted(map(tuple, m.query(spark, sf).collect())) for _ in range(2))
    assert one == two
    rows = m.query(spark, "/root/testdata/sf0.01").toPandas()
    assert abs(rows["sampled"].mean() - rows["probability"].mean()) < 0.06
    assert rows[rows["probability"] >= 1]["sampled"].all()


def test_odd_rows(odd, nothing):
    got = m.mix(odd).collect()
    assert len(got) == odd.count() and all(r["n"] == -1 for r in got)
    assert all(r["mix"]["sampled"] for r in got if r["mix"]["n_tokens"] == 0 and r["mix"]["probability"] == 1)
    assert m.mix(nothing).collect() == [] and m.sample(nothing).columns == nothing.columns


def test_only_builtin_functions(odd):
    plan = m.mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
