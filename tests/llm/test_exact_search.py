import math

import duckdb
import numpy as np
import pytest

from tidewatch.llm import exact_search as m


def by_hand(rows, k=10, every=100, scale=1024):
    """rows: (id, vector), in Python integers."""
    ok = lambda i, v: i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    points = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if ok(i, v)]
    out = []
    for a, (i, v) in enumerate(points):
        if i % every == 0:
            hits = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(points) if a != b and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def result(frame, **more):
    return sorted(map(tuple, m.search(frame, **more).collect()))


def test_query_equals_sql_and_brute_force(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, m.query(spark, sf).collect()))
    assert got == sorted(con.execute(m.ORACLE_SQL).fetchall())
    assert got == by_hand(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())


@pytest.fixture()
def rows():
    rng = np.random.default_rng(3)
    made = [(i, rng.integers(-3, 4, size=6).astype(float).tolist()) for i in range(900)]
    made += [(1000 + i, [1.0] * 6) for i in range(300)] + [(0, [1.0] * 6)] * 4 + [(2000, [1.0] * 3), (2001, [2.0] * 3), (-100, [1.0] * 3)]
    made += [(3000, []), (3001, []), (3100, None), (None, [1.0] * 6), (3200, [None] * 6), (3300, [float("nan")] * 6), (3400, [float("-inf")] * 6), (3500, [0.0] * 6), (3600, [9.0] * 7)]
    return made


def test_ties_repeats_and_odd_rows(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, `a.b` int").repartition(7)
    assert result(frame) == by_hand(rows)
    assert result(frame.where("vec_id in (0, 2000, 2001, 3100)"), k=3) == by_hand([r for r in rows if r[0] in (0, 2000, 2001, 3100)], k=3)
    assert result(frame.where("false")) == [] and result(frame.where("vec_id in (1, 2, 3)")) == []
    named = frame.withColumnsRenamed({"vec_id": "my.id", "embedding": "my.v"})
    assert result(named, id="my.id", embedding="my.v", every=7) == by_hand(rows, every=7)


def test_blocks_and_merges_change_nothing(spark, rows, monkeypatch):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    monkeypatch.setattr(m, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(m, "SHARD_ROWS", 100)
    monkeypatch.setattr(m, "FAN", 2)
    assert result(frame, every=25) == by_hand(rows, every=25)


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for most in (2**9, 2**24, 2**29):
        q, x = rng.integers(-most, most, size=(3, 8)), rng.integers(-most, most, size=(5, 8))
        assert (m.product(q, x).astype(object) == q.astype(object) @ x.T.astype(object)).all()
    with pytest.raises(OverflowError):
        m.product(np.full((1, 4), 2**40), np.full((1, 4), 2**40))


def test_selection_takes_ties_from_the_left():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 4, size=(50, 30))
    for k in (1, 5, 29, 30, 40):
        expect = np.zeros(s.shape, dtype=bool)
        for i, row in enumerate(s):
            expect[i, np.argsort(-row, kind="stable")[:k]] = True
        assert (m.select(s, k) == expect).all()
