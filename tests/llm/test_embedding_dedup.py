import numpy as np
import pytest

from tidewatch.llm import embedding_dedup as m


def by_hand(rows, threshold=0.93):
    """rows: (id, vector, label)."""
    ok = lambda v, y: y is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = {i: np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) for i, v, y in rows if ok(v, y)}
    label = {i: y for i, _, y in rows}
    parent, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a], links[b] = links[a] + 1, links[b] + 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in parent}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 60] + rng.normal(scale=rng.choice([0, 0.1, 0.25]), size=16)], int(i) % 2) for i in range(700)]
    rows += [(800 + i, [1.0] * 16, 1) for i in range(40)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [], 1), (903, [None] + [1.0] * 15, 1), (904, [float("nan")] + [1.0] * 15, 1)]
    return rows + [(905, [float("inf")] + [1.0] * 15, 1), (906, [1.0] * 16, None), (907, [2.0] * 16, 1), (908, [1.0] * 4, 1), (909, [1.0] * 4, 1)]


def compare(got, expect):
    assert {r["id"] for r in got} == expect.keys()
    total = sum(n for n, _ in expect.values())
    assert all(r["n_links"] <= expect[r["id"]][0] and r["kept"] == (r["id"] == r["component_id"]) for r in got), "a link below the threshold"
    assert sum(r["n_links"] for r in got) >= 0.97 * total
    assert sum(r["component_id"] == expect[r["id"]][1] for r in got) >= 0.97 * len(expect)


def test_recall_against_brute_force(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(5)
    compare(m.near_duplicates(frame).collect(), by_hand(vectors))


def test_blocks_change_nothing(spark, vectors, monkeypatch):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, m.near_duplicates(frame).collect()))
    monkeypatch.setattr(m, "BLOCK", 7)
    assert sorted(map(tuple, m.near_duplicates(frame).collect())) == whole


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    compare(m.query(spark, sf).withColumnRenamed("vec_id", "id").collect(), by_hand(rows))


def test_traversal_is_in_order_of_the_sums():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    sums = np.add.outer(a, b).ravel()
    assert m.traversal(a, b, 35) == np.argsort(sums, kind="stable").tolist() and m.traversal(a, b, 4) == np.argsort(sums)[:4].tolist()


def test_odd_rows(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    assert m.near_duplicates(frame.where("false")).collect() == []
    got = {r["id"]: r for r in m.near_duplicates(frame.where("vec_id >= 800 or vec_id is null")).collect()}
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 907))
    assert got[800]["n_links"] == 40 and got[907]["component_id"] == 800 and got[909]["component_id"] == 908
    same = spark.createDataFrame([(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in m.near_duplicates(same).collect()] == [(5, 1, 5, True)] * 2


def test_one_component_links_by_sign(spark):
    rows = [(1, "a", [2.0]), (2, "a", [3.0]), (3, "a", [-1.0]), (4, "b", [2.0]), (5, "a", [0.0]), (6, "a", [-4.0]), (7, "a", [2.0])]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in m.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 7: (2, 1), 3: (1, 3), 6: (1, 3), 4: (0, 4), 5: (0, 5)}
