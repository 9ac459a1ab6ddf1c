import random
import re

import numpy as np
import pytest

from tidewatch.llm import jaccard_join as m


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def by_hand(texts, k, pct):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if not x or len(x) * 100 < len(y) * pct:
                if x:
                    break
                continue
            if 100 * len(x & y) >= pct * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies around the threshold, exact copies, one large group, strangers."""
    rnd = random.Random(4)
    texts = {}
    for g in range(30):
        size = rnd.choice([3, 8, 40, 120, 400])
        base = [f"g{g}w{rnd.randrange(500)}" for _ in range(size)]
        for _ in range(150 if g == 0 else rnd.randrange(1, 8)):
            w = list(base)
            for _ in range(rnd.randrange(0, max(2, size // 18))):
                w[rnd.randrange(size)] = f"x{rnd.randrange(50)}"
            texts[len(texts) + 1] = " ".join(w).upper() if rnd.random() < 0.3 else "\n".join(w)
    return texts


@pytest.mark.parametrize(("k", "pct"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, copies, k, pct):
    frame = spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(5)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in m.jaccard_components(frame, shingle=k, pct=pct).collect()}
    assert got == by_hand(copies, k, pct)


def test_query_equals_brute_force(spark, sf, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.query(spark, sf).collect()}
    assert got == by_hand({i: r["text"] for i, r in documents.items()}, 3, 90)


def test_large_segments_are_split_into_blocks(spark, copies, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 16)
    frame = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in m.jaccard_components(frame).collect()}
    assert got == {i: c for i, (_, c) in by_hand(copies, 3, 90).items()}


def test_sketches_bound_the_difference(copies):
    sets = [m.shingle_set(t, 3) for t in list(copies.values())[:60]]
    for x in sets:
        for y in sets:
            differ = len(np.setxor1d(x, y))
            if len(x) and len(y):
                assert m.distance(x, y, 90)[0] <= differ
            a, b = m.parity_bits(x), m.parity_bits(y)
            a, b = (m.folded([z], min(len(a), len(b)))[0] for z in (a, b))
            assert int(np.bitwise_count(a ^ b).sum()) <= differ


def test_odd_rows(odd, nothing):
    got = {r["id"]: r for r in m.jaccard_components(odd).collect()}
    assert [got[i]["n_shingles"] for i in range(9)] == [len(shingles(r["text"], 3)) for r in sorted(odd.collect(), key=lambda r: r["doc_id"])]
    assert got[5]["component_id"] == 4 and got[0]["component_id"] == 0 and got[1]["component_id"] == 1
    assert m.jaccard_components(nothing).collect() == []
    kept = m.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_rows_without_id_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d")], "doc_id long, text string")
    assert [(r["id"], r["component_id"]) for r in m.jaccard_components(frame).collect()] == [(7, 7), (7, 7)]
    assert m.drop_near_duplicates(frame).count() == 3
