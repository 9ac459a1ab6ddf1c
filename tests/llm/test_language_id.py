import random
import zlib

import numpy as np

from tidewatch.llm import language_id as m


def test_gradients_are_those_of_the_loss():
    """Backpropagation through time against differences, in double precision."""
    net = m.Network(3, hidden=4, seed=1)
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 103, (5, 7)).astype(np.uint8), rng.integers(0, 3, 7)
    _, g = net.gradients(x, y)
    for k, a in net.p.items():
        for at in [tuple(rng.integers(0, n) for n in a.shape) for _ in range(6)]:
            at = (int(x[0, 0]), *at[1:]) if k.endswith("_in") else at
            old, eps = a[at], 1e-3
            a[at] = old + eps
            up = net.gradients(x, y)[0]
            a[at] = old - eps
            down = net.gradients(x, y)[0]
            a[at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-4


def test_words_are_pooled_over_positions():
    model = m.train(["der die das nicht", "the and this with"] * 40, ["de", "en"] * 40, steps=150)
    judge = m.Predictor(model)
    text = "the die " + "abcdefghij" * 9
    logs = np.zeros(2)
    n = 0
    for part in m.parts(text):
        logp = judge.net.log_probs(np.frombuffer(part, np.uint8).reshape(-1, 1))
        logs, n = logs + logp.sum(axis=(0, 1)), n + len(part)
    p = np.exp(logs / n)
    langs, scores = judge.predict([text])
    assert langs == [judge.names[int(p.argmax())]] and abs(scores[0] - p.max() / p.sum()) < 1e-5
    assert max(map(len, m.parts(text))) == m.PART and b"".join(m.parts(text)) == text.replace(" ", "").encode()


def test_held_out_accuracy(spark, documents):
    rows = m.query(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == docs.keys()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) > 0.96 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd, nothing):
    rnd = random.Random(1)
    model = m.train([" ".join(rnd.choice(["der", "die", "das"]) for _ in range(20)) for _ in range(9)], ["de"] * 9, steps=20)
    got = {r["doc_id"]: r for r in m.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in range(9)] == ["und"] * 3 + ["de"] * 6 and got[0]["score"] == 0
    assert got[4]["score"] == got[5]["score"] and got[4]["n"] == -1
    assert {r["lang_pred"] for r in m.predict(odd, None).collect()} == {"und"} and m.train([], []) is None
    digits = spark.createDataFrame([(1, "12 34 !?")], "doc_id long, text string")
    assert m.predict(digits, model).first()["lang_pred"] == "und"
    assert m.predict(nothing, model).collect() == [] and m.training_rows(nothing, "doc_id", "text", "lang") == []


def test_rare_languages_and_whole_texts_are_learned_from(spark):
    """A language far below the bound's share of the rows, and words after a long foreign head."""
    common = spark.range(20_000).selectExpr("id as doc_id", "concat('the and ', id) as text", "'en' as lang")
    rare = spark.range(20_000, 20_006).selectExpr("id as doc_id", "concat(repeat('licence ', 1000), repeat('nicht ', 1000)) as text", "'de' as lang")
    rows = m.training_rows(common.unionByName(rare), "doc_id", "text", "lang", 50)
    of = {x: [r["t"] for r in rows if r["l"] == x] for x in ("en", "de")}
    assert len(of["en"]) == 50 and len(of["de"]) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(20_000, 20_006)) > 0
    assert all(len(t) == m.DOC_WORDS and 20 < sum(bytes(w) == b"nicht" for w in t) < 80 for t in of["de"])
    assert m.train([r["t"] for r in rows], [r["l"] for r in rows], steps=5)["names"] == ["de", "en"]
