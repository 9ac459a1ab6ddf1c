import random
import zlib

from tidewatch.llm import toxicity as m


def test_folding():
    for text in ["Idiot", "1d1ot", "ID!OT", "іdіоt", "ídiöt", "ｉｄｉｏｔ", "id​iot", "𝐢𝐝𝐢𝐨𝐭", "|d|ot"]:
        assert m.fold("you " + text).split()[-1] in (m.fold("idiot"), m.fold("|diot")), text
    assert m.fold("$tupid l0$er!!") == m.fold("stupid loser!!") and m.fold(None) == ""


def naive(folded, entries, exceptions):
    """All places, without an automaton."""
    free, hits = set(), {}
    ends = lambda e: e == len(folded) or not folded[e].isalnum()
    starts = lambda s: s == 0 or not folded[s - 1].isalnum()
    for s in range(len(folded)):
        for p in exceptions:
            if folded.startswith(p, s) and starts(s) and ends(s + len(p)):
                free |= set(range(s, s + len(p)))
        for text, whole, weight in entries:
            if folded.startswith(text, s) and starts(s) and (not whole or ends(s + len(text))):
                hits[s] = max(hits.get(s, 0), weight)
    return sum(w for s, w in hits.items() if s not in free)


def test_matching_equals_a_naive_search():
    rnd = random.Random(3)
    words = ["ab", "abc", "abcd", "b", "bc", "cab", "x"]
    for _ in range(300):
        entries = [(w, rnd.random() < 0.5, float(rnd.randrange(1, 5))) for w in rnd.sample(words, 3)]
        exceptions = [" ".join(rnd.choice(words) for _ in range(2)) for _ in range(2)]
        text = "".join(rnd.choice([*words, " ", " ", ". "]) for _ in range(25))
        assert m.Lexicon(entries, exceptions).weight(text) == naive(text, entries, exceptions)


def test_exceptions_and_length():
    lexicon = m.Lexicon([(m.fold("clown"), True, 3.0)], [m.fold("clown fish")])
    assert lexicon.weight(m.fold("a Clown fish")) == 0 and lexicon.weight(m.fold("a clown, fish")) == 3 and lexicon.weight(m.fold("clowns")) == 0
    short, long = m.fold("clown"), m.fold("clown " + "word " * 500)
    assert m.feature(short, lexicon) > m.feature(long, lexicon) > 0 == m.feature("", lexicon)


def test_held_out_rows(spark, documents):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in m.query(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    held = [i for i in labels if rows[i]["held_out"]]
    assert sum(rows[i]["predicted"] for i in held if not labels[i]) <= 1
    assert sum(rows[i]["predicted"] for i in held if labels[i]) >= 0.6 * sum(labels[i] for i in held)


def test_learning_finds_words_beginnings_and_no_copies(spark):
    rnd = random.Random(5)
    filler = [f"{a}{b}{c}" for a in ("ka", "mo", "ri") for b in ("lu", "ta", "se") for c in ("no", "vi", "pe")]
    text = lambda: [rnd.choice(filler) for _ in range(30)]
    rows = []
    for i in range(400):
        w, bad = text(), i % 4 == 0
        if bad:
            for _ in range(3):
                w[rnd.randrange(30)] = rnd.choice(["grobian", "grobianen", "zork", "zorkat" + rnd.choice("abc")])
        rows.append((i, " ".join(w), int(bad)))
    copy = " ".join([*text(), "innocent", "zork"])
    rows += [(1000 + i, copy, 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = m.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    found = {e[0] for e in model["entries"]}
    assert any(m.fold("grobian").startswith(e) for e in found) and any(e.startswith("zork") for e in found) and "innocent" not in found


def test_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = m.learn(odd, none)
    got = {r["doc_id"]: r for r in odd.withColumn("score", m.score(odd, model)).collect()}
    assert got[0]["score"] == got[1]["score"] < 0.5 and got[4]["score"] == got[5]["score"] and got[4]["n"] == -1
    assert m.learn(nothing, none)["entries"] == model["entries"]
    assert nothing.withColumn("score", m.score(nothing, model)).collect() == []
