import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from tidewatch.llm import merkle_manifest as m

LOW = str.maketrans(m.UPPER, m.LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root, and for every leaf its siblings level by level with its place among them."""
    paths = [[] for _ in nodes]
    under, level = [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        for i, members in enumerate(under):
            run = level[i - i % 8 : i - i % 8 + 8]
            for leaf_no in members:
                paths[leaf_no].append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        under = [sum(under[i : i + 8], []) for i in range(0, len(under), 8)]
    return level[0], paths


def by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = tree([below[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), below[g][1], strict=True):
            way = path + above[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r[:4] + (r[4].translate(LOW) if r[4] is not None else None,)) if hit else own
            for place, others in way:
                h = sha("".join(others[:place]) + h + "".join(others[place:]))
            out.append((r[0], own, below[g][0], root, sha("".join("".join(o) for _, o in way)), h, h == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def result(spark, rows, parts=5):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, m.manifest(frame).collect()), key=str)


def some(ids, langs=("en", "de", None, "é", "z")):
    pick = random.Random(4)
    return [(i, pick.choice(["a", "", None, "ß"]), pick.choice(langs), pick.choice([None, 3, -1]), pick.choice([None, "", "Text", "ÄB c\n", "x" * 500]) and f"T{i} Äö") for i in ids]


def test_query_equals_sql_and_brute_force(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, m.query(spark, sf).collect()), key=str)
    assert got == sorted(con.execute(m.ORACLE_SQL).fetchall(), key=str)
    assert got == by_hand([tuple(r) for r in con.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()])
    assert 0 < sum(not r[-1] for r in got) < len(got), "some leaves are tampered with and found out"


def test_several_blocks_and_dense_containers(spark):
    rows = some(range(9000), langs=("en", "en", "en", "de"))
    assert result(spark, rows) == by_hand(rows)


def test_sparse_and_negative_ids_need_a_deep_directory(spark):
    ids = [k * 6007 - 4_000_000 for k in range(1400)] + [2**62 + 1, -(2**63), 2**63 - 1, 0]
    rows = some(ids, langs=("en",))
    assert result(spark, rows) == by_hand(rows)


def test_repeated_and_null_ids(spark):
    rows = some(range(40), langs=("en", None)) + [(7, "s", "en", 1, f"other {k}") for k in range(90)] + [(7, "s", "en", 1, "same Text")] * 700
    rows += [(2**62 + k, "s", "en", 1, "far") for k in (1, 1, 2, 3)] + [(-(2**61) - 1, "s", None, 1, "far")] * 2
    rows += [(None, "s", "en", 1, f"t{k % 300}") for k in range(620)] + [(None, None, None, None, None)] * 3
    assert result(spark, rows) == by_hand(rows)


def test_many_groups(spark):
    rows = [(i, "s", f"l{i * 7 % 1100}", 1, "t") for i in range(1500)]
    assert result(spark, rows) == by_hand(rows)


def test_one_row_and_no_row(spark):
    assert result(spark, [(3, "s", "en", 1, "t")]) == by_hand([(3, "s", "en", 1, "t")])
    assert result(spark, []) == []


def test_other_columns_and_names(spark, odd):
    named = odd.select("doc_id", "source", "lang", odd["n"].alias("n_chars"), "text", odd["key"].alias("leaf"), odd["n"].alias("a.b"), odd["key"].alias("g"))
    plain = [(r["doc_id"], r["source"], r["lang"], r["n"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, m.manifest(named).collect()), key=str) == by_hand(plain)
    dotted = named.withColumnsRenamed({"doc_id": "my.id", "a.b": "doc_id"})
    got = m.manifest(dotted, m.Columns(id="my.id"))
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(plain)


def test_text_ids_are_refused(odd):
    with pytest.raises(TypeError):
        m.manifest(odd.withColumnRenamed("n", "n_chars").withColumn("doc_id", odd["key"]))


def test_ranks_of_both_forms():
    rng = np.random.default_rng(2)
    for size in (0, 1, m.ARRAY_IDS, m.ARRAY_IDS + 1, m.SPAN):
        ids = np.sort(rng.permutation(m.SPAN)[:size])
        data = m.pack_ids(ids)
        assert m.unpack_ids(data).tolist() == ids.tolist()
        asked = np.arange(m.SPAN)
        assert m.rank(data, asked).tolist() == np.searchsorted(ids, asked).tolist()
