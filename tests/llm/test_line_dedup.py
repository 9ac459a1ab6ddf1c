import duckdb

from tidewatch.llm import line_dedup as m


def by_hand(rows, ratio, least):
    """rows: (site, text) -> texts without boilerplate."""
    bare = lambda x: x.strip(" \t\n\x0b\f\r")
    pages, seen = {}, {}
    for site, text in rows:
        pages.setdefault(site, set()).add(text)
        for line in (text or "").split("\n"):
            if bare(line):
                seen.setdefault((site, bare(line)), set()).add(text)
    drop = {k for k, v in seen.items() if len(v) >= least and len(v) > ratio * len(pages[k[0]])}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, bare(x)) not in drop) for s, t in rows]


def test_against_brute_force(spark):
    rows = [("a", f"menu\nbody {i}\n\n menu \nfoot" if i % 2 else f"body {i}\nfoot") for i in range(40)]
    rows += [(None, f"menu\n{i}") for i in range(12)] + [("b", "menu\nrare")] * 30 + [("b", None), ("b", ""), ("c", "menu")]
    frame = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in m.drop_boilerplate(frame, n_lines="n", n_dropped="d").collect()}
    assert [got[i]["text"] for i in range(len(rows))] == by_hand(rows, m.MAX_RATIO, m.MIN_PAGES)
    assert got[1]["d"] == 3 and got[1]["n"] == 5
    assert got[len(rows) - 3]["text"] is None, "a null text stays"


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expect = sorted(con.execute(f"SELECT doc_id, source, text, n_lines, n_dropped FROM ({m.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in m.query(spark, sf).select("doc_id", "source", "text", "n_lines", "n_dropped").collect()) == expect


def test_odd_rows(odd, nothing):
    got = m.drop_boilerplate(odd)
    assert got.columns == odd.columns and sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))
    assert m.drop_boilerplate(nothing).collect() == []


def test_only_builtin_functions(odd):
    plan = m.boilerplate(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
