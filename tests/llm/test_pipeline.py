import corpus_pipeline as p
from pyspark.sql import functions as F

from tidewatch.llm import jaccard_join, packing, registry

from .test_packing import check


def test_stages_in_turn(spark, sf):
    """Each stage against what it must do to its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mixing", "packing"]
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        before = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert out.columns == columns
            assert {r["doc_id"] for r in rows} <= before.keys() and len({r["doc_id"] for r in rows}) == len(rows)
        if name == "line_dedup":
            assert len(rows) == len(before) and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "jaccard_join":
            groups = {r["component_id"] for r in jaccard_join.jaccard_components(docs, shingle=5, pct=80).collect()}
            assert {r["doc_id"] for r in rows} == groups
        if name == "packing":
            assert {r["doc_id"] for r in rows} == before.keys()
            assert check(rows) <= 1.01 * -(-sum(r["length"] for r in rows) // packing.SEQUENCE) + 2
        seen[name] = len(rows)
        if name != "packing":
            docs = spark.createDataFrame(rows, out.schema)
    assert 0.6 * 200 < seen["quality_rules"] < 200 and seen["mixing"] > 0.6 * seen["jaccard_join"]


def test_run_and_registry(spark, sf):
    rows = p.run(spark, sf).collect()
    assert check(rows) and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    names = registry.queries().keys()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert registry.oracle_sql().keys() <= names


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        out = stage(spark, docs, sf)
        assert out.collect() == []
        docs = spark.createDataFrame([], out.schema)


def test_small_sites_lose_their_boilerplate(spark):
    rows = [(i, "small", f"menu\nbody {i}", 0) for i in range(5)] + [(5 + i, "middle", f"menu\nbody {i}" if i < 6 else f"body {i}", 0) for i in range(50)]
    docs = spark.createDataFrame([*rows, (55, "single", "menu\nbody", 0)], "doc_id long, source string, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in p.lines(spark, docs, "").collect()}
    assert got == {i: "menu\nbody" if i == 55 else t.removeprefix("menu\n") for i, _, t, _ in docs.collect()}


def test_stages_pass_other_columns(spark, sf):
    """Columns with clashing and dotted names go through every stage that returns documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    for name in ("a.b", "mix", "key", "site", "class", "__row", "id"):
        docs = docs.withColumn(name, F.lit(f"<{name}>"))
    columns = docs.columns
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    rows = docs.collect()
    assert rows and all(r["a.b"] == "<a.b>" and r["mix"] == "<mix>" for r in rows)
