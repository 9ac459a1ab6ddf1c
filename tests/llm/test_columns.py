"""Every operator takes columns whose names clash with its own, names with dots, and refuses ids that it can't use."""

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import (
    centroid_clustering, embedding_dedup, exact_search, jaccard_join, language_id, line_dedup, merkle_manifest, mixing, packing, pii, quality_rules, token_counts,
)

#: Names that operators use inside or give to results, and names that need quotes.
NAMES = [
    "a.b", "mix", "g", "id", "key", "class", "site", "words", "hash", "tokens", "probability", "judged", "__judged", "__row", "__mix", "row", "n", "k", "t", "label", "bucket", "low", "at", "v",
    "cluster", "leaf", "tile", "component_id", "keys", "sampled", "topic", "line", "lines", "pages", "e", "span", "surrogate", "distance", "base_failed", "g_lang", "z0", "name with space",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{(i // 3 * 7 + j * j) % 500}" for j in range(80)) + f" a{i // 3}@x.org\nmenu\n", "en", "s", 5) for i in range(30)] + [(40, None, None, None, None), (41, "", "en", "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *(F.lit(f"<{n}>").alias(n) for n in NAMES))


PASSING = {
    "pii": lambda d: pii.replace_entities(d, "key"), "line_dedup": line_dedup.drop_boilerplate, "quality": quality_rules.reject_outliers, "mixing": mixing.sample,
    "jaccard": jaccard_join.drop_near_duplicates,
}


@pytest.mark.parametrize("name", PASSING)
def test_documents_keep_their_columns(docs, name):
    got = PASSING[name](docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[n] == f"<{n}>" for r in rows for n in NAMES)


def test_added_columns_take_the_place_of_equal_names(docs):
    more = docs.withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit("old")).withColumn("n_tokens", F.lit("old"))
    model = language_id.train(["the cat sat on the mat"] * 5 + ["le chat est sur la table"] * 5, ["en"] * 5 + ["fr"] * 5, steps=20)
    got = language_id.predict(more, model)
    assert len(set(got.columns)) == len(got.columns) == len(more.columns)
    assert all(r["lang_pred"] in ("en", "fr", "und") and r["a.b"] == "<a.b>" and r["__judged"] == "<__judged>" for r in got.collect())
    counted = token_counts.count_tokens(more)
    assert len(set(counted.columns)) == len(counted.columns) and all(isinstance(r["n_tokens"], int) and r["a.b"] == "<a.b>" for r in counted.collect())
    mixed = mixing.mix(more)
    assert mixed.columns.count("mix") == 1 and all(r["mix"]["probability"] <= 1 and r["a.b"] == "<a.b>" for r in mixed.collect())


def test_results_of_their_own_do_not_depend_on_other_columns(docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for run in (jaccard_join.jaccard_components, packing.pack, merkle_manifest.manifest):
        assert sorted(map(str, run(docs).collect())) == sorted(map(str, run(plain).collect()))


def test_a_token_column_weighs_documents(docs):
    by_words, by_column = mixing.mix(docs).first()["mix"], mixing.mix(docs, tokens=F.col("n_chars")).orderBy("doc_id").first()["mix"]
    assert by_words["n_tokens"] != by_column["n_tokens"] == 5


def test_raking_that_does_not_converge_is_told(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10, 1), ("b", "y", "t", 30, 1)], "source string, lang string, topic string, tokens long, docs long")
    goals = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "level string, target double"), "lang": spark.createDataFrame([("x", 0.9), ("y", 0.1)], "level string, target double")}
    with pytest.warns(UserWarning, match="residual"):
        got = mixing.rake(cells, goals, rounds=3)
    assert got.first()["residual"] > 0.1


def test_letters_are_letters_of_any_script():
    judge = language_id.Predictor(language_id.train(["the cat"] * 4, ["en"] * 4, steps=5))
    assert judge.predict(["½ ² ① 12 _ ٣", "—", "é", "你", "ª"])[0] == ["und", "und", "en", "en", "en"]


def test_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = [(i, "some words here", f"l{i}") for i in range(40)] + [(100 + i, "plain words", "en") for i in range(40)] + [(200 + i, "des mots", "fr") for i in range(40)]
    got = language_id.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert {r["l"] for r in got} == {"en", "fr"}


def test_ids_of_other_types_are_refused(spark, docs):
    text_ids = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    for run in (jaccard_join.jaccard_components, merkle_manifest.manifest):
        with pytest.raises(TypeError, match="integer"):
            run(text_ids)
    vectors = spark.createDataFrame([("a", [1.0] * 64, 1)], "vec_id string, embedding array<double>, label int")
    for run in (embedding_dedup.near_duplicates, centroid_clustering.cluster, exact_search.search):
        with pytest.raises(TypeError, match="integer"):
            run(vectors)
    with pytest.raises(ValueError, match="50"):
        jaccard_join.jaccard_components(docs, pct=30)
