import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))

import pytest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("benchmark tables are not here")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


#: Rows that every operator must take: nulls, empties, blanks, ties, repeats, a very long text.
ODD_TEXTS = [None, "", " \t\n ", "one", "one two three four five six", "one two three four five six", "x" * 50_000, "word " * 30_000, "né à Łódź — 你好 🙂 ▁ <s>"]


@pytest.fixture()
def odd(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "src0", -1, "kept") for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, key string")


@pytest.fixture()
def nothing(odd):
    return odd.where("false")
