"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a site when the share of the site's distinct pages that contain it exceeds a ratio.
Pages with equal text count once, so a group of exact copies does not turn its own lines into boilerplate.

Defined cases: a null site is a site of its own; null texts stay null and count as a page without lines; blank
lines are kept and never counted; lines are compared without surrounding white space; a line repeated inside a
page counts once, and all its occurrences go; an empty table gives an empty result; repeated rows are each
rewritten; other columns pass through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES, free_name, table
from tidewatch.session import cut_lineage

MAX_RATIO = 0.1
#: The ratio decides on sites of any size; a line on one page only is that page's own text.
MIN_PAGES = 2


def boilerplate(pages: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per site, the hashes of its boilerplate lines: ``(site, lines array<bigint>)``.

    A line must be on more than ``max_ratio`` of the site's pages and on ``min_pages`` of them, so a site has at
    most its mean number of lines a page divided by ``max_ratio``, however large it is. Pages, lines and sites
    are counted from hashes, first in each task, then by (site, line); no task holds a site.
    """
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    hashed = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(F.btrim(x, F.lit(SPACES)))))
    slim = pages.select(F.col(f"`{site}`").alias("site"), F.col(f"`{text}`").alias("t")).select("site", F.xxhash64("t").alias("page"), "t")
    totals = slim.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    seen = slim.select("site", "page", F.explode(hashed).alias("line")).distinct()
    counts = seen.groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = counts.alias("c").join(totals.alias("t"), F.col("c.site").eqNullSafe(F.col("t.site")))
    over = over.where(F.col("n") > F.lit(float(max_ratio)) * F.col("pages"))
    return over.groupBy(F.col("c.site").alias("site")).agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(
    pages: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
    n_lines: str | None = None, n_dropped: str | None = None,
) -> DataFrame:
    """Pages with their boilerplate lines removed; the counts are added under the names given.

    The line sets are written first, so Spark broadcasts them when they are small by their real size and
    otherwise joins by site, where adaptive execution splits a hot site.
    """
    found = cut_lineage(boilerplate(pages, site, text, max_ratio, min_pages), "boilerplate")
    s, b, k = free_name(pages, "site"), free_name(pages, "lines"), free_name(pages, "kept")
    found = found.select(F.col("site").alias(s), F.col("lines").alias(b))
    split = F.split(F.col(text), "\n")
    joined = pages.join(found, pages[site].eqNullSafe(found[s]), "left")
    kept = F.filter(split, lambda x: ~F.array_contains(F.col(b), F.xxhash64(F.btrim(x, F.lit(SPACES)))))
    joined = joined.withColumn(k, F.when(F.col(b).isNotNull(), kept))
    dropped = F.coalesce(F.size(split) - F.size(k), F.lit(0))
    counts = {n_lines: F.coalesce(F.size(split), F.lit(0)), n_dropped: F.when(F.col(k).isNull() | F.col(text).isNull(), 0).otherwise(dropped)}
    joined = joined.withColumns({c: e.cast("long") for c, e in counts.items() if c})
    return joined.withColumn(text, F.when(F.col(k).isNull(), F.col(text)).otherwise(F.array_join(k, "\n"))).drop(s, b, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the corpus without the boilerplate lines of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, n_lines="n_lines", n_dropped="n_dropped")


ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
t AS (SELECT source, count(DISTINCT text) + CAST(count(*) > count(text) AS INT) AS pages FROM documents GROUP BY source),
b AS (
  SELECT k.source, k.bare FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WHERE k.bare <> ''
  GROUP BY k.source, k.bare, t.pages HAVING count(DISTINCT k.text) >= {MIN_PAGES} AND count(DISTINCT k.text) > CAST({MAX_RATIO} AS DOUBLE) * t.pages),
r AS (
  SELECT k.doc_id, count(*) AS n_lines, count(b.bare) AS n_dropped, string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE b.bare IS NULL) AS text
  FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.bare = b.bare GROUP BY k.doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
  coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN r USING (doc_id)
"""
