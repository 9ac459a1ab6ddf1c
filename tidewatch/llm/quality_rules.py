"""Quality rules: base limits, then robust multivariate outliers per language and source, in DataFrame functions only.

Every text gives a vector of transformed statistics. Per (language, source) a minimum-covariance-determinant
estimate is found by concentration steps from a deterministic start (median and quartile range of every
statistic): centre and scatter of the most central share of rows, ``STEPS`` times. The scatter is shrunk towards a diagonal of measurement scales, so that it is regular for groups of
any size and for statistics that are constant in most rows. It is scaled by its median distance, re-estimated
once from the rows inside the 97.5 % ellipsoid, and a row is rejected when its squared Mahalanobis distance
exceeds ``CUTOFF``.

Distances are ranked through histograms of fixed resolution, so no task ever holds a group: groups are aggregated
in each task first, and (group, bin) counts are all that meets in one place.

Defined cases: null text has no words and fails the base; null language or source is a group of its own; a group of
one row keeps it; an empty table gives an empty result; repeated rows count repeatedly; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES, free_name, table, words
from tidewatch.session import cut_lineage

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: Share of rows that an estimate is concentrated on.
CORE = 0.75
STEPS = 4
#: Squared distance beyond which a row is an outlier: the chi-square quantile of 5 degrees at about 1 - 1e-11.
CUTOFF = 60.0
#: Chi-square quantiles of 5 degrees at 0.5 and 0.975, and the scatter's correction when cut at the latter.
HALF, NEAR, CUT = 4.351, 12.833, 1.055
#: Measurement scales of the transformed statistics: differences below them mean nothing. In the order of vector().
SCALES = (0.5, 0.1, 0.08, 1.0, 0.3)
#: Rows that the measurement scales weigh as in every estimate.
PRIOR_ROWS = 10.0
P = len(SCALES)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five statistics of ``STATS``. All work stays inside a row; array sizes follow the text's length.

    Repeated three-word windows are found by hash: texts whose window hashes are all distinct stop there, the
    others sort (hash, place) and sum up the words that repeated windows cover.

    The statistics are fields of one struct beside a row number. A column that isn't deterministic is neither merged
    with others nor passed by filters, so a filter on a statistic doesn't compute them inside one another.
    """
    w, h, s, p, once = (free_name(docs, x) for x in ("words", "hashes", "sorted", "places", "statistics"))
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumn(w, words(F.col(text)))
    out = out.withColumn(h, F.transform(F.slice(w, 3, F.greatest(F.size(w), F.lit(1))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x)))
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    out = out.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(pairs)))
    twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn(p, F.sort_array(F.transform(twice, lambda x: x["i"])))
    steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    found = {
        "n_words": F.size(w).cast("long"),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    }
    out = out.withColumn(once, F.struct(*(e.alias(c) for c, e in found.items()), F.monotonically_increasing_id().alias("row")))
    return out.withColumns({c: F.col(once)[c] for c in found}).drop(w, h, s, p, once)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics: length, word length, symbols, repeated lines, repeated windows."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")), F.sqrt(F.col("n_repeat_words") / n),
    ]


def _quantiles(values: DataFrame, by: list[str], value: str, shares: dict[str, float], per_unit: int) -> DataFrame:
    """Per group the lower edge of the bin in which each share of rows is reached; bins are 1/per_unit wide."""
    bins = values.groupBy(*by, F.floor(F.col(value) * per_unit).alias("bin")).agg(F.count("*").alias("n"))
    upto = W.partitionBy(*by).orderBy("bin")
    run = bins.withColumns({"c": F.sum("n").over(upto), "all": F.sum("n").over(W.partitionBy(*by))})
    return run.groupBy(*by).agg(*(F.min(F.when(F.col("c") >= F.ceil(F.col("all") * q), F.col("bin") / per_unit)).alias(a) for a, q in shares.items()))


def _shape(sums: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of the shrunk scatter from sums of values and products."""
    n = F.col("n").cast("double")
    m = {f"m{i}": F.col(f"s{i}") / n for i in range(P)}
    out = sums.withColumns(m)
    weight = PRIOR_ROWS / (n + PRIOR_ROWS)
    cov = {}
    for i in range(P):
        for j in range(i + 1):
            c = (F.col(f"s{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) * (1 - weight)
            cov[f"c{i}{j}"] = F.greatest(c, F.lit(0.0)) + weight * SCALES[i] ** 2 + F.lit((0.5 * SCALES[i]) ** 2) if i == j else c
    out = out.withColumns(cov)
    for j in range(P):
        d = F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(d, F.lit(1e-12))))
        below = {f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, P)}
        out = out.withColumns(below) if below else out
    return out.select("g_lang", "g_source", *m, *(f"l{i}{j}" for i in range(P) for j in range(i + 1)))


def _with_distance(rows: DataFrame, shapes: DataFrame, name: str) -> DataFrame:
    """Squared distance of every row to its group's centre; the groups' own columns go."""
    shapes = shapes.select(*(F.col(c).alias(f"{name}_{c}") for c in shapes.columns))
    out = rows.join(shapes, rows["g_lang"].eqNullSafe(shapes[f"{name}_g_lang"]) & rows["g_source"].eqNullSafe(shapes[f"{name}_g_source"]), "left")
    for i in range(P):
        rest = F.col(f"z{i}") - F.col(f"{name}_m{i}") - sum((F.col(f"{name}_l{i}{k}") * F.col(f"{name}_y{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"{name}_y{i}", rest / F.col(f"{name}_l{i}{i}"))
    total = sum((F.col(f"{name}_y{i}") * F.col(f"{name}_y{i}") for i in range(P)), F.lit(0.0))
    if f"{name}_scale" in out.columns:
        total = total / F.col(f"{name}_scale")
    return out.withColumn(name, total).drop(*shapes.columns, *(f"{name}_y{i}" for i in range(P)))


def _sums(rows: DataFrame) -> DataFrame:
    z = [F.col(f"z{i}") for i in range(P)]
    return rows.groupBy("g_lang", "g_source").agg(
        F.count("*").alias("n"), *(F.sum(z[i]).alias(f"s{i}") for i in range(P)),
        *(F.sum(z[i] * z[j]).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)),
    )


def _depth(d: Column) -> Column:
    """Distances on a log scale, for bins of equal relative width."""
    return F.log(d + F.lit(1e-6))


def estimates(vectors: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """Centre, Cholesky factor and scale per group of ``vectors`` (g_lang, g_source, z0..z4), written to the shared folder."""
    by = ["g_lang", "g_source"]
    long = vectors.select(*by, F.posexplode(F.array(*(f"z{i}" for i in range(P)))).alias("k", "z"))
    q = _quantiles(long, [*by, "k"], "z", {"a": 0.25, "b": 0.5, "c": 0.75}, 256)
    at = lambda i, e: F.max(F.when(F.col("k") == i, e))
    spread = lambda i: F.greatest((F.col("c") - F.col("a")) / 1.349, F.lit(SCALES[i]))
    start = q.groupBy(*by).agg(
        *(at(i, F.col("b")).alias(f"m{i}") for i in range(P)), *(at(i, spread(i)).alias(f"l{i}{i}") for i in range(P))
    ).withColumns({f"l{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)})
    shapes = cut_lineage(start, "mcd-start")
    for _ in range(steps):
        near = cut_lineage(_core(vectors, shapes, core), "mcd-core")
        shapes = cut_lineage(_shape(_sums(near)), "mcd-shape")
    d = _with_distance(vectors, shapes, "d").withColumn("d", _depth(F.col("d")))
    half = _quantiles(d, by, "d", {"half": 0.5}, 256).select(*(F.col(c).alias(f"h_{c}") for c in by), (F.exp("half") / HALF).alias("scale"))
    scale = F.greatest(F.col("scale"), F.lit(0.25))
    raw = cut_lineage(shapes.join(half, shapes["g_lang"].eqNullSafe(half["h_g_lang"]) & shapes["g_source"].eqNullSafe(half["h_g_source"])).select(*shapes.columns, scale.alias("scale")), "mcd-raw")
    inside = _with_distance(vectors, raw, "d").where(F.col("d") <= NEAR)
    return cut_lineage(_shape(_sums(inside)).withColumn("scale", F.lit(CUT)), "mcd-final")


def _core(vectors: DataFrame, shapes: DataFrame, core: float) -> DataFrame:
    """The rows of every group up to the bin of distances in which the share is reached."""
    by = ["g_lang", "g_source"]
    d = _with_distance(vectors, shapes, "d").withColumn("d", _depth(F.col("d")))
    edge = _quantiles(d, by, "d", {"edge": core}, 256).select(*(F.col(c).alias(f"e_{c}") for c in by), "edge")
    near = d.join(edge, d["g_lang"].eqNullSafe(edge["e_g_lang"]) & d["g_source"].eqNullSafe(edge["e_g_source"]))
    return near.where(F.floor(F.col("d") * 256) / 256 <= F.col("edge")).select(*by, *(f"z{i}" for i in range(P)))


def _vectors(stats: DataFrame, lang: str, source: str) -> DataFrame:
    z = vector()
    return stats.withColumns({"g_lang": F.col(lang), "g_source": F.col(source), **{f"z{i}": z[i] for i in range(P)}})


def judge(stats: DataFrame, lang: str = "lang", source: str = "source", shapes: DataFrame | None = None) -> DataFrame:
    """Adds base_failed, distance and kept to rows that have the statistics of ``STATS``."""
    rows = _vectors(stats.withColumn("base_failed", base_failed()), lang, source)
    if shapes is None:
        shapes = estimates(rows.where("not base_failed").select("g_lang", "g_source", *(f"z{i}" for i in range(P))))
    rows = _with_distance(rows, shapes, "distance")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)).drop("g_lang", "g_source", *(f"z{i}" for i in range(P)))


def reject_outliers(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with the columns they came with.

    Texts are read twice rather than shuffled: once for the estimates, once to apply them.
    """
    slim = docs.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), F.col(text).alias("text"))
    stats = cut_lineage(statistics(slim).drop("text"), "quality-statistics")
    z = vector()
    shapes = estimates(stats.where(~base_failed()).select("g_lang", "g_source", *(z[i].alias(f"z{i}") for i in range(P))))
    whole, fence = free_name(docs, "row"), free_name(docs, "fence")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    # Filters don't move below a column that isn't deterministic; otherwise the statistics would be computed inside
    # the filter, once for each place that names them.
    judged = judge(statistics(packed).withColumn(fence, F.monotonically_increasing_id()), shapes=shapes)
    return judged.where(F.col("kept") & (F.col(fence) >= 0)).select(f"{whole}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = cut_lineage(statistics(docs).drop("text"), "quality-statistics")
    return judge(stats).select("doc_id", *STATS, "base_failed", "kept", "distance")
