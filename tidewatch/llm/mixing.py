"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are counted per (source, language, topic) cell. Cell weights start at the token shares and are raked in turn
to the target shares of every marginal until no factor moves by more than a tolerance. Each document then gets the
inclusion probability of its cell, calibrated so that the expected number of sampled tokens meets a budget; cells
whose probability reaches one are taken whole and their missing part goes to the others. A document is sampled when
the hash of its id, read as a number in [0, 1), is below its probability: the draw is the same in every run.

Defined cases: nulls of a marginal are a level of their own; null texts have no tokens, and documents in cells without
tokens get probability one, as they cost nothing; documents without id are drawn by the hash of their text; equal ids
are drawn alike; an empty table gives an empty result; other columns pass through, whatever their names are. Raking that
has not converged when its rounds are used up is told by a warning and by the ``residual`` of the cells.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import free_name, table, words
from tidewatch.session import cut_lineage

MARGINALS = ("source", "lang", "topic")
#: Without given targets, a level's target share is proportional to its token share to this power.
TEMPERATURE = 0.5
#: Share of all tokens that the sample is calibrated to.
BUDGET = 0.8
TOLERANCE = 1e-4
ROUNDS = 25
SEED = 20


def topic_of(text: Column) -> Column:
    """Topic by form: tables, markup, numbers, notes, articles or books."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    return (
        F.when(F.regexp_count(t, F.lit(r"\|")) * 40 > n, "table").when(F.regexp_count(t, F.lit(r"[#*$%&<>{}=]")) * 40 > n, "markup")
        .when(F.regexp_count(t, F.lit(r"[0-9]")) * 20 > n, "numbers").when(n < 600, "note").when(n < 6000, "article").otherwise("book")
    )


def _cells(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def tempered(cells: DataFrame, dim: str, power: float = TEMPERATURE) -> DataFrame:
    """Target shares ``(level, target)`` of a marginal, proportional to its token shares to a power."""
    got = cells.groupBy(F.col(dim).alias("level")).agg(F.pow(F.sum("tokens").cast("double"), power).alias("x")).where("x > 0")
    return got.crossJoin(F.broadcast(got.agg(F.sum("x").alias("all")))).select("level", (F.col("x") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with ``weight``, the share of tokens that meets every marginal's targets, and ``residual``, how far the last round missed one.

    Targets name levels that have tokens; levels without a target keep weight zero, and targets of levels without
    tokens are shared out by scaling. Only one number a round, the largest move, comes to the driver.
    """
    now = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    now = cut_lineage(now, "rake")
    known = {d: cut_lineage(t.join(now.select(F.col(d).alias("x")).distinct(), F.col("level").eqNullSafe(F.col("x")), "left_semi"), "targets") for d, t in targets.items()}
    # Every cell carries its targets, so that a round only joins sums.
    for dim, t in known.items():
        named = _scaled(t).select(F.col("level").alias("g"), F.col("target").alias(f"target_{dim}"))
        now = now.join(named, now[dim].eqNullSafe(named["g"]), "left").drop("g").withColumn(f"target_{dim}", F.coalesce(f"target_{dim}", F.lit(0.0)))
    now, worst = cut_lineage(now, "rake"), None
    for _ in range(rounds):
        moves = []
        for dim in known:
            sums = now.groupBy(F.col(dim).alias("g")).agg(F.sum("weight").alias("got"))
            t, got = F.col(f"target_{dim}"), F.col("got")
            factor = F.when(got > 0, t / got).otherwise(0.0)
            now = now.join(sums, now[dim].eqNullSafe(sums["g"])).withColumns({"weight": F.col("weight") * factor, f"move_{dim}": F.abs(t - got)}).drop("g", "got")
            moves.append(f"move_{dim}")
        now = cut_lineage(now, "rake")
        worst = now.agg(F.max(F.greatest(*moves)) if len(moves) > 1 else F.max(moves[0])).first()[0]
        now = now.drop(*moves)
        if worst is None or worst <= tolerance:
            break
    if worst is not None and worst > tolerance:
        warnings.warn(f"raking stopped after {rounds} rounds with a residual of {worst:.2g}", stacklevel=2)
    return now.drop(*(f"target_{d}" for d in known)).withColumn("residual", F.lit(float(worst or 0.0)))


def _scaled(target: DataFrame) -> DataFrame:
    total = target.agg(F.sum("target")).first()[0] or 1.0
    return target.select("level", (F.col("target") / total).alias("target"))


def calibrate(weights: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds ``probability`` per cell: weight to tokens, scaled to the budget, with full cells taken whole."""
    total = weights.agg(F.sum("tokens")).first()[0] or 0
    scale, full = None, F.lit(False)
    for _ in range(50):
        got = weights.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not got[1]:
            break
        new = max(0.0, budget * total - got[0]) / got[1]
        if scale is not None and new <= scale * (1 + 1e-12):
            break
        scale, full = new, F.col("weight") * new >= F.col("tokens")
    rate = F.col("weight") * F.lit(float(scale or 0.0)) / F.col("tokens")
    return weights.withColumn("probability", F.least(F.lit(1.0), F.round(rate, 12)))  # sums of doubles depend on their order


def mix(
    docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", lang: str = "lang", topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = SEED, tokens: Column | None = None, into: str = "mix",
) -> DataFrame:
    """Every document with ``topic``, ``n_tokens``, ``probability`` and ``sampled`` in a struct column, named ``into``.

    ``tokens`` is the weight of a document, such as the count of a tokenizer; words between white space are counted without it.
    A column of the documents that is named ``into`` is replaced.

    Two passes over the texts, neither of which shuffles them: cells are counted in each task first, and cell
    probabilities, written before, are joined back by the planner's choice of their real size.
    """
    whole = free_name(docs, "row")
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower())).alias(whole), F.col(source).alias("source"), F.col(lang).alias("lang"),
        (topic_of(F.col(text)) if topic is None else topic).alias("topic"), (F.size(words(F.col(text))) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens"),
        F.coalesce(F.xxhash64(F.lit(seed), F.col(id).cast("string")), F.lit(0)).alias("by_id"), F.col(id).isNull().alias("no_id"), F.xxhash64(F.lit(seed), F.col(text)).alias("by_text"),
    )
    cells = cut_lineage(_cells(keyed), "cells")
    goals = targets or {d: tempered(cells, d) for d in MARGINALS}
    rates = cut_lineage(calibrate(rake(cells, goals), budget).select(*(F.col(c).alias(f"c_{c}") for c in MARGINALS), "probability"), "rates")
    same = keyed["source"].eqNullSafe(rates["c_source"]) & keyed["lang"].eqNullSafe(rates["c_lang"]) & keyed["topic"].eqNullSafe(rates["c_topic"])
    p = F.coalesce(F.col("probability"), F.lit(1.0))
    draw = F.shiftrightunsigned(F.when(F.col("no_id"), F.col("by_text")).otherwise(F.col("by_id")), 11) / F.lit(float(2**53))
    found = keyed.join(rates, same, "left")
    return found.select(f"{whole}.*", F.struct(F.col("topic"), F.col("tokens").alias("n_tokens"), p.alias("probability"), (draw < p).alias("sampled")).alias(into))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with the columns they came with."""
    into = free_name(docs, "mix")
    marked = mix(docs, into=into, **options)
    return marked.where(F.col(into)["sampled"]).drop(into)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, tokens, inclusion probability and draw of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "source", "lang", "mix.*")
