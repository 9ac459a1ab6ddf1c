"""Exact quantiles without gathering a group.

Spark's exact ``percentile`` holds a group's distinct values in one task. Here ranks are selected by
refinement. Distinct values are counted first (combined on the map side) and written. While some group has more
distinct values than one task should number, its values fall into intervals, the intervals are counted, and only those
that hold a wanted rank stay. The first intervals are logarithmic, later ones divide the range of the values that
are left, so the edges follow the data however it is skewed, and every round leaves a small part of a group. The last
values are numbered in windows of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

#: Distinct values that one task numbers, and intervals that a round cuts a group into (per factor e in the first).
MOST, PARTS = 50_000, 4096


def _interval(level: int) -> Column:
    """The interval of ``_v``: a function that never falls as the value rises. NaN comes last, as in Spark's order."""
    if level == 0:
        place = F.signum("_v") * F.floor(F.log1p(F.least(F.abs("_v"), F.lit(1e308))) * PARTS)
    else:
        place = F.when(F.col("_max") > F.col("_min"), F.floor((F.col("_v") - F.col("_min")) / (F.col("_max") - F.col("_min")) * PARTS)).otherwise(0)
    return F.when(F.isnan("_v"), F.lit(2**62)).otherwise(place.cast("long"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], most: int = MOST) -> DataFrame:
    """Rows (keys, prob, quantile) with linear interpolation between neighbours; rows with a null key or value are left out."""
    keys = list(keys)
    some = df.filter(F.col(value).isNotNull())
    for k in keys:
        some = some.filter(F.col(k).isNotNull())
    # Without keys there is one group, named by a column of its own.
    by = keys or ["_all"]
    source = some if keys else some.withColumn("_all", F.lit(0))
    live = cut_lineage(source.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "quantile-values")
    totals = live.groupBy(*by).agg(F.sum("_n").alias("_total"))
    place = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    ranks = [
        F.struct(F.lit(float(p)).alias("prob"), (place(p) - F.floor(place(p))).alias("frac"), F.lit(low).alias("low"), (F.floor if low else F.ceil)(place(p)).alias("r"))
        for p in probs for low in (True, False)
    ]
    wants = totals.select(*by, F.array(*ranks).alias("_want"))
    group, level = list(by), 0
    while (live.groupBy(*group).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0) > most:
        b = f"_b{level}"
        if level:
            live = live.join(live.groupBy(*group).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max")), group)
        live = live.withColumn(b, _interval(level)).drop("_min", "_max")
        upto = W.partitionBy(*group).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
        held = live.groupBy(*group, b).agg(F.sum("_n").alias("_c")).withColumn("_from", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        inside = F.filter("_want", lambda w: (w["r"] >= F.col("_from")) & (w["r"] < F.col("_from") + F.col("_c")))
        held = held.join(wants, group).withColumn("_want", inside).filter(F.size("_want") > 0)
        lowered = F.transform("_want", lambda w: w.withField("r", w["r"] - F.col("_from")))
        group, level = [*group, b], level + 1
        wants = cut_lineage(held.select(*group, lowered.alias("_want")), "quantile-wants")
        live = cut_lineage(live.join(wants.select(*group), group, "left_semi"), "quantile-values")
    upto = W.partitionBy(*group).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    placed = live.withColumn("_from", F.coalesce(F.sum("_n").over(upto), F.lit(0))).join(wants, group)
    hits = placed.select(*by, "_v", F.explode(F.filter("_want", lambda w: (w["r"] >= F.col("_from")) & (w["r"] < F.col("_from") + F.col("_n")))).alias("_w"))
    ends = hits.groupBy(*by, F.col("_w.prob").alias("prob")).agg(
        F.max("_w.frac").alias("_frac"), F.max(F.when(F.col("_w.low"), F.col("_v"))).alias("_a"), F.max(F.when(~F.col("_w.low"), F.col("_v"))).alias("_c")
    )
    between = F.when(F.col("_a") == F.col("_c"), F.col("_a")).otherwise(F.col("_a") + (F.col("_c") - F.col("_a")) * F.col("_frac"))
    return ends.select(*keys, "prob", between.alias("quantile"))


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One column per named probability, one row per key."""
    long = exact_quantiles(df, keys, value, list(probs.values()))
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in probs.items()]
    )
