"""Top-k, first-per-key, shares, trailing averages and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """Planned as a per-partition top-k and one merge; ``order`` should end in a unique key."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """Spark limits each group before the shuffle, so a hot group costs k rows per task."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= k).drop("_rn")


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "n", label: str = "numbered") -> DataFrame:
    """The rows, written, with their place in the order from 0 on.

    They are sorted by ranges and written with the number of their range and their place in it; ranges are counted, one
    row each, and a range starts where those before it end.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), label)
    placed = placed.withColumns({"_range": F.shiftright("_id", 33), "_i": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(starts, "_range").withColumn(name, F.col("_before") + F.col("_i")).drop("_range", "_i", "_id", "_before")


def first_per_key(df: DataFrame, key: str | Sequence[str], order: str, columns: Sequence[str] | None = None, last: bool = False) -> DataFrame:
    """The row of the least (or greatest) ``order`` per key; null keys are dropped, a null
    order comes last, and equal orders are settled by the columns themselves.

    Picking a row with min_by holds text in the aggregation buffer, which makes Spark sort
    its whole input. So rows are first reduced to distinct descriptions with a fixed-width
    minimum, a hash aggregation combined on the map side, and only those are compared.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in (columns or df.columns) if c not in keys and c != order]
    kept = df
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    edge = F.max(order) if last else F.min(order)
    described = kept.groupBy(*keys, *rest).agg(edge.alias("_o"))
    row = F.struct(*rest)
    if last:
        best = F.max_by(row, F.struct(F.col("_o").isNotNull(), F.col("_o"), row))
    else:
        best = F.min_by(row, F.struct(F.col("_o").isNull(), F.col("_o"), row))
    return described.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def nearest_row(df: DataFrame, key: str, dist: Column | str, tie: Sequence[Column | str] = ()) -> DataFrame:
    return top_k_per_group(df, [key], [dist, *tie], 1)


def grand_total(df: DataFrame, expr: Column) -> Column:
    """A one-value aggregate of a frame as a scalar subquery: no cross join, no global window."""
    return df.agg(expr.alias("v")).scalar()


def share_of_total(df: DataFrame, c: str, alias: str = "share_percent") -> DataFrame:
    return df.withColumn(alias, F.try_divide(F.col(c), grand_total(df, F.sum(c))) * 100)


def trailing_avg(df: DataFrame, key: str, c: str, days: int = 7, date: str = "activity_date", alias: str | None = None) -> DataFrame:
    """Mean over the last ``days`` calendar days; gaps count as missing days, not as rows."""
    day = F.unix_date(date)
    window = W.partitionBy(key).orderBy(day).rangeBetween(-(days - 1), 0)
    return df.withColumn(alias or f"{c}_avg_{days}d", F.avg(c).over(window))


def dense_rank_desc(df: DataFrame, c: str, alias: str) -> DataFrame:
    """Dense rank over all rows: the place of each distinct total, numbered by ranges and joined back."""
    ranks = numbered(df.select(c).filter(F.col(c).isNotNull()).distinct(), [F.desc(c)], alias, "dense-ranks")
    return df.join(ranks.withColumn(alias, (F.col(alias) + 1).cast("int")), c)


def peak_hour(counts: DataFrame, hour: str = "hour_24", n: str = "total_activities", by: Sequence[str] = ()) -> DataFrame:
    """Busiest hour; the later one on a tie."""
    return counts.groupBy(*by).agg(F.max_by(hour, F.struct(n, hour)).alias("peak_hour"))


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """One page plus the total row count."""
    total = grand_total(df, F.count(F.lit(1)))
    return df.withColumn("total_rows", total).orderBy(*order).offset(offset).limit(limit)


def sort_report(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*order)
