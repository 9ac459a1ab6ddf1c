"""Nearest-in-time joins.

With a tolerance, time is cut into cells per key that are a few tolerances wide. Each right row is
given to the one or two cells that it can reach, and a window inside each cell does the matching:
both inputs are read once and meet in one exchange on (key, cell), so a hot key is spread over its
cells. Left rows without key or time travel in cells of their own, dealt by hash.

Without a tolerance each cell keeps only its first and last right row. A scan of two levels over these
summaries, inside blocks of cells and over the blocks of a key, tells every left cell which right row
precedes it and which follows it. Those two carried rows then enter the cell as ordinary right rows.
No right row is replicated. All windows only look backwards in their sort order, so each is one
linear pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.basics import col, epoch_micros

CELL_SECONDS = 60
#: Width of a cell in tolerances, and cells for left rows that can't match.
CELL_TOLERANCES, LOOSE_CELLS = 4, 1 << 20
#: Cells of a block: of a key, one window holds at most so many of its cells, another its blocks.
BLOCK_CELLS = 1024


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: str,
    tolerance: float | None = K.ASOF_TOLERANCE_SECONDS,
    direction: str = "nearest",
    tie: str | None = None,
    cell_seconds: int = CELL_SECONDS,
) -> DataFrame:
    """Left rows with the columns of the right row nearest in time for the same key.

    ``tolerance`` in seconds is inclusive, ``None`` means unlimited. Equal distances go to the
    earlier row. Among right rows of equal time the backward side takes the highest ``tie``
    value, the forward side the lowest. Left rows with a null key or time stay unmatched.
    Right columns that share a name with the left get a ``_job`` suffix; the right key is dropped.
    """
    payload = [c for c in right.columns if c != by]
    named = {c: (f"{c}_job" if c in left.columns else c) for c in payload}
    reach = None if tolerance is None else int(tolerance * 1_000_000)
    width = max(cell_seconds * 1_000_000, CELL_TOLERANCES * (reach or 0))
    tie_col = F.coalesce(col(tie).cast("string"), F.lit("")) if tie else F.lit("")

    r = right.filter(F.col(by).isNotNull() & F.col(right_on).isNotNull()).select(
        F.col(by).alias("_k"), epoch_micros(right_on).alias("_t"), tie_col.alias("_tie"), F.struct(*[F.col(c).alias(named[c]) for c in payload]).alias("_r")
    )
    usable = F.coalesce(F.col(by).isNotNull() & F.col(left_on).isNotNull(), F.lit(False))
    l = left.select(  # noqa: E741
        F.when(usable, F.col(by)).alias("_k"), F.when(usable, epoch_micros(left_on)).alias("_t"), F.struct("*").alias("_l")
    ).withColumn("_cell", F.coalesce(F.floor(F.col("_t") / width), F.pmod(F.xxhash64("_l"), F.lit(LOOSE_CELLS))))
    if reach is None:
        r = _carried(r.withColumn("_cell", F.floor(F.col("_t") / width)), l.filter("_k is not null").select("_k", "_cell").distinct())
    else:
        first = F.floor((F.col("_t") - (reach if direction == "nearest" else 0)) / width)
        r = r.withColumn("_cell", F.explode(F.sequence(first, F.floor((F.col("_t") + reach) / width))))

    hit = F.struct("_t", "_tie", "_r")
    no_left = F.lit(None).cast(l.schema["_l"].dataType)
    no_hit = F.lit(None).cast(r.select(hit.alias("h")).schema["h"].dataType)
    rows = r.select("_k", "_cell", "_t", F.lit(0).alias("_side"), "_tie", no_left.alias("_l"), hit.alias("_hit")).unionByName(
        l.select("_k", "_cell", "_t", F.lit(1).alias("_side"), F.lit("").alias("_tie"), "_l", no_hit.alias("_hit"))
    )
    cell = W.partitionBy("_k", "_cell")
    back = cell.orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    matched = rows.withColumn("_p", F.last("_hit", ignorenulls=True).over(back))
    if direction == "nearest":
        down = cell.orderBy(F.desc("_t"), "_side", F.desc("_tie")).rowsBetween(W.unboundedPreceding, 0)
        matched = matched.withColumn("_n", F.last("_hit", ignorenulls=True).over(down))
    else:
        matched = matched.withColumn("_n", no_hit)
    take_prev = F.col("_n").isNull() | (F.col("_t") - F.col("_p._t") <= F.col("_n._t") - F.col("_t"))
    best = F.when(F.col("_p").isNotNull() & take_prev, F.col("_p")).otherwise(F.col("_n"))
    if reach is not None:
        best = F.when(F.abs(best["_t"] - F.col("_t")) <= reach, best)
    return matched.filter("_side = 1").withColumn("_best", best["_r"]).select("_l.*", "_best.*")


def _neighbours(rows: DataFrame, keys: list[str], at: str, last: str, first: str) -> DataFrame:
    """With the last row before (``_prev``) and the first row after (``_next``) each place, within the keys."""
    before = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_prev", F.last(last, ignorenulls=True).over(before)).withColumn("_next", F.last(first, ignorenulls=True).over(after))


def _carried(r: DataFrame, left_cells: DataFrame) -> DataFrame:
    """Right rows, and for each cell that is asked for, the last one before it and the first one after it.

    A prefix scan of two levels: neighbours are looked up inside blocks of ``BLOCK_CELLS`` cells, and for cells at the
    edges of a block among the blocks of the key. The cells of a hot key are so spread over its blocks.
    """
    hit, order = F.struct("_t", "_tie", "_r"), F.struct("_t", "_tie")
    right_cells = r.groupBy("_k", "_cell").agg(F.max_by(hit, order).alias("_last"), F.min_by(hit, order).alias("_first"))
    empty = F.lit(None).cast(right_cells.schema["_last"].dataType)
    cells = (
        right_cells.withColumn("_asked", F.lit(False))
        .unionByName(left_cells.select("_k", "_cell", empty.alias("_last"), empty.alias("_first"), F.lit(True).alias("_asked")))
        .groupBy("_k", "_cell")
        .agg(F.max_by("_last", F.col("_last").isNotNull()).alias("_last"), F.max_by("_first", F.col("_first").isNotNull()).alias("_first"), F.bool_or("_asked").alias("_asked"))
    )
    cells = cells.withColumn("_block", F.floor(F.col("_cell") / BLOCK_CELLS))
    filled = lambda c: F.when(F.col(c).isNotNull(), F.col("_cell"))
    blocks = cells.groupBy("_k", "_block").agg(F.max_by("_last", filled("_last")).alias("_blast"), F.min_by("_first", filled("_first")).alias("_bfirst"))
    blocks = _neighbours(blocks, ["_k"], "_block", "_blast", "_bfirst").select("_k", "_block", F.col("_prev").alias("_bprev"), F.col("_next").alias("_bnext"))
    carried = (
        _neighbours(cells, ["_k", "_block"], "_cell", "_last", "_first")
        .filter("_asked")
        .join(blocks, ["_k", "_block"])
        .select("_k", "_cell", F.explode(F.array(F.coalesce("_prev", "_bprev"), F.coalesce("_next", "_bnext"))).alias("_h"))
        .filter("_h is not null")
        .select("_k", "_cell", F.col("_h._t").alias("_t"), F.col("_h._tie").alias("_tie"), F.col("_h._r").alias("_r"))
    )
    return r.unionByName(carried)


def asof_nearest(l: DataFrame, r: DataFrame, on: tuple[str, str] = ("start_time", "job_start_time"), by: str = "item_id", tol: float | None = K.ASOF_TOLERANCE_SECONDS, tie: str | None = "job_instance_id") -> DataFrame:  # noqa: E741
    return asof_join(l, r, on[0], on[1], by, tol, "nearest", tie)


def asof_backward(l: DataFrame, r: DataFrame, on: tuple[str, str], by: str, tol: float | None = 60, tie: str | None = None) -> DataFrame:  # noqa: E741
    return asof_join(l, r, on[0], on[1], by, tol, "backward", tie)


def asof_rank(l: DataFrame, r: DataFrame, on: tuple[str, str], by: str, tie: str) -> DataFrame:  # noqa: E741
    """Nearest right row with no tolerance, by distance, earlier row first.

    Same answer as ranking every (left, right) pair of a key, without building the pairs.
    """
    return asof_join(l, r, on[0], on[1], by, None, "nearest", tie)


def resolve_merge(df: DataFrame, missing_end: Column | None = None) -> DataFrame:
    """Settle conflicts between an activity and its matched job.

    A failed job fails the activity; reason, message, user and end time are filled from the
    job (a structured reason as its JSON text). A duration is recomputed where the end time was
    missing. ``missing_end`` sets another rule: with :func:`any_missing_end`, one missing end time
    anywhere recomputes all durations, which makes a row depend on the batch it comes in.
    """
    if missing_end is None:
        missing_end = F.col("end_time").isNull() | F.col("duration_seconds").isNull()
    job_failed = F.coalesce(F.col("job_status") == "Failed", F.lit(False))
    nested = df.schema["job_failure_reason"].dataType.typeName() == "struct"
    reason = F.coalesce("failure_reason", F.to_json("job_failure_reason") if nested else F.col("job_failure_reason"))
    end = F.coalesce("end_time", F.col("job_end_time").cast(df.schema["end_time"].dataType))
    spent = F.coalesce(
        F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", F.col("start_time"), end) / 1e6), F.lit(0.0)
    )
    changes = {
        "status": F.when(job_failed, "Failed").otherwise(F.coalesce("status", F.lit("Unknown"))),
        "failure_reason": reason,
        "error_message": F.coalesce("error_message", reason) if "error_message" in df.columns else reason,
        "duration_seconds": F.when(missing_end, spent).otherwise(F.col("duration_seconds")),
        "end_time": end,
    }
    if "job_invoker" in df.columns:
        changes["submitted_by"] = F.coalesce("submitted_by", "job_invoker")
    return df.withColumns(changes)


def any_missing_end(df: DataFrame) -> Column:
    """True when some row lacks an end time, as a scalar subquery."""
    return df.agg(F.coalesce(F.bool_or(F.col("end_time").isNull()), F.lit(False)).alias("m")).scalar()


def smart_merge(activities: DataFrame, jobs: DataFrame, tolerance: float = K.ASOF_TOLERANCE_SECONDS) -> DataFrame:
    """As-of match of activities to jobs by item and start time, then conflict resolution."""
    return resolve_merge(asof_nearest(activities, jobs, tol=tolerance))


def enrich_errors(df: DataFrame, nested_reason: bool = False) -> DataFrame:
    """Message and code from the job's failure reason, where the activity has none."""
    raw = F.col("job_failure_reason")
    message = raw["message"] if nested_reason else raw
    code = raw["errorCode"] if nested_reason else F.when(raw.isNotNull(), F.lit("Unknown"))
    as_text = F.to_json(raw) if nested_reason else raw
    changes = {
        "failure_reason": F.coalesce("failure_reason", as_text),
        "error_message": F.coalesce("error_message", message),
        "error_code": F.coalesce("error_code", code),
        "status": F.when(F.col("job_status") == "Failed", "Failed").otherwise(F.col("status")),
    }
    for name in ("workspace_name", "item_name", "item_type"):
        if f"_{name}" in df.columns:
            changes[name] = F.coalesce(name, f"_{name}")
    return df.withColumns(changes)
