"""Type-safe conversion, keys and generic text helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.when(col(c) != "", col(c))


def first_non_empty(cols: Iterable[Column | str]) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def round_half_even(c: Column | str, digits: int = 2) -> Column:
    """Round the way numpy does: scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def epoch_micros(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def safe_int64(c: Column | str) -> Column:
    """Null on bad text, NaN or infinity; fractions are cut off."""
    number = F.expr("try_cast(null as double)") if c is None else col(c).try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    whole_text = col(c).try_cast("bigint")
    return F.coalesce(whole_text, F.when(finite, number.try_cast("bigint")))


def coerce_keys(df: DataFrame) -> DataFrame:
    """Make every ``*_sk`` column a nullable bigint."""
    return df.withColumns({c: safe_int64(c) for c in df.columns if c.endswith("_sk")})


def safe_timestamp(c: Column | str, formats: Sequence[str] = tuple(K.TIMESTAMP_FORMATS)) -> Column:
    """ISO text first, then the listed formats; null when nothing parses."""
    text = F.trim(col(c).cast("string"))
    tries = [text.try_cast("timestamp")] + [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def safe_string(c: Column | str, default: str = "") -> Column:
    return F.coalesce(F.trim(col(c).cast("string")), F.lit(default))


def string_or_null(c: Column | str) -> Column:
    return blank_to_null(F.trim(col(c).cast("string")))


#: Values that stand for a null join key.
NULL_KEYS = 1024


def spread_nulls(key: Column | str, row: Column | str) -> Column:
    """A text join key that matches what ``key`` matches, but whose nulls are many values that match nothing.

    ``row`` tells rows apart. Rows without a key are so dealt evenly where a join shuffles.
    """
    return F.coalesce(col(key).cast("string"), F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(col(row)), F.lit(NULL_KEYS)).cast("string")))


def fill(c: Column | str, value) -> Column:
    return F.coalesce(col(c), F.lit(value))


def surrogate_key(prefix: str, *cols: Column | str) -> Column:
    """Deterministic 60-bit key: the first 15 MD5 digits of ``prefix|a|b``.

    One pair of equal keys is expected among some 1.5 billion members; ``key_collisions`` reports them.
    """
    return F.conv(F.substring(_key_hash(prefix, cols), 1, 15), 16, 10).cast("bigint")


def export_key(prefix: str, *cols: Column | str) -> Column:
    """31-bit form for consumers that need one: the first four MD5 bytes modulo 2^31 - 1.

    Not for joins: some 50,000 members give an even chance of two with one key.
    """
    return F.conv(F.substring(_key_hash(prefix, cols), 1, 8), 16, 10).cast("bigint") % F.lit(2147483647)


def _key_hash(prefix: str, cols: Sequence[Column | str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(prefix), *[col(c).cast("string") for c in cols]))


def key_collisions(dim: DataFrame, key: str, natural: str) -> DataFrame:
    """Keys that several natural keys share, with how many; empty when all is well."""
    members = dim.groupBy(key).agg(F.count_distinct(natural).alias("members"))
    return members.filter("members > 1")


def title_case(c: Column | str) -> Column:
    """Every run of letters capitalised, whatever separates the runs."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.array_join(F.transform(runs, F.initcap), "")


def truncate(c: Column | str, n: int, ellipsis: str = "") -> Column:
    cut = F.concat(F.substring(col(c), 1, n), F.lit(ellipsis))
    return F.when(F.length(col(c)) > n, cut).otherwise(col(c))


def rename_coalesce(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename columns; where several sources share a target, the earlier value wins and
    later ones only fill nulls. One projection, however many renames."""
    renames = K.ACTIVITY_RENAMES if renames is None else renames
    sources: dict[str, list[str]] = {}
    for name in df.columns:
        if name not in renames:
            sources.setdefault(name, []).append(name)
    for source, target in renames.items():
        if source in df.columns:
            sources.setdefault(target, []).append(source)
    return df.select(
        *[
            (F.col(f"`{names[0]}`") if len(names) == 1 else F.coalesce(*[F.col(f"`{n}`") for n in names])).alias(target)
            for target, names in sources.items()
        ]
    )


def ensure_columns(df: DataFrame, columns: Sequence[str] = tuple(K.REQUIRED_ACTIVITY_COLUMNS), fill_type: str = "string") -> DataFrame:
    missing = {c: F.lit(None).cast(fill_type) for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def backfill_activity_id(df: DataFrame) -> DataFrame:
    return df.withColumn("activity_id", F.coalesce("activity_id", "event_id"))
