"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import cut_lineage

#: Word separators of every operator: space and the five ASCII control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need_integers(df: DataFrame, id: str) -> None:
    """Refuse ids of other types: cast to numbers, texts would all become one null."""
    if not isinstance(df.schema[id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id} must be an integer column")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Bounds the rows of a batch that Python workers get, as texts and hash sets are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    return spark


def bounded_sample(df: DataFrame, hash: Column, bound: int, *ties: str) -> DataFrame:
    """The rows with the smallest hashes, at most ``bound``.

    Rows are counted first, and only hashes in the range that twice the bound needs are sorted, so that a task sends
    its share of the bound and not the whole of it.
    """
    n = df.count()
    h = free_name(df, "hash")
    keyed = df.withColumn(h, F.shiftrightunsigned(hash, 1))
    if n > 2 * bound:
        keyed = keyed.where(F.col(h) < int(2.0 * bound / n * 2**63))
    return keyed.orderBy(h, *ties).limit(bound).drop(h)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected edges ``(src, dst)`` of longs, as ``(id, component_id)``.

    The smallest id names a component. Ids without an edge to another id are left out. Alternates large-star
    and small-star rounds; neighbour minima are aggregated before they are shuffled, so a hub costs no more
    than its edges, and each round is written to the shared folder.
    """
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    now = cut_lineage(now, label)
    state = _fingerprint(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        now = cut_lineage(small.select("e.u", "e.v").where("u <> v").distinct(), label)
        before, state = state, _fingerprint(now)
        if state == before:
            break
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return members.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
