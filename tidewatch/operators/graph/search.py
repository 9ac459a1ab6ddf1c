"""A stored trigram index over names, so that a search for a part of a name reads a part of the names.

Entities are numbered and written in blocks of consecutive numbers, each a partition. Every three characters in a row
of an entity's lower-case texts are a trigram; postings say which numbers of a block have it, and are partitioned by a
hash of the trigram. A search reads the postings of its own trigrams, keeps the numbers that have all of them, reads the
blocks of those, and checks the texts themselves. Texts of under three characters have no trigram; these searches
check all entities.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.graph.model import Graph, items, label
from tidewatch.operators.ranking import numbered

#: Partitions of the postings, and bits of an entity's number inside its block.
BUCKETS, BLOCK_BITS = 256, 16
GRAM = 3
ENTITIES = "n bigint, entity_type string, id string, name string, type string, location string, block bigint"
POSTINGS = "gram string, block bigint, numbers array<bigint>, bucket int"


def entities(g: Graph) -> DataFrame:
    """(entity_type, id, name, type, location) of items, sources and tables; a table's path is its location."""
    null = F.lit(None).cast("string")
    it = items(g).select(F.lit("item").alias("entity_type"), F.col("item_id").alias("id"), F.col("item_name").alias("name"), F.col("item_type").alias("type"), null.alias("location"))
    so = label(g, "Source").select(F.lit("source"), "id", "name", "type", "location")
    ta = label(g, "Table").select(F.lit("table"), "id", "name", F.lit("Table"), "full_path")
    return it.union(so).union(ta).distinct()


def matches(c: str, text: str) -> Column:
    """Whether a column contains the text in any case."""
    return F.lower(c).contains(text.lower())


def grams(text: str) -> list[str]:
    """The distinct trigrams of a search text, in order."""
    low = text.lower()
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _grams(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM)))


class NameIndex:
    """The index of a folder; :meth:`build` writes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, rows: DataFrame, path: str) -> NameIndex:
        """Index rows (entity_type, id, name, type, location) by name and location.

        Numbers follow the entities' order, so related names share blocks.
        """
        index = cls(rows.sparkSession, path)
        placed = numbered(rows, ["entity_type", "name", "id"], label="index-entities").withColumn("block", F.shiftright("n", BLOCK_BITS))
        kept = placed.select("n", "entity_type", "id", "name", "type", "location", "block")
        kept.repartition("block").sortWithinPartitions("n").write.mode("overwrite").partitionBy("block").parquet(f"{index.path}/entities")
        found = placed.select("n", "block", F.explode(F.array_distinct(F.concat(_grams(F.col("name")), _grams(F.col("location"))))).alias("gram"))
        lists = found.groupBy("gram", "block").agg(F.sort_array(F.collect_list("n")).alias("numbers"))
        bucket = F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(BUCKETS)).cast("int")
        lists.withColumn("bucket", bucket).repartition("bucket", F.shiftright("block", 4)).sortWithinPartitions("bucket", "gram", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings")
        return index

    def candidates(self, text: str) -> DataFrame:
        """(block, n) of the entities that have every trigram of the text."""
        wanted = grams(text)
        lists = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").filter(F.col("bucket").isin(sorted({_bucket(x) for x in wanted})) & F.col("gram").isin(wanted))
        # Blocks without one of the trigrams go before any number is looked at.
        whole = lists.groupBy("block").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == len(wanted)).select("block")
        numbers = lists.join(whole, "block", "left_semi").select("block", F.explode("numbers").alias("n"))
        return numbers.groupBy("block", "n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == len(wanted)).select("block", "n")

    def find(self, text: str, kind: str | None = None, names_only: bool = False) -> DataFrame:
        """Entities whose name (or location) contains the text in any case."""
        stored = self.spark.read.schema(ENTITIES).parquet(f"{self.path}/entities")
        if len(text) >= GRAM and grams(text):
            stored = stored.join(self.candidates(text), ["block", "n"])
        has = lambda c: F.coalesce(matches(c, text), F.lit(False))
        hit = has("name") if names_only else has("name") | has("location")
        return stored.filter(hit if kind is None else hit & (F.col("entity_type") == kind)).select("entity_type", "id", "name", "type", "location")
