"""Merkle manifest of a dataset: leaf coordinates from bitmap ranks, levels from keyed slot arrays.

Leaves of a group (a language) stand in the order of their ids, but nobody sorts them. Ids are cut into containers of
``SPAN`` consecutive values. Tasks build partial compressed containers (a bitmap with a directory of popcounts, or a
short sorted array where few ids are set), which are merged per (group, container). A radix tree of fan-out ``FAN`` over
the container numbers adds up the ids before each container; a leaf's coordinate is that number plus the rank of its
id in its own container.

The coordinate says where a digest goes: block ``coordinate >> 9`` and slot ``coordinate & 511``. A block is a whole
subtree of three levels of eight, so one task reduces its slot array and hands one digest on; the digests of blocks are
reduced the same way until a group has one, the subroot. Subroots in the order of their groups are leaves of the last
tree. Every block gets back its siblings up to the root, and with them and its slot array a task writes the proofs.

Defined cases: null ids come first in their group; rows with one id in one group stand in the order of their digests,
and equal rows next to each other, each a leaf of its own, however many there are: their places are prefix sums over
digest prefixes and chunks of rows, so no task holds the rows of one id. A null group is the first group. Null columns
count as ``-``, empty texts as length 0. Ids must be integers. An empty table gives an empty result, and only the five
columns of a leaf are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import need_integers, small_batches, table
from tidewatch.session import cut_lineage

#: Nodes that one digest joins, and levels that one task reduces.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
#: Consecutive ids of a container, and containers or nodes that a node of the directory joins.
SPAN_BITS, FAN_BITS = 12, 10
SPAN, FAN = 1 << SPAN_BITS, 1 << FAN_BITS
#: Ids up to which a container is an array of 16-bit places; a bitmap with its directory takes more bytes than these.
ARRAY_IDS = 256
#: Containers that a task keeps open before it sends them on.
OPEN = 4096
#: Rows of one id that are numbered together: the chunk of a row is its number shifted by so many bits.
CHUNK_BITS = 16
#: Container of null ids: below that of every 64-bit id on each level of the directory.
NULL_BUCKET = -(1 << 52)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["g", "bucket"]


class Columns(NamedTuple):
    """Columns that make a leaf, in the order in which they are hashed; ``group`` is hashed at its place too."""

    id: str = "doc_id"
    source: str = "source"
    group: str = "lang"
    length: str = "n_chars"
    text: str = "text"


# ---- compressed containers ---------------------------------------------------------
def pack_ids(places: np.ndarray) -> bytes:
    """A container of sorted distinct places: an array, or a bitmap behind a directory of the bits before each word."""
    if len(places) <= ARRAY_IDS:
        return b"a" + places.astype("<u2").tobytes()
    bits = np.zeros(SPAN, dtype=np.uint8)
    bits[places] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype("<u2")
    return b"b" + before.tobytes() + words.tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    if data[:1] == b"a":
        return np.frombuffer(data, "<u2", offset=1)
    words = np.frombuffer(data, np.uint8, offset=1 + SPAN // 32)
    return np.flatnonzero(np.unpackbits(words, bitorder="little")).astype("<u2")


def rank(data: bytes, places: np.ndarray) -> np.ndarray:
    """Number of ids of the container below each place."""
    if data[:1] == b"a":
        return np.searchsorted(np.frombuffer(data, "<u2", offset=1), places).astype(np.int64)
    before = np.frombuffer(data, "<u2", count=SPAN // 64, offset=1)
    words = np.frombuffer(data, "<u8", offset=1 + SPAN // 32)
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
    return before[word].astype(np.int64) + np.bitwise_count(below).astype(np.int64)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial containers of a task's rows; those that are open are joined over batches."""
    held: dict[tuple[str, int], list] = {}

    def flush() -> pa.RecordBatch:
        out = [(g, b, n, pack_ids(ids)) for (g, b), (n, ids) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["g", "bucket", "n", "ids"])

    for batch in batches:
        for key, places in batch.to_pandas().groupby(KEY)["low"]:
            ids, n = np.unique(places.to_numpy()), len(places)
            if key in held:
                ids, n = np.union1d(held[key][1], ids), n + held[key][0]
            held[key] = [n, ids]
        if len(held) > OPEN:
            yield flush()
    if held:
        yield flush()


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    ids = np.unique(np.concatenate([unpack_ids(x) for x in rows["ids"]]))
    return pd.DataFrame({"g": rows["g"].iloc[:1], "bucket": rows["bucket"].iloc[:1], "n": [int(rows["n"].sum())], "distinct": [len(ids)], "ids": [pack_ids(ids)]})


def containers(keys: DataFrame) -> DataFrame:
    """(g, bucket, n rows, distinct ids, ids) of rows (g, bucket, low). Partial containers meet by (g, bucket)."""
    partial = keys.select("g", "bucket", "low").mapInArrow(_partials, "g string, bucket bigint, n bigint, ids binary")
    return partial.groupBy(*KEY).applyInPandas(_merge, "g string, bucket bigint, n bigint, distinct bigint, ids binary")


def directory(held: DataFrame) -> DataFrame:
    """(g, bucket, start): the rows of the group in earlier containers, by prefix sums down a radix tree."""
    levels = [held.groupBy("g", F.col("bucket").alias("node")).agg(F.sum("n").alias("n"))]
    while (levels[-1].groupBy("g").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0) > FAN:
        up = levels[-1].groupBy("g", F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n").alias("n"))
        levels.append(cut_lineage(up, "manifest-directory"))

    def before(nodes: DataFrame, *within: str) -> DataFrame:
        w = W.partitionBy(*within).orderBy("node").rowsBetween(W.unboundedPreceding, -1)
        return nodes.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))

    top = before(levels[-1], "g")
    for level in reversed(levels[:-1]):
        own = before(level.withColumn("parent", F.shiftright("node", FAN_BITS)), "g", "parent")
        up = top.select("g", F.col("node").alias("parent"), F.col("start").alias("above"))
        top = own.join(up, ["g", "parent"]).withColumn("start", F.col("start") + F.col("above"))
    return top.select("g", F.col("node").alias("bucket"), "start")


# ---- leaves and their coordinates --------------------------------------------------
def _part(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame, columns: Columns = Columns()) -> DataFrame:  # noqa: B008
    """Rows (uid, g, bucket, low, id, known, leaf, changed), written once: the digests are binary, ``changed`` is that after tampering or null."""
    plain = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(Columns._fields, columns, strict=True)))
    need_integers(docs, columns.id)
    digest = lambda text: F.unhex(F.sha2(F.concat(*(_part(text if k == "text" else F.col(k)) for k in Columns._fields)), 256))
    hit = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 0, F.lit(False))
    out = plain.select(
        F.monotonically_increasing_id().alias("uid"),
        F.when(F.col("group").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("group").cast("string"))).alias("g"),
        F.coalesce(F.shiftright(F.col("id").cast("long"), SPAN_BITS), F.lit(NULL_BUCKET)).alias("bucket"),
        F.coalesce(F.col("id").cast("long").bitwiseAND(F.lit(SPAN - 1)), F.lit(0)).cast("int").alias("low"),
        F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"),
        F.col("id").isNotNull().alias("known"),
        digest(F.col("text").cast("string")).alias("leaf"),
        F.when(hit & F.col("text").isNotNull(), digest(F.translate(F.col("text").cast("string"), UPPER, LOWER))).alias("changed"),
    )
    return cut_lineage(out, "manifest-leaves")


def _ranked(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Coordinates of the rows of one container."""
    if not len(rows):
        return rows.assign(at=pd.Series(dtype="int64"))
    own, low = held.iloc[0], rows["low"].to_numpy()
    at = own["start"] + rank(own["ids"], low)
    if own["again"] is not None and len(own["again"]):
        more = sorted((x["low"], x["n"] - 1) for x in own["again"])
        sums = np.concatenate([[0], np.cumsum([n for _, n in more])])
        at = at + sums[np.searchsorted([x for x, _ in more], low)]
    return rows.assign(at=at)


def _ties(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Coordinates of rows whose ids repeat: by digest, then by chunk of row numbers, then by row number.

    Counts per digest prefix, then per digest and chunk, are added up, so that only a chunk's rows are ever numbered.
    """
    same = ["g", "bucket", "low"]
    rows = rows.withColumns({"p": F.conv(F.hex(F.substring("leaf", 1, 2)), 16, 10).cast("int"), "chunk": F.shiftright("uid", CHUNK_BITS)})
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fine = rows.groupBy(*same, "p", "leaf", "chunk").agg(F.count("*").alias("n"))
    wide = fine.groupBy(*same, "p").agg(F.sum("n").alias("n")).join(first, same)
    wide = wide.select(*same, "p", (F.col("at") + earlier(W.partitionBy(*same).orderBy("p"))).alias("base"))
    fine = fine.withColumn("before", earlier(W.partitionBy(*same, "p").orderBy("leaf", "chunk")))
    place = cut_lineage(fine.join(wide, [*same, "p"]).select(*same, "leaf", "chunk", (F.col("base") + F.col("before")).alias("base")), "manifest-ties")
    number = F.row_number().over(W.partitionBy(*same, "leaf", "chunk").orderBy("uid"))
    return rows.withColumn("k", number).join(place, [*same, "leaf", "chunk"]).withColumn("at", F.col("base") + F.col("k") - 1)


def coordinates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with their coordinate ``at`` inside the group, and the number of leaves per group (g, total)."""
    held = cut_lineage(containers(rows), "manifest-containers")
    totals = held.groupBy("g").agg(F.sum("n").alias("total"))
    held = held.join(directory(held), KEY)
    full = held.where(F.col("n") > F.col("distinct")).select(*KEY)
    out = ["g", "id", "known", "leaf", "changed", "at"]
    once = rows.select("g", "bucket", "low", "id", "known", "leaf", "changed")
    if full.isEmpty():
        placed = once.groupBy(*KEY).cogroup(held.withColumn("again", F.lit(None).cast("array<struct<low:int,n:bigint>>")).groupBy(*KEY))
        return placed.applyInPandas(_ranked, _with_at(once)).select(*out), totals
    repeats = rows.join(full, KEY, "left_semi").groupBy(*KEY, "low").agg(F.count("*").alias("n")).where("n > 1")
    repeats = cut_lineage(repeats, "manifest-repeats")
    listed = repeats.groupBy(*KEY).agg(F.collect_list(F.struct("low", "n")).alias("again"))
    # One row stands for the rows of a repeated id where ranks are looked up.
    nothing = [F.lit(0).cast("long").alias("id"), F.lit(False).alias("known"), F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("changed")]
    asked = once.join(repeats, [*KEY, "low"], "left_anti").withColumn("many", F.lit(False))
    asked = asked.unionByName(repeats.select("g", "bucket", "low", *nothing, F.lit(True).alias("many")))
    placed = asked.groupBy(*KEY).cogroup(held.join(listed, KEY, "left").groupBy(*KEY)).applyInPandas(_ranked, _with_at(asked))
    placed = cut_lineage(placed, "manifest-ranks")
    first = placed.where("many").select("g", "bucket", "low", "at")
    tied = _ties(rows.join(repeats, [*KEY, "low"], "left_semi"), first)
    return placed.where("not many").select(*out).unionByName(tied.select(*out)), totals


def _with_at(frame: DataFrame) -> T.StructType:
    return T.StructType([*frame.schema.fields, T.StructField("at", T.LongType())])


# ---- levels ------------------------------------------------------------------------
def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def climb(slots: list[str], whole: bool) -> list[list[str]]:
    """The levels above a slot array: up to ``LEVELS`` of them, or for a whole tree until one node is left."""
    levels = [slots]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + ARITY])) for i in range(0, len(last), ARITY)])
    return levels


def path_of(levels: list[list[str]], slot: int) -> list[tuple[int, str]]:
    """Per level the place in its run and the joined digests of the run's others."""
    out = []
    for nodes in levels[:-1]:
        first, place = slot - slot % ARITY, slot % ARITY
        out.append((place, "".join(nodes[first:slot]) + "".join(nodes[slot + 1 : first + ARITY])))
        slot //= ARITY
    return out


def fold(leaf: str, path: list[tuple[int, str]]) -> str:
    for place, others in path:
        leaf = digest(others[: 64 * place] + leaf + others[64 * place :])
    return leaf


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """The slot array of a block: every leaf at the slot its coordinate names."""
    slot = rows["at"].to_numpy() % BLOCK
    order = np.empty(len(rows), dtype=np.int64)
    order[slot] = np.arange(len(rows))
    own = rows.iloc[order]
    changed = [b"" if x is None else x for x in own["changed"]]
    whole = bool(own["total"].iloc[0] <= BLOCK)
    top = climb([x.hex() for x in own["leaf"]], whole)[-1][0]
    return pd.DataFrame({
        "g": own["g"].iloc[:1].to_numpy(), "block": [int(own["at"].iloc[0]) // BLOCK], "whole": [whole], "node": [top], "ids": [own["id"].to_numpy("<i8").tobytes()],
        "known": [own["known"].to_numpy(bool).tobytes()], "leaves": [b"".join(own["leaf"])], "changed": [changed],
    })


BLOCK_SCHEMA = "g string, block bigint, whole boolean, node string, ids binary, known binary, leaves binary, changed array<binary>"
NODE_SCHEMA = "g string, at bigint, up bigint, top string, place array<int>, others array<string>"


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a tree under one block: the digest above them, and each one's siblings on the way to it."""
    rows = rows.sort_values("at")
    levels = climb(list(rows["node"]), bool(rows["total"].iloc[0] <= BLOCK))
    paths = [path_of(levels, i) for i in range(len(rows))]
    return pd.DataFrame({
        "g": rows["g"], "at": rows["at"], "up": rows["at"] // BLOCK, "top": levels[-1][0],
        "place": [[p for p, _ in x] for x in paths], "others": [[o for _, o in x] for x in paths],
    })


def ascend(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over nodes (g, at, node): (g, at, place, others) of the paths to the top, and (g, top)."""
    steps, tops = [], []
    while True:
        counted = nodes.join(nodes.groupBy("g").agg(F.count("*").alias("total")), "g").withColumn("up", F.floor(F.col("at") / BLOCK))
        step = cut_lineage(counted.groupBy("g", "up").applyInPandas(_reduce, NODE_SCHEMA), "manifest-levels")
        steps.append(step)
        small = step.groupBy("g").agg(F.count("*").alias("total")).where(F.col("total") <= BLOCK)
        tops.append(step.join(small, "g", "left_semi").groupBy("g").agg(F.first("top").alias("top")))
        nodes = step.join(small, "g", "left_anti").groupBy("g", F.col("up").alias("at")).agg(F.first("top").alias("node"))
        if nodes.isEmpty():
            break
    paths = steps[-1].select("g", "at", "place", "others")
    for step in reversed(steps[:-1]):
        above = paths.select("g", F.col("at").alias("up"), F.col("place").alias("p"), F.col("others").alias("o"))
        joined = step.join(above, ["g", "up"], "left")
        more = lambda a, b: F.concat(a, F.coalesce(b, F.array().cast(step.schema[a].dataType)))
        paths = joined.select("g", "at", more("place", F.col("p")).alias("place"), more("others", F.col("o")).alias("others"))
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return cut_lineage(paths, "manifest-paths"), cut_lineage(found, "manifest-tops")


def _group_order(groups: DataFrame) -> DataFrame:
    """(g, at): the place of each group in the order of its bytes, counted within ranges and over the few ranges."""
    ranged = cut_lineage(groups.select("g").repartitionByRange("g").withColumn("part", F.spark_partition_id()), "manifest-groups")
    sums = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("part").orderBy("g"))
    return ranged.withColumn("k", number).join(before, "part").select("g", (F.col("before") + F.col("k") - 1).alias("at"))


def _proofs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every leaf of a block: its proof, and the root folded from its tampered or own digest."""
    for rows in batches:
        for r in rows.itertuples(index=False):
            own = r.leaves.hex()
            slots = [own[i : i + 64] for i in range(0, len(own), 64)]
            levels = climb(slots, r.whole)
            above = list(zip(r.place.tolist(), r.others.tolist(), strict=True))
            tail = "".join(o for _, o in above)
            out: dict[str, list] = {"proof_sha256": [], "folded_root": []}
            for i, leaf in enumerate(slots):
                path = path_of(levels, i)
                out["proof_sha256"].append(digest("".join(o for _, o in path) + tail))
                out["folded_root"].append(fold(r.changed[i].hex() or leaf, path + above))
            ids = pd.array(np.frombuffer(r.ids, "<i8"), dtype="Int64")
            ids[~np.frombuffer(r.known, bool)] = pd.NA
            yield pd.DataFrame({"id": ids, "leaf": slots, "subroot": r.subroot, "root": r.root, **out})


def manifest(docs: DataFrame, columns: Columns = Columns()) -> DataFrame:  # noqa: B008
    """Per row: id, leaf, subroot of its group, root, proof_sha256, folded_root after the tampering, and verified."""
    small_batches(docs.sparkSession)
    placed, totals = coordinates(leaves(docs, columns))
    rows = placed.join(totals, "g").withColumn("block", F.floor(F.col("at") / BLOCK))
    blocks = cut_lineage(rows.groupBy("g", "block").applyInPandas(_block, BLOCK_SCHEMA), "manifest-blocks")
    inner, subroots = ascend(blocks.select("g", F.col("block").alias("at"), "node"))
    order = _group_order(subroots)
    outer, roots = ascend(subroots.join(order, "g").select(F.lit("").alias("g"), "at", F.col("top").alias("node")))
    ends = subroots.join(order, "g").join(outer.drop("g"), "at").select("g", F.col("top").alias("subroot"), F.col("place").alias("p"), F.col("others").alias("o"))
    paths = inner.join(ends, "g").select("g", F.col("at").alias("block"), "subroot", F.concat("place", "p").alias("place"), F.concat("others", "o").alias("others"))
    root = roots.agg(F.first("top").alias("root")).first()["root"]
    joined = blocks.join(paths, ["g", "block"]).withColumn("root", F.lit(root).cast("string"))
    told = joined.mapInPandas(_proofs, "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every document."""
    return manifest(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _tree(name: str, first: str) -> str:
    """Levels of the trees over ``first`` (g, i, h): ``name`` (g, level, i, h, n), n being the nodes of the level."""
    return f"""{name}(g, level, i, h, n) AS (
  SELECT g, 0, i, h, count(*) OVER (PARTITION BY g) FROM {first}
  UNION ALL
  SELECT g, level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (n + {ARITY - 1}) // {ARITY} FROM {name} WHERE n > 1 GROUP BY g, level, i // {ARITY}, n)"""


ORACLE_SQL = f"""
WITH RECURSIVE crc(b, step, v) AS (
  SELECT b, 0, b FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE step < 8),
t AS (SELECT list(v ORDER BY b) AS t FROM crc WHERE step = 8),
parts AS (
  SELECT d.*, coalesce('=' || lang, '') AS g, {" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in Columns()[:-1])} AS head,
    xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 3 = 0 AS hit
  FROM documents d, t),
docs AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END, '-')) AS own
  FROM parts),
{_tree("low", "(SELECT g, i, leaf AS h FROM docs)")},
subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i FROM low WHERE n = 1),
{_tree("high", "(SELECT '' AS g, i, h FROM subs)")},
depth AS (SELECT g, max(level) AS d FROM low GROUP BY g),
nodes AS (
  SELECT g, level, i, h FROM low WHERE n > 1
  UNION ALL SELECT s.g, depth.d + high.level, high.i, high.h FROM high, (SELECT g, i FROM subs) s JOIN depth USING (g) WHERE high.n > 1),
place AS (SELECT s.g, s.h AS subroot, s.i AS k0, d, (SELECT max(level) FROM high) AS more, (SELECT h FROM high WHERE n = 1) AS root FROM subs s JOIN depth USING (g)),
way AS (
  SELECT doc_id, docs.g, subroot, root, leaf, own, k AS level, CASE WHEN k < d THEN i // CAST(pow({ARITY}, k) AS BIGINT) ELSE k0 // CAST(pow({ARITY}, k - d) AS BIGINT) END AS j
  FROM docs JOIN place USING (g), LATERAL (SELECT unnest(range(d + more)) AS k)),
sib AS (
  SELECT w.doc_id, w.level, w.j, w.g, string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i < w.j) AS before, string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i > w.j) AS after
  FROM way w JOIN nodes x ON x.g = w.g AND x.level = w.level AND x.i // {ARITY} = w.j // {ARITY} GROUP BY ALL),
proof AS (SELECT doc_id, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY level)) AS p FROM sib GROUP BY doc_id),
up(doc_id, level, h) AS (
  SELECT doc_id, 0, own FROM docs
  UNION ALL SELECT up.doc_id, up.level + 1, sha256(coalesce(before, '') || h || coalesce(after, '')) FROM up JOIN sib ON sib.doc_id = up.doc_id AND sib.level = up.level),
folded AS (SELECT doc_id, arg_max(h, level) AS f FROM up GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, f AS folded_root, f = root AS verified
FROM docs JOIN place USING (g) JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id)
"""
