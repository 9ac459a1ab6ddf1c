"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles, as 64-bit hashes. Every shingle flips a fixed 64-bit pattern
(XOR) in one of S segments of the document's sketch, so a segment depends on the parity of its shingles only, and the
Hamming distance of two sketches, in segments, is a lower bound of the symmetric difference of their sets.

At similarity t, sets of a <= b shingles differ in at most a (1 - t) / t places. Sets are put into size bands by a fixed
ratio; in the band of the smaller set no more than D segments can differ, so of S > D segments at least S - D are
equal (pigeonhole). Each set is joined within its band, and also within the band below if its partner may be there.
Segments without a shingle would be shared by strangers. A set with a shingle in f > D segments shares f - D of these
with a partner or more, the first of which is among its first D + 1: it gives out only those. The few sets with less
give out all segments.

Equal sets are one class from the start. Pairs of classes that share a segment are tested first against the Hamming
bound, then exactly on the shingle hashes. Only components are asked for, so each segment's classes are first linked to
one of them (a star), if their sizes and parity sketches, with some bits per shingle, allow it. Segments whose classes are still in different components after two stars with different centres are
compared in blocks of bounded size inside tasks: only pairs of different components whose parity sketches are near
enough become rows. Groups of near copies never come out pair by pair.

Defined cases: null and blank texts have an empty set and link with nothing; texts with fewer words than a shingle have
one shingle, the whole sequence; repeated rows are in one class; rows without id are left out, as they cannot be named;
an empty table gives an empty result. Hashes of 64 bits stand for shingles and classes: two of 10^10 different sets are
taken for equal with a chance of about 3 in 10^10 a set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewatch.llm.common import components, free_name, need_integers, small_batches, table
from tidewatch.session import cut_lineage, remove_path, scratch_path

RATIO = 2.0
SHINGLE, PCT = 3, 90
#: Least and most bits of a parity sketch, which has two to four for each shingle between them; members of a segment in a block.
LEAST_BITS, MOST_BITS, BLOCK = 512, 1 << 17, 1024

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word, ASCII letters in lower case, in order.

    The bytes of a word are weighted by powers of an odd number counted from the word's end, summed and mixed
    with the word's length.
    """
    b = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    n = stop - start
    back = np.repeat(stop, n) - np.flatnonzero(inside) - 1
    power = np.multiply.accumulate(np.full(int(n.max()), _M1, dtype=np.uint64))
    h = np.add.reduceat(mix64(b[inside].astype(np.uint64) + np.uint64(1)) * power[back], np.concatenate(([0], np.cumsum(n)[:-1])))
    return mix64(h + n.astype(np.uint64) * _M1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = mix64(h * _M1 + w[i : len(w) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(h)


def _band_edges(ratio: float = RATIO) -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
    return np.array(edges)


_EDGES = _band_edges()


@cache
def band_plan(band: int, pct: int) -> tuple[int, int]:
    """(D, S) of a band: the most segments that can differ, and the segments there are.

    There are so many that even the smallest set of the band has a shingle in D + 1 of them but for a rare one
    (three standard deviations).
    """
    least, widest = int(_EDGES[band]), int(_EDGES[band + 1]) - 1
    d = widest * (100 - pct) // pct
    s = d + 3
    while s < 4 * (d + 3) and s * (1 - np.exp(-least / s)) - 3 * np.sqrt(s * np.exp(-least / s)) < d + 1:
        s += 1 + s // 50
    return d, s


def segments(h: np.ndarray, band: int, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketch in a band: one word a segment, and which segments have a shingle."""
    _, s = band_plan(band, pct)
    place = (mix64(h ^ _M3) % np.uint64(s)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, code = place[order], mix64(h[order] ^ _M2)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    word = np.zeros(s, dtype=np.uint64)
    word[place[first]] = np.bitwise_xor.reduceat(code, first)
    full = np.zeros(s, dtype=bool)
    full[place[first]] = True
    return word, full


def bands_of(n: int, pct: int) -> list[int]:
    """Bands that a set of n shingles is joined in: its own, and the one below if its smallest partner is there."""
    own = int(np.searchsorted(_EDGES, n, side="right")) - 1
    return [own, own - 1] if own and -(-n * pct // 100) < _EDGES[own] else [own]


def keys(h: np.ndarray, pct: int) -> np.ndarray:
    """64-bit join keys (band, segment, word). Bands in which nothing may differ need none: equal sets are one class."""
    out = []
    for band in bands_of(len(h), pct) if len(h) else ():
        d, s = band_plan(band, pct)
        if not d:
            continue
        word, full = segments(h, band, pct)
        # With f segments that have a shingle, a linked set has f - D of them in common or more. The first of these in
        # order is among the first D + 1, for either set. Sets with too few also give out segments without one.
        use = np.flatnonzero(full)[: d + 1] if full.sum() > d else np.arange(s)
        out.append(mix64(word[use] + mix64(use.astype(np.uint64) + np.uint64((band << 40) + 1))))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def distance(x: np.ndarray, y: np.ndarray, pct: int) -> tuple[int, int]:
    """(Hamming distance of the sketches, most that linked sets may have) in the smaller set's band."""
    band = bands_of(min(len(x), len(y)), pct)[0]
    a, b = segments(x, band, pct)[0], segments(y, band, pct)[0]
    return int((a != b).sum()), band_plan(band, pct)[0]


def linked(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    if min(len(x), len(y)) * 100 < max(len(x), len(y)) * pct or not len(x):
        return False
    far, most = distance(x, y, pct)
    if far > most:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= pct * (len(x) + len(y) - both)


def _class_hash(h: np.ndarray) -> int:
    """One 64-bit hash for a set, independent of order."""
    both = np.bitwise_xor.reduce(mix64(h + _M1), keepdims=True) + np.add.reduce(mix64(h ^ _M2), keepdims=True)
    return int(mix64(both + np.uint64(len(h))).view(np.int64)[0]) if len(h) else 0


def _sketches(k: int, pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes of this task whose keys have gone out
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids, sizes, classes, bits, found = batch.column(0), [], [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), k)
                sizes.append(len(h))
                bits.append(parity_bits(h))
                classes.append(_class_hash(h))
                found.append(none if classes[-1] in seen else keys(h, pct).view(np.int64))
                seen.add(classes[-1])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bits, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "class", "bits", "keys"])

    return run


def parity_bits(h: np.ndarray) -> bytes:
    """Each shingle flips one bit: the Hamming distance of two such sketches is at most the sets' difference."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(h) - 1).bit_length())) if len(h) else LEAST_BITS
    return np.packbits((np.bincount((mix64(h + _M2) % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def folded(bits: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to so many bytes: the halves' XOR is the sketch of half the bits."""
    out = np.empty((len(bits), size // 8), dtype=np.uint64)
    lengths = np.array([len(b) for b in bits])
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        x = np.frombuffer(b"".join(bits[i] for i in own), dtype=np.uint64).reshape(len(own), -1)
        while x.shape[1] > size // 8:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        out[own] = x
    return out


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py(), k).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "hashes"])

    return run


def near_pairs(node: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray, side: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block in different components whose sizes and sketches allow a link; ``side`` 0 meets 1, or 2 meets itself."""
    rows, cols = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    out_a, out_b = [], []
    for i in rows.tolist():
        j = cols[cols > i] if side[i] == 2 else cols
        j = j[comp[j] != comp[i]]
        low, high = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
        j = j[low * 100 >= high * pct]
        if len(j):
            far = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            j = j[far * (100 + pct) <= (n[j] + n[i]) * (100 - pct)]
            out_a.append(np.minimum(node[i], node[j]))
            out_b.append(np.maximum(node[i], node[j]))
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (node[:0], node[:0])


def _blocks(pct: int):
    """Rows come sorted by (key, x, y): each such block is compared as soon as it is complete."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        col = {c: t[c].to_numpy() for c in ("node", "comp", "n", "side")}
        bits = t["bits"].to_pylist()
        bits = folded(bits, min(map(len, bits)))
        a, b = near_pairs(col["node"], col["comp"], col["n"], bits, col["side"], pct)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch[c].to_numpy() for c in ("key", "x", "y")], axis=1)
            edges = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
                here = tuple(ids[begin].tolist())
                if held and here != last:
                    yield flush(held)
                    held = []
                held.append(batch.slice(begin, end - begin))
                last = here
        if held:
            yield flush(held)

    return run


def _near(pct: int):
    """Pairs whose sizes and parity sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch[c].to_numpy() for c in ("a_n", "b_n"))
            x, y = (batch[c].to_pylist() for c in ("a_bits", "b_bits"))
            size = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)], dtype=np.int64)
            far = np.zeros(len(size), dtype=np.int64)
            for k in np.unique(size).tolist():
                own = np.flatnonzero(size == k)
                far[own] = np.bitwise_count(folded([x[i] for i in own], k) ^ folded([y[i] for i in own], k)).sum(axis=1, dtype=np.int64)
            ok = (np.minimum(n, m) * 100 >= np.maximum(n, m) * pct) & (far * (100 + pct) <= (n + m) * (100 - pct))
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept["a"], kept["b"]], ["a", "b"])

    return run


def _verify(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [linked(*(np.asarray(c[i].values).view(np.uint64) for c in (x, y)), pct) for i in range(batch.num_rows)]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["src", "dst"])

    return run


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, pct: int = PCT) -> DataFrame:
    """Per row with an id: ``id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Texts are read for the sketches, and again for the exact sets of classes that have near candidates. The sketches'
    keys are removed from the shared folder once they have met. Ids must be integers, and ``pct`` 50 or more: sets of less
    similarity may lie further apart than the bands that are joined.
    """
    if not 50 <= pct <= 100:
        raise ValueError("pct must be from 50 to 100")
    need_integers(docs, id)
    spark = small_batches(docs.sparkSession)
    slim = docs.where(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    path = scratch_path(spark, "sketches")
    schema = "id long, n long, class long, bits binary, keys array<long>"
    slim.mapInArrow(_sketches(shingle, pct), schema).write.parquet(path)
    made = spark.read.schema(schema).parquet(path)
    rows = cut_lineage(made.select("id", "n", "class"), "classes")
    first = made.where("n > 0").groupBy("class").agg(F.min(F.struct("id", "n", "bits")).alias("x"))
    nodes = cut_lineage(first.select("class", F.col("x.id").alias("node"), "x.n", "x.bits"), "nodes")
    shared = cut_lineage(_shared(made), "shared-keys")
    remove_path(spark, path)

    edges = _links(slim, _distinct_keys(shared.join(nodes.select("class", "node"), "class").select("key", "node")), nodes, shingle, pct)
    merged = components(edges.select("src", "dst"), "jaccard")
    byclass = nodes.join(merged, nodes["node"] == merged["id"], "left").select("class", F.coalesce("component_id", "node").alias("component_id"))
    out = rows.join(byclass, "class", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("id")).alias("component_id"))


def _shared(made: DataFrame) -> DataFrame:
    """Members of the segments that several classes share, as distinct (key, class).

    One shuffle of (key, class), to which a task has sent each of its classes once. The window looks at the first
    class and one row back and ahead only, so a key shared by many classes streams through without being held.
    """
    each = made.select(F.explode("keys").alias("key"), "class")
    order = W.partitionBy("key").orderBy("class")
    near = each.withColumns({"first": F.first("class").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "next": F.lead("class").over(order)})
    return near.where("(next is null or next <> class) and (next is not null or first <> class)").select("key", "class")


def _distinct_keys(named: DataFrame) -> DataFrame:
    """Members of keys, one key for each set of members: others with the same members say the same."""
    named = cut_lineage(named, "shared-nodes")
    h = F.xxhash64("node")
    kinds = named.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.min("node").alias("a"), F.max("node").alias("b"))
    chosen = cut_lineage(kinds.groupBy("n", "x", "a", "b").agg(F.min("key").alias("key")).select("key"), "chosen-keys")
    return cut_lineage(named.join(chosen, "key", "left_semi"), "members")


def _links(slim: DataFrame, named: DataFrame, nodes: DataFrame, k: int, pct: int) -> DataFrame:
    """Verified links between the smallest ids of classes, enough to connect every component."""
    found, tested = None, None
    for turn in ("low", "high", "all"):
        current = named if found is None else _relabel(named, components(found, "jaccard-star"))
        if found is not None and current.isEmpty():
            break
        if turn == "all":
            pairs = _cross_pairs(current, nodes, pct).distinct()
        else:
            pairs = _star_pairs(current, turn).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if turn != "all":
            x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits")) for c in "ab")
            pairs = pairs.join(x, "a").join(y, "b").mapInArrow(_near(pct), "a long, b long")
        close = cut_lineage(pairs, "near-pairs")
        good = _verified(slim, close, k, pct)
        found = good if found is None else found.unionByName(good)
        tested = close if tested is None else tested.unionByName(close)
    return found


def _verified(slim: DataFrame, close: DataFrame, k: int, pct: int) -> DataFrame:
    """The pairs that are links, by the exact sets of their ends."""
    ends = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = cut_lineage(ends, "wanted")
    sets = cut_lineage(slim.join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(k), "node long, hashes array<long>"), "sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_h")) for c in "ab")
    full = close.join(x, "a").join(y, "b").select("a", "b", "a_h", "b_h")
    return cut_lineage(full.mapInArrow(_verify(pct), "src long, dst long"), "links")


def _relabel(named: DataFrame, merged: DataFrame) -> DataFrame:
    """Members of keys that still have several components, with their component."""
    named = named.select("key", "node").join(merged, named["node"] == merged["id"], "left").select("key", "node", F.coalesce("component_id", "node").alias("comp"))
    open_keys = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    return cut_lineage(named.join(open_keys, "key", "left_semi"), "open-keys")


def _star_pairs(members: DataFrame, turn: str) -> DataFrame:
    """Every member with its key's smallest or largest node."""
    centre = members.groupBy("key").agg((F.min if turn == "low" else F.max)("node").alias("c"))
    pairs = members.join(centre, "key").where("node <> c")
    return pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))


def _cross_pairs(members: DataFrame, nodes: DataFrame, pct: int) -> DataFrame:
    """Pairs of members of one key in different components that may be links.

    A key with more members than a block is dealt over blocks, and every two of them meet in a task of their own.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    full = members.join(sizes, "key").join(nodes.select("node", "n", "bits"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    full = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = full.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "node", "comp", "n", "bits")
    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node").mapInArrow(_blocks(pct), "a long, b long")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, pct: int = 80) -> DataFrame:
    """One document of every group: the one with the smallest id. Rows without id are kept; of repeated rows all stay."""
    found = jaccard_components(docs, id, text, shingle, pct)
    gone = free_name(docs, "gone")
    losers = found.where("component_id <> id").select(F.col("id").alias(gone)).distinct()
    return docs.join(losers, docs[f"`{id}`"].cast("long") == losers[gone], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document: three words, 90 percent."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).withColumnRenamed("id", "doc_id")
