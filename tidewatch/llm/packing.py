"""Best-fit packing by patterns: non-negative least squares on the length histogram.

Documents are tokenised with an end token; longer ones than a sequence are cut so that only the first piece is shorter.
The histogram of piece lengths, at most one number per length, comes to the driver. There all patterns of up to three
lengths that fill a sequence are enumerated, repeat counts are fitted to the histogram by accelerated projected
gradient (non-negative least squares), rounded so that no length is used more often than it occurs, and what remains is
packed best-fit with equal bins handled together; its effort depends on the number of lengths, not of documents. The
fit is tried at a few dampings and the one with the fewest sequences is taken.

Every piece gets a rank among the pieces of its length: lengths are split over buckets of bounded size, ranks are
numbered inside a bucket and shifted by the counts of the buckets before. A rank names sequence and offset by binary search
in the plan, whose size is bounded by the number of patterns.

Defined cases: null and empty texts are the end token alone; special strings in a text become their ids, as the
tokenizer does by default; rows without id and repeated rows are packed like any other; an empty table gives an empty
result; other columns are not needed and are left out.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewatch.llm.common import small_batches, table
from tidewatch.session import cut_lineage

SEQUENCE = 1024
END_ID = 2
DAMPINGS = (1.0, 0.9, 0.75, 0.5)
FIT_STEPS = 300
BUCKET_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def _encoders(json_path: str, ranks_path: str):
    """The tokenizer, and the faster library with the same vocabulary for texts without special strings."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    return exact, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(text: str, paths: tuple[str, str]) -> list[int]:
    exact, fast, special = _encoders(*paths)
    if not any(x in text for x in special):
        try:
            return fast.encode_ordinary(text)
        except Exception:  # noqa: BLE001  its pattern engine refuses some extreme texts
            pass
    return exact.encode(text, add_special_tokens=False).ids


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the size."""
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def _pieces(paths: tuple[str, str], size: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or "", paths), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    part = ids[start : start + length]
                    rows.append((doc, k, start, length, zlib.crc32(part.tobytes())))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def patterns(counts: np.ndarray) -> np.ndarray:
    """All (i, j, k) of present lengths with i >= j >= k that fill a sequence; a missing part is 0."""
    size = len(counts) - 1
    here = counts > 0
    out = []
    for i in np.flatnonzero(here[:size]):
        j = np.arange(min(i, size - i), 0, -1)
        k = size - i - j
        good = (k <= j) & here[j] & ((k == 0) | here[np.maximum(k, 0)])
        out.append(np.stack([np.full(int(good.sum()), i), j[good], k[good]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def fit(counts: np.ndarray, shapes: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts of the patterns: min |w (A x - counts)|, x >= 0, by accelerated projected gradient.

    Missing a short length costs little, as what remains of it fits anywhere.
    """
    size = len(counts) - 1
    weight = np.clip(np.arange(size + 1) / (size / 4), 0.1, 1.0) ** 2
    used = lambda x: sum(np.bincount(shapes[:, c], weights=x, minlength=size + 1) for c in range(3))
    weight[0] = 0.0
    in_patterns = np.maximum(used(np.ones(len(shapes))), 1.0)
    step = 1.0 / np.max((weight * in_patterns)[shapes].sum(axis=1)) if len(shapes) else 0.0
    x = np.full(len(shapes), 0.0)
    y, t = x, 1.0
    for _ in range(steps):
        r = weight * (used(y) - counts)
        new = np.maximum(0.0, y - step * r[shapes].sum(axis=1))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def rounded(counts: np.ndarray, shapes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts that the histogram can pay for, largest first, and what remains of it."""
    left, out = counts.copy(), np.zeros(len(shapes), dtype=np.int64)
    for p in np.argsort(-x, kind="stable"):
        if (n := int(np.floor(x[p] + 0.5))) <= 0:
            break
        parts, times = np.unique(shapes[p][shapes[p] > 0], return_counts=True)
        if n := min(n, int((left[parts] // times).min())):
            out[p] = n
            left[parts] -= n * times
    return out, left


def best_fit(left: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram: (contents as (length, times) pairs, number of such bins)."""
    size = len(left) - 1
    open_bins: list[list[tuple[tuple[tuple[int, int], ...], int]]] = [[] for _ in range(size + 1)]
    for length in range(size, 0, -1):
        c = int(left[length])
        while c:
            room = next((r for r in range(length, size) if open_bins[r]), size)
            contents, bins = open_bins[room].pop() if room < size else ((), -(-c // (size // length)))
            if bins <= c:
                q = min(room // length, c // bins)
            else:
                if room < size:
                    open_bins[room].append((contents, bins - c))
                q, bins = 1, c
            open_bins[room - q * length].append(((*contents, (length, q)), bins))
            c -= q * bins
    return [b for bins in open_bins for b in bins]


def plan(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: intervals of ranks with first sequence and offset, by length and rank."""
    counts = counts.astype(np.int64)
    size = len(counts) - 1
    part = counts.copy()
    part[size] = 0
    shapes = patterns(part)
    x = fit(part.astype(float), shapes) if len(shapes) else np.zeros(0)
    tried = []
    for damping in DAMPINGS:
        n, left = rounded(part, shapes, x * damping)
        rest = best_fit(left)
        tried.append((int(n.sum()) + sum(b for _, b in rest), n, rest))
    _, n, rest = min(tried, key=lambda t: t[0])
    filled = [(((size, 1),), int(counts[size]))] if counts[size] else []
    for p in np.flatnonzero(n):
        parts, times = np.unique(shapes[p][shapes[p] > 0], return_counts=True)
        filled.append((tuple(zip(parts.tolist(), times.tolist(), strict=True)), int(n[p])))
    used, rows, sequence = np.zeros(size + 1, dtype=np.int64), [], 0
    for contents, bins in [*filled, *rest]:
        offset = 0
        for length, times in contents:
            # The ranks of a length run through all bins for the first place, then for the next: one interval in all.
            rows.append((length, used[length], sequence, bins, offset))
            used[length] += times * bins
            offset += times * length
        sequence += bins
    assert (used[1:] == counts[1:]).all()
    table_ = np.array(rows, dtype=np.int64).reshape(-1, 5)
    table_ = table_[np.lexsort((table_[:, 1], table_[:, 0]))]
    first = np.searchsorted(table_[:, 0], np.arange(size + 2))
    return {"first": first, "rank": table_[:, 1], "sequence": table_[:, 2], "bins": table_[:, 3], "offset": table_[:, 4], "n": np.array(sequence)}


def place(lengths: np.ndarray, ranks: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    key = np.repeat(np.arange(len(p["first"]) - 1), np.diff(p["first"]))
    top = int(max(p["rank"].max(initial=0), ranks.max(initial=0))) + 1
    at = np.searchsorted(key * top + p["rank"], lengths * top + ranks, side="right") - 1
    turn, bin_ = np.divmod(ranks - p["rank"][at], p["bins"][at])
    return p["sequence"][at] + bin_, p["offset"][at] + turn * lengths


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            sequence, offset = place(cols["length"].to_numpy(), cols.pop("rank").to_numpy(), shared.value)
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(sequence), pa.array(offset)], [*cols, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SEQUENCE, end_id: int = END_ID,
    paths: tuple[str, str] | None = None, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if they are kept.

    Texts are tokenised once; the pieces are written to the shared folder, and only their numbers are shuffled.
    """
    spark = small_batches(docs.sparkSession)
    schema = PIECES + ", ids array<int>" * keep_ids
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = cut_lineage(slim.mapInArrow(_pieces(paths or tokenizer_paths(), size, end_id, keep_ids), schema), "pieces")
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # a row per length at most
        counts[length] = n
    shared = spark.sparkContext.broadcast(plan(counts))
    buckets = F.array(*(F.lit(int(-(-n // BUCKET_ROWS) or 1)) for n in counts))
    split = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(buckets, (F.col("length") + 1).cast("int")).cast("long")))
    sizes = split.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    base = cut_lineage(sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = split.withColumn("r", inside).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    columns = [c for c in pieces.columns]
    return ranked.select(*columns, "rank").mapInArrow(_assign(shared), schema + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
