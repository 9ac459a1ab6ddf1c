"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding lowers the case, drops invisible characters, maps look-alike letters of other scripts and accented letters to plain
ones, and undoes digit and symbol substitutions; the letters l and i are one, as 1 stands for both. Lexicon entries
are whole words or word beginnings. An entry counts where it begins a word (and ends one, if it is whole), unless an
exception phrase covers it. The score is a logistic function of the weighted hits divided by the text's length in words.

The lexicon is a short fixed list, and what is learned from labelled rows: words and word beginnings that toxic documents
have after more different words than chance allows, weighted by their log odds; phrases of two words in which an entry is harmless become
exceptions. Learning uses a bounded sample: of the rows that may be learned from, the ``TRAIN_TOXIC`` toxic and
``TRAIN_CLEAN`` other ones with the smallest hashes. Scoring reads every whole text.

Defined cases: null and empty texts have no hits and get the lowest score; texts of any length are read whole; without
labelled rows the fixed list is used with fixed calibration; equal rows get equal scores; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded_sample, small_batches, table

TRAIN_TOXIC, TRAIN_CLEAN = 4000, 8000
SHORTEST, LONGEST, MOST_ENTRIES = 4, 8, 1000
#: Words added to a text's length, so that one hit in a very short text doesn't count without measure.
PAD_WORDS = 20

# Insults and phrases in which they are harmless, in natural order.
SEEDS = ("disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "worthless")
EXCEPTIONS = ("clown fish", "class clown", "idiot proof", "pathetic fallacy", "trash bag", "trash bin", "trash can")
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ʟ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"!": "i", "|": "i", "$": "s", "@": "a", "+": "t", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿"
# End of the fixed values.


def _folding() -> dict[int, str | None]:
    """Accented and compatibility letters by their decomposition; the tables above; l and i are one."""
    out: dict[int, str | None] = {}
    for c in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x))
        if plain != chr(c) and plain.isascii() and plain.isalnum():
            out[c] = plain
    out |= {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()} | {ord(c): None for c in INVISIBLE} | {c: None for c in range(0x300, 0x370)}
    return {k: v and "".join(DIGITS.get(x, x) for x in v).replace("l", "i") for k, v in out.items()} | {ord("l"): "i"}


_FOLD = _folding()
_BETWEEN = re.compile(r"(?<=[^\W_])[!|$@+€](?=[^\W_])|[$@](?=[^\W\d_]{2})")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if any(c in text for c in SYMBOLS):
        text = _BETWEEN.sub(lambda m: SYMBOLS[m[0]], text)
    return text.translate(_FOLD)


class Lexicon:
    """entries: (folded text, whole word, weight); exceptions: folded phrases."""

    def __init__(self, entries: list[tuple[str, bool, float]], exceptions: list[str]) -> None:
        self.tree = ahocorasick.Automaton()
        merged: dict[str, list[tuple[bool, float | None]]] = {}
        for text, whole, weight in entries:
            merged.setdefault(text, []).append((whole, weight))
        for text in exceptions:
            merged.setdefault(text, []).append((True, None))
        for text, kinds in merged.items():
            self.tree.add_word(text, (len(text), kinds))
        if merged:
            self.tree.make_automaton()

    def weight(self, folded: str) -> float:
        """Summed weights of the hits that no exception covers; of entries that begin at one place the heaviest counts."""
        if not len(self.tree):
            return 0.0
        hits: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, kinds) in self.tree.iter(folded):
            start = end - n + 1
            if start and folded[start - 1].isalnum():
                continue
            ends = end + 1 == len(folded) or not folded[end + 1].isalnum()
            for whole, weight in kinds:
                if ends or not whole:
                    if weight is None:
                        free.append((start, end))
                    else:
                        hits[start] = max(hits.get(start, 0.0), weight)
        return sum(w for s, w in hits.items() if not any(a <= s <= b for a, b in free))


def feature(folded: str, lexicon: Lexicon) -> float:
    """Weighted hits per hundred words, on a log scale."""
    w = lexicon.weight(folded)
    return math.log1p(100 * w / (len(_WORD.findall(folded)) + PAD_WORDS)) if w else 0.0


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features_of(text: str) -> set[str]:
    """Whole words (with a mark) and word beginnings."""
    words = set(_WORD.findall(fold(text)))
    return {f"{w}." for w in words if SHORTEST <= len(w) <= 24} | {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per feature and label, summed in the task."""
    both: tuple[Counter, Counter] = Counter(), Counter()
    for rows in batches:
        for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
            both[int(toxic)].update(_features_of(text))
    clean, bad = both
    yield _counts(clean, bad)


def _counts(clean: Counter, bad: Counter) -> pd.DataFrame:
    names = [*{*clean, *bad}]
    return pd.DataFrame({"f": pd.Series(names, dtype=object), "t": np.array([bad[x] for x in names], np.int64), "n": np.array([clean[x] for x in names], np.int64)})


def _varied(names: set[str]):
    """Candidates of toxic documents with the word before: copies of one document say the same thing once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str]] = set()
        for rows in batches:
            for text in rows["text"]:
                before = ""
                for w in _WORD.findall(fold(text)):
                    own = (f"{w}.", *(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1)))
                    seen.update((f, before) for f in own if f in names)
                    before = w
        yield pd.DataFrame(list(seen), columns=["f", "before"], dtype=object)

    return run


def _choose(rows: list[tuple[str, int, int]], toxic: int, clean: int, n_features: int) -> list[tuple[str, bool, float]]:
    """Entries by evidence, without those that say what a stronger one has said."""
    odds = lambda t, n: math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
    weighed = sorted(((t * odds(t, n), f.endswith("."), len(f), f, t, n) for f, t, n in rows if odds(t, n) > math.log(8)), reverse=True)
    need = (math.log(max(2, n_features)) + 3) / math.log(1 + clean / max(1, toxic))
    out: list[tuple[str, bool, float]] = []
    taken: dict[str, int] = {}
    for _, whole, _, f, t, n in weighed:
        text = f.rstrip(".")
        near = [c for x, c in taken.items() if x.startswith(text) or text.startswith(x)]
        if t < need or any(t <= 1.3 * c for c in near):
            continue
        taken[text] = t
        out.append((text, whole, min(6.0, odds(t, n))))
        if len(out) == MOST_ENTRIES:
            break
    return out


def _contexts(folded: str, tree: Lexicon) -> set[str]:
    """Two-word phrases with an entry in one of the words."""
    words = _WORD.findall(folded)
    hit = [bool(tree.weight(w)) for w in words]
    return {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, with a small ridge so that separable rows don't run away."""
    z, b = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), z.T @ (y - p) - 0.05 * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> dict:
    """The model: entries, exceptions and calibration. Only the sample's counts and one number a document reach the driver."""
    seeds = [(fold(w), True, 3.0) for w in SEEDS]
    model = {"entries": seeds, "exceptions": [fold(p) for p in EXCEPTIONS], "a": -3.0, "b": 4.0}
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("k"), (F.col("toxic") != 0).cast("int").alias("toxic"))
    known = known.groupBy("k").agg(F.max("toxic").alias("toxic"))
    chosen = [bounded_sample(known.where(F.col("toxic") == y), F.xxhash64("k"), n, "k") for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    some = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most TRAIN_TOXIC + TRAIN_CLEAN rows
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("k"), F.col(text).alias("text")).join(some, "k").select("text", "toxic")
    rows = rows.persist()
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if toxic and clean:
        counts = rows.mapInPandas(_counted, "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        strong = counts.where(f"t >= 3 and t * {clean} > 8 * n * {toxic}").orderBy(F.desc("t"), "n", "f").limit(20 * MOST_ENTRIES)
        got = {r["f"]: r["n"] for r in strong.collect()}
        varied = rows.where("toxic = 1").mapInPandas(_varied(set(got)), "f string, before string").distinct().groupBy("f").count()
        got = [(r["f"], min(r["count"], toxic), got[r["f"]]) for r in varied.collect()]
        entries = _choose(got, toxic, clean, 30 * (toxic + clean))
        model["entries"] = entries + [s for s in seeds if s[0] not in {e[0] for e in entries}]
        found = rows.mapInPandas(_harmless(model["entries"]), "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        model["exceptions"] += [r["f"] for r in found.where("n >= 3 and n > 20 * t").orderBy(F.desc("n"), "f").limit(MOST_ENTRIES).collect()]
        xy = rows.mapInPandas(_measured(model), "x double, y int").collect()
        model["a"], model["b"] = _logistic(np.array([r["x"] for r in xy]), np.array([r["y"] for r in xy], float))
    rows.unpersist()
    return model


def _harmless(entries: list):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, both = Lexicon(entries, []), (Counter(), Counter())
        for rows in batches:
            for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
                folded = fold(text)
                if lexicon.weight(folded):
                    both[int(toxic)].update(_contexts(folded, lexicon))
        yield _counts(*both)

    return run


def _measured(model: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model["entries"], model["exceptions"])
        for rows in batches:
            yield pd.DataFrame({"x": [feature(fold(t), lexicon) for t in rows["text"]], "y": rows["toxic"].astype("int32")})

    return run


def score(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """The score of a text column, in one pass without a shuffle."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model["entries"], model["exceptions"])
        for texts in batches:
            x = np.array([feature(fold(t), lexicon) for t in texts.fillna("")], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(model["a"] + model["b"] * x, -30, 30))))

    return scored(F.col(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs, labels)
    out = docs.withColumn("score", score(docs, model)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
