"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of each word in both directions (long words in parts of bounded length) and gives every
position a distribution over languages. A document's distribution pools those of all its positions: the mean of their
logarithms, normalised again. The network is trained in numpy by backpropagation through time, on the driver, from a
bounded sample of rows: of every language the ``LANG_DOCS`` documents with the smallest hashes, so that a rare language is
learned on tables of any size, and of each ``DOC_WORDS`` words drawn by hash from the whole text in the task that reads it.
The sample grows with the number of languages only. Prediction reads every whole text; equal words of a task are read once and remembered up
to a bound.

Defined cases: ``und`` with score 0 for null texts, texts without a letter, and when nothing could be learned; texts of
any length are read whole; null languages are not learned from; equal rows get equal predictions; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import free_name, small_batches, table

LANG_DOCS, DOC_WORDS, TRAIN_WORDS = 400, 100, 120_000
#: Languages that are learned at most: the most frequent, as a dirty column may hold any number of values.
LANGUAGES = 500
HIDDEN, STEPS, BATCH, RATE = 20, 1600, 256, 0.01
PART = 24
CACHE_WORDS = 400_000
#: A letter of any script, by its Unicode category; numbers such as ½ or ² are none.
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """A bidirectional GRU with one output distribution a position. The input layer is a table of 256 rows a gate."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"out": draw(2 * hidden, classes, scale=0.1), "out_b": np.zeros(classes, np.float32)}
        for side in "fb":
            self.p[f"{side}_in"] = draw(256, 3 * hidden, scale=0.3)
            self.p[f"{side}_rec"] = draw(hidden, 3 * hidden, scale=hidden**-0.5)
            self.p[f"{side}_b"] = np.zeros(hidden, np.float32)

    def _scan(self, side: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (T, N, H) in the order of reading, and what the backward pass needs."""
        n, h = self.h, np.zeros((x.shape[1], self.h), np.float32)
        table_, rec, bias = self.p[f"{side}_in"], self.p[f"{side}_rec"], self.p[f"{side}_b"]
        out, tape = np.empty((*x.shape, n), np.float32), []
        for t in range(len(x)):
            a, u = table_[x[t]], h @ rec
            gates = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
            r, z = gates[:, :n], gates[:, n:]
            un = u[:, 2 * n :] + bias
            c = np.tanh(a[:, 2 * n :] + r * un)
            new = c + z * (h - c)
            if keep:
                tape.append((h, r, z, c, un))
            h = out[t] = new
        return out, tape

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities (T, N, C) of words given as bytes (T, N)."""
        both = np.concatenate([self._scan("f", x, False)[0], self._scan("b", x[::-1], False)[0][::-1]], axis=2)
        return _log_softmax(both @ self.p["out"] + self.p["out_b"])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        f, tape_f = self._scan("f", x, True)
        b, tape_b = self._scan("b", x[::-1], True)
        both = np.concatenate([f, b[::-1]], axis=2)
        logp = _log_softmax(both @ self.p["out"] + self.p["out_b"])
        rows = np.arange(x.shape[1])
        loss = -float(logp[:, rows, y].mean())
        d = np.exp(logp)
        d[:, rows, y] -= 1
        d /= x.size
        g = {"out": np.einsum("tnh,tnc->hc", both, d), "out_b": d.sum(axis=(0, 1))}
        dh = d @ self.p["out"].T
        self._back("f", x, tape_f, dh[:, :, : self.h], g)
        self._back("b", x[::-1], tape_b, dh[::-1, :, self.h :], g)
        return loss, g

    def _back(self, side: str, x: np.ndarray, tape: list, dout: np.ndarray, g: dict[str, np.ndarray]) -> None:
        rec = self.p[f"{side}_rec"]
        din, drec, dbias = np.zeros_like(self.p[f"{side}_in"]), np.zeros_like(rec), np.zeros(self.h, np.float32)
        carry = np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            h, r, z, c, un = tape[t]
            d = dout[t] + carry
            dc = d * (1 - z) * (1 - c * c)
            da = np.concatenate([dc * un * r * (1 - r), d * (h - c) * z * (1 - z), dc], axis=1)
            du = da.copy()
            du[:, 2 * self.h :] = dc * r
            dbias += du[:, 2 * self.h :].sum(axis=0)
            drec += h.T @ du
            carry = d * z + du @ rec.T
            np.add.at(din, x[t], da)
        g |= {f"{side}_in": din, f"{side}_rec": drec, f"{side}_b": dbias}


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def parts(text: str) -> list[bytes]:
    """The words of a text as bytes, long ones in parts of bounded length."""
    found = text.encode("utf-8", "surrogatepass").split()
    if all(len(w) <= PART for w in found):
        return found
    return [w[k : k + PART] for w in found for k in range(0, len(w), PART)]


def drawn_words(text: str) -> list[bytes]:
    """At most ``DOC_WORDS`` words of a whole text, drawn by a hash of the text."""
    own = parts(text)
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    return [own[i] for i in rng.choice(len(own), min(len(own), DOC_WORDS), replace=False)] if own else []


def train(texts: list[str] | list[list[bytes]], labels: list[str], steps: int = STEPS, seed: int = 7) -> dict | None:
    """Network weights and the languages they tell apart, from a bounded sample of texts or of their drawn words.

    Each language keeps an equal part of ``TRAIN_WORDS``, or all its words where they are fewer.
    """
    names = sorted(set(labels))
    if not names:
        return None
    number = {n: i for i, n in enumerate(names)}
    rng = np.random.default_rng(seed)
    of: list[list[bytes]] = [[] for _ in names]
    for text, label in zip(texts, labels, strict=True):
        of[number[label]] += drawn_words(text) if isinstance(text, str) else text
    most = max(1, TRAIN_WORDS // len(names))
    words = [(own[i], y) for y, own in enumerate(of) for i in rng.permutation(len(own))[:most]]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in sorted({len(w) for w, _ in words}):
        own = [w for w in words if len(w[0]) == n]
        by_length[n] = np.frombuffer(b"".join(w for w, _ in own), np.uint8).reshape(-1, n).T, np.array([y for _, y in own])
    net = Network(len(names), seed=seed)
    if not by_length:
        return None
    size = np.array([x.size for x, _ in by_length.values()], float)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    for step, n in enumerate(rng.choice(list(by_length), size=steps, p=size / size.sum()), 1):
        x, y = by_length[int(n)]
        pick = rng.integers(0, x.shape[1], BATCH)
        _, g = net.gradients(x[:, pick], y[pick])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1))) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, a in g.items():
            a = a * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.999 * v[k] + 0.001 * a * a
            net.p[k] = (net.p[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return {"names": names, "weights": net.p, "hidden": net.h}


class Predictor:
    """Applies a trained network to whole texts; remembers words."""

    def __init__(self, model: dict) -> None:
        self.names = model["names"]
        self.net = Network(len(self.names), model["hidden"])
        self.net.p = model["weights"]
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.sums = np.zeros((1024, len(self.names)))

    def _learn(self, words: list[bytes]) -> None:
        """Sums of the position log-probabilities of new words."""
        begin = len(self.place)
        self.place.update((w, begin + i) for i, w in enumerate(words))
        while len(self.sums) < len(self.place):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            for k in range(0, len(own), 4096):
                some = own[k : k + 4096]
                x = np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(-1, n).T
                self.sums[begin + some] = self.net.log_probs(x).sum(axis=0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for k in range(0, len(texts), 200):
            some = [parts(t) if t and LETTER.search(t) else [] for t in texts[k : k + 200]]
            if len(self.place) > CACHE_WORDS:
                self._forget()
            new = {w for own in some for w in own if w not in self.place}
            if new:
                self._learn(sorted(new))
            for own in some:
                if not own:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at = np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))
                total = self.sums[at].sum(axis=0) / sum(map(len, own))
                p = np.exp(total - total.max())
                langs.append(self.names[int(p.argmax())])
                scores.append(float(p.max() / p.sum()))
        return langs, scores


def training_rows(docs: DataFrame, id: str, text: str, lang: str, bound: int = LANG_DOCS) -> list:
    """Drawn words of a bounded sample per language, of the rows that may be learned from: those whose remainder is not 1.

    Languages are counted first, at most the ``LANGUAGES`` most frequent are learned, and only hashes in the range that twice the bound needs are read on; a task sends its
    smallest hashes of each language and no more.
    """
    known = docs.select(F.col(id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i")))
    counts = known.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES)
    share = counts.select("l", F.least(F.lit(1.0), 2.0 * bound / F.col("n")).alias("share"))
    near = known.withColumn("h", F.shiftrightunsigned(F.xxhash64("i", "t"), 1)).join(share, "l").where(F.col("h") <= F.col("share") * float(2**63))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"h": rows["h"], "l": rows["l"], "t": [drawn_words(t) for t in rows["t"]]})

    small_batches(docs.sparkSession)
    words = near.select("h", "l", "t").mapInPandas(draw, "h bigint, l string, t array<binary>")
    ranked = words.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("n") <= bound)
    return ranked.orderBy("l", "n").select("t", "l").collect()


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score, in the place of columns of these names. One pass over whole texts without a shuffle."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Predictor(shared.value) if shared.value else None
        for texts in batches:
            some = texts.astype(object).where(texts.notna(), None).tolist()
            langs, scores = judge.predict(some) if judge else ([UNKNOWN] * len(some), [0.0] * len(some))
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": np.array(scores, float)})

    name = free_name(docs, "judged")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"lang_pred", "score"}]
    return docs.withColumn(name, judged(F.col(f"`{text}`"))).select(*kept, f"{name}.lang_pred", f"{name}.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    rows = training_rows(docs, "doc_id", "text", "lang")
    model = train([r["t"] for r in rows], [r["l"] for r in rows])
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
