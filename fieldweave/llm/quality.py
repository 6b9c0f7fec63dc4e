"""Quality classifier by co-training.

Two views of a document: its content (words, their shapes and repetition) and the metadata of its page (source, language, lengths and line layout). Each view has a logistic model.
Over rounds each model labels the documents of an unlabelled pool of which it is sure and hands them to the other. Both are then calibrated on labelled documents that took no part
(Platt scaling), and every document of the table is scored by the mean of the calibrated log-odds.

The labelled sample and the pool are bounded (SAMPLE, POOL documents); all documents are scored, over whole texts.

Cases: null text is an empty text, null metadata a value of its own; repeated rows get equal scores; labels of documents that are absent, or null, are not used, and of an id with two labels
the lower holds; with labels of one kind only (or none) every document scores the share of good labels (or 0.5); an empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE, POOL, ROUNDS, SURE, PER_ROUND = 3000, 2000, 4, 0.97, 200
DIM, STATS = 1 << 15, 6
#: Words of which repetition counts the distinct ones, one stretch after the other, so that it does not grow with length.
SPAN = 400
_RUNS = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0")]


def shape(word: bytes) -> bytes:
    """Letters and digits as classes, punctuation as it is: what a word looks like."""
    for pattern, to in _RUNS:
        word = pattern.sub(to, word)
    return word[:12]


class Slots(dict):
    """Feature numbers of a word: itself and its shape; bounded memory."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = (xxhash.xxh3_64_intdigest(word.lower()) % DIM, DIM + xxhash.xxh3_64_intdigest(b"/" + shape(word)) % DIM)
        return out


def content(text: bytes | None, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (repeated as they occur) and dense statistics."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.int64), np.array([1.0, 0, 0, 0, 0, 0])
    at = np.fromiter((x for w in words for x in slots[w]), np.int64, 2 * len(words))
    own, n = at[::2], len(words)
    again = float(np.mean(own[1:] == own[:-1])) if n > 1 else 0.0
    seen = sum(len(np.unique(own[i : i + SPAN])) for i in range(0, n, SPAN)) / n
    upper = sum(map(bytes.isupper, words)) / n
    return at, np.array([1.0, again, 1 - seen, upper, np.log1p(n) / 10, len(text or b"") / n / 10])


def metadata(text: bytes | None, source: str | None, lang: str | None) -> np.ndarray:
    """Feature numbers of what the page says about the document without its words."""
    t = text or b""
    lines = t.count(b"\n") + 1
    marks = (f"s={source}", f"l={lang}", f"n={len(t).bit_length()}", f"k={lines.bit_length()}", f"w={(len(t) // lines).bit_length()}", "bias")
    return np.array([xxhash.xxh3_64_intdigest(m.encode()) % 4096 for m in marks], np.int64)


@dataclass
class Logistic:
    """L2 logistic model by full-batch Adam over sparse mean features and dense statistics."""

    dim: int
    stats: int
    w: np.ndarray = field(default=None)
    d: np.ndarray = field(default=None)

    def _raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self.one(a, s) for a, s in rows])

    def one(self, at: np.ndarray, stats: np.ndarray) -> float:
        return float((self.w[at].mean() if len(at) else 0.0) + self.d @ stats)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 60) -> None:
        owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
        at = np.concatenate([a for a, _ in rows])
        key, back = np.unique(owner * self.dim + at, return_inverse=True)
        count = np.bincount(back)
        owner, at = key // self.dim, key % self.dim
        share = count / np.maximum(np.array([len(a) for a, _ in rows]), 1)[owner]
        stats = np.stack([s for _, s in rows])
        self.w, self.d = np.zeros(self.dim), np.zeros(self.stats)
        m = [np.zeros(self.dim), np.zeros(self.stats)]
        v = [np.zeros(self.dim), np.zeros(self.stats)]
        total = weight.sum()
        for t in range(1, epochs + 1):
            z = np.bincount(owner, share * self.w[at], len(rows)) + stats @ self.d
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
            grads = [np.bincount(at, share * g[owner], self.dim) + 1e-6 * self.w, stats.T @ g + 1e-6 * self.d]
            for k, (p, grad) in enumerate(zip((self.w, self.d), grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                p -= 0.3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of p = sigmoid(a z + b), by Newton steps on smoothed targets; a view that tells nothing gets a slope near 0."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    ab = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        ab = ab - np.linalg.solve(h, x.T @ (p - t) + 1e-3 * ab)
    return float(max(ab[0], 0.0)), float(ab[1])


@dataclass
class CoModel:
    views: list[Logistic]
    scale: list[tuple[float, float]]
    constant: float | None = None

    def scores(self, at: np.ndarray, stats: np.ndarray, meta: np.ndarray) -> tuple[float, float, float]:
        if self.constant is not None:
            return (self.constant,) * 3
        odds = [a * z + b for z, (a, b) in zip((self.views[0].one(at, stats), self.views[1].one(meta, np.ones(1))), self.scale, strict=True)]
        p = [float(1 / (1 + np.exp(-np.clip(o, -30, 30)))) for o in (*odds, sum(odds) / 2)]
        return p[0], p[1], p[2]


def co_train(labelled: list[tuple], pool: list[tuple], rounds: int = ROUNDS, sure: float = SURE, per_round: int = PER_ROUND) -> CoModel:
    """labelled: (text, source, lang, label); pool: (text, source, lang). Every fifth labelled row is kept for calibration."""
    y = np.array([r[3] for r in labelled], float)
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return CoModel([], [], float(y.mean()) if len(y) else 0.5)
    slots = Slots()
    sees = [lambda r: content(r[0], slots), lambda r: (metadata(*r[:3]), np.ones(1))]
    shapes = [(2 * DIM, STATS), (4096, 1)]
    known, free = [[f(r) for r in labelled] for f in sees], [[f(r) for r in pool] for f in sees]
    calibrate = np.arange(len(y)) % 5 == 0
    fit = np.flatnonzero(~calibrate)
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view was given by the other
    models: list[Logistic] = []
    scale: list[tuple[float, float]] = []
    for turn in range(rounds + 1):
        models, scale = [], []
        for k in range(2):
            rows = [known[k][i] for i in fit] + [free[k][i] for i in given[k]]
            model = Logistic(*shapes[k])
            # Classes weigh alike; a pseudo-label weighs half a label.
            labels = np.concatenate([y[fit], np.fromiter(given[k].values(), float, len(given[k]))])
            weight = np.concatenate([np.ones(len(fit)), np.full(len(given[k]), 0.5)])
            weight = weight / np.where(labels > 0, weight[labels > 0].sum(), weight[labels <= 0].sum())
            model.fit(rows, labels, weight)
            models.append(model)
            scale.append(platt(model._raw([r for r, c in zip(known[k], calibrate, strict=True) if c]), y[calibrate]))
        if turn == rounds or not pool:
            break
        for k in range(2):
            p = 1 / (1 + np.exp(-(scale[k][0] * models[k]._raw(free[k]) + scale[k][1])))
            for label, score in ((1.0, p), (0.0, 1 - p)):
                order = [i for i in np.argsort(-score, kind="stable") if i not in given[1 - k] and score[i] >= sure][:per_round]
                given[1 - k].update((int(i), label) for i in order)
    return CoModel(models, scale)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> CoModel:
    """First rows by a hash of the id, up to the bounds: counts set a hash cutoff, and only rows below it are read."""
    spread = F.pmod(F.xxhash64(F.col(id_col), F.lit(23)), F.lit(1_000_000))
    view = [F.col(text_col).alias("t"), *(F.col(c).cast("string").alias(n) if c in docs.columns else F.lit(None).cast("string").alias(n) for c, n in (("source", "s"), ("lang", "l")))]
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("y"))
    n_known, n_docs = known.count(), docs.count()

    def first(df: DataFrame, n: int, most: int) -> list:
        near = df.filter(F.col("h") < min(1_000_000, int(2_000_000 * most / max(n, 1)) + 1))
        rows = near.orderBy("h", "id", "t").limit(most).collect()
        return [(r["t"].encode() if r["t"] is not None else None, r["s"], r["l"], *((float(r["y"] > 0),) if "y" in df.columns else ())) for r in rows]

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col), *view, spread.alias("h"))
    named = known.withColumn("hk", spread).filter(F.col("hk") < min(1_000_000, int(2_000_000 * sample / max(n_known, 1)) + 1)).drop("hk")
    labelled = first(rows.join(named, id_col).withColumnRenamed(id_col, "id"), n_known, sample)
    near = rows.filter(F.col("h") < min(1_000_000, int(2_000_000 * pool / max(n_docs - n_known, 1)) + 1))
    free = first(near.join(known.select(id_col), id_col, "left_anti").withColumnRenamed(id_col, "id"), n_docs - n_known, pool)
    return co_train(labelled, free)


def score(docs: DataFrame, model: CoModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, content_score, metadata_score, score (probability that the quality is good), good."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    view = docs.select(F.col(id_col), F.col(text_col).alias("text"), *(F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch, texts in slices(batches, "text"):
            rows = [held.value.scores(*content(t, slots), metadata(t, s, g)) for t, s, g in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            cols = [pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "content_score", "metadata_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return view.mapInArrow(scan, f"`{id_col}` {kind}, content_score double, metadata_score double, score double").withColumn("good", F.col("score") >= 0.5)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    return score(docs, train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col), id_col, text_col)
