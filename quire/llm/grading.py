"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (poor), 1 (fair: good prose, but toxic) and 2 (good). One weight
vector over hashed text features is shared by all grades, and ordered thresholds
cut its score: P(grade <= k) = sigmoid(threshold_k - score). Features say which
words and word shapes a text has and how many of its five-word windows differ,
hashed to a fixed number of buckets; a proximal step keeps few of them.

Null or empty text has no feature and gets the grade that the thresholds alone
give. Rows are independent; a null id is passed through. Without ratings of two
grades at least, every text gets the middle of the scale. Of ratings of one doc_id
the lowest grade counts, and of texts of one doc_id the least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_chunks

BUCKETS = 1 << 16
#: Bound of the training sample: rated documents of each grade. Their texts are read whole.
TRAIN_DOCS = 1500
GRADES = 3
#: Chosen if the probability of the top grade is at least this.
MIN_TAIL = 0.5
_SHAPE = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "9" for c in range(48, 58)}})


class Model(NamedTuple):
    buckets: np.ndarray  # those with a weight, in order
    weights: np.ndarray
    thresholds: np.ndarray  # GRADES - 1, increasing


def shape(word: str) -> str:
    """Letters and digits by kind, runs cut to two: ``EDTH!!`` gives ``XX!!``."""
    out: list[str] = []
    for c in word.translate(_SHAPE):
        if c not in "xX9" and c.isalpha():
            c = "X" if c.isupper() else "x"
        if len(out) < 2 or out[-1] != c or out[-2] != c:
            out.append(c)
    return "".join(out)


def word_features(word: str) -> tuple[int, int]:
    """Buckets of a word and of its shape."""
    return zlib.crc32(word.strip(".,;:!?").lower().encode()) % BUCKETS, zlib.crc32(("shape " + shape(word)).encode()) % BUCKETS


class Features:
    """Sets of buckets of texts; the buckets of words are remembered, up to a bound."""

    def __init__(self):
        self.seen: dict[str, tuple[int, int]] = {}

    def of(self, text: str) -> set[int]:
        words = text.split()
        kinds = set(words)
        if len(self.seen) > 100_000:
            self.seen.clear()
        seen, out = self.seen, set()
        for w in kinds:
            f = seen.get(w)
            if f is None:
                f = seen[w] = word_features(w)
            out.update(f)
        if words:  # how much a text repeats itself: different five-word windows of all, in eighths
            windows = max(1, len(words) - 4)
            distinct = len(set(zip(*(words[k:] for k in range(5))))) if windows > 1 else 1
            out.add(zlib.crc32(b"distinct %d" % (8 * distinct // windows)) % BUCKETS)
        return out


def fit(rows: list[tuple[np.ndarray, int]], rounds: int = 300, sparsity: float = 4e-4) -> Model:
    """Maximise the likelihood of (buckets, grade) rows; accelerated proximal steps with an l1 penalty."""
    neutral = Model(np.empty(0, np.int64), np.empty(0), np.array([-1.0, 1.0]))
    if len({g for _, g in rows}) < 2:
        return neutral
    grade = np.array([g for _, g in rows])
    used, flat = np.unique(np.concatenate([f for f, _ in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    share = np.bincount(flat) / len(rows)
    scale = 1 / np.sqrt(share * (1 - share) + 0.002)  # rarer features are as free to move as frequent ones
    balance = (len(rows) / GRADES / np.maximum(np.bincount(grade, minlength=GRADES), 1))[grade]
    w, cut = np.zeros(len(used)), np.array([-0.5, 0.5])
    prev_w, prev_cut, best_step = w.copy(), cut.copy(), 0.01

    def loss_grad(w: np.ndarray, cut: np.ndarray):
        s = np.bincount(row, weights=(w * scale)[flat], minlength=len(rows))
        upper = np.where(grade < GRADES - 1, cut[np.minimum(grade, GRADES - 2)], np.inf) - s
        lower = np.where(grade > 0, cut[np.maximum(grade - 1, 0)], -np.inf) - s
        a, b = 1 / (1 + np.exp(-np.clip(upper, -500, 500))), 1 / (1 + np.exp(-np.clip(lower, -500, 500)))
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p * balance, b * (1 - b) / p * balance
        g_cut = np.array([-(da * (grade == k)).sum() + (db * (grade == k + 1)).sum() for k in range(GRADES - 1)])
        g_w = np.bincount(flat, weights=(da - db)[row], minlength=len(used)) * scale
        return -(np.log(p) * balance).mean(), g_w / len(rows), g_cut / len(rows)

    for r in range(rounds):
        mom = r / (r + 3)
        yw, yc = w + mom * (w - prev_w), cut + mom * (cut - prev_cut)
        loss, gw, gc = loss_grad(yw, yc)
        while True:
            nw = yw - best_step * gw
            nw = np.sign(nw) * np.maximum(np.abs(nw) - best_step * sparsity, 0)
            nc = np.sort(yc - best_step * gc)
            dw, dc = nw - yw, nc - yc
            if loss_grad(nw, nc)[0] <= loss + gw @ dw + gc @ dc + (dw @ dw + dc @ dc) / (2 * best_step) + 1e-12 or best_step < 1e-6:
                break
            best_step /= 2
        prev_w, prev_cut, w, cut = w, cut, nw, nc
        best_step *= 1.1
    keep = w != 0
    return Model(used[keep], (w * scale)[keep], cut)


def rated(docs: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, int]]:
    """Features and grades of at most TRAIN_DOCS documents of each grade: those whose hashed id is lowest."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null")
    own = own.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    some = None
    for g in range(GRADES):
        part = own.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
        some = part if some is None else some.unionAll(part)
    chosen = {r.doc_id: r.grade for r in some.collect()}  # bounded by GRADES * TRAIN_DOCS
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features()
        for part in text_chunks(batches):
            rows = [sorted(own.of(t or "")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([np.array(r, dtype="<u2").tobytes() for r in rows], pa.binary())], names=["doc_id", "f"])

    texts = id_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = texts.mapInArrow(run, "doc_id long, f binary").orderBy("doc_id").collect()
    return [(np.frombuffer(bytes(r.f), dtype="<u2").astype(np.int64), chosen[r.doc_id]) for r in found]


def fit_grades(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(rated(docs, labels))


def grade(docs: DataFrame, model: Model, min_tail: float = MIN_TAIL) -> DataFrame:
    """Per row: doc_id, score, expected_grade, p_fair (grade 1 or more), p_good (grade 2) and selected."""
    weight = np.zeros(BUCKETS)
    weight[model.buckets] = model.weights
    cut = model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = Features(), weight.tolist()
        for part in text_chunks(batches):
            s = np.array([sum(map(table.__getitem__, sorted(own.of(t or "")))) for t in part.column("text").to_pylist()])
            tail = 1 / (1 + np.exp(np.clip(cut[None, :] - s[:, None], -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (s, tail.sum(axis=1), tail[:, 0], tail[:, 1], tail[:, 1] >= min_tail))], names=["doc_id", "score", "expected_grade", "p_fair", "p_good", "selected"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double, expected_grade double, p_fair double, p_good double, selected boolean")
