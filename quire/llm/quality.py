"""Quality rules by line sequence labelling.

Every line is an observation of binary features. A linear-chain conditional
random field with the labels *boilerplate* (0) and *content* (1), fitted on a
bounded sample of labelled documents, is decoded with Viterbi's algorithm; the
share of a document's words that stands in content lines decides retention.

Ratings are of documents, so the labels of the lines are latent: a mixture of
two kinds of lines is fitted by expectation and maximisation, in which a line of a
good document is content with probability SHARE[1] and one of a poor document with
SHARE[0]. A poor text's clean lines are thus content, and a good text's junk
isn't. The chains of the field are the whole texts of the sample, in pieces of
CHAIN lines.

Null or empty text has no words and fails the base rule. Rows are independent,
so repeated rows get equal answers; a null id is passed through. With no
labelled rows the fixed prior weights below are used unfitted. Of ratings of one
doc_id the lowest counts, and of texts of one doc_id the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_chunks, through

#: Bound of the training sample: labelled documents of each class.
TRAIN_DOCS = 300
#: Lines of a training chain; longer texts are several chains.
CHAIN = 200
#: Probability that a line of a poor and of a good document is content, before its features are seen.
SHARE = (0.1, 0.95)
#: A document stays if this share of its words is in content lines.
MIN_CONTENT = 0.5
SYMBOLS = b"#*$%&|<>"

FEATURES = (
    "bias", "no_word", "words_1_3", "words_4_9", "words_10_29", "words_30_up", "symbol_some", "symbol_many", "upper_some", "upper_many",
    "digit_many", "ends_sentence", "bang_many", "dup_line", "repeat_some", "repeat_many", "same_word_twice", "long_words", "letters_few", "first_line",
)
#: Weights for content before any fit: only what speaks against it by itself.
PRIOR = {"bias": 1.0, "symbol_many": -2.0, "upper_many": -2.0, "dup_line": -1.5, "repeat_many": -2.0, "letters_few": -1.0}


class Model(NamedTuple):
    weight: np.ndarray  # of each feature for content, 0 for boilerplate
    step: np.ndarray  # 2 x 2 transition scores


class Lines(NamedTuple):
    mask: np.ndarray  # feature bits of each line
    words: np.ndarray  # words of each line
    line_at: np.ndarray  # where each text's lines begin; one more than texts
    base: dict[str, np.ndarray]  # counts of each text


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_SPACE, _SYMBOL, _UPPER, _DIGIT = _table(b" \t\n\x0b\x0c\r"), _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"0123456789")
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123))) | (np.arange(256) >= 0xC2)  # lead bytes beyond ASCII count as letters
_LEAD, _STOP, _BANG = (np.arange(256) & 0xC0) != 0x80, _table(b".!?:;"), _table(b"!?")


def _repeated(ids: np.ndarray, doc: np.ndarray, width: int = 5) -> np.ndarray:
    """Of words: whether the word is in a window of ``width`` that its text has twice or more."""
    n, hit = len(ids), np.zeros(len(ids) + 1, dtype=np.int32)
    if n < width:
        return hit[:n].astype(bool)
    key = doc[: n - width + 1].astype(np.uint64)
    for k in range(width):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - width + 1 + k].astype(np.uint64)
    key ^= key >> np.uint64(32)
    at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    some = order[same[1:] | same[:-1]]
    if len(some):  # equal hashes: compare the windows themselves
        rows = np.stack([doc[some], *(ids[some + k] for k in range(width))], axis=1)
        rank = np.zeros(len(some), dtype=np.int64)
        for c in rows.T:
            rank = np.unique(rank * (int(c.max()) + 1) + c, return_inverse=True)[1]
        twice = some[np.bincount(rank)[rank] > 1]
        np.add.at(hit, twice, 1)
        np.add.at(hit, twice + width, -1)
    return np.cumsum(hit)[:n] > 0


def observe(texts: list[str]) -> Lines:
    """Base counts of texts and feature bits of their lines."""
    blobs = [t.encode() for t in texts]
    raw = b"\n".join(blobs) + b"\n" if blobs else b""
    b = np.frombuffer(raw, dtype=np.uint8)
    doc_end = np.cumsum(np.fromiter((len(x) + 1 for x in blobs), dtype=np.int64, count=len(blobs)))
    line_end = np.flatnonzero(b == 10)  # each text's last line ends at the joint
    line_begin = np.concatenate(([0], line_end[:-1] + 1))
    line_at = np.concatenate(([0], np.searchsorted(line_end, doc_end - 1, side="left") + 1))
    line_doc = np.repeat(np.arange(len(texts)), np.diff(line_at))

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[line_end] - total[line_begin]

    def per_doc(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(x)))
        return total[line_at[1:]] - total[line_at[:-1]]

    space, lead = _SPACE[b], _LEAD[b]
    starts = ~space
    starts[1:] &= space[:-1]
    words, chars = per_line(starts), per_line(lead & ~space)
    symbols, upper, letters, digits, bangs = (per_line(t[b]) for t in (_SYMBOL, _UPPER, _LETTER, _DIGIT, _BANG))
    first: dict[bytes, int] = {}
    split = raw.split()
    ids = np.fromiter(map(first.setdefault, split, range(len(split))), dtype=np.int64, count=len(split))
    word_line = np.repeat(np.arange(len(words)), words)
    word_doc = line_doc[word_line]
    rep = _repeated(ids, word_doc)
    repeats = np.bincount(word_line, weights=rep, minlength=len(words)).astype(np.int64)
    again = np.zeros(len(ids), dtype=bool)
    again[1:] = (ids[1:] == ids[:-1]) & (word_line[1:] == word_line[:-1])
    twice = np.bincount(word_line, weights=again, minlength=len(words))
    dup = np.zeros(len(words), dtype=bool)
    lines, begin, end = raw.split(b"\n"), line_at[:-1].tolist(), line_at[1:].tolist()
    for a, z in zip(begin, end):
        seen: set[bytes] = set()
        if z - a > 1:
            for i in range(a, z):
                x = lines[i]
                if x in seen:
                    dup[i] = words[i] > 0
                else:
                    seen.add(x)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    last = b[np.maximum(line_end - 1, 0)] if len(b) else b
    at_first = np.zeros(len(words), dtype=bool)
    at_first[line_at[:-1]] = True
    flags = (
        np.ones(len(words), dtype=bool), words == 0, (words > 0) & (words < 4), (words > 3) & (words < 10), (words > 9) & (words < 30), words > 29, (symbols * 50 > c) & (symbols * 10 <= c), symbols * 10 > c,
        (upper * 4 > letters) & (upper * 2 <= letters), (upper * 2 > letters) & (upper > 3), digits * 5 > c, (words > 0) & _STOP[last], bangs * 4 > w, dup, (repeats * 10 > w) & (repeats * 2 <= w), repeats * 2 > w,
        twice * 5 > w, chars > 14 * w, letters * 2 < chars, at_first,
    )
    mask = np.zeros(len(words), dtype=np.int64)
    for k, f in enumerate(flags):
        mask |= f.astype(np.int64) << k
    base = {"n_words": per_doc(words), "word_chars": per_doc(chars), "n_symbols": per_doc(symbols), "n_dup_lines": per_doc(dup.astype(np.int64)), "n_repeat_words": per_doc(repeats)}
    return Lines(mask, words, line_at, base)


def bits(mask: np.ndarray) -> np.ndarray:
    return ((mask[..., None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)


def prior() -> Model:
    return Model(np.array([PRIOR.get(f, 0.0) for f in FEATURES]), np.array([[0.5, 0.0], [0.0, 0.5]]))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 90, rate: float = 0.2, ridge: float = 1e-3) -> Model:
    """Maximise the conditional likelihood of labelled chains (feature bits, labels) by gradient steps (Adam)."""
    chains = [c for c in chains if len(c[0])]
    model = prior()
    if len({int(y) for _, ys in chains for y in ys}) < 2:
        return model
    n, t = len(chains), max(len(m) for m, _ in chains)
    mask, gold, there = np.zeros((n, t), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (m, y) in enumerate(chains):
        mask[i, : len(m)], gold[i, : len(m)], there[i, : len(m)] = m, y, True
    kinds, kind = np.unique(mask, return_inverse=True)
    kind, x = kind.reshape(n, t), bits(kinds)
    k = len(FEATURES)
    theta = np.concatenate((model.weight, model.step.ravel()))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    pair_gold = np.zeros((2, 2))
    both = there[:, 1:] & there[:, :-1]
    np.add.at(pair_gold, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for r in range(1, rounds + 1):
        e = np.zeros((n, t, 2))
        e[..., 1] = (x @ theta[:k])[kind]
        step = theta[k:].reshape(2, 2)
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = e[:, 0]
        for i in range(1, t):
            fwd[:, i] = np.where(there[:, i, None], e[:, i] + _lse(fwd[:, i - 1, :, None] + step, 1), fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            bwd[:, i] = np.where(there[:, i + 1, None], _lse(step[None] + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2), 0.0)
        z = _lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])[..., 1] * there
        diff = np.bincount(kind[there], weights=(gold - p)[there], minlength=len(kinds))
        pair = np.exp(fwd[:, :-1, :, None] + step + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        grad = np.concatenate((diff @ x, (pair_gold - pair.sum(axis=(0, 1))).ravel())) / there.sum() - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return Model(theta[:k], theta[k:].reshape(2, 2))


def viterbi(score: list[float], step: list[list[float]]) -> list[int]:
    """Best labels of one chain; ``score``: of content against boilerplate. Ties go to content."""
    (s00, s01), (s10, s11) = step
    a, c, back = 0.0, score[0], []
    for e in score[1:]:
        stay, fall, rise, keep = a + s00, c + s10, a + s01, c + s11
        back.append((int(fall >= stay), int(keep >= rise)))
        a, c = max(stay, fall), max(rise, keep) + e
    y = [int(c >= a)]
    for b in reversed(back):
        y.append(b[y[-1]])
    return y[::-1]


def line_labels(masks: list[np.ndarray], quality: list[int], rounds: int = 20) -> list[np.ndarray]:
    """Most probable labels of lines, given feature bits and the documents' ratings; lines that a text has had before are boilerplate."""
    if not masks:
        return []
    mask, q = np.concatenate(masks), np.repeat(quality, [len(m) for m in masks])
    kinds, kind = np.unique(mask, return_inverse=True)
    x, dup = bits(kinds), (kinds >> FEATURES.index("dup_line")) & 1 == 1
    # Lines of one kind in documents of one rating are alike, so a table of counts is enough.
    count = np.stack([np.bincount(kind[q == c], minlength=len(kinds)) for c in (0, 1)]).astype(np.float64)
    odds = np.log(np.array(SHARE) / (1 - np.array(SHARE)))[:, None]
    p = np.broadcast_to(np.array(SHARE)[:, None], count.shape) * ~dup
    for _ in range(rounds):
        one, two = ((count * w).sum(axis=0) for w in (p, 1 - p))
        a, b = ((w @ x + 1) / (w.sum() + 2) for w in (one, two))
        gain = x @ np.log(a / b) + (1 - x) @ np.log((1 - a) / (1 - b))
        p = np.where(dup, 0.0, 1 / (1 + np.exp(-np.clip(odds + gain, -50, 50))))
    label = (p[q, kind] >= 0.5).astype(np.int64)
    return np.split(label, np.cumsum([len(m) for m in masks])[:-1])


def labelled_chains(docs: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature bits and line labels of at most TRAIN_DOCS documents of each class: those whose hashed id is lowest."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = None
    for q in (0, 1):
        part = own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
        some = part if some is None else some.unionAll(part)
    chosen = {r.doc_id: r.quality for r in some.collect()}  # bounded by 2 * TRAIN_DOCS
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            seen = observe([t or "" for t in part.column("text").to_pylist()])
            rows = [seen.mask[a:z].tolist() for a, z in zip(seen.line_at, seen.line_at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "mask"])

    texts = id_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = texts.mapInArrow(run, "doc_id long, mask array<long>").orderBy("doc_id").collect()
    masks = [np.array(r.mask, dtype=np.int64) for r in found]
    chains = zip(masks, line_labels(masks, [chosen[r.doc_id] for r in found]))
    return [(m[k : k + CHAIN], y[k : k + CHAIN]) for m, y in chains for k in range(0, len(m), CHAIN)]


def verdicts(texts: list[str], model: Model, min_content: float = MIN_CONTENT) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, words in content lines, their share, and kept."""
    step, seen = model.step.tolist(), observe(texts)
    score = (bits(seen.mask) @ model.weight).tolist()
    at = seen.line_at.tolist()
    label = np.fromiter((y for a, z in zip(at, at[1:]) for y in viterbi(score[a:z], step)), dtype=np.int64, count=len(score))
    total = np.concatenate(([0], np.cumsum(label * seen.words)))
    content = total[seen.line_at[1:]] - total[seen.line_at[:-1]]
    n, rep = seen.base["n_words"], seen.base["n_repeat_words"]
    failed = (n < 10) | (100 * rep > 20 * n)
    share = content / np.maximum(n, 1)
    return seen.base, failed, content, share, ~failed & (share >= min_content)


def quality_rules(docs: DataFrame, model: Model, min_content: float = MIN_CONTENT) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, content_words, content_share and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            base, *rest = verdicts([t or "" for t in part.column("text").to_pylist()], model, min_content)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(base[k]) for k in names), *map(pa.array, rest)], names=["doc_id", *names, "base_failed", "content_words", "content_share", "kept"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_words long, content_share double, kept boolean")


def keep_good(docs: DataFrame, model: Model, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows that are kept, with all their columns."""
    return through(docs, lambda part: part.filter(pa.array(verdicts([t or "" for t in part.column("text").to_pylist()], model, min_content)[-1])))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled_chains(docs, labels))
