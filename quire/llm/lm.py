"""Language-model scoring with a probabilistic suffix tree.

Tokens are lower-cased words and one end a text; every word is a symbol of its
own. Contexts are suffixes of the words read so far, to MAX_DEPTH words, where a
text begins with a mark. A context is retained if it passes a divergence test: the
left-one-out log-likelihood gain of its next-word distribution over that of its
own suffix, N(s) times an unbiased estimate of their divergence, must exceed
MIN_GAIN. No frequency or share decides: a context whose next words are all
different has no gain, and next words seen once add the same to the gain whatever
the suffix says, so that only runs of words seen MIN_PAIR times are kept.
Distributions are smoothed by absolute discounting of these towards the next
shorter retained suffix, down to the word frequencies. A token is scored in the
state of its longest retained suffix.

All counts are over all training texts, and what is gathered grows with them. The
texts are read once; their words' 64-bit hashes, by chunk, are a written table.
A run of k words is known by the hash of the two runs of k - 1 words in it, its
context and its parent. A run seen twice has both seen twice, so of the runs of k
words only those are counted whose halves are kept: a sieve of fixed size spares
most others, and what passes it is counted exactly. Each length takes two steps
over buckets. Runs are dealt by their parent, counted, and given the parent's
probability; then by their context, whose total is its own count as a run one word
shorter, and of which next words seen once are what the others leave. There the
test is made and the distribution smoothed. Parents seen HOT times or more are
spread over all buckets, and their values broadcast; contexts seen HOT times or
more are tested by aggregation instead. Both are few: HOT is a number of tokens,
and grows with the corpus so that at most HOT_KEYS can have it.

A token's log probability is a sum: of its word's, of log(back) for each retained
context, and of log(p / (back * p of suffix)) for each run in it. For all but words
the chunks send the keys they need, by text, and get sums by text.

Null text counts as empty: one token, the end. A null id is hashed as empty
text. Rows are scored one by one, so repeated rows get equal scores. Without any
training text N is 0 and all tokens are unknown. What goes to a bucket
has the low 48 bits of a key, by which the bucket's own table, of bounded size, gives
the whole one: a false match has a chance of about 4e-9. Probabilities of contexts
and runs are single precision, those of words double.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded_words, cut, drop, give_back, id_text, partitions, text_chunks

MAX_DEPTH, DISCOUNT, MIN_GAIN, MIN_PAIR = 4, 0.5, 10.0, 2
#: Tokens of a hot run, and the most hot runs of one length (more raise the number of tokens).
HOT, HOT_KEYS = 4_000_000, 100_000
#: Tokens for which keys are made at once.
ASKED = 250_000
#: Values of the most frequent runs that every task has at hand, a power of two: 24 MB for any corpus.
HEAD = 1 << 20
#: Bytes of text of a chunk: larger ones repeat more of their words.
CHUNK = 6 << 20
#: Tokens a bucket on average.
BUCKET = 1_000_000
#: 64-bit words of the sieve: 16 MB for any corpus.
SIEVE = 1 << 21
END_WORD, BEGIN_WORD = b" end", b" begin"  # no word has a space


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def held_out(ids: list[int | None]) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i is None else b"%d" % i) % 5 == 1 for i in ids), dtype=bool, count=len(ids))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def joined(context: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The key of a run of words from those of its context and its parent."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + parent)


def as_context(key: np.ndarray) -> np.ndarray:
    """The key under which log(back) of a run as a context is filed."""
    return mix(key ^ np.uint64(0xA0761D6478BD642F))


class Chunk(NamedTuple):
    """Texts as words: a mark, the words and the end of each."""

    hashes: np.ndarray  # of the distinct words, the mark and the end, in order
    index: np.ndarray  # of all tokens into hashes
    counts: np.ndarray  # tokens of each text, with mark and end
    train: np.ndarray  # of each text

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def chunk(texts: pa.Array, train: np.ndarray) -> Chunk:
    import xxhash

    words, index, size = coded_words(texts)
    words = words.cast(pa.large_binary())
    raw, ends = (words.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(words.buffers()[1] or bytes(8), np.int64)[words.offset :][: len(words) + 1].tolist()
    words = [*(raw[i:j] for i, j in zip(ends, ends[1:])), BEGIN_WORD, END_WORD]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    counts = size + 2
    ends = np.cumsum(counts)
    full = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    inner = np.ones(len(full), dtype=bool)
    inner[ends - 1] = inner[ends - counts] = False
    full[inner], full[ends - counts], full[ends - 1] = index, len(words) - 2, len(words) - 1
    return Chunk(hashes[order], rank[full], counts, train)


_CHUNKS = "cid long, ids binary, some binary, hashes binary, idx binary, counts binary, train binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_chunks(batches, CHUNK):
        ids = part.column("doc_id")
        c = chunk(part.column("text"), ~held_out(ids.to_pylist()))
        rows = [ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), c.hashes, planes(c.index, len(c.hashes)), c.counts, c.train]
        yield pa.RecordBatch.from_arrays([part.column("uid").slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in rows)], names=["cid", "ids", "some", "hashes", "idx", "counts", "train"])


def planes(index: np.ndarray, kinds: int) -> np.ndarray:
    """Indices by byte, the low ones first, as many as ``kinds`` needs: the high ones are nearly all alike."""
    return np.stack([(index >> 8 * k).astype(np.uint8) for k in range((max(kinds - 1, 1).bit_length() + 7) // 8)])


def from_planes(raw: bytes, size: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, size) if size else np.zeros((1, 0), np.uint8)
    out = rows[-1].astype(np.uint32 if len(rows) <= 4 else np.int64)
    for x in rows[-2::-1]:
        out <<= out.dtype.type(8)
        out |= x
    return out.astype(np.int64)


def _each(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Chunk]]:
    for i in range(table.num_rows):
        get = lambda name, kind: np.frombuffer(table.column(name)[i].as_py(), kind)  # noqa: B023, E731
        counts = get("counts", np.int64)
        yield table.column("cid")[i].as_py(), Chunk(get("hashes", np.uint64), from_planes(table.column("idx")[i].as_py(), int(counts.sum())), counts, get("train", bool))


class Sieve:
    """Bits of keys. It only spares work: what passes it is looked up or counted exactly."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = key >> np.uint64(3)
        at &= np.uint64(8 * len(self.bits) - 1)
        found = self.bits.view(np.uint8).take(at.view(np.int64))  # by byte: less to move
        found >>= key.astype(np.uint8) & np.uint8(7)
        found &= np.uint8(1)
        return found.view(bool)

    def add(self, rows: DataFrame) -> None:
        """Set the bits of the keys in a column of bytes that begin with them (m of each row): SIEVE words go to the driver."""
        size = 64 * len(self.bits)
        ranges = min(16, len(self.bits))
        each = size // ranges

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    keys = np.concatenate([np.frombuffer(r, np.uint64, n) for r, n in zip(b.column("rows").to_pylist(), b.column("m").to_pylist())])
                    place = (keys & np.uint64(size - 1)).astype(np.int64)
                    kinds, parts = dealt(place // each, (place % each).astype(np.uint32))
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(parts, pa.binary())], names=["r", "rows"])

        def mark(t: pa.Table) -> pa.Table:
            bits = np.zeros(each, dtype=bool)
            for r in t["rows"].to_pylist():
                bits[np.frombuffer(r, np.uint32)] = True
            return pa.table({"r": t["r"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        found = rows.select("m", "rows").mapInArrow(send, "r long, rows binary").groupBy("r").applyInArrow(mark, "r long, bits binary").toArrow()
        words = each // 64
        for r, bits in zip(found["r"].to_pylist(), found["bits"].to_pylist()):
            self.bits[r * words : (r + 1) * words] |= np.frombuffer(bits, np.uint64)


def runs(c: Chunk, passes: Sieve | None, depth: int, words: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 2 to ``depth`` + 1, of the runs of k words: place of the last word, key, key of the context, key of the parent.

    With a sieve only of the runs whose halves pass it; ``words`` says which of the chunk's words do.
    """
    key, inside = c.hashes[c.index], np.ones(len(c.index), dtype=bool)
    inside[np.cumsum(c.counts) - c.counts] = False
    if passes is not None:
        good = (passes(c.hashes) if words is None else words)[c.index]
        inside[1:] &= good[1:] & good[:-1]
    at = np.flatnonzero(inside)
    context, parent = key[at - 1], key[at]
    for left in range(depth - 1, -1, -1):
        made = joined(context, parent)
        yield at, made, context, parent
        if not left:
            return
        if passes is not None:
            good = passes(made)
            at, made = at[good], made[good]
        both = np.flatnonzero(at[1:] - at[:-1] == 1)  # the context of a run ends one word before it
        context, parent = made[both], made[both + 1]
        at = at[both + 1]


def by_bucket(b: np.ndarray) -> np.ndarray:
    """A stable order of buckets; of small numbers by radix."""
    return np.argsort(b.astype(np.uint16) if len(b) and b.max() < 1 << 16 else b, kind="stable")


#: Keys are dealt and matched by these bits.
LOW = np.uint64((1 << 48) - 1)


def dealt(b: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Buckets in order, and the columns of each one's rows as bytes one after another."""
    order = by_bucket(b)
    kinds, start = np.unique(b[order], return_index=True)
    cols = tuple(c[order] for c in cols)
    ends = np.append(start[1:], len(b))
    return kinds, [b"".join(c[i:j].tobytes() for c in cols) for i, j in zip(start.tolist(), ends.tolist())]


def gathered(rows: pa.ChunkedArray, *kinds: str) -> list[np.ndarray]:
    """The columns of all rows of a bucket."""
    types = [np.dtype(k) for k in kinds]
    width, out = sum(t.itemsize for t in types), [[np.empty(0, t)] for t in types]
    for r in rows.to_pylist():
        n, at = len(r) // width, 0
        for t, x in zip(types, out):
            x.append(np.frombuffer(r, t, n, at))
            at += n * t.itemsize
    return [np.concatenate(x) for x in out]


def short(key: np.ndarray) -> bytes:
    """The low 48 bits of keys, six bytes each."""
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def widened(raw: bytes | memoryview) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def spot(key: np.ndarray) -> np.ndarray:
    """A number of a key's low bits of its own; buckets are ranges of it."""
    return mix((key & LOW) * np.uint64(0x9E3779B97F4A7C15))


def bucket(key: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(spot(key), n)


def bucket_of(place: np.ndarray, n: int) -> np.ndarray:
    x = place >> np.uint64(32)
    x *= np.uint64(n)
    x >>= np.uint64(32)
    return x.view(np.int64)


def find(ordered: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in an ascending column, and which are there."""
    if not len(ordered):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(ordered, keys)
    at[at == len(ordered)] = 0
    return at, ordered[at] == keys


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of a column, where each run of equal values begins in that order, and the number of each row's run."""
    order, first = firsts(key)
    return order, first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))


def firsts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool))


def count_words(chunks: DataFrame) -> DataFrame:
    """Training count of every word's hash, of the end's and of the mark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in (c for b in batches for _, c in _each(b)):
            n = np.bincount(c.index[np.repeat(c.train, c.counts)], minlength=len(c.hashes))
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(c.hashes[some].view(np.int64)), pa.array(n[some])], names=["h", "n"])

    return chunks.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Hot(NamedTuple):
    """Runs of one length that are seen very often, in order of their keys' low bits."""

    key: np.ndarray
    n: np.ndarray
    p: np.ndarray
    lp: np.ndarray


#: Tables by bucket: rows of (b, m, rows), m runs as columns of bytes.
_ROWS = "b long, m long, rows binary"
_FILED, _FOUND, _VALUE = ("u8", "i8", "f4", "f4"), ("u8", "u8", "i8", "f4", "f4"), ("u8", "f4", "f4")
_PAIRS = "b long, hot boolean, rows binary"


def table_of(key: np.ndarray, n: int, *cols: np.ndarray) -> dict[str, pa.Array]:
    """Rows of (b, m, rows) with a key and its columns, by the bucket of the key."""
    b = bucket(key, n)
    kinds, rows = dealt(b, key, *cols)
    return {"b": pa.array(kinds, pa.int64()), "m": pa.array(np.bincount(b, minlength=n)[kinds] if len(b) else np.zeros(0, np.int64)), "rows": pa.array(rows, pa.binary())}


def packed(rows: DataFrame, n: int, names: tuple[str, ...], types: tuple[str, ...]) -> DataFrame:
    """A table by bucket of rows with a key h and other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key = b.column("h").to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_pydict(table_of(key, n, *(b.column(c).to_numpy().astype(t) for c, t in zip(names, types))))

    return rows.select("h", *names).mapInArrow(run, _ROWS)


def hot_runs(before: DataFrame, total: int) -> Hot:
    """At most HOT_KEYS: each has more than a HOT_KEYS-th part of all tokens."""
    least = max(HOT, -(-total // HOT_KEYS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n, p, lp = gathered(pa.chunked_array([b.column("rows")]), *_FILED)
            some = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (h.view(np.int64), n, p, lp)], names=["h", "n", "p", "lp"])

    t = before.select("rows").mapInArrow(run, "h long, n long, p float, lp float").toArrow()
    key = t["h"].to_numpy().view(np.uint64)
    order = np.argsort(key & LOW)
    return Hot(key[order], *(t[c].to_numpy()[order] for c in ("n", "p", "lp")))


def count_runs(chunks: DataFrame, before: DataFrame, passes: Sieve, hot: Hot, k: int, n: int) -> DataFrame:
    """Runs of k words seen MIN_PAIR times in training texts, by the bucket of their context: context, parent, count, p and lp of the parent."""
    share = chunks.sparkSession.sparkContext.broadcast((passes.bits, hot))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = share.value
        for c in (c for b in batches for _, c in _each(b)):
            found, words = [[np.empty(0, np.uint64)] * 3], Sieve(bits)(c.hashes)
            c = Chunk(c.hashes, c.index[np.repeat(c.train, c.counts)], c.counts[c.train], c.train[c.train])
            for _, part in pieces(c, ASKED):
                for _, *own in runs(part, Sieve(bits), k - 1, words):  # noqa: B007
                    pass
                found.append(own)
            key, context, parent = (np.concatenate(x) for x in zip(*found))
            order, first = firsts(key)
            times = np.diff(np.append(first, len(key)))
            context, parent = context[order[first]], parent[order[first]]
            spread = parent ^ np.where(find(hot.key & LOW, parent & LOW)[1], mix(context), np.uint64(0)) if len(hot.key) else parent
            place = spot(spread)
            order = np.argsort(place)  # by bucket, and rows of a parent together
            context, parent, times, b = context[order], parent[order], times[order].astype(np.uint32), bucket_of(place[order], n)
            new = np.r_[True, (parent[1:] != parent[:-1]) | (b[1:] != b[:-1])] if len(b) else np.zeros(0, bool)
            kinds, start = np.unique(b, return_index=True)
            rows = []
            for i, j in zip(start.tolist(), [*start[1:].tolist(), len(b)]):  # a parent once, and how many rows it has
                at = np.flatnonzero(new[i:j])
                rows.append(b"".join((np.array([len(at), j - i]).tobytes(), np.diff(np.append(at, j - i)).astype(np.uint32).tobytes(), times[i:j].tobytes(), short(parent[i:j][at]), short(context[i:j]))))
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(rows, pa.binary())], names=["b", "rows"])
        give_back()

    def read(r: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, size = np.frombuffer(r, np.int64, 2).tolist()
        repeat, times = np.frombuffer(r, np.uint32, m, 16), np.frombuffer(r, np.uint32, size, 16 + 4 * m)
        at = 16 + 4 * (m + size)
        view = memoryview(r)
        return widened(view[at + 6 * m :]), np.repeat(widened(view[at : at + 6 * m]), repeat), times.astype(np.int64)

    def count(sent: pa.Table, filed: pa.Table) -> pa.Table:
        hot = share.value[1]
        parts = [read(r) for r in sent["rows"].to_pylist()]
        none = np.zeros(0, np.uint64)
        context, parent, times = (np.concatenate([none, *x]) for x in (zip(*parts) if parts else ((), (), ())))
        del parts
        order, first = firsts(joined(context, parent))
        total = np.add.reduceat(times[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        some = total >= MIN_PAIR
        at, total = order[first[some]], total[some]
        order = np.argsort(at)  # as sent, by spot: near keys are looked up together
        context, parent, total = context[at[order]], parent[at[order]], total[order]
        h, _, p, lp = gathered(filed["rows"], *_FILED)
        spots = spot(h)
        by = np.argsort(spots)
        at, there = find(spots[by], spot(parent))
        often, is_hot = find(hot.key & LOW, parent)
        whole, p, lp = (np.where(is_hot, x[often] if len(x) else 0, y[by][at] if len(y) else 0).astype(t) for x, y, t in ((hot.key, h, "u8"), (hot.p, p, "f4"), (hot.lp, lp, "f4")))
        ok = there | is_hot
        context, parent, total, p, lp = context[ok], whole[ok], total[ok], p[ok], lp[ok]
        wide = find(hot.key & LOW, context)[1]
        out = []
        for flag, some in ((False, ~wide), (True, wide)):
            kinds, rows = dealt(bucket(context[some], n), context[some], parent[some], total[some], p[some], lp[some])
            out.append(pa.table({"b": kinds, "hot": np.full(len(kinds), flag), "rows": pa.array(rows, pa.binary())}))
        give_back()
        return pa.concat_tables(out)

    sent = chunks.mapInArrow(send, "b long, rows binary")
    return sent.groupBy("b").cogroup(before.groupBy("b")).applyInArrow(count, _PAIRS)


def left_out(n, total, kinds, p):
    """What a next word adds to the gain of its context, on numbers or columns."""
    log = F.log if hasattr(n, "isNotNull") else np.log
    return n * log((n - 1 - DISCOUNT + DISCOUNT * kinds * p) / ((total - 1) * p))


_LEVEL = f"{_ROWS}, kind int"


def level_of(runs: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...], n: int) -> pa.Table:
    """Kept runs (kind 0: key, count, p, lp) and values (kind 1: key, value, how often it is asked for), by bucket."""
    parts = []
    for kind, (key, *cols), types in ((0, runs, _FILED), (1, values, _VALUE)):
        cells = table_of(key.astype(np.uint64), n, *(c.astype(t) for c, t in zip(cols, types[1:])))
        parts.append(pa.table({**cells, "kind": pa.array(np.full(len(cells["b"]), kind), pa.int32())}))
    return pa.concat_tables(parts)


def test_contexts(pairs: DataFrame, before: DataFrame, n: int) -> DataFrame:
    """Kept runs and the values of runs in retained contexts and of these contexts, under their keys as contexts."""

    def solve(sent: pa.Table, filed: pa.Table) -> pa.Table:
        context, parent, c, p, lp = gathered(sent["rows"], *_FOUND)
        order, first, group = groups(context)
        context, parent, c, p, lp = context[order], parent[order], *(x[order].astype(np.float64) for x in (c, p, lp))
        h, seen, _, _ = gathered(filed["rows"], *_FILED)
        by = np.argsort(h & LOW)
        at, there = find((h & LOW)[by], context[first])
        total = np.where(there, seen[by][at] if len(h) else 0, 0).astype(np.float64)
        state = h[by][at] if len(h) else context[first]  # the whole keys of the contexts
        sums = lambda x: np.bincount(group, weights=x, minlength=len(first))
        kept = sums(np.ones(len(context)))
        ones = total - sums(c)
        kinds = ones + kept
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sums(left_out(c, total[group], kinds[group], p)) + np.where(ones > 0, ones * np.log(DISCOUNT * kinds / (total - 1)), 0.0)
        back = (ones + DISCOUNT * kept) / np.maximum(total, 1)
        ok = gain >= MIN_GAIN
        new = np.where(ok[group], np.log((c - DISCOUNT) / total[group] + back[group] * np.exp(lp)), lp)
        v = np.where(ok[group], new - lp - np.log(back[group]), np.nan)
        some, in_some = np.flatnonzero(ok), ok[group]
        h = joined(state[group], parent)
        values = (np.concatenate((h[in_some], as_context(state[some]))), np.concatenate((v[in_some], np.log(back[some]))), np.concatenate((c[in_some], total[some])))
        give_back()
        return level_of((h, c, c / total[group], new), values, n)

    return pairs.groupBy("b").cogroup(before.groupBy("b")).applyInArrow(solve, _LEVEL)


def test_hot(pairs: DataFrame, hot: Hot, n: int) -> DataFrame:
    """The same for the runs in hot contexts, by aggregation."""
    spark = pairs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, parent, c, p, lp = gathered(pa.chunked_array([b.column("rows")]), *_FOUND)
            context = hot.key[find(hot.key & LOW, context)[0]]
            h = joined(context, parent)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), context.view(np.int64), as_context(context).view(np.int64), c, p.astype(np.float64), lp.astype(np.float64))], names=["h", "ctx", "state", "n", "p", "lp"])

    rows = pairs.select("rows").mapInArrow(run, "h long, ctx long, state long, n long, p double, lp double")
    totals = F.broadcast(spark.createDataFrame(list(zip(hot.key.view(np.int64).tolist(), hot.n.tolist())), "ctx long, total long"))
    sums = rows.groupBy("ctx", "state").agg(F.sum("n").alias("seen"), F.count("n").alias("kept")).join(totals, "ctx")
    sums = sums.withColumn("ones", F.col("total") - F.col("seen")).withColumn("kinds", F.col("ones") + F.col("kept"))
    rows = rows.join(F.broadcast(sums), ["ctx", "state"])  # at most HOT_KEYS contexts
    single = F.when(F.col("ones") > 0, F.col("ones") * F.log(DISCOUNT * F.col("kinds") / (F.col("total") - 1))).otherwise(0.0)
    gain = F.sum(left_out(F.col("n"), F.col("total"), F.col("kinds"), F.col("p")))
    back = (F.col("ones") + DISCOUNT * F.col("kept")) / F.col("total")
    kept = rows.groupBy("ctx", "state", "total", "ones", "kinds", "kept").agg(gain.alias("gain")).where(F.col("gain") + single >= MIN_GAIN).select("ctx", "state", "total", back.alias("back"))
    new = F.when(F.col("back").isNotNull(), F.log((F.col("n") - DISCOUNT) / F.col("total") + F.col("back") * F.exp("lp"))).otherwise(F.col("lp"))
    out = rows.join(F.broadcast(kept.select("ctx", "back")), "ctx", "left")
    out = out.select("h", "n", (F.col("n") / F.col("total")).alias("p"), new.alias("lp"), (new - F.col("lp") - F.log("back")).alias("v"))
    values = out.where("v is not null").select("h", "v", F.col("n").alias("w")).unionAll(kept.select("state", F.log("back"), "total"))
    level = packed(out, n, ("n", "p", "lp"), _FILED[1:]).withColumn("kind", F.lit(0))
    return level.unionAll(packed(values, n, ("v", "w"), _VALUE[1:]).withColumn("kind", F.lit(1)))


def tree(chunks: DataFrame, words: DataFrame, total: int, scale: float, n: int) -> tuple[list[DataFrame], Sieve, int]:
    """Tables whose rows of kind 1 are the values of runs and of retained contexts, one for each length; the sieve of kept runs; the depth of the tree."""
    p = (F.col("n") + 0.5) / scale
    kept = words.where(F.col("n") >= MIN_PAIR).select("h", "n", p.alias("p"), F.log(p).alias("lp"))
    before = cut(packed(kept, n, ("n", "p", "lp"), _FILED[1:]), "pst-words")
    passes, levels, depth = Sieve(np.zeros(SIEVE, np.uint64)), [], 0
    first = before
    passes.add(before)
    for k in range(2, MAX_DEPTH + 2):
        hot = hot_runs(before, total)
        pairs = count_runs(chunks, before, passes, hot, k, n)
        if len(hot.key):
            pairs = cut(pairs, f"pst-{k}")
        found = test_contexts(pairs.where("not hot").select("b", "rows"), before, n)
        if len(hot.key):
            found = found.unionAll(test_hot(pairs.where("hot"), hot, n))
        level = cut(found, "pst-level", ("kind",))
        if len(hot.key):
            drop(pairs)
        drop(*([] if levels else [first]))
        if levels:
            drop(levels[-1], part="kind=0")
        levels.append(level)
        before = level.where("kind = 0").select("b", "m", "rows")
        if not values_of(level).isEmpty():
            depth = k - 1
        if before.isEmpty():
            break
        passes.add(before)
    drop(levels[-1], part="kind=0")
    return levels, passes, depth


def values_of(level: DataFrame) -> DataFrame:
    return level.where("kind = 1").select("b", "m", "rows")


class Head(NamedTuple):
    """A table of the most frequent values by the low bits of their keys; of two keys in one place the more frequent is here."""

    key: np.ndarray
    v: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = keys & np.uint64(len(self.key) - 1)
        there = self.key[at] == keys
        return there, self.v[at[there]]


def head(values: DataFrame) -> Head:
    """The most frequent runs and contexts, HEAD at most."""

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = gathered(pa.chunked_array([b.column("rows")]), *_VALUE)[2]
            kinds, n = np.unique(np.floor(8 * np.log2(np.maximum(w, 1))).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["bin", "n"])

    found = values.select("rows").mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()  # a few hundred bins
    least, room = None, HEAD
    for r in found:
        if r.n > room:
            break
        least, room = r.bin, room - r.n
    out = Head(np.zeros(2 * HEAD, np.uint64), np.zeros(2 * HEAD, np.float32))  # no key is 0 but by chance, and then its value is looked up as 0 here
    if least is None:
        return out

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, v, w = gathered(pa.chunked_array([b.column("rows")]), *_VALUE)
            some = np.floor(8 * np.log2(np.maximum(w, 1))).astype(np.int64) >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(v[some]), pa.array(w[some])], names=["h", "v", "w"])

    t = values.select("rows").mapInArrow(pick, "h long, v float, w float").toArrow()
    order = np.argsort(t["w"].to_numpy(), kind="stable")  # the most frequent is written last
    key = t["h"].to_numpy()[order].view(np.uint64)
    at = key & np.uint64(2 * HEAD - 1)
    out.key[at], out.v[at] = key, t["v"].to_numpy()[order]
    return out


def pieces(c: Chunk, most: int) -> Iterator[tuple[int, Chunk]]:
    """A chunk by texts of about ``most`` tokens together, with the number of the first text of each."""
    ends = np.cumsum(c.counts)
    a = 0
    while a < len(ends):
        base = ends[a - 1] if a else 0
        z = max(a + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield a, Chunk(c.hashes, c.index[base : ends[z - 1]], c.counts[a:z], c.train[a:z])
        a = z


def needed(c: Chunk, words: np.ndarray, states: np.ndarray, passes: Sieve, known: Sieve, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of contexts of two or more words and of runs that may have a value, and the place of each one's token.

    ``words`` and ``states`` say of the chunk's words which are kept, and which may be
    retained contexts. A context is a kept run, and so are both halves of a kept run.
    """
    key, good, inside = c.hashes[c.index], words[c.index], np.ones(len(c.index) + 1, dtype=bool)
    inside[np.cumsum(c.counts) - c.counts] = inside[-1] = False
    need, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    at = np.flatnonzero(inside[1:-1] & good[1:] & good[:-1]) + 1
    context, parent, some = key[at - 1], key[at], states[c.index[at - 1]]
    for k in range(depth):
        if k:
            # The next word's run has this one as its context.
            then = np.flatnonzero(inside[at + 1])
            own = as_context(made[then])
            known_own = known(own)
            then = then[known_own]
            need.append(own[known_own])
            places.append(at[then] + 1)
            some = np.zeros(len(at), dtype=bool)
            some[then] = True
            both = np.flatnonzero(at[1:] - at[:-1] == 1)
            context, parent, some, at = made[both], made[both + 1], some[both], at[both + 1]
        made = joined(context, parent)
        kept = passes(made)  # a run with a value is kept
        at, made, some = at[kept], made[kept], some[kept]
        asked, place = made[some], at[some]
        here = known(asked)
        need.append(asked[here])
        places.append(place[here])
    return np.concatenate(need), np.concatenate(places)


def ask(chunks: DataFrame, passes: np.ndarray, bits: np.ndarray, often: Head, depth: int, n: int) -> DataFrame:
    """Requests (b, cid, first, counts, keys) of every chunk: keys of each text from ``first`` on, one after another.

    What is at hand is summed at once: such a row has no keys, a bucket of ``n`` or
    more, and in place of counts the sums.
    """
    share = chunks.sparkSession.sparkContext.broadcast((passes, bits, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, known = (Sieve(x) for x in share.value[:2])
        often = share.value[2]
        for cid, whole in (x for b in batches for x in _each(b)):
            words, states = passes(whole.hashes), known(as_context(whole.hashes))
            for first, c in pieces(whole, ASKED):
                need, places = needed(c, words, states, passes, known, depth)
                m = len(c.counts)
                owner = c.doc()[places]
                there, own = often.find(need)
                sums = np.bincount(owner[there], weights=own, minlength=m).astype(np.float64)
                need, owner = need[~there], owner[~there]
                b = bucket(need, n)
                order = np.argsort(b * m + owner)
                need, owner, b = need[order], owner[order], b[order]
                start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
                ends = np.append(start[1:], len(b))
                counts = [np.bincount(owner[i:j], minlength=m).astype(np.uint32).tobytes() for i, j in zip(start, ends)]
                rows = [short(need[i:j]) for i, j in zip(start, ends)]
                b = np.append(b[start], n + cid % n)
                counts.append(sums.tobytes())
                rows.append(b"")
                same = lambda x: pa.array(np.full(len(b), x, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(b), same(cid), same(first), pa.array(counts, pa.binary()), pa.array(rows, pa.binary())], names=["b", "cid", "first", "counts", "keys"])
        give_back()

    return chunks.mapInArrow(run, "b long, cid long, first long, counts binary, keys binary")


def add_up(sent: pa.Table, filed: pa.Table) -> pa.Table:
    """Sums by text of the values of the keys of a bucket; a key without a value adds nothing."""
    h, v, _ = gathered(filed["rows"], *_VALUE)
    order = np.argsort(h & LOW)
    h, v = (h & LOW)[order], v[order].astype(np.float64)
    out = []
    for counts, keys in zip(sent["counts"].to_pylist(), sent["keys"].to_pylist()):
        if not keys:  # sums already
            out.append(counts)
            continue
        counts = np.frombuffer(counts, np.uint32)
        at, there = find(h, widened(keys))
        own = np.repeat(np.arange(len(counts)), counts)
        out.append(np.bincount(own, weights=np.where(there, v[at], 0.0) if len(h) else np.zeros(len(own)), minlength=len(counts)).astype(np.float64).tobytes())
    give_back()
    return pa.table({"cid": sent["cid"], "b": pa.nulls(len(out), pa.int64()), "first": sent["first"], "v": pa.array(out, pa.binary())})


def word_keys(c: Chunk, known: Sieve) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a chunk's words and of those that may be retained contexts, and which these are."""
    states = as_context(c.hashes)
    some = np.flatnonzero(known(states))
    return np.concatenate((c.hashes, states[some])), some


def ask_words(chunks: DataFrame, bits: np.ndarray, n: int) -> DataFrame:
    """Requests (b, cid, keys) of every chunk for its words, and for these as contexts."""
    share = chunks.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, c in (x for b in batches for x in _each(b)):
            keys, _ = word_keys(c, Sieve(share.value))
            kinds, rows = dealt(bucket(keys, n), keys)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.full(len(kinds), cid)), pa.array(rows, pa.binary())], names=["b", "cid", "keys"])
        give_back()

    return chunks.mapInArrow(run, "b long, cid long, keys binary")


def answer(sent: pa.Table, filed: pa.Table) -> pa.Table:
    """Values of the keys of a bucket, in the order of each request; NaN if there is none."""
    parts = [gathered(filed.filter(pc.equal(filed["single"], flag))["rows"], *kinds)[:2] for flag, kinds in ((True, _VALUE), (False, ("u8", "f8")))]
    h, v = np.concatenate([x[0] for x in parts]), np.concatenate([x[1].astype(np.float64) for x in parts])
    order = np.argsort(h)
    h, v = h[order], v[order]
    out = []
    for r in sent["keys"].to_pylist():
        at, there = find(h, np.frombuffer(r, np.uint64))
        out.append((np.where(there, v[at], np.nan) if len(h) else np.full(len(at), np.nan)).tobytes())
    give_back()
    return pa.table({"cid": sent["cid"], "b": sent["b"], "first": pa.nulls(len(out), pa.int64()), "v": pa.array(out, pa.binary())})


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    own = id_text(docs).withColumn("uid", F.monotonically_increasing_id())
    chunks = cut(own.mapInArrow(_chunks, _CHUNKS), "chunks")
    words = cut(count_words(chunks), "words")
    mark = int(np.array(word_hash(BEGIN_WORD), np.uint64).view(np.int64))
    total, distinct = (int(x or 0) for x in words.where(F.col("h") != mark).agg(F.sum("n"), F.count("n")).first())
    scale = total + 0.5 * (distinct + 1)
    n = max(min(partitions(spark), 64), -(-total // BUCKET))
    levels, passes, depth = tree(chunks, words, total, scale, n)
    values = values_of(levels[0])
    for t in levels[1:]:
        values = values.unionAll(values_of(t))
    known = Sieve(np.zeros(SIEVE, np.uint64))
    known.add(values)
    schema = "cid long, b long, first long, v binary"
    log_p = packed(words.select("h", F.log((F.col("n") + 0.5) / scale).alias("v")), n, ("v",), ("f8",))
    by_word = log_p.withColumn("single", F.lit(False)).unionAll(values_of(levels[0]).withColumn("single", F.lit(True)))
    parts = []
    if depth:
        sent = ask(chunks, passes.bits, known.bits, head(values), depth, n)
        parts.append(cut(sent.groupBy("b").cogroup(values.groupBy("b")).applyInArrow(add_up, schema), "sums"))
        drop(*levels[1:])
    parts.append(cut(ask_words(chunks, known.bits, n).groupBy("b").cogroup(by_word.groupBy("b")).applyInArrow(answer, schema), "words-asked"))
    drop(words, *(levels[:1] if depth else levels))
    share, unknown = spark.sparkContext.broadcast(known.bits), float(np.log(0.5 / scale))

    def finish(own: pa.Table, got: pa.Table) -> pa.Table:
        (_, c), = _each(own)
        ids, some = (np.frombuffer(own.column(x)[0].as_py(), kind) for x, kind in (("ids", np.int64), ("some", bool)))
        keys, states = word_keys(c, Sieve(share.value))
        b = bucket(keys, n)
        v = np.full(len(keys), np.nan)
        more = np.zeros(len(c.counts))
        by = {}
        for x, first, r in zip(got["b"].to_pylist(), got["first"].to_pylist(), got["v"].to_pylist()):
            if x is None:
                sums = np.frombuffer(r, np.float64)
                more[first : first + len(sums)] += sums
            else:
                by[x] = r
        order = np.argsort(b, kind="stable")
        v[order] = np.concatenate([np.empty(0), *(np.frombuffer(by[x], np.float64) for x in np.unique(b).tolist())])
        back = np.zeros(len(c.hashes))
        back[states] = np.nan_to_num(v[len(c.hashes) :])
        token, back = v[c.index], back[c.index]
        text = c.doc()
        real = np.ones(len(text), dtype=bool)
        real[np.cumsum(c.counts) - c.counts] = False  # the marks
        by_text = lambda w: np.bincount(text, weights=w, minlength=len(c.counts))
        there = real & ~np.isnan(token)
        base = by_text(np.where(there, np.nan_to_num(token), np.where(real, unknown, 0.0)))
        more += by_text(np.where(real, np.r_[0.0, back[:-1]], 0.0))
        return pa.table({
            "doc_id": pa.array(ids, mask=~some), "held_out": ~c.train, "n_tokens": c.counts - 1, "n_known": by_text(there).astype(np.int64),
            "train_tokens": np.full(len(ids), total), "base_score": base / np.log(10), "score": (base + more) / np.log(10),
        })

    got = parts[0]
    for x in parts[1:]:
        got = got.unionAll(x)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = cut(chunks.groupBy("cid").cogroup(got.groupBy("cid")).applyInArrow(finish, schema), "scores")
    drop(chunks, *parts)
    return out
