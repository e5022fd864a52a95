"""Exact substring dedup by longest-previous-factor arrays.

A byte goes if a string of WINDOW bytes that covers it also starts earlier, in
the order of (doc_id, start). Matches do not cross documents.

Every window of WINDOW bytes has an anchor: the leftmost of its GRAM-byte grams
with the least hash. Equal windows have equal anchors at equal places, so texts
meet under the hashes of their anchors (one in about (WINDOW - GRAM) / 2 bytes).
The windows that have one anchor are consecutive; the bytes they span are the
anchor's segment, at most 2 * WINDOW - GRAM long. Then:

1. Under one hash, equal segments are copies: all but the first go.
2. Different segments under one hash can still share windows. Their bytes are
   fetched, and for groups of them suffixes are sorted, and the previous and next
   smaller positions in suffix order give the longest previous factor of each:
   a window goes if its factor is WINDOW bytes or longer.
3. Hashes under which very many different segments meet are cut down: the windows
   of their segments are dealt by the windows' own hashes, so no task holds them
   all.

Copies are thinned before each shuffle: of equal segments (or windows) in one
chunk only the first goes on, for all others are already known to go.

Defined results: null text is empty (0 bytes, the hash of nothing). Repeated rows
are one document, and each gets its removals; a
null doc_id loses nothing and removes nothing elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, text_chunks

WINDOW, GRAM = 100, 32
#: Different segments under one hash that one task sorts; beyond, windows are dealt by their own hashes.
GROUP_SEGMENTS = 2000
#: Hot hashes that may be broadcast: each has GROUP_SEGMENTS segments, so only corpora of 2e9 segments have more.
BROADCAST_HASHES = 1_000_000
#: Segments whose suffixes are sorted at once.
SORT_SEGMENTS = 20_000
_REACH = WINDOW - GRAM  # an anchor is at most so far behind its window's start


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(b: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all grams of ``width`` (a power of two) bytes, by doubling."""
    h, base, w = _byte_table()[b], np.uint64(0xD6E8FEB86659FD93), 1
    while w < width:
        h = h[:-w] * base + h[w:]
        base = np.uint64(int(base) * int(base) & 0xFFFFFFFFFFFFFFFF)
        w *= 2
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        v = np.minimum(v[:-w], v[w:])
        w *= 2
    return np.minimum(v[: len(v) - (width - w)], v[width - w :]) if width > w else v


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more than texts)."""
    texts = [t.encode() for t in pc.fill_null(part.column("text"), "").to_pylist()]
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))))).astype(np.int64)


def anchors(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: text, place, first and last window start (places in ``b``), hash, segment hash."""
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    if len(b) < WINDOW:
        return none
    gram = gram_hashes(b, GRAM)
    order = mix(gram)
    least = sliding_min((order & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(order), dtype=np.uint64), _REACH + 1)
    start = np.arange(len(least))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    ok = start + WINDOW <= at[doc + 1]
    start, doc, place = start[ok], doc[ok], (least[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return none
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, p = start[first], start[last], place[first]
    end = hi + WINDOW - GRAM
    seg = (p - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)
    for k in range(0, 2 * WINDOW - GRAM, GRAM):
        seg = mix(seg * np.uint64(0x9E3779B97F4A7C15) + gram[np.minimum(lo + k, end)])
    return doc[first], p, lo, hi, order[p], seg


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Of sorted columns: where a row differs from the one before."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.cumsum(_runs(doc)) - 1
    wide = int(end.max()) + 2
    top = np.maximum.accumulate(end + base * wide) - base * wide
    new = _runs(doc)
    new[1:] |= start[1:] > top[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], top[np.append(at[1:], len(doc)) - 1]


_S1 = "k long, seg long, doc long, a long, z long, p long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to deal by k: anchors (first of its kind in the chunk), and intervals known to go (seg null)."""
    for part in text_chunks(batches, 4 << 20):
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        b, at = _flat(part)
        doc, p, lo, hi, h, seg = anchors(b, at)
        if not len(doc):
            continue
        name = ids[doc].astype(np.int64)
        base = at[doc]
        order = np.lexsort((lo - base, name, seg, h))
        first = _runs(h[order], seg[order])
        keep = order[first]
        head = keep[np.cumsum(first) - 1]
        gone = order[(name[order] != name[head]) | ((lo - base)[order] != (lo - base)[head])]  # a repeated row is no earlier start
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[keep].view(np.int64), seg[keep].view(np.int64), name[keep], (lo - base)[keep], (hi - base)[keep], (p - base)[keep])], names=["k", "seg", "doc", "a", "z", "p"])
        if len(gone):
            d, s, e = merged(name[gone], (lo - base)[gone], (hi - base)[gone] + WINDOW)
            yield pa.RecordBatch.from_arrays([pa.array(mix(d.astype(np.uint64) + s.astype(np.uint64)).view(np.int64)), pa.nulls(len(d), pa.int64()), pa.array(d), pa.array(s), pa.array(e), pa.nulls(len(d), pa.int64())], names=["k", "seg", "doc", "a", "z", "p"])


_S2 = "h long, doc long, a long, z long, p long"


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (k, seg, doc, a): intervals to go (p null), and segments that meet a different one (p given).

    Holds one row over batches: the first segment of the last hash, until another one is seen.
    """
    held: tuple | None = None  # k, seg, (doc, a, z, p) that waits or None, doc and a of the first with seg
    for batch in batches:
        known = pc.is_null(batch.column("seg"))
        done = batch.filter(known)
        out = [[done.column("doc"), done.column("a"), done.column("z"), pa.nulls(done.num_rows, pa.int64()), pa.nulls(done.num_rows, pa.int64())]]
        rest = batch.filter(pc.invert(known))
        if rest.num_rows:
            k, seg, doc, a, z, p = (rest.column(c).to_numpy() for c in ("k", "seg", "doc", "a", "z", "p"))
            new_k, new_s = _runs(k), _runs(k, seg)
            if held is not None and held[0] == k[0]:
                new_k[0], new_s[0] = False, held[1] != seg[0]
            group = np.cumsum(new_k)  # 0: goes on from the batch before
            firsts = np.bincount(group, weights=new_s, minlength=group[-1] + 1)
            waiting = None
            if held is not None:
                going_on = held[0] == k[0]
                if going_on and firsts[0] and held[2] is not None:  # what waited meets another
                    d, s, e, q = held[2]
                    out.append([pa.array([d]), pa.array([s]), pa.array([e]), pa.array([q]), pa.array([int(held[0])])])
                if going_on:
                    firsts[0] += 1
                    waiting = held[2] if firsts[0] == 1 else None
            at = np.maximum.accumulate(np.where(new_s, np.arange(len(k)), -1))
            head_doc, head_a = (np.where(at >= 0, x[np.maximum(at, 0)], held[i] if held else 0) for x, i in ((doc, 3), (a, 4)))
            gone = ~new_s & ((doc != head_doc) | (a != head_a))  # a repeated row is no earlier start
            out.append([pa.array(doc[gone]), pa.array(a[gone]), pa.array(z[gone] + WINDOW), pa.nulls(int(gone.sum()), pa.int64()), pa.nulls(int(gone.sum()), pa.int64())])
            meet = new_s & (firsts[group] > 1)
            out.append([pa.array(doc[meet]), pa.array(a[meet]), pa.array(z[meet]), pa.array(p[meet]), pa.array(k[meet])])
            if firsts[group[-1]] == 1 and (group[-1] > 0 or waiting is None):
                i = np.flatnonzero(new_s & (group == group[-1]))
                waiting = (int(doc[i[0]]), int(a[i[0]]), int(z[i[0]]), int(p[i[0]])) if len(i) else waiting
            elif group[-1] > 0 or firsts[group[-1]] > 1:
                waiting = None
            held = (k[-1], seg[-1], waiting, int(head_doc[-1]), int(head_a[-1]))
        for doc, a, z, p, h in out:
            if len(doc):
                yield pa.RecordBatch.from_arrays([h, doc, a, z, p], schema=_SCHEMA2)


_SCHEMA2 = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("a", pa.int64()), ("z", pa.int64()), ("p", pa.int64())])


def suffix_order(cols: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: the suffixes' first bytes, compared word by word; ties by place."""
    return np.lexsort(tuple(cols[:, j] for j in range(cols.shape[1] - 1, -1, -1)))


def smaller(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places in suffix order: index of the previous and of the next smaller place (-1, len: none), by pointer jumping."""
    n = len(place)
    out = []
    for flip in (False, True):
        x = place[::-1] if flip else place
        to = np.arange(-1, n - 1)
        active = np.arange(n)
        while len(active):
            c = to[active]
            active = active[(c >= 0) & (x[np.maximum(c, 0)] > x[active])]
            to[active] = to[to[active]]
        out.append(n - 1 - to[::-1] if flip else to)
    return out[0], out[1]


def windows(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of segments: 13 words of each (the last padded), its segment and its place there."""
    raw = np.frombuffer(b"".join(segments) + b"\0" * 8, dtype=np.uint8)
    size = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    each = size - WINDOW + 1
    seg = np.repeat(np.arange(len(segments)), each)
    off = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    at = begin[seg] + off
    word = np.zeros(len(raw) - 7, dtype=np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | raw[k : len(raw) - 7 + k].astype(np.uint64)
    cols = np.stack([word[at + min(8 * j, WINDOW - 8)] for j in range(-(-WINDOW // 8))], axis=1)
    return cols, seg, off


def longest_previous(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of segments (given in text order): segment, place, and whether the longest previous factor is WINDOW or longer."""
    cols, seg, off = windows(segments)
    order = suffix_order(cols)
    far = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        same = (cols[order[1:]] == cols[order[:-1]]).all(axis=1)
        run = np.concatenate(([0], np.cumsum(~same)))  # suffixes of one run have WINDOW bytes in common
        before, after = smaller(order)
        hit = (before >= 0) & (run[np.maximum(before, 0)] == run)
        hit |= (after < len(order)) & (run[np.minimum(after, len(order) - 1)] == run)
        far[order] = hit
    return seg, off, far


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_chunks(batches, 4 << 20):
        h, doc, lo, cell = [], [], [], []
        for d, text, some in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("some").to_pylist()):
            raw = text.encode()
            for s in some:
                h.append(s["h"])
                doc.append(d)
                lo.append(s["a"])
                cell.append(raw[s["a"] : s["z"] + WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(lo, pa.int64()), pa.array(cell, pa.binary())], names=["h", "doc", "a", "bytes"])


def _emit(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    d, s, e = merged(doc, start, start + WINDOW)
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc", "a", "z"])


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals to go among segments sorted by hash; hashes are taken whole, several at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.sort_by([("doc", "ascending"), ("a", "ascending")])
        doc, a = t["doc"].to_numpy(), t["a"].to_numpy()
        seg, off, far = longest_previous(t["bytes"].to_pylist())
        if far.any():
            yield _emit(doc[seg[far]], a[seg[far]] + off[far])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        while rows >= SORT_SEGMENTS:
            t = pa.Table.from_batches(held).combine_chunks()
            h = t["h"].to_numpy()
            starts = np.flatnonzero(_runs(h))
            at = int(starts[-1])  # the last hash may go on
            far_on = np.searchsorted(starts, SORT_SEGMENTS)
            if far_on < len(starts):
                at = int(starts[far_on])
            if not at:
                break
            yield from solve(t.slice(0, at))
            held, rows = t.slice(at).to_batches(), t.num_rows - at
    if rows:
        yield from solve(pa.Table.from_batches(held))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of segments under hot hashes, by their own hashes (known false), thinned; those that go at once have known true."""
    for batch in batches:
        for start in range(0, batch.num_rows, 5000):
            some = batch.slice(start, 5000)
            cols, seg, off = windows(some.column("bytes").to_pylist())
            one, two = np.zeros(len(seg), np.uint64), np.ones(len(seg), np.uint64)
            for j in range(cols.shape[1]):
                one, two = mix(one * np.uint64(3) + cols[:, j] + np.uint64(1)), mix(two * np.uint64(5) + cols[:, j] + np.uint64(7))
            doc, at = some.column("doc").to_numpy()[seg], some.column("a").to_numpy()[seg] + off
            order = np.lexsort((at, doc, two, one))
            first = _runs(one[order], two[order])
            for known, i in ((False, order[first]), (True, order[~first])):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(one[i].view(np.int64) ^ (at[i] if known else 0)), pa.array(two[i].view(np.int64)), pa.array(doc[i]), pa.array(at[i]), pa.array(np.full(len(i), known))], names=["one", "two", "doc", "a", "known"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (hash, doc, a): all but the first of each hash."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two, doc, a = (batch.column(c).to_numpy() for c in ("one", "two", "doc", "a"))
        known = batch.column("known").to_numpy(zero_copy_only=False)
        gone = known.copy()
        i = np.flatnonzero(~known)
        if len(i):
            new = _runs(one[i], two[i])
            if last == (one[i[0]], two[i[0]]):
                new[0] = False
            last = (one[i[-1]], two[i[-1]])
            gone[i[~new]] = True
        if gone.any():
            yield _emit(doc[gone], a[gone])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_chunks(batches):
        n, removed, spans, digest = [], [], [], []
        for text, some in zip(part.column("text").to_pylist(), part.column("some").to_pylist()):
            raw = (text or "").encode()
            keep, at, out, count = hashlib.sha256(), 0, 0, 0
            end = -1
            for s in sorted((min(x["a"], len(raw)), min(x["z"], len(raw))) for x in some or ()):
                if s[0] > end:
                    count += 1
                    keep.update(raw[at : s[0]])
                    out += s[1] - s[0]
                elif s[1] > end:
                    out += s[1] - end
                end = at = max(end, s[1])
            keep.update(raw[max(at, 0) :])
            n.append(len(raw))
            removed.append(out)
            spans.append(count)
            digest.append(keep.hexdigest())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removals(docs: DataFrame) -> DataFrame:
    """Intervals of bytes to remove: doc, a, z (overlapping, in no order)."""
    spark = docs.sparkSession
    own = id_text(docs).where("doc_id is not null and text is not null")
    dealt = own.mapInArrow(_scan, _S1).repartition("k").sortWithinPartitions("k", "seg", "doc", "a")
    sifted = cut(dealt.mapInArrow(_sift, _S2), "sifted")
    done = sifted.where("p is null").select("doc", "a", "z")
    open_ = sifted.where("p is not null")
    often = open_.groupBy("h").agg(F.count("doc").alias("m")).where(F.col("m") > GROUP_SEGMENTS).select("h", F.lit(True).alias("hot"))
    some = open_.groupBy("doc").agg(F.collect_list(F.struct("h", "a", "z")).alias("some"))
    fetched = cut(own.join(some, own.doc_id == some.doc).select("doc_id", "text", "some").mapInArrow(_fetch, "h long, doc long, a long, bytes binary").distinct(), "segments")
    often = cut(often, "often")
    if often.count() <= BROADCAST_HASHES:  # else a shuffle join splits them
        often = F.broadcast(often)
    hot = fetched.join(often, "h", "left_semi")
    calm = fetched.join(often, "h", "left_anti")
    by_factor = calm.repartition("h").sortWithinPartitions("h").mapInArrow(_factor, "doc long, a long, z long")
    by_window = hot.mapInArrow(_spread, "one long, two long, doc long, a long, known boolean").repartition("one").sortWithinPartitions("one", "two", "doc", "a").mapInArrow(_later, "doc long, a long, z long")
    return cut(done.unionAll(by_factor).unionAll(by_window), "removals")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256."""
    own = id_text(docs)
    some = removals(docs).groupBy("doc").agg(F.collect_set(F.struct("a", "z")).alias("some"))
    return own.join(some, own.doc_id == some.doc, "left").select("doc_id", "text", "some").mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
