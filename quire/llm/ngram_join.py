"""N-gram Jaccard join over prefix trees.

A document's set holds the 64-bit hashes of its distinct shingles. Sets that are
equal form one class. The classes' sets are put in one global order: shingles
that are not hot by hash, then the hot ones. Two sets of Jaccard similarity s or
more share one of their first n - ceil(s n) + 1 shingles, so sets meet under the
shingles of these prefixes. Where they meet, sizes and counts of shingles by
hash bucket bound the possible overlap from above.

No list of pairs is made. Under each shingle only a spanning forest of what
passes the bound goes out; its components are clusters outside which no set can
have a link. Each set is then sent once to its cluster's task, which stores the
sets, ordered by how many of the cluster have a shingle, in a trie. A probe goes
down the trie, shares the overlap of common beginnings, and leaves a subtree once
its remaining length cannot give the required overlap, or once all sets below are
linked with it already. Only a star for each component goes out. A cluster of
more than GROUP_ITEMS shingles is dealt to blocks, and a task gets two of them.

Defined results: null text, or text without words, gives the empty set (0
shingles), linked with nothing. Rows of one doc_id are one node. A null doc_id
has its shingles counted and a null component. Equal texts are linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, give_back, id_text, split_words, text_chunks, without
from .components import components

#: Buckets of a sketch: the power of two at which a bucket has LOAD shingles or fewer on average, BUCKETS at least.
BUCKETS, LOAD = 64, 16
#: A shingle is hot if so many prefixes have it, and a ten-thousandth of all classes: at most 10,000 per prefix shingle of an average set.
HOT_LEAST, HOT_SHARE = 256, 1e-4
#: Shingles of a block; a task holds the sets of two blocks at a time.
GROUP_ITEMS = 500_000
#: Sets under one shingle that are compared at once; more are taken as one cluster, size by size.
GROUP_ROWS = 5_000
#: Ids that may be broadcast to pick documents; beyond, a shuffle join does.
BROADCAST_IDS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts, in order of (text, hash), and where each text's begin (one more than texts)."""
    import xxhash

    words, index, counts = split_words(texts)
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    h = table[index]
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(h) - width + 1
    key = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        key = mix(key * np.uint64(3) + h[k : n + k] + np.uint64(0x9E3779B97F4A7C15))
    ok = doc[:n] == doc[width - 1 :] if n > 0 else np.empty(0, bool)
    key, owner = key[ok], doc[: max(n, 0)][ok]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))
        extra = np.array([xxhash.xxh3_64_intdigest(b"\n".join(words[k] for k in index[begin[i] : begin[i + 1]].tolist())) for i in short], dtype=np.uint64)
        key, owner = np.concatenate((key, extra)), np.concatenate((owner, short))
    if len(short):
        order = np.argsort(owner, kind="stable")
        key, owner = key[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, z in zip(at.tolist(), at[1:].tolist()):
        key[a:z].sort()
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], np.concatenate(([0], np.cumsum(new)))[at]


def ordered(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A set in the global order; ``hot`` and ``keys`` ascending."""
    if not len(hot):
        return keys
    late = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
    return np.concatenate((keys[~late], keys[late]))


def least_overlap(a, b, percent: int):
    """Smallest intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def spare(p: int) -> int:
    """Shingles kept beyond a prefix, to fill it up when hot ones leave it."""
    return max(8, p // 2)


def _describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, uid, n, the set's 128-bit key, bucket counts (255: so many or more) and the prefix by hash with spare shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            keys, at = shingle_sets(part.column("text"), width)
            n = np.diff(at)
            one, two = np.append(np.cumsum(mix(keys)), np.uint64(0)), np.append(np.cumsum(mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))), np.uint64(0))
            total = lambda c: np.where(n > 0, c[at[1:] - 1] - np.where(at[:-1] > 0, c[at[:-1] - 1], np.uint64(0)), np.uint64(0)).view(np.int64)
            deep = _depth(n)
            begin = np.concatenate(([0], np.cumsum(1 << deep)))
            place = np.repeat(begin[:-1], n) + (keys >> (64 - np.repeat(deep, n)).astype(np.uint64)).astype(np.int64)
            grid = np.minimum(np.bincount(place, minlength=int(begin[-1])), 255).astype(np.uint8)
            sketch = [grid[a:z].tobytes() for a, z in zip(begin.tolist(), begin[1:].tolist())]
            prefix = [keys[a : min(z, a + (p := prefix_size(z - a, percent)) + spare(p))].view(np.int64) if z > a else [] for a, z in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("uid"), pa.array(n), pa.array(total(one)), pa.array(total(two)), pa.array(sketch, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["doc_id", "uid", "n", "k1", "k2", "sketch", "prefix"],
            )

    own = id_text(docs).withColumn("uid", F.monotonically_increasing_id())
    return own.mapInArrow(run, "doc_id long, uid long, n long, k1 long, k2 long, sketch binary, prefix array<long>")


def _prefixes(own: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """(uid, n, items): prefixes in the global order; items is null where the spare shingles don't suffice."""
    share = own.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, size = share.value, prefix_size
        for batch in batches:
            n = batch.column("n").to_numpy()
            lists = batch.column("prefix")
            flat, at = lists.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            late = hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] == flat if len(hot) else np.zeros(len(flat), bool)
            rows = []
            for i, (a, z) in enumerate(zip(at.tolist(), at[1:].tolist())):
                p = size(int(n[i]), percent)
                if not late[a : a + p].any():
                    rows.append(flat[a : a + p].view(np.int64))
                    continue
                calm = flat[a:z][~late[a:z]]
                if len(calm) >= p:
                    rows.append(calm[:p].view(np.int64))
                elif z - a == n[i]:  # the whole set is here
                    rows.append(ordered(flat[a:z], hot)[:p].view(np.int64))
                else:
                    rows.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("n"), pa.array(rows, pa.list_(pa.int64()))], names=["uid", "n", "items"])

    return own.select("uid", "n", "prefix").mapInArrow(run, "uid long, n long, items array<long>")


def _sets(docs: DataFrame, ids: DataFrame, width: int, hot: np.ndarray, percent: int, whole: bool) -> DataFrame:
    """(doc_id, k1, items) of the documents among ``ids``, read again: their sets, or prefixes in the global order unless ``whole``."""
    share = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = share.value
        for part in text_chunks(batches):
            keys, at = shingle_sets(part.column("text"), width)
            rows = []
            for a, z in zip(at.tolist(), at[1:].tolist()):
                s = keys[a:z]
                rows.append((s if whole else ordered(s, hot)[: prefix_size(z - a, percent) if z > a else 0]).view(np.int64))
            one = [int(mix(keys[a:z]).sum(dtype=np.uint64).view(np.int64)) for a, z in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(one, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "k1", "items"])

    names = ids.select("doc_id").distinct()
    picked = id_text(docs).join(F.broadcast(names) if ids.count() <= BROADCAST_IDS else names, "doc_id", "left_semi")
    return picked.mapInArrow(run, "doc_id long, k1 long, items array<long>")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut between keys: every key lies whole in one of the batches that go out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        last = int(np.searchsorted(k, k[-1]))  # where the last key begins; it may go on
        if last or (held and held[-1].column(key)[0].as_py() != k[0]):
            if held or last:
                yield from pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _live(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shingle, size): those with a neighbour of a size that can link. Holds one row over batches."""
    last: tuple | None = None  # shingle, id, size, whether it has gone out
    for batch in batches:
        t, r, n = (batch.column(c).to_numpy() for c in ("t", "rep", "n"))
        if last is not None:
            t, r, n = np.append(last[0], t), np.append(last[1], r), np.append(last[2], n)
        if not len(t):
            continue
        near = (t[1:] == t[:-1]) & (100 * n[:-1] >= percent * n[1:])
        go = np.zeros(len(t), dtype=bool)
        go[1:] |= near
        go[:-1] |= near
        if last is not None and last[3]:
            was, go[0] = True, False
        else:
            was = False
        sent = bool(go[-1]) or (was and len(t) == 1)
        last = (t[-1], r[-1], n[-1], sent)
        if go.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[go]) for x in (t, r, n)], names=["t", "rep", "n"])


def _by_shingle(rows: DataFrame) -> DataFrame:
    return rows.repartition("t").sortWithinPartitions("t", "n", "rep")


def _depth(n: np.ndarray) -> np.ndarray:
    """log2 of the buckets of sketches of sets of n shingles."""
    return np.ceil(np.log2(np.maximum(n / LOAD, BUCKETS))).astype(np.int64)


class Sketches:
    """Sketches of several sizes. Two are compared at the size of the smaller, to which the larger folds."""

    def __init__(self, n: np.ndarray, rows: list[bytes]):
        self.n, self.depth, self.at, self.row = n, _depth(n), {}, {}
        for d in np.unique(self.depth).tolist():
            full, twice = np.flatnonzero(self.depth == d), np.flatnonzero(self.depth == d + 1)
            grid = np.frombuffer(b"".join(rows[i] for i in full), dtype=np.uint8).reshape(-1, 1 << d)
            more = np.frombuffer(b"".join(rows[i] for i in twice), dtype=np.uint8).reshape(-1, 1 << d, 2)
            fold = np.where((more == 255).any(axis=2), 255, np.minimum(more.sum(axis=2, dtype=np.int64), 255)).astype(np.uint8)
            self.at[d] = np.concatenate((grid, fold))
            self.row[d] = np.zeros(len(n), dtype=np.int64)
            self.row[d][np.concatenate((full, twice))] = np.arange(len(full) + len(twice))

    def bounds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlaps of sets i and j, whose sizes differ by less than half."""
        level, out = np.minimum(self.depth[i], self.depth[j]), np.minimum(self.n[i], self.n[j])
        for d in np.unique(level).tolist():
            k = np.flatnonzero(level == d)
            low = np.minimum(self.at[d][self.row[d][i[k]]], self.at[d][self.row[d][j[k]]])
            sure = ~(low == 255).any(axis=1)
            out[k[sure]] = low[sure].sum(axis=1, dtype=np.int64)
        return out


def _forest(sketch: Sketches, rows: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of one group by ascending size: edges (member, members) of a spanning forest of the pairs that pass the bound."""
    rest, waiting, n = rows, [], sketch.n
    while len(rest):
        if not waiting:
            waiting, rest = [int(rest[0])], rest[1:]
        i = waiting.pop()
        lo, hi = np.searchsorted(100 * n[rest], percent * n[i]), np.searchsorted(percent * n[rest], 100 * n[i], side="right")
        can = rest[lo:hi]
        ok = sketch.bounds(np.full(len(can), i), can) >= least_overlap(n[i], n[can], percent)
        if ok.any():
            yield i, can[ok]
            waiting.extend(can[ok].tolist())
            rest = np.concatenate((rest[:lo], can[~ok], rest[hi:]))


def _loose(live: DataFrame, percent: int) -> DataFrame:
    """Edges (x, y) that join all sets which share a prefix shingle and pass the bound, and few others."""

    def chain(rep: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
        near = np.flatnonzero(100 * n[:-1] >= percent * n[1:])
        return zip(rep[near + 1].tolist(), rep[near].tolist())

    def solve(part: pa.RecordBatch, pairs: set[tuple[int, int]]) -> None:
        t, rep, n = (part.column(c).to_numpy() for c in ("t", "rep", "n"))
        sketch = Sketches(n, part.column("sketch").to_pylist())
        at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.append(at, len(t)))
        two = at[size == 2]
        if len(two):
            two = two[percent * n[two + 1] <= 100 * n[two]]
            two = two[sketch.bounds(two, two + 1) >= least_overlap(n[two], n[two + 1], percent)]
            pairs.update(zip(rep[two + 1].tolist(), rep[two].tolist()))
        for a, m in zip(at[size > 2].tolist(), size[size > 2].tolist()):
            for i, can in _forest(sketch, np.arange(a, a + m), percent):
                y = int(rep[i])
                pairs.update((x, y) for x in rep[can].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        last, seen = None, 0  # the row before, and how many rows its shingle has had

        def pieces() -> Iterator[pa.RecordBatch]:
            """A shingle of more than GROUP_ROWS rows goes as a chain from there on; what came before is one chain too."""
            nonlocal last, seen
            held: list[pa.RecordBatch] = []
            for batch in batches:
                t = batch.column("t").to_numpy()
                for a, z in zip(at := np.flatnonzero(np.r_[True, t[1:] != t[:-1]]).tolist() if len(t) else [], [*at[1:], len(t)]):
                    if last is None or last[0] != t[a]:
                        if held:
                            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                            held = []
                        last, seen = None, 0
                    one = batch.slice(a, z - a)
                    seen += z - a
                    if seen > GROUP_ROWS:
                        rows = [*held, one]
                        rep, n = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("rep", "n"))
                        if last is not None and not held:
                            rep, n = np.r_[last[1], rep], np.r_[last[2], n]
                        pairs.update(chain(rep, n))
                        held = []
                    else:
                        held.append(one)
                    last = (t[z - 1], one.column("rep")[-1].as_py(), one.column("n")[-1].as_py())
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        waiting: list[pa.RecordBatch] = []
        rows = 0
        for group in pieces():
            waiting.append(group)
            rows += group.num_rows
            if rows > 10_000:
                solve(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], pairs)
                waiting, rows = [], 0
            if len(pairs) > 50_000:
                yield _pairs(pairs)
                pairs.clear()
        if waiting:
            solve(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], pairs)
        if pairs:
            yield _pairs(pairs)
        give_back()

    return _by_shingle(live).mapInArrow(run, "x long, y long").distinct()


def _pairs(pairs) -> pa.RecordBatch:
    both = sorted(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in both], pa.int64()), pa.array([p[1] for p in both], pa.int64())], names=["x", "y"])


class Trie:
    """Sets of ranks by shared beginnings, as arrays: runs without a branch are one node.

    The sets are sorted, so the sets below a node are neighbours, ``low`` to ``high``.
    """

    def __init__(self, sets: list[np.ndarray], size: np.ndarray):
        key = [x.astype(">u4").tobytes() for x in sets]
        self.order = np.array(sorted(range(len(sets)), key=key.__getitem__), dtype=np.int64)
        self.size = size[self.order]  # whole sizes; a set may hold shingles that no other has
        self.sets = [sets[i] for i in self.order]
        length = np.array([len(x) for x in self.sets], dtype=np.int64)
        shared = [0]
        for x, y in zip(self.sets, self.sets[1:]):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            shared.append(int(differ[0]) if len(differ) else m)
        low, high, top, end, up = [0], [len(sets)], [0], [0], [-1]  # top: items above the node, end: with its own
        path = [0]
        for i, n in enumerate(length.tolist()):
            while end[path[-1]] > shared[i]:
                last = path.pop()
                high[last] = i
                if end[path[-1]] < shared[i]:  # the run branches inside
                    low.append(low[last]), high.append(0), top.append(end[path[-1]]), end.append(shared[i]), up.append(path[-1])
                    top[last], up[last] = shared[i], len(low) - 1
                    path.append(len(low) - 1)
            if n > end[path[-1]]:
                low.append(i), high.append(0), top.append(end[path[-1]]), end.append(n), up.append(path[-1])
                path.append(len(low) - 1)
        for last in path:
            high[last] = len(sets)
        self.low, self.high, self.top, self.end, up = (np.array(x, dtype=np.int64) for x in (low, high, top, end, up))
        self.flat = np.concatenate([*self.sets, np.zeros(1, np.int64)])
        begin = np.concatenate(([0], np.cumsum(length)))[:-1]
        self.at = begin[np.minimum(self.low, max(len(sets) - 1, 0))] + self.top if len(sets) else self.top
        self.by = np.argsort(up, kind="stable")  # nodes by parent
        self.child = np.searchsorted(up[self.by], np.arange(len(up) + 1))
        self.least, self.longest = np.zeros(len(up), np.int64), np.zeros(len(up), np.int64)
        for k, (a, z) in enumerate(zip(self.low.tolist(), self.high.tolist())):
            self.least[k], self.longest[k] = (self.size[a:z].min(), length[a:z].max()) if z > a else (1 << 40, 0)
        self.length = length

    def probe(self, i: int, mark: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
        """Places after ``i`` of stored sets of at least the similarity with set ``i``, but for those that have its label.

        ``mark`` says for each rank whether the probe has it; ``label`` is of the sets by place.
        """
        items, n = self.sets[i], int(self.size[i])
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        node, shared, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(node):
            end = self.end[node]
            # Sets that end here: the first ones below the node, as long as its path.
            for k in np.flatnonzero(self.length[self.low[node]] == end).tolist():
                a, z = int(self.low[node[k]]), int(self.high[node[k]])
                z = a + int(np.searchsorted(self.length[a:z] != end[k], True)) if z - a > 1 else z
                here = np.arange(max(a, i + 1), z)
                if len(here):
                    here = here[(100 * shared[k] >= percent * (n + self.size[here] - shared[k])) & (label[here] != label[i])]
                    if len(here):
                        found.append(here)
            count = self.child[node + 1] - self.child[node]
            many = int(count.sum())
            if not many:
                break
            at = np.repeat(self.child[node] - (np.cumsum(count) - count), count) + np.arange(many)
            node, shared = self.by[at], np.repeat(shared, count)
            low, high = self.low[node], self.high[node]
            open_ = (high > i + 1) & ((change[high - 1] != change[low]) | (label[low] != label[i]))
            node, shared = node[open_], shared[open_]
            if not len(node):
                break
            run = self.end[node] - self.top[node]
            at = np.repeat(self.at[node] - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))
            shared = shared + np.add.reduceat(mark[self.flat[at]], np.cumsum(run) - run)
            passed = np.searchsorted(items, self.flat[self.at[node] + run - 1], side="right")
            # The best that is left: the rest of the probe, or of the longest set below.
            best = shared + np.minimum(len(items) - passed, self.longest[node] - self.end[node])
            go = (100 + percent) * best >= percent * (n + self.least[node])
            node, shared = node[go], shared[go]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def link_group(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Of sets of a cluster: the index of the first set of each one's component."""
    m, size = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    label = np.arange(m)
    if m < 2:
        return label
    _, rank, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    # Shingles that no other set has can't be shared; frequent ones come first, so that near copies share long beginnings.
    place = np.empty(len(df), dtype=np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(df))
    held = df[rank] > 1
    key = np.sort(owner[held] * len(df) + place[rank[held]])
    at = np.searchsorted(key, np.arange(m + 1) * len(df))
    kept = [key[a:z] % len(df) for a, z in zip(at.tolist(), at[1:].tolist())]
    # A set that shares too few shingles has no link.
    some = np.flatnonzero(100 * np.diff(at) >= percent * size)
    trie = Trie([kept[i] for i in some], size[some])
    own, mark = np.arange(len(some)), np.zeros(len(df), dtype=np.int64)
    for i in range(len(some)):
        mark[trie.sets[i]] = 1
        found = trie.probe(i, mark, own, percent)
        mark[trie.sets[i]] = 0
        if len(found):
            both = np.unique(own[np.append(found, i)])
            own[np.isin(own, both)] = both[0]
            if (own == own[0]).all():
                break
    name = some[trie.order]
    if len(name):
        first = np.full(len(name), m)
        np.minimum.at(first, own, name)
        label[name] = first[own]
    return label


def _link(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) of a star for each component that a task sees among its sets, given as rows (g, rep, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for part in _runs(batches, "g"):
            g, rep = part.column("g").to_numpy(), part.column("rep").to_numpy()
            lists = part.column("items")
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            ends = np.cumsum(size)
            at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for a, z in zip(at.tolist(), [*at[1:].tolist(), len(g)]):
                label = link_group([flat[ends[k] - size[k] : ends[k]] for k in range(a, z)], percent)
                k = np.flatnonzero(label != np.arange(z - a))
                links.extend(zip(rep[a + k].tolist(), rep[a + label[k]].tolist()))
            if len(links) > 50_000:
                yield _pairs(links)
                links = []
        if links:
            yield _pairs(links)
        give_back()

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "x long, y long")


def _clusters(docs: DataFrame, own: DataFrame, loose: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (g, rep, items): every set of a cluster once. Also the tables that they are read from.

    A cluster too large for a task is cut by size first: linked sets are in one
    band or in two that adjoin, so a part has two bands. A part that is still too
    large is dealt to blocks, and its sets go out once for each other block.
    """
    part = own.select("uid", "doc_id", "k1", "n").join(loose, own.uid == loose.node)
    part = cut(part.select("uid", "doc_id", "k1", "label", "n", F.floor(F.log("n") / (math.log(100 / percent) * 1.000001)).alias("band")), "clusters")
    large = part.groupBy("label").agg(F.sum("n").alias("total")).where(F.col("total") > GROUP_ITEMS).select("label")
    cells = part.join(large, "label", "left_semi").groupBy("label", "band").agg(F.sum("n").alias("own"))
    above = cells.select("label", (F.col("band") - 1).alias("band"), F.col("own").alias("more"))
    cells = cells.join(above, ["label", "band"], "left").select("label", "band", F.ceil((F.col("own") + F.coalesce("more", F.lit(0))) / GROUP_ITEMS).alias("blocks"))
    cells = cut(cells, "cells")
    keys = part.join(cells.select("label").distinct(), "label", "left_anti").select("uid", F.xxhash64("label").alias("g"))
    spread = part.join(cells.select("label").distinct(), "label", "left_semi").select("uid", "label", F.explode(F.array("band", F.col("band") - 1)).alias("band")).join(cells, ["label", "band"])
    mine = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != mine)
    each = F.when(F.col("blocks") == 1, F.array(F.xxhash64("label", "band"))).otherwise(F.transform(other, lambda j: F.xxhash64("label", "band", F.least(mine, j), F.greatest(mine, j))))
    keys = keys.unionAll(spread.select("uid", F.explode(each).alias("g")))
    sets = _sets(docs, part, width, np.empty(0, np.uint64), percent, True)
    sets = cut(sets.join(part.select("uid", "doc_id", "k1"), ["doc_id", "k1"]).dropDuplicates(["uid"]).select("uid", "items"), "items")
    return keys.join(sets, "uid").select("g", F.col("uid").alias("rep"), "items"), [part, cells, sets]


def jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    rows = cut(_describe(docs, width, percent), "sets")
    whole = rows.where("doc_id is not null and n > 0").select("doc_id", "uid", "n", "k1", "k2")
    classes = whole.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "uid")).alias("r"), F.count(F.lit(1)).alias("m"))
    same = cut(classes.where("m > 1").select("k1", "k2", "n", F.col("r.uid").alias("rep")), "classes")
    member = cut(whole.join(same, ["k1", "k2", "n"], "left").select("doc_id", "uid", "n", F.coalesce("rep", "uid").alias("rep")), "members")
    # A set of n shingles can only be linked with a different one if n of n + 1 is enough.
    own = rows.where(f"doc_id is not null and 100 * n >= {percent} * (n + 1)")
    own = cut(without(own, member.where("rep <> uid").select("uid"), "uid"), "own")
    by_hash = _prefixes(own, np.empty(0, np.uint64), percent).select(F.explode("items").alias("t"))
    limit = max(HOT_LEAST, int(HOT_SHARE * own.count()))
    often = by_hash.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > limit).select("t").toArrow()["t"].to_numpy()
    hot = np.sort(often.view(np.uint64))
    filled = _prefixes(own, hot, percent)
    if len(hot):  # few sets have so many hot shingles that the text must be read again
        touched = cut(filled.where("items is null").select("uid").join(own.select("uid", "doc_id", "k1", "n"), "uid"), "touched")
        if not touched.isEmpty():
            again = _sets(docs, touched, width, hot, percent, False).join(touched, ["doc_id", "k1"]).dropDuplicates(["uid"])
            filled = filled.where("items is not null").unionByName(again.select("uid", "n", "items"))
    prefix = filled.select(F.explode("items").alias("t"), F.col("uid").alias("rep"), "n")
    live = _by_shingle(prefix).mapInArrow(lambda b: _live(b, percent), "t long, rep long, n long")
    live = cut(live.join(own.select(F.col("uid").alias("rep"), "sketch"), "rep").select("t", "rep", "n", "sketch"), "live")
    edges = cut(_loose(live, percent).select(F.col("x").alias("a"), F.col("y").alias("b")), "loose")
    drop(live)
    dealt, used = _clusters(docs, own, components(edges), width, percent)
    stars = cut(_link(dealt, percent).select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    drop(edges, *used)
    # Rows of one doc_id are one node, whatever their texts.
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    links = stars.unionAll(member.join(twice, "doc_id").select("a", F.col("rep").alias("b")))
    labels = components(links)
    named = member.select("doc_id", "uid", "rep").join(labels, member.rep == labels.node, "left").select("doc_id", "uid", F.coalesce("label", "rep").alias("label"))
    named = cut(named, "named")
    groups = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("m")).where("m > 1").select("label", "component_id")
    found = named.join(groups, "label", "left").select("uid", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "uid", "n").join(found, "uid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = cut(out, "joined")
    drop(rows, same, member, own, stars, named)
    return out


def oracle(width: int = 3, percent: int = 90) -> str:
    """DuckDB: all pairs with a shingle in common, and the links' closure by recursion."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    e AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, chr(10))]
                 ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS s FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
    r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen),
    c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
    SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
    """
