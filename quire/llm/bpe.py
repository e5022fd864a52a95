"""Byte-level BPE encoding and decoding.

Pre-tokens come from the scan in :mod:`pretoken`. The distinct ones of a chunk
are merged once (and remembered, up to a bound, between chunks); ids of all
pre-tokens are then gathered by index. Offsets of pre-tokens and ids are kept,
so decoding gathers token bytes without a search.

Null text counts as empty: no tokens, the hash of nothing. Rows are independent:
repeated rows, null ids and very long texts need no other treatment.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import pretoken
from .common import id_text, text_chunks

#: Distinct pre-tokens remembered by a worker; at the bound it starts anew.
CACHE_PIECES = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Up to this length a scan for the lowest rank beats a heap.
SHORT_PIECE = 48


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, is joined until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    return _merge_short(piece, ranks) if len(piece) <= SHORT_PIECE else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, none = ranks.get, 1 << 60
    cut = list(range(len(piece) + 1))
    pair = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        del cut[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(piece[cut[i] : cut[i + 2]], none)
        if i:
            pair[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Neighbours are linked by index and pairs wait in a heap: n log n steps."""
    n = len(piece)
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has been joined meanwhile
        alive[j], end[i], right[i] = False, stop, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if (h := left[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


class Encoded(NamedTuple):
    ids: np.ndarray  # of all texts
    text_at: np.ndarray  # where each text's ids begin; one more than texts
    piece_at: np.ndarray  # where each pre-token's ids begin


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.seen = ranks, {}
        size = max(ranks.values()) + 1
        vocab: list[bytes] = [b""] * size
        for token, i in ranks.items():
            vocab[i] = token
        self.vocab = pa.array(vocab, type=pa.large_binary())
        self.length = np.array([len(x) for x in vocab], dtype=np.int64)

    def encode(self, texts: list[str]) -> Encoded:
        found = pretoken.split(texts)
        coded = found.pieces.dictionary_encode()
        if len(self.seen) > CACHE_PIECES:
            self.seen.clear()
        seen, ranks, lists = self.seen, self.ranks, []
        for piece in coded.dictionary.to_pylist():
            ids = seen.get(piece)
            if ids is None:
                ids = seen[piece] = merge(piece, ranks)
            lists.append(ids)
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), dtype=np.uint32, count=int(sizes.sum()))
        at = np.concatenate(([0], np.cumsum(sizes)))
        index = np.asarray(coded.indices, dtype=np.int64)
        each = sizes[index]
        piece_at = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat(at[index] - piece_at[:-1], each) + np.arange(piece_at[-1])] if len(index) else np.empty(0, np.uint32)
        return Encoded(ids, piece_at[np.concatenate(([0], np.cumsum(found.counts)))], piece_at)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the tokens in a row, and where each token's bytes begin (one more than ids)."""
        taken = self.vocab.take(pa.array(ids, type=pa.uint32()))
        return taken.buffers()[2].to_pybytes() if len(ids) else b"", np.concatenate(([0], np.cumsum(self.length[ids])))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(read_ranks(path))


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes; with ``with_ids`` also ids.

    The hashes are over the ids as little-endian unsigned 32-bit integers and over
    the decoded bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in text_chunks(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            out = own.encode(texts)
            raw, byte_at = own.decode(out.ids)
            ids, view, at = out.ids.astype("<u4").tobytes(), memoryview(raw), out.text_at.tolist()
            byte_at = byte_at[out.text_at].tolist()
            cols = [
                part.column("doc_id"),
                pa.array(np.diff(out.text_at)),
                pa.array([hashlib.sha256(ids[4 * a : 4 * b]).hexdigest() for a, b in zip(at, at[1:])]),
                pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(byte_at, byte_at[1:])]),
                pa.array(np.diff(byte_at).astype(np.int64)),
            ]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(out.text_at, pa.int32()), pa.array(out.ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "ids"][: len(cols)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * with_ids
    return id_text(docs).mapInArrow(run, schema)


class Counter:
    """Token counts under a library's tokenizer file, once for each distinct pre-token."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.special = [t.content for t in added if t.content]
        self.seen: dict[bytes, int] = {}

    def table(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each distinct pre-token."""
        if len(self.seen) > CACHE_PIECES:
            self.seen.clear()
        seen = self.seen
        new = [p for p in pieces if p not in seen]
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            seen.update(zip(some, map(len, self.tok.encode_batch_fast([p.decode() for p in some], add_special_tokens=False))))
        return np.fromiter((seen[p] for p in pieces), dtype=np.int64, count=len(pieces))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. An added token's string inside a text is one token and splits the text."""
        owner, parts, extra = range(len(texts)), texts, np.zeros(len(texts), dtype=np.int64)
        if self.special and any(s in t for t in texts for s in self.special):
            import regex

            cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
            split = [cut.split(t) for t in texts]
            extra = np.array([len(x) - 1 for x in split], dtype=np.int64)
            owner, parts = [i for i, x in enumerate(split) for _ in x], [p for x in split for p in x]
        found = pretoken.split(parts)
        coded = found.pieces.dictionary_encode()
        each = self.table(coded.dictionary.to_pylist())
        # Frequencies by (text, pre-token), joined with the pre-tokens' counts.
        doc = np.asarray(owner, dtype=np.int64)[found.doc]
        width = max(1, len(each))
        pair, times = np.unique(doc * width + np.asarray(coded.indices, dtype=np.int64), return_counts=True)
        return extra + np.bincount(pair // width, weights=times * each[pair % width], minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Pieces are counted once for each distinct pre-token of a chunk of texts,
    joined to the frequencies by (text, pre-token) and summed; no ids are made.
    Null text counts as empty: 0 bytes, 0 tokens, not over the limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for part in text_chunks(batches):
            text = part.column("text")
            n = own.count([t or "" for t in text.to_pylist()])
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
