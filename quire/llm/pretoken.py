"""Pre-tokenisation without regular expressions at run time.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
is recast as a finite automaton over code point classes. Each code point is a
transition function on nine states; the functions that can arise by composition
form a small monoid, closed once at import. Texts of a chunk are concatenated,
code points become monoid elements, and a work-efficient prefix scan with the
monoid's multiplication table gives the state before every code point. A token
starts where the (state, symbol) table says so.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Code point classes.
OTHER, LETTER, NUMBER, BLANK, GAP = range(5)
# Symbols: classes refined by what follows.
S_P, S_L, S_N, S_Q1, S_Q2, S_SP_MID, S_SP_LAST, S_W_MID, S_W_LAST, S_SEP = range(10)
# States: what was read last.
START, IN_L, IN_N, IN_P, AFTER_SP, AFTER_W, NEED2, NEED1, CLOSED = range(9)


def _matches(pattern: str, every: str) -> str:
    """The code points of ``every`` that a property holds for, by the tables of tiktoken's engine."""
    import tiktoken

    plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return plain.decode(plain.encode_ordinary(every))


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, from the Unicode properties that the tokenizer library knows."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", GAP)):
        table[np.frombuffer(_matches(pattern, every).encode("utf-32-le"), dtype=np.uint32)] = kind
    table[0x20] = BLANK
    return table


def _step(state: int, symbol: int) -> int:
    if symbol == S_L:
        return {NEED2: NEED1, NEED1: CLOSED}.get(state, IN_L)
    if symbol in (S_Q1, S_Q2):
        return IN_P if state in (IN_P, AFTER_SP) else (NEED1 if symbol == S_Q1 else NEED2)
    return {S_P: IN_P, S_N: IN_N, S_SP_MID: AFTER_SP, S_SP_LAST: AFTER_SP, S_W_MID: AFTER_W, S_W_LAST: AFTER_W, S_SEP: START}[symbol]


def _starts(state: int, symbol: int) -> bool:
    if symbol == S_L:
        return state not in (IN_L, AFTER_SP, NEED2, NEED1)
    if symbol == S_N:
        return state not in (IN_N, AFTER_SP)
    if symbol in (S_P, S_Q1, S_Q2):
        return state not in (IN_P, AFTER_SP)
    if symbol in (S_SP_MID, S_W_MID):
        return state not in (AFTER_SP, AFTER_W)
    return True


class Automaton(NamedTuple):
    element: np.ndarray  # symbol -> monoid element
    product: np.ndarray  # element * size + element -> element: first the left one
    final: np.ndarray  # element -> state reached from START
    starts: np.ndarray  # state * 10 + symbol -> a token starts
    size: int


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    gens = [tuple(_step(s, a) for s in range(9)) for a in range(10)]
    index: dict[tuple[int, ...], int] = {}
    todo = list(dict.fromkeys(gens))
    for f in todo:
        index[f] = len(index)
    while todo:
        f = todo.pop()
        for g in gens:
            if (h := tuple(g[x] for x in f)) not in index:
                index[h] = len(index)
                todo.append(h)
    funcs = list(index)
    product = np.array([[index[tuple(g[x] for x in f)] for g in funcs] for f in funcs], dtype=np.uint8)
    starts = np.array([[_starts(s, a) for a in range(10)] for s in range(9)], dtype=bool)
    return Automaton(np.array([index[g] for g in gens], dtype=np.uint8), product.ravel(), np.array([f[START] for f in funcs], dtype=np.uint8), starts.ravel(), len(funcs))


def scan(f: np.ndarray, product: np.ndarray, size: int) -> np.ndarray:
    """Inclusive prefix products of monoid elements; work in proportion to the length."""
    n = len(f)
    if n < 2:
        return f.copy()
    half = product[f[0 : n - n % 2 : 2].astype(np.uint16) * size + f[1::2]]
    half = scan(half, product, size)
    out = np.empty_like(f)
    out[0] = f[0]
    out[1::2] = half
    rest = f[2::2]
    out[2::2] = product[half[: len(rest)].astype(np.uint16) * size + rest]
    return out


def symbols(cps: np.ndarray, sep: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``sep``: positions that stand between texts (the last one does)."""
    kind = class_table()[cps]
    kind[sep] = GAP  # nothing visible follows at a text's end
    sym = np.array([S_P, S_L, S_N, S_SP_MID, S_W_MID], dtype=np.uint8)[kind]
    seen = np.empty(len(kind), dtype=bool)
    seen[:-1] = kind[1:] < BLANK
    seen[-1] = False
    sym += (seen & (kind >= BLANK)).astype(np.uint8)
    quote = np.flatnonzero(cps == 0x27)
    if len(quote):
        a, b = cps[np.minimum(quote + 1, len(cps) - 1)], cps[np.minimum(quote + 2, len(cps) - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        sym[quote[one]] = S_Q1
        sym[quote[two & ~one]] = S_Q2
    sym[sep] = S_SEP
    return sym


class Pieces(NamedTuple):
    pieces: pa.BinaryArray  # all pre-tokens of the texts, in order
    doc: np.ndarray  # index of each piece's text
    counts: np.ndarray  # pieces per text


def split(texts: list[str]) -> Pieces:
    """Pre-tokens of texts, as slices of one UTF-8 buffer."""
    joined = "\0" + "".join(t + "\0" for t in texts)
    cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    sep = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))))).astype(np.int64)
    a, sym = automaton(), symbols(cps, sep)
    state = a.final[scan(a.element[sym], a.product, a.size)]
    begins = np.zeros(len(cps), dtype=bool)
    begins[1:] = a.starts[state[:-1].astype(np.uint8) * 10 + sym[1:]]
    begins[sep] = True
    raw = np.frombuffer(joined.encode(), dtype=np.uint8)
    at = np.flatnonzero(begins)
    offset = np.flatnonzero((raw & 0xC0) != 0x80)[at] if len(raw) != len(cps) else at
    keep = np.ones(len(at), dtype=bool)
    is_sep = np.zeros(len(cps), dtype=bool)
    is_sep[sep] = True
    keep = ~is_sep[at]
    doc = np.cumsum(~keep) - 1
    # Slices are contiguous but for the separators, which go from the buffer.
    sep_byte = offset[~keep]
    data = np.delete(raw, sep_byte)
    begin = offset[keep] - doc[keep] - 1
    ends = np.concatenate((begin, [len(data)])).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return Pieces(pieces, doc[keep], np.bincount(doc[keep], minlength=len(texts)))
