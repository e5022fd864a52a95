"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import drop, settle as cut, shared_dir  # noqa: F401

#: The separators of words: space and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a vectorised step works on at once; bounds Python memory.
CHUNK_BYTES = 1 << 20


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that no other column of the input can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``coded_words`` with the words as a list."""
    words, index, size = coded_words(texts)
    return words.cast(pa.binary()).to_pylist(), index, size


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words of texts (null: none), the index of each word in order, and how many each text has.

    Words are cut at blanks and the ASCII controls tab to carriage return; A-Z only is lowered.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    some = np.asarray(pc.not_equal(flat, "").to_numpy(zero_copy_only=False), dtype=bool)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if not some.all():  # blanks at either end of a text give an empty word
        owner = np.repeat(np.arange(len(size)), size)[some]
        flat, size = flat.filter(pa.array(some)), np.bincount(owner, minlength=len(size)).astype(np.int64)
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), size


@functools.cache
def _libc():  # found by a process of its own, so once a worker
    import ctypes
    import ctypes.util

    return ctypes.CDLL(ctypes.util.find_library("c") or None)


def give_back() -> None:
    """Memory that a finished partition leaves with the allocators goes back to the system, for the worker lives on."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def through(docs: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text") -> DataFrame:
    """Rows with all their columns through a function on chunks; the schema stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, text=text):
            yield change(part)

    return docs.mapInArrow(run, docs.schema)


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose id is not among ``ids``; these are broadcast if few, and else joined by a shuffle."""
    few = ids.count() <= 1_000_000
    return docs.join(F.broadcast(ids) if few else ids, key, "left_anti")
