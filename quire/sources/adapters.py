"""Adapters of what runs outside Spark: parsers, OCR jobs and renderers over files, as functions that a deployment gives."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources import readers

PAGES = "doc_id string, page int, text string"
ITEMS = "doc_id string, ord int, label string, level int, text string, page int, left double, top double, width double, height double"
IMAGES = "doc_id string, page int, image binary, width_px int, height_px int"


def framed(rows: list[dict], names: list[str]) -> pd.DataFrame:
    """Rows with all columns; what a row lacks is null."""
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def over_files(files: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that a parser makes of each file (doc_id, content); its dictionaries need not have all columns.

    The parser runs on the executors. A file that it can't read gives no row and an
    error would end the job, so ``attempted`` keeps failures apart.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc, content in zip(part["doc_id"], part["content"]):
                yield framed([{"doc_id": doc, **r} for r in parse(bytes(content))], names)

    return files.select("doc_id", "content").mapInPandas(run, schema)


def attempted(files: DataFrame, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """(doc_id, status, error) of a parser over files, without its rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, content in zip(part["doc_id"], part["content"]):
                try:
                    parse(bytes(content))
                    out.append((doc, "processed", None))
                except Exception as e:  # noqa: BLE001  the reason is the result
                    out.append((doc, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "status", "error"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, status string, error string")


def convert(files: DataFrame, parse: Callable[[bytes], list[dict]], native: DataFrame | None = None) -> DataFrame:
    """Layout items of files by a layout model; with ``native`` (doc_id, is_native) only of those with text of their own."""
    own = files if native is None else files.join(native.where("is_native"), "doc_id", "left_semi")
    return over_files(own, parse, ITEMS)


def analyse(files: DataFrame, start: Callable[[bytes], str], status: Callable[[str], str], fetch: Callable[[str, str | None], tuple[list[dict], str | None]], wait: float = 5.0, limit: float = 900.0) -> DataFrame:
    """OCR blocks of files by jobs: started, asked for until they end, read page by page of results."""

    def parse(content: bytes) -> list[dict]:
        job = start(content)
        poll(lambda: status(job), wait, limit)
        rows, token = fetch(job, None)
        while token:
            more, token = fetch(job, token)
            rows += more
        return rows

    names = [c.split()[0] for c in readers.BLOCKS.split(", ")]
    schema = readers.BLOCKS

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc, content in zip(part["doc_id"], part["content"]):
                yield framed([{"doc_id": doc, **r} for r in parse(bytes(content))], names)

    return files.select("doc_id", "content").mapInPandas(run, schema)


def poll(status: Callable[[], str], wait: float = 5.0, limit: float = 900.0) -> str:
    """Ask until a job has succeeded; one that fails or takes longer than ``limit`` seconds is an error."""
    began = time.monotonic()
    while (now := status()) not in ("SUCCEEDED", "PARTIAL_SUCCESS"):
        if now == "FAILED":
            raise RuntimeError("the job failed")
        if time.monotonic() - began > limit:
            raise TimeoutError(f"the job is {now} after {limit:g} seconds")
        time.sleep(wait)
    return now


def render(files: DataFrame, draw: Callable[[bytes], list[dict]]) -> DataFrame:
    """Page images of files by a renderer: (doc_id, page, image, width_px, height_px)."""
    return over_files(files, draw, IMAGES)


def cropped(regions: DataFrame, pages: DataFrame, crop: Callable[[bytes, tuple[int, int, int, int]], bytes], boxes: str = "box") -> DataFrame:
    """(doc_id, block_id, page, image) of regions with pixel boxes, cut from their page images."""

    @F.pandas_udf("binary")
    def cut(image: pd.Series, box: pd.DataFrame) -> pd.Series:
        return pd.Series([crop(bytes(i), tuple(b)) for i, b in zip(image, box.itertuples(index=False))], dtype=object)

    return regions.join(pages, ["doc_id", "page"]).select("doc_id", "block_id", "page", cut("image", F.col(boxes)).alias("image"))


def plain_pages(content: bytes) -> list[dict]:
    """A parser for tests and for text files: form feeds part the pages."""
    return [{"page": i, "text": t} for i, t in enumerate(content.decode().split("\f"), 1)]
