"""Model boundaries as pandas UDFs, with a deterministic offline embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def embedder(embed: Callable[[list[str]], list[list[float]]]):
    """A UDF of a batch embedder; an empty text is an error."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if (texts.fillna("") == "").any():
                raise ValueError("cannot embed an empty text")
            out = embed(texts.tolist()) if len(texts) else []
            if any(not np.isfinite(v).all() for v in out):
                raise ValueError("embedding is not finite")
            yield pd.Series(out)

    return run


def hashing(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Signed feature hashing of words, to unit length."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return embed


def payload(context: str = "context_text", text: str = "text"):
    """What is embedded: the context text, else the text, else nothing."""
    return F.coalesce(F.when(F.col(context) != "", F.col(context)), F.when(F.col(text) != "", F.col(text)))


def checked(embed: Callable[[list[str]], list[list[float]]], dim: int) -> Callable[[list[str]], list[list[float]]]:
    """An embedder whose vectors must have ``dim`` finite elements."""

    def run(texts: list[str]) -> list[list[float]]:
        out = embed(texts)
        for v in out:
            if len(v) != dim or not np.isfinite(v).all():
                raise ValueError(f"an embedding is not {dim} finite numbers")
        return out

    return run


def retrying(call: Callable, attempts: int = 4, wait: tuple[float, float] = (2.0, 8.0), transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)) -> Callable:
    """A call that is tried again after transient errors, with doubling pauses; other errors go on at once."""

    def run(*args, **kwargs):
        import time

        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except transient:
                if n == attempts - 1:
                    raise
                time.sleep(min(wait[1], wait[0] * 2**n))

    return run


def http_json(url: str, payload: dict, timeout: float = 120.0) -> dict:
    import json
    import urllib.error
    import urllib.request

    req = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return json.load(r)
    except urllib.error.HTTPError:
        raise
    except urllib.error.URLError as e:
        raise ConnectionError(str(e.reason)) from e


def local_server(url: str, model: str) -> Callable[[list[str]], list[list[float]]]:
    """A model server with an /api/embed call."""
    return retrying(lambda texts: http_json(f"{url}/api/embed", {"model": model, "input": texts})["embeddings"])


def sentence_model(name: str, batch: int = 32) -> Callable[[list[str]], list[list[float]]]:
    """A sentence-transformers model, loaded once a worker, with unit vectors."""
    loaded: dict[str, object] = {}

    def embed(texts: list[str]) -> list[list[float]]:
        if name not in loaded:
            from sentence_transformers import SentenceTransformer

            loaded[name] = SentenceTransformer(name)
        return loaded[name].encode(texts, batch_size=batch, normalize_embeddings=True).tolist()

    return embed


def cloud_embedder(invoke: Callable[[dict], dict], dim: int) -> Callable[[list[str]], list[list[float]]]:
    """One text a call of a hosted model; its vectors may have 256, 512 or 1024 elements."""
    if dim not in (256, 512, 1024):
        raise ValueError(f"no vectors of {dim}")
    call = retrying(invoke)
    return lambda texts: [call({"inputText": t, "dimensions": dim, "normalize": True})["embedding"] for t in texts]


def get_embedder(kind: str, dim: int, **options) -> Callable[[list[str]], list[list[float]]]:
    """An embedder by name: hashing (offline), server, sentence or cloud."""
    makers = {"hashing": lambda: hashing(dim), "server": lambda: local_server(**options), "sentence": lambda: sentence_model(**options), "cloud": lambda: cloud_embedder(dim=dim, **options)}
    if kind not in makers:
        raise ValueError(f"unknown embedder {kind!r}")
    return checked(makers[kind](), dim)


def text_model(ask: Callable[[str], str], unknown: str = "UNKNOWN"):
    """A UDF of a text model: one answer a text, null for blank texts and for answers that say unknown."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = retrying(ask, 3)
        for texts in batches:
            out = [None if not t else (call(t) or "").strip() for t in texts]
            yield pd.Series([None if not a or a.upper() == unknown else a for a in out], dtype=object)

    return run


def chat_server(url: str, model: str, system: str = "") -> Callable[[str], str]:
    """A model server with an /api/chat call, as a function of a text."""

    def ask(text: str) -> str:
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": text}]
        return http_json(f"{url}/api/chat", {"model": model, "stream": False, "messages": messages})["message"]["content"]

    return ask


def header_model(ask: Callable[[str], str]):
    """A UDF of a model that reads a table's header: a list of cells, or null if its answer has none."""
    import json

    cell = "array<struct<row:int,col:int,row_span:int,col_span:int,text:string>>"

    def read(answer: str | None):
        try:
            cells = json.loads(answer[answer.index("[") : answer.rindex("]") + 1])
            return [{"row": int(c["row"]), "col": int(c["col"]), "row_span": int(c.get("row_span", 1)), "col_span": int(c.get("col_span", 1)), "text": str(c.get("text", ""))} for c in cells]
        except (ValueError, TypeError, KeyError, AttributeError):
            return None

    @F.pandas_udf(cell)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = retrying(ask, 3)
        for texts in batches:
            yield pd.Series([read(call(t)) if t else None for t in texts], dtype=object)

    return run
