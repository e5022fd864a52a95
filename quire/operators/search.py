"""Batch retrieval: exact vectors, coverage-weighted BM25, reciprocal-rank fusion.

Every search takes a DataFrame of queries with a column qid and returns
(qid, rank, id, score). One query is a batch of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text, vectors

#: Query vectors are compared with all stored vectors in blocks of so many, and of so many bytes, which are broadcast.
QUERY_BLOCK, QUERY_BYTES = 10_000, 64 << 20


def chunk_filter(doc_ids=None, project_id=None, group_name=None, level=None, layout_types=None, min_page=None, max_page=None) -> Column:
    """All given conditions; an empty doc_ids or layout_types is no condition, an empty level list matches nothing."""
    first, out = F.get(F.col("page_numbers"), F.lit(0)), F.lit(True)
    if doc_ids:
        out &= F.col("doc_id").isin(list(doc_ids))
    if project_id is not None:
        out &= F.col("project_id") == project_id
    if group_name is not None:
        out &= F.col("group_name") == group_name
    if level is not None:
        levels = list(level) if isinstance(level, (list, tuple, set)) else [level]
        out &= F.col("level").isin(levels) if levels else F.lit(False)
    if layout_types:
        out &= F.col("layout_type").isin(list(layout_types))
    if min_page is not None:
        out &= first >= min_page
    if max_page is not None:
        out &= first <= max_page
    return out


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best of each query with ranks; Spark limits each task's rows before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)


def vector_search(store: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", where: Column | None = None, post_filter: bool = False) -> DataFrame:
    """Exact nearest neighbours of (qid, embedding) in (id, embedding, ...).

    By default ``where`` applies before the search. ``post_filter`` gives the
    other behaviour: the nearest max(5k, 50) are filtered, which can leave fewer
    than k. Queries are a stated set, compared block by block with all rows.
    """
    distance = {"l2": vectors.l2, "cosine": vectors.cosine_distance}[metric]
    base = store if where is None or post_filter else store.where(where)
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n // min(QUERY_BLOCK, max(1, QUERY_BYTES // (4 * max(1, width or 1))))))
    parts = [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) for i in range(blocks)]
    found = None
    for q in parts:
        pairs = base.withColumnRenamed("embedding", "v").join(F.broadcast(q.select("qid", "embedding"))).withColumn("distance", distance(F.col("v"), F.col("embedding"))).drop("v", "embedding")
        if where is not None and post_filter:
            pairs = top(pairs, max(5 * k, 50), F.col("distance"), F.col("id")).where(where).drop("rank")
        part = top(pairs, k, F.col("distance"), F.col("id"))
        found = part if found is None else found.unionByName(part)
    return found.withColumn("score", vectors.score(F.col("distance"))).select("qid", "rank", "id", "distance", "score")


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of (id, text)."""
    split = docs.select("id", text.terms(F.col("text")).alias("w")).where("w is not null")
    return split.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))


def keyword_search(docs: DataFrame, queries: DataFrame, k: int = 10, coverage_exponent: float = 2.0, where: Column | None = None) -> DataFrame:
    """Coverage-weighted BM25 of (qid, query) over (id, text, ...).

    Statistics are of all rows; ``where`` only limits what is returned. A
    keyword that a query repeats counts as often.
    """
    asked = queries.select("qid", text.keywords(F.col("query")).alias("kw")).withColumn("n_kw", F.size("kw")).select("qid", "n_kw", F.posexplode("kw").alias("ord", "term"))
    split = docs.where("text is not null").select("id", text.terms(F.col("text")).alias("w"))
    stats = docs.where("text is not null").select(text.term_count(F.col("text")).alias("dl")).agg(F.count("dl").alias("n"), F.avg("dl").alias("avgdl"))
    # Only the words that are asked for are counted; a query set is stated, so its words are few.
    words = split.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(F.broadcast(asked.select("term").distinct()), "term")
    hits = words.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    rows = hits.withColumn("df", F.count("id").over(Window.partitionBy("term"))).join(F.broadcast(stats))
    rows = rows.select("term", "id", bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl")).alias("bm25"))
    if where is not None:
        rows = rows.join(docs.where(where).select("id"), "id", "left_semi")
    summed = asked.join(rows, "term").groupBy("qid", "id", "n_kw").agg(F.sum("bm25").alias("bm25_sum"), F.count("ord").alias("hits"))
    scored = summed.withColumn("score", F.col("bm25_sum") * F.pow(F.col("hits") / F.col("n_kw"), F.lit(coverage_exponent)))
    return top(scored.withColumn("by", F.round("score", 9)), k, F.col("by").desc(), F.col("id")).select("qid", "rank", "id", "bm25_sum", "hits", "score")


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 10, rrf_k: int = 60, vector_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """Reciprocal-rank fusion; a list without an id adds nothing to it."""
    one = vector.select("qid", "id", (F.lit(float(vector_weight)) / (rrf_k + F.col("rank"))).alias("s"))
    two = keyword.select("qid", "id", (F.lit(float(keyword_weight)) / (rrf_k + F.col("rank"))).alias("s"))
    fused = one.unionByName(two).groupBy("qid", "id").agg(F.sum("s").alias("score"))
    return top(fused.withColumn("by", F.round("score", 12)), k, F.col("by").desc(), F.col("id")).select("qid", "rank", "id", "score")


def hybrid_search(store: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10, rrf_k: int = 60, vector_weight: float = 1.0, keyword_weight: float = 1.0, coverage_exponent: float = 2.0) -> DataFrame:
    """Queries (qid, query, embedding): both searches to max(4k, 40), then fusion."""
    wide = max(4 * k, 40)
    return fuse(vector_search(store, queries, wide), keyword_search(docs, queries, wide, coverage_exponent), k, rrf_k, vector_weight, keyword_weight)
