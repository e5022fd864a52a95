"""Retrieval, evaluation and graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import evaluate, navigate, search

#: The stored vector that single-query searches ask with.
PROBE = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == PROBE).select(F.col("vec_id").alias("qid"), "embedding")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("qid", "rank", F.col("id").alias("chunk_id"), *(F.round(c, 6).alias(c) for c in extra))


def vector_topk(spark, sf_dir):
    return _out(search.vector_search(store(spark, sf_dir), probe(spark, sf_dir), 10), "distance", "score")


def vector_topk_filtered(spark, sf_dir):
    return _out(search.vector_search(store(spark, sf_dir), probe(spark, sf_dir), 10, where=F.col("label") == 3), "distance", "score")


def vector_topk_compat(spark, sf_dir):
    return _out(search.vector_search(store(spark, sf_dir), probe(spark, sf_dir), 10, where=F.col("label") == 3, post_filter=True), "distance", "score")


def vector_cosine(spark, sf_dir):
    return _out(search.vector_search(store(spark, sf_dir), probe(spark, sf_dir), 10, metric="cosine"), "distance", "score")


def batch(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def vector_batch(spark, sf_dir):
    return _out(search.vector_search(store(spark, sf_dir), batch(spark, sf_dir), 5), "distance", "score")


def keyword_terms(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.posexplode(text.keywords(F.col("query"))).alias("ord", "keyword")).select("qid", F.col("ord").cast("long").alias("ord"), "keyword")


def term_statistics(spark, sf_dir):
    p = search.postings(texts(spark, sf_dir))
    return p.groupBy("term").agg(F.count("id").alias("df"), F.sum("tf").alias("cf"))


def keyword_coverage(spark, sf_dir):
    return _out(search.keyword_search(texts(spark, sf_dir), asked(spark, sf_dir), 10), "bm25_sum", "score")


def keyword_bm25(spark, sf_dir):
    return _out(search.keyword_search(texts(spark, sf_dir), asked(spark, sf_dir), 10, coverage_exponent=0.0), "bm25_sum", "score")


def keyword_filtered(spark, sf_dir):
    return _out(search.keyword_search(texts(spark, sf_dir), asked(spark, sf_dir), 10, where=F.col("lang") == "en"), "bm25_sum", "score")


def _hybrid(spark, sf_dir, vw, kw):
    # Question i is asked with stored vector i as its embedding.
    q = asked(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), "qid")
    return search.hybrid_search(store(spark, sf_dir).drop("label"), texts(spark, sf_dir), q, 10, vector_weight=vw, keyword_weight=kw)


def hybrid_rrf(spark, sf_dir):
    return _out(_hybrid(spark, sf_dir, 1.0, 1.0), "score")


def hybrid_vec_tilt(spark, sf_dir):
    return _out(_hybrid(spark, sf_dir, 2.0, 1.0), "score")


def hybrid_kw_tilt(spark, sf_dir):
    return _out(_hybrid(spark, sf_dir, 1.0, 2.0), "score")


def _judged(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    found = search.vector_search(store(spark, sf_dir).drop("label"), batch(spark, sf_dir), 20)
    label = v.select(F.col("vec_id").alias("id"), F.col("label").alias("found_label"))
    own = v.select(F.col("vec_id").alias("qid"), F.col("label").alias("category"))
    # The query's own vector is not evidence; the rest move up by one.
    return found.where("id <> qid").withColumn("rank", F.col("rank") - 1).where("rank >= 1").join(label, "id").join(own, "qid").select("qid", F.col("category").cast("string").alias("category"), "rank", (F.col("found_label") == F.col("category")).alias("hit"))


def eval_outcomes(spark, sf_dir):
    o = evaluate.outcomes(_judged(spark, sf_dir), by=("qid", "category"))
    return o.select("qid", "category", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"), "hit_1", "hit_3", "hit_5", "hit_10")


def eval_by_category(spark, sf_dir):
    r = evaluate.report(evaluate.outcomes(_judged(spark, sf_dir), by=("qid", "category")))
    return r.select("category", "n", *(F.round(c, 6).alias(c) for c in ("rr", "ndcg", "hit_1", "hit_3", "hit_5", "hit_10")))


def golden(spark, sf_dir):
    """(vectors, chunks, questions): document i has vector i, if there is one, level i % 3 and ten documents a page; question i asks for document i."""
    v = store(spark, sf_dir).drop("label")
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("doc_id"), F.pmod("doc_id", F.lit(3)).cast("int").alias("level"), F.array(F.floor(F.col("doc_id") / 10).cast("int")).alias("page_numbers"))
    chunks = d.withColumns({"parent_id": F.when(F.col("level") > 0, F.col("id") - 1), "prev_id": F.when(F.col("id") >= 3, F.col("id") - 3), "next_id": F.col("id") + 3})
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"))
    q = item.join(v, "id").join(chunks.select("id", "doc_id", "page_numbers", "level"), "id")
    q = q.select(F.col("id").alias("qid"), "query", "embedding", F.col("level").cast("string").alias("category"), "doc_id", F.array("id").alias("gold_chunk_ids"), F.col("page_numbers").alias("gold_pages"))
    return v, chunks, q


def golden_outcomes(spark, sf_dir):
    scored, _ = evaluate.run_eval(*golden(spark, sf_dir), evaluate.Config(mode="keyword"))
    return scored.select("qid", "category", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"), "num_retrieved", "first_relevant_rank", "hit_1", "hit_10", "loose_1", "loose_10")


def ablation_matrix(spark, sf_dir):
    """All eight standard configurations over the questions, by category and overall."""
    r = evaluate.run_matrix(*golden(spark, sf_dir), evaluate.standard())
    return r.select("config", "category", "n", *(F.round(c, 6).alias(c) for c in ("rr", "ndcg", "hit_1", "hit_10", "loose_1", "loose_10")))


def geography(spark, sf_dir):
    """The tree region, nation, customer as a chunk graph."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    cid = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    nodes = r.select(cid("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("o"), F.lit(0).alias("level"))
    nodes = nodes.unionByName(n.select(cid("n", "n_nationkey").alias("id"), cid("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("o"), F.lit(1).alias("level")))
    nodes = nodes.unionByName(c.select(cid("c", "c_custkey").alias("id"), cid("n", "c_nationkey").alias("parent_id"), F.col("c_custkey").cast("long").alias("o"), F.lit(2).alias("level")))
    from quire.operators.chunking import link

    return link(nodes, ["level"], "o")


TREE = """t AS (
  SELECT *, lag(id) OVER (PARTITION BY level ORDER BY o) AS prev_id, lead(id) OVER (PARTITION BY level ORDER BY o) AS next_id FROM (
    SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, CAST(r_regionkey AS BIGINT) AS o, 0 AS level FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, 1 FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, 2 FROM customer))"""


def navigate_parent(spark, sf_dir):
    g = geography(spark, sf_dir)
    return navigate.navigate(g.select("id"), g, "parent").select(F.col("id").alias("chunk_id"), F.col("to").alias("parent"))


def navigate_children(spark, sf_dir):
    g = geography(spark, sf_dir)
    return navigate.navigate(g.where("level < 2").select("id"), g, "children").select(F.col("id").alias("chunk_id"), F.col("to").alias("child"))


def sibling_counts(spark, sf_dir):
    g = geography(spark, sf_dir)
    return navigate.sibling_counts(g).select(F.col("id").alias("chunk_id"), "n_siblings")


def ancestor_pairs(spark, sf_dir):
    g = geography(spark, sf_dir)
    return navigate.ancestors(g.select("id"), g, 3).select(F.col("id").alias("chunk_id"), "ancestor", "distance")


def lineage_relevant(spark, sf_dir):
    g = geography(spark, sf_dir)
    gold = g.where("level = 1").select(F.col("id").alias("item"), "id")
    return navigate.lineage(gold, g, 3).select("item", F.col("id").alias("chunk_id"))


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"


def _vector_sql(k, where="true", metric="sqrt(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: (v.e[i] - q.e[i]) * (v.e[i] - q.e[i]))))", queries=f"id = {PROBE}", wide=None):
    base = f"SELECT q.id AS qid, v.id, v.label, {metric} AS distance FROM v, v q WHERE q.{queries}"
    if wide:
        base = f"SELECT qid, id, label, distance FROM ({base}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= {wide}"
    return f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank, id AS chunk_id, distance, 1 / (1 + distance) AS score
      FROM ({base}) WHERE {where} QUALIFY rank <= {k}"""


def _vector(k, **kw):
    return f"WITH {_V} SELECT qid, CAST(rank AS INT) AS rank, chunk_id, round(distance, 6) AS distance, round(score, 6) AS score FROM ({_vector_sql(k, **kw)})"


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS if "'" not in w)
_KW = f"""
 q0 AS (SELECT item_id AS qid, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1 AND NOT list_contains([{_STOP}], x)) AS kw FROM benchmark),
 q1 AS (SELECT qid, len(kw) AS n_kw, unnest(kw) AS term, generate_subscripts(kw, 1) - 1 AS ord FROM q0),
 d0 AS (SELECT doc_id AS id, lang, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
 st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d0),
 p0 AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d0),
 p AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM p0 GROUP BY term, id),
 dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM p GROUP BY term)"""


def _keyword_sql(k, exponent=2.0, where="true"):
    return f"""SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INT) AS rank, id AS chunk_id, bm25_sum, score FROM (
      SELECT qid, id, sum(b) AS bm25_sum, sum(b) * pow(count(*) / any_value(n_kw), {exponent}) AS score FROM (
        SELECT qid, n_kw, p.id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS b
        FROM q1 JOIN p USING (term) JOIN dfs USING (term), st WHERE p.id IN (SELECT id FROM d0 WHERE {where})) GROUP BY qid, id) QUALIFY rank <= {k}"""


def _keyword(k, **kw):
    return f"WITH {_KW} SELECT qid, rank, chunk_id, round(bm25_sum, 6) AS bm25_sum, round(score, 6) AS score FROM ({_keyword_sql(k, **kw)})"


def _hybrid_sql(vw, kw):
    vec = _vector_sql(40, queries="id IN (SELECT item_id FROM benchmark)")
    return f"""WITH {_V}, {_KW}, a AS ({vec}), b AS ({_keyword_sql(40)}),
     f AS (SELECT qid, chunk_id, sum(s) AS score FROM (SELECT qid, chunk_id, {vw} / (60 + rank) AS s FROM a UNION ALL SELECT qid, chunk_id, {kw} / (60 + rank) FROM b WHERE qid IN (SELECT id FROM v)) GROUP BY qid, chunk_id)
     SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) AS INT) AS rank, chunk_id, round(score, 6) AS score FROM f QUALIFY rank <= 10"""


_JUDGED = f"""{_V}, a AS ({_vector_sql(20, queries='id % 20 = 0')}),
  j AS (SELECT qid, CAST(o.label AS VARCHAR) AS category, rank - 1 AS rank, f.label = o.label AS hit FROM a JOIN v f ON f.id = a.chunk_id JOIN v o ON o.id = a.qid WHERE a.chunk_id <> a.qid AND rank > 1),
  s AS (SELECT qid, category, coalesce(1 / min(rank) FILTER (hit), 0) AS rr, least(count(*) FILTER (hit), 10) AS m, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10), 0) AS dcg,
     {', '.join(f'CAST(bool_or(hit AND rank <= {k}) AS INT) AS hit_{k}' for k in (1, 3, 5, 10))} FROM j GROUP BY qid, category),
  o AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, m + 1), lambda i: 1 / log2(i + 1))) END AS ndcg FROM s)"""
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("rr", "ndcg", "hit_1", "hit_3", "hit_5", "hit_10"))

_GOLDEN = f"""{_V}, {_KW},
  ch AS (SELECT doc_id AS id, source AS doc, doc_id % 3 AS level, doc_id // 10 AS page FROM documents WHERE text IS NOT NULL),
  gq AS (SELECT item_id AS qid, level, doc, page FROM benchmark JOIN ch ON ch.id = item_id WHERE item_id IN (SELECT id FROM v)),
  par AS (SELECT id, CASE WHEN level > 0 THEN id - 1 END AS p FROM ch),
  anc AS (SELECT a.id, a.p AS to_id FROM par a WHERE a.p IS NOT NULL UNION SELECT a.id, b.p FROM par a JOIN par b ON b.id = a.p WHERE b.p IS NOT NULL),
  rel AS (SELECT qid, qid AS id FROM gq UNION SELECT qid, to_id FROM gq JOIN anc ON anc.id = qid UNION SELECT qid, anc.id FROM gq JOIN anc ON anc.to_id = qid
          UNION SELECT qid, qid - 3 FROM gq WHERE qid >= 3 UNION SELECT qid, qid + 3 FROM gq)"""


def _run_sql(mode, level, vw, kw, name):
    """SQL of one configuration: rows (config, qid, category, rr, …)."""
    where = "true" if level is None else f"id % 3 = {level}"
    in_ch = f"id IN (SELECT id FROM ch) AND {where}"
    wide = 40 if mode == "hybrid" else 10
    vec = f"SELECT * FROM ({_vector_sql(wide, where=where if level is None else in_ch, queries='id IN (SELECT qid FROM gq)')})"
    key = _keyword_sql(wide, where=in_ch).replace("FROM q1 JOIN p", "FROM (SELECT * FROM q1 WHERE qid IN (SELECT qid FROM gq)) q1 JOIN p")
    if mode == "hybrid":
        found = f"""SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, chunk_id) AS INT) AS rank, chunk_id FROM (SELECT qid, chunk_id, sum(s) AS s FROM
          (SELECT qid, chunk_id, {vw} / (60 + rank) AS s FROM ({vec}) UNION ALL SELECT qid, chunk_id, {kw} / (60 + rank) FROM ({key})) GROUP BY ALL) QUALIFY rank <= 10"""
    else:
        found = f"SELECT qid, rank, chunk_id FROM ({vec if mode == 'vector' else key})"
    return f"""SELECT '{name}' AS config, gq.qid, CAST(gq.level AS VARCHAR) AS category, coalesce(1 / min(r.rank) FILTER (hit), 0) AS rr,
      coalesce(sum(1 / log2(r.rank + 1)) FILTER (hit AND r.rank <= 5), 0) / greatest(list_sum(list_transform(range(1, least(count(*) FILTER (hit), 5) + 1), lambda i: 1 / log2(i + 1))), 1e-9) AS nd,
      count(r.rank) AS num_retrieved, min(r.rank) FILTER (hit) AS first_relevant_rank, coalesce(CAST(bool_or(hit AND r.rank <= 1) AS INT), 0) AS hit_1, coalesce(CAST(bool_or(hit AND r.rank <= 10) AS INT), 0) AS hit_10,
      coalesce(CAST(bool_or(loose AND r.rank <= 1) AS INT), 0) AS loose_1, coalesce(CAST(bool_or(loose AND r.rank <= 10) AS INT), 0) AS loose_10
      FROM gq LEFT JOIN (SELECT f.qid, f.rank, rel.id IS NOT NULL AS hit, f.chunk_id = f.qid OR (ch.doc = g.doc AND ch.page = g.page) AS loose FROM ({found}) f JOIN ch ON ch.id = f.chunk_id JOIN gq g ON g.qid = f.qid LEFT JOIN rel ON rel.qid = f.qid AND rel.id = f.chunk_id) r ON r.qid = gq.qid
      GROUP BY gq.qid, gq.level"""


_MATRIX = " UNION ALL ".join(_run_sql(c.mode, c.level, c.vector_weight, c.keyword_weight, c.name) for c in evaluate.standard())
_MATRIX_MEANS = "count(*) AS n, " + ", ".join(f"round(avg({x}), 6) AS {c}" for c, x in (("rr", "rr"), ("ndcg", "coalesce(nd, 0)"), ("hit_1", "hit_1"), ("hit_10", "hit_10"), ("loose_1", "loose_1"), ("loose_10", "loose_10")))

QUERIES = {
    "vector_topk": (vector_topk, _vector(10)),
    "vector_topk_filtered": (vector_topk_filtered, _vector(10, where="label = 3")),
    "vector_topk_compat": (vector_topk_compat, _vector(10, where="label = 3", wide=50)),
    "vector_cosine": (vector_cosine, _vector(10, metric="1 - list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e)))")),
    "vector_batch": (vector_batch, _vector(5, queries="id % 20 = 0")),
    "keyword_terms": (keyword_terms, f"WITH {_KW} SELECT qid, CAST(ord AS BIGINT) AS ord, term AS keyword FROM q1"),
    "term_statistics": (term_statistics, f"WITH {_KW} SELECT term, df, CAST(cf AS BIGINT) AS cf FROM dfs"),
    "keyword_bm25": (keyword_bm25, _keyword(10, exponent=0.0)),
    "keyword_coverage": (keyword_coverage, _keyword(10)),
    "keyword_filtered": (keyword_filtered, _keyword(10, where="lang = 'en'")),
    "hybrid_rrf": (hybrid_rrf, _hybrid_sql(1.0, 1.0)),
    "hybrid_vec_tilt": (hybrid_vec_tilt, _hybrid_sql(2.0, 1.0)),
    "hybrid_kw_tilt": (hybrid_kw_tilt, _hybrid_sql(1.0, 2.0)),
    "eval_outcomes": (eval_outcomes, f"WITH {_JUDGED} SELECT qid, category, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg, hit_1, hit_3, hit_5, hit_10 FROM o"),
    "eval_by_category": (eval_by_category, f"WITH {_JUDGED} SELECT category, count(*) AS n, {_MEANS} FROM o GROUP BY category UNION ALL SELECT 'overall', count(*), {_MEANS} FROM o"),
    "ablation_matrix": (ablation_matrix, f"WITH {_GOLDEN}, m AS ({_MATRIX}) SELECT config, category, {_MATRIX_MEANS} FROM m GROUP BY config, category UNION ALL SELECT config, 'overall', {_MATRIX_MEANS} FROM m GROUP BY config"),
    "golden_outcomes": (golden_outcomes, f"WITH {_GOLDEN}, m AS ({_run_sql('keyword', None, 1.0, 1.0, 'k')}) SELECT qid, category, round(rr, 6) AS rr, round(coalesce(nd, 0), 6) AS ndcg, num_retrieved, first_relevant_rank, hit_1, hit_10, loose_1, loose_10 FROM m"),
    "navigate_parent": (navigate_parent, f"WITH {TREE} SELECT id AS chunk_id, parent_id AS parent FROM t WHERE parent_id IS NOT NULL"),
    "navigate_children": (navigate_children, f"WITH {TREE} SELECT parent_id AS chunk_id, id AS child FROM t WHERE parent_id IS NOT NULL"),
    "sibling_counts": (sibling_counts, f"WITH {TREE} SELECT a.id AS chunk_id, count(*) AS n_siblings FROM t a JOIN t b ON a.parent_id = b.parent_id AND a.id <> b.id GROUP BY a.id"),
    "ancestor_pairs": (ancestor_pairs, f"WITH RECURSIVE {TREE}, u AS (SELECT id, parent_id AS ancestor, 1 AS distance FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT u.id, t.parent_id, distance + 1 FROM u JOIN t ON t.id = u.ancestor WHERE t.parent_id IS NOT NULL) SELECT id AS chunk_id, ancestor, distance FROM u"),
    "lineage_relevant": (lineage_relevant, f"""WITH {TREE}, g AS (SELECT * FROM t WHERE level = 1) SELECT DISTINCT item, chunk_id FROM (SELECT id AS item, id AS chunk_id FROM g UNION ALL SELECT id, parent_id FROM g UNION ALL SELECT id, prev_id FROM g
        UNION ALL SELECT id, next_id FROM g UNION ALL SELECT g.id, t.id FROM g JOIN t ON t.parent_id = g.id) WHERE chunk_id IS NOT NULL"""),
}
