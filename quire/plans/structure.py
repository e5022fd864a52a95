"""Outline and chunk graph queries. Documents serve as outlines: four lines are a section, three sections a chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import chunking, graph, navigate, outline
from quire.plans.documents import elements
from quire.plans.retrieval import table


def lines_outline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sections, elements) with tables, lists and figures among the lines."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    section = F.floor(F.col("ord") / 4).cast("int")
    kind = F.when(F.col("ord") % 7 == 3, "table").when(F.col("ord") % 11 == 5, "list").when(F.col("ord") % 13 == 6, "figure").otherwise("text")
    none = lambda t: F.lit(None).cast(t)
    own = lines.withColumns({"section_id": section, "element_type": kind, "page": (F.floor(F.col("ord") / 10) + 1).cast("int")})
    els = own.select("doc_id", "section_id", "ord", "element_type", F.when(kind == "figure", "[Figure]").otherwise(F.col("text")).alias("text"), "page", F.concat("doc_id", F.lit("#"), F.col("ord").cast("string")).alias("block_id"), F.when(kind == "figure", F.col("text")).alias("caption"), none("int").alias("width_px"), none("int").alias("height_px"))
    root = (F.col("section_id") - F.col("section_id") % 3).alias("root_id")
    heads = own.groupBy("doc_id", "section_id").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    sections = heads.select("doc_id", "section_id", F.when(F.col("section_id") % 3 != 0, root).alias("parent_id"), root, F.when(F.col("section_id") % 3 == 0, 0).otherwise(1).alias("level"), F.concat(F.lit("Part "), F.col("section_id").cast("string")).alias("title"), "page_start", "page_end")
    pages = own.groupBy("doc_id").agg(F.max("page").alias("total_pages"))
    docs = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title")).join(pages, "doc_id")
    return docs, sections, els


_LINES = """l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, t AS text, seq, seq // 4 AS section_id, seq // 4 - (seq // 4) % 3 AS root_id, CAST(seq // 10 + 1 AS INT) AS page,
    CASE WHEN seq % 7 = 3 THEN 'table' WHEN seq % 11 = 5 THEN 'list' WHEN seq % 13 = 6 THEN 'figure' ELSE 'text' END AS kind FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents WHERE text IS NOT NULL))"""


def _fold(items: str, size: str, budget: int, alone: str = "false") -> str:
    """SQL: group numbers of a list of structs, packed greedily; an item alone is a group of its own."""
    fits = f"(NOT a.s AND NOT x.s AND a.u + x.u <= {budget})"
    return (
        f"list_reduce(list_transform({items}, lambda y: {{'u': y.{size}, 's': {alone}, 'g': 0, 'o': [0]}}), lambda a, x: "
        f"{{'u': CASE WHEN {fits} THEN a.u + x.u ELSE x.u END, 's': x.s, 'g': CASE WHEN {fits} THEN a.g ELSE a.g + 1 END, 'o': list_append(a.o, CASE WHEN {fits} THEN a.g ELSE a.g + 1 END)}}).o"
    )


def micro_sql(source: str) -> str:
    """CTEs from ``source`` (doc_id, section, ord, kind, text, page) to micro (…, idx, tok): pieces of up to 128 tokens."""
    trim = lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
    mark = "chr(57344)"
    return f"""
    m1 AS (SELECT *, {trim('text')} AS x FROM {source}),
    m2 AS (SELECT doc_id, section, ord, kind, page, x, string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || {mark}, 'g'), {mark}) AS ss FROM m1 WHERE kind IN ('text', 'list') AND x <> ''),
    m3 AS (SELECT doc_id, section, ord, kind, page, i, ss[i] AS s, greatest(1, length(ss[i]) // 4) AS tok FROM m2, unnest(range(1, len(ss) + 1)) u(i) WHERE greatest(1, length(x) // 4) > 128),
    m4 AS (SELECT doc_id, section, ord, kind, page, i, 0 AS j, s, tok, false AS word FROM m3 WHERE tok <= 128
           UNION ALL SELECT doc_id, section, ord, kind, page, i, j, w, greatest(1, length(w) // 4), true FROM (SELECT *, unnest(string_split_regex(s, '\\s+')) AS w, generate_subscripts(string_split_regex(s, '\\s+'), 1) AS j FROM m3 WHERE tok > 128) WHERE w <> ''),
    m5 AS (SELECT *, CASE WHEN word THEN 2 * i ELSE 2 * coalesce(max(CASE WHEN word THEN i END) OVER (PARTITION BY doc_id, ord ORDER BY i, j), 0) + 1 END AS run FROM m4),
    m6 AS (SELECT doc_id, section, ord, kind, page, run, list({{'s': s, 'tok': tok}} ORDER BY i, j) AS items FROM m5 GROUP BY ALL),
    m7 AS (SELECT *, {_fold('items', 'tok', 128)} AS g FROM m6),
    m8 AS (SELECT doc_id, section, ord, kind, page, run, unnest(items).s AS s, unnest(g) AS g, generate_subscripts(g, 1) AS k FROM m7),
    m9 AS (SELECT doc_id, section, ord, kind, page, run, g, {trim("string_agg(s, ' ' ORDER BY k)")} AS text FROM m8 GROUP BY ALL
           UNION ALL SELECT doc_id, section, ord, kind, page, 0, 0, x FROM m1 WHERE kind IN ('text', 'list') AND x <> '' AND greatest(1, length(x) // 4) <= 128
           UNION ALL SELECT doc_id, section, ord, kind, page, 0, 0, CASE WHEN kind = 'figure' THEN coalesce(nullif(text, ''), '[Figure]') ELSE text END FROM m1 WHERE kind IN ('table', 'figure')),
    micro AS (SELECT doc_id, section, ord, kind, page, text, CAST(greatest(1, length(text) // 4) AS INT) AS tok, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, ord, run, g) - 1 AS INT) AS idx FROM m9 WHERE text <> '' OR kind IN ('table', 'figure')),
    n1 AS (SELECT doc_id, section, list({{'tok': tok, 'kind': kind, 'text': text, 'page': page, 'idx': idx, 'ord': ord}} ORDER BY idx) AS items FROM micro GROUP BY ALL),
    n2 AS (SELECT *, {_fold('items', 'tok', 512, "y.kind IN ('table', 'figure') AND y.tok > 128")} AS g FROM n1),
    n3 AS (SELECT doc_id, section, unnest(items) AS x, unnest(g) AS g FROM n2),
    meso AS (SELECT doc_id, section, g, string_agg(x.text, chr(10) || chr(10) ORDER BY x.idx) AS text, CASE WHEN count(DISTINCT x.kind) = 1 THEN any_value(x.kind) ELSE 'mixed' END AS layout_type,
                    min(x.page) AS p1, max(x.page) AS p2, min(x.ord) AS ord, count(*) AS n_children, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section, g) - 1 AS INT) AS idx FROM n3 GROUP BY doc_id, section, g)"""


_PLAIN = "e AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0 AS section, seq AS ord, 'text' AS kind, t AS text, CAST(seq // 10 + 1 AS INT) AS page FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents WHERE text IS NOT NULL))"
_GRAPH = f"{_LINES}, e AS (SELECT doc_id, root_id // 3 AS section, seq AS ord, kind, text, page FROM l)"


def micro_chunks(spark, sf_dir):
    return chunking.micro_chunks(elements(spark, sf_dir)).select("id", "doc_id", "idx", "text", "token_count", "layout_type", F.get("page_numbers", F.lit(0)).alias("page"))


def meso_chunks(spark, sf_dir):
    m = chunking.meso_chunks(chunking.meso_groups(chunking.micro_chunks(elements(spark, sf_dir))))
    return m.select("id", "doc_id", "idx", "text", "token_count", "layout_type", text.page_label(F.col("page_numbers")).alias("pages"), "n_children")


def split(spark, sf_dir) -> DataFrame:
    return graph.split_document(*lines_outline(spark, sf_dir))


def chunk_graph(spark, sf_dir):
    """All chunks of the outlines with their links; texts as digests."""
    c = graph.link(split(spark, sf_dir))
    return c.select("id", "level", F.md5("text").alias("text_md5"), "token_count", "layout_type", text.page_label(F.col("page_numbers")).alias("pages"), "doc_title", "chapter_title", "section_title", "parent_id", "chapter_root_id", "prev_id", "next_id", "seq")


def chapter_pages(spark, sf_dir):
    _, s, e = lines_outline(spark, sf_dir)
    c = outline.coverage(s, e).join(s.select("doc_id", "section_id", "parent_id"), ["doc_id", "section_id"])
    return c.select("doc_id", "section_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "element_count")


def outline_summary(spark, sf_dir):
    out = outline.summary(*lines_outline(spark, sf_dir))
    kind = lambda k: F.coalesce(F.try_element_at("elements_by_type", F.lit(k)), F.lit(0)).alias(k)
    return out.select("doc_id", "title", "total_pages", "top_level_sections", "total_sections", "total_elements", *(kind(k) for k in ("text", "table", "list", "figure")))


def outline_text(spark, sf_dir):
    _, s, e = lines_outline(spark, sf_dir)
    return outline.text_dump(s, e).select("doc_id", F.md5("text").alias("text_md5"))


def graph_levels(spark, sf_dir):
    return graph.counts_by_level(split(spark, sf_dir))


def meso_weights(spark, sf_dir):
    return graph.summary_weights(split(spark, sf_dir)).select("id", F.round("mean_weight", 9).alias("mean_weight"), "n")


def figure_context(spark, sf_dir):
    """Context texts of figures: breadcrumb, caption, neighbours, text."""
    c = graph.enrich(graph.link(split(spark, sf_dir)))
    return c.where("layout_type = 'figure' and level = 2").select("id", F.md5("context_text").alias("context_md5"))


def chapter_contexts(spark, sf_dir):
    """Contexts of chapters before any summary."""
    return graph.chapter_context(split(spark, sf_dir)).select("id", "context")


def chapter_summaries(spark, sf_dir):
    return graph.summaries(split(spark, sf_dir)).select("id", "summary")


def graph_children(spark, sf_dir):
    """How many chunks a step to the children gives."""
    c = split(spark, sf_dir)
    return navigate.navigate(c.select("id"), c, "children").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def heading_parents(spark, sf_dir):
    """Events as headings of levels 0 to 3: the nearest earlier one that is shallower."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("ord"), F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(4)).cast("int").alias("level"))
    return outline.nest(e, 4).select("doc_id", "ord", "level", "parent")


def continued_sections(spark, sf_dir):
    """Every third section of a chapter is a continuation of the one before."""
    d, s, e = lines_outline(spark, sf_dir)
    s = s.withColumn("title", F.when(F.col("section_id") % 3 == 2, F.concat(F.lit("Part "), (F.col("section_id") - 1).cast("string"), F.lit(" (Continued)"))).otherwise(F.col("title")))
    s, e = outline.merge_continued(s, e)
    n = e.groupBy("doc_id", "section_id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, ["doc_id", "section_id"]).select("doc_id", "section_id", "parent_id", "title", "page_end", "n")


def numbered_headings(spark, sf_dir):
    """Order dates as dotted numbers."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.regexp_replace(F.col("o_orderdate").cast("string"), "-0?", "."), F.lit(". "), "o_orderpriority").alias("title"))
    n = outline.numbering(F.col("title"))
    return o.select("o_orderkey", n["depth"].alias("depth"), n["leading"].alias("leading"))


def numbering_absent(spark, sf_dir):
    o = table(spark, sf_dir, "part").select("p_partkey", outline.numbering(F.col("p_name")).isNull().alias("plain"))
    return o


QUERIES = {
    "micro_chunks": (micro_chunks, f"WITH {_PLAIN}, {micro_sql('e')} SELECT doc_id || ':L2:' || idx AS id, doc_id, idx, text, tok AS token_count, kind AS layout_type, page FROM micro"),
    "meso_chunks": (meso_chunks, f"""WITH {_PLAIN}, {micro_sql('e')} SELECT doc_id || ':L1:' || idx AS id, doc_id, idx, text, CAST(greatest(1, length(text) // 4) AS INT) AS token_count, layout_type,
        CASE WHEN p1 = p2 THEN CAST(p1 AS VARCHAR) ELSE p1 || '-' || p2 END AS pages, n_children FROM meso"""),
    "chunk_graph": (chunk_graph, f"""WITH {_GRAPH}, {micro_sql('e')}, titles AS (SELECT DISTINCT doc_id, source AS doc_title FROM l),
        a AS (SELECT doc_id, root_id // 3 AS section, min(page) AS p1, max(page) AS p2 FROM l GROUP BY ALL),
        o AS (SELECT doc_id || ':L2:' || x.idx AS id, doc_id || ':L1:' || meso.idx AS parent_id FROM n3 JOIN meso USING (doc_id, section, g)),
        c AS (SELECT doc_id || ':L0:' || section AS id, doc_id, 0 AS level, '' AS text, 0 AS token_count, 'mixed' AS layout_type, p1, p2, section, 'Part ' || section * 3 AS section_title, NULL AS parent_id, NULL AS chapter_root_id, section AS idx, 0 AS turn FROM a
          UNION ALL SELECT doc_id || ':L2:' || idx, doc_id, 2, text, tok, kind, page, page, section, 'Part ' || ord // 4, o.parent_id, doc_id || ':L0:' || section, idx, 1 FROM micro JOIN o ON o.id = doc_id || ':L2:' || idx
          UNION ALL SELECT doc_id || ':L1:' || idx, doc_id, 1, text, greatest(1, length(text) // 4), layout_type, p1, p2, section, 'Part ' || ord // 4, doc_id || ':L0:' || section, doc_id || ':L0:' || section, idx, 2 FROM meso)
        SELECT id, CAST(level AS INT) AS level, md5(text) AS text_md5, CAST(token_count AS INT) AS token_count, layout_type, CASE WHEN p1 = p2 THEN CAST(p1 AS VARCHAR) ELSE p1 || '-' || p2 END AS pages, doc_title, 'Part ' || section * 3 AS chapter_title, section_title,
          parent_id, chapter_root_id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, turn, idx) - 1 AS seq
        FROM c JOIN titles USING (doc_id) WINDOW w AS (PARTITION BY doc_id, level ORDER BY idx)"""),
    "chapter_pages": (chapter_pages, f"""WITH {_LINES}, s AS (SELECT DISTINCT doc_id, section_id, root_id FROM l), b AS (SELECT s.doc_id, s.section_id, l.page FROM s JOIN l ON l.doc_id = s.doc_id AND (l.section_id = s.section_id OR (s.section_id = s.root_id AND l.root_id = s.root_id)))
        SELECT doc_id, CAST(section_id AS INT) AS section_id, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, count(*) AS element_count FROM b GROUP BY ALL"""),
    "outline_summary": (outline_summary, f"""WITH {_LINES} SELECT doc_id, any_value(source) AS title, max(page) AS total_pages, count(DISTINCT root_id) AS top_level_sections, count(DISTINCT section_id) AS total_sections, count(*) AS total_elements,
        count(*) FILTER (kind = 'text') AS text, count(*) FILTER (kind = 'table') AS "table", count(*) FILTER (kind = 'list') AS list, count(*) FILTER (kind = 'figure') AS figure FROM l GROUP BY doc_id"""),
    "outline_text": (outline_text, f"""WITH {_LINES}, b AS (SELECT doc_id, section_id, string_agg(CASE WHEN kind = 'figure' THEN '[Figure]' ELSE text END, chr(10) || chr(10) ORDER BY seq) FILTER (trim(text) <> '' OR kind = 'figure') AS body FROM l GROUP BY ALL)
        SELECT doc_id, md5(string_agg(concat_ws(chr(10) || chr(10), repeat('#', CASE WHEN section_id % 3 = 0 THEN 1 ELSE 2 END) || ' Part ' || section_id, body), chr(10) || chr(10) ORDER BY section_id)) AS text_md5 FROM b GROUP BY doc_id"""),
    "graph_levels": (graph_levels, f"""WITH {_GRAPH}, {micro_sql('e')}, a AS (SELECT doc_id, count(DISTINCT root_id) AS macro FROM l GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS meso FROM meso GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS micro FROM micro GROUP BY doc_id)
        SELECT doc_id, macro + coalesce(meso, 0) + coalesce(micro, 0) AS total, macro, coalesce(meso, 0) AS meso, coalesce(micro, 0) AS micro FROM a LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""),
    "meso_weights": (meso_weights, f"""WITH {_GRAPH}, {micro_sql('e')} SELECT meso.doc_id || ':L1:' || meso.idx AS id, round(avg(CASE x.kind WHEN 'table' THEN 1.5::DOUBLE WHEN 'figure' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END), 9) AS mean_weight, count(*) AS n FROM n3 JOIN meso USING (doc_id, section, g) GROUP BY ALL"""),
    "figure_context": (figure_context, f"""WITH {_GRAPH}, {micro_sql('e')}, w AS (SELECT *, lag(text) OVER v AS p, lead(text) OVER v AS q FROM micro WINDOW v AS (PARTITION BY doc_id ORDER BY idx)), t AS (SELECT DISTINCT doc_id, source FROM l)
        SELECT doc_id || ':L2:' || idx AS id, md5(concat_ws(chr(10), 'Document: ' || source || ' > Chapter: Part ' || section * 3 || CASE WHEN ord // 4 <> section * 3 THEN ' > Section: Part ' || ord // 4 ELSE '' END || ' > Content type: Figure/Diagram > Page: ' || page, '---',
          'Caption: ' || CASE WHEN text = '[Figure]' THEN NULL ELSE text END, 'Surrounding context: ' || nullif(concat_ws(' [...] ', nullif(substring(p, 1, 300), ''), nullif(substring(q, 1, 300), '')), ''), text)) AS context_md5 FROM w JOIN t USING (doc_id) WHERE kind = 'figure'"""),
    "chapter_contexts": (chapter_contexts, f"""WITH {_GRAPH}, {micro_sql('e')}, t AS (SELECT doc_id, root_id // 3 AS section, any_value(source) AS source, min(page) AS p1, max(page) AS p2 FROM l GROUP BY ALL), k AS (SELECT doc_id, section, ord // 4 AS s, min(idx) AS f FROM meso GROUP BY ALL), j AS (SELECT doc_id, section, string_agg('Part ' || s, ' | ' ORDER BY f) AS line FROM k GROUP BY ALL)
        SELECT doc_id || ':L0:' || section AS id, concat_ws(chr(10), 'Document: ' || source || ' > Chapter: Part ' || section * 3 || CASE WHEN p1 = p2 THEN ' > Page: ' || p1 ELSE ' > Pages: ' || p1 || '-' || p2 END, '---', 'Subsections: ' || line, CASE WHEN line IS NOT NULL THEN '---' END) AS context FROM t LEFT JOIN j USING (doc_id, section)"""),
    "chapter_summaries": (chapter_summaries, None),
    "graph_children": (graph_children, f"""WITH {_GRAPH}, {micro_sql('e')} SELECT doc_id || ':L0:' || section AS id, count(*) AS n FROM meso GROUP BY ALL UNION ALL SELECT doc_id || ':L1:' || idx, n_children FROM meso"""),
    "heading_parents": (heading_parents, """WITH h AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id AS ord, CAST((event_id * 7 + user_id) % 4 AS INT) AS level FROM events)
        SELECT doc_id, ord, level, greatest(CASE WHEN level > 0 THEN max(CASE WHEN level = 0 THEN ord END) OVER w END, CASE WHEN level > 1 THEN max(CASE WHEN level = 1 THEN ord END) OVER w END, CASE WHEN level > 2 THEN max(CASE WHEN level = 2 THEN ord END) OVER w END) AS parent
        FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "continued_sections": (continued_sections, f"""WITH {_LINES}, k AS (SELECT *, CASE WHEN section_id % 3 = 2 THEN section_id - 1 ELSE section_id END AS s FROM l)
        SELECT doc_id, CAST(s AS INT) AS section_id, CAST(CASE WHEN s % 3 <> 0 THEN s - s % 3 END AS INT) AS parent_id, 'Part ' || s AS title, max(page) AS page_end, count(*) AS n FROM k GROUP BY doc_id, s"""),
    "numbered_headings": (numbered_headings, "SELECT o_orderkey, CAST(3 AS INT) AS depth, CAST(year(o_orderdate) AS BIGINT) AS leading FROM orders"),
    "numbering_absent": (numbering_absent, "SELECT p_partkey, NOT regexp_matches(trim(p_name), '^\\d+(\\.\\d+)*\\.?\\s+\\S') AS plain FROM part"),
}
