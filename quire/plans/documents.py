"""Store, chunking, table, layout and cost queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import chunking, control, costs, layout, navigate, search, store, tables, views
from quire.plans.retrieval import table


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document is a text element; ten lines make a page; a document is one section."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    none = F.lit(None)
    return lines.select("doc_id", F.lit(0).alias("section"), "ord", F.lit("text").alias("element_type"), "text", (F.floor(F.col("ord") / 10) + 1).cast("int").alias("page"), none.cast("string").alias("caption"), none.cast("int").alias("width_px"), none.cast("int").alias("height_px"))


def lines_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks, unsplit: doc_id, seq, level, text, page_numbers, project (source), group (lang)."""
    d = table(spark, sf_dir, "documents")
    c = d.select("doc_id", F.col("source").alias("project_id"), F.col("lang").alias("group_name"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return c.withColumn("level", F.pmod("seq", F.lit(3))).withColumn("page_numbers", F.array((F.floor(F.col("seq") / 10) + 1).cast("int"))).withColumn("layout_type", F.lit("text"))


LINES = """c AS (SELECT doc_id, source AS project_id, lang AS group_name, t AS text, seq, seq % 3 AS level, seq // 10 + 1 AS page FROM (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents WHERE text IS NOT NULL))"""


def filter_page_range(spark, sf_dir):
    return lines_as_chunks(spark, sf_dir).where(search.chunk_filter(min_page=2, max_page=3)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def filter_levels(spark, sf_dir):
    return lines_as_chunks(spark, sf_dir).where(search.chunk_filter(level=[0, 2])).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def filter_combo(spark, sf_dir):
    return lines_as_chunks(spark, sf_dir).where(search.chunk_filter(project_id="src3", group_name="en", level=1, layout_types=["text"], max_page=2)).select("doc_id", F.col("seq").cast("long").alias("seq"), "text")


def filter_no_level(spark, sf_dir):
    return lines_as_chunks(spark, sf_dir).where(search.chunk_filter(level=[])).select("doc_id", F.col("seq").cast("long").alias("seq"))


def stats_by_level(spark, sf_dir):
    c = lines_as_chunks(spark, sf_dir).rollup("level").agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("level") == 0, "macro").when(F.col("level") == 1, "meso").when(F.col("level") == 2, "micro").otherwise("total")
    return c.select(name.alias("level"), "n")


def ingested_docs(spark, sf_dir):
    c = lines_as_chunks(spark, sf_dir).withColumn("created_at", F.col("seq")).withColumn("doc_title", F.col("text"))
    return store.ingested(c).select("doc_id", "n_chunks", F.col("title"), F.col("page_count"))


def list_documents(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    side = d.select("doc_id", "source", "lang").join(l, "doc_id", "left")
    chunks = lines_as_chunks(spark, sf_dir).withColumns({"created_at": F.col("seq"), "doc_title": F.col("text")})
    return views.document_metadata(side, chunks).select("doc_id", "source", "lang", "quality", "toxic", "doc_title", "page_count")


def metadata_attributes(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    side = d.join(l, "doc_id").select("doc_id", F.array("source", "lang").alias("tags"), F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")).alias("attributes"))
    return side.where(store.has_tags(F.col("tags"), ["src3", "en"]) & (F.try_element_at("attributes", F.lit("toxic")) == "1")).select("doc_id")


def mpn_token_match(spark, sf_dir):
    """Part types as alias lists: those of which one alias is STEEL."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_type", " ", ",").alias("mpn"))
    return p.where(store.mpn_matches(F.col("mpn"), "STEEL")).select("p_partkey", store.add_alias(F.col("mpn"), "NEW").alias("mpn"))


def doc_prefix_resolve(spark, sf_dir):
    """Ids by prefix: how many documents each two-digit prefix names."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    chunks = d.select(F.col("id").alias("doc_id"))
    short = d.select(F.concat(F.substring("id", 1, 2), F.lit(":L2:0")).alias("chunk_id")).distinct()
    return views.resolve_ids(short, chunks).select("chunk_id", "full")


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))


def sentence_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(text.strip(F.col("text")), text.SENTENCE)).cast("long").alias("n_sentences"))


def micro_count_by_document(spark, sf_dir):
    """Chunks must keep every word: words of the chunks against words of the text."""
    m = chunking.micro_chunks(elements(spark, sf_dir)).groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("n_words"))
    return m.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words")


def link_prev_next(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("id", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))
    return chunking.verify_links(chunking.link(c, ["conv_id"], "turn"), ["prev_id", "next_id"]).select("id", "prev_id", "next_id")


def neighbour_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", chunking.neighbour_context("text", ["conv_id"], "turn").alias("context"))


def context_strings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc_title"), F.col("lang").alias("chapter_title"), F.lit("en").alias("section_title"), F.lit("table").alias("layout_type"), F.array(F.lit(1), F.lit(3)).alias("page_numbers"), "text")
    d = d.withColumn("context", chunking.context_string())
    return d.select("doc_id", "context", F.md5(chunking.context_text(F.col("context"), F.col("text"))).alias("context_text_md5"))


def upsert_keep_title(spark, sf_dir):
    """Labelled documents come in again without a source; the stored one stays, the new language wins."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    old = d.select("doc_id", "source", "lang")
    new = l.select("doc_id", F.lit("").alias("source"), F.lit("xx").alias("lang")).unionByName(l.agg((F.max("doc_id") + 1_000_000).alias("doc_id")).select("doc_id", F.lit("new").alias("source"), F.lit("yy").alias("lang")))
    return store.upsert(old, new, "doc_id", keep_if_blank=("source",))


def apply_metadata(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chunks = d.select("doc_id", F.col("source").alias("project_id"), F.col("lang").alias("group_name"))
    side = l.select("doc_id", F.when(F.col("quality") == 1, F.lit("good")).alias("project_id"), F.when(F.col("toxic") == 1, F.lit("toxic")).alias("group_name"))
    return store.apply_metadata(chunks, side).select("doc_id", "project_id", "group_name")


def metadata_merge(spark, sf_dir):
    """Attributes {a: source, b: lang} merged with {b: null, c: quality} for labelled documents."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    s = "map<string,string>"
    old = d.select("doc_id", F.col("source").alias("mpn"), F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.col("lang")).cast(s).alias("attributes"))
    new = l.select("doc_id", F.lit(None).cast("string").alias("mpn"), F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.col("quality").cast("string")).cast(s).alias("attributes"))
    m = store.set_metadata(old, new)
    at = lambda k: F.try_element_at("attributes", F.lit(k)).alias(k)
    return m.select("doc_id", "mpn", at("a"), at("b"), at("c"))


def delete_cascade(spark, sf_dir):
    c = lines_as_chunks(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))
    return store.delete_docs(c, ["1", "2", "3"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("doc_id").cast("long").alias("doc_id"), "n")


def ingest_antijoin(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return store.new_documents(d.select("doc_id"), l)


def audit_recent(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.withColumnsRenamed({"event_id": "id"}).withColumn("doc_id", F.col("user_id").cast("string"))
    return control.audit(log, since="2024-01-02").select(F.col("id").alias("event_id"), "user_id", "event_type")


def audit_of_document(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumnsRenamed({"event_id": "id"}).withColumn("doc_id", F.col("user_id").cast("string"))
    return control.audit(log, doc_id="13", limit=20).select("id", "doc_id", "event_type")


def audit_by_user(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def running_header(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return layout.running_header(lines, "source", "line")


def repeated_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.explode(F.split("text", "\n")).alias("title"), F.lit(0).alias("n_elements"))
    pages = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_pages"))
    return layout.repeated_headings(lines, pages)


def section_assign(spark, sf_dir):
    """Turns as blocks: what the user says is a header, the first turn a title."""
    c = table(spark, sf_dir, "conversations").withColumn("kind", F.when(F.col("turn") == 0, "title").when(F.col("role") == "user", "section_header").otherwise("text"))
    return layout.assign_sections(c, "conv_id", "turn").select("conv_id", "turn", "kind", "section", "root")


def nearest_header(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return layout.nearest_before(c, "conv_id", "turn", F.when(F.col("role") == "user", F.md5("text")), "header").select("conv_id", "turn", "header")


def contents_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", layout.is_contents(F.lit("x"), F.split("text", "\n")).alias("is_contents"))


def embed_cost(spark, sf_dir):
    return layout.embedding_cost(table(spark, sf_dir, "documents")).select("tokens", F.round("usd", 8).alias("usd"))


def extractive_digest(spark, sf_dir):
    # The digest is bound to a variable, so that it is made once.
    both = F.transform(F.array(text.digest(F.col("text"), 400)), lambda d: F.struct(F.md5(d).alias("digest_md5"), F.length(d).alias("n_chars")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(both, F.lit(0)).alias("d")).select("doc_id", "d.digest_md5", "d.n_chars")


def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.preview(F.col("text"))).alias("preview_md5"), text.slug(F.substring("text", 1, 60)).alias("slug"))


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a table of three columns: some headers repeat one text, some hold the first order, some cells span two columns."""
    o = table(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = o.select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("k"), F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("v"), n.alias("n"))
    c, wide = F.col("table_id"), (F.col("table_id") % 3 == 0) & (F.col("k") % 2 == 0)
    named = F.array(*map(F.lit, ("Order", "Status", "Priority")))
    title = F.when(c % 5 == 0, F.array_repeat(F.lit("Order summary table"), 3)).when(c % 7 == 0, F.col("v")).otherwise(named)
    cell = lambda span, header, origin: (F.lit(1).alias("row_span"), span.alias("col_span"), "text", F.lit(header).alias("is_header"), F.lit(origin).alias("is_origin"))
    one = F.lit(1)
    head = o.where("n = 1").select("table_id", F.lit(1).alias("row"), F.posexplode(title).alias("i", "text")).select("table_id", "row", (F.col("i") + 1).alias("col"), *cell(one, True, True))
    body = o.select("table_id", (F.col("n") + 1).alias("row"), "k", F.posexplode("v").alias("i", "text"))
    data = body.select("table_id", "row", (F.col("i") + 1).alias("col"), *cell(F.when(wide & (F.col("i") == 2), 2).otherwise(1), False, True))
    copies = body.where(wide & (F.col("i") == 2)).select("table_id", "row", F.lit(4).alias("col"), *cell(F.lit(2), False, False))
    return head.unionByName(data).unionByName(copies)


def _head(col: int, name: str, own: str) -> str:
    return f"SELECT c, 1, {col}, 1, 1, CASE WHEN c % 5 = 0 THEN 'Order summary table' WHEN c % 7 = 0 THEN {own} ELSE '{name}' END, true, true FROM oc WHERE n = 1"


_CELLS = f"""oc AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS n FROM orders),
    cells AS (SELECT *, trim(text) AS t, coalesce(is_origin, true) AS o FROM ({_head(1, 'Order', 'CAST(k AS VARCHAR)')} UNION ALL {_head(2, 'Status', 's')} UNION ALL {_head(3, 'Priority', 'p')}
      UNION ALL SELECT c, n + 1, 1, 1, 1, CAST(k AS VARCHAR), false, true FROM oc UNION ALL SELECT c, n + 1, 2, 1, 1, s, false, true FROM oc
      UNION ALL SELECT c, n + 1, 3, 1, CASE WHEN c % 3 = 0 AND k % 2 = 0 THEN 2 ELSE 1 END, p, false, true FROM oc UNION ALL SELECT c, n + 1, 4, 1, 2, p, false, false FROM oc WHERE c % 3 = 0 AND k % 2 = 0
    ) v(table_id, "row", col, row_span, col_span, text, is_header, is_origin))"""


def table_reasons(spark, sf_dir):
    return tables.untrustworthy(cell_rows(spark, sf_dir)).select("table_id", "garbled", "fused", "reason")


def table_columns(spark, sf_dir):
    return tables.column_counts(cell_rows(spark, sf_dir)).select("table_id", "header_rows", "total_rows", "column_count")


def table_compact_text(spark, sf_dir):
    return tables.compact_text(cell_rows(spark, sf_dir))


def table_reading_order(spark, sf_dir):
    return tables.reading_order_text(cell_rows(spark, sf_dir))


def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as boxes on two pages."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    left, top = F.pmod("p", F.lit(80)) / 100, F.pmod("s", F.lit(70)) / 100
    name = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    return l.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), name.alias("box_id"), left.alias("left"), top.alias("top"), (left + 0.1 + F.pmod("p", F.lit(7)) / 100).alias("right"), (top + 0.2 + F.pmod("s", F.lit(5)) / 100).alias("bottom"))


_BOXES = """bx AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_orderkey || ':' || l_linenumber AS box_id, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber),
    b AS (SELECT doc_id, page, box_id, p % 80 / 100::DOUBLE AS "left", s % 70 / 100::DOUBLE AS "top", p % 80 / 100::DOUBLE + 0.1::DOUBLE + p % 7 / 100::DOUBLE AS "right", s % 70 / 100::DOUBLE + 0.2::DOUBLE + s % 5 / 100::DOUBLE AS "bottom" FROM bx)"""


def crop_caps(spark, sf_dir):
    c = layout.crop_caps(box_rows(spark, sf_dir), 0.05)
    return c.select("box_id", F.round("left_cap", 6).alias("left_cap"), F.round("right_cap", 6).alias("right_cap"))


def bbox_iou(spark, sf_dir):
    b = box_rows(spark, sf_dir)
    s = F.struct("left", "top", "right", "bottom")
    at = ["doc_id", "page"]
    pairs = b.select(*at, F.col("box_id").alias("x"), s.alias("p")).join(b.select(*at, F.col("box_id").alias("y"), s.alias("q")), at).where("x < y")
    return pairs.select("x", "y", F.round(layout.iou("p", "q"), 6).alias("iou"))


def concept_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks and parts as their concepts, as relevant as their quantity."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("concept_id")).agg((F.max("l_quantity") / 50).alias("relevance"))


_LINKS = "l AS (SELECT l_orderkey AS chunk_id, l_partkey AS concept_id, max(l_quantity) / 50 AS relevance FROM lineitem GROUP BY ALL)"


def concept_lateral(spark, sf_dir):
    links = concept_links(spark, sf_dir)
    return navigate.lateral_search(links.select("chunk_id").distinct(), links, 2).select("chunk_id", F.col("to").alias("other"), "concept_rank", "concept_id")


def as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as full chunk rows, linked in order."""
    c = lines_as_chunks(spark, sf_dir).withColumns({"id": F.concat(F.col("doc_id").cast("string"), F.lit(":L"), F.col("level").cast("string"), F.lit(":"), F.col("seq").cast("string"))})
    none = lambda t="string": F.lit(None).cast(t)
    c = c.withColumns({"doc_title": F.col("project_id"), "chapter_title": F.col("group_name"), "section_title": none(), "parent_id": none(), "chapter_root_id": none(), "figure_image_path": none(), "figure_s3_key": none(), "figure_caption": none(), "figure_description": none(), "context_text": F.concat("project_id", F.lit(" "), "text")})
    kind = F.when(F.col("seq") % 5 == 4, "table").when(F.col("seq") % 7 == 3, "figure").otherwise("text")
    c = c.withColumns({"layout_type": kind, "figure_s3_key": F.when(kind == "figure", "k"), "figure_caption": F.when(kind == "figure", F.col("text"))})
    return chunking.link(c, ["doc_id"], "seq")


_ROWS = f"""{LINES}, rw AS (SELECT doc_id || ':L' || level || ':' || seq AS id, *, CASE WHEN seq % 5 = 4 THEN 'table' WHEN seq % 7 = 3 THEN 'figure' ELSE 'text' END AS kind FROM c),
    rn AS (SELECT *, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM rw WINDOW w AS (PARTITION BY doc_id ORDER BY seq))"""


def shaped_chunks(spark, sf_dir):
    s = views.shaped(as_rows(spark, sf_dir).withColumn("score", F.col("seq") / 7))
    return s.select("chunk_id", "level", "page", "section", "chapter", "prev_id", "next_id", "has_figure", "figure_caption", "note", "score")


def packed_round_trip(spark, sf_dir):
    """Chunks packed to rows with JSON and back."""
    c = views.unpacked(views.packed(as_rows(spark, sf_dir)))
    return c.select("id", "doc_title", "chapter_title", "section_title", "layout_type", text.page_label(F.col("page_numbers")).alias("page"))


def neighbour_rows(spark, sf_dir):
    n = views.neighbours(as_rows(spark, sf_dir), ("id",))
    return n.select("id", F.col("prev.id").alias("prev"), F.col("next.id").alias("next"), F.col("parent.id").alias("parent"))


def surrounding_texts(spark, sf_dir):
    return views.surrounding(as_rows(spark, sf_dir), 40)


def short_ids(spark, sf_dir):
    c = as_rows(spark, sf_dir).withColumn("doc_id", F.sha2(F.col("doc_id").cast("string"), 256)).withColumn("id", F.concat("doc_id", F.lit(":L2:"), F.col("seq").cast("string")))
    return c.select("id", views.short_id(F.col("id"), F.col("doc_id")).alias("short"))


def variant_payloads(spark, sf_dir):
    c = as_rows(spark, sf_dir)
    return c.select("id", *(F.md5(views.payload(v)).alias(v) for v in ("raw_text", "context", "no_figure_desc")))


def first_pages(spark, sf_dir):
    c = lines_as_chunks(spark, sf_dir).withColumn("level", F.lit(2))
    return views.first_page_text(c, 500).select("doc_id", F.md5("text").alias("text_md5"))


def chunks_on_pages(spark, sf_dir):
    c = as_rows(spark, sf_dir)
    asked = c.select("doc_id").distinct().withColumn("pages", F.array(F.lit(2), F.lit(4)))
    return views.on_pages(c, asked).select("chunk_id", "level", F.md5("preview").alias("preview_md5"))


def sample_pool(spark, sf_dir):
    """The whole pool of a category: the first 500 chunks by id that fit it; the limit is the sampling operator's."""
    return views.sample_chunks(as_rows(spark, sf_dir), "conceptual", views.SAMPLE_POOL).select("id")


def blank_titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "").when(F.col("lang") == "de", "—").when(F.col("lang") == "fr", F.col("source")).alias("title"))
    return d.where(views.blank_title(F.col("title"))).select("doc_id")


def cost_totals(spark, sf_dir):
    c = as_rows(spark, sf_dir)
    pages = c.groupBy("doc_id").agg(F.max(F.get("page_numbers", F.lit(0))).alias("total_pages"))
    t = costs.total(costs.estimate(c, pages, ocr=True))
    return t.select("label", F.round("amount", 4).alias("amount"), F.round("usd", 6).alias("usd"))


def table_inspection(spark, sf_dir):
    return views.inspect_tables(tables.untrustworthy(cell_rows(spark, sf_dir)))


def table_repairs(spark, sf_dir):
    """Which tables' headers can't be repaired, and why."""
    return tables.repair_eligible(cell_rows(spark, sf_dir))


def header_proposals(spark, sf_dir):
    """Proposed headers of three cells against the tables' bands: gaps, overlaps, garbled ones and leaked data."""
    c = cell_rows(spark, sf_dir)
    bands = tables.column_counts(c).where("column_count = 3").select("table_id", "header_rows", "column_count")
    names = F.when(F.col("table_id") % 4 == 0, F.array_repeat(F.lit("One long header"), 3)).otherwise(F.array(*map(F.lit, ("a", "b", "c"))))
    p = bands.select("table_id", F.posexplode(names).alias("i", "text")).where("table_id % 4 <> 1 or i < 2")
    p = p.select("table_id", F.lit(1).alias("row"), F.when((F.col("table_id") % 4 == 2) & (F.col("i") == 2), 2).otherwise(F.col("i") + 1).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), "text")
    return tables.validate_grid(p, bands, c).select("table_id", "reason")


def concept_related(spark, sf_dir):
    l = concept_links(spark, sf_dir).where("relevance >= 0.9")
    return views.related(l).groupBy("chunk_id").agg(F.count("to").alias("n"))


def review_counts(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "human").otherwise("auto").alias("source"))
    return views.review_summary(d)


def ingest_tally(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("processed").alias("status"))
    return views.tally(e)


def clean_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(views.clean_text(F.regexp_replace("text", " ", "   "))).alias("text_md5"))


def model_answers(spark, sf_dir):
    """Events' props between fences and prose, read back."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("a"), F.concat(F.lit("Sure: "), "props", F.lit(" ok")).alias("b"))
    return e.select("event_id", views.unfenced(F.col("a")).alias("props"), views.json_object(F.col("b"), "k long")["k"].alias("k"))


def table_of_blocks(spark, sf_dir):
    """Pages of lines in reading order: those that the page lists first, in its order."""
    from quire.operators import outline

    l = lines_as_chunks(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "seq", F.get("page_numbers", F.lit(0)).alias("page"))
    kid = F.concat(F.lit("b"), F.col("seq").cast("string"))
    blank = F.expr("cast(array() as array<struct<type:string,ids:array<string>>>)")
    blocks = l.select("doc_id", kid.alias("id"), F.lit("LAYOUT_TEXT").alias("block_type"), "page", (F.col("seq") % 10 / 10).alias("top"), F.lit(0.0).alias("left"), blank.alias("relationships"))
    listed = l.where("seq % 2 = 1").groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list("seq"), False), lambda x: F.concat(F.lit("b"), x.cast("string"))).alias("ids"))
    pages = listed.select("doc_id", F.concat(F.lit("p"), F.col("page").cast("string")).alias("id"), F.lit("PAGE").alias("block_type"), "page", F.lit(0.0).alias("top"), F.lit(0.0).alias("left"), F.array(F.struct(F.lit("CHILD").alias("type"), F.col("ids"))).alias("relationships"))
    return outline.reading_order(blocks.unionByName(pages)).select("doc_id", "id", "ord")


QUERIES = {
    "filter_page_range": (filter_page_range, f"WITH {LINES} SELECT doc_id, count(*) AS n FROM c WHERE page BETWEEN 2 AND 3 GROUP BY doc_id"),
    "filter_levels": (filter_levels, f"WITH {LINES} SELECT CAST(level AS INT) AS level, count(*) AS n FROM c WHERE level IN (0, 2) GROUP BY level"),
    "filter_combo": (filter_combo, f"WITH {LINES} SELECT doc_id, CAST(seq AS BIGINT) AS seq, text FROM c WHERE project_id = 'src3' AND group_name = 'en' AND level = 1 AND page <= 2"),
    "filter_no_level": (filter_no_level, f"WITH {LINES} SELECT doc_id, CAST(seq AS BIGINT) AS seq FROM c WHERE false"),
    "stats_by_level": (stats_by_level, f"WITH {LINES} SELECT ['macro', 'meso', 'micro'][level + 1] AS level, count(*) AS n FROM c GROUP BY level UNION ALL SELECT 'total', count(*) FROM c"),
    "ingested_docs": (ingested_docs, f"WITH {LINES} SELECT doc_id, count(*) AS n_chunks, arg_min(text, seq) FILTER (text <> '') AS title, CAST(max(page) AS INT) AS page_count FROM c GROUP BY doc_id"),
    "list_documents": (list_documents, f"WITH {LINES}, k AS (SELECT doc_id, arg_min(text, seq) FILTER (text <> '') AS doc_title, CAST(max(page) AS INT) AS page_count FROM c GROUP BY doc_id) SELECT doc_id, source, lang, quality, toxic, doc_title, page_count FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN k USING (doc_id)"),
    "metadata_attributes": (metadata_attributes, "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE source = 'src3' AND lang = 'en' AND toxic = 1"),
    "mpn_token_match": (mpn_token_match, "SELECT p_partkey, array_to_string(string_split(p_type, ' '), ',') || ',NEW' AS mpn FROM part WHERE list_contains(string_split(p_type, ' '), 'STEEL')"),
    "doc_prefix_resolve": (doc_prefix_resolve, """WITH d AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents), p AS (SELECT DISTINCT substring(id, 1, 2) AS p FROM d)
        SELECT p || ':L2:0' AS chunk_id, CASE WHEN (SELECT count(*) FROM d WHERE starts_with(id, p)) = 1 THEN (SELECT min(id) FROM d WHERE starts_with(id, p)) || ':L2:0' END AS "full" FROM p"""),
    "token_estimate": (token_estimate, "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents"),
    "sentence_count": (sentence_count, "SELECT doc_id, len(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS n_sentences FROM documents"),
    "micro_count_by_document": (micro_count_by_document, "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents"),
    "link_prev_next": (link_prev_next, "SELECT conv_id || ':' || turn AS id, lag(conv_id || ':' || turn) OVER w AS prev_id, lead(conv_id || ':' || turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "neighbour_context": (neighbour_context, "SELECT conv_id, turn, concat_ws(' [...] ', nullif(substring(lag(text) OVER w, 1, 300), ''), nullif(substring(lead(text) OVER w, 1, 300), '')) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "context_strings": (context_strings, """WITH d AS (SELECT doc_id, text, 'Document: ' || source || ' > Chapter: ' || lang || CASE WHEN lang <> 'en' THEN ' > Section: en' ELSE '' END || ' > Content type: Table > Pages: 1-3' AS context FROM documents)
        SELECT doc_id, context, md5(concat_ws(chr(10), context, '---', nullif(text, ''))) AS context_text_md5 FROM d"""),
    "upsert_keep_title": (upsert_keep_title, "SELECT doc_id, source, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'xx' END AS lang FROM documents d LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id) UNION ALL SELECT max(doc_id) + 1000000, 'new', 'yy' FROM labels"),
    "apply_metadata": (apply_metadata, """SELECT doc_id, CASE WHEN quality = 1 OR toxic = 1 THEN CASE WHEN quality = 1 THEN 'good' END ELSE source END AS project_id,
        CASE WHEN quality = 1 OR toxic = 1 THEN CASE WHEN toxic = 1 THEN 'toxic' END ELSE lang END AS group_name FROM documents LEFT JOIN labels USING (doc_id)"""),
    "metadata_merge": (metadata_merge, "SELECT doc_id, source AS mpn, source AS a, CASE WHEN quality IS NULL THEN lang END AS b, CAST(quality AS VARCHAR) AS c FROM documents LEFT JOIN labels USING (doc_id)"),
    "delete_cascade": (delete_cascade, f"WITH {LINES} SELECT doc_id, count(*) AS n FROM c WHERE doc_id NOT IN (1, 2, 3) GROUP BY doc_id"),
    "ingest_antijoin": (ingest_antijoin, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "audit_recent": (audit_recent, "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02' ORDER BY event_id DESC LIMIT 200"),
    "audit_of_document": (audit_of_document, "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS doc_id, event_type FROM events WHERE user_id = 13 ORDER BY event_id DESC LIMIT 20"),
    "audit_by_user": (audit_by_user, "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id, event_type"),
    "running_header": (running_header, """WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL HAVING count(*) >= 2)
        SELECT source, line AS header, n FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, line) = 1"""),
    "repeated_lines": (repeated_lines, """WITH l AS (SELECT source AS doc_id, unnest(string_split(text, chr(10))) AS title FROM documents), p AS (SELECT source AS doc_id, count(*) AS m FROM documents GROUP BY 1)
        SELECT doc_id, title, count(*) AS n FROM l JOIN p USING (doc_id) GROUP BY doc_id, title, m HAVING count(*) >= greatest(3, CAST(floor(m * 0.04) AS INT))"""),
    "section_assign": (section_assign, """WITH k AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'title' WHEN role = 'user' THEN 'section_header' ELSE 'text' END AS kind FROM conversations)
        SELECT conv_id, turn, kind, max(CASE WHEN kind <> 'text' THEN turn END) OVER w AS section, max(CASE WHEN kind = 'title' THEN turn END) OVER w AS root FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""),
    "nearest_header": (nearest_header, """SELECT conv_id, turn, md5(arg_max(text, turn) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS header FROM conversations"""),
    "contents_pages": (contents_pages, """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
        SELECT doc_id, len(a) >= 10 AND len(list_filter(a, lambda x: regexp_matches(x, '^.+[.\\s]{2,}\\d+\\s*$'))) >= 0.6 * len(a) AS is_contents FROM l"""),
    "embed_cost": (embed_cost, "SELECT CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, round(sum(greatest(1, length(text) // 4)) / 1e6 * 0.02, 8) AS usd FROM documents"),
    "extractive_digest": (extractive_digest, """WITH t AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS w FROM documents),
        u AS (SELECT *, regexp_replace(w, '([.!?])\\s+', '\\1' || chr(57344), 'g') || chr(57344) AS j, substring(w, 1, 400) AS k FROM t), v AS (SELECT *, substring(j, 1, 400) AS h, string_split(j, chr(57344))[1] AS f, length(k) - strpos(reverse(k), ' ') AS spot FROM u),
        d AS (SELECT doc_id, CASE WHEN length(w) <= 400 THEN w WHEN length(f) + 1 = length(j) THEN rtrim(CASE WHEN strpos(k, ' ') > 0 AND spot > 200 THEN substring(k, 1, spot) ELSE k END) || '…'
          WHEN strpos(h, chr(57344)) = 0 THEN f ELSE replace(substring(h, 1, length(h) - strpos(reverse(h), chr(57344))), chr(57344), ' ') END AS d FROM v) SELECT doc_id, md5(d) AS digest_md5, CAST(length(d) AS INT) AS n_chars FROM d"""),
    "previews": (previews, """WITH p AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)
        SELECT doc_id, md5(CASE WHEN length(f) > 180 THEN substring(f, 1, 179) || '…' ELSE f END) AS preview_md5, substring(trim(regexp_replace(lower(substring(text, 1, 60)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) AS slug FROM p"""),
    "table_reasons": (table_reasons, f"""WITH {_CELLS}, g AS (SELECT table_id, t AS garbled FROM cells WHERE is_header AND o AND length(t) >= 12 GROUP BY table_id, t HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY count(*) DESC) = 1),
        h AS (SELECT DISTINCT table_id, "row", lower(t) AS t FROM cells a WHERE is_header AND o AND length(t) >= 2 AND lower(t) IN (SELECT lower(t) FROM cells b WHERE b.table_id = a.table_id AND NOT is_header AND b.o)),
        r AS (SELECT table_id, "row", list_sort(list(t)) AS l FROM h GROUP BY ALL HAVING count(*) >= 2), f AS (SELECT table_id, array_to_string(arg_min(l, "row")[1:3], ', ') AS fused FROM r GROUP BY table_id)
        SELECT table_id, garbled, fused, coalesce('garbled header: ' || substring(garbled, 1, 60), 'fused header and data row: ' || fused) AS reason FROM (SELECT DISTINCT table_id FROM cells) LEFT JOIN g USING (table_id) LEFT JOIN f USING (table_id)"""),
    "table_columns": (table_columns, f"""WITH {_CELLS}, h AS (SELECT table_id, coalesce(max("row") FILTER (is_header AND o), 0) AS header_rows, max("row") AS total_rows FROM cells GROUP BY table_id),
        w AS (SELECT table_id, "row", max(col + col_span - 1) AS w FROM cells JOIN h USING (table_id) WHERE o AND "row" > header_rows GROUP BY ALL), v AS (SELECT table_id, w, count(*) AS n, min("row") AS f FROM w GROUP BY table_id, w),
        b AS (SELECT *, sum(n) OVER (PARTITION BY table_id) AS m FROM v QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY n DESC, f) = 1)
        SELECT table_id, header_rows, total_rows, CAST(CASE WHEN n / m < 0.7 THEN 0 ELSE w END AS INT) AS column_count FROM h JOIN b USING (table_id)"""),
    "table_compact_text": (table_compact_text, f"""WITH {_CELLS}, l AS (SELECT table_id, "row", string_agg(CASE WHEN o THEN t ELSE '' END, ' | ' ORDER BY col) AS line FROM cells GROUP BY ALL HAVING bool_or(o AND t <> ''))
        SELECT table_id, string_agg(line, chr(10) ORDER BY "row") AS text FROM l GROUP BY table_id"""),
    "table_reading_order": (table_reading_order, f"""WITH {_CELLS}, a AS (SELECT table_id, t, "row", col, lag(t) OVER (PARTITION BY table_id ORDER BY "row", col) AS p FROM cells WHERE o AND t <> '')
        SELECT table_id, string_agg(t, chr(10) ORDER BY "row", col) AS text FROM a WHERE p IS NULL OR p <> t GROUP BY table_id"""),
    "crop_caps": (crop_caps, f"""WITH {_BOXES}, p AS (SELECT x.box_id AS l, y.box_id AS r, (y."left" - x."right") / 2 AS cap FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.page = y.page AND x."left" < y."left" AND y."left" - x."right" >= 0 AND y."left" - x."right" < 0.05
        AND least(x."bottom", y."bottom") - greatest(x."top", y."top") >= 0.3 * least(x."bottom" - x."top", y."bottom" - y."top"))
        SELECT box_id, (SELECT round(CAST(min(cap) AS DOUBLE), 6) FROM p WHERE r = box_id) AS left_cap, (SELECT round(CAST(min(cap) AS DOUBLE), 6) FROM p WHERE l = box_id) AS right_cap FROM b"""),
    "bbox_iou": (bbox_iou, f"""WITH {_BOXES}, p AS (SELECT x.box_id AS x, y.box_id AS y, CAST(greatest(0, least(x."right", y."right") - greatest(x."left", y."left")) * greatest(0, least(x."bottom", y."bottom") - greatest(x."top", y."top")) AS DOUBLE) AS i,
        CAST((x."right" - x."left") * (x."bottom" - x."top") + (y."right" - y."left") * (y."bottom" - y."top") AS DOUBLE) AS s FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.page = y.page AND x.box_id < y.box_id) SELECT x, y, round(i / (s - i), 6) AS iou FROM p"""),
    "concept_lateral": (concept_lateral, f"""WITH {_LINKS},
        m AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY relevance DESC, concept_id) AS r FROM l QUALIFY r <= 2)
        SELECT m.chunk_id, l.chunk_id AS other, CAST(min(r) AS INT) AS concept_rank, arg_min(m.concept_id, r) AS concept_id FROM m JOIN l USING (concept_id) WHERE m.chunk_id <> l.chunk_id GROUP BY ALL"""),
    "shaped_chunks": (shaped_chunks, f"""WITH {_ROWS} SELECT id AS chunk_id, ['MACRO', 'MESO', 'MICRO'][level + 1] AS level, CAST(page AS VARCHAR) AS page, '' AS section, group_name AS chapter, prev_id, next_id, kind = 'figure' AS has_figure, CASE WHEN kind = 'figure' THEN text END AS figure_caption,
        CASE kind WHEN 'table' THEN 'confirm' WHEN 'figure' THEN 'show' END AS note, round(seq / 7, 4) AS score FROM rn"""),
    "packed_round_trip": (packed_round_trip, f"WITH {_ROWS} SELECT id, project_id AS doc_title, group_name AS chapter_title, CAST(NULL AS VARCHAR) AS section_title, kind AS layout_type, CAST(page AS VARCHAR) AS page FROM rw"),
    "neighbour_rows": (neighbour_rows, f"WITH {_ROWS} SELECT id, prev_id AS prev, next_id AS \"next\", CAST(NULL AS VARCHAR) AS parent FROM rn"),
    "surrounding_texts": (surrounding_texts, f"WITH {_ROWS} SELECT id, nullif(substring(prev_text, 1, 40), '') AS \"before\", nullif(substring(next_text, 1, 40), '') AS \"after\" FROM rn"),
    "short_ids": (short_ids, f"WITH {_ROWS} SELECT sha256(CAST(doc_id AS VARCHAR)) || ':L2:' || seq AS id, substring(sha256(CAST(doc_id AS VARCHAR)), 1, 12) || ':L2:' || seq AS short FROM rw"),
    "variant_payloads": (variant_payloads, f"WITH {_ROWS} SELECT id, md5(coalesce(nullif(text, ''), project_id || ' ' || text)) AS raw_text, md5(project_id || ' ' || text) AS context, md5(project_id || ' ' || text) AS no_figure_desc FROM rw"),
    "first_pages": (first_pages, f"""WITH {LINES}, t AS (SELECT doc_id, seq, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM c WHERE page = 1), u AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM t WHERE t <> '')
        SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY seq)) AS text_md5 FROM u WHERE had < 500 GROUP BY doc_id"""),
    "chunks_on_pages": (chunks_on_pages, f"""WITH {_ROWS}, q AS (SELECT *, trim(regexp_replace(CASE WHEN text <> '' THEN text ELSE '' END, '\\s+', ' ', 'g')) AS f FROM rw WHERE page IN (2, 4))
        SELECT id AS chunk_id, ['MACRO', 'MESO', 'MICRO'][level + 1] AS level, md5(CASE WHEN length(f) > 180 THEN substring(f, 1, 179) || '…' ELSE f END) AS preview_md5 FROM q"""),
    "sample_pool": (sample_pool, f"WITH {_ROWS} SELECT id FROM rw WHERE level = 1 AND kind = 'text' AND length(text) > 40 ORDER BY id LIMIT 500"),
    "blank_titles": (blank_titles, "SELECT doc_id FROM documents WHERE lang <> 'fr' OR source IN ('', '—')"),
    "cost_totals": (cost_totals, f"""WITH {_ROWS}, d AS (SELECT doc_id, CAST(greatest(1, floor(sum(length(project_id || ' ' || text)) / 4)) AS DOUBLE) AS tok, count(*) FILTER (kind = 'figure') AS figs, max(page) AS pages FROM rw GROUP BY doc_id),
        i AS (SELECT 'embeddings' AS label, sum(tok) AS amount, sum(tok / 1e6 * 0.02) AS usd FROM d UNION ALL SELECT 'figures', sum(figs), sum(figs * 0.00075) FROM d UNION ALL SELECT 'pages', sum(pages), sum(pages * 0.004) FROM d UNION ALL SELECT 'titles', count(*), count(*) * 0.0005 FROM d)
        SELECT label, round(CAST(amount AS DOUBLE), 4) AS amount, round(CAST(usd AS DOUBLE), 6) AS usd FROM i UNION ALL SELECT 'total', NULL, round(CAST(sum(usd) AS DOUBLE), 6) FROM i"""),
    "table_inspection": (table_inspection, """WITH c AS (SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders GROUP BY 1), g AS (SELECT c % 5 = 0 AS g, c % 5 <> 0 AND c % 7 = 0 AND k >= 10 AS f FROM c)
        SELECT count(*) AS "tables", count(*) FILTER (g) AS garbled, count(*) FILTER (f) AS fused, count(*) FILTER (g AND f) AS "both", count(*) FILTER (g OR f) AS "either", round(100 * count(*) FILTER (g OR f) / count(*), 4) AS percent FROM g"""),
    "table_repairs": (table_repairs, f"""WITH {_CELLS}, h AS (SELECT table_id, max("row") AS n FROM cells GROUP BY 1), w AS (SELECT table_id, "row", max(col + col_span - 1) AS w FROM cells WHERE o AND "row" > 1 GROUP BY ALL), v AS (SELECT table_id, w, count(*) AS k FROM w GROUP BY ALL),
        b AS (SELECT table_id, max(k) / sum(k) AS share FROM v GROUP BY 1) SELECT table_id, CASE WHEN 1 > 0.3 * n THEN 'header too large a share' WHEN share < 0.7 THEN 'no trusted column count' END AS skip FROM h JOIN b USING (table_id)"""),
    "header_proposals": (header_proposals, f"""WITH {_CELLS}, w AS (SELECT table_id, "row", max(col + col_span - 1) AS w FROM cells WHERE o AND "row" > 1 GROUP BY ALL), v AS (SELECT table_id, w, count(*) AS k, min("row") AS f FROM w GROUP BY ALL), b AS (SELECT *, sum(k) OVER (PARTITION BY table_id) AS m FROM v QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY k DESC, f) = 1)
        SELECT table_id, CASE table_id % 4 WHEN 1 THEN 'gap' WHEN 2 THEN 'overlap' WHEN 0 THEN 'still garbled' END AS reason FROM b WHERE k / m >= 0.7 AND w = 3"""),
    "concept_related": (concept_related, f"WITH {_LINKS}, k AS (SELECT * FROM l WHERE relevance >= 0.9) SELECT a.chunk_id, count(DISTINCT b.chunk_id) AS n FROM k a JOIN k b USING (concept_id) WHERE a.chunk_id <> b.chunk_id GROUP BY a.chunk_id"),
    "review_counts": (review_counts, "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS reviewed FROM labels"),
    "ingest_tally": (ingest_tally, "SELECT count(*) FILTER (event_type NOT IN ('error', 'view')) AS processed, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS failed FROM events"),
    "clean_texts": (clean_texts, "SELECT doc_id, md5(trim(regexp_replace(replace(text, ' ', '   '), ' {2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS text_md5 FROM documents"),
    "model_answers": (model_answers, "SELECT event_id, props, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "table_of_blocks": (table_of_blocks, f"WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'b' || seq AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, seq % 2 = 0, CASE WHEN seq % 2 = 1 THEN -seq ELSE seq END) - 1 AS INT) AS ord FROM c"),
}
