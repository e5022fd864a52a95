"""What callers see of chunks: result rows, ids, neighbours, first pages, samples, and tallies over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import store

LEVELS = ("MACRO", "MESO", "MICRO")
SHORT_ID, FIRST_PAGE_CHARS, SAMPLE_POOL, SAMPLE_CHARS, SURROUNDING_CHARS = 12, 4000, 500, 40, 400
#: Columns that are packed into a chunk's metadata when it is stored as one row.
METADATA = ("doc_title", "chapter_title", "section_title", "page_numbers", "layout_type")
_METADATA_TYPE = "doc_title string, chapter_title string, section_title string, page_numbers array<int>, layout_type string"


def level_name(level: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), level), level.cast("string"))


def packed(chunks: DataFrame) -> DataFrame:
    """Rows with page_numbers as JSON and all metadata as one JSON object."""
    blob = F.to_json(F.struct(*METADATA), {"ignoreNullFields": "false"})
    return chunks.withColumn("metadata_json", blob).withColumn("page_numbers", F.to_json(F.coalesce("page_numbers", F.expr("cast(array() as array<int>)"))))


def unpacked(rows: DataFrame) -> DataFrame:
    """Chunks of packed rows; where the metadata is missing or unreadable, the row's own columns count."""
    m = F.from_json("metadata_json", _METADATA_TYPE)
    there = F.coalesce(m["page_numbers"].isNotNull() | m["doc_title"].isNotNull() | m["layout_type"].isNotNull(), F.lit(False))
    own = {c: F.col(c) for c in METADATA} | {"page_numbers": F.from_json("page_numbers", "array<int>")}
    return rows.withColumns({c: F.when(there, m[c]).otherwise(own[c]) for c in METADATA}).drop("metadata_json")


def shaped(chunks: DataFrame) -> DataFrame:
    """Compact result rows: level by name, page label, figure and table notes, score to four places."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    figure = (F.col("layout_type") == "figure") & ((some("figure_image_path") != "") | (some("figure_s3_key") != ""))
    table = (F.col("layout_type") == "table") & (F.coalesce(F.size("page_numbers"), F.lit(0)) > 0)
    warned = F.when(table, F.col("table_structure_warning")) if "table_structure_warning" in chunks.columns else F.lit(None).cast("string")
    note = F.when(table & (F.coalesce(warned, F.lit("")) != ""), "verify").when(table, "confirm").when(figure, "show")
    score = [F.round("score", 4).alias("score")] if "score" in chunks.columns else []
    return chunks.select(
        F.col("id").alias("chunk_id"), "doc_id", level_name(F.col("level")).alias("level"), text.page_label(F.col("page_numbers")).alias("page"), some("section_title").alias("section"), some("chapter_title").alias("chapter"), "text",
        "parent_id", "prev_id", "next_id", "chapter_root_id", F.coalesce(figure, F.lit(False)).alias("has_figure"), F.when(figure, some("figure_caption")).alias("figure_caption"), F.when(figure, F.col("figure_description")).alias("figure_description"),
        F.when(figure, F.concat(F.lit("figure://"), "id")).alias("figure_uri"), warned.alias("table_warning"), note.alias("note"), *score,
    )


def short_id(chunk_id: Column, doc_id: Column) -> Column:
    """The document's part cut to SHORT_ID characters; what follows it stays."""
    return F.concat(F.substring(doc_id, 1, SHORT_ID), F.substr(chunk_id, F.length(doc_id) + 1))


def split_id(chunk_id: Column) -> Column:
    """(doc, rest) of an id at its first colon; an id without one is an error."""
    at = F.instr(chunk_id, ":")
    bad = F.raise_error(F.concat(F.lit("not a chunk id: "), chunk_id)).cast("string")
    return F.struct(F.when(at > 0, F.substr(chunk_id, F.lit(1), at - 1)).otherwise(bad).alias("doc"), F.substr(chunk_id, at + 1).alias("rest"))


def resolve_ids(short: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id) with abbreviated documents to (chunk_id, full): null if no document or more than one begins so."""
    asked = short.select("chunk_id", split_id(F.col("chunk_id")).alias("p")).select("chunk_id", "p.doc", "p.rest")
    docs = chunks.select("doc_id").distinct()
    found = asked.join(docs, F.startswith("doc_id", F.col("doc"))).groupBy("chunk_id", "rest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("d"))
    return asked.select("chunk_id").join(found.where("n = 1").select("chunk_id", F.concat("d", F.lit(":"), "rest").alias("full")), "chunk_id", "left")


def payload(variant: str) -> Column:
    """The text to embed under an index variant: ``raw_text``, ``no_figure_desc`` (figures without their description lines) or ``context``."""
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    if variant == "raw_text":
        return F.coalesce(some("text"), "context_text")
    if variant == "context":
        return F.coalesce(some("context_text"), "text")
    if variant != "no_figure_desc":
        raise ValueError(f"unknown variant {variant!r}")
    lines = F.filter(F.split("context_text", "\n"), lambda x: ~F.contains(x, F.col("figure_description")) & ~F.startswith(x, F.lit("Description:")))
    kept = text.strip(F.array_join(lines, "\n"))
    described = (F.col("layout_type") == "figure") & some("figure_description").isNotNull()
    return F.when(described, F.coalesce(F.when(kept != "", kept), some("figure_caption"), "text")).otherwise(F.coalesce(some("context_text"), "text"))


def neighbours(chunks: DataFrame, columns: tuple[str, ...] = ("id", "text")) -> DataFrame:
    """(id, parent, prev, next): structs of the named columns, null where there is none."""
    out = chunks.select("id", "parent_id", "prev_id", "next_id")
    for side in ("parent", "prev", "next"):
        other = chunks.select(F.col("id").alias(f"{side}_id"), F.struct(*columns).alias(side))
        out = out.join(other, f"{side}_id", "left")
    return out.select("id", "parent", "prev", "next")


def surrounding(chunks: DataFrame, limit: int = SURROUNDING_CHARS) -> DataFrame:
    """(id, before, after): the neighbours' texts, cut."""
    n = neighbours(chunks)
    side = lambda c: F.when(F.coalesce(F.col(f"{c}.text"), F.lit("")) != "", F.substring(F.col(f"{c}.text"), 1, limit))
    return n.select("id", side("prev").alias("before"), side("next").alias("after"))


def document_metadata(metadata: DataFrame, chunks: DataFrame) -> DataFrame:
    """The sidecar with title and page count; documents that have none are not there."""
    return metadata.join(store.ingested(chunks).select("doc_id", F.col("title").alias("doc_title"), "page_count"), "doc_id", "left")


def first_page_text(chunks: DataFrame, limit: int = FIRST_PAGE_CHARS) -> DataFrame:
    """(doc_id, text): the pieces of page 1, in order, until ``limit`` characters are reached."""
    own = chunks.where((F.col("level") == 2) & F.array_contains("page_numbers", 1)).select("doc_id", "seq", text.strip(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    so_far = F.sum(F.length("t")).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    kept = own.withColumn("had", F.coalesce(so_far, F.lit(0))).where(F.col("had") < limit)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "\n").alias("text"))


def on_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks of (doc_id, pages) whose pages overlap these, with a preview, by level and id."""
    body = F.coalesce(*(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in ("text", "figure_caption", "figure_description")), F.lit(""))
    found = chunks.join(pages.select("doc_id", F.col("pages").alias("_wanted")), "doc_id").where(F.arrays_overlap("page_numbers", "_wanted"))
    return found.select("doc_id", F.col("id").alias("chunk_id"), level_name(F.col("level")).alias("level"), "layout_type", "page_numbers", text.preview(body).alias("preview")).orderBy("doc_id", "level", "chunk_id")


def blank_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).isin("", "—")


#: Which chunks can answer a question of a category (fixed conditions).
CATEGORIES = {
    "identifier": "level = 2 AND layout_type IN ('text', 'key_value', 'list')",
    "conceptual": "level = 1 AND layout_type = 'text'",
    "figure": "layout_type = 'figure' AND (figure_caption IS NOT NULL OR figure_description IS NOT NULL)",
    "table_spec": "layout_type = 'table'",
    "synthesis": "level = 0",
}


def seeded(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in an order that the seed and the key fix; a sampling operator, so the limit is its purpose."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def sample_chunks(chunks: DataFrame, category: str, n: int, seed: int = 0, where: Column | None = None) -> DataFrame:
    """Candidates for golden questions: of the first 500 by id that fit the category and have over 40 characters, ``n`` by the seed."""
    own = chunks.where(CATEGORIES[category]).where(F.length("text") > SAMPLE_CHARS)
    pool = (own if where is None else own.where(where)).orderBy("id").limit(SAMPLE_POOL)
    return seeded(pool, "id", n, seed)


def clean_text(x: Column) -> Column:
    """Runs of blanks as one, trimmed."""
    return text.strip(F.regexp_replace(x, " {2,}", " "))


def unfenced(x: Column) -> Column:
    """The inside of a fenced block, or the text itself."""
    inside = F.regexp_extract(text.strip(x), r"(?s)^```(?:json)?\s*\n(.*)\n```\s*$", 1)
    return F.when(text.strip(x).rlike(r"(?s)^```(?:json)?\s*\n(.*)\n```\s*$"), inside).otherwise(x)


def json_object(x: Column, schema: str) -> Column:
    """The object between the first and the last brace of a model's answer; null if it can't be read."""
    first, last = F.instr(x, "{"), F.length(x) - F.instr(F.reverse(x), "}") + 1
    return F.when((first > 0) & (F.instr(x, "}") > 0) & (last >= first), F.from_json(F.substr(x, first, last - first + 1), schema))


def concepts_of(links: DataFrame, chunk_id: str) -> DataFrame:
    return links.where(F.col("chunk_id") == chunk_id).select("concept_id", "relevance").orderBy(F.desc("relevance"), "concept_id")


def chunks_of(links: DataFrame, concept_id: str) -> DataFrame:
    return links.where(F.col("concept_id") == concept_id).select("chunk_id", "relevance").orderBy(F.desc("relevance"), "chunk_id")


def related(links: DataFrame) -> DataFrame:
    """(chunk_id, to): chunks that share a concept, not themselves."""
    other = links.select(F.col("chunk_id").alias("to"), "concept_id")
    return links.select("chunk_id", "concept_id").join(other, "concept_id").where("chunk_id <> to").select("chunk_id", "to").distinct()


def inspect_tables(reasons: DataFrame) -> DataFrame:
    """(tables, garbled, fused, both, either, percent) of (garbled, fused) per table."""
    g, f = F.col("garbled").isNotNull(), F.col("fused").isNotNull()
    either = F.count_if(g | f)
    return reasons.agg(F.count(F.lit(1)).alias("tables"), F.count_if(g).alias("garbled"), F.count_if(f).alias("fused"), F.count_if(g & f).alias("both"), either.alias("either"), F.when(F.count(F.lit(1)) > 0, F.round(100 * either / F.count(F.lit(1)), 4)).alias("percent"))


def review_summary(golden: DataFrame) -> DataFrame:
    return golden.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("source") == "human").alias("reviewed"))


def apply_update(golden: DataFrame, patch: DataFrame, key: str = "question") -> DataFrame:
    """Golden items with the patch's values where it has any, by key."""
    fields = [c for c in golden.columns if c != key and c in patch.columns]
    p = patch.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return golden.join(p, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(*golden.columns)


def tally(outcomes: DataFrame) -> DataFrame:
    """(processed, skipped, failed) of a bulk ingest's (doc_id, status)."""
    return outcomes.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("processed", "skipped", "failed")))


def missing_description(description: Column) -> Column:
    return store.blank(description)
