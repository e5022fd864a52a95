"""Multi-scale chunks: paragraphs (MICRO), subsections (MESO) and chapters (MACRO), linked and put in context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quire.functions import text

MACRO, MESO, MICRO = 0, 1, 2
MICRO_TOKENS, MESO_TOKENS, MIN_FIGURE_PX, MAX_TABLE_CHARS = 128, 512, 400, 50_000


def chunk_id(doc: Column, level: int, index: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit(f":L{level}:"), index.cast("string"))


def micro_chunks(elements: DataFrame, budget: int = MICRO_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, section, ord, element_type, text, page, caption, width_px, height_px) to numbered MICRO chunks.

    Text and lists are split; tables and figures stay whole; figures known to be
    small in both directions, and formulas, give none; a table beyond the
    embedding limit is an error. Columns named in ``keep`` stay.
    """
    kind = F.col("element_type")
    small = F.coalesce((F.col("width_px") < MIN_FIGURE_PX) & (F.col("height_px") < MIN_FIGURE_PX), F.lit(False))
    table = F.when(F.length("text") > MAX_TABLE_CHARS, F.raise_error(F.concat(F.lit("table too long on page "), F.col("page").cast("string"))).cast("string")).otherwise(F.col("text"))
    pieces = (
        F.when(kind.isin("text", "list"), text.split_text(F.coalesce("text", F.lit("")), budget))
        .when(kind == "table", F.array(table))
        .when((kind == "figure") & ~small, F.array(F.coalesce(F.when(F.col("caption") != "", F.col("caption")), F.lit("[Figure]"))))
        .when(kind == "key_value", F.array("text"))
        .otherwise(F.expr("cast(array() as array<string>)"))
    )
    cut = elements.select("doc_id", "section", "ord", "page", F.col("element_type").alias("layout_type"), *keep, F.posexplode(pieces).alias("piece", "text"))
    order = Window.partitionBy("doc_id").orderBy("section", "ord", "piece")
    cut = cut.withColumn("idx", F.row_number().over(order) - 1).withColumn("token_count", text.tokens(F.col("text")))
    return cut.select(chunk_id(F.col("doc_id"), MICRO, F.col("idx")).alias("id"), "doc_id", F.lit(MICRO).alias("level"), "section", "idx", "text", "token_count", "layout_type", F.array("page").alias("page_numbers"), *keep)


@F.pandas_udf(ArrayType(IntegerType()))
def _packed(tokens: pd.Series, alone: pd.Series, budget: pd.Series) -> pd.Series:
    """A group takes items while its tokens stay within the budget; an item alone is a group of its own."""
    out = []
    for t, lone, most in zip(tokens, alone, budget):
        t, lone = np.asarray(t, dtype=np.int64), np.asarray(lone, dtype=bool)
        ends, group, i, g = np.cumsum(t), np.empty(len(t), dtype=np.int32), 0, 0
        stops = np.append(np.flatnonzero(lone), len(t))
        while i < len(t):
            if lone[i]:
                j = i + 1
            else:
                fits = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right"))
                j = min(max(i + 1, fits), int(stops[np.searchsorted(stops, i)]))
            group[i:j] = g
            i, g = j, g + 1
        out.append(group.tolist())
    return pd.Series(out)


def meso_groups(micro: DataFrame, budget: int = MESO_TOKENS, atomic: int = MICRO_TOKENS) -> DataFrame:
    """MICRO chunks with the number of their MESO group within the section.

    A group takes chunks while its tokens stay within the budget; a large table or
    figure is a group of its own. Only a section's (idx, tokens, alone) triples go
    to the packing, not its texts; a fold over them would copy its result at each step.
    """
    alone = F.col("layout_type").isin("table", "figure") & (F.col("token_count") > atomic)
    lists = micro.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("idx", "token_count", alone.alias("alone")))).alias("items"))
    packed = _packed(F.col("items.token_count"), F.col("items.alone"), F.lit(budget))
    placed = lists.select("doc_id", "section", F.explode(F.arrays_zip(F.col("items.idx").alias("idx"), packed.alias("grp"))).alias("p")).select("doc_id", "section", "p.idx", "p.grp")
    return micro.join(placed, ["doc_id", "section", "idx"])


def meso_chunks(grouped: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """MESO chunks of grouped MICRO chunks: texts joined by blank lines, pages united, one layout type or mixed; ``keep``: more aggregates."""
    keep = keep or {}
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    kinds = F.collect_set("layout_type")
    made = grouped.groupBy("doc_id", "section", "grp").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("page_numbers"),
        F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise(F.lit("mixed")).alias("layout_type"),
        F.count("id").alias("n_children"),
        *(c.alias(name) for name, c in keep.items()),
    )
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "grp")) - 1
    made = made.withColumn("idx", idx)
    return made.select(chunk_id(F.col("doc_id"), MESO, F.col("idx")).alias("id"), "doc_id", F.lit(MESO).alias("level"), "section", "grp", "idx", "text", text.tokens(F.col("text")).alias("token_count"), "layout_type", "page_numbers", "n_children", *keep)


def link(chunks: DataFrame, by: list[str], order: str, key: str = "id") -> DataFrame:
    """prev_id and next_id by order within ``by``."""
    w = Window.partitionBy(*by).orderBy(order)
    return chunks.withColumn("prev_id", F.lag(key).over(w)).withColumn("next_id", F.lead(key).over(w))


def verify_links(chunks: DataFrame, links: list[str], key: str = "id") -> DataFrame:
    """Links to chunks that aren't there become null."""
    for name in links:
        there = chunks.select(F.col(key).alias("_there")).distinct()
        chunks = chunks.join(there, chunks[name] == F.col("_there"), "left").withColumn(name, F.col("_there")).drop("_there")
    return chunks


def context_string() -> Column:
    """Breadcrumb of doc_title, chapter_title, section_title, layout_type and page_numbers; repeats and blanks are left out.

    Its wordings are fixed values: stored contexts and their vectors depend on them.
    """
    doc, chapter, section, layout, pages = (F.col(c) for c in ("doc_title", "chapter_title", "section_title", "layout_type", "page_numbers"))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    hint = F.when(layout == "table", "Content type: Table").when(layout == "figure", "Content type: Figure/Diagram").when(layout == "key_value", "Content type: Specification/Key-Value").when(layout == "list", "Content type: List")
    size = F.coalesce(F.size(pages), F.lit(0))
    return F.concat_ws(
        " > ",
        F.when(some(doc), F.concat(F.lit("Document: "), doc)),
        F.when(some(chapter) & ~chapter.eqNullSafe(doc), F.concat(F.lit("Chapter: "), chapter)),
        F.when(some(section) & ~section.eqNullSafe(chapter), F.concat(F.lit("Section: "), section)),
        hint,
        F.when(size == 1, F.concat(F.lit("Page: "), F.get(pages, F.lit(0)).cast("string"))).when(size > 1, F.concat(F.lit("Pages: "), text.page_label(pages))),
    )


def context_text(context: Column, body: Column) -> Column:
    shown = F.when(context != "", context)
    return F.concat_ws("\n", shown, F.when(context != "", F.lit("---")), F.when(F.coalesce(body, F.lit("")) != "", body))


def neighbour_context(body: str, by: list[str], order: str, limit: int = 300) -> Column:
    w = Window.partitionBy(*by).orderBy(order)
    side = lambda c: F.when(c != "", F.substring(c, 1, limit))
    return F.concat_ws(" [...] ", side(F.lag(body).over(w)), side(F.lead(body).over(w)))
