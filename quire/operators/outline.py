"""Outlines: OCR blocks to sections and elements, heading nesting, and the clean-up chain.

Blocks have the schema of ``quire.sources.readers.BLOCKS``. An outline is two
tables, since Spark has no recursive types:

* sections: doc_id, section_id (in reading order from 0), parent_id (null: a
  chapter), root_id (its chapter), level, title, page_start, page_end;
* elements: doc_id, section_id, ord, element_type, text, page, block_id, caption.

Trees are walked by joins unrolled to MAX_DEPTH. What several steps read is
written once (``settle``), so that plans stay small and nothing is done twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.sources.scratch import settle

MAX_DEPTH = 8
#: Block types that carry no content of their own (fixed values).
FURNITURE = ["LAYOUT_FOOTER", "LAYOUT_HEADER", "LAYOUT_PAGE_NUMBER"]
HEADINGS = ["LAYOUT_TITLE", "LAYOUT_SECTION_HEADER"]
CONTENT = {"LAYOUT_TABLE": "table", "LAYOUT_FIGURE": "figure", "LAYOUT_LIST": "list", "LAYOUT_TEXT": "text"}
#: Titles of tables of contents (fixed values).
CONTENTS = ["table of contents", "contents", "index", "toc"]
CONTINUED = r"(?i)\s*\(continued\)\s*$"
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+\S"
FLAT_CHILDREN, FLAT_NUMBERED = 50, 5
CAPTION_GAP, CAPTION_CHARS, PRECEDING_CHARS = 0.05, 200, 500


def in_order(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("ord")


def so_far(*by: str) -> Window:
    return in_order(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(*by: str) -> Window:
    return in_order(*by).rowsBetween(Window.unboundedPreceding, -1)


# Blocks


def children(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, pos, child) of the references of type CHILD."""
    own = F.filter("relationships", lambda r: r["type"] == "CHILD")
    return blocks.select("doc_id", "id", F.posexplode(F.flatten(F.transform(own, lambda r: r["ids"]))).alias("pos", "child"))


def texts(blocks: DataFrame, depth: int = 3) -> DataFrame:
    """(doc_id, id, t): a block's own text, else its children's texts in order, to ``depth`` references."""
    links = children(blocks)
    found = blocks.select("doc_id", "id", "text", F.coalesce("text", F.lit("")).alias("t"))
    for _ in range(depth):
        below = found.where(strip(F.col("t")) != "").select("doc_id", F.col("id").alias("child"), "t")
        joined = links.join(below, ["doc_id", "child"]).groupBy("doc_id", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("parts"))
        joined = joined.select("doc_id", "id", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("j"))
        found = blocks.select("doc_id", "id", "text").join(joined, ["doc_id", "id"], "left").select("doc_id", "id", "text", F.coalesce("text", "j", F.lit("")).alias("t"))
    return found.select("doc_id", "id", "t")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Layout blocks with ``ord`` in a document: by page, those that the page lists in its order, then the others from the top left."""
    layout = blocks.where(F.startswith("block_type", F.lit("LAYOUT_")))
    rank = children(blocks.where(F.col("block_type") == "PAGE")).groupBy("doc_id", F.col("child").alias("id")).agg(F.min("pos").alias("rank"))
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("page", F.lit(0)), F.col("rank").isNull(), "rank", "top", "left", "id")
    return layout.join(rank, ["doc_id", "id"], "left").withColumn("ord", F.row_number().over(order) - 1)


def elements_by_type(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", F.coalesce("block_type", F.lit("UNKNOWN")).alias("block_type")).agg(F.count(F.lit(1)).alias("n"))


def _caption(ahead: list[Column], page: Column, bottom: Column) -> Column:
    """The first of the next blocks that reads like a caption close below; another page, heading or figure ends the search."""
    out, open_ = None, F.lit(True)
    for b in ahead:
        open_ &= (b["page"] == page) & ~b["block_type"].isin(*HEADINGS, "LAYOUT_FIGURE")
        t = strip(b["t"])
        like = F.lower(t).rlike(r"^(figure|fig\.|fig )") | (F.length(t) < CAPTION_CHARS)
        ok = F.coalesce(open_ & (b["block_type"] == "LAYOUT_TEXT") & (b["top"] - bottom < CAPTION_GAP) & (t != "") & like, F.lit(False))
        out = F.when(ok, t) if out is None else out.when(ok, t)
    return out.otherwise("")


def figure_regions(blocks: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Figures with their box, caption, nearest heading (not over a page back) and preceding text on the page. ``read``: the blocks' texts, if known."""
    lay = reading_order(blocks).join(texts(blocks) if read is None else read, ["doc_id", "id"])
    w = in_order("doc_id")
    cell = F.struct("page", "block_type", "top", "t")
    ahead = [F.lead(cell, k).over(w) for k in (1, 2, 3)]
    lay = lay.withColumn("after", F.lead("page").over(w)).withColumns({f"a{k}": c for k, c in enumerate(ahead)})
    head = F.last(F.when(F.col("block_type").isin(HEADINGS), F.struct("t", "after")), True).over(before("doc_id"))
    prose = F.last(F.when((F.col("block_type") == "LAYOUT_TEXT") & (strip(F.col("t")) != ""), F.struct("t", "page")), True).over(before("doc_id"))
    lay = lay.withColumn("head", head).withColumn("prose", prose).where(F.col("block_type") == "LAYOUT_FIGURE")
    return lay.select(
        "doc_id", F.col("id").alias("block_id"), "ord", "page", "left", "top", "width", "height", _caption([F.col(f"a{k}") for k in range(3)], F.col("page"), F.col("top") + F.col("height")).alias("caption"),
        F.when(F.col("page") - F.col("head.after") <= 1, strip(F.col("head.t"))).otherwise("").alias("section_header"),
        F.when(F.col("prose.page") == F.col("page"), F.substring(strip(F.col("prose.t")), 1, PRECEDING_CHARS)).otherwise("").alias("preceding_text"),
    )


def table_cells(blocks: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Cells of the tables below each table layout block: table_id (the layout block), row, col, spans, text, is_header."""
    links, kind = children(blocks), blocks.select("doc_id", F.col("id").alias("child"), F.col("block_type").alias("kind"))
    lay = blocks.where(F.col("block_type") == "LAYOUT_TABLE").select("doc_id", "id")
    grids = lay.join(links, ["doc_id", "id"]).join(kind.where("kind = 'TABLE'"), ["doc_id", "child"]).select("doc_id", F.col("id").alias("table_id"), F.col("child").alias("id"), F.col("pos").alias("grid"))
    cells = grids.join(links, ["doc_id", "id"]).select("doc_id", "table_id", "grid", "pos", F.col("child").alias("id"))
    own = blocks.where(F.col("block_type").isin("CELL", "MERGED_CELL")).join(texts(blocks) if read is None else read, ["doc_id", "id"])
    header = F.coalesce(F.col("entity_types") == F.array(F.lit("COLUMN_HEADER")), F.lit(False))
    return cells.join(own, ["doc_id", "id"]).select(
        "doc_id", "table_id", "grid", "pos", F.coalesce("row_index", F.lit(0)).alias("row"), F.coalesce("column_index", F.lit(0)).alias("col"), F.coalesce("row_span", F.lit(1)).alias("row_span"),
        F.coalesce("col_span", F.lit(1)).alias("col_span"), strip(F.col("t")).alias("text"), header.alias("is_header"), F.lit(None).cast("boolean").alias("is_origin"),
    )


def ocr_table_text(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, text): all cells of a row between bars, rows below each other, grids after each other."""
    rows = cells.groupBy("doc_id", "table_id", "grid", "row").agg(F.array_sort(F.collect_list(F.struct("col", "pos", "text"))).alias("c"))
    rows = rows.withColumn("line", F.array_join(F.transform("c", lambda x: x["text"]), " | "))
    whole = rows.groupBy("doc_id", "table_id").agg(F.array_sort(F.collect_list(F.struct("grid", "row", "line"))).alias("l"))
    return whole.select("doc_id", "table_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def parse_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks to (documents, sections, elements).

    A title begins a chapter, and so does the first block with content if no title
    came before; other headers are sections of the chapter. Blocks inside other
    layout blocks, page furniture and blank texts give nothing.
    """
    read = settle(texts(blocks), "texts")
    lay = reading_order(blocks).join(read, ["doc_id", "id"]).withColumn("t", strip(F.col("t")))
    inner = children(blocks.where(F.startswith("block_type", F.lit("LAYOUT_")))).select("doc_id", F.col("child").alias("id")).distinct()
    kind = F.col("block_type")
    shown = kind.isin(*HEADINGS, "LAYOUT_TABLE", "LAYOUT_FIGURE") | (kind.isin("LAYOUT_LIST", "LAYOUT_TEXT") & (F.col("t") != ""))
    lay = lay.join(inner, ["doc_id", "id"], "left_anti").where(shown)
    head = kind.isin(HEADINGS)
    lay = lay.withColumn("is_root", (kind == "LAYOUT_TITLE") | (F.row_number().over(in_order("doc_id")) == 1))
    lay = lay.withColumn("is_section", F.col("is_root") | head)
    lay = lay.withColumn("section_id", (F.sum(F.col("is_section").cast("int")).over(so_far("doc_id")) - 1).cast("int"))
    lay = settle(lay.withColumn("root_id", F.last(F.when(F.col("is_root"), F.col("section_id")), True).over(so_far("doc_id"))), "layout")
    regions = figure_regions(blocks, read).select("doc_id", F.col("block_id").alias("id"), "caption")
    table = ocr_table_text(table_cells(blocks, read)).select("doc_id", F.col("table_id").alias("id"), F.col("text").alias("grid_text"))
    title = children(blocks.where(kind == "LAYOUT_TABLE")).join(blocks.where(kind == "TABLE_TITLE").select("doc_id", F.col("id").alias("child")), ["doc_id", "child"])
    title = title.join(read.withColumnRenamed("id", "child"), ["doc_id", "child"]).groupBy("doc_id", "id").agg(F.max_by(strip(F.col("t")), "pos").alias("table_title"))
    body = lay.where(~head).join(regions, ["doc_id", "id"], "left").join(table, ["doc_id", "id"], "left").join(title, ["doc_id", "id"], "left")
    table_text = strip(F.concat_ws("\n", F.when(F.col("table_title") != "", F.col("table_title")), F.coalesce("grid_text", "t")))
    text = F.when(kind == "LAYOUT_FIGURE", "[Figure]").when(kind == "LAYOUT_TABLE", table_text).otherwise(F.col("t"))
    name = F.create_map(*(F.lit(x) for pair in CONTENT.items() for x in pair))
    none = lambda t: F.lit(None).cast(t)
    elements = body.select("doc_id", "section_id", "ord", name[kind].alias("element_type"), text.alias("text"), F.coalesce("page", F.lit(1)).alias("page"), F.col("id").alias("block_id"), "caption", none("int").alias("width_px"), none("int").alias("height_px"))
    ends = lay.groupBy("doc_id", "section_id").agg(F.max("page").alias("page_end"), F.min("root_id").alias("root_id"))
    heads = lay.where("is_section").select("doc_id", "section_id", F.when(F.col("section_id") != F.col("root_id"), F.col("root_id")).alias("parent_id"), F.when(head, F.when(kind == "LAYOUT_TITLE", 0).otherwise(1)).otherwise(0).alias("level"), F.when(head, F.col("t")).otherwise("(Untitled)").alias("title"), F.coalesce("page", F.lit(1)).alias("page_start"))
    sections = heads.join(ends, ["doc_id", "section_id"]).select("doc_id", "section_id", "parent_id", "root_id", "level", "title", "page_start", "page_end")
    # A chapter ends where its own content or its last section begins.
    below = sections.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("section_id")).agg(F.max("page_start").alias("last"))
    sections = sections.join(below, ["doc_id", "section_id"], "left").withColumn("page_end", F.greatest("page_end", F.coalesce("last", "page_end"))).drop("last")
    pages = blocks.groupBy("doc_id").agg(F.greatest(F.lit(1), F.count_if(kind == "PAGE")).alias("total_pages"))
    first = lay.where((kind == "LAYOUT_TITLE") & (F.col("t") != "")).groupBy("doc_id").agg(F.min_by("t", "ord").alias("title"))
    documents = pages.join(first, "doc_id", "left").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), "total_pages")
    return documents, settle(sections, "sections"), settle(elements, "elements")


# Headings with levels


def nest(headings: DataFrame, levels: int = 10) -> DataFrame:
    """(doc_id, ord, level) with parent: the nearest heading before that is strictly shallower; none begins a chapter."""
    last = F.array(*(F.last(F.when(F.col("level") == k, F.col("ord")), True).over(before("doc_id")) for k in range(levels)))
    w = headings.withColumn("_last", last)
    shallower = F.filter(F.slice("_last", F.lit(1), F.col("level")), lambda x: x.isNotNull())
    return w.withColumn("parent", F.when(F.col("level") > 0, F.array_max(shallower))).drop("_last")


def closure(sections: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, section_id, above, distance): each section with itself and all sections over it."""
    up = sections.select("doc_id", F.col("section_id").alias("above"), "parent_id")
    level = sections.select("doc_id", "section_id", F.col("section_id").alias("above"))
    out = level.withColumn("distance", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(up, ["doc_id", "above"]).where("parent_id is not null").select("doc_id", "section_id", F.col("parent_id").alias("above"))
        out = out.unionByName(level.withColumn("distance", F.lit(d)))
    return out


def coverage(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, section_id, pages, element_count) over each section's subtree; its own first page counts."""
    seen = elements.select("doc_id", "section_id", "page", F.lit(1).alias("one"))
    seen = seen.unionByName(sections.where("page_start > 0").select("doc_id", "section_id", F.col("page_start").alias("page"), F.lit(0).alias("one")))
    below = closure(sections).join(seen, ["doc_id", "section_id"], "left")
    return below.groupBy("doc_id", F.col("above").alias("section_id")).agg(F.array_sort(F.collect_set("page")).alias("pages"), F.coalesce(F.sum("one"), F.lit(0)).alias("element_count"))


def summary(documents: DataFrame, sections: DataFrame, elements: DataFrame) -> DataFrame:
    """Per document: title, pages, chapters, sections, elements, and elements by type."""
    s = sections.groupBy("doc_id").agg(F.count_if(F.col("parent_id").isNull()).alias("top_level_sections"), F.count(F.lit(1)).alias("total_sections"))
    kinds = elements.groupBy("doc_id", "element_type").agg(F.count(F.lit(1)).alias("n"))
    e = kinds.groupBy("doc_id").agg(F.sum("n").alias("total_elements"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("element_type", "n")))).alias("elements_by_type"))
    out = documents.join(s, "doc_id", "left").join(e, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "title", "total_pages", *(F.coalesce(c, zero).alias(c) for c in ("top_level_sections", "total_sections", "total_elements")), F.coalesce("elements_by_type", F.expr("cast(map() as map<string,bigint>)")).alias("elements_by_type"))


# The clean-up chain


def key(title: Column) -> Column:
    return F.lower(F.trim(title))


def drop_repeated(documents: DataFrame, sections: DataFrame, elements: DataFrame) -> DataFrame:
    """Sections without those whose title stands max(3, 4 % of pages) times or more and never with content."""
    full = elements.select("doc_id", "section_id").union(sections.where("parent_id is not null").select("doc_id", "parent_id")).distinct().withColumn("full", F.lit(1))
    seen = sections.join(full, ["doc_id", "section_id"], "left").groupBy("doc_id", key(F.col("title")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("full"))
    least = F.greatest(F.lit(3), F.floor(F.col("total_pages") * 0.04).cast("int"))
    noise = seen.join(documents.select("doc_id", "total_pages"), "doc_id").where(F.col("full").isNull() & (F.col("n") >= least)).select("doc_id", "k")
    return sections.withColumn("k", key(F.col("title"))).join(noise, ["doc_id", "k"], "left_anti").drop("k")


def merge_continued(sections: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A "(continued)" section joins the latest sibling of its name, which takes its elements, children and last page."""
    name = F.regexp_replace("title", CONTINUED, "")
    own = sections.withColumn("k", key(name)).withColumn("goes_on", F.col("title").rlike(CONTINUED))
    w = Window.partitionBy("doc_id", "parent_id", "k").orderBy("section_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    into = F.when(F.col("goes_on"), F.coalesce(F.last(F.when(~F.col("goes_on"), F.col("section_id")), True).over(w), F.first("section_id").over(w))).otherwise(F.col("section_id"))
    own = own.withColumn("into", into)
    to = own.select("doc_id", "section_id", "into")
    ends = own.groupBy("doc_id", F.col("into").alias("section_id")).agg(F.max("page_end").alias("page_end"))
    kept = own.where("section_id = into").drop("page_end", "k", "goes_on", "into").join(ends, ["doc_id", "section_id"])
    for c in ("parent_id", "root_id"):
        kept = kept.join(to.select("doc_id", F.col("section_id").alias(c), F.col("into").alias("_to")), ["doc_id", c], "left").withColumn(c, F.col("_to")).drop("_to")
    moved = elements.join(to, ["doc_id", "section_id"]).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("into", "section_id", "ord")) - 1)
    return kept.select(*sections.columns), moved.withColumn("section_id", F.col("into")).select(*elements.columns)


def numbering(title: Column) -> Column:
    """(depth, leading) of a dotted heading number, or null."""
    number = F.regexp_extract(F.trim(title), NUMBERED, 1)
    parts = F.split(number, r"\.")
    return F.when(number != "", F.struct(F.size(parts).alias("depth"), F.get(parts, F.lit(0)).cast("long").alias("leading")))


def _renumber(part: pd.DataFrame) -> pd.DataFrame:
    """One flat chapter's headings, in order, to a tree by their numbers.

    Headings before the first numbered one stay under the old chapter. A first-level
    number that does not follow on, or none, hangs under the open section.
    """
    part = part.sort_values("section_id")
    old = part[part["parent_id"].isna()]["section_id"].iloc[0]
    parent, level, open_, top, due = {}, {}, [], [], None
    started = False
    for s, depth, leading in part[part["parent_id"] == old][["section_id", "depth", "leading"]].itertuples(index=False):
        numbered = depth == depth and depth is not None and not (depth == 1 and due is not None and leading != due)
        if not numbered:
            parent[s] = (open_[-1][1] if open_ else top[-1] if top else old) if started else old
            continue
        started = True
        if depth == 1:
            due = leading + 1
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        parent[s], level[s] = (open_[-1][1], len(open_)) if open_ else (None, 0)
        if not open_:
            top.append(s)
        open_.append((depth, s))
    out = part.copy()
    out["parent_id"] = [parent.get(s, p) for s, p in zip(out["section_id"], out["parent_id"])]
    out["level"] = [level.get(s, x) for s, x in zip(out["section_id"], out["level"])]
    up = dict(zip(out["section_id"], out["parent_id"]))

    def root(s):
        while up[s] is not None and up[s] == up[s]:
            s = up[s]
        return s

    out["root_id"] = [root(s) for s in out["section_id"]]
    return out.drop(columns=["depth", "leading"]).astype({"parent_id": "Int64"})


def restructure(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """Documents of one chapter with 50 or more sections in it, 5 or more of them numbered, get their tree from the numbers."""
    one = sections.withColumn("number", numbering(F.col("title")))
    one = one.withColumn("depth", F.col("number.depth")).withColumn("leading", F.col("number.leading")).drop("number")
    top = sections.where("parent_id is null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("tops"), F.max("section_id").alias("top"))
    flat = one.join(top, "doc_id").where("parent_id = top and tops = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.count("depth").alias("numbered"))
    flat = flat.where((F.col("m") >= FLAT_CHILDREN) & (F.col("numbered") >= FLAT_NUMBERED)).select("doc_id")
    made = one.join(flat, "doc_id", "left_semi").groupBy("doc_id").applyInPandas(_renumber, sections.schema)
    # The old chapter stays if it has anything of its own.
    used = made.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("section_id")).union(elements.select("doc_id", "section_id")).distinct()
    gone = sections.where("parent_id is null").join(flat, "doc_id", "left_semi").select("doc_id", "section_id").join(used, ["doc_id", "section_id"], "left_anti")
    return sections.join(flat, "doc_id", "left_anti").unionByName(made.join(gone, ["doc_id", "section_id"], "left_anti"))


def drop_contents(sections: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without tables of contents, by title or by ten or more texts of which 60 % end in a leader and a number, and all below them."""
    like = F.col("text").rlike(r"^.+[.\s]{2,}\d+\s*$")
    lines = elements.where(F.col("element_type") == "text").groupBy("doc_id", "section_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(like).alias("m"))
    found = sections.join(lines, ["doc_id", "section_id"], "left").where(key(F.col("title")).isin(CONTENTS) | F.coalesce((F.col("n") >= 10) & (F.col("m") >= 0.6 * F.col("n")), F.lit(False)))
    gone = closure(sections).join(found.select("doc_id", F.col("section_id").alias("above")), ["doc_id", "above"], "left_semi").select("doc_id", "section_id").distinct()
    return tuple(x.join(gone, ["doc_id", "section_id"], "left_anti").select(*x.columns) for x in (sections, elements))


def clean(documents: DataFrame, sections: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chain in its order: repeated headings, continued sections, flat chapters, tables of contents."""
    sections = settle(drop_repeated(documents, sections, elements), "sections")
    sections, elements = (settle(x, "outline") for x in merge_continued(sections, elements))
    sections = settle(restructure(sections, elements), "sections")
    return tuple(settle(x, "outline") for x in drop_contents(sections, elements))


def text_dump(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, text): a heading of level + 1 signs and the texts of each section, in reading order."""
    body = elements.where(strip(F.coalesce("text", F.lit(""))) != "").groupBy("doc_id", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    head = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.repeat(F.lit("#"), F.col("level") + 1), F.lit(" "), "title"))
    parts = sections.join(body, ["doc_id", "section_id"], "left").select("doc_id", "section_id", F.concat_ws("\n\n", head, "body").alias("p")).where("p <> ''")
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", "p"))), lambda x: x["p"]), "\n\n").alias("text"))


# Figures and tables by their boxes


def repeating_figures(regions: DataFrame, least: int = 3, top: float = 0.1, bottom: float = 0.9) -> DataFrame:
    """(doc_id, block_id) of figures of one size and one pixel hash on three or more pages that stand in the header or footer zone."""
    size = [F.round("width", 2).alias("w"), F.round("height", 2).alias("h")]
    seen = regions.select("*", *size)
    often = seen.groupBy("doc_id", "w", "h", "pixel_md5").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least)
    zone = (F.col("top") < top) | (F.col("top") + F.col("height") > bottom)
    return seen.join(often, ["doc_id", "w", "h", "pixel_md5"], "left_semi").where(zone).select("doc_id", "block_id")


def match_tables(cached: DataFrame, fresh: DataFrame, least: float = 0.1) -> DataFrame:
    """(doc_id, page, cached_ord, fresh_ord, overlap): cached tables in order take the unused table on their page that overlaps most.

    Boxes: left, top, right, bottom; overlap is intersection over union. A page's
    tables are few, so its pairs are resolved in one group.
    """
    box = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("left", "top", "right", "bottom")]
    a = cached.select("doc_id", "page", F.col("ord").alias("cached_ord"), *box("a"))
    b = fresh.select("doc_id", "page", F.col("ord").alias("fresh_ord"), *box("b"))
    w = F.greatest(F.lit(0.0), F.least("a_right", "b_right") - F.greatest("a_left", "b_left"))
    h = F.greatest(F.lit(0.0), F.least("a_bottom", "b_bottom") - F.greatest("a_top", "b_top"))
    area = lambda p: (F.col(f"{p}_right") - F.col(f"{p}_left")) * (F.col(f"{p}_bottom") - F.col(f"{p}_top"))
    pairs = a.join(b, ["doc_id", "page"]).withColumn("i", w * h).where("i > 0").select("doc_id", "page", "cached_ord", "fresh_ord", (F.col("i") / (area("a") + area("b") - F.col("i"))).alias("overlap"))

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for own, rows in part.sort_values(["cached_ord", "overlap", "fresh_ord"], ascending=[True, False, True]).groupby("cached_ord", sort=True):
            left = rows[~rows["fresh_ord"].isin(used)]
            if len(left) and left["overlap"].iloc[0] >= least:
                used.add(left["fresh_ord"].iloc[0])
                out.append(left.iloc[0])
        return pd.DataFrame(out, columns=part.columns).astype(part.dtypes)

    return pairs.groupBy("doc_id", "page").applyInPandas(resolve, pairs.schema)


def normal_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A box in points from the bottom left corner, as shares of the page from the top left, each within 0 and 1."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.struct(clamp(left / width).alias("left"), clamp((height - top) / height).alias("top"), clamp((right - left) / width).alias("width"), clamp((top - bottom) / height).alias("height"))


def crop_box(box: Column, width: Column, height: Column, padding: float = 0.02, max_right: Column | float = 1.0, min_left: Column | float = 0.0, max_bottom: Column | float = 1.0, min_top: Column | float = 0.0) -> Column:
    """Pixels (left, top, right, bottom) of a box with padding, held back by the caps, inside the page."""
    col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    low = lambda cap, x, n: F.greatest(F.lit(0), (F.greatest(col(cap), x - padding) * n).cast("int"))
    high = lambda cap, x, n: F.least(n.cast("int"), (F.least(col(cap), x + padding) * n).cast("int"))
    return F.struct(
        low(min_left, box["left"], width).alias("left"), low(min_top, box["top"], height).alias("top"),
        high(max_right, box["left"] + box["width"], width).alias("right"), high(max_bottom, box["top"] + box["height"], height).alias("bottom"),
    )


def row_band(box: Column, first: Column, last: Column, rows: Column) -> Column:
    """The part of a table's box that its rows ``first`` to ``last`` of ``rows`` take, if all are equally high; without rows the whole."""
    some = F.coalesce(rows, F.lit(0)) > 0
    top = F.when(some, box["top"] + (first - 1) / rows * box["height"]).otherwise(box["top"])
    high = F.when(some, (last - first + 1) / rows * box["height"]).otherwise(box["height"])
    return F.struct(box["left"].alias("left"), top.alias("top"), box["width"].alias("width"), high.alias("height"))



# Items of a layout model, in reading order

#: Labels of items that are content, with their element types, and those that are left out (fixed values).
ITEMS = {"table": "table", "picture": "figure", "formula": "formula", "text": "text", "code": "text", "list_item": "list"}
LEFT_OUT = ["page_header", "page_footer", "footnote"]


def from_items(items: DataFrame, tables: DataFrame | None = None, repeating: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (doc_id, ord, label, level, text, page) to (documents, sections, elements).

    A title is a chapter; a header belongs to the nearest earlier one that is
    shallower. A caption goes to the picture or formula right before it, and is no
    element. ``tables`` (doc_id, ord, text, warning) has the rendered tables, and
    ``repeating`` (doc_id, ord) pictures of page furniture, which give nothing.
    """
    w = in_order("doc_id")
    flat = items.withColumn("t", strip(F.regexp_replace(F.coalesce("text", F.lit("")), " {2,}", " ")))
    headers = flat.where((F.col("label") == "page_header") & (F.col("t") != "")).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    running = headers.groupBy("doc_id").agg(F.max_by("t", F.struct("n", -F.col("first"))).alias("running_header"), F.max("n").alias("n")).where("n >= 2").drop("n")
    flat = flat.where(~F.col("label").isin(LEFT_OUT))
    # Only a caption that follows at once is the picture's.
    flat = flat.withColumn("caption", F.when(F.col("label").isin("picture", "formula") & (F.lead("label").over(w) == "caption"), F.lead("t").over(w))).where(F.col("label") != "caption")
    if repeating is not None:
        flat = flat.join(repeating.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti")
    head = F.col("label").isin("title", "section_header")
    shown = head | F.col("label").isin("table", "picture", "formula") | (F.col("label").isin("text", "list_item", "code") & (F.col("t") != ""))
    flat = flat.where(shown).withColumn("first", F.row_number().over(w) == 1)
    flat = flat.withColumn("is_section", head | F.col("first"))
    flat = flat.withColumn("section_id", (F.sum(F.col("is_section").cast("int")).over(so_far("doc_id")) - 1).cast("int"))
    flat = settle(flat.withColumn("depth", F.when(F.col("label") == "title", 0).when(head, F.greatest(F.lit(1), F.col("level"))).otherwise(0)), "items")
    heads = nest(flat.where("is_section").select("doc_id", F.col("section_id").alias("ord"), F.col("depth").alias("level"), F.when(head, F.col("t")).otherwise("(Untitled)").alias("title"), F.coalesce("page", F.lit(1)).alias("page_start")))
    ends = flat.groupBy("doc_id", "section_id").agg(F.max("page").alias("page_end"))
    sections = heads.select("doc_id", F.col("ord").alias("section_id"), F.col("parent").alias("parent_id"), "level", "title", "page_start")
    sections = settle(sections.join(ends, ["doc_id", "section_id"]), "sections")
    top = closure(sections.withColumn("root_id", F.lit(None).cast("int"))).groupBy("doc_id", "section_id").agg(F.min("above").alias("root_id"))
    sections = sections.join(top, ["doc_id", "section_id"]).select("doc_id", "section_id", "parent_id", "root_id", "level", "title", "page_start", F.coalesce("page_end", "page_start").alias("page_end"))
    kind = F.create_map(*(F.lit(x) for pair in ITEMS.items() for x in pair))[F.col("label")]
    body = flat.where(~head)
    if tables is not None:
        body = body.join(tables.select("doc_id", "ord", F.col("text").alias("rendered"), F.col("warning").alias("table_structure_warning")), ["doc_id", "ord"], "left")
    else:
        body = body.withColumns({"rendered": F.lit(None).cast("string"), "table_structure_warning": F.lit(None).cast("string")})
    shown_text = F.when(F.col("label") == "picture", "[Figure]").when(F.col("label") == "formula", F.when(F.col("t") != "", F.col("t")).otherwise("[Formula]")).when(F.col("label") == "table", strip(F.concat_ws("\n", F.when(F.col("t") != "", F.col("t")), "rendered"))).otherwise(F.col("t"))
    elements = body.select("doc_id", "section_id", "ord", kind.alias("element_type"), shown_text.alias("text"), F.coalesce("page", F.lit(1)).alias("page"), F.concat(F.lit("item_"), F.col("ord").cast("string")).alias("block_id"), F.when(F.col("caption") != "", F.col("caption")).alias("caption"), F.lit(None).cast("int").alias("width_px"), F.lit(None).cast("int").alias("height_px"), "table_structure_warning")
    pages = items.groupBy("doc_id").agg(F.coalesce(F.max("page"), F.lit(1)).alias("total_pages"))
    first = flat.where((F.col("label") == "title") & (F.col("t") != "")).groupBy("doc_id").agg(F.min_by("t", "ord").alias("title"))
    documents = pages.join(first, "doc_id", "left").join(running, "doc_id", "left").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), "total_pages", F.coalesce("running_header", F.lit("")).alias("running_header"))
    return documents, settle(sections, "sections"), settle(elements, "elements")


def item_regions(items: DataFrame) -> DataFrame:
    """Pictures and formulas of items with a box (left, top, width, height): numbered by kind, with captions."""
    w = in_order("doc_id")
    own = items.withColumn("caption", F.when(F.lead("label").over(w) == "caption", strip(F.coalesce(F.lead("text").over(w), F.lit("")))).otherwise(""))
    own = own.where(F.col("label").isin("picture", "formula"))
    number = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("ord"))
    name = F.concat(F.when(F.col("label") == "picture", "figure_").otherwise("formula_"), number.cast("string"))
    return own.select("doc_id", "ord", name.alias("block_id"), F.col("label").alias("kind"), "page", "left", "top", "width", "height", "caption")
