"""Outlines and figure geometry: sections of a block stream, running headers, captions, boxes, crops, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prices in dollars: a page read, a million embedding tokens, a figure, a title (fixed values).
PAGE_USD, EMBED_USD, FIGURE_USD, TITLE_USD = 0.004, 0.02, 0.00075, 0.0005


def assign_sections(blocks: DataFrame, by: str, order: str, kind: str = "kind") -> DataFrame:
    """The header or title that each block stands under, and the title that began its root."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col(kind).isin("title", "section_header"), F.col(order))
    root = F.when(F.col(kind) == "title", F.col(order))
    return blocks.withColumn("section", F.last(head, True).over(w)).withColumn("root", F.last(root, True).over(w))


def nearest_before(blocks: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(name, F.last(value, True).over(w))


def running_header(lines: DataFrame, by: str, text: str) -> DataFrame:
    """The line that a group repeats most, if twice or more."""
    seen = lines.where(F.col(text) != "").groupBy(by, text).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    best = seen.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), text))).where("r = 1")
    return best.select(by, F.col(text).alias("header"), "n")


def repeated_headings(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, title) of headings that only ever stand empty, and do so max(3, 4 % of pages) times or more."""
    seen = sections.groupBy("doc_id", "title").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("n_elements") > 0).cast("int")).alias("full"))
    least = F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.04).cast("int"))
    return seen.join(pages, "doc_id").where((F.col("full") == 0) & (F.col("n") >= least)).select("doc_id", "title", "n")


def is_contents(title: Column, lines: Column) -> Column:
    """A table of contents by its title, or by ten or more lines of which 60 % end in a leader and a number."""
    like = F.size(F.filter(lines, lambda x: x.rlike(r"^.+[.\s]{2,}\d+\s*$")))
    named = F.lower(F.trim(title)).isin("contents", "table of contents", "index", "toc")
    return F.coalesce(named, F.lit(False)) | F.coalesce((F.size(lines) >= 10) & (like >= 0.6 * F.size(lines)), F.lit(False))


def merge_continued(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, ord, title) with the ord of the section that a '(continued)' one belongs to."""
    base = F.trim(F.regexp_replace("title", r"(?i)\s*\(?\s*(continued|cont\.?|cont'd)\s*\)?\s*$", ""))
    own = sections.withColumn("base", F.lower(base)).withColumn("goes_on", F.lower(F.trim("title")) != F.lower(base))
    w = Window.partitionBy("doc_id", "base").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.withColumn("into", F.coalesce(F.last(F.when(~F.col("goes_on"), F.col("ord")), True).over(w), F.col("ord"))).drop("base")


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box structs (left, top, right, bottom)."""
    f = lambda x, k: F.col(f"{x}.{k}")
    w = F.greatest(F.lit(0.0), F.least(f(a, "right"), f(b, "right")) - F.greatest(f(a, "left"), f(b, "left")))
    h = F.greatest(F.lit(0.0), F.least(f(a, "bottom"), f(b, "bottom")) - F.greatest(f(a, "top"), f(b, "top")))
    area = lambda x: (f(x, "right") - f(x, "left")) * (f(x, "bottom") - f(x, "top"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def crop_caps(boxes: DataFrame, padding: float) -> DataFrame:
    """Space right and left of each box up to a neighbour on its page that is nearer than the padding and overlaps 30 % of the lower height."""
    a, b = boxes.alias("a"), boxes.alias("b")
    height = lambda x: F.col(f"{x}.bottom") - F.col(f"{x}.top")
    over = F.least(F.col("a.bottom"), F.col("b.bottom")) - F.greatest(F.col("a.top"), F.col("b.top"))
    gap = F.col("b.left") - F.col("a.right")
    near = (F.col("a.page") == F.col("b.page")) & (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.left") < F.col("b.left")) & (gap >= 0) & (gap < padding) & (over >= 0.3 * F.least(height("a"), height("b")))
    pairs = a.join(b, near).select(F.col("a.box_id").alias("l"), F.col("b.box_id").alias("r"), (gap / 2).alias("cap"))
    right = pairs.groupBy(F.col("l").alias("box_id")).agg(F.min("cap").alias("right_cap"))
    left = pairs.groupBy(F.col("r").alias("box_id")).agg(F.min("cap").alias("left_cap"))
    return boxes.select("box_id").join(right, "box_id", "left").join(left, "box_id", "left")


def embedding_cost(docs: DataFrame, text: str = "text") -> DataFrame:
    """(tokens, usd): characters over four, one at least each."""
    tokens = F.sum(F.greatest(F.lit(1), F.floor(F.length(text) / 4)))
    return docs.where(F.col(text).isNotNull()).agg(tokens.cast("long").alias("tokens"), (tokens / 1e6 * EMBED_USD).alias("usd"))
