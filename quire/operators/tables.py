"""Table structure: detectors of misread headers, column counts, renderings, repair checks.

Cells: table_id, row, col (from 1), row_span, col_span, text, is_header,
is_origin (null: true).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip

GARBLED_CHARS, GARBLED_REPEATS, FUSED_CHARS, COLUMN_SHARE = 12, 3, 2, 0.7
MAX_HEADER_ROWS, MAX_HEADER_SHARE = 6, 0.3


def cells(df: DataFrame) -> DataFrame:
    return df.withColumn("is_origin", F.coalesce("is_origin", F.lit(True))).withColumn("t", strip(F.coalesce("text", F.lit(""))))


def garbled_headers(df: DataFrame) -> DataFrame:
    """(table_id, garbled): the long header text that most header cells repeat, if three or more do."""
    own = cells(df).where(F.col("is_header") & F.col("is_origin") & (F.length("t") >= GARBLED_CHARS))
    seen = own.groupBy("table_id", "t").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "col")).alias("at"))
    best = seen.withColumn("r", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("n"), "at"))).where((F.col("r") == 1) & (F.col("n") >= GARBLED_REPEATS))
    return best.select("table_id", F.col("t").alias("garbled"))


def fused_headers(df: DataFrame) -> DataFrame:
    """(table_id, fused): of the first header row with two or more texts that data cells have too, three in order."""
    own = cells(df).where(F.col("is_origin") & (F.col("t") != "")).withColumn("t", F.lower("t"))
    data = own.where(~F.col("is_header") & (F.length("t") >= FUSED_CHARS)).select("table_id", "t").distinct()
    leaked = own.where("is_header").join(data, ["table_id", "t"], "left_semi")
    rows = leaked.groupBy("table_id", "row").agg(F.array_sort(F.collect_set("t")).alias("texts")).where(F.size("texts") >= 2)
    first = rows.groupBy("table_id").agg(F.min_by("texts", "row").alias("texts"))
    return first.select("table_id", F.array_join(F.slice("texts", 1, 3), ", ").alias("fused"))


def header_rows(df: DataFrame) -> DataFrame:
    own = cells(df)
    return own.groupBy("table_id").agg(F.coalesce(F.max(F.when(F.col("is_header") & F.col("is_origin"), F.col("row"))), F.lit(0)).alias("header_rows"), F.max("row").alias("total_rows"))


def column_counts(df: DataFrame) -> DataFrame:
    """(table_id, header_rows, total_rows, column_count): the width most data rows have, 0 if too few agree."""
    own = cells(df).where("is_origin").join(header_rows(df), "table_id")
    body = own.withColumn("is_data", F.col("row") > F.col("header_rows")).withColumn("has_data", F.max("is_data").over(Window.partitionBy("table_id"))).where("is_data or not has_data")
    widths = body.groupBy("table_id", "row").agg(F.max(F.col("col") + F.col("col_span") - 1).alias("w"))
    votes = widths.groupBy("table_id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    per = Window.partitionBy("table_id")
    best = votes.withColumn("all", F.sum("n").over(per)).withColumn("r", F.row_number().over(per.orderBy(F.desc("n"), "first"))).where("r = 1")
    count = F.when(F.col("n") / F.col("all") < COLUMN_SHARE, 0).otherwise(F.col("w"))
    return header_rows(df).join(best.select("table_id", count.alias("column_count")), "table_id", "left").withColumn("column_count", F.coalesce("column_count", F.lit(0)))


def untrustworthy(df: DataFrame) -> DataFrame:
    """(table_id, reason): garbled first, then fused, else null."""
    ids = df.select("table_id").distinct()
    both = ids.join(garbled_headers(df), "table_id", "left").join(fused_headers(df), "table_id", "left")
    reason = F.coalesce(F.concat(F.lit("garbled header: "), F.substring("garbled", 1, 60)), F.concat(F.lit("fused header and data row: "), F.col("fused")))
    return both.select("table_id", "garbled", "fused", reason.alias("reason"))


def compact_text(df: DataFrame) -> DataFrame:
    """(table_id, text): rows of cells between bars; a spanned cell once; blank rows dropped."""
    shown = F.when(F.col("is_origin"), F.col("t")).otherwise("")
    rows = cells(df).withColumn("s", shown).groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "s"))).alias("c")).where(F.exists("c", lambda x: x["s"] != ""))
    lines = rows.select("table_id", "row", F.array_join(F.transform("c", lambda x: x["s"]), " | ").alias("line"))
    return lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))


def reading_order_text(df: DataFrame) -> DataFrame:
    """(table_id, text): texts row by row, equal neighbours once, no grid."""
    own = cells(df).where(F.col("is_origin") & (F.col("t") != ""))
    texts = own.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "t"))), lambda x: x["t"]).alias("a"))
    kept = F.filter("a", lambda x, i: (i == 0) | (x != F.get(F.col("a"), i - 1)))
    return texts.select("table_id", F.array_join(kept, "\n").alias("text"))


def repair_eligible(df: DataFrame) -> DataFrame:
    """(table_id, skip): why a header band cannot be repaired, or null."""
    h = F.col("header_rows")
    skip = (
        F.when(h == 0, "no header rows")
        .when(h > MAX_HEADER_ROWS, "too many header rows")
        .when(h > MAX_HEADER_SHARE * F.col("total_rows"), "header too large a share")
        .when(F.col("column_count") == 0, "no trusted column count")
    )
    return column_counts(df).select("table_id", skip.alias("skip"))


def validate_grid(proposal: DataFrame, bands: DataFrame, data: DataFrame | None = None) -> DataFrame:
    """Proposals (table_id, row, col, row_span, col_span, text) against (table_id, header_rows, column_count).

    (table_id, reason): null if the cells are positive, inside the band, and tile it
    exactly, no long text repeats across it, and no row repeats data of its columns.
    ``data``: the table's cells; only those below the header count.
    """
    own = proposal.join(bands, "table_id")
    bad = (F.col("row") < 1) | (F.col("col") < 1) | (F.col("row_span") < 1) | (F.col("col_span") < 1)
    out = (F.col("row") + F.col("row_span") - 1 > F.col("header_rows")) | (F.col("col") + F.col("col_span") - 1 > F.col("column_count"))
    state = own.groupBy("table_id").agg(F.max(bad).alias("bad"), F.max(out).alias("out"), F.first(F.col("header_rows") * F.col("column_count")).alias("area"))
    fine = own.where(~bad & ~out)
    spots = fine.select("table_id", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r"), "col", "col_span").select("table_id", "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("c"))
    tiled = spots.groupBy("table_id", "r", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("table_id").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("covered"))
    joined = state.join(tiled, "table_id", "left")
    reason = F.when(F.col("bad"), "non-positive cell").when(F.col("out"), "outside band").when(F.col("most") > 1, "overlap").when(F.coalesce("covered", F.lit(0)) < F.col("area"), "gap")
    t = proposal.withColumn("t", strip(F.coalesce("text", F.lit(""))))
    repeats = t.where(F.length("t") >= GARBLED_CHARS).groupBy("table_id", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("table_id").agg(F.max("n").alias("repeats"))
    joined = joined.join(repeats, "table_id", "left")
    reason = reason.when(F.col("repeats") >= GARBLED_REPEATS, "still garbled")
    if data is not None:
        body = cells(data).join(bands.select("table_id", "header_rows"), "table_id").where(F.col("is_origin") & (F.col("row") > F.col("header_rows")) & (F.length("t") >= FUSED_CHARS))
        spots = body.select("table_id", F.lower("t").alias("k"), F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("col")).distinct()
        same = t.where(F.length("t") >= FUSED_CHARS).withColumn("k", F.lower("t")).join(spots, ["table_id", "col", "k"], "left_semi")
        fused = same.groupBy("table_id", "row").agg(F.count_distinct("t").alias("n")).groupBy("table_id").agg(F.max("n").alias("fused"))
        joined = joined.join(fused, "table_id", "left")
        reason = reason.when(F.col("fused") >= 2, "repeats data")
    return joined.select("table_id", reason.alias("reason"))


def splice_header(df: DataFrame, proposal: DataFrame, bands: DataFrame) -> DataFrame:
    """Cells with the header band replaced by the proposal, spans expanded."""
    body = cells(df).drop("t").join(bands, "table_id").where(F.col("row") > F.col("header_rows")).select("table_id", "row", "col", "row_span", "col_span", "text", "is_header", "is_origin")
    grid = proposal.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    head = grid.select("table_id", F.col("r").alias("row"), F.col("c").alias("col"), "row_span", "col_span", "text", F.lit(True).alias("is_header"), ((F.col("r") == F.col("row")) & (F.col("c") == F.col("col"))).alias("is_origin"))
    return head.unionByName(body)


def repaired(df: DataFrame, proposal: DataFrame) -> DataFrame:
    """Cells with the header bands of accepted proposals, others as they are, and which tables changed (``repaired``)."""
    bands = column_counts(df).select("table_id", "header_rows", "column_count")
    fine = validate_grid(proposal, bands, df).where("reason is null").select("table_id")
    some = df.join(fine, "table_id", "left_semi")
    spliced = splice_header(some, proposal.join(fine, "table_id", "left_semi"), bands)
    rest = cells(df).drop("t").join(fine, "table_id", "left_anti").select(*spliced.columns)
    return spliced.withColumn("repaired", F.lit(True)).unionByName(rest.withColumn("repaired", F.lit(False)))
