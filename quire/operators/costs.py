"""What a run would cost: items with a label and dollars, summed by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.layout import EMBED_USD, FIGURE_USD, PAGE_USD, TITLE_USD


def estimate(chunks: DataFrame, pages: DataFrame, ocr: bool = False, titles: bool = True) -> DataFrame:
    """(doc_id, label, amount, usd) of documents: chunks (doc_id, text, context_text, layout_type) and (doc_id, total_pages)."""
    own = F.when(F.coalesce("context_text", F.lit("")) != "", F.col("context_text")).otherwise(F.coalesce("text", F.lit("")))
    tokens = F.greatest(F.lit(1), F.floor(F.sum(F.length(own)) / 4)).cast("double")
    per = chunks.groupBy("doc_id").agg(tokens.alias("embeddings"), F.count_if(F.col("layout_type") == "figure").cast("double").alias("figures"))
    per = per.join(pages.select("doc_id", F.col("total_pages").cast("double").alias("pages")), "doc_id", "full_outer")
    items = [("embeddings", F.col("embeddings"), F.col("embeddings") / 1e6 * EMBED_USD), ("figures", F.col("figures"), F.col("figures") * FIGURE_USD)]
    if ocr:
        items.append(("pages", F.col("pages"), F.col("pages") * PAGE_USD))
    if titles:
        items.append(("titles", F.lit(1.0), F.lit(TITLE_USD)))
    rows = F.array(*(F.struct(F.lit(n).alias("label"), F.coalesce(a, F.lit(0.0)).alias("amount"), F.coalesce(u, F.lit(0.0)).alias("usd")) for n, a, u in items))
    return per.select("doc_id", F.explode(rows).alias("i")).select("doc_id", "i.*")


def total(items: DataFrame) -> DataFrame:
    """(label, amount, usd) over all documents, and the sum as 'total'."""
    whole = items.rollup("label").agg(F.sum("amount").alias("amount"), F.sum("usd").alias("usd"))
    return whole.select(F.coalesce("label", F.lit("total")).alias("label"), F.when(F.col("label").isNotNull(), F.col("amount")).alias("amount"), "usd")
