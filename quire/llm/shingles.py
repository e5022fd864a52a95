"""Native word shingles: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 5
#: Rows of a reference table (shingles of templates or items) up to which it may be broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, width: int = WIDTH) -> Column:
    """Hashes of all word shingles in order; empty with fewer words."""
    n = F.size(w) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, width)))).otherwise(F.expr("cast(array() as array<bigint>)"))


def text_shingles(text: Column) -> Column:
    """Shingles of a text. The words are bound to a lambda's variable, so they are split once and not once a shingle."""
    return F.element_at(F.transform(F.array(words(text)), lambda w: F.when(w.isNotNull(), shingles(w))), 1)


def small(df: DataFrame) -> DataFrame:
    """Mark a reference table for broadcasting if its rows are few; beyond, joins shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def rows(spark: SparkSession, values: list[tuple], names: list[str]) -> DataFrame:
    """A small table of literals; without any, an empty table of strings."""
    if not values:
        return spark.range(0).select(*(F.lit("").alias(n) for n in names))
    made = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(v, names))) for v in values))
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def with_spots(docs: DataFrame, spots: DataFrame, spot: Column) -> DataFrame:
    """Documents that have spots, with an array of them; broadcast only if all spots are few."""
    few = spots.count() <= 5 * BROADCAST_ROWS
    by_doc = spots.groupBy("doc_id").agg(F.collect_list(spot).alias("spots"))
    return docs.join(F.broadcast(by_doc) if few else by_doc, "doc_id")
