"""Store semantics on DataFrames: upserts that lose nothing, metadata merges, deletes, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) == ""


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep_if_blank: tuple[str, ...] = (), keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Insert or update by key; a blank (or null) incoming value of the named columns leaves the stored one. One row a key is expected on each side."""
    old, new = stored.alias("o"), incoming.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"n.{key}").isNotNull()

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep_if_blank:
            n = F.when(blank(n) & ~blank(o), o).otherwise(n)
        if c in keep_if_null:
            n = F.coalesce(n, o)
        return F.when(there, n).otherwise(o).alias(c)

    return both.select(*(pick(c) for c in stored.columns))


def merge_map(old: Column, new: Column) -> Column:
    """Keys of ``new`` win; a null value deletes its key; a null map changes nothing."""
    none = F.expr("cast(map() as map<string,string>)")
    o, n = F.coalesce(old, none), F.coalesce(new, none)
    left = F.map_filter(o, lambda k, v: ~F.array_contains(F.map_keys(n), k))
    return F.map_concat(left, F.map_filter(n, lambda k, v: v.isNotNull()))


def set_metadata(stored: DataFrame, patch: DataFrame) -> DataFrame:
    """Partial merge by doc_id: null keeps, '' or an empty array clears, attributes merge by key."""
    old, new = stored.alias("o"), patch.alias("n")
    both = old.join(new, F.col("o.doc_id") == F.col("n.doc_id"), "full_outer")
    out = [F.coalesce("n.doc_id", "o.doc_id").alias("doc_id")]
    for c in stored.columns:
        if c == "doc_id":
            continue
        if c not in patch.columns:
            out.append(F.col(f"o.{c}").alias(c))
        else:
            out.append((merge_map(F.col("o.attributes"), F.col("n.attributes")) if c == "attributes" else F.coalesce(f"n.{c}", f"o.{c}")).alias(c))
    return both.select(*out)


def apply_metadata(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Project and group of the sidecar on a document's chunks; no change if both are null, else both are set."""
    m = metadata.where("project_id is not null or group_name is not null").select("doc_id", F.col("project_id").alias("_p"), F.col("group_name").alias("_g"), F.lit(True).alias("_m"))
    j = chunks.join(m, "doc_id", "left")
    return j.withColumn("project_id", F.when(F.col("_m"), F.col("_p")).otherwise(F.col("project_id"))).withColumn("group_name", F.when(F.col("_m"), F.col("_g")).otherwise(F.col("group_name"))).drop("_p", "_g", "_m")


def delete_docs(table: DataFrame, doc_ids: list[str]) -> DataFrame:
    return table.where(~F.coalesce(F.col("doc_id").isin(doc_ids), F.lit(False)))


def describe_figure(chunks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Set (id, description) and add it to the context once."""
    j = chunks.join(descriptions.select("id", F.col("description").alias("_d")), "id", "left")
    line = F.concat(F.lit("Description: "), F.col("_d"))
    ctx = F.coalesce("context_text", F.lit(""))
    merged = F.when(F.col("_d").isNull() | F.contains(ctx, F.coalesce("_d", F.lit(""))), F.col("context_text")).when(ctx == "", line).otherwise(F.concat(ctx, F.lit("\n"), line))
    return j.withColumn("context_text", merged).withColumn("figure_description", F.coalesce("_d", "figure_description")).drop("_d")


def mpn_matches(mpn: Column, wanted: str) -> Column:
    """A part number equals one of a comma list."""
    return F.coalesce(F.array_contains(F.transform(F.split(mpn, ","), lambda x: F.trim(x)), wanted), F.lit(False))


def has_tags(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(tags, F.expr("cast(array() as array<string>)")))) == 0 if wanted else F.lit(True)


def add_alias(mpn: Column, new: str) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(mpn, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(F.concat(parts, F.array(F.lit(new)))), ",")


def ingested(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, first creation, title, and the last page of the last chunk that has pages."""
    some = F.when(F.coalesce(F.size("page_numbers"), F.lit(0)) > 0, F.col("seq"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("created_at").alias("created_at"), F.min_by("doc_title", F.when(~blank(F.col("doc_title")), F.col("seq"))).alias("title"), F.array_max(F.max_by("page_numbers", some)).alias("page_count"))


def new_documents(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    return candidates.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
