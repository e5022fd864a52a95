"""The control plane: API keys by token hash and the append-only audit log."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import readers


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def new_key(spark: SparkSession, label: str, scopes: list[str]) -> tuple[DataFrame, str]:
    """A key's row, and its token, of which only the hash is kept."""
    token, key = secrets.token_urlsafe(32), secrets.token_hex(6)
    row = spark.range(1).select(F.lit(key).alias("id"), F.lit(label).alias("label"), token_hash(F.lit(token)).alias("token_sha256"), F.array(*map(F.lit, scopes)).cast("array<string>").alias("scopes"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return row, token


def lookup(keys: DataFrame, token: str) -> DataFrame:
    """The live key of a token, or no row."""
    return keys.where((F.col("token_sha256") == token_hash(F.lit(token))) & F.col("revoked_at").isNull())


def listed(keys: DataFrame, include_revoked: bool = True) -> DataFrame:
    return (keys if include_revoked else keys.where("revoked_at is null")).orderBy("created_at", "id")


def revoked(keys: DataFrame, key_id: str) -> DataFrame:
    """All keys, the named one revoked now if it was live."""
    hit = (F.col("id") == key_id) & F.col("revoked_at").isNull()
    return keys.withColumn("revoked_at", F.when(hit, F.current_timestamp()).otherwise(F.col("revoked_at")))


def audit_row(spark: SparkSession, number: int, action: str, status: str, **values) -> DataFrame:
    """One audit record under readers.AUDIT; ``detail`` goes in as JSON."""
    detail = values.pop("detail", None)
    row = {"id": number, "action": action, "status": status, **values}
    made = spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items()), F.current_timestamp().alias("ts"))
    if detail is not None:
        made = made.withColumn("detail_json", F.to_json(F.create_map(*(F.lit(str(x)) for pair in detail.items() for x in pair))))
    return readers.migrate(made, readers.AUDIT)


def audit(log: DataFrame, doc_id: str | None = None, since=None, limit: int = 200) -> DataFrame:
    """The latest records, newest first; the limit is the report's."""
    if doc_id:
        log = log.where(F.col("doc_id") == doc_id)
    if since:
        log = log.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return log.orderBy(F.desc("id")).limit(limit)
