"""The corpus pipeline: five stages from raw documents to token ids' digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written and read again as the next stage's docs. All but the last return the
columns of documents, whatever other columns those are. Every stage takes null or
empty texts, null ids, repeated rows and empty tables; what it makes of them is in
its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, ngram_join, pii, quality
from quire.llm.common import cut, without
from quire.llm.queries import PII_KEY, public_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts are among them. Equal rows get equal verdicts."""
    return quality.keep_good(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one of least id stays.

    Of rows with one doc_id the one of least text stays (a null text comes first;
    then the other columns decide, as one string). Rows without a doc_id all stay,
    and so do texts without words, which are linked with nothing.
    """
    found = ngram_join.jaccard_join(docs, 5, 80)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    left = without(docs, gone)
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return left.select(*docs.columns)
    few = left.join(twice, "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*few.columns)))
    one = few.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return left.join(twice, "doc_id", "left_anti").unionByName(one).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, by doc_id; null and empty texts and rows without a doc_id stay."""
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, cut(found.select("doc_id").distinct(), "leaks"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; n_chars follows the new text. Null stays null; the same entity gets the same surrogate everywhere."""
    new = pii.replaced(docs, PII_KEY)
    return new.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded; the digests of both go out, one row a row. Null counts as empty."""
    return bpe.encode_decode(docs, public_path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII surrogates", personal_data),
    ("byte-level BPE", token_ids),
]

#: The line model, similarity classes and surrogates have no SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{i + 1}")
    return docs
