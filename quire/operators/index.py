"""A stored inverted index: folded and stemmed terms with places, in append-only segments.

Below a root folder: ``postings`` (term, id, places; by segment and by bucket of the
term), ``docs`` (id, dl; by segment) and ``gone`` (id, segment). A document's latest
segment counts, unless it has gone since; so adding, replacing and removing
documents writes only what is new, and a search reads only the buckets of the terms
it asks for. ``compact`` writes one segment anew.

A document's texts are analysed one after another; counts and lengths are over all
of them, and a phrase lies within one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire.functions import stem, text
from quire.operators.search import bm25, top

BUCKETS = 64
#: Places of a document's next text begin so much later.
GAP = 1 << 24
POSTINGS, DOCS, GONE = "term string, id string, places array<bigint>, segment bigint, b int", "id string, dl bigint, segment bigint", "id string, segment bigint"


def bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@F.pandas_udf(ArrayType(StringType()))
def terms(x):
    return x.map(stem.analyse)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term, ids, places = [], [], []
        for i, texts in zip(batch.column("id").to_pylist(), batch.column("texts").to_pylist()):
            found: dict[str, list[int]] = {}
            n = 0
            for k, t in enumerate(texts or ()):
                for at, w in enumerate(stem.analyse(t)):
                    found.setdefault(w, []).append(k * GAP + at)
                    n += 1
            term += [None, *found]
            ids += [i] * (len(found) + 1)
            places += [[n], *found.values()]  # without a term: the length
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(ids, pa.string()), pa.array(places, pa.list_(pa.int64()))], names=["term", "id", "places"])


class Index:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for name, schema in (("postings", POSTINGS), ("docs", DOCS), ("gone", GONE)):
            if not self._there(name):
                by = {"postings": ["segment", "b"], "docs": ["segment"], "gone": []}[name]
                spark.createDataFrame([], schema).write.partitionBy(*by).parquet(f"{self.root}/{name}")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _next(self) -> int:
        return max((self._read(n, s).agg(F.max("segment")).first()[0] or 0) for n, s in (("docs", DOCS), ("gone", GONE))) + 1

    def add(self, docs: DataFrame, segment: int | None = None) -> int:
        """Add or replace (id, texts). One row an id; null texts are empty. Postings go out before the documents that make them count."""
        segment = self._next() if segment is None else segment
        rows = docs.select(F.col("id").cast("string").alias("id"), "texts").mapInArrow(_post, "term string, id string, places array<bigint>")
        staged = f"{self.root}/.staged"
        rows.write.mode("overwrite").parquet(staged)
        rows = self.spark.read.schema("term string, id string, places array<bigint>").parquet(staged)
        b = bucket(F.col("term"))
        rows.where("term is not null").withColumn("segment", F.lit(segment).cast("long")).withColumn("b", b).repartition("b").write.mode("append").partitionBy("segment", "b").parquet(f"{self.root}/postings")
        rows.where("term is null").select("id", F.get("places", F.lit(0)).alias("dl"), F.lit(segment).cast("long").alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{self.root}/docs")
        return segment

    def remove(self, ids: DataFrame) -> None:
        """Remove ids; a later ``add`` brings one back."""
        last = self._next() - 1
        ids.select(F.col("id").cast("string").alias("id"), F.lit(last).cast("long").alias("segment")).write.mode("append").parquet(f"{self.root}/gone")

    def live(self) -> DataFrame:
        """(id, dl, segment) of the documents that count."""
        latest = self._read("docs", DOCS).groupBy("id").agg(F.max(F.struct("segment", "dl")).alias("l")).select("id", "l.segment", "l.dl")
        gone = self._read("gone", GONE).groupBy("id").agg(F.max("segment").alias("until"))
        return latest.join(gone, "id", "left").where("until is null or segment > until").select("id", "dl", "segment")

    def search(self, queries: DataFrame, k: int = 10, coverage_exponent: float = 2.0, where: DataFrame | None = None) -> DataFrame:
        """Coverage-weighted BM25 of (qid, query); ``where``: (id) of what may be returned, statistics are of all."""
        words = queries.select("qid", text.keywords(F.col("query")).alias("kw")).withColumn("n_kw", F.size("kw")).select("qid", "n_kw", F.posexplode("kw").alias("ord", "word"))
        asked = words.withColumn("parts", terms(F.col("word"))).where("size(parts) > 0")
        kinds = asked.select("word", "parts").distinct().select("word", F.size("parts").alias("m"), F.posexplode("parts").alias("j", "term"))
        buckets = [r.b for r in kinds.select(bucket(F.col("term")).alias("b")).distinct().collect()]  # at most BUCKETS
        live = self.live()
        own = self._read("postings", POSTINGS).where(F.col("b").isin(buckets)) if buckets else self._read("postings", POSTINGS).limit(0)
        hits = own.select("term", "id", "places", "segment").join(kinds, "term").join(live, ["id", "segment"])
        one = hits.where("m = 1").select("word", "id", "dl", F.size("places").cast("long").alias("tf"))
        # A phrase: all its parts at consecutive places.
        spots = hits.where("m > 1").select("word", "id", "dl", "m", "j", F.explode("places").alias("at")).groupBy("word", "id", "dl", "m", (F.col("at") - F.col("j")).alias("start")).agg(F.count_distinct("j").alias("parts"))
        many = spots.where("parts = m").groupBy("word", "id", "dl").agg(F.count(F.lit(1)).alias("tf")).select("word", "id", "dl", "tf")
        found = one.unionByName(many)
        df = found.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        stats = live.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        rows = found.join(df, "word").join(F.broadcast(stats)).select("word", "id", bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl")).alias("bm25"))
        if where is not None:
            rows = rows.join(where.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
        summed = words.join(rows, "word").groupBy("qid", "id", "n_kw").agg(F.sum("bm25").alias("bm25_sum"), F.count("ord").alias("hits"))
        scored = summed.withColumn("score", F.col("bm25_sum") * F.pow(F.col("hits") / F.col("n_kw"), F.lit(coverage_exponent)))
        return top(scored.withColumn("by", F.round("score", 9)), k, F.col("by").desc(), F.col("id")).select("qid", "rank", "id", "bm25_sum", "hits", "score")

    def compact(self, root: str) -> Index:
        """The live documents as one segment in another folder."""
        new, live = Index(self.spark, root), self.live()
        self._read("postings", POSTINGS).join(live.select("id", "segment"), ["id", "segment"], "left_semi").withColumn("segment", F.lit(1).cast("long")).select("term", "id", "places", "segment", "b").repartition("b").write.mode("append").partitionBy("segment", "b").parquet(f"{new.root}/postings")
        live.select("id", "dl", F.lit(1).cast("long").alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{new.root}/docs")
        return new
