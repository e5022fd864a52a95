"""Incremental ingest: a file stream, each batch once, known documents skipped, chunks upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import chunking
from quire.sources import readers
from quire.sources.scratch import settle


def elements_of(docs: DataFrame) -> DataFrame:
    none = F.lit(None)
    lines = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.select("doc_id", F.lit(0).alias("section"), "ord", F.lit("text").alias("element_type"), "text", (F.floor(F.col("ord") / 10) + 1).cast("int").alias("page"), none.cast("string").alias("caption"), none.cast("int").alias("width_px"), none.cast("int").alias("height_px"))


def ingest_stream(spark: SparkSession, source: str, schema, store: str, checkpoint: str, force: bool = False) -> None:
    """Ingest all files that have come since the last run.

    Chunks are dealt to parts by their document. A batch replaces whole parts, with
    the documents in it: known documents are skipped unless forced, and a forced one's
    chunks go when its new ones come. So a batch that is run again after a failure
    gives the same store. Documents that can't be chunked are written to
    ``{store}-failed`` with the reason, and the others go on.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(readers.PARTS)).cast("int")

    def one(batch: DataFrame, number: int) -> None:
        there = spark._jvm.org.apache.hadoop.fs.Path(store)
        exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
        docs = batch.withColumn("doc_id", F.col("doc_id").cast("string")).dropDuplicates(["doc_id"])
        known = spark.read.parquet(store) if exists else None
        if known is not None and not force:
            docs = docs.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
        reason = F.when(F.col("doc_id").isNull(), "no id").when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text")
        docs = settle(docs.select("doc_id", "text", reason.alias("reason")), "batch")
        docs.where("reason is not null").select("doc_id", "reason").write.mode("overwrite").json(f"{store}-failed/batch={number}")
        good = docs.where("reason is null")
        new = settle(chunking.micro_chunks(elements_of(good)).withColumn("part", part), "batch")
        if known is not None:
            parts = [r.part for r in new.select("part").distinct().collect()]  # at most PARTS
            kept = known.where(F.col("part").isin(parts)).join(good.select("doc_id"), "doc_id", "left_anti")
            new = settle(new.unionByName(kept.select(*new.columns)), "batch")
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(store)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Progress:
    """Events of a stream's batches, as a caller's function gets them: (name, batch, rows)."""

    def __init__(self, spark: SparkSession, tell):
        from pyspark.sql.streaming import StreamingQueryListener

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                tell("started", None, 0)

            def onQueryProgress(self, event):
                tell("progress", event.progress.batchId, event.progress.numInputRows)

            def onQueryTerminated(self, event):
                tell("failed" if event.exception else "ended", None, 0)

        self.spark, self.listener = spark, Listener()

    def __enter__(self):
        self.spark.streams.addListener(self.listener)
        return self

    def __exit__(self, *_):
        self.spark.streams.removeListener(self.listener)


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """An extension: counts of audit events by window and type; late ones within the watermark count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
