"""One object over a store folder, with the operations of a document retrieval backend."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import models
from quire.operators import control, graph, index, navigate, search, store, views
from quire.sources import readers
from quire.sources.scratch import settle


class Engine:
    """All reads return DataFrames. Writes replace the touched parts of a table: new files are complete before old ones go."""

    def __init__(self, spark: SparkSession, root: str, dim: int, embed: Callable[[list[str]], list[list[float]]] | None = None, files: str | None = None):
        self.spark, self.root, self.dim, self.embed, self.files = spark, root, dim, embed, files or f"{root}/files"

    def create(self) -> None:
        """Make the tables that aren't there. A store of another dimension is an error."""
        readers.check_store(self.spark, self.root, self.dim)
        for name, schema in readers.TABLES.items():
            empty = self.spark.createDataFrame([], schema)
            part = readers.part_of(name)
            w = (empty if part is None else empty.withColumn("part", part)).write.mode("ignore")
            (w if part is None else w.partitionBy("part")).parquet(f"{self.root}/{name}")
        index.Index(self.spark, f"{self.root}/index")

    # tables

    def table(self, name: str) -> DataFrame:
        return readers.read_table(self.spark, self.root, name)

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    @property
    def index(self) -> index.Index:
        return index.Index(self.spark, f"{self.root}/index")

    def _change(self, name: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the parts of a table that hold the documents of ``touched`` (doc_id)."""
        part = F.pmod(F.xxhash64("doc_id"), F.lit(readers.PARTS)).cast("int")
        parts = [r.p for r in touched.select(part.alias("p")).distinct().collect()]  # at most PARTS
        if not parts:
            return
        new = settle(change(readers.read_table(self.spark, self.root, name, parts)), name)
        readers.write_table(new, self.root, name, self.dim)
        # A part that has no row left is not written, so its old files go by hand.
        left = {r.p for r in new.select(readers.part_of(name).alias("p")).distinct().collect()}
        for p in set(parts) - left:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/part={p}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # search

    def search(self, queries: DataFrame, mode: str = "hybrid", k: int = 10, where: Column | None = None) -> DataFrame:
        """Queries (qid, query, and embedding unless the engine embeds) in one of the modes vector, keyword and hybrid.

        Keywords are looked up in the stored index, over contexts and texts.
        """
        if mode not in ("vector", "keyword", "hybrid"):
            raise ValueError(f"unknown mode {mode!r}")
        blank = queries.where(store.blank(F.trim("query")))
        if mode != "vector" and not blank.isEmpty():
            raise ValueError("blank query")
        if mode != "keyword" and "embedding" not in queries.columns:
            queries = queries.withColumn("embedding", models.embedder(self.embed)("query"))
        allowed = None if where is None else self.chunks.where(where).select("id")
        wide = max(4 * k, 40) if mode == "hybrid" else k
        lists = []
        if mode in ("vector", "hybrid"):
            vectors = self.table("chunk_vecs").withColumnRenamed("chunk_id", "id")
            lists.append(search.vector_search(vectors if allowed is None else vectors.join(allowed, "id", "left_semi"), queries, wide))
        if mode in ("keyword", "hybrid"):
            lists.append(self.index.search(queries, wide, where=allowed))
        found = search.fuse(*lists, k) if mode == "hybrid" else lists[0]
        return found.select("qid", "rank", "id", "score", F.lit(mode).alias("match_source")).join(self.chunks, "id")

    def results(self, queries: DataFrame, mode: str = "hybrid", k: int = 5, where: Column | None = None) -> DataFrame:
        """Compact result rows of a search, by question and rank."""
        found = self.search(queries, mode, k, where)
        return views.shaped(found).join(found.select("qid", "rank", F.col("id").alias("chunk_id")), "chunk_id").orderBy("qid", "rank")

    # chunks

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("id") == chunk_id)

    def get_children(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("parent_id") == chunk_id).orderBy("seq")

    def neighbours(self, starts: DataFrame) -> DataFrame:
        return views.neighbours(self.chunks).join(starts, "id", "left_semi")

    def navigate(self, starts: DataFrame, direction: str) -> DataFrame:
        return navigate.navigate(starts, self.chunks, direction)

    def _where(self, **equal: str | None) -> DataFrame:
        return functools.reduce(lambda df, x: df if x[1] is None else df.where(F.col(x[0]) == x[1]), equal.items(), self.chunks)

    def count_chunks(self, doc_id: str | None = None, project_id: str | None = None) -> int:
        return self._where(doc_id=doc_id, project_id=project_id).count()

    def stats(self, doc_id: str | None = None, project_id: str | None = None) -> DataFrame:
        """(level, n), the total without a level."""
        return self._where(doc_id=doc_id, project_id=project_id).rollup("level").agg(F.count(F.lit(1)).alias("n"))

    # documents

    def list_docs(self, project_id: str | None = None, group_name: str | None = None, mpn: str | None = None, manufacturer: str | None = None) -> DataFrame:
        side = self.table("doc_metadata")
        for name, value in (("project_id", project_id), ("group_name", group_name), ("manufacturer", manufacturer)):
            if value is not None:
                side = side.where(F.col(name) == value)
        return (side if mpn is None else side.where(store.mpn_matches(F.col("mpn"), mpn))).orderBy("doc_id")

    def list_documents(self, **equal: str) -> DataFrame:
        """The sidecar of documents with title and page count."""
        own = store.ingested(self.chunks).select("doc_id", "n_chunks", "created_at", "title", "page_count")
        return self.list_docs(**equal).join(own, "doc_id", "left").orderBy("doc_id")

    def get_ingested_docs(self, project_id: str | None = None) -> DataFrame:
        return store.ingested(self._where(project_id=project_id)).orderBy("created_at", "doc_id")

    def get_doc_titles(self) -> DataFrame:
        return store.ingested(self.chunks).where("title is not null").select("doc_id", "title")

    def set_doc_title(self, doc_id: str, title: str) -> int:
        n = self.count_chunks(doc_id)
        own = F.col("doc_id") == doc_id
        self._change("chunks", self.chunks.where(own), lambda c: c.withColumn("doc_title", F.when(own, F.lit(title)).otherwise(F.col("doc_title"))))
        return n

    def resolve_doc_id(self, prefix: str) -> str:
        found = [r.doc_id for r in self.chunks.where(F.startswith("doc_id", F.lit(prefix))).select("doc_id").distinct().limit(2).collect()]
        if len(found) != 1:
            raise ValueError(f"{prefix!r} names {'no' if not found else 'more than one'} document")
        return found[0]

    # sidecar

    def get_metadata(self, doc_id: str) -> DataFrame:
        return views.document_metadata(self.table("doc_metadata").where(F.col("doc_id") == doc_id), self.chunks.where(F.col("doc_id") == doc_id))

    def set_metadata(self, patch: DataFrame) -> None:
        """Merge (doc_id, …) into the sidecar."""
        self._change("doc_metadata", patch, lambda old: store.set_metadata(old, patch))

    def delete_metadata(self, doc_id: str) -> None:
        self._change("doc_metadata", self.table("doc_metadata").where(F.col("doc_id") == doc_id), lambda old: store.delete_docs(old, [doc_id]))

    def mark_stale(self, doc_id: str, stale: bool = True) -> None:
        """Note in the sidecar that a document's vectors are older than its texts, or take the note away."""
        row = self.spark.range(1).select(F.lit(doc_id).alias("doc_id"), F.create_map(F.lit("needs_reembed"), F.lit("true" if stale else None).cast("string")).alias("attributes"))
        self.set_metadata(row)

    def apply_metadata(self, doc_id: str | None = None) -> int:
        """Project and group of the sidecar on the documents' chunks; how many documents that concerns."""
        side = self.table("doc_metadata") if doc_id is None else self.table("doc_metadata").where(F.col("doc_id") == doc_id)
        some = side.where("project_id is not null or group_name is not null")
        self._change("chunks", some, lambda c: store.apply_metadata(c, side).select(*c.columns))
        return some.count()

    # writes

    def upsert_chunks(self, chunks: DataFrame, vectors: DataFrame | None = None) -> int:
        """Insert or update by id; vectors only if given. Of two rows of one id in the input either may win, so one is an error."""
        twice = chunks.groupBy("id").count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"more than one chunk {twice.first().id!r}")
        chunks = settle(readers.migrate(chunks, readers.CHUNKS), "incoming")
        self._change("chunks", chunks, lambda old: store.upsert(old, chunks, "id", keep_if_blank=("doc_title",), keep_if_null=("figure_description",)))
        if vectors is not None:
            vectors = settle(vectors, "incoming")
            docs = vectors.select(readers.document_of("chunk_id").alias("doc_id"))
            self._change("chunk_vecs", docs, lambda old: store.upsert(old, vectors, "chunk_id"))
        self.index.add(chunks.select("id", F.array(F.coalesce("context_text", F.lit("")), F.coalesce("text", F.lit(""))).alias("texts")))
        return chunks.count()

    def delete_doc(self, doc_id: str) -> int:
        """Delete a document's chunks, vectors and index entries; how many chunks."""
        gone = settle(self.chunks.where(F.col("doc_id") == doc_id).select("id", "doc_id"), "gone")
        n = gone.count()
        self.index.remove(gone.select("id"))
        self._change("chunk_vecs", gone, lambda old: old.where(readers.document_of("chunk_id") != doc_id))
        self._change("chunks", gone, lambda old: store.delete_docs(old, [doc_id]))
        return n

    def ingest(self, chunks: DataFrame, project_id: str | None = None, group_name: str | None = None, metadata: DataFrame | None = None, embed: bool = True, describe=None, infer_title=None, force: bool = False) -> DataFrame:
        """Store chunks of documents: (doc_id, status), where those in the store already are skipped unless forced.

        ``describe`` and ``infer_title`` are UDFs of a text model. A forced document's
        old chunks go first.
        """
        named = [c for c in (("project_id", project_id), ("group_name", group_name)) if c[1] is not None]
        chunks = readers.migrate(chunks, readers.CHUNKS).withColumns({k: F.lit(v) for k, v in named}).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        docs = settle(chunks.select("doc_id").distinct(), "docs")
        known = settle(docs.join(self.chunks.select("doc_id").distinct(), "doc_id", "left_semi"), "known")
        if force:
            for r in known.collect():  # documents that are given again, one call's worth
                self.delete_doc(r.doc_id)
        else:
            chunks = chunks.join(known, "doc_id", "left_anti")
        if describe is not None:
            figure = (F.col("layout_type") == "figure") & store.blank(F.col("figure_description"))
            said = chunks.where(figure).select("id", describe(F.coalesce("figure_caption", "text")).alias("description"))
            chunks = store.describe_figure(chunks, said).select(*chunks.columns)
        chunks = settle(chunks, "ingest")
        vectors = None
        if embed and self.embed is not None:
            own = chunks.withColumn("payload", models.payload()).where("payload is not null")
            vectors = own.select(F.col("id").alias("chunk_id"), models.embedder(self.embed)("payload").alias("embedding"))
        self.upsert_chunks(chunks, vectors)
        if metadata is not None:
            self.set_metadata(metadata)
            self.apply_metadata()
        if infer_title is not None:
            self.infer_titles(infer_title, docs)
        done = docs if force else docs.join(known, "doc_id", "left_anti")
        return done.select("doc_id", F.lit("processed").alias("status")).unionByName(docs.join(done, "doc_id", "left_anti").select("doc_id", F.lit("skipped").alias("status")))

    def ingest_blocks(self, blocks: DataFrame, manifest: DataFrame | None = None, **options) -> DataFrame:
        """OCR blocks through the chunking run into the store."""
        return self.ingest(graph.chunk_blocks(blocks, manifest), **options)

    # figures and titles

    def list_figures(self, doc_id: str | None = None, project_id: str | None = None, only_with_image: bool = True) -> DataFrame:
        own = self._where(doc_id=doc_id, project_id=project_id).where(F.col("layout_type") == "figure")
        return (own.where("figure_image_path is not null or figure_s3_key is not null") if only_with_image else own).orderBy("doc_id", "seq")

    def figure_bytes(self, chunk_id: str) -> bytes:
        row = self.get_chunk(chunk_id).select("figure_image_path", "figure_s3_key").first()
        path = row and (row.figure_image_path or row.figure_s3_key)
        if not path:
            raise FileNotFoundError(f"{chunk_id} has no image")
        return bytes(self.spark.read.format("binaryFile").load(path).select("content").first().content)

    def update_figure_descriptions(self, descriptions: DataFrame) -> None:
        """(id, description) of figures; the context gets each once."""
        docs = descriptions.select(readers.document_of("id").alias("doc_id"))
        self._change("chunks", docs, lambda c: store.describe_figure(c, descriptions).select(*c.columns))

    def describe_figures(self, describe, doc_id: str | None = None, project_id: str | None = None, missing_only: bool = True, limit: int | None = None, dry_run: bool = False) -> DataFrame:
        """(id, description) by a UDF of a vision model over caption and text; written back unless it is a dry run. The limit is the caller's."""
        own = self.list_figures(doc_id, project_id, False)
        own = own.where(views.missing_description(F.col("figure_description"))) if missing_only else own
        own = own if limit is None else own.orderBy("doc_id", "seq").limit(limit)
        said = settle(own.select("id", describe(F.coalesce("figure_caption", "text")).alias("description")).where("description is not null"), "described")
        if not dry_run:
            self.update_figure_descriptions(said)
        return said

    def infer_titles(self, infer, docs: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
        """(doc_id, title) by a UDF of a text model over the first page, with hints of the sidecar before it; null for unknown."""
        pages = views.first_page_text(self.chunks if docs is None else self.chunks.join(docs, "doc_id", "left_semi"))
        hint = lambda k, head: F.when(F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit("")) != "", F.concat(F.lit(head), F.try_element_at("attributes", F.lit(k))))
        hints = self.table("doc_metadata").select("doc_id", F.concat_ws("\n", hint("running_header", "Running page header (appears on every page): "), hint("pdf_meta_title", "PDF embedded title metadata: ")).alias("hints"))
        asked = pages.join(hints, "doc_id", "left").select("doc_id", F.concat_ws("\n\n", F.when(F.col("hints") != "", F.col("hints")), "text").alias("text"))
        found = settle(asked.select("doc_id", infer("text").alias("title")).where("title is not null and title <> ''"), "titles")
        if not dry_run:
            new = found.select("doc_id", F.col("title").alias("_t"))
            self._change("chunks", found, lambda c: c.join(F.broadcast(new), "doc_id", "left").withColumn("doc_title", F.coalesce("_t", "doc_title")).select(*c.columns))
            self.set_metadata(found.select("doc_id", F.create_map(F.lit("title_inferred"), F.lit("true")).alias("attributes")))
        return found

    # files, keys, audit

    def keep_pdf(self, content: bytes) -> str:
        return readers.keep_file(self.spark, content, self.files)

    def pdf_bytes(self, doc_id: str) -> bytes:
        return readers.file_bytes(self.spark, doc_id, self.files)

    def create_key(self, label: str, scopes: list[str]) -> str:
        row, token = control.new_key(self.spark, label, scopes)
        readers.write_table(readers.migrate(row, readers.KEYS), self.root, "api_keys", mode="append")
        return token

    def lookup_key(self, token: str) -> DataFrame:
        return control.lookup(self.table("api_keys"), token)

    def list_keys(self, include_revoked: bool = True) -> DataFrame:
        return control.listed(self.table("api_keys"), include_revoked)

    def revoke_key(self, key_id: str) -> bool:
        live = self.table("api_keys").where((F.col("id") == key_id) & F.col("revoked_at").isNull()).count()
        if live:
            readers.write_table(settle(control.revoked(self.table("api_keys"), key_id), "keys"), self.root, "api_keys")
        return bool(live)

    def record_audit(self, action: str, status: str, **values) -> None:
        number = (self.table("audit_log").agg(F.max("id")).first()[0] or 0) + 1
        readers.write_table(control.audit_row(self.spark, number, action, status, **values), self.root, "audit_log", mode="append")

    def list_audit(self, doc_id: str | None = None, since=None, limit: int = 200) -> DataFrame:
        return control.audit(self.table("audit_log"), doc_id, since, limit)

    def variant(self, root: str, name: str, embed: Callable | None = None, summaries: DataFrame | None = None, limit: int | None = None) -> Engine:
        """A copy of the store with vectors of another payload, or with other chapter texts (id, summary)."""
        other = Engine(self.spark, root, self.dim, embed or self.embed)
        other.create()
        own = self.chunks if limit is None else self.chunks.orderBy("doc_id", "seq").limit(limit)
        if summaries is not None:
            own = own.join(summaries, "id", "left").withColumn("text", F.coalesce("summary", "text")).drop("summary")
            own = graph.enrich(own.withColumn("idx", F.col("seq"))).select(*self.chunks.columns)
        vectors = own.withColumn("payload", views.payload(name)).where("payload <> ''").select(F.col("id").alias("chunk_id"), models.embedder(other.embed)("payload").alias("embedding"))
        other.upsert_chunks(own, vectors)
        return other
