"""Sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = (
    "id string, doc_id string, level int, text string, context_text string, token_count int, page_numbers array<int>, layout_type string, doc_title string, chapter_title string, section_title string, "
    "parent_id string, prev_id string, next_id string, chapter_root_id string, figure_image_path string, figure_s3_key string, figure_caption string, figure_description string, "
    "project_id string, group_name string, created_at timestamp, seq bigint"
)
VECTORS = "chunk_id string, embedding array<float>"
METADATA = "doc_id string, project_id string, group_name string, mpn string, manufacturer string, subsystem string, doc_type string, tags array<string>, attributes map<string,string>, updated_at timestamp"
GOLDEN = "question string, category string, doc_id string, gold_chunk_ids array<string>, gold_pages array<int>, answer_notes string, source string"
BLOCKS = (
    "doc_id string, id string, block_type string, page int, text string, left double, top double, width double, height double, relationships array<struct<type:string,ids:array<string>>>, "
    "row_index int, column_index int, row_span int, col_span int, entity_types array<string>"
)
KEYS = "id string, label string, token_sha256 string, scopes array<string>, created_at timestamp, revoked_at timestamp"
OUTLINE = "title string, doc_id string, total_pages int, running_header string, pdf_meta_title string, sections array<struct<section_id:int,parent_id:int,root_id:int,level:int,title:string,page_start:int,page_end:int>>, elements array<struct<section_id:int,ord:int,element_type:string,text:string,page:int,block_id:string,caption:string>>"
MANIFEST = "doc_id string, block_id string, page int, caption string, section_header string, preceding_text string, image_path string, s3_key string, width_px int, height_px int"
AUDIT = "id bigint, ts timestamp, key_label string, client_ip string, action string, doc_id string, project_id string, detail_json string, status string, error string"
TABLES = {"chunks": CHUNKS, "chunk_vecs": VECTORS, "doc_metadata": METADATA, "audit_log": AUDIT, "api_keys": KEYS}
#: Version of the store's tables; readers accept older ones, whose missing columns are null.
VERSION = 2
#: Parts that the tables of documents are dealt to, so that a change rewrites a part and not the table.
PARTS = 64


def document_of(chunk_id: str) -> Column:
    """The document's part of a chunk id, read from the right."""
    return F.regexp_replace(chunk_id, r":L?\d+:\d+$", "")


def part_of(name: str) -> Column | None:
    """The part that a row of a table is in; null for tables that are only appended to or small."""
    doc = {"chunks": F.col("doc_id"), "doc_metadata": F.col("doc_id"), "chunk_vecs": document_of("chunk_id")}.get(name)
    return None if doc is None else F.pmod(F.xxhash64(doc), F.lit(PARTS)).cast("int")


def read_table(spark: SparkSession, root: str, name: str, parts: list[int] | None = None) -> DataFrame:
    """A store table, or the named parts of it; columns that older files lack are null."""
    if part_of(name) is None:
        return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
    whole = spark.read.schema(f"{TABLES[name]}, part int").parquet(f"{root}/{name}")
    return (whole if parts is None else whole.where(F.col("part").isin(parts))).drop("part")


def write_table(df: DataFrame, root: str, name: str, dim: int | None = None, mode: str = "overwrite") -> None:
    """Write a store table, or with parts only those that have rows; vectors of another dimension are an error."""
    if name == "chunk_vecs" and dim is not None:
        bad = F.raise_error(F.concat(F.lit(f"embedding dimension is not {dim}: "), F.size("embedding").cast("string")))
        df = df.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(bad.cast("array<float>")))
    part = part_of(name)
    if part is None:
        df.write.mode(mode).parquet(f"{root}/{name}")
    else:
        df.withColumn("part", part).repartition("part").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{root}/{name}")


def check_store(spark: SparkSession, root: str, dim: int) -> None:
    """Open a store of this dimension, or make its version record; another dimension or a newer version is an error."""
    path = f"{root}/schema_version"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(dim).alias("dim")).write.parquet(path)
        return
    found = spark.read.schema("version int, dim int").parquet(path).first()
    if found.dim != dim:
        raise ValueError(f"the store has vectors of {found.dim}, not {dim}")
    if found.version > VERSION:
        raise ValueError(f"the store has version {found.version}, this reads up to {VERSION}")


def migrate(old: DataFrame, schema: str) -> DataFrame:
    """Rows of an older version under a newer schema; new columns are null."""
    empty = old.sparkSession.createDataFrame([], schema)
    return empty.unionByName(old, allowMissingColumns=True).select(*empty.columns)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line is an error that names its number in its file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where(F.trim("line") != "")
    row = F.from_json("line", f"{GOLDEN}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = F.raise_error(F.concat(F.lit("line "), (F.col("n") + 1).cast("string"), F.lit(" is not a golden item"))).cast("string")
    rows = lines.select("n", row.alias("r")).select("n", F.when(F.col("r._bad").isNotNull() | F.col("r.question").isNull(), bad).otherwise(F.col("r.question")).alias("question"), *(f"r.{c.split()[0]}" for c in GOLDEN.split(", ")[1:]))
    return rows.drop("n")


def write_golden(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report or a matrix of reports as JSON lines in one file; reports are a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_graph(chunks: DataFrame, path: str) -> None:
    """A chunk graph as JSON, without vectors."""
    chunks.drop("embedding").write.mode("overwrite").json(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def save_outline(documents: DataFrame, sections: DataFrame, elements: DataFrame, path: str) -> None:
    """Outlines as JSON, one object a document."""
    rows = lambda df, names: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias(names[0] + "s"))
    s = rows(sections, ["section_id", "parent_id", "root_id", "level", "title", "page_start", "page_end"]).withColumnRenamed("section_ids", "sections")
    e = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_id", "ord", "element_type", "text", "page", "block_id", "caption"))).alias("elements"))
    documents.join(s, "doc_id", "left").join(e, "doc_id", "left").write.mode("overwrite").json(path)


def load_outline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sections, elements); missing keys get their defaults."""
    own = spark.read.schema(OUTLINE).json(path)
    none = lambda t: F.lit(None).cast(t)
    docs = own.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "running_header", "pdf_meta_title")), F.coalesce("total_pages", F.lit(0)).alias("total_pages"))
    sections = own.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*").fillna({"title": "", "level": 0, "page_start": 0, "page_end": 0})
    elements = own.select("doc_id", F.explode("elements").alias("e")).select("doc_id", "e.*").fillna({"text": "", "page": 1, "block_id": "", "element_type": "text"})
    return docs, sections, elements.withColumns({"width_px": none("int"), "height_px": none("int")})


def save_blocks(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").json(path)


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks saved as JSON lines."""
    return spark.read.schema(BLOCKS).json(path)


def save_manifest(figures: DataFrame, path: str) -> None:
    migrate(figures, MANIFEST).write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def layout_of(spark: SparkSession, folder: str, doc_id: str) -> tuple[str, DataFrame]:
    """('outline', rows) if an outline of the document is cached in a folder, else ('blocks', rows); neither is an error."""
    for kind, schema in (("outline", OUTLINE), ("blocks", BLOCKS)):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{doc_id}_{kind}.json")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return kind, spark.read.schema(schema).json(path.toString())
    raise FileNotFoundError(f"no layout of {doc_id} in {folder}")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).option("multiLine", True).json(path)


def pdf_files(spark: SparkSession, root: str) -> DataFrame:
    """PDF files below a folder with their content's SHA-256 as doc_id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower("path").rlike(r"\.pdf$")).select("path", "length", F.sha2("content", 256).alias("doc_id"), "content").orderBy("path")


def keep_file(spark: SparkSession, content: bytes, root: str) -> str:
    """Write a file once under its content's SHA-256 to any store that Spark reaches; its id."""
    import hashlib

    name = hashlib.sha256(content).hexdigest()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.pdf")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
    return name


def file_bytes(spark: SparkSession, name: str, *roots: str) -> bytes:
    """The file of an id from the first of several places that has it."""
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.pdf")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return bytes(spark.read.format("binaryFile").load(path.toString()).select("content").first().content)
    raise FileNotFoundError(name)


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, length) of the files kept below a place, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("doc_id"), "path", "length").where("doc_id <> ''").orderBy("path")


def purge(spark: SparkSession, root: str, name: str) -> bool:
    """Delete a kept file; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.pdf")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False))


def native_pdf(pages: DataFrame, sample: int = 5, least: int = 100) -> DataFrame:
    """(doc_id, page, text): documents whose first pages have over ``least`` characters."""
    return pages.where(F.col("page") <= sample).groupBy("doc_id").agg((F.sum(F.length(F.trim("text"))) > least).alias("is_native"))
