"""The store behind the engine, the stream, and the model boundary."""

import pytest
from pyspark.sql import functions as F

from quire.functions import models
from quire.operators import chunking, search
from quire.plans.engine import Engine
from quire.sources import readers
from quire.streaming import ingest


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), 8)
    e.create()
    text = ["I2C interface overview", "SCL held low, clock stretching", "ESD HBM rating", "dropout voltage curve", "quiescent current", "buck converter reference design", "switching frequency via FSEL", "thermal shutdown at 150 C"]
    ids = ["doc1:0:0", "doc1:2:0", "doc1:2:1", "doc1:2:2", "doc1:2:3", "doc2:0:0", "doc2:2:0", "doc2:2:1"]
    rows = [(i, i.split(":")[0], int(i.split(":")[1]), t, t, s, None if i.split(":")[1] == "0" else i.split(":")[0] + ":0:0", "Doc") for s, (i, t) in enumerate(zip(ids, text))]
    c = spark.createDataFrame(rows, "id string, doc_id string, level int, text string, context_text string, seq long, parent_id string, doc_title string")
    v = spark.createDataFrame([(i, [1.0 if j == s else 0.0 for j in range(8)]) for s, i in enumerate(ids)], readers.VECTORS)
    assert e.upsert_chunks(readers.migrate(c, readers.CHUNKS), v) == 8
    return e


def ask(spark, words, at):
    return spark.createDataFrame([(0, words, [1.0 if j == at else 0.0 for j in range(8)])], "qid int, query string, embedding array<float>")


def test_search(spark, engine):
    assert engine.search(ask(spark, "x", 2), "vector", 1).first().id == "doc1:2:1"
    assert engine.search(ask(spark, "clock stretching", 0), "keyword", 1).first().id == "doc1:2:0"
    assert engine.search(ask(spark, "clock stretching", 1), "hybrid", 3).orderBy("rank").first().id == "doc1:2:0"
    assert {r.doc_id for r in engine.search(ask(spark, "x", 2), "vector", 9, search.chunk_filter(doc_ids=["doc2"])).collect()} == {"doc2"}
    with pytest.raises(ValueError):
        engine.search(ask(spark, " ", 1), "hybrid")


def test_store(spark, engine):
    assert [r.id for r in engine.get_children("doc2:0:0").collect()] == ["doc2:2:0", "doc2:2:1"]
    assert engine.resolve_doc_id("doc2") == "doc2"
    with pytest.raises(ValueError):
        engine.resolve_doc_id("doc")
    blank = engine.get_chunk("doc1:0:0").withColumn("doc_title", F.lit(""))
    engine.upsert_chunks(blank)
    assert engine.get_chunk("doc1:0:0").first().doc_title == "Doc"
    engine.delete_doc("doc1")
    assert engine.chunks.count() == 3 and engine.table("chunk_vecs").count() == 3
    wrong = spark.createDataFrame([("x", [1.0])], readers.VECTORS)
    with pytest.raises(Exception, match="dimension"):
        readers.write_table(wrong, engine.root, "chunk_vecs", 8)


def test_stream(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    docs.where("doc_id < 100").write.parquet(src)
    ingest.ingest_stream(spark, src, docs.schema, out, check)
    docs.write.mode("append").parquet(src)
    ingest.ingest_stream(spark, src, docs.schema, out, check)
    got = spark.read.parquet(out)
    assert got.select("id").distinct().count() == got.count() == chunking.micro_chunks(ingest.elements_of(docs)).count()


def test_embedder(spark):
    run = models.embedder(models.hashing(4))
    df = spark.createDataFrame([("a b",), ("c",)], "t string").select(run("t").alias("v"))
    assert [len(r.v) for r in df.collect()] == [4, 4]
    with pytest.raises(Exception, match="empty"):
        spark.createDataFrame([("",)], "t string").select(run("t")).collect()


def chunk_rows(spark, rows):
    """(id, text, parent, layout) as chunks of the document before the id's first colon."""
    return spark.createDataFrame([(i, i.split(":")[0], int(i.split(":")[1][1:]), t, f"Section > {t}", s, p, k, [1 + s // 2], "Doc") for s, (i, t, p, k) in enumerate(rows)], "id string, doc_id string, level int, text string, context_text string, seq long, parent_id string, layout_type string, page_numbers array<int>, doc_title string")


@pytest.fixture(scope="module")
def backend(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("backend")), 4, models.hashing(4))
    e.create()
    a = [("a:L0:0", "", None, "mixed"), ("a:L2:0", "Frequencies of the café oscillator", "a:L1:0", "text"), ("a:L2:1", "[Figure]", "a:L1:0", "figure"), ("a:L1:0", "Frequencies of the oscillator", "a:L0:0", "text")]
    b = [("b:L2:0", "Pin SERCOM3_PAD3 is an output", None, "text"), ("b:L2:1", "PAD3 then SERCOM3", None, "text")]
    out = {r.doc_id: r.status for r in e.ingest(chunk_rows(spark, a).unionByName(chunk_rows(spark, b)), project_id="p1").collect()}
    assert out == {"a": "processed", "b": "processed"}
    return e


def test_backend_reads(spark, backend):
    e = backend
    assert e.count_chunks() == 6 and e.count_chunks(doc_id="a", project_id="p1") == 4 and e.count_chunks(project_id="no") == 0
    assert {r.doc_id: r.title for r in e.get_doc_titles().collect()} == {"a": "Doc", "b": "Doc"}
    assert [(r.doc_id, r.n_chunks, r.page_count) for r in e.get_ingested_docs("p1").orderBy("doc_id").collect()] == [("a", 4, 2), ("b", 2, 1)]
    ask = lambda q: e.search(spark.createDataFrame([(0, q)], "qid int, query string"), "keyword", 5).orderBy("rank")
    assert {r.id for r in ask("frequency").collect()} == {"a:L2:0", "a:L1:0"}  # stems
    assert ask("cafe").first().id == "a:L2:0"  # folded
    assert [r.id for r in ask("sercom3_pad3").collect()] == ["b:L2:0"]  # a phrase
    got = e.results(spark.createDataFrame([(0, "oscillator frequency")], "qid int, query string"), "hybrid", 2).collect()
    assert [r.rank for r in got] == [1, 2] and {r.level for r in got} <= {"MESO", "MICRO"}
    n = e.neighbours(spark.createDataFrame([("a:L2:0",)], "id string")).first()
    assert n.parent.id == "a:L1:0" and n.prev is None


def test_backend_writes(spark, backend):
    e = backend
    again = chunk_rows(spark, [("b:L2:0", "New words only", None, "text")])
    assert [tuple(r) for r in e.ingest(again).collect()] == [("b", "skipped")]
    assert [tuple(r) for r in e.ingest(again, force=True).collect()] == [("b", "processed")]
    assert e.count_chunks(doc_id="b") == 1 and e.table("chunk_vecs").where("chunk_id like 'b:%'").count() == 1
    assert e.search(spark.createDataFrame([(0, "sercom3")], "qid int, query string"), "keyword").count() == 0
    with pytest.raises(ValueError, match="more than one"):
        e.upsert_chunks(again.unionByName(again))
    assert e.set_doc_title("b", "Other") == 1 and e.get_chunk("b:L2:0").first().doc_title == "Other"
    row = lambda **v: spark.range(1).select(*(F.lit(x).alias(k) for k, x in v.items()), F.create_map(F.lit("running_header"), F.lit("Head")).alias("attributes"))
    e.set_metadata(row(doc_id="a", project_id="p2", group_name="g", mpn="X1, Y2", manufacturer="M"))
    assert e.apply_metadata("a") == 1 and e.get_chunk("a:L2:0").first().project_id == "p2"
    assert [r.doc_id for r in e.list_documents(mpn="Y2", manufacturer="M").collect()] == ["a"] and e.list_docs(mpn="Y").count() == 0
    assert e.get_metadata("a").first().doc_title == "Doc"
    e.mark_stale("a")
    assert e.get_metadata("a").first().attributes == {"running_header": "Head", "needs_reembed": "true"}
    e.mark_stale("a", False)
    assert e.get_metadata("a").first().attributes == {"running_header": "Head"}
    said = models.text_model(lambda t: f"drawing of {t}")
    assert [tuple(r) for r in e.describe_figures(said, dry_run=True).collect()] == [("a:L2:1", "drawing of [Figure]")]
    assert e.describe_figures(said).count() == 1 and e.get_chunk("a:L2:1").first().context_text.endswith("Description: drawing of [Figure]") and e.describe_figures(said).count() == 0
    assert [tuple(r) for r in e.infer_titles(models.text_model(lambda t: t.split("\n")[0][-4:]), spark.createDataFrame([("a",)], "doc_id string")).collect()] == [("a", "Head")]
    assert e.get_metadata("a").first().attributes["title_inferred"] == "true" and e.get_chunk("a:L0:0").first().doc_title == "Head"
    assert e.infer_titles(models.text_model(lambda t: "unknown")).count() == 0
    e.delete_metadata("a")
    assert e.get_metadata("a").count() == 0
    v = e.variant(e.root + "-raw", "raw_text")
    assert v.table("chunk_vecs").count() == 5  # a chapter without text has its context
    assert e.delete_doc("a") == 4 and e.count_chunks() == 1


def test_backend_files_keys_audit(spark, backend):
    e = backend
    name = e.keep_pdf(b"%PDF-1")
    assert e.keep_pdf(b"%PDF-1") == name and e.pdf_bytes(name) == b"%PDF-1"
    assert [r.doc_id for r in readers.stored_files(spark, e.files).collect()] == [name] and readers.purge(spark, e.files, name)
    with pytest.raises(FileNotFoundError):
        e.pdf_bytes(name)
    token = e.create_key("ci", ["read"])
    key = e.lookup_key(token).first()
    assert key.scopes == ["read"] and token not in str(key) and e.lookup_key("x").count() == 0
    assert e.revoke_key(key.id) and not e.revoke_key(key.id) and e.lookup_key(token).count() == 0
    assert e.list_keys().count() == 1 and e.list_keys(False).count() == 0
    e.record_audit("ingest", "ok", doc_id="a", detail={"n": 1})
    e.record_audit("delete", "failed", doc_id="b", error="x")
    assert [(r.id, r.action, r.detail_json) for r in e.list_audit().collect()] == [(2, "delete", None), (1, "ingest", '{"n":"1"}')]
    assert e.list_audit(doc_id="a").count() == 1 and e.list_audit(since="2999-01-01").count() == 0
    with pytest.raises(ValueError, match="vectors"):
        Engine(spark, e.root, 8).create()


def test_stream_replaces_forced_documents(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    d = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    d([(1, "One. Two."), (2, "Keep."), (3, " ")]).write.parquet(src)
    with ingest.Progress(spark, lambda *x: seen.append(x)):
        ingest.ingest_stream(spark, src, "doc_id long, text string", out, check)
    d([(1, "Other.\nText.")]).write.mode("append").parquet(src)
    ingest.ingest_stream(spark, src, "doc_id long, text string", out, check, force=True)
    assert sorted((r.id, r.text) for r in spark.read.parquet(out).collect()) == [("1:L2:0", "Other."), ("1:L2:1", "Text."), ("2:L2:0", "Keep.")]
    assert [(r.doc_id, r.reason) for r in spark.read.json(out + "-failed").select("doc_id", "reason").collect()] == [("3", "no text")]
    assert seen


def test_models():
    assert models.get_embedder("hashing", 8)(["a b"])[0]
    for bad in (lambda: models.get_embedder("none", 8), lambda: models.checked(lambda t: [[1.0]], 2)(["a"]), lambda: models.checked(lambda t: [[float("nan")]], 1)(["a"]), lambda: models.cloud_embedder(None, 300)):
        with pytest.raises(ValueError):
            bad()
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ConnectionError
        return x

    assert models.retrying(flaky, 4, (0.0, 0.0))(5) == 5 and len(calls) == 3
    assert models.cloud_embedder(lambda p: {"embedding": [len(p["inputText"])] * p["dimensions"]}, 256)(["abc"])[0][:2] == [3, 3]
