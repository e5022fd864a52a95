"""Operators on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import chunking, evaluate, navigate, search, store, tables


def test_split_text(spark):
    """No word is lost, no piece is over the budget unless it is one word, and no two neighbours of one kind would fit together."""
    size = lambda x: max(1, len(x) // 4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", text.split_text(F.col("text")).alias("p")).collect()
    for r in docs:
        assert " ".join(r.p).split() == r.text.split()
        if size(r.text.strip()) <= 128:
            assert list(r.p) == ([r.text.strip()] if r.text.strip() else [])
        for p in r.p:
            # A piece is packed of sentences, or of words of a sentence that is over the budget by itself.
            ends = [e + 1 for e in range(len(p)) if p[e] in ".!?" and e + 1 < len(p) and p[e + 1] == " "]
            sentences = [p[a:z].strip() for a, z in zip([0, *ends], [*ends, len(p)])]
            assert sum(map(size, sentences)) <= 128 or sum(map(size, p.split())) <= 128 or len(p.split()) == 1
    cases = {"Aa bb. Cc dd. Ee ff.": ["Aa bb. Cc dd.", "Ee ff."], "one two three four five": ["one two", "three four", "five"], "Hi. one two three. Yo.": ["Hi.", "one two", "three.", "Yo."], "": [], "  x  ": ["x"]}
    out = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.split_text(F.col("s"), 2).alias("p")).collect()
    assert {r.s: list(r.p) for r in out} == cases


def test_digest_and_truncate(spark):
    rows = [("One. Two two two. Three three three.",), ("x" * 30 + " " + "y" * 30,), ("short",), ("",)]
    out = [r[0] for r in spark.createDataFrame(rows, "s string").select(text.digest(F.col("s"), 20)).collect()]
    assert out == ["One. Two two two.", "x" * 20 + "…", "short", ""]
    cut = spark.createDataFrame([("alpha beta gamma",)], "s string").select(text.truncate(F.col("s"), 12)).first()[0]
    assert cut == "alpha beta…"


def test_meso_budget(spark):
    rows = [("d", 0, i, t, "table" if a else "text", f"t{i}") for i, (t, a) in enumerate([(300, 0), (200, 0), (100, 0), (200, 1), (400, 0)])]
    m = spark.createDataFrame(rows, "doc_id string, section int, idx int, token_count int, layout_type string, text string").withColumn("page_numbers", F.array(F.lit(1))).withColumn("id", F.col("text"))
    got = {r.idx: r.grp for r in chunking.meso_groups(m).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_micro_rules(spark):
    rows = [("d", 0, 0, "figure", None, 1, "cap", 500, 100), ("d", 0, 1, "figure", None, 1, None, 100, 100), ("d", 0, 2, "formula", "x", 1, None, None, None), ("d", 0, 3, "figure", None, 2, "", None, None), ("d", 0, 4, "text", "Hello.", 2, None, None, None)]
    e = spark.createDataFrame(rows, "doc_id string, section int, ord int, element_type string, text string, page int, caption string, width_px int, height_px int")
    assert [r.text for r in chunking.micro_chunks(e).orderBy("idx").collect()] == ["cap", "[Figure]", "Hello."]


def test_navigation_and_lineage(spark):
    g = spark.createDataFrame([("M", None, None, None), ("S", "M", None, None), ("a", "S", None, "b"), ("b", "S", "a", "c"), ("c", "S", "b", None), ("z", "S2", None, None)], "id string, parent_id string, prev_id string, next_id string")
    rel = lambda i: {r.id for r in navigate.lineage(spark.createDataFrame([("q", i)], "item string, id string"), g).collect()}
    assert rel("a") == {"a", "S", "M", "b"}
    assert rel("S") == {"S", "M", "a", "b", "c"}
    assert {r.to for r in navigate.siblings(spark.createDataFrame([("a",)], "id string"), g).collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        navigate.navigate(g, g, "sideways")


def test_metrics(spark):
    rows = [("q1", i + 1, h) for i, h in enumerate([False, False, True, False])] + [("q2", 1, True), ("q2", 2, False)] + [("q3", 1, False)]
    o = {r.qid: r for r in evaluate.outcomes(spark.createDataFrame(rows, "qid string, rank int, hit boolean"), ks=(1, 3), ndcg_k=3).collect()}
    assert (o["q1"].hit_1, o["q1"].hit_3, round(o["q1"].rr, 6)) == (0, 1, round(1 / 3, 6)) and 0 < o["q1"].ndcg < 1
    assert o["q2"].ndcg == 1.0 and (o["q3"].rr, o["q3"].ndcg) == (0.0, 0.0)


def test_upsert_and_metadata(spark):
    s = "doc_id string, title string, note string"
    old, new = spark.createDataFrame([("a", "Old", "n"), ("b", "B", None)], s), spark.createDataFrame([("a", "", None), ("c", "C", "x")], s)
    got = {r.doc_id: (r.title, r.note) for r in store.upsert(old, new, "doc_id", ("title",), ("note",)).collect()}
    assert got == {"a": ("Old", "n"), "b": ("B", None), "c": ("C", "x")}
    m = "doc_id string, mpn string, tags array<string>, attributes map<string,string>"
    have = spark.createDataFrame([("a", "M1", ["x"], {"revision": "B", "notes": "draft"})], m)
    patch = spark.createDataFrame([("a", None, None, {"revision": "C", "notes": None, "extra": "yes"})], m)
    r = store.set_metadata(have, patch).first()
    assert (r.mpn, r.tags, r.attributes) == ("M1", ["x"], {"revision": "C", "extra": "yes"})


def test_tables(spark):
    head = lambda t, *texts: [(t, 1, k + 1, 1, 1, x, True, None) for k, x in enumerate(texts)]
    body = lambda t, *texts: [(t, 2, k + 1, 1, 1, x, False, True) for k, x in enumerate(texts)]
    rows = head("same", *["Range of flow"] * 3) + body("same", "1", "2", "3") + head("brief", *["Flow"] * 3) + body("brief", "1", "2", "3")
    rows += head("leaked", "Valve 7", "Brass", "x") + body("leaked", "valve 7", "BRASS", "x") + head("one", "Valve 7", "Brass") + body("one", "valve 7", "Steel")
    cells = spark.createDataFrame(rows, "table_id string, row int, col int, row_span int, col_span int, text string, is_header boolean, is_origin boolean")
    reasons = {r.table_id: r for r in tables.untrustworthy(cells).collect()}
    assert reasons["same"].garbled == "Range of flow" and reasons["leaked"].fused == "brass, valve 7"
    assert all(reasons[k].reason is None for k in ("brief", "one"))
    bands = spark.createDataFrame([(t, 1, 2) for t in ("ok", "gap", "lap", "out", "neg")], "table_id string, header_rows int, column_count int")
    p = spark.createDataFrame([("ok", 1, 1, 1, 2, "a"), ("gap", 1, 1, 1, 1, "a"), ("lap", 1, 1, 1, 2, "a"), ("lap", 1, 2, 1, 1, "b"), ("out", 1, 1, 2, 2, "a"), ("neg", 1, 1, 0, 2, "a")], "table_id string, row int, col int, row_span int, col_span int, text string")
    assert {r.table_id: r.reason for r in tables.validate_grid(p, bands).collect()} == {"ok": None, "gap": "gap", "lap": "overlap", "out": "outside band", "neg": "non-positive cell"}


def test_vector_filters(spark):
    one = lambda i: [1.0 if j == i else 0.0 for j in range(8)]
    s = spark.createDataFrame([(i, one(i), i % 2) for i in range(8)], "id int, embedding array<float>, odd int")
    q = spark.createDataFrame([(0, one(2))], "qid int, embedding array<float>")
    assert search.vector_search(s, q, 1).first().id == 2
    assert {r.id for r in search.vector_search(s, q, 9, where=F.col("odd") == 1).collect()} == {1, 3, 5, 7}
    assert search.keyword_search(spark.createDataFrame([(1, "SCL held low, clock stretching")], "id int, text string"), spark.createDataFrame([(0, "clock stretching"), (1, "  ")], "qid int, query string"), 5).collect()[0].id == 1
