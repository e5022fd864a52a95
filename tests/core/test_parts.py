"""The index, readers and writers, adapters, evaluation and views, on small invented inputs."""

import math

import pytest
from pyspark.sql import functions as F

from quire.functions import stem
from quire.operators import costs, evaluate, index, navigate, outline, tables, views
from quire.sources import adapters, config, readers


def test_stems():
    got = {w: stem.stem(w) for w in ("caresses", "ponies", "agreed", "hopping", "filing", "relational", "electricity", "adoption", "controlling", "frequencies", "sky", "at")}
    assert got == {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "filing": "file", "relational": "relat", "electricity": "electr", "adoption": "adopt", "controlling": "control", "frequencies": "frequenc", "sky": "sky", "at": "at"}
    assert stem.analyse("Übermäßig Naïve_cafés 3V3") == ["ubermaßig", "naiv", "cafe", "3v3"] and stem.analyse(None) == []


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    i = index.Index(spark, str(tmp_path_factory.mktemp("index")))
    rows = [("a", ["clock stretching", "the clock line is held"]), ("b", ["power", "clocked power_good pin"]), ("c", [None, "good power"]), ("d", None)]
    i.add(spark.createDataFrame(rows, "id string, texts array<string>"))
    return i


def ask(spark, i, words, **kw):
    return {r.id: r for r in i.search(spark.createDataFrame([(0, words)], "qid int, query string"), **kw).collect()}


def test_index_scores(spark, filled):
    got = ask(spark, filled, "clocks", coverage_exponent=0.0)
    n, df, avg = 4, 2, (6 + 5 + 2 + 0) / 4  # "the" and "is" count: only queries drop words
    avg = (2 + 5 + 1 + 4 + 0 + 2 + 0) / 4
    dl = {"a": 7, "b": 5}
    for k, tf in (("a", 2), ("b", 1)):
        want = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[k] / avg))
        assert math.isclose(got[k].score, want, rel_tol=1e-9), k
    assert set(ask(spark, filled, "power_good")) == {"b"} and set(ask(spark, filled, "power good")) == {"b", "c"}
    assert set(ask(spark, filled, "power", where=spark.createDataFrame([("c",)], "id string"))) == {"c"}
    assert ask(spark, filled, "nothing") == {} == ask(spark, filled, "the")


def test_index_changes(spark, filled, tmp_path):
    filled.add(spark.createDataFrame([("a", ["only new text"])], "id string, texts array<string>"))
    assert set(ask(spark, filled, "clock")) == {"b"} and set(ask(spark, filled, "new")) == {"a"}
    filled.remove(spark.createDataFrame([("b",)], "id string"))
    assert ask(spark, filled, "clock") == {}
    small = filled.compact(str(tmp_path / "small"))
    assert {k: round(r.score, 9) for k, r in ask(spark, small, "new power").items()} == {k: round(r.score, 9) for k, r in ask(spark, filled, "new power").items()}
    filled.add(spark.createDataFrame([("b", ["clock again"])], "id string, texts array<string>"))
    assert set(ask(spark, filled, "clock")) == {"b"}


def test_round_trips(spark, tmp_path):
    p = lambda x: str(tmp_path / x)
    docs = spark.createDataFrame([("d", "T", 3)], "doc_id string, title string, total_pages int")
    s = spark.createDataFrame([("d", 0, None, 0, 0, "A", 1, 2)], "doc_id string, section_id int, parent_id int, root_id int, level int, title string, page_start int, page_end int")
    e = spark.createDataFrame([("d", 0, 0, "text", "x", 1, "b", None)], "doc_id string, section_id int, ord int, element_type string, text string, page int, block_id string, caption string")
    readers.save_outline(docs, s, e, p("outline"))
    docs2, s2, e2 = readers.load_outline(spark, p("outline"))
    assert docs2.first().asDict() == {"doc_id": "d", "title": "T", "running_header": "", "pdf_meta_title": "", "total_pages": 3}
    assert s2.select(*s.columns).collect() == s.collect() and e2.select(*e.columns).collect() == e.collect()
    (tmp_path / "old_outline.json").write_text('{"doc_id": "old", "sections": [{"section_id": 0, "root_id": 0}]}')
    assert readers.load_outline(spark, p("old_outline.json"))[1].first().title == ""
    assert readers.layout_of(spark, str(tmp_path), "old")[0] == "outline"
    with pytest.raises(FileNotFoundError):
        readers.layout_of(spark, str(tmp_path), "none")
    c = spark.createDataFrame([("d:L2:0", "d", [1.0])], "id string, doc_id string, embedding array<float>")
    readers.save_graph(c, p("graph"))
    assert readers.load_graph(spark, p("graph")).first().id == "d:L2:0" and "embedding" not in readers.load_graph(spark, p("graph")).columns
    readers.save_manifest(spark.createDataFrame([("d", "b1")], "doc_id string, block_id string"), p("manifest"))
    assert readers.load_manifest(spark, p("manifest")).first().block_id == "b1"
    (tmp_path / "gold.jsonl").write_text('{"question": "q", "category": "c", "gold_pages": [1]}\n\n{"question": "r"}\n')
    gold = readers.read_golden(spark, p("gold.jsonl"))
    assert [(r.question, r.gold_pages) for r in gold.collect()] == [("q", [1]), ("r", None)]
    readers.write_golden(gold, p("gold2"))
    assert readers.read_golden(spark, p("gold2")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"question": "q"}\n{broken\n')
    with pytest.raises(Exception, match="line 2"):
        readers.read_golden(spark, p("bad.jsonl")).collect()


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x" * 120 + b"\fpage two")
    (tmp_path / "b.pdf").write_bytes(b"short")
    (tmp_path / "c.txt").write_bytes(b"no")
    files = readers.pdf_files(spark, str(tmp_path))
    assert [r.path[-5:] for r in files.collect()] == ["a.PDF", "b.pdf"]
    pages = adapters.over_files(files, adapters.plain_pages, adapters.PAGES)
    assert sorted(r.is_native for r in readers.native_pdf(pages).collect()) == [False, True]
    items = adapters.convert(files, lambda b: [{"ord": 0, "label": "text", "text": b.decode()[:5], "page": 1}], readers.native_pdf(pages))
    assert [r.text for r in items.collect()] == ["xxxxx"]

    def fails(content):
        if content == b"short":
            raise ValueError("too short")
        return []

    assert sorted((r.status, r.error) for r in adapters.attempted(files, fails).collect()) == [("failed", "ValueError: too short"), ("processed", None)]
    ocr = adapters.analyse(files, lambda b: b.decode()[:1], lambda job: "SUCCEEDED", lambda job, token: ([{"id": job + (token or "1"), "block_type": "LINE"}], None if token else "2"))
    assert sorted(r.id for r in ocr.collect()) == ["s1", "s2", "x1", "x2"]
    states = iter(["IN_PROGRESS", "SUCCEEDED"])
    assert adapters.poll(lambda: next(states), 0) == "SUCCEEDED"
    with pytest.raises(TimeoutError):
        adapters.poll(lambda: "IN_PROGRESS", 0, -1)
    with pytest.raises(RuntimeError):
        adapters.poll(lambda: "FAILED")


def test_config(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / config.NAME).write_text('project_id = "top"\nmpn = "m"\ntags = ["x", "y"]\n')
    (tmp_path / "a" / config.NAME).write_text("broken =")
    (deep / config.NAME).write_text('project_id = "deep"\ntags = ["y", "z"]\n')
    m = config.merge(config.find(deep))
    assert (m["project_id"], m["mpn"], m["group"], m["tags"]) == ("deep", "m", None, ["y", "z", "x"])
    assert [config.project(e, w, deep, "d") for e, w in (("own", True), (None, True), (None, False))] == ["own", None, "deep"] and config.merge([]) is None


def test_items(spark):
    rows = [("title", 0, "Guide", 1), ("page_header", 0, "Head", 1), ("text", 0, "Hello  there", 1), ("section_header", 2, "Deep", 1), ("section_header", 1, "Wide", 2), ("page_header", 0, "Head", 2), ("picture", 0, None, 2), ("caption", 0, "A valve", 2),
            ("caption", 0, "lost", 2), ("formula", 0, "", 2), ("table", 0, "Limits", 3), ("footnote", 0, "no", 3), ("title", 0, "Annex", 4), ("list_item", 0, "one", 4), ("text", 0, " ", 4)]
    items = spark.createDataFrame([("d", i, k, l, t, p) for i, (k, l, t, p) in enumerate(rows)], "doc_id string, ord int, label string, level int, text string, page int")
    rendered = spark.createDataFrame([("d", 10, "a | b", "garbled")], "doc_id string, ord int, text string, warning string")
    docs, s, e = outline.from_items(items, rendered)
    assert tuple(docs.first()) == ("d", "Guide", 4, "Head")
    assert [tuple(r) for r in s.orderBy("section_id").select("section_id", "parent_id", "root_id", "level", "title", "page_end").collect()] == [(0, None, 0, 0, "Guide", 1), (1, 0, 0, 2, "Deep", 1), (2, 0, 0, 1, "Wide", 3), (3, None, 3, 0, "Annex", 4)]
    assert [tuple(r) for r in e.orderBy("ord").select("section_id", "element_type", "text", "caption", "table_structure_warning").collect()] == [
        (0, "text", "Hello there", None, None), (2, "figure", "[Figure]", "A valve", None), (2, "formula", "[Formula]", None, None), (2, "table", "Limits\na | b", None, "garbled"), (3, "list", "one", None, None),
    ]
    boxes = items.withColumns({c: F.lit(0.1) for c in ("left", "top", "width", "height")})
    assert [(r.block_id, r.caption) for r in outline.item_regions(boxes).orderBy("ord").collect()] == [("figure_1", "A valve"), ("formula_1", "")]


def test_repairs(spark):
    cell = "table_id string, row int, col int, row_span int, col_span int, text string, is_header boolean, is_origin boolean"
    rows = [("t", r, c, 1, 1, f"h{c}" if r == 1 else f"value {r} {c}", r == 1, True) for r in range(1, 6) for c in (1, 2)]
    df = spark.createDataFrame(rows, cell)
    good = [("t", 1, 1, 1, 2, "Both")]
    cols = "table_id string, row int, col int, row_span int, col_span int, text string"
    out = tables.repaired(df, spark.createDataFrame(good, cols))
    assert [(r.col, r.text, r.is_origin) for r in out.where("row = 1").orderBy("col").collect()] == [(1, "Both", True), (2, "Both", False)] and out.where("repaired").count() == 10
    leaked = [("t", 1, 1, 1, 1, "value 2 1"), ("t", 1, 2, 1, 1, "value 3 2")]
    bands = tables.column_counts(df).select("table_id", "header_rows", "column_count")
    assert tables.validate_grid(spark.createDataFrame(leaked, cols), bands, df).first().reason == "repeats data"
    assert tables.repaired(df, spark.createDataFrame(leaked, cols)).where("repaired").count() == 0


def test_evaluation(spark, tmp_path):
    n = None
    chunks = spark.createDataFrame([("a", "x", "alpha words", 1, [1], n, n, "b"), ("b", "x", "beta words", 2, [2], "a", "a", n), ("c", "y", "gamma words", 2, [1], n, n, n)], "id string, doc_id string, text string, level int, page_numbers array<int>, parent_id string, prev_id string, next_id string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    gold = spark.createDataFrame([(0, "gamma", [1.0, 0.0], "k1", "x", ["b"], [1]), (1, "nothing here", [0.0, 1.0], "k2", "y", ["c"], [1])], "qid int, query string, embedding array<float>, category string, doc_id string, gold_chunk_ids array<string>, gold_pages array<int>")
    scored, report = evaluate.run_eval(vectors, chunks, gold, evaluate.Config(mode="vector", k=2, ks=(1, 2)), str(tmp_path / "trace"))
    got = {r.qid: r for r in scored.collect()}
    assert (got[0].rr, got[0].hit_1, got[0].loose_1, got[0].num_retrieved, got[0].first_relevant_rank) == (1.0, 1, 1, 2, 1) and got[1].rr == 1.0
    assert spark.read.json(str(tmp_path / "trace")).count() == 2
    scored, report = evaluate.run_eval(vectors, chunks, gold, evaluate.Config(mode="keyword", ks=(1,)))
    got = {r.qid: r for r in scored.collect()}
    assert got[0].num_retrieved == 1 and got[0].rr == 0.0 and got[1].num_retrieved == 0  # a question without results counts
    assert {r.category: r.n for r in report.collect()} == {"k1": 1, "k2": 1, "overall": 2}
    assert evaluate.run_matrix(vectors, chunks, gold, evaluate.standard()).select("config").distinct().count() == 8
    assert [(r.id, r.hit) for r in evaluate.preview(vectors, chunks, gold, 1).orderBy("qid").collect()] == [("c", False), ("c", True)]  # found by both searches
    answers = spark.createDataFrame([("a", " Why? ", True, "n"), ("b", "x", False, ""), ("c", " ", True, "")], "id string, question string, answerable boolean, answer_notes string")
    made = evaluate.build_golden(chunks.withColumn("category", F.lit("k")), answers)
    assert [(r.question, r.gold_chunk_ids, r.source) for r in made.collect()] == [("Why?", ["a"], "auto")]


def test_views(spark):
    gold = spark.createDataFrame([("q1", "c", "auto"), ("q2", "c", "human")], "question string, category string, source string")
    patch = spark.createDataFrame([("q1", None, "human")], "question string, category string, source string")
    assert sorted(tuple(r) for r in views.apply_update(gold, patch).collect()) == [("q1", "c", "human"), ("q2", "c", "human")]
    assert tuple(views.review_summary(gold).first()) == (2, 1)
    links = spark.createDataFrame([("a", "p", 0.5), ("b", "p", 0.9), ("a", "q", 0.7)], "chunk_id string, concept_id string, relevance double")
    assert [r.concept_id for r in views.concepts_of(links, "a").collect()] == ["q", "p"] and [r.chunk_id for r in views.chunks_of(links, "p").collect()] == ["b", "a"]
    assert sorted(tuple(r) for r in views.related(links).collect()) == [("a", "b"), ("b", "a")]
    ids = spark.range(50).select(F.col("id").cast("string").alias("id"))
    one, two = ([r.id for r in views.seeded(ids, "id", 9, s).collect()] for s in (1, 1))
    assert one == two != [r.id for r in views.seeded(ids, "id", 9, 2).collect()] and len(set(one)) == 9
    with pytest.raises(Exception, match="not a chunk id"):
        spark.range(1).select(views.split_id(F.lit("plain"))).collect()
    with pytest.raises(ValueError):
        views.payload("other")
    old = spark.createDataFrame([("x", "T", None, None, "[1, 2]", "text", None)], "id string, doc_title string, chapter_title string, section_title string, page_numbers string, layout_type string, metadata_json string")
    assert tuple(views.unpacked(old).select("doc_title", "page_numbers").first()) == ("T", [1, 2])
    d = spark.createDataFrame([("d", "x" * 8, "", "figure")], "doc_id string, text string, context_text string, layout_type string")
    items = {r.label: r for r in costs.estimate(d, spark.createDataFrame([("d", 5)], "doc_id string, total_pages int"), ocr=True).collect()}
    assert items["pages"].usd == 5 * 0.004 and items["embeddings"].amount == 2.0 and items["figures"].amount == 1.0


def test_descendants_of_a_cycle(spark):
    c = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "id string, parent_id string")
    assert sorted(tuple(r)[:2] for r in navigate.ancestors(c.select("id"), c, 4).collect()) == [("a", "b"), ("b", "a"), ("c", "a"), ("c", "b")]
    assert sorted(tuple(r)[:2] for r in navigate.descendants(c.select("id").where("id = 'b'"), c, 4).collect()) == [("b", "a"), ("b", "c")]
