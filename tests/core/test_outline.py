"""Outlines from blocks, the clean-up chain, boxes, and the chunk run, on small invented documents."""

import pytest
from pyspark.sql import functions as F

from quire.operators import graph, outline
from quire.sources import readers

WORDS = {}


def block(id, kind, page=1, text=None, kids=(), top=0.0, left=0.0, height=0.02, **more):
    rel = [("CHILD", list(kids))] if kids else []
    return dict({"doc_id": "d", "id": id, "block_type": kind, "page": page, "text": text, "left": left, "top": top, "width": 0.5, "height": height, "relationships": rel, "row_index": None, "column_index": None, "row_span": None, "col_span": None, "entity_types": None}, **more)


def cell(id, row, col, text, header=False, **more):
    return [block(id, "CELL", kids=[id + "w"], row_index=row, column_index=col, row_span=1, col_span=1, entity_types=["COLUMN_HEADER"] if header else [], **more), block(id + "w", "WORD", text=text)]


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [
        block("p1", "PAGE", kids=["l1", "w1", "l2", "l3", "l4"]), block("p2", "PAGE", 2, kids=["l6", "l7", "l8"]),
        block("l1", "LAYOUT_TITLE", kids=["w1"]), block("w1", "LINE", text=" Pump Manual "),
        block("l2", "LAYOUT_TEXT", kids=["w2", "w3"], top=0.2), block("w2", "LINE", text="Turn it on."), block("w3", "LINE", text="Wait."),
        block("l3", "LAYOUT_SECTION_HEADER", kids=["w4"], top=0.3), block("w4", "LINE", text="Setup"),
        block("l4", "LAYOUT_LIST", kids=["l5"], top=0.4), block("l5", "LAYOUT_TEXT", kids=["w5"], top=0.4), block("w5", "LINE", text="one two"),
        block("l0", "LAYOUT_FOOTER", kids=["w0"], top=0.9), block("w0", "LINE", text="page 1"), block("lx", "LAYOUT_TEXT", top=0.5),
        block("l6", "LAYOUT_FIGURE", 2, top=0.1, height=0.2), block("l7", "LAYOUT_TEXT", 2, kids=["w7"], top=0.32), block("w7", "LINE", 2, text="Figure 1: valve"),
        block("l8", "LAYOUT_TABLE", 2, kids=["t1", "tt"], top=0.6), block("tt", "TABLE_TITLE", 2, kids=["w8"]), block("w8", "LINE", 2, text="Limits"),
        block("t1", "TABLE", 2, kids=["c1", "c2", "c3", "c4"]), *cell("c1", 1, 1, "Name", True), *cell("c2", 1, 2, "Max", True), *cell("c3", 2, 1, "flow"), *cell("c4", 2, 2, "9"),
        {**block("e1", "LAYOUT_TEXT", text="No heading here."), "doc_id": "e"},
    ]
    return spark.createDataFrame(rows, readers.BLOCKS)


def test_reading_order(blocks):
    got = [r.id for r in outline.reading_order(blocks).where("doc_id = 'd'").orderBy("ord").collect()]
    assert got == ["l1", "l2", "l3", "l4", "l5", "lx", "l0", "l6", "l7", "l8"]


def test_parse_blocks(blocks):
    docs, sections, elements = outline.parse_blocks(blocks)
    assert sorted(tuple(r) for r in docs.collect()) == [("d", "Pump Manual", 2), ("e", "", 1)]
    assert sorted(tuple(r) for r in sections.select("doc_id", "section_id", "parent_id", "root_id", "level", "title", "page_start", "page_end").collect()) == [
        ("d", 0, None, 0, 0, "Pump Manual", 1, 1), ("d", 1, 0, 0, 1, "Setup", 1, 2), ("e", 0, None, 0, 0, "(Untitled)", 1, 1),
    ]
    assert [tuple(r) for r in elements.orderBy("doc_id", "ord").select("doc_id", "section_id", "element_type", "text", "page", "caption").collect()] == [
        ("d", 0, "text", "Turn it on. Wait.", 1, None), ("d", 1, "list", "one two", 1, None), ("d", 1, "figure", "[Figure]", 2, "Figure 1: valve"), ("d", 1, "text", "Figure 1: valve", 2, None),
        ("d", 1, "table", "Limits\nName | Max\nflow | 9", 2, None), ("e", 0, "text", "No heading here.", 1, None),
    ]
    s = {r.doc_id: r for r in outline.summary(docs, sections, elements).collect()}
    assert (s["d"].total_sections, s["d"].total_elements, s["d"].elements_by_type) == (2, 5, {"text": 2, "list": 1, "figure": 1, "table": 1})


def test_figure_regions_and_cells(blocks):
    r = outline.figure_regions(blocks).first()
    assert (r.block_id, r.caption, r.section_header, r.preceding_text) == ("l6", "Figure 1: valve", "Setup", "")
    cells = outline.table_cells(blocks).orderBy("row", "col").collect()
    assert [(c.table_id, c.row, c.col, c.text, c.is_header) for c in cells] == [("l8", 1, 1, "Name", True), ("l8", 1, 2, "Max", True), ("l8", 2, 1, "flow", False), ("l8", 2, 2, "9", False)]
    assert {r.block_type: r.n for r in outline.elements_by_type(blocks).where("doc_id = 'd'").collect()}["CELL"] == 4


def test_chunk_blocks(blocks):
    c = {r.id: r for r in graph.chunk_blocks(blocks).collect()}
    assert set(c) == {"d:L0:0", "d:L2:0", "d:L2:1", "d:L2:2", "d:L2:3", "d:L2:4", "d:L1:0", "e:L0:0", "e:L1:0", "e:L2:0"}
    assert c["d:L1:0"].parent_id == c["d:L2:3"].chapter_root_id == "d:L0:0" and c["d:L2:2"].parent_id == "d:L1:0"
    assert (c["d:L2:2"].figure_caption, c["d:L2:2"].prev_id, c["d:L2:2"].next_id) == ("Figure 1: valve", "d:L2:1", "d:L2:3")
    assert c["d:L2:2"].context_text == "Document: Pump Manual > Section: Setup > Content type: Figure/Diagram > Page: 2\n---\nCaption: Figure 1: valve\nSurrounding context: one two [...] Figure 1: valve\nFigure 1: valve"
    assert c["d:L0:0"].text == "Turn it on. Wait. one two Figure 1: valve Figure 1: valve Limits\nName | Max\nflow | 9"
    assert [c[k].seq for k in ("d:L0:0", "d:L2:0", "d:L2:4", "d:L1:0")] == [0, 1, 5, 6]
    assert c["e:L0:0"].token_count == len("No heading here.") // 4


def sections_of(spark, rows):
    return spark.createDataFrame([("x", i, p, r, 0 if p is None else 1, t, 1, 1) for i, p, r, t in rows], "doc_id string, section_id int, parent_id int, root_id int, level int, title string, page_start int, page_end int")


def elements_for(spark, pairs):
    return spark.createDataFrame([("x", s, k, "text", t, 1, "") for k, (s, t) in enumerate(pairs)], "doc_id string, section_id int, ord int, element_type string, text string, page int, block_id string")


def test_clean_up(spark):
    docs = spark.createDataFrame([("x", "t", 10)], "doc_id string, title string, total_pages int")
    s = sections_of(spark, [(0, None, 0, "A"), (1, 0, 0, "Mark"), (2, 0, 0, "B"), (3, 0, 0, "mark "), (4, 0, 0, "b (CONTINUED)"), (5, 0, 0, "MARK"), (6, 0, 0, "C (continued)"), (7, 0, 0, "c (continued)"), (8, None, 8, "Index"), (9, 8, 8, "Sub")])
    e = elements_for(spark, [(0, "a"), (2, "b"), (4, "more b"), (6, "c"), (7, "more c"), (9, "gone")])
    s2, e2 = outline.clean(docs, s, e)
    assert [(r.section_id, r.title) for r in s2.orderBy("section_id").collect()] == [(0, "A"), (2, "B"), (6, "C (continued)")]
    assert [(r.section_id, r.text) for r in e2.orderBy("ord").collect()] == [(0, "a"), (2, "b"), (2, "more b"), (6, "c"), (6, "more c")]


def test_restructure(spark):
    titles = ["Cover", "1. Intro", "1.1. Goal", "note", "2. Use", "2. stray", "2.1. Start", "2.1.1. Deep"] + [f"frag {i}" for i in range(50)] + ["3. End"]
    s = sections_of(spark, [(0, None, 0, "Book"), *((i + 1, 0, 0, t) for i, t in enumerate(titles))])
    got = {r.title: r for r in outline.restructure(s, elements_for(spark, [(2, "x")])).collect()}
    assert got["Book"].parent_id is None and got["Cover"].parent_id == 0  # front matter
    assert [got[t].parent_id for t in ("1. Intro", "1.1. Goal", "note", "2. Use", "2. stray", "2.1. Start", "2.1.1. Deep", "frag 7", "3. End")] == [None, 2, 3, None, 5, 5, 7, 8, None]
    assert [got[t].level for t in ("1. Intro", "1.1. Goal", "2.1.1. Deep")] == [0, 1, 2] and got["frag 7"].root_id == 5
    small = sections_of(spark, [(0, None, 0, "Book"), *((i + 1, 0, 0, f"{i + 1}. x") for i in range(10))])
    assert outline.restructure(small, elements_for(spark, [(1, "x")])).where("parent_id = 0").count() == 10


def test_boxes(spark):
    d = spark.range(1)
    box = F.struct(*(F.lit(v).alias(k) for k, v in (("left", 0.1), ("top", 0.2), ("width", 0.3), ("height", 0.4))))
    assert tuple(d.select(outline.crop_box(box, F.lit(1000), F.lit(500), max_right=0.41).alias("c")).first().c) == (80, 90, 410, 310)
    assert tuple(round(x, 6) for x in d.select(outline.row_band(box, F.lit(1), F.lit(2), F.lit(4)).alias("c")).first().c) == (0.1, 0.2, 0.3, 0.2)
    n = d.select(outline.normal_box(*(F.lit(float(x)) for x in (60, 700, 130, 600, 100, 800))).alias("c")).first().c
    assert tuple(round(x, 6) for x in n) == (0.6, 0.125, 0.7, 0.125)
    cols = "doc_id string, page int, ord int, left double, top double, right double, bottom double"
    cached = spark.createDataFrame([("x", 1, 0, 0.0, 0.0, 1.0, 0.4), ("x", 1, 1, 0.0, 0.1, 1.0, 0.5), ("x", 2, 2, 0.0, 0.0, 0.1, 0.1)], cols)
    fresh = spark.createDataFrame([("x", 1, 0, 0.0, 0.1, 1.0, 0.5), ("x", 1, 1, 0.0, 0.45, 1.0, 0.6), ("x", 2, 2, 0.05, 0.0, 1.0, 1.0)], cols)
    assert [(r.cached_ord, r.fresh_ord) for r in outline.match_tables(cached, fresh).orderBy("cached_ord").collect()] == [(0, 0)]
    marks = spark.createDataFrame([("x", f"b{p}", p, 0.1, 0.02, 0.2, 0.05, "aa") for p in range(3)] + [("x", "big", 4, 0.1, 0.4, 0.2, 0.05, "aa"), ("x", "one", 5, 0.1, 0.02, 0.3, 0.05, "bb")], "doc_id string, block_id string, page int, left double, top double, width double, height double, pixel_md5 string")
    assert sorted(r.block_id for r in outline.repeating_figures(marks).collect()) == ["b0", "b1", "b2"]


def plain_combine(items, limit):
    def cut(t, n):
        if len(t) <= n:
            return t
        h = t[:n]
        at = h.rfind(" ")
        return (h[:at] if at > n * 0.5 else h).rstrip() + "…"

    if not items:
        return ""
    if len(items) == 1:
        return cut(items[0][0], limit)
    best = sorted(range(len(items)), key=lambda i: -items[i][1])[: max(1, limit // 41)]
    items = [items[i] for i in sorted(best)]
    total = sum(w for _, w in items) or len(items)
    room = [max(40, int(w / total * limit)) for _, w in items]
    if sum(room) > limit:
        scale = limit / sum(room)
        room = [max(1, int(r * scale)) for r in room]
    return cut(" ".join(p for p in (cut(t.strip(), r) for (t, _), r in zip(items, room)) if p), limit)


def test_combine(spark):
    import random

    r = random.Random(2)
    cases = [[(" ".join("w" * r.randint(1, 9) for _ in range(r.randint(0, 40))), r.choice([1.5, 1.4, 0.8, 1.0, 0.3])) for _ in range(n)] for n in (0, 1, 2, 5, 9, 30, 60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, items array<struct<text:string,weight:double>>")
    for limit in (60, 400, 1500):
        got = [x.c for x in df.orderBy("i").select(graph.combine(F.col("items"), limit).alias("c")).collect()]
        assert got == [plain_combine(c, limit) for c in cases]


def test_summarise_with_a_model(spark, blocks):
    short = F.pandas_udf(lambda s: s.str[:5], "string")
    c = graph.split_document(*outline.parse_blocks(blocks))
    assert {r.id: r.summary for r in graph.summarise_with(c, short, fan_in=2, least_tokens=3).collect()} == {"d:L0:0": "Turn ", "e:L0:0": "No he"}
    assert graph.counts_by_level(c).where("doc_id = 'd'").first().asDict() == {"doc_id": "d", "total": 7, "macro": 1, "meso": 1, "micro": 5}
