"""The pipeline's stages on a small table: columns, decisions, and a plain version of each decision."""

import re

import corpus_pipeline
from quire.llm import pii, quality
from quire.llm.common import cut
from test_ops import plain_join


def test_stages(spark, tmp_path, docs, bench, fixture_rows):
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [now]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = cut(stage(spark, now, sf), "t")
        steps.append(now)
        if i < 4:
            assert now.columns == docs.columns
    rows = [{(r.doc_id, r.text) for r in s.collect()} if "text" in s.columns else None for s in steps]
    texts = [t or "" for _, t in fixture_rows[0]]
    kept = quality.verdicts(texts, quality.prior())[-1]
    assert rows[1] == {r for r, k in zip(fixture_rows[0], kept) if k}
    want = plain_join([r for r in rows[1] if r[0] is not None], 5, 80)
    assert rows[2] == {r for r in rows[1] if r[0] is None or want[r[0]][1] == r[0]}
    assert steps[2].where("doc_id is not null").count() == steps[2].where("doc_id is not null").select("doc_id").distinct().count()
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    assert rows[3] == {r for r in rows[2] if r[0] is None or flat(fixture_rows[1]) not in flat(r[1])} != rows[2]
    assert rows[4] == {(i, None if t is None else pii.replace(t, corpus_pipeline.PII_KEY)[0]) for i, t in rows[3]}
    assert steps[5].count() == steps[4].count()


def test_run_on_empty_tables(spark, tmp_path, none, bench):
    sf = str(tmp_path)
    none.write.parquet(f"{sf}/documents.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []
