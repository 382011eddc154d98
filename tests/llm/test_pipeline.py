import zlib

import numpy as np
from brute import jaccard_components, removed

import corpus_pipeline
from cellframe.llm import scratch

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_equal_brute_force_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [texts(docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
            seen.append(texts(docs))
    start, good, whole, near, cut = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(good) <= set(start) and all(start[d] == t for d, t in good.items())
    assert np.mean([d in good for d, q in labels.items() if q == 1]) > 0.97
    last = {}
    for d, t in good.items():
        last[t] = max(last.get(t, d), d)
    assert whole == {d: t for t, d in last.items()}
    rows = sorted(whole.items())
    assert set(near) == {d for d, _, c in jaccard_components(rows, 5, 80) if c == d}
    assert set(cut) == set(near)
    lost = {r[0]: r[2] for r in removed(sorted(near.items()), 50)}
    for d, t in cut.items():
        if not lost[d]:
            assert t == near[d]
        else:
            assert len(near[d].encode()) - len(t.encode()) - lost[d] in range(0, 8 * 50)
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(cut)
    by = {}
    for r in packed:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert all(sum(n for _, n, _ in p) == p[0][2] for p in by.values())


def test_run_returns_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "start", "length"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_packing_stage_returns_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    rows = corpus_pipeline.pack(spark, docs, SF).select("length", "ids", "ids_crc32").collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
