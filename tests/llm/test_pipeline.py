"""The pipeline's stages against plain versions, each on its own input."""

import os

import plain_versions as brute
import pytest
from test_lone_lines import plain as plain_lines

SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        if name != "packing":
            assert out.columns == columns
        if name == "quality":
            assert all(i in ids for i, _ in before if labels.get(i) == 1) and sum(i in ids for i, _ in before if labels.get(i) == 0) <= 1
        elif name == "line_dedup":
            want = {i: "\n".join(left) for i, left in plain_lines(before).items() if left}
            assert {r.doc_id: r.text for r in out.collect()} == want and all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_dedup":
            sets = {i: brute.shingles(t, 5) for i, t in before}
            alike = {i: {j: len(a & b) / len(a | b) for j, b in sets.items() if j != i} for i, a in sets.items()}
            assert all(alike[i][j] < 0.9 for i in ids for j in ids if i != j)
            assert all(max(alike[i].values()) > 0.7 for i in sets.keys() - ids)
        elif name == "decontamination":
            assert ids == {i for i, v in brute.contamination(before, items).items() if not v[4]}
        else:
            assert ids == {i for i, _ in before}
        docs = out
    run = pipeline.run(spark, SF)
    assert run.columns == docs.columns and run.count() == docs.count()


def test_odd_rows(spark, docs, empty):
    for frame in (docs, empty):
        now = frame
        for _, stage in pipeline.STAGES:
            now = stage(spark, now, SF)
        assert now.count() >= 0
