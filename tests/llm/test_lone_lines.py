"""Repeated single lines in op4_line_dedup and in the pipeline's stage, against a plain version."""

import hashlib

import corpus_pipeline
import plain_versions as brute
from test_corpus_operators import plain_lines

from verdantspark.llm import linededup
from verdantspark.llm.queries import op4_line_dedup


def plain(rows):
    """{doc_id: lines that stay}: without later copies of runs of two lines, nor of any line with a word."""
    lines, seen, pairs, out = {i: (t or "").split("\n") for i, t in rows}, set(), set(), {}
    for i in sorted(lines):
        gone = set()
        for k, line in enumerate(lines[i]):
            if brute.space_words(line):
                gone |= {k} if line in seen else set()
                seen.add(line)
            if k + 1 < len(lines[i]):
                pair = (line, lines[i][k + 1])
                gone |= {k, k + 1} if pair in pairs else set()
                pairs.add(pair)
        out[i] = [x for k, x in enumerate(lines[i]) if k not in gone]
    return out


PASSAGE = " ".join(f"w{i}" for i in range(60))
ROWS = [(0, f"a\n{PASSAGE}\n\nb"), (1, f"c\n{PASSAGE}\nd\n\nshort"), (2, f"{PASSAGE}\n e\n\n \nf\n\n "), (3, "short"), (4, " \n \ng\n\n"), (5, None)]


def test_op4(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    want = plain(ROWS)
    all_ = {i: len((t or "").split("\n")) for i, t in ROWS}
    assert got == {i: (all_[i], all_[i] - len(v), hashlib.sha256("\n".join(v).encode()).hexdigest()) for i, v in want.items()}
    assert PASSAGE in want[0] and PASSAGE not in want[1] + want[2]


def test_stage(spark):
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(ROWS, "doc_id long, text string"), "")
    assert {r.doc_id: r.text or "" for r in out.collect()} == {i: "\n".join(v) for i, v in plain(ROWS).items() if v}


def test_odd_rows(docs, rows):
    got = {r.doc_id: r.kept_text for r in linededup.without_copies(docs, lone_words=1).collect()}
    assert got == {i: "\n".join(v) for i, v in plain(rows).items()}
    assert any(got[i] != t for i, (_, _, t) in plain_lines(rows, 2).items())


def test_op4_merges_its_narrow_rows(spark, tmp_path):
    """The result, rows without texts, is one small file, not one for each task that read texts."""
    rows = [(i, "\n".join(f"line {(i * 7 + k) % 400} of {PASSAGE}" for k in range(40))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    found = op4_line_dedup(spark, str(tmp_path))
    found.write.parquet(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 1
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: (40, 40 - len(v), hashlib.sha256("\n".join(v).encode()).hexdigest()) for i, v in plain(rows).items()}
