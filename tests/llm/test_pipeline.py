"""The pipeline against its stages done by SQL and brute force."""

import re

import duckdb
import pytest
from test_duplicates import classes

import corpus_pipeline
from beatloom.llm import decontam, quality, secrets, segmentation
from beatloom.llm.queries import piece_model
from beatloom.session import materialise

SF = "/root/testdata/sf0.001"


def by_sql(sql, rows):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return con.execute(sql)


@pytest.fixture(scope="module")
def wanted():
    """Documents that should be left behind each stage, by id."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    good = {r[0] for r in by_sql(f"SELECT doc_id FROM ({quality.QUALITY_SQL}) WHERE kept", rows).fetchall()}
    one = [r for r in rows if r[0] in good]
    comp, _ = classes([r[1] for r in one], 5)
    two = [r for i, r in enumerate(one) if comp[i] == i]
    bad = {r[0] for r in by_sql(f"SELECT doc_id FROM ({decontam.CONTAMINATION_SQL}) WHERE contaminated", two).fetchall()}
    three = [r for r in two if r[0] not in bad]
    return [one, two, three]


def test_stages(spark, wanted):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding",
    ]
    for (_, stage), want in zip(corpus_pipeline.STAGES, wanted):
        docs = materialise(stage(spark, docs, SF))
        assert docs.columns == columns
        assert sorted(docs.select("doc_id", "text").collect()) == [(r[0], r[1]) for r in want]
    # secrets: nothing is left that the rules find, all else stays
    clean = materialise(corpus_pipeline.STAGES[3][1](spark, docs, SF))
    assert clean.columns == columns
    got = {r.doc_id: r.text for r in clean.collect()}
    mark = re.compile("|".join(rf"\[{r.kind}\]" for r in secrets.RULES))
    changed = 0
    for i, text, *_ in wanted[2]:
        assert secrets.scan(got[i].encode()) == []
        parts = mark.split(got[i])
        changed += len(parts) > 1
        at = 0
        for p in parts:
            at = text.index(p, at) + len(p)
        assert len(parts) > 1 or got[i] == text
    assert len(got) == len(wanted[2])
    # pieces: every document, both samples decode to its text
    pieces = segmentation.decode(corpus_pipeline.STAGES[4][1](spark, clean, SF), piece_model()).collect()
    assert {r.doc_id for r in pieces} == set(got)
    assert all(r.text == got[r.doc_id] for r in pieces)


def test_run_is_the_stages_in_a_row(spark, wanted):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert ids == {r[0] for r in wanted[2]}
