"""Faults found on larger and on odd tables, fourth round."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom import schemas
from citeloom.checks import incremental, inputs, scalars
from citeloom.operators import curate, lexical, queue
from citeloom.plans import corpus_jobs
from citeloom.session import materialize

# Text, and what is left of it when white space is made single; the last three hold no text.
ODD = [("a]]>b and ]]> c",) * 2, ("nul \x00, bell \x07, esc \x1b[0m",) * 2, ("form\x0cfeed \x0c page", "form feed page"), ("￾ non ￿",) * 2,
       ("x &amp; <b>bold</b>\r\ny", "x &amp; <b>bold</b> y"), ("\x01",) * 2, ("", ""), (" \n", ""), (None, None)]


def odd_documents(spark, tmp_path, lang="en"):
    rows = [(i + 1, text, lang, f"src{i}") for i, (text, _) in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_sections_of_texts_that_xml_cannot_hold(spark, tmp_path):
    found = {(r.doc_id, r.position): (r.title, r.text) for r in scalars.fulltext_sections(spark, odd_documents(spark, tmp_path, "e<n&")).collect()}
    want = {}
    for i, (_, text) in enumerate(ODD):
        want[i + 1, 0] = ("Abstract", None if text is None else f"{text}\n\nsrc{i}")
        want[i + 1, 1], want[i + 1, 2] = (f"Head src{i}", text), ("Section 2", "e<n& tail")
    assert found == want


def test_full_texts_of_odd_documents_are_cut_as_their_texts(spark, tmp_path):
    landed = incremental.landed_fulltexts(spark, odd_documents(spark, tmp_path)).where("file_stem not like '%00009v%'")
    papers = landed.select("file_stem", F.col("file_stem").alias("doc_id"), F.lit("a").alias("arxiv_id"), F.lit("t").alias("title"))
    chunks, errors = corpus_jobs.chunk_papers(papers, landed)
    assert errors.count() == 0
    got = {r.doc_id: r.text for r in chunks.select("doc_id", inputs.of_xml("text").alias("text")).collect()}
    assert got == {f"2001.0000{i + 1}v{1 + (i + 1) % 3}": text for i, (_, text) in enumerate(ODD) if text}


def test_joins_of_a_whole_queue_are_shuffled(spark):
    def stored(schema, *rows):
        return materialize(spark.createDataFrame(rows, schema), "small")

    documents, candidates = stored(schemas.DOCUMENTS), stored(schemas.CANDIDATES)
    batch = stored("doc_id string, best_pdf_url string", ("axv:1", "u"))
    results = stored("doc_id string, status string, reason string, seq int", ("axv:1", "failed", "r", 0))
    texts = stored("file_stem string, xml string", ("1", "<TEI/>"))
    catalogue = stored("paper_key string, citationCount int", ("ARXIV:2001.00001", 3))
    papers = materialize(queue.to_papers(batch, documents), "papers")
    ended = materialize(queue.apply_results(candidates, results, 1), "candidates")
    new = stored(schemas.CHUNKS)
    due = curate.stale_or_missing(stored("arxiv_id string", ("2001.00001",)), stored(schemas.METRICS), 30, 1)
    for made in (queue.to_papers(batch, documents), queue.require_cached(papers, texts), *corpus_jobs.chunk_papers(papers, texts),
                 queue.apply_results(candidates, results, 1), queue.apply_results_to_documents(documents, ended, results, 1),
                 lexical.refresh_index(materialize(lexical.forward_index(new), "index"), new), due, curate.look_up(due, catalogue)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan
    assert [r.citationCount for r in curate.look_up(due, catalogue).collect()] == [3]
