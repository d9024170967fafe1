"""Faults found on larger and on odd tables."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import functions as F

from citeloom.checks import corpus_state, incremental, inputs, selection
from citeloom.config import DEFAULTS
from citeloom.operators import chunk_store, extract, lexical, resolve
from citeloom.operators.chunking import chunk_sections
from citeloom.operators.models import hashing_embedding
from citeloom.session import materialize, shared_folder
from citeloom.streaming import jobs


def test_pages_of_one_address_give_each_link_once(spark):
    pages = spark.createDataFrame(
        [("http://h.org/p", '<a href="a"><a name="x"><a href="b"><a href="a">'), ("http://h.org/p", '<a href="mailto:m"><a href="c"><a href="b">'),
         ("http://h.org/q", '<a href="a">')], "page_url string, html string")
    got = {(r.page_url[-1], r.position): r.link[-1] for r in extract.page_links(pages).collect()}
    assert got == {("p", 0): "a", ("p", 1): "c", ("p", 2): "b", ("q", 0): "a"}


def test_tables_stream_from_one_file_and_from_a_folder(spark, tmp_path):
    rows = [(i, "word " * (i + 1), "en", "src0") for i in range(8)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    documents.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    os.makedirs(tmp_path / "one")
    documents.toPandas().to_parquet(str(tmp_path / "one" / "documents.parquet"))
    for folder in ("many", "one"):
        chunks = incremental.streamed_chunks(spark, str(tmp_path / folder)).collect()
        assert len(chunks) == 8 and {c.text for c in chunks} == {r[1].strip() for r in rows}


def test_tokens_that_cancel_out_still_have_a_vector(spark):
    words = [f"w{i}" for i in range(400)]
    slots = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", F.pmod(F.xxhash64("w"), F.lit(128)).alias("s")).collect()}
    plus, minus = next((a, b) for a in words for b in words if slots[b] == slots[a] + 64)
    vectors = [r.v for r in spark.createDataFrame([(f"{plus} {minus}",), (plus,), ("",)], "t string").select(hashing_embedding("t").alias("v")).collect()]
    assert [round(sum(x * x for x in v), 5) for v in vectors] == [1.0, 1.0, 0.0]


def test_keyword_search_stores_no_pairs(spark, tmp_path):
    rows = [(f"c{i:03d}", "", "", "", f"a common a{i % 9} rare{i % 50} " * (1 + i % 4)) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id string, arxiv_id string, title string, section_title string, text string")
    index = materialize(lexical.forward_index(chunks), "index")
    stats = lexical.corpus_statistics(index)
    queries = spark.createDataFrame([(i, f"a common rare{i}") for i in range(40)], "query_id int, query string")
    before = set(os.listdir(shared_folder(spark)))
    found = lexical.keyword_search(index, stats, queries, 3)
    got = {(r.query_id, r["rank"]): r.chunk_id for r in found.collect()}
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_folder(spark))) - before} == {"query-classes"}
    # Only whole words of the rare kind tell these chunks apart; rare1 also begins rare10 to rare19.
    assert all(int(got[q, 1][1:]) % 50 == q for q in range(6, 40)) and len(got) == 120
    sliced = lexical.keyword_search(index, stats, queries, 3, replace(DEFAULTS, max_broadcast_bytes=0))
    assert {(r.query_id, r["rank"]): r.chunk_id for r in sliced.collect()} == got


def test_chunking_bounds_the_rows_of_a_python_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        schema = "doc_id string, arxiv_id string, title string, sections array<struct<title: string, text: string>>"
        chunks = chunk_sections(spark.createDataFrame([(f"d{i}", "a", "t", [("s", "some text")]) for i in range(500)], schema))
        assert chunks.count() == 500 and int(spark.conf.get(name)) <= 200
    finally:
        spark.conf.set(name, before)


def test_searches_store_the_index_alone_and_cut_hits_again(spark, sf_dir):
    before = set(os.listdir(shared_folder(spark)))
    corpus = inputs.build_corpus(spark, sf_dir)
    assert {name.rsplit("-", 5)[0] for name in set(os.listdir(shared_folder(spark))) - before} == {"index", "statistics"}
    stored = chunk_store.store_chunks(inputs.chunk_table(spark, sf_dir))
    every = corpus.index.select("chunk_id").where(F.xxhash64("chunk_id") % 3 == 0)
    hits = materialize(every.unionByName(spark.createDataFrame([("axv:none:0",)], "chunk_id string")), "hits")
    columns = ["doc_id", "arxiv_id", "title", "section_title", "text"]
    rows = lambda df: sorted(df.select("chunk_id", *columns).collect())
    want = rows(chunk_store.with_payload(stored, hits, columns))
    assert want and rows(chunk_store.cut_again(corpus.papers, hits, columns)) == want
    assert rows(chunk_store.cut_again(corpus.papers, hits, columns, replace(DEFAULTS, max_broadcast_bytes=0))) == want


def test_running_candidates_equal_a_row_by_row_model_without_python(spark, tmp_path):
    schema = "doc_id long, status string, seq long, at_unix long"
    rows = [(i % 7, ("blocked", "failed", "ingested", "ready", None)[i * i % 5], i * 37 % 211, 1000 + i) for i in range(211)]
    for at in range(0, len(rows), 50):
        spark.createDataFrame(rows[at : at + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states = jobs.candidate_lifecycle(stream, replace(DEFAULTS, candidate_max_retries=12))
    assert "Python" not in states._jdf.queryExecution().toString() and "Pandas" not in states._jdf.queryExecution().toString()
    got = {}
    for r in sorted(jobs.run_to_table(states, spark, "running", "update").collect(), key=lambda r: r.batch):
        got[r.doc_id] = (r.status, r.retry_count, r.next_retry_unix, r.last_seq)
    for doc in range(7):
        mine = [r for r in rows if r[0] == doc]
        n, last = sum(r[1] in ("blocked", "failed") for r in mine), max(mine, key=lambda r: r[2])
        status, due = last[1], None
        if status in ("blocked", "failed"):
            status, due = ("failed", None) if n >= 12 else ("blocked", last[3] + 14 * 86400)
        assert got[doc] == (status, n, due, last[2])


def test_resolved_state_mines_no_texts_and_spreads_its_cache(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(incremental, "references", lambda *_: 1 / 0)
    assert incremental.resolved_state(spark, sf_dir).count() > 0
    assert selection.work_cache(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    seen = spark.createDataFrame([("10.1/a", 5), ("10.1/a", 3), ("10.1/b", None), (None, 7)], "doi string, seq long")
    unique = resolve.resolve_dois(seen, selection.work_cache(spark, sf_dir))
    assert {(r.doi, r.seq) for r in unique.collect()} == {("10.1/a", 3), ("10.1/b", None), (None, 7)}
    assert "SortAggregate" not in unique._jdf.queryExecution().toString()


def test_mentions_are_searched_from_their_first_letters(spark):
    texts = ["ArXiv: 2101.00001v2 ARXIV 2101.00002", "HTTPS://ARXIV.ORG/ABS/cs/0101001, http://arxiv.org/pdf/2101.00003v1.pdf",
             "xarxiv:2101.00004 éarxiv:2101.00005 (arxiv:2101.00006)", "DOI:10.1000/A x10.1000/b é10.1000/c https://DX.doi.org/10.1000/d 10.1000/e.", ""]
    plain = {name: pattern.split("(?iU)", 1) for name, pattern in (("paper", extract.PAPER_MENTION), ("doi", extract.DOI_MENTION))}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for ahead, rest in plain.values():
        assert ahead.startswith("(?=[")
        found = rows.select(F.regexp_extract_all("t", F.lit(ahead + "(?iU)" + rest), F.lit(0)), F.regexp_extract_all("t", F.lit("(?iU)" + rest), F.lit(0))).collect()
        assert all(a == b for a, b in found) and sum(len(a) for a, _ in found) >= 4


def test_postings_carry_their_document_without_a_shuffle(spark):
    chunks = spark.createDataFrame([("d:0", "d", "one two one"), ("e:0", "e", "two"), ("f:0", None, "")], "chunk_id string, doc_id string, text string")
    chunks = chunks.withColumns({c: F.lit("") for c in ("arxiv_id", "title", "section_title")})
    nested = lexical.chunk_postings(lexical.forward_index(chunks, ["doc_id"]), ["doc_id"])
    assert {r.chunk_id: sorted(map(tuple, r.terms)) for r in nested.collect()} == {"d:0": [("one", 2), ("two", 1)], "e:0": [("two", 1)], "f:0": []}
    assert lexical.chunk_postings(lexical.forward_index(chunks.where("text = ''"))).count() == 1
    found = lexical.posting_rows(nested, ["doc_id"])
    assert {(r.term, r.doc_id, r.tf) for r in found.collect()} == {("one", "d", 2), ("two", "d", 1), ("two", "e", 1)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_references_take_their_kind_from_the_mined_row(spark, sf_dir):
    mined = corpus_state.references(spark, sf_dir)
    assert "Join" not in mined._jdf.queryExecution().executedPlan().toString()
    kinds = {(r.source_ref.rsplit("/", 1)[1], r.source_kind) for r in mined.select("source_ref", "source_kind").distinct().collect()}
    assert ("src0", "curated_repo") in kinds and len(dict(kinds)) == len(kinds)
