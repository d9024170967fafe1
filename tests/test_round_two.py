"""Late stream rows, feeds with gaps, lookups with repeated keys, point ids and vector lengths."""

import pytest
from pyspark.sql import functions as F

from citeloom.config import Settings
from citeloom.functions.ids import vector_point_id
from citeloom.operators import hybrid, select, upsert
from citeloom.operators.chunking import extract_sections
from citeloom.plans import corpus_jobs
from citeloom.schemas import PAPERS
from citeloom.sources import files
from citeloom.streaming import jobs


def test_an_older_attempt_in_a_later_batch_does_not_win(spark, tmp_path):
    schema = "doc_id string, status string, seq long, at_unix long"
    for name, row in (("a", ("d", "ingested", 10, 100)), ("b", ("d", "failed", 5, 50))):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rows = jobs.run_to_table(jobs.candidate_lifecycle(stream, Settings(candidate_max_retries=9)), spark, "late", "update").collect()
    last = max(rows, key=lambda r: r.batch)
    assert last.batch == 1 and (last.status, last.retry_count, last.last_seq) == ("ingested", 1, 10)


def test_feed_with_gaps_and_blank_versions(spark):
    feed = spark.createDataFrame([("a1", 0), ("b1", 100), ("", 200), (None, 300), ("a1", 400), ("c1", 500)], "arxiv_id_with_version string, seq long")
    known = spark.createDataFrame([("b1",), (None,)], "arxiv_id_with_version string")
    chosen, stats = select.select_from_feed(feed, known, 5)
    assert sorted(str(r[0]) for r in chosen.collect()) == ["", "None", "a1", "c1"]
    assert stats.first().asDict() == {"requested": 5, "selected": 4, "scanned": 6, "skipped": 1}
    two, stats = select.select_from_feed(feed, known, 1, scan_cap=2)
    assert [r[0] for r in two.collect()] == ["a1"] and stats.first()["scanned"] == 1


def test_feed_file_to_selection(spark, tmp_path):
    entry = "<entry><id>http://arxiv.org/abs/2401.0000{0}v1</id><title>T{0}</title><summary>s</summary></entry>"
    feed = '<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(entry.format(i) for i in range(4)) + "</feed>"
    (tmp_path / "feed.xml").write_text(feed)
    papers = spark.createDataFrame([], PAPERS)
    picked = corpus_jobs.select_latest(files.read_feed(spark, str(tmp_path / "feed.xml")), papers, 2)
    assert sorted(r["arxiv_id_with_version"] for r in picked.papers.collect()) == ["2401.00000v1", "2401.00001v1"]


def test_repeated_lookup_rows_do_not_multiply_hits(spark):
    hits = spark.createDataFrame([("q", "c1", "p"), ("q", "c2", "x")], "query_id string, chunk_id string, arxiv_id string")
    tiers = spark.createDataFrame([("p", 2), ("p", 1)], "arxiv_id string, tier int")
    found = hybrid._attach(hits, tiers, "arxiv_id", "tier", "int", Settings())
    assert sorted((r.chunk_id, r.tier) for r in found.collect()) == [("c1", 1), ("c2", None)]


def test_point_ids(spark):
    row = spark.range(1).select(vector_point_id(F.lit(17)).alias("a"), vector_point_id(F.lit("12")).alias("b"), vector_point_id(F.lit("d:0")).alias("c")).first()
    assert (row.a, row.b) == ("17", "12") and len(row.c) == 36


def test_vectors_of_another_length_stop_the_upsert(spark):
    schema = "chunk_id string, embedding array<float>"
    stored = spark.createDataFrame([("a", [1.0, 2.0])], schema)
    batch = spark.createDataFrame([("b", [1.0], 0)], schema + ", seq long")
    assert upsert.upsert_vectors(stored, batch).count() == 2
    with pytest.raises(Exception, match="another dimension"):
        upsert.upsert_vectors(stored, batch, dimension=2).collect()


def test_sections_of_odd_documents(spark):
    ns = 'xmlns="http://www.tei-c.org/ns/1.0"'
    cases = {
        f"<TEI {ns}><profileDesc><abstract><p>a <b>b</b></p><p/></abstract></profileDesc><text><body><div><head>H <i>x</i></head><p>one<p>in</p></p></div>"
        f"<div>bare <note>text</note></div></body></text></TEI>": [("Abstract", "a b"), ("H x", "onein\n\nin"), ("Section 2", "bare text")],
        f"<TEI {ns}><text><body><p>loose</p><figure><p>deep</p></figure></body></text></TEI>": [("Body", "loose\n\ndeep")],
        f"<TEI {ns}><text/></TEI>": [],
    }
    for xml, expected in cases.items():
        row = spark.createDataFrame([(xml,)], "xml string").select(extract_sections("xml").alias("s")).first().s
        assert row.error is None and [(s.title, s.text) for s in row.sections] == expected


def test_stored_postings_are_pruned_by_term(spark):
    from citeloom.operators import lexical

    rows = [(f"c{i}", "a", "t", "s", f"{w}{i % 7} common zebra") for i, w in enumerate(["alpha", "beta", "gamma", "delta", "epsilon"] * 40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, arxiv_id string, title string, section_title string, text string")
    index = lexical.forward_index(chunks)
    stored = lexical.store_postings(index)
    queries = spark.createDataFrame([("q", "gam alpha1 al"), ("r", "zeb zebra"), ("s", "ZEB zebra")], "query_id string, query string")
    members, terms = lexical.query_classes(queries)
    assert len({r["class"] for r in members.collect()}) == 2
    hits = lexical.prefix_hits(stored, terms)
    assert {(r.prefix, r.n) for r in hits.groupBy("prefix").count().withColumnRenamed("count", "n").collect()} == {
        ("gam", 40), ("al", 40), ("alpha1", 6), ("zeb", 200), ("zebra", 200)
    }
    met, rows = lexical.matching_postings(stored, terms)
    assert rows == met.count() and "PartitionFilters: [bucket" in met._jdf.queryExecution().toString()
    totals = {r.term: (r.df, r.cf) for r in lexical.term_statistics(index).collect()}
    assert totals["zebra"] == (200, 200) and totals["t"] == (200, 200) and totals["alpha0"][0] == 6
    assert {r.term: (r.df, r.cf) for r in stored.vocabulary.collect()} == totals


def test_a_document_that_comes_again_replaces_its_chunks(spark, tmp_path):
    schema = "doc_id string, arxiv_id string, title string, sections array<struct<title: string, text: string>>"
    long, short = [("S", "word " * 600)], [("S", "new words")]
    for docs in ([("d", "a", "t", long), ("e", "b", "t", short)], [("d", "a", "t", short)]):
        spark.createDataFrame(docs, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        jobs.enrich_documents_stream(stream, str(tmp_path / "out")).awaitTermination()
    rows = {(r.doc_id, r.text) for r in jobs.enriched_chunks(spark, str(tmp_path / "out")).collect()}
    assert rows == {("d", "new words"), ("e", "new words")}


def test_a_repeated_batch_keeps_its_time(spark, tmp_path):
    ticks = iter(range(100, 200))
    first = jobs.batch_time(spark, str(tmp_path), 0, lambda: next(ticks))
    assert first == jobs.batch_time(spark, str(tmp_path), 0, lambda: next(ticks)) != jobs.batch_time(spark, str(tmp_path), 1, lambda: next(ticks))
