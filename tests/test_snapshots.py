"""Snapshots in parts: what a batch rewrites, and what an interrupted one leaves."""

import os

import pytest

from citeloom.config import Settings
from citeloom.operators.graph import GraphState
from citeloom.plans import corpus_jobs
from citeloom.schemas import REFERENCES
from citeloom.streaming import jobs


def references(spark, ids, kind="curated_repo"):
    rows = [("arxiv", f"2101.{i:05d}v1", kind, f"src{i}", 1000 + i) for i in ids]
    return spark.createDataFrame(rows, REFERENCES)


def stream_once(spark, tmp_path, ids, settings):
    references(spark, ids).coalesce(1).write.mode("append").json(str(tmp_path / "runs" / "run_id=r"))
    source = jobs.reference_stream(spark, str(tmp_path / "runs" / "run_id=r"))
    jobs.fold_references_stream(spark, source, str(tmp_path / "state"), lambda: 7, settings).awaitTermination()


def test_a_small_batch_rewrites_one_part(spark, tmp_path):
    settings = Settings(snapshot_parts=8)
    stream_once(spark, tmp_path, range(60), settings)
    store = jobs.snapshots(spark, str(tmp_path / "state"), settings)
    first = store.manifest(store.last_commit())
    assert len({p for t, p in first if t == "documents"}) == 8
    stream_once(spark, tmp_path, [3], settings)
    second = store.manifest(store.last_commit())
    changed = {k for k in second if second[k] != first.get(k)}
    assert {t for t, _ in changed} <= set(jobs.PARTS) and len({p for _, p in changed}) == 1
    state = jobs.read_snapshot(spark, str(tmp_path / "state"), settings=settings)
    assert state.documents.count() == 60 and state.candidates.count() == 60
    assert jobs.read_snapshot(spark, str(tmp_path / "none")).documents.collect() == []


def test_an_uncommitted_batch_is_not_read(spark, tmp_path):
    settings = Settings(snapshot_parts=4)
    stream_once(spark, tmp_path, range(10), settings)
    store = jobs.snapshots(spark, str(tmp_path / "state"), settings)
    before = sorted(r.doc_id for r in store.read("documents", store.last_commit()).collect())
    left = store.read("documents", store.last_commit()).limit(1).withColumn("part", store.part_of("doc_id"))
    left.write.partitionBy("part").parquet(str(tmp_path / "state" / "documents" / "version=1"))  # interrupted before its commit
    assert sorted(r.doc_id for r in store.read("documents", store.last_commit()).collect()) == before
    stream_once(spark, tmp_path, range(10, 12), settings)
    assert store.read("documents", store.last_commit()).count() == 12


def test_a_document_that_comes_again_leaves_nothing_stale(spark, tmp_path):
    schema = "doc_id string, arxiv_id string, title string, sections array<struct<title: string, text: string>>"
    for docs in ([("d", "a", "t", [("S", "oldword " * 600)]), ("e", "b", "t", [("S", "kept")])], [("d", "a", "t", [("S", "newword")])]):
        spark.createDataFrame(docs, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        jobs.enrich_documents_stream(stream, str(tmp_path / "out")).awaitTermination()
    out = str(tmp_path / "out")
    chunks = {r.chunk_id for r in jobs.enriched_chunks(spark, out).collect()}
    assert chunks == {"d:0", "e:0"} == {r.chunk_id for r in jobs.enriched_vectors(spark, out).collect()}
    terms = {(r.chunk_id, r.term) for r in jobs.enriched_postings(spark, out).collect()}
    assert ("d:0", "newword") in terms and ("e:0", "kept") in terms and not [t for t in terms if t[1] == "oldword"]


def test_an_interrupted_run_resumes(spark, tmp_path):
    rows = references(spark, range(5)).withColumn("seq", jobs.F.monotonically_increasing_id())
    record = lambda **more: corpus_jobs.record_run(spark, rows, "references", GraphState.empty(spark), str(tmp_path), "r1", 9, **more)
    whole = sorted(r.doc_id for r in record().documents.collect())
    with pytest.raises(Exception, match="(?i)exist"):
        record()
    os.remove(tmp_path / "events" / "references" / "run_id=r1" / "_SUCCESS")  # as if it had stopped there
    assert sorted(r.doc_id for r in record(resume=True).documents.collect()) == whole
    assert (tmp_path / "events" / "references" / "run_id=r1" / "_SUCCESS").exists()
