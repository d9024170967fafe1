import random


from citeloom.config import Settings
from citeloom.operators import graph, queue, upsert
from citeloom.schemas import CANDIDATES, REFERENCES, RESOLUTIONS
from pyspark.sql import types as T

NOW = 1000
WITH_SEQ = lambda schema: T.StructType([*schema.fields, T.StructField("seq", T.LongType())])


def apply_one_by_one(docs, queue_rows, ops):
    """Row-at-a-time model of the state rules."""
    for op in ops:
        d, q = docs.get(op["doc"]), queue_rows.get(op["doc"])
        new = {k: op[k] for k in ("arxiv", "doi", "pdf", "status", "conf", "prov", "best")} | {"created": op["seen"]}
        if d is None:
            docs[op["doc"]] = new
        else:
            for k in ("arxiv", "doi", "pdf"):
                d[k] = op[k] if op[k] is not None else d[k]
            d["conf"], d["best"] = max(d["conf"], op["conf"]), op["best"]
            if op["op"] == "alias":
                d["status"] = "resolved"
            else:
                d["prov"] = op["prov"]
                keep = d["status"] == "ingested" or (op["op"] == "reference" and d["status"] == "ready" and op["status"] == "discovered")
                d["status"] = d["status"] if keep else op["status"]
        if q is None:
            queue_rows[op["doc"]] = {"status": op["status"], "pdf": op["pdf"], "retry": op["retry"], "error": op["error"]}
        else:
            keep = q["status"] == "ingested" or (op["op"] == "reference" and q["status"] == "ready" and op["status"] == "discovered")
            q["status"] = q["status"] if keep else op["status"]
            if op["op"] == "reference":
                q["pdf"] = q["pdf"] if q["pdf"] is not None else op["pdf"]
            else:
                q["pdf"] = op["pdf"] if op["pdf"] is not None else q["pdf"]
                q["retry"] = op["retry"]
                if op["op"] == "alias":
                    q["error"] = op["error"]


def random_batch(rng):
    refs, res, ops = [], [], []
    for i in range(120):
        kind = rng.choice(["arxiv", "doi"])
        value = rng.choice(["2001.00001", "2001.00001v1", "2001.00002v2"]) if kind == "arxiv" else rng.choice(["10.1/a", "10.1/b", "10.1/c"])
        source = rng.choice(["curated_repo", "arxiv_feed", "scraped_pdf"])
        refs.append((kind, value, source, "u", 10 + i, i))
        versioned = kind == "arxiv" and "v" in value
        ops.append(
            {
                "op": "reference", "doc": ("axv:" if kind == "arxiv" else "doi:") + value, "arxiv": value if kind == "arxiv" else None,
                "doi": value if kind == "doi" else None, "pdf": f"https://arxiv.org/pdf/{value}.pdf" if versioned else None,
                "status": "ready" if versioned else "discovered", "conf": 0.9 if versioned else 0.0,
                "prov": {"curated_repo": "curated", "arxiv_feed": "canonical_api"}.get(source, "scraped"), "best": source, "seen": 10 + i,
                "retry": None, "error": None,
            }
        )
    for i in range(40):
        doi, paper = rng.choice(["10.1/a", "10.1/b", "10.1/d"]), rng.choice([None, "2001.00002v2", "2001.00009v1"])
        pdf, conf = rng.choice([None, "https://x/1.pdf", "https://x/2.pdf"]), rng.choice([0.3, 0.95])
        doc = f"axv:{paper}" if paper else f"doi:{doi}"
        res.append((doc, paper, paper, doi, pdf, conf, "openalex_resolved", 500 + i, i))
        base = {"arxiv": paper, "doi": doi, "pdf": pdf, "conf": conf, "prov": "canonical_api", "best": "openalex_resolved", "seen": 500 + i}
        if paper:
            ops.append(base | {"op": "alias", "doc": f"doi:{doi}", "status": "resolved", "retry": None, "error": f"merged_to:{doc}"})
        status = "ready" if paper or pdf else "blocked"
        ops.append(base | {"op": "resolution", "doc": doc, "status": status, "retry": NOW + 14 * 86400 if status == "blocked" else None, "error": None})
    return refs, res, ops


def test_fold_equals_row_by_row_model_over_several_batches(spark):
    rng = random.Random(7)
    docs, rows = {}, {}
    state = graph.GraphState.empty(spark)
    for _ in range(2):
        refs, res, ops = random_batch(rng)
        apply_one_by_one(docs, rows, ops)
        state = graph.fold_batch(
            state, spark.createDataFrame(refs, WITH_SEQ(REFERENCES)), spark.createDataFrame(res, WITH_SEQ(RESOLUTIONS)), NOW
        )
        got = {r["doc_id"]: r for r in state.documents.collect()}
        assert set(got) == set(docs)
        for key, want in docs.items():
            r = got[key]
            assert (r["arxiv_id_with_version"], r["doi"], r["pdf_url"], r["status"], r["resolution_confidence"], r["provenance_kind"],
                    r["best_source_kind"], r["created_at"]) == (
                want["arxiv"], want["doi"], want["pdf"], want["status"], want["conf"], want["prov"], want["best"], want["created"])
        queued = {r["doc_id"]: r for r in state.candidates.collect()}
        for key, want in rows.items():
            r = queued[key]
            assert (r["status"], r["best_pdf_url"], r["next_retry_unix"], r["last_error"]) == (
                want["status"], want["pdf"], want["retry"], want["error"])
        state = graph.GraphState(
            spark.createDataFrame(state.documents.collect(), state.documents.schema),
            spark.createDataFrame(state.sources.collect(), state.sources.schema),
            spark.createDataFrame(state.candidates.collect(), state.candidates.schema),
        )


def test_two_sources_give_two_documents_and_four_lineage_rows(spark):
    refs = [
        (kind, value, source, "ref", 1, i)
        for i, (kind, value, source) in enumerate(
            (k, v, s) for k, v in (("arxiv", "2104.00680v2"), ("doi", "10.1145/3366423.3380211")) for s in ("curated_repo", "visionbib_page")
        )
    ]
    state = graph.fold_batch(graph.GraphState.empty(spark), spark.createDataFrame(refs, WITH_SEQ(REFERENCES)), None, NOW)
    assert state.documents.count() == 2 and state.sources.count() == 4
    assert {r["doc_id"] for r in queue.ready_candidates(state.candidates, 10, NOW).collect()} == {"axv:2104.00680v2"}


def test_failed_twice_with_two_tries(spark):
    settings = Settings(candidate_retry_days=7, candidate_max_retries=2)
    rows = spark.createDataFrame([("d", "ready", None, 1.0, 0, None, None, 0)], CANDIDATES)
    once = spark.createDataFrame([("d", "failed", "x", 0)], "doc_id string, status string, reason string, seq int")
    first = queue.apply_results(rows, once, NOW, settings).first()
    assert (first["status"], first["retry_count"], first["next_retry_unix"]) == ("blocked", 1, NOW + 7 * 86400)
    twice = once.union(spark.createDataFrame([("d", "failed", "y", 1)], once.schema))
    last = queue.apply_results(rows, twice, NOW, settings).first()
    assert (last["status"], last["retry_count"], last["next_retry_unix"], last["last_error"]) == ("failed", 2, None, "y")


def test_upsert_chunks_replace_doc(spark):
    schema = "chunk_id string, doc_id string, arxiv_id string, title string, section_title string, chunk_index int, text string"
    stored = spark.createDataFrame([("d:0", "d", "a", "t", "s", 0, "old"), ("d:1", "d", "a", "t", "s", 1, "stale"), ("e:0", "e", "b", "t", "s", 0, "e")], schema)
    batch = spark.createDataFrame([("d:0", "d", "a", "t", "s", 0, "new", 0)], schema + ", seq int")
    assert {r["text"] for r in upsert.upsert_chunks(stored, batch).collect()} == {"new", "stale", "e"}
    assert {r["text"] for r in upsert.upsert_chunks(stored, batch, replace_doc=True).collect()} == {"new", "e"}
