"""Chunks in buckets, vectors in cells."""

import numpy as np

from citeloom.config import Settings
from citeloom.operators import chunk_store, lexical, probes, vector


def test_hits_read_the_buckets_of_their_chunks(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 9}", "text " * (i % 5)) for i in range(400)], "chunk_id string, doc_id string, text string")
    store = chunk_store.store_chunks(chunks, buckets=16)
    hits = spark.createDataFrame([(1, "c7"), (1, "c300"), (2, "c7"), (2, "gone")], "query_id int, chunk_id string")
    want = {(1, "c7", "d7"), (1, "c300", "d3"), (2, "c7", "d7")}
    few = chunk_store.with_payload(store, hits, ["doc_id"])
    assert {(r.query_id, r.chunk_id, r.doc_id) for r in few.collect()} == want
    setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(setting, "false")  # else the plan prunes too, but does not print it
    plan = chunk_store.with_payload(store, hits, ["doc_id"])._jdf.queryExecution().toString()
    spark.conf.unset(setting)
    assert 1 <= int(plan.split("SelectedBucketsCount: ")[1].split(" out of 16")[0]) <= 3
    many = chunk_store.with_payload(store, hits, ["doc_id"], Settings(pruned_ids=1))
    assert {(r.query_id, r.chunk_id, r.doc_id) for r in many.collect()} == want
    assert chunk_store.with_payload(chunk_store.store_chunks(chunks.limit(0)), hits, ["doc_id"]).collect() == []


def clustered(spark, n, seed):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((12, 16)) * 4
    rows = middles[rng.integers(0, 12, n)] + rng.standard_normal((n, 16))
    rows[::7] = rows[0]  # a hot vector
    return rows, spark.createDataFrame([(f"v{i:04d}", r.tolist()) for i, r in enumerate(rows)], "chunk_id string, embedding array<float>")


def test_probed_cells_find_nearly_all_neighbours(spark):
    rows, vectors = clustered(spark, 900, 3)
    index = probes.build_index(vectors)
    assert index.table.count() == 900 and index.table.select("cell").distinct().count() > 1
    queries = spark.createDataFrame([(i, rows[i].tolist()) for i in range(0, 900, 31)], "query_id int, vector array<float>")
    pairs = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact = pairs(vector.nearest(queries, vectors))
    assert len(pairs(probes.nearest_probed(queries, index)) & exact) >= 0.9 * len(exact)
    assert pairs(probes.nearest_probed(queries, index, probes=len(index.centroids))) == exact  # all cells: nothing is lost
    assert pairs(probes.nearest_probed(queries, index, probes=len(index.centroids), settings=Settings(max_broadcast_bytes=16 * 8 * 5))) == exact
    one = probes.nearest_probed(queries.limit(1), index, probes=1)
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString()
    assert probes.nearest_probed(queries, probes.build_index(vectors.limit(0))).collect() == []


def test_hot_prefixes_are_looked_up_for_candidates(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i:03d}", "", "", "", " ".join(["common"] * int(rng.integers(1, 6)) + [f"rare{i % 40}"] * int(rng.integers(1, 4)) + ["filler"] * int(rng.integers(0, 9)))) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id string, arxiv_id string, title string, section_title string, text string")
    index = lexical.forward_index(chunks)
    stored, stats = lexical.store_postings(index), lexical.corpus_statistics(index)
    queries = spark.createDataFrame([(i, f"common rare{i} filler") for i in range(12)], "query_id int, query string")
    _, terms = lexical.query_classes(queries)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in lexical.keyword_search(stored, stats, queries, 5).collect()}
    counts = {c: {w: t.split().count(w) for w in t.split()} for c, *_, t in rows}
    lengths = {c: sum(v.values()) for c, v in counts.items()}
    mean = sum(lengths.values()) / len(rows)
    for q in range(12):
        total = {}
        for prefix in ("common", f"rare{q}", "filler"):
            tf = {c: sum(n for w, n in v.items() if w.startswith(prefix)) for c, v in counts.items()}
            df = sum(n > 0 for n in tf.values())
            idf = max(np.log((400 - df + 0.5) / (df + 0.5)), 1e-6)
            for c, n in tf.items():
                if n:
                    total[c] = total.get(c, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lengths[c] / mean))
        want = sorted((round(-s, 9), c) for c, s in total.items())[:5]
        assert [got[q, r + 1][0] for r in range(5)] == [c for _, c in want]
