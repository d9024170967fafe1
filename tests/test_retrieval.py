import math
import re

import numpy as np
import pytest

from citeloom.config import Settings
from citeloom.operators import hybrid, lexical, vector
from citeloom.operators.relevance import filter_by_entities, irrelevance
from citeloom.operators.models import embed, generate

HIT = "query_id int, title string, section_title string, text string, vector_score double"


def random_vectors(spark, n, dim, name, seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-3, 4, size=(n, dim)).astype(float)
    rows[::5] = rows[0]  # copies, so that scores tie
    key = "query_id int, vector array<float>" if name == "query" else "chunk_id string, embedding array<float>"
    data = [((i if name == "query" else f"c{i:04d}"), r.tolist()) for i, r in enumerate(rows)]
    return rows, spark.createDataFrame(data, key)


@pytest.mark.parametrize("settings", [{}, {"max_broadcast_bytes": 8 * 8 * 3}])
def test_nearest_equals_brute_force_both_ways(spark, settings):
    q, queries = random_vectors(spark, 11, 8, "query", 1)
    v, vectors = random_vectors(spark, 130, 8, "vector", 2)
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    scores = np.round(norm(q) @ norm(v).T, 9)
    want = {
        (i, rank + 1): f"c{j:04d}" for i in range(11)
        for rank, j in enumerate(sorted(range(130), key=lambda j: (-scores[i, j], j))[:12])
    }
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in vector.nearest(queries, vectors, 12, **settings).collect()}
    assert got == want


def test_vector_dimension_is_checked(spark):
    _, queries = random_vectors(spark, 2, 4, "query", 1)
    _, vectors = random_vectors(spark, 3, 5, "vector", 1)
    with pytest.raises(Exception, match="vector dimension is not 4"):
        vector.nearest(queries, vectors).collect()


def bm25_model(texts, query):
    docs = {k: re.findall(r"[^\W_]+", t.lower()) for k, t in texts.items()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in re.findall("[A-Za-z0-9]+", query):
        tf = {k: sum(t.startswith(term.lower()) for t in d) for k, d in docs.items()}
        df = sum(c > 0 for c in tf.values())
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        for k, c in tf.items():
            if c:
                scores[k] = scores.get(k, 0) - idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[k]) / mean))
    return sorted(((round(s, 9), k) for k, s in scores.items()))[:12]


def test_keyword_search_equals_model_both_ways(spark):
    words = ["match", "matching", "super", "superglue", "glue", "loss", "a", "deep"]
    rng = np.random.default_rng(3)
    texts = {f"c{i:02d}": " ".join(rng.choice(words, size=rng.integers(1, 30))) for i in range(40)}
    chunks = spark.createDataFrame([(k, "", "", "", t) for k, t in texts.items()], "chunk_id string, arxiv_id string, title string, section_title string, text string")
    asked = {1: "Compare with SuperGlue. super", 2: "match m", 3: "!!", 4: "zzz", 5: "A NOT deep"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    index = lexical.forward_index(chunks)
    stats, stored = lexical.corpus_statistics(index), lexical.store_postings(index)
    want = {(q, r + 1): hit for q, text in asked.items() for r, hit in enumerate(bm25_model(texts, text))}
    for settings in (Settings(), Settings(max_broadcast_bytes=0, rows_per_salt=5)):
        found = lexical.keyword_search(stored, stats, queries, settings=settings)
        got = {(r["query_id"], r["rank"]): (r["score"], r["chunk_id"]) for r in found.collect()}
        assert got.keys() == want.keys()
        for key in want:
            assert got[key][1] == want[key][1] and abs(got[key][0] - want[key][0]) < 1e-8


def test_refresh_index_touches_changed_chunks_only(spark):
    schema = "chunk_id string, arxiv_id string, title string, section_title string, text string"
    index = lexical.forward_index(spark.createDataFrame([("a", "", "", "", "old"), ("b", "", "", "", "kept")], schema))
    fresh = lexical.refresh_index(index, spark.createDataFrame([("a", "", "", "", "new words")], schema))
    assert {(r["chunk_id"], tuple(r["tokens"])) for r in fresh.collect()} == {("a", ("new", "words")), ("b", ("kept",))}


def ranked(spark, rows, **limits):
    """rows: chunk_id, doc, section, vector_rank, tier, provenance"""
    found = spark.createDataFrame(
        [(1, c, d, d, "T", s, "x", v, 0.5, None, None, t, p) for c, d, s, v, t, p in rows],
        "query_id int, chunk_id string, doc_id string, arxiv_id string, title string, section_title string, text string, vector_rank int,"
        " vector_score double, keyword_rank int, keyword_score double, tier int, provenance_kind string",
    )
    queries = spark.createDataFrame([(1,)], "query_id int")
    options = {"vector_k": 12, "keyword_k": 12, "top_k": 8, "max_per_doc": 4, "section_boost": 0.0} | limits
    got = hybrid.rank_candidates(found, hybrid.uniform_limits(queries, **options)).orderBy("rank").collect()
    return [r["chunk_id"] for r in got]


def test_boosts_and_quota(spark):
    plain = [("a", "d1", "Intro", 1, None, None), ("b", "d2", "Method", 2, None, None)]
    assert ranked(spark, plain) == ["a", "b"]
    assert ranked(spark, plain, section_boost=0.01) == ["b", "a"]
    assert ranked(spark, [("a", "d1", "s", 1, 2, None), ("b", "d2", "s", 2, 0, None)]) == ["b", "a"]
    assert ranked(spark, [("a", "d1", "s", 1, None, "scraped"), ("b", "d2", "s", 2, None, "curated")]) == ["b", "a"]
    crowd = [(f"c{i}", "d1" if i < 5 else "d2", "s", i + 1, None, None) for i in range(6)]
    assert ranked(spark, crowd, max_per_doc=2) == ["c0", "c1", "c5"]
    assert len(ranked(spark, crowd, max_per_doc=0)) == 6


def test_relevance_guard(spark):
    queries = spark.createDataFrame(
        [(1, "transformer attention"), (2, "transformer"), (3, "of it"), (4, "nothing found"), (5, "vectors only")], "query_id int, query string"
    )
    hits = spark.createDataFrame(
        [(1, "t", "s", "bananas", 0.12), (2, "t", "s", "a Transformer", 0.12), (3, "t", "s", "x", 0.1), (5, "t", "s", "x", 0.45)], HIT
    )
    got = {r["query_id"]: r["is_irrelevant"] for r in irrelevance(queries, hits).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_entity_filter_needs_whole_words(spark):
    queries = spark.createDataFrame([(1, "Does LoFTR win"), (2, "is it ok")], "query_id int, query string")
    hits = spark.createDataFrame([(1, "loftr", "s", "x", 0.0), (1, "t", "s", "loftrs", 0.0), (2, "t", "s", "any", 0.0)], HIT)
    assert sorted((r["query_id"], r["title"]) for r in filter_by_entities(hits, queries).collect()) == [(1, "loftr"), (2, "t")]


def test_embedding_contract(spark):
    df = spark.createDataFrame([("a b",), ("",)], "text string")
    made = embed(df, "text", "v", lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert [list(r["v"]) for r in made] == [[3.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="embedder gave 0 vectors"):
        embed(df, "text", "v", lambda texts: []).collect()


def test_generation_errors_are_values(spark):
    def model(prompt, **_):
        if prompt == "boom":
            raise RuntimeError("no")
        return "" if prompt == "empty" else prompt.upper()

    df = spark.createDataFrame([("hi",), ("boom",), ("empty",)], "prompt string")
    got = {r["prompt"]: (r["reply"], r["error"]) for r in generate(df, model).collect()}
    assert got == {"hi": ("HI", None), "boom": (None, "generation failed: no"), "empty": (None, "model gave no output")}
