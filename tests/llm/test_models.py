"""Page texts, toxicity, languages and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from citeloom.llm import html_text, language, toxicity

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">Accept <b>all</b></div><!-- <p>no</p> --><article class="post ad-free2"><h1>Head &amp;  line</h1><p>One<b> two</b><br>three
<p>Four&nbsp;five <script>var t="</p>";</script>six</p><div id='comments'><p>First!</p></div><aside>Side</aside><form>Mail <input></form>
<ul><li>a<li>b</ul><p title="x > y">a &lt;p&gt; b</p></article><footer>&copy; x</footer></body></html>"""


def text_of(page):
    return html_text.main_texts([page])[0][0]


def test_page_text():
    assert text_of(PAGE) == "Head & line\nOne two three\nFour five six\na\nb\na <p> b"
    assert text_of(None) == text_of("") == text_of("<nav>x</nav>") == ""
    assert text_of("just text") == "just text"
    assert text_of("<p>a<!-- open") == "a" and text_of("<p>a<script>open") == "a"
    assert text_of("<main><p>m</p></main><p>o</p>") == "m" and text_of("</b></p>x<p>y") == "x\ny"
    assert text_of("<article>" + "<p>word " * 20000).count("\n") == 19999


def test_repeats_decide_without_marks():
    menu = "".join(f"<div>menu entry number {i} leads to another page here</div>" for i in range(3))
    pages = [f"{menu}<div>{' '.join(f'own{k}x{i}' for i in range(30))}</div>" for k in range(5)]
    assert [t for t, _, _ in html_text.main_texts(pages)] == [" ".join(f"own{k}x{i}" for i in range(30)) for k in range(5)]
    assert text_of(pages[0]).count("\n") == 3  # alone, nothing repeats
    assert [t for t, _, _ in html_text.main_texts([pages[0]] * 3)] == [text_of(pages[0])] * 3  # equal pages are one


def test_covered_tokens_against_brute_force():
    draw = random.Random(1)
    for _ in range(30):
        streams = [[draw.choice("abc") for _ in range(draw.randrange(60))] for _ in range(draw.randint(1, 6))]
        found = html_text.covered_tokens(streams, 5)
        for k, stream in enumerate(streams):
            marked = np.zeros(len(stream), bool)
            others = {tuple(s[i : i + 5]) for j, s in enumerate(streams) if j != k for i in range(len(s) - 4)}
            for i in range(len(stream) - 4):
                if tuple(stream[i : i + 5]) in others:
                    marked[i : i + 5] = True
            assert (found[k] == marked).all()


def test_extract(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else f"http://h{i % 3}.com/{i}", None if i % 11 == 0 else PAGE, "x") for i in range(300)] + [(1, "http://h1.com/1", PAGE, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_text.extract(frame).collect()
    assert len(found) == 301 and all(r.text == text_of(PAGE if r.page_id % 11 else None) and r.n_chars == len(r.text) for r in found)
    assert html_text.extract(frame.limit(0)).collect() == []


def test_attributes_and_regions_of_text():
    for attributes in ('style="overflow:hidden"', 'aria-hidden="false"', 'title="a hidden valley"', 'href="/a?id=comments"', 'data-id="widget"', "data-x='role=\"main\"'"):
        assert text_of(f"<div {attributes}><p>kept</p></div>") == "kept", attributes
        assert text_of(f"<article {attributes}><p>kept</p></article>") == "kept", attributes
    for attributes in ("hidden", "HIDDEN=''", 'title="x" hidden', 'aria-hidden="true"', "id=comments", "role='navigation'"):
        assert text_of(f"<div {attributes}><p>gone</p></div>x") == "x", attributes
    teaser = "<article><p>read this too</p></article>"
    assert text_of(f"<main><p>{'body ' * 50}</p></main>{teaser}").startswith("body body")
    assert text_of(f"<main><p>{'body ' * 50}</p>{teaser}</main>").startswith("body body")
    assert text_of(f"<p>{'body ' * 50}</p>{teaser}").startswith("body body")


def test_repeats_of_a_whole_host(spark):
    own = [" ".join(f"own{k}x{i}" for i in range(30)) for k in range(400)]
    notice = " ".join(f"notice{i}" for i in range(12))
    with_notice = {3, 391}
    rows = [(k, f"http://a.com/{k}", f"<div>{own[k]}</div>" + (f"<div>{notice}</div>" if k in with_notice else "")) for k in range(400)]
    rows += [(1000, "http://b.com/", f"<div>{own[3]}</div><div>{notice}</div>")]  # another host
    rows += [(k, "http://c.com/", f"<div>{notice}</div>") for k in (1001, 1002)]  # equal pages are one
    rows += [(k, None, f"<div>{notice}</div><div>{own[k - 1000]}</div>") for k in (1003, 1004)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
    for bound in (1000, 0):
        found = {r.page_id: r for r in html_text.extract(frame, broadcast_rows=bound).collect()}
        assert len(found) == len(rows)
        assert all(found[k].text == own[k] and found[k].n_covered == 12 * (k in with_notice) for k in range(400))
        assert found[1000].text == f"{own[3]}\n{notice}" and found[1001].text == found[1002].text == notice
        assert found[1003].text == own[3] and found[1004].text == own[4]


def test_host_repeats_against_memory(spark):
    draw = random.Random(3)
    pages = ["".join(f"<p>{' '.join(draw.choice('abc') for _ in range(draw.randrange(14)))}</p>" for _ in range(3)) for _ in range(40)]
    pages += [pages[0], None, ""]
    frame = spark.createDataFrame([(k, "http://a.com/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    found = {r.page_id: (r.text, r.n_tokens, r.n_covered) for r in html_text.extract(frame).collect()}
    expected = html_text.main_texts(pages)
    assert [found[k] for k in range(len(pages))] == expected and any(c for _, _, c in expected)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matcher_against_edit_distance():
    draw = random.Random(3)
    terms = [toxicity.Term(t, b, 1.0 + i) for i, (t, b) in enumerate([("scum", False), ("idiot", False), ("worthless", False), ("lostr", True), ("abcabcabc", True), ("ab", True)])]
    matcher = toxicity.Matcher(terms)
    for _ in range(4000):
        word = list(draw.choice(terms).text + draw.choice(["", "x", "ung"]))
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word) + 1)
            word[at : at + draw.randrange(2)] = draw.choice(["", "a", "s", "t"])
        word = "".join(word)
        best = []
        for t in terms:
            ends = range(len(word) + 1) if t.is_beginning else [len(word)]
            least = min(edits(word[:e], t.text) for e in ends)
            if least <= t.edits:
                best.append((least, -t.weight))
        expected = min(best, default=None)
        assert matcher.match(word) == (expected and (expected[0], -expected[1])), word


@pytest.fixture(scope="module")
def toxic_data(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abdeglmnoprstu") for _ in range(draw.randint(3, 8))) for _ in range(300)]
    insults = ["dimwitted", "scoundrel", "lowlife"]
    rows, labels = [], []
    for i in range(600):
        text, toxic = [draw.choice(words) for _ in range(draw.randint(10, 60))], i % 6 == 0
        for _ in range(3 * toxic):
            text.insert(draw.randrange(len(text)), draw.choice(insults))
        rows.append((i, " ".join(text), "clash"))
        labels.append((i, int(toxic)))
    rows += [(700, None, "clash"), (701, "", "clash"), (701, "", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    return docs, spark.createDataFrame([*labels, (0, 1), (None, 1), (5, None)], "doc_id long, toxic int"), words, insults


def test_toxicity(spark, toxic_data):
    docs, labels, words, insults = toxic_data
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    assert {t.text for t in model.terms} == set(insults)
    scored = toxicity.score_texts(docs, model)
    assert scored.columns == ["doc_id", "text", "toxic", "score"]
    held = [r for r in scored.join(labels.where("toxic is not null").withColumnRenamed("toxic", "y"), "doc_id").where(toxicity.held_out()).collect()]
    assert len(held) > 100 and all((r.score >= 0.3) == bool(r.y) for r in held)
    plain = " ".join(words[:40])
    matcher = toxicity.Matcher(model.terms)
    score = lambda t: model.score(toxicity.text_features(t, matcher))
    assert score(plain + " dimwited scoundrell l0wlife") > 0.3 > score(plain)  # misspelled
    assert score(f'{plain} he said "dimwitted" once') < score(f"{plain} he said dimwitted once")
    empty = {r.doc_id: r.score for r in scored.where("doc_id >= 700").collect()}
    assert empty == {700: score(None), 701: score("")} and 0 <= empty[700] < 0.3


def test_toxicity_without_labels(spark, toxic_data):
    docs, labels, _, _ = toxic_data
    model = toxicity.learn(docs, labels.limit(0))
    assert not model.terms and {r.score < 1e-6 for r in toxicity.score_texts(docs, model, keep=["doc_id"]).collect()} == {True}
    assert toxicity.score_texts(docs.limit(0), model).collect() == []


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnsRenamed({"n_chars": "score"})
    odd = spark.createDataFrame([(-1, None, None, "s", 1), (-2, "12 %&", "en", "s", 1), (-3, "", "en", "s", 1), (-4, None, "en", "s", 1)], docs.schema)
    both = docs.unionByName(odd)
    model = language.learn(both.where(~language.held_out()))
    assert sorted(map(sorted, model.families)) == [["de", "en"], ["es", "fr"]]
    found = language.identify(both, model)
    assert found.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == both.count() and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id < 0)
    held = [r for r in found.where(language.held_out()).collect() if r.doc_id >= 0 and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    nothing = language.learn(both.limit(0))
    assert {r.lang_pred for r in language.identify(both, nothing).collect()} == {"und"}
    one = language.learn(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language.identify(docs, one).collect()} <= {"de", "und"}


def test_language_stage_keeps_vote_cycles(spark, sf_dir, monkeypatch):
    import corpus_pipeline

    line = lambda bias: np.append(np.zeros(language.FEATURES), bias)
    cycle = language.Model([["a", "b", "c"]], np.zeros((1, language.FEATURES + 1)), {("a", "b"): line(1), ("b", "c"): line(1), ("a", "c"): line(-1)})
    assert cycle.predict(language.features("some text"))[1] < 0.5
    monkeypatch.setattr(language, "learn", lambda *a, **k: cycle)
    docs = spark.createDataFrame([(1, "some text", "a"), (2, "1 2", "a"), (3, None, "a")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, sf_dir).collect()] == [1]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, given, sf_dir)
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in given.select("doc_id").collect()}
        seen.append(len(ids))
        given = spark.createDataFrame(kept.collect(), docs.schema)
    tokens = corpus_pipeline.STAGES[-1][1](spark, given, sf_dir).collect()
    assert len(tokens) == seen[-1] and all(r.round_trip and r.n_tokens == len(r.ids) for r in tokens)
    assert 0.6 * docs.count() < seen[-1] < docs.count()


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = [(None, "a text without an id in words", None, None, None), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "1 2 %", "en", "s", 5)]
    odd += [(-4, "the same row twice in one table", "en", "s", 31)] * 2 + [(-5, "long " * 30_000, None, "s", 150_000)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("kept", F.lit("clash")).withColumn("score", F.lit(1))
    for table in (both, both.limit(0)):
        given = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, given, sf_dir)
            assert kept.columns == both.columns, name
            given = spark.createDataFrame(kept.collect(), both.schema)
        ids = [r.doc_id for r in given.collect()]
        tokens = corpus_pipeline.STAGES[-1][1](spark, given, sf_dir).collect()
        assert len(tokens) == len(ids) and all(r.round_trip for r in tokens)
        if table is both:
            assert not {-1, -2, -3} & set(ids) and ids.count(-4) == 1 and ids.count(-5) == 1 and ids.count(None) == 1
        else:
            assert ids == []
