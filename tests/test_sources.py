import json

import pytest

from citeloom.operators import resolve
from citeloom.sources import files


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_line_lists(spark, tmp_path):
    dois = write(tmp_path / "d.txt", "# c\nhttps://doi.org/10.1/B\n\n10.1/a\ndoi:10.1/b\n")
    assert [r["doi"] for r in files.read_dois(spark, dois).orderBy("seq").collect()] == ["10.1/b", "10.1/a"]
    repos, bad = files.read_repos(spark, write(tmp_path / "r.txt", "o/r.git\nhttps://github.com/o/r/tree\nx y/z\nhttps://gitlab.com/a/b\n"))
    assert [r["repo"] for r in repos.collect()] == ["o/r"] and bad.count() == 2
    ranges, bad = files.read_page_ranges(spark, write(tmp_path / "p.txt", "http://h.org/b\ncompute42 compute44\nm 3 2\na1 b2\n"))
    assert [tuple(r)[:3] for r in ranges.select("stem", "start", "end").collect()] == [("compute", 42, 44)] and bad.count() == 2
    venues = write(tmp_path / "v.yaml", "venues:\n  - CVPR\n  - ' ICCV '\n")
    assert {r["venue"] for r in files.read_venues(spark, venues).collect()} == {"CVPR", "ICCV"}
    cases = write(tmp_path / "e.yaml", "cases:\n  - question: q\n    must_include_tokens: [x]\n")
    assert files.read_eval_cases(spark, cases).first()["min_sources"] == 6


def test_paper_id_lines_fail_on_bad_json(spark, tmp_path):
    ids, skipped = files.read_paper_ids(spark, write(tmp_path / "i.jsonl", '{"base_id": "b"}\n"a"\n{"arxiv_id": 3}\n"a"\n'))
    assert [r["paper_id"] for r in ids.orderBy("seq").collect()] == ["b", "a"] and skipped.first()["skipped"] == 1
    with pytest.raises(Exception, match="invalid JSON"):
        files.read_paper_ids(spark, write(tmp_path / "x.jsonl", "{oops\n"))[0].collect()


def test_runs_are_append_only_and_ordered(spark, tmp_path):
    refs = spark.createDataFrame([("doi", f"10.1/{i}", "curated_repo", "r", i) for i in range(20)],
                                 "ref_type string, normalized_value string, source_kind string, source_ref string, discovered_at_unix long")
    files.write_run(refs.coalesce(1), str(tmp_path), "20240101-awesome")
    files.write_run(refs.limit(1), str(tmp_path), "20240102-awesome")
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_run(refs, str(tmp_path), "20240101-awesome")
    first = files.numbered(files.read_references(spark, f"{tmp_path}/run_id=20240101-awesome"))
    assert [(r["seq"], r["normalized_value"]) for r in first.orderBy("seq").collect()] == [(i, f"10.1/{i}") for i in range(20)]
    assert first.first()["run_id"] == "20240101-awesome"
    assert files.read_latest_references(spark, str(tmp_path), "awesome").count() == 1


def test_feeds(spark, tmp_path):
    entry = (
        "<entry><id>http://arxiv.org/abs/2104.00680v2</id><title> A\n b </title><summary>s  t</summary><published>2021</published>"
        '<author><name>X</name></author><author><name>Y</name></author><link href="http://arxiv.org/abs/2104.00680v2" rel="alternate"/>'
        '<link title="pdf" href="http://arxiv.org/pdf/2104.00680v2" rel="related" type="application/pdf"/></entry>'
    )
    feed = write(tmp_path / "f.xml", f'<feed xmlns="http://www.w3.org/2005/Atom">{entry}</feed>')
    row = files.read_feed(spark, feed).first()
    assert (row["arxiv_id"], row["version"], row["title"], row["summary"], row["authors"], row["pdf_url"]) == (
        "2104.00680", "v2", "A b", "s t", ["X", "Y"], "http://arxiv.org/pdf/2104.00680v2",
    )
    item = (
        "<item><title>T</title><link>https://arxiv.org/abs/2104.00681</link><description>x Abstract: y</description>"
        '<guid isPermaLink="false">oai:arXiv.org:2104.00681v1</guid><dc:creator>A, B</dc:creator></item>'
    )
    rss = write(tmp_path / "r.xml", f'<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>{item}</channel></rss>')
    row = files.read_rss(spark, rss).first()
    assert (row["arxiv_id_with_version"], row["summary"], row["authors"], row["pdf_url"]) == (
        "2104.00681v1", "y", ["A", "B"], "https://arxiv.org/pdf/2104.00681.pdf",
    )


def test_work_cache(spark, tmp_path):
    import hashlib

    works = {
        "10.1/a": {"id": "W1", "best_oa_location": {"pdf_url": "https://b/x.pdf", "is_oa": True}, "primary_location": {"pdf_url": "https://p/y.pdf"}},
        "10.1/b": {"_status": 404},
        "10.1/c": {"id": "W3", "best_oa_location": {"pdf_url": " ", "landing_page_url": "https://l"}, "locations": [{"pdf_url": "https://n", "is_oa": False}, {"pdf_url": "https://o", "is_oa": True}], "ids": {"arxiv": "https://arxiv.org/abs/2101.00001v2"}},
    }
    for doi, work in works.items():
        (tmp_path / f"{hashlib.sha256(doi.encode()).hexdigest()}.json").write_text(json.dumps(work))
    (tmp_path / f"{'0' * 64}.json").write_text("{broken")
    dois = spark.createDataFrame([(d, i) for i, d in enumerate([*works, "10.1/z"])], "doi string, seq int")
    got = {r["doi"]: (r["cache_state"], r["pdf_url"], r["source"], r["arxiv_id"]) for r in resolve.resolve_dois(dois, files.read_work_cache(spark, str(tmp_path))).collect()}
    assert got["10.1/a"] == ("resolved", "https://b/x.pdf", "best_oa_location", None)
    assert got["10.1/b"][0] == "missing" and got["10.1/z"][0] == "uncached"
    assert got["10.1/c"] == ("resolved", "https://o", "locations", "2101.00001")


def test_file_listing_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"123")
    (tmp_path / "in" / "a.txt").write_bytes(b"1")
    assert [tuple(r) for r in files.list_files(spark, str(tmp_path / "in"), "*.pdf").collect()] == [("a.pdf", "a", 3)]
    files.write_unique_lines(spark.createDataFrame([("b",), ("a",), ("b",)], "v string"), "v", str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]
