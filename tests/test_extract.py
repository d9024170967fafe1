from citeloom.operators import extract
from pyspark.sql import functions as F


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def test_paper_mentions(spark):
    text = (
        "https://arxiv.org/abs/2104.00680v2, http://arxiv.org/pdf/1911.11763.pdf arXiv: 2103.00020 arxiv CS/9901001v2;"
        " arXiv:2104.00680v2"
    )
    got = one(spark, text, extract.paper_mentions)
    assert [m["paper_id"] for m in got] == ["2104.00680v2", "1911.11763", "2103.00020", "cs/9901001v2", "2104.00680v2"]
    assert [m["version"] for m in got] == [2, None, None, 2, 2]


def test_doi_mentions(spark):
    text = "(https://doi.org/10.1145/3366423.3380211). doi: 10.1000/ABC; see 10.5555/x,y and a10.1234/no"
    assert [m["doi"] for m in one(spark, text, extract.doi_mentions)] == ["10.1145/3366423.3380211", "10.1000/abc", "10.5555/x"]


def test_page_links(spark):
    html = (
        '<a href="https://doi.org/10.1/A">1</a><a href="https://doi.org/10.1/A">2</a><!-- <a href="x.pdf"> --><a href="paper.pdf#p">'
        "<a href='https://arxiv.org/abs/2101.00001v3'><a href=\"mailto:x\">doi:10.2222/B."
    )
    pages = spark.createDataFrame([("http://h.org/d/i.html", html)], "page_url string, html string")
    got = {(r["kind"], r["normalized_value"], r["context"]) for r in extract.mine_pages(pages).collect()}
    assert got == {
        ("doi", "10.1/a", "href"), ("pdf", "http://h.org/d/paper.pdf", "href"), ("arxiv", "2101.00001", "href"), ("doi", "10.2222/b", "text"),
    }


def test_absolute_urls(spark):
    base = "http://h.org/a/b/c.html?q=1#f"
    cases = {
        "x": "http://h.org/a/b/x", "../x": "http://h.org/a/x", "/x?y": "http://h.org/x?y", "?z": "http://h.org/a/b/c.html?z",
        "//o.org/p": "http://o.org/p", "#t": "http://h.org/a/b/c.html?q=1", "ftp://o/p": None, "./../../../x": "http://h.org/x",
    }
    df = spark.createDataFrame([(base, h) for h in cases], "b string, h string")
    got = {r["h"]: r["u"] for r in df.select("h", extract.absolute_url("b", "h").alias("u")).collect()}
    assert got == cases
