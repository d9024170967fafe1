from pyspark.sql import functions as F

from citeloom.operators.chunking import chunk_sections, extract_sections, text_windows

TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0">{}</TEI>'


def sections_of(spark, xml):
    row = spark.createDataFrame([(xml,)], "x string").select(extract_sections("x").alias("s")).first()["s"]
    return [(s["title"], s["text"]) for s in row["sections"]], row["error"]


def test_window_sizes_and_overlap():
    text = " ".join(f"token{i:04d}" for i in range(900))
    found = list(text_windows(text, 1200, 200))
    assert all(len(w["text"]) <= 1200 for w in found)
    for left, right in zip(found, found[1:]):
        assert set(left["text"].split()) & set(right["text"].split())
    assert found[-1]["char_end"] == len(text)
    for w in found:
        assert text[w["char_start"] : w["char_end"]].strip() == w["text"]


def test_window_without_blanks():
    assert [w["text"] for w in text_windows("a" * 25, 10, 3)] == ["a" * 10, "a" * 10, "a" * 10, "a" * 4]


def test_chunk_index_runs_over_sections(spark):
    rows = [("d", "a", "t", [("One", "x " * 900), (" ", "short"), ("Empty", "  "), ("Last", None)])]
    df = spark.createDataFrame(rows, "doc_id string, arxiv_id string, title string, sections array<struct<title:string,text:string>>")
    got = chunk_sections(df).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == [0, 1, 2]
    assert [r["section_title"] for r in got] == ["One", "One", "Untitled"]
    assert got[2]["chunk_id"] == "d:2"


def test_tei_shapes(spark):
    abstract = "<teiHeader><profileDesc><abstract><p>A  b</p><p>c</p></abstract></profileDesc></teiHeader>"
    body = "<text><body><div><head>Intro</head><p>x <b>y</b></p><p>z</p></div><div><p>w</p></div></body></text>"
    assert sections_of(spark, TEI.format(abstract))[0] == [("Abstract", "A b\n\nc")]
    assert sections_of(spark, TEI.format(abstract + body))[0] == [
        ("Abstract", "A b\n\nc"), ("Intro", "x y\n\nz"), ("Section 2", "w"),
    ]
    loose = TEI.format("<text><body><p>one</p><p>two</p></body></text>")
    assert sections_of(spark, loose)[0] == [("Body", "one\n\ntwo")]
    assert sections_of(spark, TEI.format("<text/>"))[0] == []
    assert sections_of(spark, "  ") == ([], None)
    assert sections_of(spark, "<TEI")[1].startswith("unreadable full text")
