import uuid

from pyspark.sql import functions as F

from citeloom.functions import ids, scoring, text


def values(spark, inputs, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_paper_ids(spark):
    raw = [
        "2104.00680v2", "arXiv:2104.00680", "https://arxiv.org/abs/2104.00680v3", "http://arxiv.org/pdf/2104.00680v1.pdf",
        " cs/9901001v2 ", "https://arxiv.org/pdf/cs/9901001.pdf?x=1#y", "https://arxiv.org/abs/2104.00680v2/", "",
    ]
    assert values(spark, raw, ids.normalize_paper_id) == [
        "2104.00680", "2104.00680", "2104.00680", "2104.00680", "cs/9901001", "cs/9901001", "2104.00680", "",
    ]
    assert values(spark, raw, ids.paper_version) == ["v2", None, "v3", "v1", "v2", None, "v2", None]


def test_dois(spark):
    raw = ["https://doi.org/10.1145/AB.1).", "doi: 10.5/x>", "http://dx.doi.org/10.1/Q'", "10.1/a(b)"]
    assert values(spark, raw, ids.normalize_doi) == ["10.1145/ab.1", "10.5/x", "10.1/q", "10.1/a(b"]


def test_curatable_ids(spark):
    good = ["2104.00680", "arXiv:2104.00680v2", "cs/9901001", "cs.CV/9901001v1", "10.1145/3366423.3380211", "doi:10.1/x y"[:10]]
    bad = ["", "doi:x", "url:abc"]
    assert values(spark, good[:5] + bad, ids.is_curatable) == [True] * 5 + [False] * 3


def test_point_id_is_uuid5(spark):
    known = str(uuid.uuid4())
    raw = ["axv:1:0", "axv:é:1", known]
    assert values(spark, raw, ids.vector_point_id) == [
        str(uuid.uuid5(uuid.NAMESPACE_URL, "axv:1:0")), str(uuid.uuid5(uuid.NAMESPACE_URL, "axv:é:1")), known,
    ]


def test_authors_and_summary(spark):
    assert values(spark, ['["A B", "C"]', "A, B ,,C", None], text.parse_authors) == [["A B", "C"], ["A", "B", "C"], []]
    assert values(spark, ["arXiv:1v1 Abstract: we  do\nit"], text.feed_summary) == ["we do it"]


def test_index_tokens_fold_accents(spark):
    assert values(spark, ["Élan naïve ß-1"], text.index_tokens) == [["elan", "naive", "ß", "1"]]
    assert values(spark, ["Élan naïve"], text.query_tokens) == [["lan", "na", "ve"]]


def test_priority_example(spark):
    row = spark.createDataFrame([("curated_repo", 1.0, "arxiv_versioned", 0, 2)], "s string, c double, k string, a int, r int")
    assert abs(row.select(scoring.queue_priority("s", "c", "k", "a", "r")).first()[0] - 1.35) < 1e-9


def test_tiers(spark):
    rows = [(350, 2021, True, 1), (35, 2022, False, 1), (2, 2025, False, 0)]
    df = spark.createDataFrame(rows, "c int, y int, v boolean, p int")
    assert [r[0] for r in df.select(scoring.quality_tier("c", "y", "v", "p", 2025)).collect()] == [0, 1, 2]


def test_run_id_ignores_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert spark.createDataFrame([(1706745599,)], "t long").select(ids.run_id_at("t")).first()[0] == "20240131T235959Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
