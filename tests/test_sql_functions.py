
from citeloom.functions import sql
from citeloom.operators.extract import mine_texts


def test_table_functions(spark):
    sql.register(spark)
    text = "See https://doi.org/10.1145/AB.1). arXiv:2104.00680v02 and CS: arxiv CS/9901001 doi: 10.5555/x"
    spark.createDataFrame([("r", "u", "f", text), ("r", "u", "g", "none")], "source_repo string, source_url string, found_in string, text string") \
        .createOrReplaceTempView("texts")
    got = spark.sql("SELECT kind, value, raw_match, position FROM texts, LATERAL extract_references(texts.text)").collect()
    want = mine_texts(spark.table("texts")).select("kind", "value", "raw_match", "position").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 4
    chunks = spark.sql("SELECT c.* FROM texts, LATERAL chunk_text(texts.text, 40, 5) c").collect()
    assert len(chunks) > 2 and all(len(c["text"]) <= 40 for c in chunks)
    rows = spark.sql("SELECT concat_ws('-', source_repo, found_in) AS doc_id, text FROM texts UNION ALL SELECT 'empty', '' UNION ALL SELECT 'null', NULL")
    rows.createOrReplaceTempView("keyed")
    whole = spark.sql("SELECT * FROM chunk_texts(TABLE(keyed))").collect()
    assert sorted((r.doc_id, r.chunk_index, r.text) for r in whole) == [("r-f", 0, " ".join(text.split())), ("r-g", 0, "none")]
