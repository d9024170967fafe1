"""The given tables read as the tables of a literature corpus, in Spark and as SQL for the oracle.

Ids, section titles, tiers and source classes are derived from existing columns; no rows are added or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.chunking import chunk_sections
from citeloom.operators.hybrid import Corpus
from citeloom.operators.lexical import corpus_statistics, forward_index
from citeloom.session import materialize

SECTION_TITLES = ("Introduction", "Method", "Experiments", "Results", "Conclusion")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table for work that is heavy per byte, as on its whole texts. One row group is one task, so a table
    of fewer splits than cores is spread over them first; a table with enough splits is read as it lies, without a shuffle of its texts."""
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def with_sql(**ctes: str) -> str:
    return "with recursive " + ",\n".join(f"{name} as ({body})" for name, body in ctes.items()) + "\n"


def epoch(c: str) -> Column:
    """Seconds of a zone-less time read as UTC, whatever the time zone of the session."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


# What no XML 1.0 text can hold, and the noncharacters that stand for it, one for one, so that cuts by length stay. Unicode keeps
# them for such inner use; a text that holds them itself would not come back as it was.
_NOT_XML = "".join(map(chr, [*range(9), 0x0B, *range(0x0E, 0x20), 0xFFFE, 0xFFFF]))
_STAND_IN = "".join(chr(0xFDD0 + i) for i in range(len(_NOT_XML)))
_BLANK = chr(0xFDD0 + len(_NOT_XML))


def xml_text(c: str) -> Column:
    """A column as it stands inside an XML document; ``of_xml`` reads it back. A form feed becomes the blank that it counts as."""
    text = F.when(F.col(c).rlike(f"[{_NOT_XML[:-2]}\f{_NOT_XML[-2]}-{_NOT_XML[-1]}]"), F.translate(c, _NOT_XML + "\f", _STAND_IN + " ")).otherwise(F.col(c))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def xml_paragraph(c: str) -> Column:
    """``xml_text`` that is never blank, so that it stays a paragraph: blank text and null become a mark, which ``of_xml`` drops."""
    return F.when(holds_text(c), xml_text(c)).otherwise(_BLANK)


def holds_text(c: str) -> Column:
    """Whether ``xml_text`` holds more than white space; a vertical tab is none, as it travels as another character."""
    return F.col(c).rlike(r"(?U)[\S\x0B]")


def of_xml(c: str) -> Column:
    # translate() would drop what it turns into a zero, so the first character goes its own way.
    back = F.replace(F.translate(c, _STAND_IN[1:] + _BLANK, _NOT_XML[1:]), F.lit(_STAND_IN[0]), F.lit(_NOT_XML[0]))
    return F.when(F.col(c).rlike(f"[{_STAND_IN[0]}-{_BLANK}]"), back).otherwise(F.col(c))


# The same text runs in both engines. The id grammar has room for 799,900,000 papers; larger tables repeat ids.
PAPER_ID = (
    "concat(lpad(cast(2001 + cast(floor({0} / 100000) as bigint) % 7999 as string), 4, '0'), '.',"
    " lpad(cast({0} % 100000 as string), 5, '0'))"
)
TIER = "case when quality = 1 then 0 when toxic = 1 then 2 else 1 end"
SOURCE_KIND = (
    "case when source in ('src0', 'src1', 'src2', 'src3') then 'curated_repo'"
    " when source in ('src4', 'src5', 'src6', 'src7') then 'arxiv_feed'"
    " when source in ('src8', 'src9', 'src10', 'src11') then 'openalex_resolved' else 'scraped_pdf' end"
)
PROVENANCE = (
    "case when source in ('src0', 'src1', 'src2', 'src3') then 'curated'"
    " when source in ('src4', 'src5', 'src6', 'src7', 'src8', 'src9', 'src10', 'src11') then 'canonical_api'"
    " else 'scraped' end"
)


def paper_id(c: str = "doc_id") -> str:
    return PAPER_ID.format(c)


def documents_as_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its lines as sections, spread over the cores."""
    return as_papers(text_table(spark, sf_dir, "documents"))


def as_papers(documents: DataFrame) -> DataFrame:
    """Rows of the table of documents as papers, each read where it lies."""
    lines = F.split("text", "\n")
    titles = F.array(*[F.lit(t) for t in SECTION_TITLES])
    sections = F.transform(
        lines,
        lambda line, i: F.struct(F.get(titles, i % len(SECTION_TITLES)).alias("title"), line.alias("text")),
    )
    return (
        documents.withColumn("arxiv_id", F.expr(paper_id()))
        .select(
            F.concat(F.lit("axv:"), "arxiv_id", F.lit("v1")).alias("doc_id"), "arxiv_id",
            F.concat_ws(" ", F.lit("Paper"), "doc_id", "source").alias("title"), sections.alias("sections"),
        )
    )


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_sections(documents_as_papers(spark, sf_dir))


_TITLES_SQL = "[" + ", ".join(f"'{t}'" for t in SECTION_TITLES) + "]"
_END = """case when {st} + 1200 >= length(t) then length(t)
  when instr(reverse(substr(t, {st} + 601, 600)), ' ') = 0 then {st} + 1200
  else {st} + 1200 - instr(reverse(substr(t, {st} + 601, 600)), ' ') end"""
_NEXT = "greatest(en - 200, st + 1) + case when substr(t, greatest(en - 200, st + 1) + 1, 1) = ' ' then 1 else 0 end"

LINES_SQL = """select doc_id, source, i as section_no, arr[i] as line
  from (select doc_id, source, string_split(text, chr(10)) as arr from documents) d, unnest(range(1, len(arr) + 1)) u(i)"""
NORMALIZED_SQL = (
    "select doc_id, source, section_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) as t from lines"
    " where trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''"
)
WINDOWS_SQL = f"""select doc_id, source, section_no, t, cast(0 as bigint) as st, cast({_END.format(st='0')} as bigint) as en
    from normalized
  union all
  select doc_id, source, section_no, t, st, cast({_END.format(st='st')} as bigint) as en from (
    select doc_id, source, section_no, t, {_NEXT} as st from windows where en < length(t)) n where st < length(t)"""
CHUNKS_SQL = f"""select concat('axv:', {paper_id()}, 'v1:', cast(row_number() over w - 1 as string)) as chunk_id,
    concat('axv:', {paper_id()}, 'v1') as doc_id, {paper_id()} as arxiv_id,
    concat('Paper ', doc_id, ' ', source) as title, {_TITLES_SQL}[cast((section_no - 1) % 5 + 1 as int)] as section_title,
    row_number() over w - 1 as chunk_index, trim(substr(t, st + 1, en - st)) as text,
    st as char_start, en as char_end
  from windows where trim(substr(t, st + 1, en - st)) <> '' window w as (partition by doc_id order by section_no, st)"""
CHUNK_CTES = {"lines": LINES_SQL, "normalized": NORMALIZED_SQL, "windows": WINDOWS_SQL, "chunks": CHUNKS_SQL}

TOKENS_SQL = r"""select chunk_id, unnest(regexp_extract_all(strip_accents(lower(
    concat_ws(' ', arxiv_id, title, section_title, text))), '[\p{L}\p{N}]+')) as term from chunks"""
LENGTHS_SQL = "select chunk_id, count(*) as n_tokens from tokens group by chunk_id"
STATS_SQL = "select (select count(*) from chunks) as n_chunks, (select count(*) from tokens) as total_tokens"
POSTINGS_SQL = "select term, chunk_id, count(*) as tf from tokens group by term, chunk_id"
QTERMS_SQL = r"""select query_id, lower(token) as prefix, count(*) as repeats from (
    select query_id, unnest(regexp_extract_all(query, '[A-Za-z0-9]+')) as token from queries) q group by 1, 2"""
HITS_SQL = """select prefix, chunk_id, sum(tf) as tf from (
    select p.prefix, v.term from (select distinct prefix from qterms) p, (select distinct term from postings) v
    where starts_with(v.term, p.prefix)) m join postings using (term) group by prefix, chunk_id"""
KEYWORD_SQL = """select query_id, chunk_id, round(-sum(repeats * greatest(ln((n_chunks - df + 0.5) / (df + 0.5)), 1e-6)
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / (total_tokens / n_chunks)))), 9) as score
    from qterms join (select prefix, count(*) as df from prefix_hits group by prefix) d using (prefix)
      join prefix_hits using (prefix) join lengths using (chunk_id), stats
    group by query_id, chunk_id"""
KEYWORD_RANKED_SQL = "select *, row_number() over (partition by query_id order by score, chunk_id) as rank from keyword"
LEXICAL_CTES = {
    "tokens": TOKENS_SQL, "lengths": LENGTHS_SQL, "stats": STATS_SQL, "postings": POSTINGS_SQL, "qterms": QTERMS_SQL,
    "prefix_hits": HITS_SQL, "keyword": KEYWORD_SQL, "keyword_ranked": KEYWORD_RANKED_SQL,
}
VECTOR_RANKED_SQL = f"""select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (
    select query_id, concat('axv:', {paper_id('vec_id')}, 'v1:0') as chunk_id,
      round(list_cosine_similarity(vector, cast(embedding as double[])), 9) as score
    from queries, embeddings where vec_id in (select doc_id from documents)) s"""


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query, with the vector of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return (
        table(spark, sf_dir, "benchmark")
        .join(vectors, "item_id")
        .select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "vector")
    )


QUERIES_SQL = """select item_id as query_id, text as query, cast(embedding as double[]) as vector
    from benchmark join embeddings on item_id = vec_id"""


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding belongs to the first chunk of its document."""
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return (
        table(spark, sf_dir, "embeddings")
        .join(known, "vec_id", "left_semi")
        .select(F.concat(F.lit("axv:"), F.expr(paper_id("vec_id")), F.lit("v1:0")).alias("chunk_id"), "embedding")
    )


def tier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.expr(paper_id()).alias("arxiv_id"), F.expr(TIER).alias("tier"))


def provenance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("axv:"), F.expr(paper_id()), F.lit("v1")).alias("doc_id"),
        F.expr(PROVENANCE).alias("provenance_kind"),
    )


TIERS_SQL = f"select {paper_id()} as arxiv_id, {TIER} as tier from labels"
PROVENANCE_SQL = f"select concat('axv:', {paper_id()}, 'v1') as doc_id, {PROVENANCE} as provenance_kind from documents"


_STORES: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The stores of a table folder: index, statistics. An application builds them once; its searches share them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = build_corpus(spark, sf_dir)
    return _STORES[key]


def build_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The index is the one copy of the texts that is stored, written by the tasks that cut them; the few chunks that are hits are cut again."""
    chunks = chunk_table(spark, sf_dir)
    index = materialize(forward_index(chunks), "index")
    return Corpus(
        chunks=chunks, vectors=vector_table(spark, sf_dir), index=index,
        statistics=materialize(corpus_statistics(index), "statistics"),
        tiers=tier_table(spark, sf_dir), provenance=provenance_table(spark, sf_dir), papers=as_papers(table(spark, sf_dir, "documents")),
    )


FUSED_SQL = """select query_id, chunk_id, min(vrank) as vrank, min(krank) as krank, min(vscore) as vscore, min(kscore) as kscore
    from (select query_id, chunk_id, rank as vrank, null as krank, score as vscore, null as kscore from vector_ranked
      where rank <= {k}
    union all select query_id, chunk_id, null, rank, null, score from keyword_ranked where rank <= {k}) u
    group by query_id, chunk_id"""
BOOSTED_SQL = """select f.*, c.doc_id, c.arxiv_id, c.title, c.section_title, c.text,
      coalesce(1.0::double / (60 + vrank), 0) + coalesce(1.0::double / (60 + krank), 0)
      + case when {boost}::double > 0 and regexp_matches(c.title || chr(10) || c.section_title,
          '(?i)(method|approach|implementation|supervision|loss|training|optimal matching|experiments?|ablation|results?)')
          then {boost}::double else 0::double end
      + case coalesce(t.tier, 2) when 0 then 0.25::double when 1 then 0.1::double else 0::double end
      + case p.provenance_kind when 'curated' then 0.08::double when 'canonical_api' then 0.05::double
          when 'scraped' then 0.02::double else 0::double end as fused_score
    from fused f join chunks c using (chunk_id) left join tiers t on t.arxiv_id = c.arxiv_id
    left join provenance p on p.doc_id = c.doc_id"""
POSITIONED_SQL = """select *, row_number() over (partition by query_id
      order by fused_score desc, vrank asc nulls last, krank asc nulls last) as position from boosted"""
QUOTA_SQL = """select *, row_number() over (partition by query_id order by position) as rank from (
      select *, row_number() over (partition by query_id, doc_id order by position) as nth from positioned) q
    where {quota} <= 0 or nth <= {quota}"""


def hybrid_ctes(k: int, boost: float, quota: int) -> dict[str, str]:
    return {
        **CHUNK_CTES, "queries": QUERIES_SQL, **LEXICAL_CTES, "vector_ranked": VECTOR_RANKED_SQL,
        "fused": FUSED_SQL.format(k=k), "tiers": TIERS_SQL, "provenance": PROVENANCE_SQL,
        "boosted": BOOSTED_SQL.format(boost=boost), "positioned": POSITIONED_SQL, "ranked": QUOTA_SQL.format(quota=quota),
    }


# Text that mentions papers and DOIs, the same expression in both engines.
REF_TEXT = (
    "concat('See https://doi.org/10.', cast(1000 + doc_id % 9000 as string), '/ab', cast(doc_id as string),"
    " ', arXiv:', lpad(cast(2001 + cast(floor(doc_id / 100000) as bigint) % 7999 as string), 4, '0'), '.', lpad(cast(doc_id % 100000 as string), 5, '0'),"
    " 'v', cast(1 + doc_id % 3 as string), ' and doi: 10.5555/X', cast(doc_id % 7 as string), ').',"
    " ' PDF https://arxiv.org/pdf/', lpad(cast(1001 + doc_id % 11 as string), 4, '0'), '.', lpad(cast(doc_id % 13 as string), 5, '0'),"
    " '.pdf and https://arxiv.org/abs/cs/', lpad(cast(doc_id % 1000 as string), 7, '0'), 'v2. ', text)"
)
