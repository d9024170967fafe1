"""Runs and their by-products: rejects, page totals, mergeable counts, exports, line selections, prompts, table functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom.checks import Registry, inputs as I
from citeloom.checks.answering import LIST_CTES, order_questions, ranked_hits
from citeloom.checks.discovery import MENTION_CTES, reference_texts
from citeloom.checks.selection import _SELECT_CTES, RESOLVE_CTES, dois, feed, requests, stored_papers, work_cache
from citeloom.functions import sql
from citeloom.operators import extract, prompts, resolve, route
from citeloom.plans import corpus_jobs
from citeloom.session import materialize, shared_path
from citeloom.sources import files

CHECKS = Registry()


# --- rejects ---------------------------------------------------------------------------------------------------

_LINE = """case doc_id % 7 when 3 then '{"ref_type": "arxiv", "normalized_value": ' when 5 then 'no json ' || doc_id
  else '{"ref_type":"arxiv","normalized_value":"' || doc_id || '","source_kind":"' || source || '","source_ref":"r","discovered_at_unix":' || doc_id || '}' end"""


@CHECKS.query(f"""select case when doc_id % 7 in (3, 5) then 'rejected' else 'read' end as kind,
    case when doc_id % 7 in (3, 5) then {_LINE} else cast(doc_id as varchar) end as text, count(*) as n from documents group by 1, 2""")
def rejected_lines(spark, sf_dir):
    """Lines that do not fit go to a reject table with file and line number; good rows are unaffected."""
    landed, rejects = shared_path(spark, "landed"), shared_path(spark, "rejects")
    I.table(spark, sf_dir, "documents").select(F.expr(_LINE).alias("value")).write.text(landed)
    good = files.read_references_checked(spark, landed, rejects)
    bad = spark.read.schema("file string, line_no long, line string").json(rejects).where("line_no >= 1 and file <> ''")
    rows = good.select(F.lit("read").alias("kind"), F.col("normalized_value").alias("text")).unionByName(
        # Lines lose blanks at their ends when they are read.
        bad.select(F.lit("rejected").alias("kind"), F.when(F.col("line").startswith("{"), F.concat("line", F.lit(" "))).otherwise(F.col("line")).alias("text"))
    )
    return rows.groupBy("kind", "text").agg(F.count(F.lit(1)).alias("n"))


# --- totals ----------------------------------------------------------------------------------------------------


@CHECKS.query("""select count(*) as pages_requested, count(*) filter (ok) as pages_ok, count(*) filter (not ok) as pages_failed
    from (select url, bool_or(page_id % 9 <> 0 and page_id % 11 <> 0 and trim(html) <> '') as ok from pages where url is not null group by url) p""")
def discovery_page_totals(spark, sf_dir):
    """requested pages, of which some did not land and some landed blank."""
    pages = I.table(spark, sf_dir, "pages").select(F.col("url").alias("page_url"), "html", "page_id")
    landed = pages.where("page_id % 11 <> 0").withColumn("html", F.when(F.col("page_id") % 9 == 0, F.lit(" ")).otherwise(F.col("html")))
    return extract.page_totals(pages, landed)


@CHECKS.query(I.with_sql(**MENTION_CTES) + "select kind, count(*) as total, true as within_error from mentions group by kind")
def run_unique_totals(spark, sf_dir):
    """distinct mentions over all runs (one per source) from stored sketches, held against the exact number."""
    mined = extract.mine_texts(reference_texts(spark, sf_dir)).withColumnRenamed("source_repo", "run_id")
    estimated = extract.unique_totals(materialize(extract.run_sketches(mined), "run-sketches"))
    exact = mined.groupBy("kind").agg(F.count_distinct("base_id").alias("n"))
    # Four standard errors of 0.8 percent.
    near = F.abs(F.col("unique_estimate") - F.coalesce("n", F.lit(0))) <= F.greatest(0.033 * F.col("n"), F.lit(1.0))
    return mined.groupBy("kind").agg(F.count(F.lit(1)).alias("total")).join(exact, "kind").join(estimated.drop("total"), "kind", "left").select(
        "kind", "total", F.coalesce(near, F.col("n") == 0).alias("within_error")
    )


# --- exports and selections --------------------------------------------------------------------------------------


@CHECKS.query(I.with_sql(**RESOLVE_CTES) + "select doi, openalex_id, arxiv_id, pdf_url, source, 'today' as fetched_at from resolved where cache_state = 'resolved'")
def exported_records(spark, sf_dir):
    """Resolved DOIs written in the nine fields of their export and read back."""
    path = shared_path(spark, "export")
    rows = files.resolved_export(resolve.resolve_dois(dois(spark, sf_dir), work_cache(spark, sf_dir)), "today")
    assert len(rows.columns) == 9
    files.write_export(rows, path)
    return spark.read.schema(rows.schema).json(path).select("doi", "openalex_id", "arxiv_id", "pdf_url", "source", "fetched_at")


@CHECKS.query("""select 'p' || (event_id * 7) % 3001 as arxiv_id, event_type as title, props as summary, 1 as n_authors from events""")
def exported_metadata(spark, sf_dir):
    """Metadata of papers written with all its fields and read back."""
    path = shared_path(spark, "metadata")
    rows = files.metadata_export(feed(spark, sf_dir))
    files.write_export(rows, path)
    return spark.read.schema(rows.schema).json(path).select("arxiv_id", "title", "summary", F.size("authors").alias("n_authors"))


_TAKEN = 200


@CHECKS.query(I.with_sql(**(_SELECT_CTES | {"raw": f"select * from ({_SELECT_CTES['raw']}) r order by seq limit {_TAKEN}"}))
              + "select requested_id, arxiv_id_with_version from remaining")
def jsonl_selection(spark, sf_dir):
    """Ids of JSON lines, the first ones in the order of the lines, against stored papers."""
    line = F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(F.col("raw_id").alias("arxiv_id")))).otherwise(F.concat(F.lit('"'), "raw_id", F.lit('"')))
    lines = requests(spark, sf_dir).select(line.alias("line"), "seq")
    # Ids of the lines differ, so the first different ids are the first lines.
    chosen, _ = corpus_jobs.select_from_lines(lines, feed(spark, sf_dir), stored_papers(spark, sf_dir), _TAKEN)
    return chosen.papers.select("requested_id", "arxiv_id_with_version")


# --- prompts -----------------------------------------------------------------------------------------------------


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def _by_mode(texts: dict[str, str]) -> str:
    return "case mode " + " ".join(f"when '{name}' then {_text(text)}" for name, text in texts.items()) + " end"


_MODES = list(prompts.FOCUS)
_MODE = "list_extract([" + ", ".join(f"'{m}'" for m in _MODES) + f"], cast(query_id % {len(_MODES)} as int) + 1)"
_SOURCES = """string_agg('[S' || rank || ']' || chr(10) || 'arxiv_id: ' || arxiv_id || chr(10) || 'title: T' || chr(10) || 'section: ' || section_title
    || chr(10) || 'text: ' || status || chr(10) || chr(10), '' order by rank)"""
_ANSWER_CTES = {
    **LIST_CTES, "blocks": f"select query_id, count(*) as source_count, {_SOURCES} as sources from hits group by query_id",
    "routed": f"""select query_id, query, {_MODE} as mode, case when query_id % 3 = 0 then 'preface ' || query_id when query_id % 3 = 1 then '' end as preface
      from asked""",
    "answers": f"""select query_id, source_count, {_text(prompts.ROLE + chr(10) + 'Prompt policy: v2. ')} || {_by_mode(prompts.FOCUS)} || chr(10) || chr(10)
      || 'Question:' || chr(10) || query || chr(10) || chr(10) || 'Sources:' || chr(10) || sources || {_by_mode(prompts.MODE_INSTRUCTIONS)} || chr(10) || chr(10)
      || {_text(prompts.MODE_RULES)} || case when coalesce(preface, '') <> '' then {_text(prompts.PREFACE_RULE)} || '"' || preface || '"' else '' end
      || chr(10) || chr(10) || {_text(prompts.FORMAT_HEAD.format(lists=''))}
      || case when mode in ({', '.join(_text(m) for m in prompts.GROUPED_MODES)}) then {_text(prompts.GROUPED)} else '' end || {_text(prompts.FORMAT_TAIL)} as prompt
      from routed join blocks using (query_id)""",
}


def routed(spark, sf_dir):
    mode = F.get(F.array(*map(F.lit, _MODES)), (F.col("query_id") % len(_MODES)).cast("int"))
    preface = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("preface "), F.col("query_id").cast("string"))).when(F.col("query_id") % 3 == 1, "")
    return order_questions(spark, sf_dir).withColumns({"mode": mode, "preface": preface})


def _answers(spark, sf_dir):
    return prompts.answer_prompts(routed(spark, sf_dir), ranked_hits(spark, sf_dir))


@CHECKS.query(I.with_sql(**_ANSWER_CTES) + "select * from answers")
def answer_prompts(spark, sf_dir):
    """The prompt of every routed question."""
    return _answers(spark, sf_dir)


@CHECKS.query(I.with_sql(**_ANSWER_CTES) + f"""select query_id, source_count, {_text(prompts.ROLE)} || chr(10) || chr(10) || 'Question:' || chr(10) || query || chr(10)
    || chr(10) || 'Sources:' || chr(10) || sources || {_text(prompts.STRICT_RULES)} || chr(10) || chr(10)
    || {_text(prompts.FORMAT_HEAD.format(lists=', no bullet lists') + prompts.FORMAT_TAIL)} as prompt from asked join blocks using (query_id)""")
def strict_prompts(spark, sf_dir):
    """The strict prompt of every question."""
    return prompts.strict_prompts(order_questions(spark, sf_dir), ranked_hits(spark, sf_dir))


@CHECKS.query(I.with_sql(**_ANSWER_CTES) + f"""select query_id, prompt || {_text(prompts.REPAIR_HEAD)} || 'draft ' || query_id || {_text(prompts.REPAIR_TAIL)} as prompt
    from answers""")
def repair_prompts(spark, sf_dir):
    """The prompt that asks to rewrite a draft."""
    draft = F.concat(F.lit("draft "), F.col("query_id").cast("string"))
    return _answers(spark, sf_dir).select("query_id", prompts.repair_prompt("prompt", draft).alias("prompt"))


_ROUTER_HEAD = (
    prompts.ROUTER_HEAD.format(modes=", ".join(_MODES)) + prompts.ROUTER_BODY + "\nOutput schema:\n"
    + prompts.ROUTER_SCHEMA.format(modes="|".join(_MODES)) + "\n\nQuestion: "
)


@CHECKS.query(I.with_sql(**LIST_CTES, docs="select query_id, arxiv_id, max(fused_score) as best, count(*) as n from hits group by 1, 2",
                         placed="select *, row_number() over (partition by query_id order by best desc, n desc, arxiv_id) as position from docs",
                         named="select query_id, string_agg(arxiv_id, ',' order by position) as papers from placed where position <= 6 group by query_id")
              + f"""select query_id, {_text(_ROUTER_HEAD)} || query || chr(10) || chr(10) || 'Retrieved source summary (top docs):' || chr(10) as head,
    coalesce(papers, '') as papers from asked left join named using (query_id)""")
def router_prompts(spark, sf_dir):
    """The routing prompt of every question, its summary read back as the papers that it lists."""
    made = prompts.router_prompts(order_questions(spark, sf_dir), route.summarize_sources(ranked_hits(spark, sf_dir)))
    at = F.instr("prompt", "(top docs):") + F.lit(len("(top docs):"))
    listed = F.from_json(F.substr("prompt", at + 1), "array<struct<arxiv_id: string>>")
    return made.select("query_id", F.substr("prompt", F.lit(1), at).alias("head"), F.array_join(listed["arxiv_id"], ",").alias("papers"))


# --- table functions ---------------------------------------------------------------------------------------------


@CHECKS.query(I.with_sql(**{**I.CHUNK_CTES, "lines": "select doc_id, source, 1 as section_no, text as line from documents"})
              + "select chunk_id, text, char_start from chunks")
def sql_chunks(spark, sf_dir):
    """O: the chunks of all documents by the table function."""
    sql.register(spark)
    view = f"texts_{uuid.uuid4().hex}"
    key = F.concat(F.lit("axv:"), F.expr(I.paper_id()), F.lit("v1"))
    I.table(spark, sf_dir, "documents").select(key.alias("doc_id"), "text").createOrReplaceTempView(view)
    return spark.sql(f"select concat(doc_id, ':', chunk_index) as chunk_id, text, char_start from chunk_texts(TABLE({view}))")
