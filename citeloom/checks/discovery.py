"""Mining texts and pages for references, and the line-list sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.checks import Registry, inputs as I
from citeloom.operators import extract
from citeloom.operators.ordered import ranked_counts
from citeloom.operators.resolve import sorted_unique
from citeloom.plans import corpus_jobs
from citeloom.sources import files

CHECKS = Registry()

_BASE = r"(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z-]+)?/\d{7})"
_PAPER = (
    rf"(?i)https?://arxiv\.org/abs/{_BASE}(?:v\d+)?\b|https?://arxiv\.org/pdf/{_BASE}(?:v\d+)?\.pdf\b"
    rf"|\barxiv(?:\s*:\s*|\s+){_BASE}(?:v\d+)?\b"
)
_CORE = r"10\.\d{4,9}/[-._;()/:A-Z0-9]+"
_DOI = rf"(?i)(?:https?://(?:dx\.)?doi\.org/|\bdoi\s*:\s*|(?:^|[^A-Za-z0-9]))({_CORE})"
_TRAIL = r"""[)\]}>,.;:"'']+$"""
MENTION_CTES = {
    "texts": f"select doc_id, source, {I.REF_TEXT} as t from documents",
    "paper_raw": f"""select doc_id, source, i - 1 as position, m[i] as raw_match from (
        select doc_id, source, regexp_extract_all(t, '{_PAPER}') as m from texts) x, unnest(range(1, len(m) + 1)) u(i)""",
    "paper_mentions": rf"""select doc_id, source, position, raw_match,
        case when contains(b, '/') then lower(b) else b end as base_id,
        case when contains(b, '/') then lower(b) else b end || coalesce('v' || try_cast(nullif(regexp_extract(raw_match, '(?i)v(\d+)(\.pdf)?$', 1), '') as int), '') as value
      from (select *, regexp_extract(raw_match, '(?i)^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv(?:\s*:\s*|\s+))({_BASE})', 1) as b from paper_raw) y""",
    "doi_mentions": rf"""select doc_id, source, position, regexp_replace(raw, '{_TRAIL}', '') as raw_match,
        lower(regexp_replace(core, '{_TRAIL}', '')) as value
      from (select doc_id, source, i - 1 as position, regexp_replace(m[i], '^[^A-Za-z0-9]', '') as raw, c[i] as core from (
        select doc_id, source, regexp_extract_all(t, '{_DOI}') as m, regexp_extract_all(t, '{_DOI}', 1) as c from texts) x,
        unnest(range(1, len(m) + 1)) u(i)) y""",
    "mentions": """select doc_id, source, 'arxiv' as kind, base_id, value, raw_match, position from paper_mentions
      union all select doc_id, source, 'doi', value, value, raw_match, position from doi_mentions""",
}


def reference_texts(spark, sf_dir):
    """Documents as READMEs of their source, with mentions in front of the text."""
    return I.text_table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_repo"), F.concat(F.lit("https://github.com/"), "source").alias("source_url"),
        F.col("doc_id").cast("string").alias("found_in"), F.expr(I.REF_TEXT).alias("text"),
    )


@CHECKS.query(I.with_sql(**MENTION_CTES) + """select source as source_repo, 'https://github.com/' || source as source_url,
    cast(doc_id as string) as found_in, kind, base_id, value, raw_match, position from mentions""")
def mined_mentions(spark, sf_dir):
    """Every paper and DOI mention of every text."""
    return extract.mine_texts(reference_texts(spark, sf_dir))


@CHECKS.query(I.with_sql(**MENTION_CTES) + "select source, kind, count(*) as n from mentions group by source, kind")
def mentions_per_source(spark, sf_dir):
    """F5."""
    mined = extract.mine_texts(reference_texts(spark, sf_dir))
    return mined.groupBy(F.col("source_repo").alias("source"), "kind").agg(F.count(F.lit(1)).alias("n"))


@CHECKS.query(I.with_sql(**MENTION_CTES) + """select value, count(*) as n from mentions where kind = 'doi' group by value
    order by n desc, value limit 10""")
def top_mentioned_dois(spark, sf_dir):
    """H7: a top-ten report."""
    return ranked_counts(extract.mine_texts(reference_texts(spark, sf_dir)).filter(F.col("kind") == "doi"), "value", 10)


@CHECKS.query(I.with_sql(**MENTION_CTES) + """select count(*) filter (kind = 'arxiv') as arxiv_total, count(*) filter (kind = 'doi') as doi_total,
    cast(0 as bigint) as pdf_total, count(distinct base_id) filter (kind = 'arxiv') as arxiv_unique,
    count(distinct base_id) filter (kind = 'doi') as doi_unique, cast(0 as bigint) as pdf_unique from mentions""")
def discovery_totals(spark, sf_dir):
    """F6."""
    return extract.discovery_totals(extract.mine_texts(reference_texts(spark, sf_dir)))


@CHECKS.query(I.with_sql(**MENTION_CTES) + "select distinct base_id from mentions where kind = 'arxiv'")
def unique_paper_ids(spark, sf_dir):
    """H8, I4: the sorted export list."""
    mined = extract.mine_texts(reference_texts(spark, sf_dir)).filter(F.col("kind") == "arxiv")
    return sorted_unique(mined, "base_id")


@CHECKS.query(I.with_sql(**MENTION_CTES) + """select kind as ref_type, value as normalized_value, 'curated_repo' as source_kind,
    'https://github.com/' || source as source_ref, cast(1700000000 as bigint) as discovered_at_unix from mentions""")
def references_from_texts(spark, sf_dir):
    """References of a text discovery run."""
    return corpus_jobs.discover_in_texts(reference_texts(spark, sf_dir), "curated_repo", 1700000000)[1]


# Pages get links to a DOI, a relative and an absolute PDF, a paper, and links that do not count.
PAGE_HTML = (
    "concat(html, '<a class=\"k\" href=\"https://doi.org/10.', cast(1000 + page_id as string), '/P%2F', cast(page_id as string),"
    " '\">d</a> <A HREF=''paper', cast(page_id % 5 as string), '.PDF#p2''>p</A><a href=\"../up/./x.pdf?v=1\">u</a>"
    "<a href=\"https://export.arxiv.org/abs/2101.', lpad(cast(page_id % 100000 as string), 5, '0'), 'v2\">x</a>"
    "<a href=\"mailto:a@b.c\">m</a><a href=\"JavaScript:void(0)\">j</a><a name=\"n\">n</a><a href=\"ftp://x.org/a.pdf\">f</a>"
    "<a href=\"//cdn.org/s.pdf\">s</a> see doi:10.7777/Q', cast(page_id as string), ').')"
)
_SQL_PAGE_HTML = PAGE_HTML.replace("\\'", "''")
PAGE_CTES = {
    "p": f"select url as page_url, {_SQL_PAGE_HTML} as html from pages",
    "anchors": r"""select page_url, i as n, m[i] as tag from (select page_url, regexp_extract_all(
        regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?i)<a\s[^>]*>') as m from p) x,
        unnest(range(1, len(m) + 1)) u(i)""",
    "raw_links": r"""select page_url, n, trim(replace(replace(replace(replace(replace(
          regexp_extract(tag, '(?i)\shref\s*=\s*"([^"]*)"', 1) || regexp_extract(tag, '(?i)\shref\s*=\s*''([^'']*)''', 1),
        '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as href from anchors""",
    "origins": r"""select page_url, n, regexp_replace(href, '#.*$', '') as href, regexp_extract(page_url, '^([a-z]+):', 1) as scheme,
        regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) as origin, regexp_extract(page_url, '^[a-z]+://[^/?#]*([^?#]*/)', 1) as folder
      from raw_links where href <> '' and not regexp_matches(href, '(?i)^(javascript|mailto):')""",
    "absolute": r"""select page_url, n, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href
        when starts_with(href, '//') then scheme || ':' || href when starts_with(href, '/') then origin || href
        when starts_with(href, '../') then origin || coalesce(nullif(regexp_replace(folder, '[^/]*/$', ''), ''), '/')
           || replace(substr(href, 4), './', '')
        else origin || folder || href end as link from origins""",
    "links": """select page_url, link, min(n) as n from absolute where regexp_matches(link, '(?i)^https?:') group by page_url, link""",
    "hosts": r"""select *, lower(regexp_extract(link, '://([^/?#]*)', 1)) as host, regexp_extract(link, '://[^/?#]*([^?#]*)', 1) as path from links""",
    "kinds": r"""select page_url, link as raw_link, n, 'href' as context,
        case when host like '%doi.org' then 'doi' when regexp_matches(path, '(?i)\.pdf$') then 'pdf'
          when host like '%arxiv.org' and regexp_matches(path, '^/(abs|pdf)/') then 'arxiv' end as kind,
        case when host like '%doi.org' then lower(url_decode(substr(path, 2))) when regexp_matches(path, '(?i)\.pdf$') then link
          else regexp_replace(regexp_replace(path, '^/(abs|pdf)/', ''), 'v\d+$', '') end as value from hosts""",
    "page_dois": rf"""select page_url, i as n, regexp_replace(regexp_replace(m[i], '^[^A-Za-z0-9]', ''), '{_TRAIL}', '') as raw_link,
        lower(regexp_replace(c[i], '{_TRAIL}', '')) as value from (select page_url, regexp_extract_all(html, '{_DOI}') as m,
        regexp_extract_all(html, '{_DOI}', 1) as c from p) x, unnest(range(1, len(m) + 1)) u(i)""",
    "found": """select page_url, kind, value, raw_link, context, n from kinds where kind is not null
      union all select page_url, 'doi', value, raw_link, 'text', 1000000 + n from page_dois""",
    "page_links": """select page_url, kind, value, arg_min(raw_link, n) as raw_link, arg_min(context, n) as context, min(n) as n
      from found group by page_url, kind, value""",
}


def landed_pages(spark, sf_dir):
    return I.text_table(spark, sf_dir, "pages").select(F.col("url").alias("page_url"), F.expr(PAGE_HTML).alias("html"))


@CHECKS.query(I.with_sql(**PAGE_CTES) + """select page_url, link,
    row_number() over (partition by page_url order by n) - 1 as position from links""")
def page_links(spark, sf_dir):
    """Absolute link targets of every page in order."""
    return extract.page_links(landed_pages(spark, sf_dir))


@CHECKS.query(I.with_sql(**PAGE_CTES) + """select page_url as source_page_url, kind, value as normalized_value, raw_link, context
    from page_links""")
def mined_pages(spark, sf_dir):
    """Classified links and text DOIs, once per page and value."""
    return extract.mine_pages(landed_pages(spark, sf_dir)).drop("position")


@CHECKS.query(I.with_sql(**PAGE_CTES) + """select case kind when 'pdf' then 'url:' || sha256(value) else 'axv:' || value end as doc_id,
    case kind when 'arxiv' then value end as arxiv_id, case kind when 'pdf' then value else 'https://arxiv.org/pdf/' || value || '.pdf' end as pdf_url,
    case kind when 'pdf' then 0.6::double else 1.0::double end as resolution_confidence,
    case kind when 'pdf' then 'scraped_pdf' else 'visionbib_page' end as source_kind
    from page_links where kind in ('pdf', 'arxiv')""")
def resolutions_from_pages(spark, sf_dir):
    """Links that resolve themselves."""
    found = corpus_jobs.discover_in_pages(landed_pages(spark, sf_dir), "visionbib_page", 1700000000)[2]
    return found.select("doc_id", "arxiv_id", "pdf_url", "resolution_confidence", "source_kind")


@CHECKS.query(I.with_sql(**PAGE_CTES) + """select case kind when 'pdf' then 'pdf_url' else kind end as ref_type, value as normalized_value,
    page_url as source_ref, count(*) as n from page_links group by all""")
def references_from_pages(spark, sf_dir):
    """References of a page discovery run."""
    found = corpus_jobs.discover_in_pages(landed_pages(spark, sf_dir), "visionbib_page", 1700000000)[1]
    return found.groupBy("ref_type", "normalized_value", "source_ref").agg(F.count(F.lit(1)).alias("n"))


@CHECKS.query("""select distinct 'https://b.org/x/' || case p_partkey % 3 when 0 then 'compute' else 'motion' end || (p_size + i) || '.html' as page_url
    from part, unnest(range(0, cast(p_partkey % 4 as bigint) + 1)) u(i)""")
def expanded_pages(spark, sf_dir):
    """Page ranges to page URLs."""
    ranges = I.table(spark, sf_dir, "part").select(
        F.lit("https://b.org/x/").alias("prefix_url"),
        F.when(F.col("p_partkey") % 3 == 0, "compute").otherwise("motion").alias("stem"), F.col("p_size").alias("start"),
        (F.col("p_size") + (F.col("p_partkey") % 4)).cast("int").alias("end"), F.col("p_partkey").alias("seq"),
    )
    return extract.expand_pages(ranges).select("page_url")


_REPO_LINE = (
    "case doc_id % 6 when 0 then concat(lang, '/', source, '.git') when 1 then concat('https://github.com/', lang, '/', source, '/tree')"
    " when 2 then concat('https://gitlab.com/', lang, '/', source) when 3 then concat(source, '/a/b') when 4 then concat(lang, ' / ', source)"
    " else concat(lang, '/', source, '?') end"
)


@CHECKS.query(
    f"""select r as repo, 'https://github.com/' || r as source_url, min(doc_id) as seq from (
      select doc_id, lang || '/' || source as r from documents where doc_id % 6 in (0, 1, 4)) x group by r"""
)
def repo_sources(spark, sf_dir):
    """Repository lines to owner/name, first spelling kept."""
    lines = I.table(spark, sf_dir, "documents").select(F.expr(_REPO_LINE).alias("line"), F.col("doc_id").alias("seq"))
    return files.repo_lines(lines)[0]


@CHECKS.query("select doc_id as seq, case doc_id % 6 when 2 then 'https://gitlab.com/' || lang || '/' || source when 3 then source || '/a/b'"
              " else lang || '/' || source || '?' end as line from documents where doc_id % 6 in (2, 3, 5)")
def repo_source_rejects(spark, sf_dir):
    """The lines that are no repository."""
    lines = I.table(spark, sf_dir, "documents").select(F.expr(_REPO_LINE).alias("line"), F.col("doc_id").alias("seq"))
    return files.repo_lines(lines)[1]


_RANGE_LINE = (
    "case p_partkey % 5 when 0 then concat('compute', p_size, ' compute', p_size + p_partkey % 9)"
    " when 1 then concat('motion  ', p_size, ' ', p_size + 3) when 2 then concat('a', p_size, ' b', p_size)"
    " when 3 then concat('stem ', p_size + 1, ' ', p_size) else 'one two' end"
)


@CHECKS.query(
    """select p_partkey as seq, case p_partkey % 5 when 0 then 'compute' else 'motion' end as stem, p_size as start,
      case p_partkey % 5 when 0 then p_size + p_partkey % 9 else p_size + 3 end as "end" from part where p_partkey % 5 in (0, 1)"""
)
def page_ranges(spark, sf_dir):
    """Valid page-range lines."""
    lines = I.table(spark, sf_dir, "part").select(F.expr(_RANGE_LINE).alias("line"), F.col("p_partkey").alias("seq"))
    return files.page_range_lines(lines)[0]


@CHECKS.query(
    """select 'doi' as list, lower('10.' || (1000 + doc_id % 90) || '/AB') as value, min(doc_id) as seq from documents group by 2
    union all select 'id', source || case when doc_id % 3 = 2 then '' else 'x' end, min(doc_id) from documents where doc_id % 4 <> 3 group by 2"""
)
def line_lists(spark, sf_dir):
    """DOI and JSON id lines, first spelling of each value kept in order."""
    documents = I.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")
    doi_lines = documents.select(
        F.concat(F.lit("https://doi.org/10."), (1000 + F.col("seq") % 90).cast("string"), F.lit("/AB).")).alias("line"), "seq"
    )
    name = F.concat("source", F.lit("x"))
    json_line = (
        F.when(F.col("seq") % 4 == 3, F.lit('{"arxiv_id": 7, "base_id": "  "}'))
        .when(F.col("seq") % 3 == 0, F.concat(F.lit('{"arxiv_id": " '), name, F.lit(' "}')))
        .when(F.col("seq") % 3 == 1, F.concat(F.lit('{"arxiv_id": [1], "base_id": "'), name, F.lit('"}')))
        .otherwise(F.concat(F.lit('"'), "source", F.lit('"')))
    )
    ids, _ = files.paper_id_lines(documents.select(json_line.alias("line"), "seq"))
    dois = files.doi_lines(doi_lines).select(F.lit("doi").alias("list"), F.col("doi").alias("value"), "seq")
    return dois.unionByName(ids.select(F.lit("id").alias("list"), F.col("paper_id").alias("value"), "seq"))


@CHECKS.query("select count(*) filter (doc_id % 4 = 3) as skipped from documents")
def skipped_id_lines(spark, sf_dir):
    """A4: lines without a usable id."""
    line = F.when(F.col("doc_id") % 4 == 3, F.lit('{"arxiv_id": null}')).otherwise(F.concat(F.lit('{"base_id": "'), "source", F.lit('"}')))
    return files.paper_id_lines(I.table(spark, sf_dir, "documents").select(line.alias("line"), F.col("doc_id").alias("seq")))[1]
