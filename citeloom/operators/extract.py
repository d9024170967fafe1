"""Mining text and pages for paper references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions.ids import (
    DOI_CORE, DOI_TRAILING, PAPER_BASE, PDF_URL_PREFIX, axv_doc_id, base_of_versioned,
    clean_matched_base, normalize_doi, normalize_paper_id, reference_doc_id, with_version_number,
)
from citeloom.functions.text import ColumnLike, col, strip
from citeloom.operators.ordered import first_per_key

# The grammar of every mention form of a paper or DOI in one leftmost alternation. The look-ahead at the first
# letter changes no match; it spares the Unicode tests at every other character.
PAPER_MENTION = (
    rf"(?=[hHaA])(?iU)(?:https?://arxiv\.org/abs/{PAPER_BASE}(?:v\d+)?\b|https?://arxiv\.org/pdf/{PAPER_BASE}(?:v\d+)?\.pdf\b"
    rf"|\barxiv(?:\s*:\s*|\s+){PAPER_BASE}(?:v\d+)?\b)"
)
PAPER_PARTS = rf"(?iU)^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv(?:\s*:\s*|\s+))({PAPER_BASE})(v\d+)?(?:\.pdf)?$"
DOI_MENTION = rf"(?=[hHdD1])(?iU)(?:https?://(?:dx\.)?doi\.org/|\bdoi\s*:\s*|(?<![A-Za-z0-9]))({DOI_CORE})"
DOI_LEAD = r"(?iU)^(?:https?://(?:dx\.)?doi\.org/|doi\s*:\s*)"
HTML_NOISE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ANCHOR = r"""(?i)<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
HREF = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

SKETCH_BITS = 14


def paper_mentions(text: ColumnLike) -> Column:
    """ARRAY<STRUCT<base_id, paper_id, version, raw_match>> in text order; repeats stay."""
    found = F.regexp_extract_all(col(text), F.lit(PAPER_MENTION), F.lit(0))

    def parts(raw: Column) -> Column:
        base = clean_matched_base(F.regexp_extract(raw, PAPER_PARTS, 1))
        version = F.regexp_extract(raw, PAPER_PARTS, 2)
        return F.struct(
            base.alias("base_id"), with_version_number(base, version).alias("paper_id"),
            F.substr(version, F.lit(2)).try_cast("int").alias("version"), raw.alias("raw_match"),
        )

    return F.transform(found, parts)


def doi_mentions(text: ColumnLike) -> Column:
    """ARRAY<STRUCT<doi, raw_match>> in text order, trailing punctuation removed."""
    cleaned = F.transform(
        F.regexp_extract_all(col(text), F.lit(DOI_MENTION), F.lit(0)),
        lambda raw: F.struct(
            normalize_doi(F.regexp_replace(raw, DOI_LEAD, "")).alias("doi"),
            F.regexp_replace(raw, DOI_TRAILING, "").alias("raw_match"),
        ),
    )
    return F.filter(cleaned, lambda m: (m["doi"] != "") & (m["raw_match"] != ""))


def mine_texts(texts: DataFrame) -> DataFrame:
    """Seed records of (source_repo, source_url, found_in, text): one row per mention, papers and DOIs."""
    keep = ["source_repo", "source_url", "found_in"]
    both = F.concat(
        F.transform(
            paper_mentions("text"),
            lambda m, i: F.struct(
                F.lit("arxiv").alias("kind"), m["base_id"].alias("base_id"), m["paper_id"].alias("value"),
                m["raw_match"].alias("raw_match"), i.alias("position"),
            ),
        ),
        F.transform(
            doi_mentions("text"),
            lambda m, i: F.struct(
                F.lit("doi").alias("kind"), m["doi"].alias("base_id"), m["doi"].alias("value"),
                m["raw_match"].alias("raw_match"), i.alias("position"),
            ),
        ),
    )
    return texts.select(*keep, F.explode(both).alias("m")).select(*keep, "m.*")


# --- links ---------------------------------------------------------------------------------------------------


def _resolve_dots(path: Column) -> Column:
    """Remove '.' and '..' segments of an absolute path."""
    parts = F.split(path, "/")
    walked = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == ".", kept)
        .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part))),
    )
    ends_in_dots = F.element_at(parts, -1).isin(".", "..") & (F.size(walked) > 0)
    return F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(ends_in_dots, F.lit("/")).otherwise(F.lit("")))


def absolute_url(page_url: ColumnLike, href: ColumnLike) -> Column:
    """href seen from its page, without fragment; null when it is not http(s)."""
    base, raw = col(page_url), F.regexp_replace(col(href), "#.*$", "")
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_extract(path, "^(.*/)", 1)).otherwise(F.lit("/"))
    href_path, href_rest = F.regexp_extract(raw, r"^([^?]*)", 1), F.regexp_extract(raw, r"^[^?]*(\?.*)$", 1)
    joined = (
        F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw))
        .when(raw == "", F.concat(origin, path, query))
        .when(raw.startswith("?"), F.concat(origin, path, raw))
        .when(raw.startswith("/"), F.concat(origin, _resolve_dots(href_path), href_rest))
        .otherwise(F.concat(origin, _resolve_dots(F.concat(folder, href_path)), href_rest))
    )
    return F.when(joined.rlike("(?i)^https?:"), joined)


def numbered_hrefs(html: ColumnLike, page_url: ColumnLike) -> Column:
    """ARRAY<STRUCT<n, link>>: absolute link targets of a page with the number of their anchor."""
    anchors = F.regexp_extract_all(F.regexp_replace(col(html), HTML_NOISE, " "), F.lit(ANCHOR), F.lit(0))

    def target(anchor: Column) -> Column:
        raw = F.concat(*[F.regexp_extract(anchor, HREF, group) for group in (1, 2, 3)])
        for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            raw = F.replace(raw, F.lit(entity), F.lit(char))
        return strip(raw)

    hrefs = F.transform(anchors, lambda a, i: F.struct(i.alias("n"), target(a).alias("href")))
    wanted = F.filter(hrefs, lambda h: (h["href"] != "") & ~h["href"].rlike("(?i)^(?:javascript|mailto):"))
    links = F.transform(wanted, lambda h: F.struct(h["n"].alias("n"), absolute_url(page_url, h["href"]).alias("link")))
    return F.filter(links, lambda h: h["link"].isNotNull())


def page_hrefs(html: ColumnLike, page_url: ColumnLike) -> Column:
    """Absolute link targets of a page in order, first occurrence only."""
    return F.array_distinct(F.transform(numbered_hrefs(html, page_url), lambda h: h["link"]))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_url, link, position) of landed pages (page_url, html): each link of an address once, however often its page landed,
    in the order of its first anchor; of links with one anchor number the lesser comes first."""
    flat = pages.select("page_url", F.inline(numbered_hrefs("html", "page_url"))).repartition("page_url")
    first = flat.groupBy("page_url", "link").agg(F.min("n").alias("n"))
    in_order = W.partitionBy("page_url").orderBy("n", "link")
    return first.select("page_url", "link", (F.row_number().over(in_order) - 1).alias("position"))


def classify_link(url: ColumnLike) -> Column:
    """STRUCT<kind, value> for DOI, PDF and paper links, in that order; null for the rest."""
    link = col(url)
    host = F.lower(F.regexp_extract(link, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(link, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    bare = F.regexp_replace(path, "^/+", "")
    # A plus sign is a plain character in a path, unlike in a form.
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    doi = F.when(host.endswith("doi.org"), F.nullif(normalize_doi(decoded), F.lit("")))
    pdf = F.when(path.rlike(r"(?i)\.pdf$"), F.regexp_replace(link, "#.*$", ""))
    paper = F.when(
        host.endswith("arxiv.org") & path.rlike("^/(?:abs|pdf)/"), F.nullif(normalize_paper_id(link), F.lit(""))
    )

    def as_kind(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    return F.coalesce(as_kind("doi", doi), as_kind("pdf", pdf), as_kind("arxiv", paper))


def mine_pages(pages: DataFrame) -> DataFrame:
    """Links of (page_url, html): kind, value, source page, raw link and context, once per page and value.

    Links come before DOIs mentioned in the text. A page is one row, so everything happens inside its row.
    """
    links = F.transform(
        page_hrefs("html", "page_url"),
        lambda url: F.struct(classify_link(url).alias("target"), url.alias("raw_link"), F.lit("href").alias("context")),
    )
    mentions = F.transform(
        doi_mentions("html"),
        lambda m: F.struct(
            F.struct(F.lit("doi").alias("kind"), m["doi"].alias("value")).alias("target"),
            m["raw_match"].alias("raw_link"), F.lit("text").alias("context"),
        ),
    )
    found = F.filter(F.concat(links, mentions), lambda f: f["target"].isNotNull())
    flat = pages.select("page_url", F.posexplode(found).alias("position", "f")).select(
        F.col("page_url").alias("source_page_url"), F.col("f.target.kind").alias("kind"),
        F.col("f.target.value").alias("normalized_value"), "f.raw_link", "f.context", "position",
    )
    return first_per_key(flat, ["source_page_url", "kind", "normalized_value"], "position")


# --- to references -------------------------------------------------------------------------------------------


def references_from_texts(records: DataFrame, source_kind: str, discovered_at: int) -> DataFrame:
    return records.select(
        F.col("kind").alias("ref_type"), F.col("value").alias("normalized_value"), F.lit(source_kind).alias("source_kind"),
        F.col("source_url").alias("source_ref"), F.lit(discovered_at).cast("long").alias("discovered_at_unix"),
    )


def references_from_pages(links: DataFrame, source_kind: str, discovered_at: int) -> DataFrame:
    ref_type = F.when(F.col("kind") == "pdf", "pdf_url").otherwise(F.col("kind"))
    return links.select(
        ref_type.alias("ref_type"), "normalized_value", F.lit(source_kind).alias("source_kind"),
        F.col("source_page_url").alias("source_ref"), F.lit(discovered_at).cast("long").alias("discovered_at_unix"),
    )


def resolutions_from_pages(links: DataFrame, source_kind: str) -> DataFrame:
    """Links that need no look-up: PDF links and paper links resolve themselves."""
    value, is_pdf = F.col("normalized_value"), F.col("kind") == "pdf"
    return links.filter(F.col("kind").isin("pdf", "arxiv")).select(
        F.when(is_pdf, reference_doc_id(F.lit("pdf_url"), value)).otherwise(axv_doc_id(value)).alias("doc_id"),
        F.when(~is_pdf, base_of_versioned(value)).alias("arxiv_id"),
        F.when(~is_pdf, value).alias("arxiv_id_with_version"),
        F.lit(None).cast("string").alias("doi"),
        F.when(is_pdf, value).otherwise(F.concat(F.lit(PDF_URL_PREFIX), value, F.lit(".pdf"))).alias("pdf_url"),
        F.when(is_pdf, F.lit(0.6)).otherwise(F.lit(1.0)).alias("resolution_confidence"),
        F.when(is_pdf, F.lit("scraped_pdf")).otherwise(F.lit(source_kind)).alias("source_kind"),
        F.lit(None).cast("long").alias("resolved_at_unix"),
    )


def discovery_totals(records: DataFrame, kind: str = "kind", value: str = "base_id") -> DataFrame:
    """Total and distinct matches per kind in one row."""

    def of(name: str) -> Column:
        return F.when(F.col(kind) == name, F.col(value))

    return records.agg(
        *[F.count(of(k)).alias(f"{k}_total") for k in ("arxiv", "doi", "pdf")],
        *[F.count_distinct(of(k)).alias(f"{k}_unique") for k in ("arxiv", "doi", "pdf")],
    )


def page_totals(requested: DataFrame, landed: DataFrame) -> DataFrame:
    """One row: pages requested, ok and failed. ``requested``: page_url; ``landed``: page_url, html. A page that did not land, or
    whose html is blank, has failed; repeated requests and landings count once."""
    ok = landed.where(strip(F.coalesce("html", F.lit(""))) != "").select("page_url").distinct().withColumn("ok", F.lit(1))
    pages = requested.select("page_url").where("page_url is not null").distinct().join(ok, "page_url", "left")
    return pages.agg(
        F.count(F.lit(1)).alias("pages_requested"), F.count("ok").alias("pages_ok"), F.count_if(F.col("ok").isNull()).alias("pages_failed")
    )


def run_sketches(records: DataFrame, run: str = "run_id", kind: str = "kind", value: str = "base_id") -> DataFrame:
    """(run_id, kind, total, sketch): one mergeable row per run and kind, stored with the run."""
    return records.where(F.col(value).isNotNull()).groupBy(run, kind).agg(
        F.count(F.lit(1)).alias("total"), F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias("sketch")
    )


def unique_totals(sketches: DataFrame, kind: str = "kind") -> DataFrame:
    """(kind, total, unique_estimate) over all runs, from their sketches alone. The standard error of an estimate is
    1.04 / sqrt(2 ^ SKETCH_BITS), 0.8 percent."""
    return sketches.groupBy(kind).agg(
        F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_estimate")
    )


def expand_pages(ranges: DataFrame) -> DataFrame:
    """Page URLs of (prefix_url, stem, start, end, seq): both ends included, first spelling of a URL kept."""
    pages = ranges.select(
        "seq", "stem", F.explode(F.sequence("start", "end")).alias("page_no"), F.regexp_replace("prefix_url", "/+$", "").alias("p")
    ).select(
        F.concat("p", F.lit("/"), "stem", "page_no", F.lit(".html")).alias("page_url"), "stem", "page_no",
        F.struct("seq", "page_no").alias("at"),
    )
    return first_per_key(pages, ["page_url"], "at").select("page_url", "stem", "page_no")


