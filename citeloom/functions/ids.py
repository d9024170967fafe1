"""Identifiers: papers, DOIs, canonical document ids, provenance and citation labels."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import ColumnLike, blank_to_null, col, first_filled, section_or_untitled, strip

# Identifier grammars, trailing punctuation and source classes.
PAPER_BASE = r"(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z-]+)?/\d{7})"
DOI_CORE = r"10\.\d{4,9}/[-._;()/:A-Z0-9]+"
DOI_TRAILING = r"""[)\]}>,.;:"']+$"""
CURATED_SOURCES = ("curated_repo", "awesome_repo", "awesome", "visionbib", "visionbib_page")
API_SOURCES = ("arxiv_feed", "arxiv_api", "openalex_resolved", "semantic_scholar", "canonical_api")
PDF_URL_PREFIX = "https://arxiv.org/pdf/"
ABS_URL_PREFIX = "https://arxiv.org/abs/"


def _paper_token(raw: ColumnLike, after: str = "") -> Column:
    """The id part of an id, prefixed id or URL, without '.pdf', still with its version.

    A chain of replacements that each apply to their own form only, so the input is named once and the
    generated code stays small however deep these functions are nested. ``after`` may follow the id in a URL.
    """
    value = F.regexp_replace(strip(raw), "(?i)^arxiv:", "")
    value = F.regexp_replace(value, rf"(?s)^https?://[^/?#]*/(?:abs|pdf)/([^?#]*?){after}(?:[?#].*)?$", "$1")
    value = F.regexp_replace(value, r"(?s)^https?://[^/?#]*/*([^?#]*?)/*(?:[?#].*)?$", "$1")
    return F.regexp_replace(value, r"\.pdf$", "")


def normalize_paper_id(raw: ColumnLike) -> Column:
    """Base id without prefix, URL path, '.pdf' and version."""
    return F.regexp_replace(F.regexp_replace(_paper_token(raw), "^/+|/+$", ""), r"v\d+$", "")


def paper_version(raw: ColumnLike) -> Column:
    """Version suffix 'vN', or null."""
    return F.nullif(F.regexp_extract(_paper_token(raw, after="/*"), r"(v\d+)$", 1), F.lit(""))


def canonical_paper_id(raw: ColumnLike) -> Column:
    """Base id with its version when one is given; null when there is no id."""
    base = F.nullif(normalize_paper_id(raw), F.lit(""))
    return F.concat(base, F.coalesce(paper_version(raw), F.lit("")))


def has_version(c: ColumnLike) -> Column:
    return F.coalesce(col(c).rlike(r"(?i)v\d+$"), F.lit(False))


def base_of_versioned(c: ColumnLike) -> Column:
    """Drop the trailing version; a 'v' inside an archive name stays."""
    return F.regexp_replace(col(c), r"v\d+$", "")


def clean_matched_base(c: ColumnLike) -> Column:
    """Trailing punctuation off; old-style ids (with '/') in lower case."""
    cleaned = F.regexp_replace(strip(c), r"[)\]}>,.;:]+$", "")
    return F.when(cleaned.contains("/"), F.lower(cleaned)).otherwise(cleaned)


def with_version_number(base: ColumnLike, version: ColumnLike) -> Column:
    """'v007' and 'v7' name the same version."""
    number = F.regexp_extract(F.coalesce(col(version), F.lit("")), r"(\d+)", 1).try_cast("int")
    return F.concat(col(base), F.coalesce(F.concat(F.lit("v"), number.cast("string")), F.lit("")))


def normalize_doi(raw: ColumnLike) -> Column:
    value = F.regexp_replace(strip(raw), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    value = strip(F.regexp_replace(value, "(?i)^doi:", ""))
    return strip(F.lower(F.regexp_replace(value, DOI_TRAILING, "")))


def axv_doc_id(versioned: ColumnLike) -> Column:
    return F.concat(F.lit("axv:"), strip(versioned))


def url_doc_id(url: ColumnLike) -> Column:
    return F.concat(F.lit("url:"), F.sha2(strip(url), 256))


def reference_doc_id(ref_type: ColumnLike, value: ColumnLike) -> Column:
    kind = col(ref_type)
    return (
        F.when(kind == "arxiv", axv_doc_id(value))
        .when(kind == "doi", F.concat(F.lit("doi:"), strip(value)))
        .otherwise(url_doc_id(value))
    )


def provenance_class(source_kind: ColumnLike) -> Column:
    kind = F.lower(strip(source_kind))
    return (
        F.when(kind.isin(*CURATED_SOURCES), "curated")
        .when(kind.isin(*API_SOURCES), "canonical_api")
        .otherwise("scraped")
    )


def public_paper_id(arxiv_id: ColumnLike, doc_id: ColumnLike) -> Column:
    """Paper id to show; DOI- and URL-keyed documents have none."""
    value = blank_to_null(arxiv_id)
    shown = F.when(~value.rlike("^(?:doi|url):"), value)
    from_doc = F.when(col(doc_id).startswith("axv:"), base_of_versioned(F.substr(col(doc_id), F.lit(5))))
    return F.coalesce(shown, from_doc)


def file_stem(versioned: ColumnLike, doc_id: ColumnLike, arxiv_id: ColumnLike) -> Column:
    """File-name-safe stem of the first non-empty id."""
    empty_to_null = [F.nullif(col(c), F.lit("")) for c in (versioned, doc_id)]
    return F.translate(strip(F.coalesce(*empty_to_null, col(arxiv_id))), "/:?&", "____")


def document_id(doc_id: ColumnLike, versioned: ColumnLike, arxiv_id: ColumnLike) -> Column:
    return F.coalesce(
        blank_to_null(doc_id), F.concat(F.lit("axv:"), first_filled(versioned, arxiv_id)), F.lit("axv:unknown")
    )


def _doi_part(value: Column) -> Column:
    bare = F.when(value.rlike("(?i)^doi:"), strip(F.regexp_replace(value, "(?i)^doi:", ""))).otherwise(value)
    return F.when(bare.startswith("10."), bare)


def catalogue_keys(paper_id: ColumnLike) -> Column:
    """Id forms under which an external catalogue may hold the paper, in lookup order."""
    value = strip(paper_id)
    doi = _doi_part(value)
    keys = (
        F.when(value == "", F.array().cast("array<string>"))
        .when(value.rlike("^https?://"), F.array(value))
        .when(doi.isNotNull(), F.array(F.concat(F.lit("DOI:"), doi), value, F.concat(F.lit("https://doi.org/"), doi)))
        .when(value.rlike("(?i)^arxiv:"), F.array(value))
        .otherwise(F.array(value, F.concat(F.lit("ARXIV:"), value), F.concat(F.lit(ABS_URL_PREFIX), value)))
    )
    return F.array_distinct(keys)


def catalogue_batch_key(paper_id: ColumnLike) -> Column:
    """The one form used in batch lookups."""
    value = strip(paper_id)
    doi = _doi_part(value)
    return (
        F.when((value == "") | value.rlike("^https?://"), value)
        .when(doi.isNotNull(), F.concat(F.lit("DOI:"), doi))
        .when(value.rlike("(?i)^arxiv:"), value)
        .otherwise(F.concat(F.lit("ARXIV:"), value))
    )


def is_curatable(paper_id: ColumnLike) -> Column:
    value = strip(paper_id)
    bare = F.when(value.rlike("(?i)^arxiv:"), strip(F.regexp_replace(value, "(?i)^arxiv:", ""))).otherwise(value)
    doi = value.rlike(r"(?iU)^(?:doi:)?10\.\d{4,9}/\S+$")
    paper = bare.rlike(rf"(?i)^{PAPER_BASE}(?:v\d+)?$")
    return F.coalesce((value != "") & (doi | paper), F.lit(False))


def citation_label(arxiv_id: ColumnLike, section_title: ColumnLike) -> Column:
    return F.concat(F.lit("arXiv:"), col(arxiv_id), F.lit(" §"), section_or_untitled(section_title))


def vector_point_id(chunk_id: ColumnLike) -> Column:
    """Name-based UUID (version 5, URL namespace) of a chunk id; UUIDs and unsigned integers are point ids already."""
    text = col(chunk_id).cast("string")
    digest = F.sha1(F.concat(F.lit(uuid.NAMESPACE_URL.bytes), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    named = F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )
    bare = F.regexp_replace(text, r"^urn:uuid:|[{}-]", "")
    return F.when(bare.rlike("(?i)^[0-9a-f]{32}$") | text.rlike("^[0-9]{1,20}$"), text).otherwise(named)


def choose_pdf_url(links: ColumnLike, entry_id: ColumnLike, entry_link: ColumnLike) -> Column:
    """First PDF link of a feed entry, else the abstract URL turned into its PDF URL."""
    pdf_links = F.filter(col(links), lambda link: (link["type"] == "application/pdf") | (link["title"] == "pdf"))

    def from_abs(url: Column) -> Column:
        return F.when(url.contains("/abs/"), F.concat(F.replace(url, F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf")))

    return F.coalesce(
        F.try_element_at(pdf_links, F.lit(1))["href"], from_abs(col(entry_id)), from_abs(col(entry_link)), col(entry_id)
    )


def run_id_at(unix: ColumnLike) -> Column:
    """UTC run id such as 20240131T235959Z, whatever the time zone of the session."""
    wall_clock = F.timestamp_seconds(col(unix)).cast("timestamp_ntz")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall_clock)
    return F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'")


def retry_at(now_unix: ColumnLike | int, retry_days: int) -> Column:
    now = F.lit(now_unix) if isinstance(now_unix, int) else col(now_unix)
    return (now + F.lit(max(retry_days, 1) * 86400)).cast("long")
