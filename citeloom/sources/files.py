"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom import schemas
from citeloom.functions.ids import canonical_paper_id, choose_pdf_url, normalize_doi, normalize_paper_id, paper_version
from citeloom.functions.text import blank_to_null, collapse_whitespace, feed_authors, feed_summary, strip
from citeloom.operators.ordered import first_per_key

REPO_PART = "^[A-Za-z0-9_.-]+$"
RANGE_TOKEN = r"^([A-Za-z][A-Za-z_-]*)(\d+)$"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank, non-comment lines with a sortable position: file, block, line in block."""
    text = spark.read.text(path).select(
        strip("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
    )
    return text.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def _with_position(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "seq",
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ),
    )


def numbered(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Turn a file position into a number that keeps its order, without sorting the rows in one task.

    Rows of one block keep their line offset; blocks (few, one row each) are ranked and spaced apart.
    """
    block = F.struct(F.col(f"{seq}.file").alias("file"), F.col(f"{seq}.block").alias("block"))
    tagged = df.withColumn("__block", block)
    spans = tagged.groupBy("__block").agg(F.min(f"{seq}.line").alias("__low"), F.max(f"{seq}.line").alias("__high"))
    before = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.withColumn("__start", F.coalesce(F.sum(F.col("__high") - F.col("__low") + 1).over(before), F.lit(0)))
    number = F.col("__start") + F.col(f"{seq}.line") - F.col("__low")
    return tagged.join(starts, "__block").withColumn(seq, number.cast("long")).drop("__block", "__low", "__high", "__start")


def read_references(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reference artifacts (JSON lines) with run_id from the folder name and their position."""
    rows = spark.read.schema(schemas.REFERENCES).option("mode", "FAILFAST").json(path)
    return _with_position(rows).withColumn("run_id", F.regexp_extract("seq.file", r"/(?:run_id=)?([^/]+)/[^/]+$", 1))


REJECTED = "__rejected"


def checked_lines(lines: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines (line, seq as from ``_lines``). A line that does not fit the schema is a reject with its file,
    its number there (from 1, blank and comment lines not counted) and its text; the others are rows with ``seq``."""
    parsed = F.from_json("line", StructType([*schema.fields]).add(REJECTED, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED})
    rows = lines.withColumn("r", parsed)
    good = rows.where(F.col(f"r.{REJECTED}").isNull()).select("r.*", "seq").drop(REJECTED)
    numbered_lines = numbered(lines.select("line", "seq", F.col("seq.file").alias("file")))
    first = numbered_lines.groupBy("file").agg(F.min("seq").alias("__first"))
    bad = numbered_lines.withColumn("r", parsed).where(F.col(f"r.{REJECTED}").isNotNull()).join(F.broadcast(first), "file")
    return good, bad.select("file", (F.col("seq") - F.col("__first") + 1).alias("line_no"), "line")


def read_references_checked(spark: SparkSession, path: str | list[str], rejects: str) -> DataFrame:
    """References of run artifacts; lines that do not fit go to a reject table at ``rejects`` instead of failing the job."""
    good, bad = checked_lines(_lines(spark, path), schemas.REFERENCES)
    bad.write.mode("append").json(rejects)
    return good


def resolved_export(resolved: DataFrame, fetched_at: str) -> DataFrame:
    """Resolved DOIs in the nine fields of their export."""
    known = resolved.where(F.col("cache_state") == "resolved")
    return known.select(
        "doi", "openalex_id", "arxiv_id", "is_oa", "pdf_url", "landing_page_url", "license", "source", F.lit(fetched_at).alias("fetched_at")
    )


def metadata_export(papers: DataFrame) -> DataFrame:
    """Papers in the fields of the metadata export."""
    return papers.select(*schemas.PAPER_METADATA.fieldNames())


def write_export(rows: DataFrame, path: str) -> None:
    """JSON lines with all fields, nulls too; an existing export is refused."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def clean_resolutions(rows: DataFrame) -> DataFrame:
    """Blank text to null, default confidence and source."""
    blank = {c: F.when(strip(c) != "", F.col(c)) for c in ("arxiv_id", "arxiv_id_with_version", "doi", "pdf_url")}
    return rows.withColumns(
        {
            **blank, "resolution_confidence": F.coalesce("resolution_confidence", F.lit(0.0)),
            "source_kind": F.coalesce("source_kind", F.lit("openalex_resolved")),
        }
    )


def read_resolutions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = spark.read.schema(schemas.RESOLUTIONS).option("mode", "FAILFAST").json(path)
    return clean_resolutions(_with_position(rows))


def latest_run(runs: DataFrame, suffix: str) -> Column:
    """Latest run id with a suffix among (run_id), as a scalar for a partition filter."""
    return runs.filter(F.col("run_id").endswith(f"-{suffix}")).select(F.max("run_id")).scalar()


def read_latest_references(spark: SparkSession, runs_dir: str, suffix: str) -> DataFrame:
    """References of the latest run of a kind; the run id is a partition column, so other runs are not read."""
    runs = spark.read.schema(schemas.REFERENCES).json(runs_dir)
    return runs.filter(F.col("run_id") == latest_run(runs.select("run_id"), suffix))


def paper_id_lines(lines: DataFrame, fields: tuple[str, ...] = ("arxiv_id", "base_id")) -> tuple[DataFrame, DataFrame]:
    """Ids of JSON lines (line, seq): objects give their first filled field, bare strings themselves.

    Returns (paper_id, seq) without repeats, and one row (skipped). A line that is no JSON fails the job.
    """
    is_json = F.try_parse_json("line").isNotNull()
    bad = F.concat(F.lit("invalid JSON: "), "line")
    parsed = lines.withColumn("line", F.when(is_json, F.col("line")).otherwise(F.raise_error(bad)))
    # Only text counts: a number or list under the name is passed over.
    def text_field(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), f"$.{name}", "variant"))
        return F.when(kind == "STRING", blank_to_null(F.get_json_object("line", f"$.{name}")))

    text_fields = [text_field(name) for name in fields]
    as_object = F.when(F.col("line").startswith("{"), F.coalesce(*text_fields))
    as_string = F.when(F.col("line").startswith('"'), blank_to_null(F.from_json(F.concat(F.lit('{"v":'), "line", F.lit("}")), "v string")["v"]))
    ids = parsed.select(F.coalesce(as_object, as_string).alias("paper_id"), "seq")
    return (
        first_per_key(ids.filter(F.col("paper_id").isNotNull()), ["paper_id"], "seq"),
        ids.agg(F.count_if(F.col("paper_id").isNull()).alias("skipped")),
    )


def read_paper_ids(spark: SparkSession, path: str, fields: tuple[str, ...] = ("arxiv_id", "base_id")):
    return paper_id_lines(_lines(spark, path), fields)


def doi_lines(lines: DataFrame) -> DataFrame:
    dois = lines.select(F.nullif(normalize_doi("line"), F.lit("")).alias("doi"), "seq")
    return first_per_key(dois.filter(F.col("doi").isNotNull()), ["doi"], "seq")


def read_dois(spark: SparkSession, path: str) -> DataFrame:
    return doi_lines(_lines(spark, path))


def repo_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, source_url, seq) of valid lines without repeats, and the lines that are invalid."""
    line = F.col("line")
    is_url = line.rlike("^https?://")
    host = F.lower(F.regexp_extract(line, "^https?://([^/?#]*)", 1))
    segments = F.filter(F.split(F.regexp_extract(line, "^https?://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    pair = F.split(line, "/")
    valid_url = host.isin("github.com", "www.github.com") & (F.size(segments) >= 2)
    owner = F.when(is_url & valid_url, F.get(segments, F.lit(0))).when(~is_url & (F.size(pair) == 2), strip(F.get(pair, F.lit(0))))
    name = F.when(is_url & valid_url, F.get(segments, F.lit(1))).when(~is_url & (F.size(pair) == 2), strip(F.get(pair, F.lit(1))))
    name = F.regexp_replace(name, r"\.git$", "")
    ok = F.coalesce(owner.rlike(REPO_PART) & name.rlike(REPO_PART), F.lit(False))
    parsed = lines.select("line", "seq", ok.alias("ok"), F.concat(owner, F.lit("/"), name).alias("repo"))
    repos = first_per_key(parsed.filter("ok").select("repo", "seq"), ["repo"], "seq")
    return (
        repos.select("repo", F.concat(F.lit("https://github.com/"), "repo").alias("source_url"), "seq"),
        parsed.filter(~F.col("ok")).select("line", "seq"),
    )


def read_repos(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return repo_lines(_lines(spark, path))


def page_range_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stem, start, end, seq) of 'stem start end' and 'stemStart stemEnd' lines, and the invalid lines."""
    parts = F.split("line", r"(?U)\s+")

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    compact = (F.size(parts) == 2) & part(0).rlike(RANGE_TOKEN) & part(1).rlike(RANGE_TOKEN)
    same_stem = F.regexp_extract(part(0), RANGE_TOKEN, 1) == F.regexp_extract(part(1), RANGE_TOKEN, 1)
    spaced = (F.size(parts) == 3) & part(1).rlike(r"^\d+$") & part(2).rlike(r"^\d+$")
    stem = F.when(spaced, part(0)).when(compact & same_stem, F.regexp_extract(part(0), RANGE_TOKEN, 1))
    start = F.when(spaced, part(1)).when(compact, F.regexp_extract(part(0), RANGE_TOKEN, 2)).try_cast("int")
    end = F.when(spaced, part(2)).when(compact, F.regexp_extract(part(1), RANGE_TOKEN, 2)).try_cast("int")
    parsed = lines.select("line", "seq", stem.alias("stem"), start.alias("start"), end.alias("end"))
    ok = F.coalesce(F.col("stem").isNotNull() & (F.col("start") <= F.col("end")), F.lit(False))
    return parsed.filter(ok).select("stem", "start", "end", "seq"), parsed.filter(~ok).select("line", "seq")


def read_page_ranges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Page ranges of a spec file whose first line is the URL prefix: (prefix_url, stem, start, end, seq)."""
    lines = _lines(spark, path)
    first = lines.select(F.min_by("line", "seq")).scalar()
    rest = lines.filter(~F.col("line").rlike("(?i)^https?://"))
    valid, invalid = page_range_lines(rest)
    prefix = F.when(first.rlike("(?i)^https?://"), first).otherwise(
        F.raise_error(F.lit("the first line must be a URL prefix"))
    )
    return valid.withColumn("prefix_url", prefix), invalid


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    """Venue list: text lines, or YAML with a list or {venues: [...]}."""
    if not path.endswith((".yaml", ".yml")):
        return _lines(spark, path).select(F.col("line").alias("venue")).distinct()
    import yaml

    # A hand-written list; read as one value.
    content = yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"])
    items = content.get("venues") if isinstance(content, dict) else content
    if items is not None and not isinstance(items, list):
        raise ValueError(f"venue file must contain a list: {path}")
    names = sorted({str(i).strip() for i in items or [] if str(i).strip()})
    return spark.createDataFrame([(n,) for n in names], "venue string")


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation suite: a YAML list or {cases: [...]} with defaults filled in."""
    import yaml

    content = yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"])
    cases = content.get("cases") if isinstance(content, dict) else content
    if cases is not None and not isinstance(cases, list):
        raise ValueError("an evaluation suite is a list of cases")
    rows = [
        (i, str(c["question"]), [str(x) for x in c.get("must_include_arxiv_ids") or []],
         [str(x) for x in c.get("must_include_tokens") or []], int(c.get("min_sources", 6)))
        for i, c in enumerate(cases or [], start=1)
    ]
    return spark.createDataFrame(rows, schemas.EVAL_CASES)


FEED_ENTRY = (
    "id STRING, title STRING, summary STRING, published STRING, updated STRING,"
    " author ARRAY<STRUCT<name: STRING>>, link ARRAY<STRUCT<_href: STRING, _type: STRING, _title: STRING, _rel: STRING>>"
)
RSS_ITEM = "guid STRUCT<_VALUE: STRING>, title STRING, link STRING, description STRING, pubDate STRING, creator STRING"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Stored Atom feeds to PAPER_METADATA with their position."""
    entries = _with_position(spark.read.format("xml").option("rowTag", "entry").schema(FEED_ENTRY).load(path))
    links = F.transform("link", lambda x: F.struct(x["_href"].alias("href"), x["_type"].alias("type"), x["_title"].alias("title")))
    page = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    entry_id = strip("id")
    versioned = canonical_paper_id(entry_id)
    names = F.filter(F.transform("author", lambda a: a["name"]), lambda n: n != "")
    return entries.filter(F.coalesce(entry_id, F.lit("")) != "").select(
        normalize_paper_id(entry_id).alias("arxiv_id"), versioned.alias("arxiv_id_with_version"),
        paper_version(entry_id).alias("version"), F.concat(F.lit("axv:"), versioned).alias("doc_id"),
        collapse_whitespace("title").alias("title"), collapse_whitespace(F.coalesce("summary", F.lit(""))).alias("summary"),
        "published", "updated", F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        choose_pdf_url(links, entry_id, page).alias("pdf_url"), entry_id.alias("abs_url"), "seq",
    )


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Stored RSS feeds, the fallback source, to PAPER_METADATA."""
    items = _with_position(
        spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(RSS_ITEM).load(path)
    )
    link = strip("link")
    base = normalize_paper_id(link)
    versioned = F.concat(base, F.coalesce(paper_version("guid._VALUE"), F.lit("")))
    pdf = F.when(
        link.contains("/abs/"), F.concat(F.replace(link, F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf"))
    ).otherwise(F.concat(F.lit("https://arxiv.org/pdf/"), base, F.lit(".pdf")))
    return items.filter(F.coalesce(base, F.lit("")) != "").select(
        base.alias("arxiv_id"), versioned.alias("arxiv_id_with_version"), paper_version("guid._VALUE").alias("version"),
        F.concat(F.lit("axv:"), versioned).alias("doc_id"), collapse_whitespace("title").alias("title"),
        feed_summary(F.coalesce("description", F.lit(""))).alias("summary"), F.col("pubDate").alias("published"),
        F.lit(None).cast("string").alias("updated"),
        feed_authors("creator", F.array().cast("array<string>")).alias("authors"), pdf.alias("pdf_url"), link.alias("abs_url"), "seq",
    )


def read_work_cache(spark: SparkSession, path: str) -> DataFrame:
    """Landed work records, one JSON file per DOI hash; unreadable files count as not cached."""
    rows = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_name", r"^([0-9a-f]{64})\.json$", 1).alias("cache_key"), "value"
    )
    return parse_work_cache(rows)


def parse_work_cache(rows: DataFrame) -> DataFrame:
    """(cache_key, value) to the WORK fields; only JSON objects count."""
    usable = rows.filter((F.col("cache_key") != "") & F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"))
    return usable.select("cache_key", F.lit(True).alias("cached"), F.from_json("value", schemas.WORK).alias("w")).select(
        "cache_key", "cached", "w.*"
    )


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file_name, file_stem, length) of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("file_stem"), "length")


def require_rows(df: DataFrame, what: str) -> None:
    """Input check before a run."""
    if df.isEmpty():
        raise FileNotFoundError(f"no rows in {what}")


# --- sinks ---------------------------------------------------------------------------------------------------


def write_run(df: DataFrame, runs_dir: str, run_id: str, again: bool = False) -> None:
    """Immutable run artifact: a new partition folder; an existing run id is refused by the writer. ``again`` writes over what an
    interrupted run has left."""
    df.drop("run_id").write.mode("overwrite" if again else "errorifexists").json(f"{runs_dir.rstrip('/')}/run_id={run_id}")


def is_written(spark: SparkSession, runs_dir: str, run_id: str) -> bool:
    """Whether the artifact of a run was written whole: Spark's writer ends with an empty _SUCCESS file."""
    try:
        return spark.read.format("binaryFile").load(f"{runs_dir.rstrip('/')}/run_id={run_id}/_SUCCESS").count() == 1
    except AnalysisException:
        return False


def write_unique_lines(df: DataFrame, column: str, path: str) -> None:
    """Sorted distinct values, one per line; the parts are in global order."""
    df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value").write.mode(
        "errorifexists"
    ).text(path)


def write_vectors(df: DataFrame, path: str, dimension: int) -> None:
    from citeloom.operators.vector import checked_vectors

    checked_vectors(df, dimension).write.mode("errorifexists").parquet(path)
