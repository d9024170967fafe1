"""URL filter: host-suffix and path-prefix expressions joined with rules on short digests.

Every URL is expanded into (host suffix, path prefix) expressions, only in the shapes that occur among the rules.
An expression meets the rules in an equi-join on the first eight hex digits of its SHA-256; full digests confirm it,
and the longest rule wins.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule. A path that is empty
does not start with ``/``, so a rule with a path does not fit it. Repeated rows are judged one by one. An empty rule
table leaves every page to the default verdict. Rules of one host and path that disagree: block wins. Other columns
of the page table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import lower_ascii

SHORT_HEX = 8
BROADCAST_BYTES = 16 * 1024 * 1024
ROW_BYTES = 160  # of a rule besides its text: digests, numbers, row overhead


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (
        lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id", default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every page. ``rules``: verdict, host, path.

    The rules are broadcast only if they were measured to fit ``broadcast_bytes``; a larger table takes a shuffled join.
    """
    known = (
        rules.select("verdict", lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
        .where(F.col("verdict").isNotNull() & F.col("r_host").isNotNull())
        .withColumn("rule", F.concat("r_host", "r_path"))
        .groupBy("rule", "r_host", "r_path")
        .agg(F.max("verdict").alias("r_verdict"))  # block wins over allow
        .withColumn("full", F.sha2("rule", 256))
        .withColumn("short", F.substring("full", 1, SHORT_HEX))
        .select(
            "short", "full",
            F.struct(F.length("rule").alias("n"), F.length("r_host").alias("n_host"), "rule", "r_verdict").alias("hit"),
            F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars"),
        )
    )
    # Label counts and path lengths, not rules: as many as hosts have labels times paths have lengths.
    shapes = [(r.labels, r.chars) for r in known.select("labels", "chars").distinct().collect()]
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), host.alias("host"), path.alias("path"))
    n_labels = F.size(F.split("host", r"\."))
    expressions = [
        F.when(
            (n_labels >= labels) & (F.length("path") >= chars),
            F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)),
        )
        for labels, chars in sorted(shapes)
    ]
    opened = urls.select("*", F.explode(F.array(F.lit(None).cast("string"), *expressions)).alias("__text"))
    opened = opened.withColumn("__full", F.sha2("__text", 256)).withColumn("__short", F.substring("__full", 1, SHORT_HEX))
    size = known.agg(F.sum(F.octet_length("hit.rule") + ROW_BYTES)).first()[0] or 0
    met = opened.join(
        F.broadcast(known) if size <= broadcast_bytes else known,
        (F.col("__short") == F.col("short")) & (F.col("__full") == F.col("full")), "left",
    )
    # The expressions of a URL stand together in one task, so the partial aggregate sends one row per page.
    best = met.groupBy("__row", id_col, "host", "path").agg(F.max("hit").alias("__hit"))
    return best.select(
        id_col, "host", "path", F.col("__hit.rule").alias("rule"),
        F.coalesce("__hit.r_verdict", F.lit(default)).alias("verdict"),
    )
