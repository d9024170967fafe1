"""Table functions for SQL users: SELECT ... FROM t, LATERAL extract_references(t.text)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS
from citeloom.functions.ids import DOI_TRAILING
from citeloom.operators.chunking import text_windows
from citeloom.operators.extract import DOI_MENTION, PAPER_MENTION, PAPER_PARTS


WINDOWS = "chunk_index int, text string, char_start int, char_end int"


class ChunkText:
    """Windows of one text, for lateral joins, which take no Arrow functions: (chunk_index, text, char_start, char_end)."""

    def eval(self, text: str, max_chars: int, overlap_chars: int) -> Iterator[tuple]:
        for index, window in enumerate(text_windows(" ".join((text or "").split()), max_chars, overlap_chars)):
            yield index, window["text"], window["char_start"], window["char_end"]


class ChunkTexts:
    """Windows of all rows of a table (doc_id, text), a batch at a time: (doc_id, chunk_index, text, char_start, char_end)."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        size, overlap = DEFAULTS.chunk_max_chars, DEFAULTS.chunk_overlap_chars
        found = [
            (doc_id, index, window["text"], window["char_start"], window["char_end"])
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True)
            for index, window in enumerate(text_windows(" ".join((text or "").split()), size, overlap))
        ]
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
        names = ["doc_id", "chunk_index", "text", "char_start", "char_end"]
        yield pa.Table.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names)


def _raw(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    return 'R"' + pattern.replace('"', r"\x22") + '"'


EXTRACT_REFERENCES = f"""
CREATE OR REPLACE TEMPORARY FUNCTION extract_references(content STRING)
RETURNS TABLE (kind STRING, value STRING, raw_match STRING, position INT)
RETURN
  SELECT 'arxiv', concat(
      if(contains(base, '/'), lower(base), base), coalesce(concat('v', try_cast(nullif(version, '') AS INT)), '')), raw, pos
  FROM (
    SELECT pos, raw, regexp_extract(raw, {_raw(PAPER_PARTS)}, 1) AS base,
      substr(regexp_extract(raw, {_raw(PAPER_PARTS)}, 2), 2) AS version
    FROM posexplode(regexp_extract_all(content, {_raw(PAPER_MENTION)}, 0)) AS m(pos, raw))
  UNION ALL
  SELECT 'doi', doi, raw, pos
  FROM (
    SELECT pos, lower(regexp_replace(m.`0`, {_raw(DOI_TRAILING)}, '')) AS doi, regexp_replace(m.`1`, {_raw(DOI_TRAILING)}, '') AS raw
    FROM posexplode(arrays_zip(
      regexp_extract_all(content, {_raw(DOI_MENTION)}, 1), regexp_extract_all(content, {_raw(DOI_MENTION)}, 0))) AS d(pos, m))
  WHERE doi <> '' AND raw <> ''
"""


def register(spark: SparkSession) -> None:
    """Make ``chunk_text(text, max_chars, overlap_chars)``, ``chunk_texts(TABLE(rows))`` and ``extract_references(text)`` known to SQL."""
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType=WINDOWS))
    spark.udtf.register("chunk_texts", F.arrow_udtf(ChunkTexts, returnType=f"doc_id string, {WINDOWS}"))
    spark.sql(EXTRACT_REFERENCES)
