"""String helpers as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnLike) -> Column:
    """Trim every kind of Unicode whitespace, not only blanks."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: ColumnLike) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_filled(*cs: ColumnLike) -> Column:
    """First column that holds more than whitespace, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def collapse_whitespace(c: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def preview(c: ColumnLike, chars: int = 140) -> Column:
    return F.replace(F.substring(col(c), 1, chars), F.lit("\n"), F.lit(" "))


def section_or_untitled(c: ColumnLike) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("Untitled"))


def split_names(c: ColumnLike) -> Column:
    """Comma-separated names to a trimmed array without blanks."""
    return F.filter(F.transform(F.split(col(c), ","), strip), lambda name: name != "")


def parse_authors(c: ColumnLike) -> Column:
    """Authors stored either as a JSON list or as comma-separated text."""
    raw = col(c)
    as_json = F.when(raw.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(raw, "array<string>"))
    return F.coalesce(as_json, split_names(raw), F.array().cast("array<string>"))


def feed_authors(single: ColumnLike, names: ColumnLike) -> Column:
    """Authors of a feed item: the single author field, else the list of names."""
    joined = F.array_join(F.filter(F.transform(col(names), strip), lambda n: n != ""), ", ")
    return F.coalesce(split_names(F.coalesce(blank_to_null(single), joined)), F.array().cast("array<string>"))


def feed_summary(c: ColumnLike) -> Column:
    """Text behind the first 'Abstract:' marker, or all of it."""
    return strip(F.regexp_replace(collapse_whitespace(c), r"^.*?Abstract:", ""))


def to_int(c: ColumnLike) -> Column:
    return col(c).try_cast("int")


def _accent_map() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is one letter plus marks, built from Unicode data."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = "".join(ch for ch in unicodedata.normalize("NFD", letter) if not unicodedata.combining(ch))
        if len(base) == 1 and base != letter:
            source.append(letter)
            target.append(base)
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


_ACCENTED, _PLAIN = _accent_map()


def strip_accents(c: ColumnLike) -> Column:
    return F.translate(col(c), _ACCENTED, _PLAIN)


def index_tokens(c: ColumnLike) -> Column:
    """Index tokens: case-folded runs of letters and digits without diacritics."""
    return F.regexp_extract_all(strip_accents(F.lower(col(c))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(c: ColumnLike) -> Column:
    """Keyword-query tokens: ASCII runs in order, so an accented word splits at the accent."""
    return F.regexp_extract_all(col(c), F.lit("[A-Za-z0-9]+"), F.lit(0))
