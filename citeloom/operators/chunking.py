"""Full text to overlapping chunks."""

from __future__ import annotations

import itertools
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS
from citeloom.functions.text import col, section_or_untitled
from citeloom.session import small_batches

SECTIONS = "array<struct<title: string, text: string>>"
TEI = "{http://www.tei-c.org/ns/1.0}"


def text_windows(text: str, size: int, overlap: int) -> Iterator[dict]:
    """Windows over text whose whitespace is already single blanks.

    Blank offsets are found once; every cut is then a binary search, so a long text costs one pass.
    """
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype="<u4") == 32)
    start, length = 0, len(text)
    while start < length:
        stop = start + size
        if stop < length:
            slot = int(np.searchsorted(blanks, stop)) - 1
            if slot >= 0 and blanks[slot] >= start + size // 2 and blanks[slot] > start:
                stop = int(blanks[slot])
        stop = min(stop, length)
        body = text[start:stop].strip(" ")
        if body:
            yield {"text": body, "char_start": start, "char_end": stop}
        if stop == length:
            return
        start = max(stop - overlap, start + 1)
        start += text[start] == " "


def chunk_sections(
    sections: DataFrame,
    size: int = DEFAULTS.chunk_max_chars,
    overlap: int = DEFAULTS.chunk_overlap_chars,
) -> DataFrame:
    """Chunks of documents given as (doc_id, arxiv_id, title, sections ARRAY<STRUCT<title, text>>).

    The sections of a document arrive in one row, so the chunk index that runs across sections is the
    position in a flattened array: no shuffle and no window. A document lives in one task, as its row does.
    """
    small_batches(sections.sparkSession)
    text_of = F.transform("sections", lambda s: s["text"])
    joined = sections.withColumn("__windows", _section_windows(size, overlap)(text_of))
    titled = F.transform(
        "__windows",
        lambda w: F.struct(
            section_or_untitled(F.get(F.col("sections"), w["section_no"])["title"]).alias("section_title"),
            w["text"].alias("text"), w["char_start"].alias("char_start"), w["char_end"].alias("char_end"),
        ),
    )
    return joined.select("doc_id", "arxiv_id", "title", F.posexplode(titled).alias("chunk_index", "__chunk")).select(
        F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"),
        "doc_id", "arxiv_id", "title", "__chunk.section_title", "chunk_index", "__chunk.text",
        "__chunk.char_start", "__chunk.char_end",
    )


def _section_windows(size: int, overlap: int):
    schema = "array<struct<section_no: int, text: string, char_start: int, char_end: int>>"

    @F.pandas_udf(schema)
    def cut(section_texts: pd.Series) -> pd.Series:
        def one(texts):
            return [
                {"section_no": no, **window}
                for no, text in enumerate(texts)
                for window in text_windows(" ".join((text or "").split()), size, overlap)
            ]

        return section_texts.map(lambda texts: [] if texts is None else one(texts))

    return cut


class _Sections:
    """Target of an XML parser: gathers headings and paragraphs of a TEI document in one pass over its events.

    Rules: the paragraphs of every abstract right below a profileDesc make one leading section. Each division right in
    the body is a section, named by its own first head or by its number, with its paragraphs or, if they are blank, all
    its text. If no section has text, the paragraphs of the body are one.
    """

    def __init__(self) -> None:
        self.path: list[str] = []
        self.open: list[tuple[int, list[str]]] = []  # depth and pieces of the texts being gathered
        self.abstract: list[list[str]] = []
        self.in_body: list[list[str]] = []
        self.divisions: list[tuple[list[list[str]], list[list[str]], list[list[str]]]] = []  # heads, paragraphs, all
        self.body_depth = 0
        self.body_ended = False

    def _gather(self, *lists: list[list[str]]) -> None:
        pieces: list[str] = []
        for each in lists:
            each.append(pieces)
        self.open.append((len(self.path), pieces))

    def start(self, tag: str, attributes: dict) -> None:
        self.path.append(tag)
        depth, body = len(self.path), 0 if self.body_ended else self.body_depth
        if not self.body_depth and self.path[-2:] == [TEI + "text", TEI + "body"]:
            self.body_depth = depth
        elif body and depth == body + 1 and tag == TEI + "div":
            self.divisions.append(([], [], []))
            self._gather(self.divisions[-1][2])
        in_division = body and depth > body + 1 and self.path[body] == TEI + "div"
        if in_division and depth == body + 2 and tag == TEI + "head" and not self.divisions[-1][0]:
            self._gather(self.divisions[-1][0])
        if tag == TEI + "p":
            in_abstract = (TEI + "profileDesc", TEI + "abstract") in itertools.pairwise(self.path)
            lists = ([self.abstract] if in_abstract else []) + ([self.in_body] if body else [])
            self._gather(*lists, *([self.divisions[-1][1]] if in_division else []))

    def data(self, text: str) -> None:
        for _, pieces in self.open:
            pieces.append(text)

    def end(self, tag: str) -> None:
        while self.open and self.open[-1][0] == len(self.path):
            self.open.pop()
        self.body_ended = self.body_ended or len(self.path) == self.body_depth
        self.path.pop()

    def close(self) -> list[dict]:
        def joined(texts: list[list[str]]) -> str:
            return "\n\n".join(filter(None, (" ".join("".join(pieces).split()) for pieces in texts)))

        found = [("Abstract", joined(self.abstract))]
        for number, (heads, paragraphs, whole) in enumerate(self.divisions, start=1):
            found.append((joined(heads) or f"Section {number}", joined(paragraphs) or joined(whole)))
        if not any(text for _, text in found):
            found.append(("Body", joined(self.in_body)))
        return [{"title": title, "text": text} for title, text in found if text]


def _tei_sections(xml: str) -> list[dict]:
    parser = ElementTree.XMLParser(target=_Sections())
    parser.feed(xml)
    return parser.close()


def extract_sections(xml: Column | str) -> Column:
    """Sections of a TEI document as STRUCT<sections, error>; a broken document gives its error as a value."""

    @F.pandas_udf(f"struct<sections: {SECTIONS}, error: string>")
    def parse(documents: pd.Series) -> pd.DataFrame:
        rows = []
        for xml_text in documents:
            try:
                rows.append((_tei_sections(xml_text) if xml_text and xml_text.strip() else [], None))
            except ElementTree.ParseError as problem:
                rows.append(([], f"unreadable full text: {problem}"))
        return pd.DataFrame(rows, columns=["sections", "error"])

    return parse(col(xml))
