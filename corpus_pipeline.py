"""Documents to token ids: toxicity, language, near duplicates, benchmark leaks, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows it gets; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, decontamination, language, near_duplicates, toxicity
from citeloom.llm.common import read_table
from citeloom.llm.queries import TOXIC_FROM, VOCABULARY
from citeloom.session import materialize

SCORE = "__score"
LANGUAGE = "__lang"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled ones outside of the held-out fold."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score_texts(docs, model, score=SCORE)
    return scored.where(F.col(SCORE) < TOXIC_FROM).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; null texts and texts without letters go. A low score stays: it says
    that a text mixes languages, not that it has none."""
    model = language.learn(docs.where(~language.held_out()))
    found = language.identify(docs, model, lang=LANGUAGE, score=SCORE)
    return found.where(F.col(LANGUAGE) != language.UNDETERMINED).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return near_duplicates.deduplicated(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): token ids and whether they decode to the text."""
    vocabulary = public_tokenizers.path(VOCABULARY)
    texts = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("__sha256"))
    decoded = bpe.encode_texts(texts, vocabulary, public_tokenizers.PATTERN, decoded="decoded")
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("__sha256")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: Learned models and tokenisation have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
