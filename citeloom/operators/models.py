"""Pluggable model steps: embedding and text generation as batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS
from citeloom.functions.text import ColumnLike, col, index_tokens

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Generator = Callable[..., str]


def hashing_embedding(text: ColumnLike, dimension: int = 64) -> Column:
    """Default embedder: signed token counts by hash slot, scaled to length one. Deterministic, needs no model.

    Tokens are cut and hashed in the JVM; only slot numbers travel to the array step.
    """
    slots = F.transform(index_tokens(col(text)), lambda t: F.pmod(F.xxhash64(t), F.lit(2 * dimension)).cast("int"))

    @F.pandas_udf("array<float>")
    def count(batch: pd.Series) -> pd.Series:
        lengths = batch.map(len).to_numpy()
        rows = np.repeat(np.arange(len(batch)), lengths)
        flat = np.concatenate([*batch.to_numpy(), np.empty(0)]).astype(np.int64)
        sign = np.where(flat < dimension, 1.0, -1.0)
        sums = np.bincount(rows * dimension + flat % dimension, sign, len(batch) * dimension).astype(float).reshape(-1, dimension)
        # Tokens that cancel each other out still count: such a text gets the plain counts of its slots.
        lost = ~sums.any(axis=1)
        if lost.any():
            sums[lost] = np.bincount(rows * dimension + flat % dimension, None, len(batch) * dimension).reshape(-1, dimension)[lost]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        return pd.Series(list(np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0).astype(np.float32)))

    return count(slots)


def embed(df: DataFrame, text: str, output: str, embedder: Embedder | None = None, batch_size: int = DEFAULTS.embed_batch_size) -> DataFrame:
    """Add one vector per row. ``embedder`` takes a list of texts; a wrong number of vectors fails the job."""
    if embedder is None:
        return df.withColumn(output, hashing_embedding(text))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = []
            for at in range(0, len(texts), batch_size):
                part = texts.iloc[at : at + batch_size].tolist()
                made = list(embedder(part))
                if len(made) != len(part):
                    raise ValueError(f"embedder gave {len(made)} vectors for {len(part)} texts")
                vectors.extend(made)
            yield pd.Series(vectors)

    return df.withColumn(output, run(F.col(text)))


def generate(
    prompts: DataFrame,
    generator: Generator,
    max_tokens: int = 1200,
    temperature: float = 0.0,
    top_p: float = 1.0,
    seed: int | None = 0,
    prompt: str = "prompt",
) -> DataFrame:
    """Add ``reply`` and ``error`` to every prompt; an empty reply or an exception becomes an error value."""

    @F.pandas_udf("struct<reply: string, error: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                try:
                    reply = generator(prompt=text, max_tokens=max_tokens, temperature=temperature, top_p=top_p, seed=seed)
                    rows.append((reply, None) if reply and reply.strip() else (None, "model gave no output"))
                except Exception as problem:  # one bad prompt must not fail the batch
                    rows.append((None, f"generation failed: {problem}"))
            yield pd.DataFrame(rows, columns=["reply", "error"])

    # The reply is read twice below; marked so that the model runs once per prompt.
    called = run.asNondeterministic()
    return prompts.withColumn("__out", called(F.col(prompt))).select(
        "*", F.col("__out.reply").alias("reply"), F.col("__out.error").alias("error")
    ).drop("__out")
