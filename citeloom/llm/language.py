"""Language identification by hierarchical discrimination.

Letters of the whole text are counted as character n-grams (one to three letters, word ends included) in hashed
features. Languages are grouped into families by the closeness of their mean features. A text goes to the family with
the largest linear score first; inside it one-versus-one linear support vector machines vote.

Learning uses a sample of about ``per_language`` labelled rows of each language, chosen by a hash of the id, so its
size does not grow with the table; only their feature vectors reach the driver. Prediction reads texts alone.

Edge cases: a null text, or one without letters, is ``und`` with score 0. Ties of votes go to the larger sum of
margins, then to the first name. With one language all texts with letters get it; with none all are ``und``. Rows with
a null label are not learned from. Repeated rows get equal predictions; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import small_batches

UNDETERMINED = "und"
FEATURES = 1 << 12
PER_LANGUAGE = 500
LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global LETTERS
    if LETTERS is None:  # once per worker
        LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return LETTERS


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of the roots of n-gram counts; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes] if len(codes) else np.empty(0, bool)
    if not is_letter.any():
        return None
    cleaned = np.where(is_letter, codes, 32).astype(np.uint32)
    cleaned = np.concatenate(([32], cleaned, [32])).astype(np.uint32)
    cleaned = cleaned[(cleaned != 32) | np.concatenate(([True], cleaned[:-1] != 32))]
    mixed, counts = cleaned * np.uint32(0x9E3779B1), np.zeros(FEATURES)
    grams = mixed
    for n in range(3):
        if n:
            grams = (grams[:-1] ^ (grams[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + mixed[n:]
        hashed = (grams ^ (grams >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(20)
        counts += np.bincount(hashed, minlength=FEATURES)
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    families: list[list[str]]
    family_weights: np.ndarray  # one line per family, the last column is the bias
    pairs: dict[tuple[str, str], np.ndarray]  # positive for the first

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return UNDETERMINED, 0.0
        with_bias = np.append(x, 1.0)
        scores = self.family_weights @ with_bias
        family = int(np.argmax(scores))
        names = self.families[family]
        rest = np.delete(scores, family)
        margin = scores[family] - rest.max() if len(rest) else np.inf
        votes, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        nearest = dict.fromkeys(names, np.inf)
        for a, b in itertools.combinations(names, 2):
            m = float(self.pairs[a, b] @ with_bias)
            votes[a if m >= 0 else b] += 1
            for name, signed in ((a, m), (b, -m)):
                sums[name] += signed
                nearest[name] = min(nearest[name], signed)
        best = min(names, key=lambda n: (-votes[n], -sums[n], n))
        margin = min(margin, nearest[best])
        return best, float(1.0 / (1.0 + np.exp(-4.0 * margin))) if np.isfinite(margin) else 1.0


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; y is +1 or -1. The bias is the weight of a constant feature."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    squares, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = alpha[i] - (y[i] * (x[i] @ w) - 1.0) / squares[i]
            step = min(max(step, 0.0), cost)
            if step != alpha[i]:
                w += (step - alpha[i]) * y[i] * x[i]
                alpha[i] = step
    return w


def group_families(names: list[str], means: np.ndarray) -> list[list[str]]:
    """Average-linkage clusters of the mean vectors, about the root of the number of languages."""
    unit = means / np.linalg.norm(means, axis=1, keepdims=True)
    near, groups = unit @ unit.T, [[i] for i in range(len(names))]
    while len(groups) > max(1, round(len(names) ** 0.5)):
        a, b = max(
            itertools.combinations(range(len(groups)), 2),
            key=lambda ab: (near[np.ix_(groups[ab[0]], groups[ab[1]])].mean(), -ab[0], -ab[1]),
        )
        groups[a] = sorted(groups[a] + groups.pop(b))
    return [[names[i] for i in group] for group in groups]


def train(labels: list[str], x: np.ndarray) -> Model:
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((0, FEATURES + 1)), {})
    at = np.array(labels)
    families = group_families(names, np.stack([x[at == n].mean(axis=0) for n in names]))
    if len(families) > 1:
        weights = np.stack([linear_svm(x, np.where(np.isin(at, family), 1.0, -1.0)) for family in families])
    else:
        weights = np.zeros((1, x.shape[1] + 1))
    pairs = {}
    for family in families:
        for a, b in itertools.combinations(family, 2):
            rows = np.isin(at, (a, b))
            pairs[a, b] = linear_svm(x[rows], np.where(at[rows] == a, 1.0, -1.0))
    return Model(families, weights, pairs)


def learn(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from about ``per_language`` rows of each label."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([], np.zeros((0, FEATURES)))
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(label) == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1_000_000)) / 1e6
    sample = rows.where(draw < share).select(F.col(label).alias("label"), F.col(id_col).alias("id"), F.col(text).alias("text"))

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(a, i, v.astype(np.float16).tobytes()) for a, i, t in zip(frame["label"], frame["id"], frame["text"], strict=True) if (v := features(t)) is not None]
            yield pd.DataFrame(found, columns=["label", "id", "x"])

    small_batches(labelled.sparkSession)
    kind = sample.schema["id"].dataType.simpleString()
    found = sorted(map(tuple, sample.mapInPandas(vectors, f"label string, id {kind}, x binary").collect()), key=lambda r: (r[0], r[1], bytes(r[2])))
    x = np.array([np.frombuffer(r[2], np.float16) for r in found], np.float32).reshape(-1, FEATURES)
    return train([r[0] for r in found], x)


def identify(
    documents: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (default: all) with the predicted language and a score from 0 to 1."""
    kept = [c for c in (keep or documents.columns) if c not in (lang, score)]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [shared.value.predict(v) if (v := features(t)) is not None else (UNDETERMINED, 0.0) for t in frame["__text"]]
            out = frame[kept].copy()
            out[lang], out[score] = [f[0] for f in found], [f[1] for f in found]
            yield out

    small_batches(documents.sparkSession)
    schema = ", ".join([f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept] + [f"`{lang}` string", f"`{score}` double"])
    return documents.select(*kept, F.col(text).alias("__text")).mapInPandas(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    from citeloom.llm.common import crc32_of_id

    return F.coalesce(crc32_of_id(id_col) % 5 == 0, F.lit(True))
