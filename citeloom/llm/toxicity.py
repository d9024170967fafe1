"""Toxicity: a learned lexicon, a Levenshtein automaton over its trie, and scores of context windows.

Learning. A sample of about ``sample_rows`` labelled texts, near copies collapsed by their smallest shingle, gives for
every word and every word beginning of three to eight letters the numbers of toxic and other texts that hold it. Terms
that stand almost only in toxic texts, by a likelihood-ratio test, are the lexicon; a beginning covers all its words.
A logistic regression over the features below is fitted to the same sample.

Scoring. The trie of the lexicon and Levenshtein automata are intersected and determinised lazily, so each word is one
run of a finite automaton; long terms allow one or two edits. A hit counts less inside quotation marks, and more if
others stand near it: the window of words around it decides. Text alone is scored.

Edge cases: null and empty texts, and texts without words, score like texts without hits. Without labelled rows of
both kinds there is no lexicon and every score is the share of toxic labels (about 1e-9 without labels). Quotations and texts may
have any length; a very long text is scored whole, in time in proportion to its length. Rows with a null label
or id are not learned from; repeated label rows of an id count once, toxic if any is. Repeated texts score alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import crc32_of_id, small_batches
from citeloom.session import materialize

SAMPLE_ROWS = 10_000
LEAST_TEXTS, LEAST_RATIO, LEAST_SHARE = 4, 30.0, 0.9
NEAR = 8  # words on each side
KEPT_WORDS = 100_000
WORD = regex.compile(r"[\p{L}\p{N}]+")
MARK = regex.compile('["“”„«»‹›]')
# Which marks end a quotation that a mark begins.
CLOSING = {'"': '"', "“": "”", "„": "“”", "«": "»", "‹": "›"}


@dataclass(frozen=True)
class Term:
    text: str
    is_beginning: bool
    weight: float

    @property
    def edits(self) -> int:
        return 0 if len(self.text) < 5 else 1 if len(self.text) < 9 else 2


class Matcher:
    """word → (edits, weight) of its best term, or None."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[Term]] = [[]]
        self.reach = [0]  # edits that some term below a node allows
        for term in terms:
            node = 0
            self.reach[0] = max(self.reach[0], term.edits)
            for letter in term.text:
                node = self.children[node].setdefault(letter, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                self.reach[node] = max(self.reach[node], term.edits)
            self.ends[node].append(term)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, tuple[int, float] | None] = {}
        self.numbers: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.arcs: list[dict[str, int]] = []
        self.whole: list[tuple[int, float] | None] = []
        self.begun: list[tuple[int, float] | None] = []
        self.start = self._number({0: 0})

    def _number(self, nodes: dict[int, int]) -> int:
        """The state of a set of trie nodes with their least edits, closed under left-out letters."""
        queue = list(nodes)
        while queue:
            node = queue.pop()
            for child in self.children[node].values():
                edits = nodes[node] + 1
                if edits <= self.reach[child] and edits < nodes.get(child, 99):
                    nodes[child] = edits
                    queue.append(child)
        key = tuple(sorted(nodes.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(nodes)
            self.arcs.append({})
            hits = [(e, -t.weight, t.is_beginning) for n, e in nodes.items() for t in self.ends[n] if e <= t.edits]
            self.whole.append(min(hits)[:2] if hits else None)
            hits = [h for h in hits if h[2]]
            self.begun.append(min(hits)[:2] if hits else None)
        return self.numbers[key]

    def _arc(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            if edits + 1 <= self.reach[node]:
                nodes[node] = min(nodes.get(node, 99), edits + 1)  # an extra letter
            for seen, child in self.children[node].items():
                cost = edits + (seen != letter)
                if cost <= self.reach[child]:
                    nodes[child] = min(nodes.get(child, 99), cost)
        number = self.arcs[state][letter] = self._number(nodes) if nodes else -1
        return number

    def match(self, word: str) -> tuple[int, float] | None:
        if word in self.known:
            return self.known[word]
        if len(self.known) > KEPT_WORDS or len(self.sets) > KEPT_WORDS // 5:
            self._forget()
        state, best = self.start, None
        for letter in word:
            state = self.arcs[state].get(letter) or self._arc(state, letter)
            if state < 0:
                break
            if self.begun[state] and (best is None or self.begun[state] < best):
                best = self.begun[state]
        if state >= 0 and self.whole[state] and (best is None or self.whole[state] < best):
            best = self.whole[state]
        found = None if best is None else (best[0], -best[1])
        self.known[word] = found
        return found


FEATURES = 5


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of the spans between a quotation mark and the next one that closes it, of any length, in one scan. A mark
    without a closing one begins nothing, and what lies inside of a quotation begins no other."""
    marks = [(m.start(), m[0]) for m in MARK.finditer(text)]
    ending: dict[str, list[int]] = {}  # places of each closing mark, the next one last
    for at, mark in reversed(marks):
        ending.setdefault(mark, []).append(at)
    found, free = [], 0
    for at, mark in marks:
        if at < free or mark not in CLOSING:
            continue
        ends = []
        for closing in CLOSING[mark]:
            places = ending.get(closing, [])
            while places and places[-1] <= at:
                places.pop()
            ends += places[-1:]
        if ends:
            found.append((at, min(ends) + 1))
            free = min(ends) + 1
    return found


def text_features(text: str | None, matcher: Matcher) -> list[float]:
    """Evidence of all hits, a misspelled one counting half; of misspelled ones; per word; in quotations; in one window."""
    lowered = (text or "").lower()
    match, known, hits = matcher.match, matcher.known, []
    if not matcher.terms:
        return [0.0] * FEATURES
    words = WORD.findall(lowered)
    for at, word in enumerate(words):
        hit = known[word] if word in known else match(word)
        if hit is not None:
            hits.append((at, *hit))
    if not hits:
        return [0.0] * FEATURES
    quoted = np.zeros(len(words), bool)
    if spans := quotations(lowered):
        starts = np.fromiter((m.start() for m in WORD.finditer(lowered)), np.int64, len(words))
        for a, b in spans:
            quoted[np.searchsorted(starts, a) : np.searchsorted(starts, b)] = True
    at = np.array([h[0] for h in hits])
    near = np.searchsorted(at, at + NEAR, "right") - np.searchsorted(at, at - NEAR, "left") - 1
    weight = np.array([h[2] for h in hits]) * np.where(quoted[at], 0.25, 1.0) * (1.0 + 0.25 * np.minimum(near, 3))
    exact = np.array([h[1] == 0 for h in hits])
    return [
        math.log1p(np.where(exact, weight, 0.5 * weight).sum()), math.log1p(weight[~exact].sum()), math.log1p(100.0 * weight.sum() / len(words)),
        math.log1p(float(quoted[at].sum())), math.log1p(weight.max()),
    ]


@dataclass(frozen=True)
class Model:
    terms: list[Term]
    weights: np.ndarray  # the last one is the bias

    def score(self, found: list[float]) -> float:
        return float(1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, float(self.weights[:-1] @ np.array(found) + self.weights[-1]))))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Newton's method with a ridge on all weights but the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(bend, slope)
    return w


def is_sign(a: Column, n: Column, rate: float) -> Column:
    """Whether a term in ``n`` texts, ``a`` of them toxic, stands almost only in toxic texts, by a likelihood-ratio test."""
    b = n - a
    ratio = 2 * (a * F.log(a / (n * rate)) + F.when(b > 0, b * F.log(b / (n * (1 - rate)))).otherwise(0.0))
    return (a >= LEAST_TEXTS) & (a >= LEAST_SHARE * n) & (ratio >= LEAST_RATIO)


def choose_terms(signs: list[tuple[str, bool, int, int]], toxic: int, other: int) -> list[Term]:
    """Terms (text, is_beginning, toxic texts, other texts) of those that passed the test.

    A beginning is left to a longer term that stands in nearly as many texts; of the rest, a shorter beginning covers
    the longer terms.
    """
    longer: dict[str, int] = {}
    for text, is_beginning, a, _ in signs:
        for n in range(1, len(text) + (not is_beginning)):
            longer[text[:n]] = max(longer.get(text[:n], 0), a)
    kept: dict[tuple[str, bool], Term] = {}
    for text, is_beginning, a, b in sorted(signs, key=lambda c: (len(c[0]), not c[1], c[0])):
        if is_beginning and longer.get(text, 0) >= 0.9 * a or any((text[:n], True) in kept for n in range(1, len(text) + 1)):
            continue
        kept[text, is_beginning] = Term(text, is_beginning, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1)))
    return list(kept.values())


def learn(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """A model from about ``sample_rows`` labelled texts. ``labels``: only rows that may be learned from."""
    once = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("toxic"))
    total = once.count()
    draw = F.pmod(F.xxhash64(F.lit(3), id_col), F.lit(1_000_000)) / 1e6
    # The sample is bounded by its parameter, so it may be broadcast.
    drawn = F.broadcast(once.where(draw < min(1.0, sample_rows / max(1, total))))
    texts = documents.select(id_col, F.col(text).alias("text")).where("text is not null").join(drawn, id_col)
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 4, F.lit(0))), lambda i: F.xxhash64(F.slice("words", i + 1, 4)))
    sample = texts.withColumn("words", words).withColumn("least", F.array_min(pairs))
    sample = sample.groupBy("toxic", "least").agg(F.min_by(F.struct("text", "words"), id_col).alias("r")).select("toxic", "r.text", "r.words")
    sample = materialize(sample, "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = sum(n for value, n in sizes.items() if value > 0)
    other = sum(sizes.values()) - toxic
    if not toxic or not other:
        share = toxic / max(1, toxic + other)
        return Model([], np.append(np.zeros(FEATURES), math.log(max(share, 1e-9) / max(1 - share, 1e-9))))

    beginnings = F.flatten(F.transform(
        F.filter(F.array_distinct("words"), lambda w: F.length(w) > 3),
        lambda w: F.transform(F.sequence(F.lit(3), F.least(F.length(w) - 1, F.lit(8))), lambda n: F.substr(w, F.lit(1), n)),
    ))
    terms = F.concat(
        F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), F.lit(False).alias("is_beginning"))),
        F.transform(F.array_distinct(beginnings), lambda w: F.struct(w.alias("term"), F.lit(True).alias("is_beginning"))),
    )
    bad = (F.col("toxic") > 0).cast("int")
    opened = sample.select(bad.alias("bad"), F.inline(terms))
    counted = opened.groupBy("term", "is_beginning").agg(F.sum("bad").alias("a"), F.count(F.lit(1)).alias("n"))
    # The sample bounds what passes: every term stands in at least LEAST_TEXTS of its texts.
    passed = counted.where(is_sign(F.col("a"), F.col("n"), toxic / (toxic + other))).collect()
    chosen = choose_terms([(r["term"], r["is_beginning"], r["a"], r["n"] - r["a"]) for r in passed], toxic, other)

    model = Model(chosen, np.zeros(FEATURES + 1))
    measured = score_texts(sample.select(bad.alias("bad"), "text"), model, keep=["bad"], features=True)
    rows = sorted((r["bad"], *r["features"]) for r in measured.collect())
    x = np.array([r[1:] for r in rows])
    return Model(chosen, logistic(x, np.array([r[0] for r in rows], float)))


def score_texts(
    documents: DataFrame, model: Model, text: str = "text", score: str = "score", keep: list[str] | None = None,
    features: bool = False,
) -> DataFrame:
    """``keep`` columns (default: all) with the score, or with the features instead."""
    out = "features" if features else score
    kept = [c for c in (keep if keep is not None else documents.columns) if c != out]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = shared.value
        matcher = Matcher(found.terms)
        for frame in frames:
            measured = [text_features(t, matcher) for t in frame["__text"]]
            result = frame[kept].copy()
            result[out] = measured if features else [found.score(m) for m in measured]
            yield result

    small_batches(documents.sparkSession)
    kind = "array<double>" if features else "double"
    schema = ", ".join([f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept] + [f"`{out}` {kind}"])
    return documents.select(*kept, F.col(text).alias("__text")).mapInPandas(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc32_of_id(id_col) % 4 == 2, F.lit(True))
