"""Mixing to target weights with soft memberships.

A classifier fitted on labelled documents gives every document a posterior over domains. Nonnegative document rates
are then fitted by projected gradient so that the expected tokens of each domain (rate x tokens x posterior, summed
over all documents) match the targets. An iteration reads the written table of posteriors and returns one sum per
domain; a document's rate follows from its posterior and the iterations' gradients, so rates aren't stored meanwhile.
A row's decision comes from its own posterior, so no two rows are ever joined by their doc_id.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.llm.common import free_name, picked, slices, small_side, tidy, written

#: ASCII letters in lower case; other ASCII but digits as spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
UPPER, LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS, SPACES = bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
SHAPES = 8


def shape(text: str | None) -> tuple[int, np.ndarray, set[bytes]]:
    """(tokens, shape of the text, its distinct words); tokens are white-space separated."""
    raw = (text or "").encode()
    words, n = raw.translate(PLAIN).split(), max(1, len(raw))
    own, tokens = set(words), len(raw.split())
    marks = len(raw.translate(None, LETTERS + DIGITS + SPACES))
    upper = len(raw) - len(raw.translate(None, UPPER))
    digits = len(raw) - len(raw.translate(None, DIGITS))
    lines = raw.count(b"\n") + 1
    stats = [
        1.0, marks / n * 10, upper / n * 5, digits / n * 10, raw.count(b"|") / max(1, tokens) * 5,
        len(own) / max(1, len(words)) ** 0.8, np.log1p(tokens) / 5, min(2.0, tokens / lines / 20),
    ]
    return tokens, np.array(stats), own


@dataclass
class Classifier:
    """Softmax regression on a text's shape and the words it has."""

    domains: list[str]
    words: dict[bytes, int]
    weights: np.ndarray  # (shape and words, domains)

    def posterior(self, stats: np.ndarray, own: set[bytes]) -> np.ndarray:
        z = stats @ self.weights[:SHAPES]
        if rows := [SHAPES + self.words[w] for w in own.intersection(self.words.keys())]:
            z = z + self.weights[rows].sum(axis=0)
        p = np.exp(z - z.max())
        return p / p.sum()


def fit(y: np.ndarray, stats: np.ndarray, has: list[list[int]], domains: list[str], words: list[bytes], rounds: int = 200) -> Classifier:
    """Fits on rows of domain y (its place in domains), shape stats and the places of the words they have."""
    x = np.zeros((len(y), SHAPES + len(words)), np.float32)
    x[:, :SHAPES] = stats
    for k, own in enumerate(has):
        x[k, np.array(own, np.int64) + SHAPES] = 1
    weights, truth = np.zeros((x.shape[1], len(domains)), np.float32), np.eye(len(domains), dtype=np.float32)[y]
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for turn in range(1, rounds + 1 if len(y) else 1):
        z = x @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (p / p.sum(axis=1, keepdims=True) - truth) / len(y) + 1e-4 * weights
        m += 0.1 * (g - m)
        v += 0.02 * (g * g - v)
        weights -= 0.05 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.98**turn)) + 1e-8)
    return Classifier(domains, {w: k for k, w in enumerate(words)}, weights.astype(np.float64))


def quality_domain() -> Column:
    """toxic, low or clean from the columns toxic and quality of labels; null where they don't tell."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for domain, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sorted(shape(text)[2])
            yield pa.record_batch([pa.array([domain] * len(own), pa.string()), pa.array(own, pa.binary())], ["domain", "word"])


def _shapes(words: list[bytes]):
    at = {w: k for k, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(stats, sorted(at[w] for w in own & at.keys())) for part in slices(batch) for _, stats, own in map(shape, part.column(1).to_pylist())]
            yield pa.record_batch(
                [batch.column(0), pa.array([f[0].tolist() for f in found], pa.list_(pa.float64())), pa.array([f[1] for f in found], pa.list_(pa.int32()))],
                ["domain", "shape", "has"],
            )

    return run


def telling_words(rows: DataFrame, sizes: dict[str, int], most: int) -> list[bytes]:
    """The words of rows(domain, text) whose presence tells most about the domain; counts are made on executors.

    A word's figure is the largest over the domains of (rows with it - expected)^2 / expected; at least four rows have it.
    """
    seen = rows.mapInArrow(tidy(_words), "domain string, word binary").groupBy("word").pivot("domain", list(sizes)).count().na.fill(0)
    all_of, n = sum((F.col(f"`{d}`") for d in sizes), F.lit(0)), max(1, sum(sizes.values()))
    tells = F.greatest(*(F.pow(F.col(f"`{d}`") - (e := all_of * (size / n)), 2) / F.greatest(e, F.lit(0.5)) for d, size in sizes.items()), F.lit(0.0))
    return sorted(bytes(r.word) for r in seen.where(all_of >= 4).orderBy(tells.desc(), "word").limit(most).collect())


def learn(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], per_domain: int = 800, most_words: int = 3000) -> Classifier:
    """Fits on at most per_domain labelled documents of each domain, picked in hash order, and most_words words.

    Whole texts count. The driver holds a row for each of these documents with the places of the words it has.
    """
    named = labels.withColumn("domain", domain).where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    named = named.groupBy("doc_id").agg(F.max("domain").alias("domain")).join(docs.select("doc_id").distinct(), "doc_id")
    own = written(picked(named, "domain", "doc_id", per_domain).select("doc_id", "domain"), "labelled")
    rows = written(docs.select("doc_id", "text").join(small_side(own), "doc_id").select("domain", "text"), "labelled-texts")
    sizes = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    words = telling_words(rows, {d: sizes.get(d, 0) for d in domains}, most_words)
    got = rows.mapInArrow(tidy(_shapes(words)), "domain string, shape array<double>, has array<int>").collect()
    got = sorted(((domains.index(r.domain), r.shape, r.has) for r in got))
    return fit(np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got]).reshape(-1, SHAPES), [r[2] for r in got], domains, words)


def _posteriors(model: Classifier, tokens_name: str, p_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = [], []
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    n, stats, own = shape(text)
                    tokens.append(n)
                    p.append(model.posterior(stats, own))
            made = [pa.array(tokens, pa.int64()), pa.array([x.tolist() for x in p], pa.list_(pa.float64()))]
            yield pa.record_batch([*batch.columns, *made], [*batch.schema.names, tokens_name, p_name])

    return run


def posteriors(docs: DataFrame, model: Classifier, tokens: str = "tokens", p: str = "p") -> DataFrame:
    """docs with the text's tokens and its posterior in columns of these names, which docs doesn't have."""
    schema = T.StructType([*docs.schema.fields, T.StructField(tokens, T.LongType()), T.StructField(p, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(tidy(_posteriors(model, tokens, p)), schema)


def _rates(p: np.ndarray, steps: list[tuple[float, np.ndarray]], most: float) -> np.ndarray:
    """Rates after the given (momentum, gradient) steps from 1, each followed by the projection onto [0, most]."""
    rate = before = np.ones(len(p))
    for momentum, move in steps:
        rate, before = np.clip(rate + momentum * (rate - before) - p @ move, 0.0, most), rate
    return rate


def _totals(steps: list[tuple[float, np.ndarray]], most: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            p = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, k)
            total += (_rates(p, steps, most) * batch.column(0).to_numpy(zero_copy_only=False)) @ p
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array(total)], ["k", "total"])

    return run


@dataclass
class Rates:
    """Steps that give a row's rate from its posterior, and what they reach: expected tokens of each domain."""

    steps: list[tuple[float, np.ndarray]]
    most: float
    totals: np.ndarray
    targets: np.ndarray
    met: bool

    def column(self, p: Column) -> Column:
        """The rate of a row with posterior p: all steps as one expression, each followed by its projection."""
        if not self.steps:
            return F.lit(1.0)

        def step(now: Column, by: Column) -> Column:
            moved = now["rate"] + by[0] * (now["rate"] - now["before"]) - sum((p[j] * by[j + 1] for j in range(len(self.totals))), F.lit(0.0))
            return F.struct(F.least(F.greatest(moved, F.lit(0.0)), F.lit(self.most)).alias("rate"), now["rate"].alias("before"))

        steps = F.array(*(F.array(*(F.lit(float(x)) for x in (momentum, *move))) for momentum, move in self.steps))
        return F.aggregate(steps, F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("before")), step, lambda now: now["rate"])


def fit_rates(table: DataFrame, weights: list[float], anchor: int | None = None, most: float = float("inf"), close: float = 1e-4) -> Rates:
    """Projected gradient over table(tokens, p), a written table, until the targets are met or the totals stand still.

    Minimises sum_k (total_k - target_k)^2 / mass_k, mass_k being domain k's tokens at rate 1: with steps measured in
    tokens the curvature is 1 at most, so a step of 1 converges. Momentum grows while that brings the totals nearer and
    starts again where it doesn't. Targets sum to all tokens, or to as many that the domain anchor's target is its whole
    mass. Targets that can't be met within the rates allowed are logged.
    """
    k = len(weights)
    share = np.array(weights) / sum(weights)

    def totals(steps: list[tuple[float, np.ndarray]]) -> np.ndarray:
        out = np.zeros(k)
        for r in table.select("tokens", "p").mapInArrow(_totals(steps, most, k), "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect():
            out[r.k] = r.total
        return out

    mass = totals([])
    if not mass.sum():
        return Rates([], most, mass, mass, True)
    target = share * (mass.sum() if anchor is None else mass[anchor] / share[anchor])

    def off(now: np.ndarray) -> float:
        return float(((now - target) ** 2 / np.maximum(mass, 1e-9)).sum())

    steps: list[tuple[float, np.ndarray]] = []
    now = before = mass
    momentum, turn = 0.0, 1.0
    while np.abs(now - target).max() > close * target.sum():
        steps.append((momentum, (now + momentum * (now - before) - target) / np.maximum(mass, 1e-9)))
        before, now = now, totals(steps)
        later = (1 + (1 + 4 * turn * turn) ** 0.5) / 2
        momentum, turn = (0.0, 1.0) if off(now) > off(before) else ((turn - 1) / later, later)
        if momentum and np.abs(now - before).max() <= close / 4 * target.sum():
            break
    met = bool(np.abs(now - target).max() <= close * target.sum())
    if not met:
        logging.getLogger(__name__).warning("targets %s aren't met, totals are %s", target.round().tolist(), now.round().tolist())
    return Rates(steps, most, now, target, met)


def _fitted(docs: DataFrame, model: Classifier, weights: dict[str, float], anchor: str | None, most: float) -> tuple[DataFrame, str, str, Rates]:
    tokens, p = free_name(docs, "tokens"), free_name(docs, "p")
    table = written(posteriors(docs, model, tokens, p), "posteriors")
    at = model.domains.index(anchor) if anchor else None
    rates = fit_rates(table.select(F.col(tokens).alias("tokens"), F.col(p).alias("p")), [weights[d] for d in model.domains], at, most)
    return table, tokens, p, rates


def mixed(docs: DataFrame, model: Classifier, weights: dict[str, float], anchor: str | None = None, most: float = float("inf")) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate) of every row of docs(doc_id, text).

    A null or empty text has 0 tokens and the posterior of its shape; it gets a rate like any other but doesn't count
    in totals. Rows with equal or null doc_id are rated by themselves, equal texts equally. An empty table gives an
    empty result; other columns are ignored. Tokens are white-space separated words.
    """
    table, tokens, p, rates = _fitted(docs.select("doc_id", "text"), model, weights, anchor, most)
    return table.select("doc_id", F.col(tokens).alias("tokens"), *(F.col(p)[j].alias(f"p_{d}") for j, d in enumerate(model.domains)), rates.column(F.col(p)).alias("rate"))


def sampled(docs: DataFrame, model: Classifier, weights: dict[str, float], anchor: str | None = None, most: float = 1.0, seed: int = 11) -> DataFrame:
    """docs, each row kept with its rate's chance (1 or more: kept), by a hash of doc_id and text; the columns of docs.

    Every row is decided by itself, by the rate of its own text, whatever other rows share its doc_id; rows that repeat
    a doc_id and its text stay or go together. See mixed for null and empty texts and tables.
    """
    table, _, p, rates = _fitted(docs, model, weights, anchor, most)
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)) / F.lit(1 << 40)
    return table.where(chance < rates.column(F.col(p))).select(*(F.col(f"`{c}`") for c in docs.columns))
