"""Toxicity: a factorization machine over hashed terms.

A term is a lower-cased run of letters and digits, hashed to `BUCKETS` places; a document is the set
of its places. The machine adds to a bias and linear weights the weighted pairs of places, each
weight the product of two learned vectors, so that two terms can mean more together than apart.

It is fitted on a bounded sample: at most `SAMPLE_DOCS` labelled documents, the first by a hash of
their doc_id, one text each. The driver gets only the distinct places of these, not texts. Two kinds
of places enter the machine: those that tell the labels apart alone, by a chi-squared test, at most
`MAX_PLACES`; and both places of pairs that tell them apart far better together than either alone,
so that a pair of words each harmless by itself can be learned. Pairs are counted among the
`PAIR_PLACES` places of most toxic documents in the sample, by one product of matrices. The machine
is trained by Adam from a fixed seed, so that the same tables give the same scores.

Scoring is one pass over the documents without a shuffle; the model is at most `MAX_PLACES` and
twice `MAX_PAIRS` rows of `FACTORS` + 1 numbers and goes along with the code. Nothing but the text
enters a score.

Defined cases: a null or empty text has no terms and scores as the bias; null labels and labels of
null or unknown doc_ids are left out; a doc_id labelled twice is toxic if either label is; of rows
that share a labelled doc_id, the one with the least set of places is learned from; places of equal
chi-squared value are taken in ascending order; without labels of both kinds every score is the
share of toxic ones, 0 without labels; a null doc_id is not held out; repeated rows score alike; an
empty table gives an empty result; other columns of either table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = re.compile(r"[^\W_]+")
BUCKETS = 1 << 20
SAMPLE_DOCS = 8192
MAX_PLACES = 1024
#: Documents of the sample in which a place must occur, and the chi-squared value it needs.
MIN_DOCS = 3
MIN_CHI = 15.0
#: Pairs: places looked at, pairs kept, toxic documents that hold the pair, its chi-squared value,
#: and how many times that of either place it must be.
PAIR_PLACES = 2048
MAX_PAIRS = 256
MIN_PAIR_DOCS = 8
MIN_PAIR_CHI = 60.0
MIN_GAIN = 2.0
FACTORS = 8
STEPS = 400
RATE = 0.05
DECAY = 1e-5
CUT = 0.7
FOLDS, HELD_FOLD = 3, 1


def places(text: str | None) -> np.ndarray:
    """The distinct places of a text's terms, ascending."""
    terms = set(TERM.findall((text or "").lower()))
    hashed = [xxhash.xxh64_intdigest(t) % BUCKETS for t in terms]
    return np.unique(np.array(hashed, np.int64))


@dataclass
class Machine:
    """Selected places with their weights and vectors."""

    bias: float
    selected: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.selected, found)
        at = np.minimum(at, max(len(self.selected) - 1, 0))
        at = at[self.selected[at] == found] if len(self.selected) else at[:0]
        held = self.vectors[at]
        pairs = 0.5 * float((held.sum(axis=0) ** 2 - (held**2).sum(axis=0)).sum())
        z = self.bias + float(self.weights[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def chi_squared(toxic: np.ndarray, held: np.ndarray, ones: float, total: int) -> np.ndarray:
    """How far the toxic among `held` documents are from chance, for each place or pair."""
    expected = held * (ones / total)
    spread = expected * (1 - ones / total) * (total - held) / max(total - 1, 1)
    return np.where(spread > 0, (toxic - expected) ** 2 / np.maximum(spread, 1e-12), 0)


def select_places(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The places whose presence, alone or in a pair, depends most on the label."""
    found, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    owner = np.repeat(y, [len(s) for s in sets])
    toxic = np.bincount(inverse, weights=owner, minlength=len(found))
    held = np.bincount(inverse, minlength=len(found))
    total, ones = len(y), y.sum()
    chi = np.where(held >= MIN_DOCS, chi_squared(toxic, held, ones, total), 0)
    best = np.lexsort((found, -chi))[:MAX_PLACES]
    return np.union1d(found[best[chi[best] >= MIN_CHI]], found[_paired(sets, y, found, toxic, chi)])


def _paired(sets: list[np.ndarray], y: np.ndarray, found: np.ndarray, toxic: np.ndarray, chi: np.ndarray) -> np.ndarray:
    """Indices of places in pairs that tell the labels apart far better than their places alone."""
    among = np.lexsort((found, -toxic))[:PAIR_PLACES]
    among = np.sort(among[toxic[among] >= MIN_PAIR_DOCS])
    if len(among) < 2:
        return among[:0]
    x = np.zeros((len(y), len(among)), np.float32)
    for i, s in enumerate(sets):
        x[i, np.flatnonzero(np.isin(found[among], s, assume_unique=True))] = 1
    both = [(part := x[y == kind]).T @ part for kind in (1, 0)]
    a, b = np.nonzero(np.triu(both[0] >= MIN_PAIR_DOCS, 1))
    own = both[0][a, b].astype(np.float64)
    value = chi_squared(own, own + both[1][a, b], y.sum(), len(y))
    alone = np.maximum(chi[among[a]], chi[among[b]])
    ok = np.flatnonzero((value >= MIN_PAIR_CHI) & (value >= MIN_GAIN * alone))
    ok = ok[np.lexsort((b[ok], a[ok], -value[ok]))][:MAX_PAIRS]
    return np.unique(among[np.concatenate((a[ok], b[ok]))])


def train(sets: list[np.ndarray], y: np.ndarray) -> Machine:
    """Fit the machine to sets of places and their labels, 0 or 1."""
    empty = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS))
    if not len(y) or not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.0
        return Machine(float(np.log(np.clip(share, 1e-9, 1 - 1e-9) / (1 - np.clip(share, 1e-9, 1 - 1e-9)))), *empty)
    selected = select_places(sets, y)
    x = np.zeros((len(y), len(selected)), np.float64)
    for i, s in enumerate(sets):
        x[i, np.flatnonzero(np.isin(selected, s))] = 1
    rng = np.random.default_rng(0)
    share = y.mean()
    values = [np.array([np.log(share / (1 - share))]), np.zeros(len(selected)), rng.normal(0, 0.05, (len(selected), FACTORS))]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, STEPS + 1):
        bias, w, v = values
        inner = x @ v
        z = bias[0] + x @ w + 0.5 * (inner**2 - (x @ v**2)).sum(axis=1)
        miss = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        # x is 0 or 1, so its square is itself.
        grads = [
            np.array([miss.sum()]),
            x.T @ miss + DECAY * w,
            x.T @ (miss[:, None] * inner) - (x.T @ miss)[:, None] * v + DECAY * v,
        ]
        for value, grad, m, s in zip(values, grads, first, second):
            m += 0.1 * (grad - m)
            s += 0.001 * (grad**2 - s)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(float(values[0][0]), selected, values[1], values[2])


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that no label is learned from."""
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_FOLD, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    """Fit the machine on labelled documents outside the held-out fold."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_docs)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [places(t).astype("<i4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "toxic": batch["toxic"], "places": packed})

    # The sample is bounded by its parameter, so it can go to every executor; of the rows that share
    # a doc_id one comes back, so the driver gets at most as many.
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    texts = chosen.mapInPandas(run, "doc_id string, toxic int, places binary")
    rows = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("places").alias("places")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    sets = [np.frombuffer(p, "<i4").astype(np.int64) for p in rows["places"]]
    return train(sets, (rows["toxic"].to_numpy(np.float64) > 0).astype(np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [machine.score(places(t)) for t in batch["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    return score(docs, fit(docs, labels, sample_docs)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
