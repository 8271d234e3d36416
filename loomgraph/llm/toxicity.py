"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import hand_back, stage

#: Terms are hashed to this many buckets; RANK numbers a bucket stand for its pairs.
BUCKETS, RANK = 1 << 18, 6
#: Labelled rows that the machine learns from: all up to this many, above it those with the smallest hash.
TRAIN_ROWS = 20_000
#: Buckets that differ most between the classes, seen in at least SEEN rows, carry weights.
KEPT, SEEN = 8192, 3
#: Chi-square that a bucket has to exceed: one in ten thousand does by chance.
TELLING = 15.0
EPOCHS, BATCH, RATE, SHRINK = 12, 64, 0.2, 1e-4
#: A toxic row counts as much as the clean rows for each of them, up to this often.
TOXIC_WEIGHT = 8.0
#: Word beginnings that are terms too, so that inflected forms share what is learned.
STEMS = (4, 5)

LETTERS = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """Buckets of a lower-case word: the word, and its beginnings."""
    return [zlib.crc32(word.encode()) % BUCKETS] + [zlib.crc32(f"^{word[:k]}".encode()) % BUCKETS for k in STEMS if len(word) > k]


def text_terms(text: str | None, known: dict[str, list[int]]) -> np.ndarray:
    """Distinct buckets of a whole text. ``known`` remembers words; it is emptied when large."""
    out: set[int] = set()
    if len(known) > 100_000:
        known.clear()
    for word in set(LETTERS.findall((text or "").lower())):
        terms = known.get(word)
        if terms is None:
            terms = known[word] = word_terms(word)
        out.update(terms)
    return np.sort(np.fromiter(out, np.int32, len(out)))


@dataclass
class Machine:
    """Bias, a weight for each bucket and ``RANK`` factors for its pairs; zero for buckets not kept."""

    bias: float
    slot: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, terms: list[np.ndarray]) -> np.ndarray:
        """bias + sum of weights + sum over pairs of the products of their factors."""
        slots = [self.slot[t] for t in terms]
        slots = [s[s >= 0] for s in slots]
        return _logits(self, np.concatenate([*slots, np.zeros(0, np.int32)]).astype(np.int64), _starts(slots))[0]

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(self.logits(terms))


def _starts(rows: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0] + [len(r) for r in rows])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's values; rows may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]


def _logits(m: Machine, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = m.factors[flat]
    both = _sums(own, starts)
    pairs = 0.5 * (both**2 - _sums(own**2, starts)).sum(axis=1)
    return m.bias + _sums(m.weights[flat], starts) + pairs, both


def train(rows: Callable[[], Iterable[tuple[np.ndarray, int]]], seed: int = 7) -> Machine:
    """Fit by mini-batches with adaptive steps, on the driver; ``TRAIN_ROWS`` bounds its input.

    ``rows()`` gives terms and label of every row, and is asked twice: for counts, by which the
    buckets that tell the classes apart are kept, and for the kept buckets of each row.
    Without rows, or with one class only, the machine is its bias.
    """
    seen, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    found = []
    for terms, label in rows():
        found.append(label)
        seen[terms] += 1
        toxic[terms] += label
    labels = np.array(found, np.float64)
    positive = int(labels.sum())
    prior = (positive + 1) / (len(labels) + 2)
    slot = np.full(BUCKETS, -1, np.int32)
    machine = Machine(float(np.log(prior / (1 - prior))), slot, np.zeros(0), np.zeros((0, RANK)))
    if not 0 < positive < len(labels):
        return machine
    expected = seen * (positive / len(labels))
    gap = (toxic - expected) ** 2 / np.maximum(expected * (1 - seen / (len(labels) + 1)), 1e-9)
    gap[seen < SEEN] = 0
    kept = np.argsort(-gap, kind="stable")[:KEPT]
    kept = kept[gap[kept] > TELLING]
    slot[kept] = np.arange(len(kept))
    held = [slot[terms] for terms, _ in rows()]
    held = [r[r >= 0].astype(np.int64) for r in held]
    rng = np.random.default_rng(seed)
    machine.weights = np.zeros(len(kept))
    machine.factors = rng.normal(0, 0.01, (len(kept), RANK))
    w_step, v_step = np.full(len(kept), 1e-6), np.full((len(kept), RANK), 1e-6)
    b_step = 1e-6
    weight = np.where(labels > 0, min(TOXIC_WEIGHT, (len(labels) - positive) / positive), 1.0)
    weight /= weight.mean()
    for _ in range(EPOCHS):
        order = rng.permutation(len(held))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            chosen = [held[k] for k in part]
            starts = _starts(chosen)
            flat = np.concatenate(chosen)
            z, both = _logits(machine, flat, starts)
            error = weight[part] * (_sigmoid(z) - labels[part]) / len(part)
            back = np.repeat(error, np.diff(starts))
            used, at = np.unique(flat, return_inverse=True)
            g = np.bincount(at, back, len(used)) + SHRINK * machine.weights[used]
            h = back[:, None] * (np.repeat(both, np.diff(starts), axis=0) - machine.factors[flat])
            h = np.stack([np.bincount(at, h[:, k], len(used)) for k in range(RANK)], axis=1) + SHRINK * machine.factors[used]
            w_step[used] += g**2
            v_step[used] += h**2
            b_step += error.sum() ** 2
            machine.weights[used] -= RATE * g / np.sqrt(w_step[used])
            machine.factors[used] -= RATE * 0.2 * h / np.sqrt(v_step[used])
            machine.bias -= RATE * error.sum() / np.sqrt(b_step)
    return machine


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text is a multiple of five; null counts as no text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """A machine from the labelled, not held-out rows of ``docs(doc_id, text)``.

    Labels other than 0 and 1 and null ids teach nothing; a document labelled twice is toxic if
    any label says so; an id of no document, or of several, is fine. Above ``train_rows``
    the rows with the smallest hash of their id are taken, so the choice is a fixed random sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            terms = [text_terms(x.as_py(), known).tobytes() for x in batch.column("text")]
            yield pa.record_batch(
                {"place": batch.column("place"), "toxic": batch.column("toxic"), "terms": pa.array(terms, pa.binary())}
            )

    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.xxhash64(F.col("doc_id").cast("long"))
    chosen = stage(known.withColumn("place", place).orderBy("place", "doc_id").limit(train_rows), "labels")
    # At most train_rows ids: they are broadcast, so the texts stay where they are.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "toxic", "text")
    terms = stage(texts.mapInArrow(run, "place long, toxic int, terms binary"), "terms")
    rows = stage(terms.orderBy("place", "terms").limit(train_rows), "sample")

    def again() -> Iterator[tuple[np.ndarray, int]]:
        for row in rows.orderBy("place", "terms").toLocalIterator():
            yield np.frombuffer(row["terms"], np.int32), row["toxic"]

    return train(again)


def scorer(docs: DataFrame, machine: Machine):
    """A column function from text to score; the machine is broadcast, its size is fixed by ``BUCKETS``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        for texts in parts:
            scores = [shared.value.scores([text_terms(t, known) for t in texts[i : i + 512]]) for i in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate([*scores, np.zeros(0)]))
        known.clear()
        hand_back()

    return score


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from 0.5 on), for every row.

    Only the text is scored. Null and empty texts have no terms and get the machine's bias;
    repeated rows score alike; without usable labels every score is one half or the share of the
    only class; an empty table gives none. Columns of ``docs`` with those names are replaced.
    """
    score = scorer(docs, learn(docs, labels, train_rows))
    scored = docs.withColumns({"held_out": held_out(), "score": score("text")})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
