"""Quality: random-indexing word vectors, pooled per document, and a small network with calibrated scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import hand_back, slices, stage
from loomgraph.llm.toxicity import held_out

#: Words are hashed to so many buckets, each with a vector of DIM numbers: the vectors stay a few MB on any corpus.
BUCKETS, DIM = 1 << 15, 32
#: Non-zero entries of a bucket's index vector, and how far words count as neighbours.
SPARSE, WINDOW = 4, 2
INDEX_SEED = 11
#: Labelled rows that the network learns from: all up to this many, above it those with the smallest hash.
TRAIN_ROWS = 20_000
#: Every HELD-th of them fits the temperature and not the weights.
HELD = 5
HIDDEN, EPOCHS, BATCH, RATE, SHRINK = 32, 60, 128, 3e-3, 1e-4
#: Bytes that are cut into words at a time. In a longer text a word across a border counts as two.
PART = 1 << 20
#: Distances at which words of a document are compared with each other.
APART = (1, 2)
#: Length of word vectors, whose entries are whole numbers: sums over ``WORDS`` words, of squares too, are
#: exact in single precision, so they do not depend on their order.
FINE = 31
#: Documents that are held as words at a time, words that are met before they are counted, and words pooled at a time.
ROWS, MET, WORDS = 256, 1 << 20, 1 << 13

#: Kind of every byte: blank, letter (and all beyond ASCII), digit, other sign. Words are runs of one kind, case kept.
KINDS = np.array([1 if chr(b).isalpha() or b > 127 else 2 if chr(b).isdigit() else 0 if chr(b).isspace() else 3 for b in range(256)], np.uint8)
#: An odd factor, its inverse modulo 2^64, and a factor that spreads the sum's bits.
FACTOR, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = pow(FACTOR, -1, 1 << 64)


def _powers(factor: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PART - 1, factor, np.uint64)]))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(FACTOR), _powers(INVERSE)


def _part(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and buckets of the words in at most ``PART`` bytes; no word crosses a border.

    A word's hash is a polynomial of its bytes, taken as a difference of running sums.
    """
    powers, inverses = _tables()
    kinds = KINDS[data]
    cut = np.ones(len(data), bool)
    cut[1:] = kinds[1:] != kinds[:-1]
    cut[borders] = True
    starts = np.flatnonzero(cut)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[: len(data)])])
    hashes = (sums[np.append(starts[1:], len(data))] - sums[starts]) * inverses[starts]
    word = kinds[starts] > 0
    hashes = (hashes[word] ^ (hashes[word] >> np.uint64(29))) * np.uint64(SPREAD)
    return starts[word], (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words of the whole texts, one text after the other, and the number of words of each."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    found, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        # Short texts together, up to a part's length; a longer text alone, part by part.
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PART, "right")) - 1)
        for at in range(ends[first], ends[last], PART):
            to = min(at + PART, ends[last])
            inside = ends[first:last] - at
            starts, buckets = _part(data[at:to], inside[(inside > 0) & (inside < to - at)])
            found.append(buckets)
            owners = np.searchsorted(ends[first : last + 1], starts + at, "right") - 1
            counts[first:last] += np.bincount(owners, minlength=last - first)
        first = last
    return np.concatenate(found), counts


def index_vectors() -> np.ndarray:
    """The index vector of every bucket: few entries of one or minus one; the last row is a border, all zero."""
    rng = np.random.default_rng(INDEX_SEED)
    places = rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :SPARSE]
    vectors = np.zeros((BUCKETS + 1, DIM), np.int8)
    np.put_along_axis(vectors[:-1], places, rng.choice(np.array([-1, 1], np.int8), places.shape), axis=1)
    return vectors


def context_sums(counted: np.ndarray, words: np.ndarray, index: np.ndarray) -> np.ndarray:
    """By bucket of ``counted``, the sum of the index vectors of all neighbours in ``words``, place by place."""
    own = index[words]
    near = np.zeros_like(own)
    for step in range(1, WINDOW + 1):
        near[step:] += own[:-step]
        near[:-step] += own[step:]
    return np.stack([np.bincount(counted, near[:, i], BUCKETS + 1) for i in range(DIM)], axis=1)[:BUCKETS].astype(np.int64)


def bordered(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words with borders in front of every document, and at the end."""
    places = np.concatenate([[0], np.cumsum(counts)])
    return np.insert(words, np.repeat(places, WINDOW), BUCKETS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A vector of length ``FINE`` in whole numbers for every bucket, from all neighbourhoods of all documents.

    Index vectors hold whole numbers, so the sums do not depend on how rows are dealt out.
    The part that all words have in common is taken off; buckets never met stay zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS, DIM), np.int64)
        waiting: list[np.ndarray] = []

        def count() -> None:
            flat = np.concatenate(waiting)
            for at in range(0, len(flat), MET):
                # A part's ends see their neighbours beyond it, which count with their own part.
                low, high = max(at - WINDOW, 0), min(at + MET, len(flat))
                part = flat[low : high + WINDOW]
                own = np.full(len(part), BUCKETS)
                own[at - low : high - low] = flat[at:high]
                total[:] += context_sums(own, part, index)
            waiting.clear()

        for batch in slices(batches, ROWS):
            waiting.append(bordered(*word_buckets(batch.column("text"))))
            if sum(map(len, waiting)) > MET:
                count()
        # A task without rows, or with none since the last count, has nothing waiting.
        if waiting:
            count()
        met = np.flatnonzero(total.any(axis=1))
        columns = {"bucket": pa.array(met, pa.int32())}
        yield pa.record_batch(columns | {f"v{i}": pa.array(total[met, i]) for i in range(DIM)})
        hand_back()

    names = [f"v{i}" for i in range(DIM)]
    sums = docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{c} long" for c in names))
    found = sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    vectors = np.zeros((BUCKETS, DIM))
    vectors[found.column("bucket").to_numpy()] = np.stack([found.column(c).to_numpy() for c in names], axis=1)
    met = vectors.any(axis=1)
    if met.any():
        vectors[met] = _unit(vectors[met])
        vectors[met] = _unit(vectors[met] - vectors[met].mean(axis=0))
    return np.rint(FINE * vectors)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def pooled(flat: np.ndarray, lengths: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each document's words, and the mean likeness (inner product)
    of words one and two apart, which tells texts that repeat themselves; zeros without words."""
    dim = vectors.shape[1]
    sums = np.zeros((len(lengths), 2 * dim + len(APART)))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    vectors = vectors.astype(np.float32)
    ones = np.ones(WORDS, np.float32)
    # In parts of WORDS words, wherever documents end.
    for at in range(0, len(flat), WORDS):
        to = min(at + WORDS, len(flat))
        found, here = vectors[flat[at : to + max(APART)]], owner[at : to + max(APART)]
        rows, starts = np.unique(here[: to - at], return_index=True)
        squares = found[: to - at] ** 2
        for row, low, high in zip(rows, starts, [*starts[1:], to - at], strict=True):
            sums[row, :dim] += ones[: high - low] @ found[low:high]
            sums[row, dim : 2 * dim] += ones[: high - low] @ squares[low:high]
        for k, step in enumerate(APART):
            ends = min(to - at, len(here) - step)
            alike = np.einsum("ij,ij->i", found[:ends], found[step : step + ends])
            alike[here[:ends] != here[step : step + ends]] = 0
            sums[:, 2 * dim + k] += np.bincount(here[:ends], alike, len(lengths))
    n = np.maximum(lengths, 1)[:, None]
    mean = sums[:, :dim] / n / FINE
    spread = np.sqrt(np.maximum(sums[:, dim : 2 * dim] / n / FINE**2 - mean**2, 0))
    return np.concatenate([mean, spread, sums[:, 2 * dim :] / n / FINE**2], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """Two layers over scaled features, the logit divided by a temperature."""

    def __init__(self, prior: float, width: int) -> None:
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.layers = [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(prior / (1 - prior))])]
        self.temperature = 1.0

    def plain(self) -> tuple:
        """Arrays only, so that workers need not know this class."""
        return self.mean, self.scale, self.layers, self.temperature


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden @ layers[2] + layers[3][0], hidden


def scores(plain: tuple, features: np.ndarray) -> np.ndarray:
    """Rounded, as the last bits of a matrix product depend on how many rows it takes at once."""
    mean, scale, layers, temperature = plain
    return np.round(_sigmoid(forward(layers, (features - mean) / scale)[0] / temperature), 12)


def train(features: np.ndarray, labels: np.ndarray, seed: int = 5) -> Network:
    """Fit by Adam on the driver; ``TRAIN_ROWS`` bounds its input.

    Without rows, or with one class only, the network is its bias.
    """
    good = int(labels.sum())
    network = Network((good + 1) / (len(labels) + 2), features.shape[1])
    if not 0 < good < len(labels):
        return network
    network.mean, network.scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-6)
    x = (features - network.mean) / network.scale
    held = np.arange(len(x)) % HELD == HELD - 1
    if len(np.unique(labels[~held])) < 2:
        held[:] = False
    fit_x, fit_y = x[~held], labels[~held].astype(np.float64)
    rng = np.random.default_rng(seed)
    layers = network.layers
    layers[0] = rng.normal(0, 1 / np.sqrt(x.shape[1]), layers[0].shape)
    layers[2] = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit_x))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            logit, hidden = forward(layers, fit_x[part])
            error = (_sigmoid(logit) - fit_y[part]) / len(part)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            slopes = [fit_x[part].T @ back, back.sum(axis=0), hidden.T @ error, np.array([error.sum()])]
            slopes = [g + SHRINK * p if p.ndim == 2 else g for g, p in zip(slopes, layers, strict=True)]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if len(np.unique(labels[held])) == 2:
        network.temperature = temperature_for(forward(layers, x[held])[0], labels[held])
    return network


def temperature_for(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits that makes the labels likeliest; a search over 1/16 to 16.

    Labels are drawn in by one count a class, so that logits which part the classes stay finite.
    """
    good = labels.sum()
    labels = np.where(labels > 0, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))

    def loss(power: float) -> float:
        z = np.clip(logits / 2.0**power, -40, 40)
        return float(np.mean(np.log1p(np.exp(-z)) + (1 - labels) * z))

    low, high, golden = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(2.0 ** ((low + high) / 2))


def learn(docs: DataFrame, labels: DataFrame, vectors, train_rows: int = TRAIN_ROWS) -> Network:
    """A network from the labelled, not held-out rows of ``docs(doc_id, text)``; ``vectors`` is a broadcast.

    Labels other than 0 and 1 and null ids teach nothing; a document labelled twice is good only
    if every label says so. Above ``train_rows`` the rows with the smallest hash of their id are
    taken, a fixed random sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            found = pooled(*word_buckets(batch.column("text")), vectors.value)
            packed = pa.array([row.tobytes() for row in found], pa.binary())
            yield pa.record_batch({"place": batch.column("place"), "good": batch.column("good"), "features": packed})

    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    place = F.xxhash64(F.col("doc_id").cast("long"))
    chosen = stage(usable.withColumn("place", place).orderBy("place", "doc_id").limit(train_rows), "labels")
    # At most train_rows ids: they are broadcast, so the texts stay where they are.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "good", "text")
    found = stage(texts.mapInArrow(run, "place long, good int, features binary"), "features")
    rows = found.orderBy("place", "features").limit(train_rows).toArrow()
    width = 2 * vectors.value.shape[1] + len(APART)
    features = np.frombuffer(b"".join(rows.column("features").to_pylist()), np.float64).reshape(-1, width)
    return train(features, rows.column("good").to_numpy().astype(np.int64))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with held_out, score (0 to 1, likelihood of good quality) and predicted (score >= ``threshold``).

    Word vectors come from all whole texts, and only the text is scored. Null and empty texts, and
    texts of blanks, pool to zeros and score alike; very long ones are cut into words part by
    part; repeated rows score alike; without usable labels every score is one half, or the
    smoothed share of the only class; an empty table gives none. Columns of ``docs`` with those
    names are replaced.
    """
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    network = context.broadcast(learn(docs, labels, vectors, train_rows).plain())

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = [np.zeros(0)]
            for at in range(0, len(texts), ROWS):
                found.append(scores(network.value, pooled(*word_buckets(texts[at : at + ROWS]), vectors.value)))
            yield pa.array(np.concatenate(found))
        hand_back()

    scored = docs.withColumns({"held_out": held_out(), "score": score("text")})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
