"""Approximate nearest neighbours by largest inner product, over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import stage

#: Vectors that a list should hold, and most centroids; beyond it lists grow and are cut into blocks.
LIST, CENTROIDS = 256, 4096
#: Rows, and numbers in all, of the sample that centroids are fitted on, on the driver.
SAMPLE_ROWS, SAMPLE_NUMBERS = 65_536, 1 << 23
#: A vector goes to every list whose centroid is at most so much farther than the nearest, up to COPIES.
BOUNDARY, COPIES = 1.05, 4
#: Links of a centroid to its nearest, and to others anywhere, in the graph that is searched.
LINKS, JUMPS = 16, 2
#: Nearest centroids seen so far that a walk goes on from.
BEAM = 48
#: Queries searched exhaustively to set how far lists are searched, and the share to be found.
PROBES, RECALL = 64, 0.97
#: Vectors and queries of one list that meet in one task.
BLOCK = 4096
#: Nearest lists of a query that are searched first; what others find must beat their ``k``-th.
FIRST = 4


def usable(vector: str = "embedding") -> Column:
    """Not null, no null or non-finite number, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    parts = F.col(vector)
    return F.coalesce(parts.isNotNull() & F.forall(parts, finite) & F.exists(parts, lambda x: x != 0), F.lit(False))


def balanced_centroids(x: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """Means of ``count`` equal parts of ``x``: halved again and again at the median, between two means."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < count:
        parts.sort(key=len)
        own = parts.pop()
        if len(own) < 2:
            parts.append(own)
            break
        a, b = x[rng.choice(own, 2, replace=False)]
        for _ in range(4):
            side = x[own] @ (a - b)
            order = np.argsort(side, kind="stable")
            half = len(own) // 2
            a, b = x[own[order[half:]]].mean(axis=0), x[own[order[:half]]].mean(axis=0)
        parts += [own[order[:half]], own[order[half:]]]
    return np.stack([x[p].mean(axis=0) for p in parts])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T, 0)


@dataclass
class Lists:
    """Centroids with their graph; ``norm`` is the longest vector's, ``spread`` how far lists are searched.

    Vectors get one number more, so that all are ``norm`` long: among them the nearest to a query
    of that length is the one with the largest inner product.
    """

    centroids: np.ndarray
    links: np.ndarray
    norm: float
    spread: float
    sizes: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def raised(self, queries: np.ndarray) -> np.ndarray:
        long = queries * (self.norm / np.sqrt((queries**2).sum(axis=1)))[:, None]
        return np.concatenate([long, np.zeros((len(long), 1))], axis=1)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of every copy of lifted vectors."""
        apart = np.sqrt(_squared(x, self.centroids))
        near = np.argsort(apart, axis=1, kind="stable")[:, :COPIES]
        far = np.take_along_axis(apart, near, axis=1)
        held = far <= BOUNDARY * far[:, :1]
        rows, place = np.nonzero(held)
        return rows, near[rows, place]

    def search(self, queries: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and list of all lists to look in: centroids within ``spread`` of the nearest.

        The graph is walked from a few entries. A centroid is expanded if it is near enough by
        what is known so far, or among the ``BEAM`` nearest seen; so the walk first descends and
        then floods the neighbourhood. If the lists found hold less than ``least`` copies, the
        next nearest are added.
        """
        n, k = len(queries), len(self.centroids)
        apart = np.full((n, k), np.inf)
        done = np.zeros((n, k), bool)
        entries = np.unique(np.linspace(0, k - 1, 8).astype(int))
        rows, nodes = np.repeat(np.arange(n), len(entries)), np.tile(entries, n)
        while len(rows):
            apart[rows, nodes] = np.sqrt(((queries[rows] - self.centroids[nodes]) ** 2).sum(axis=1))
            ranked = np.partition(apart, min(BEAM, k) - 1, axis=1)[:, min(BEAM, k) - 1]
            bound = np.maximum(self.spread * apart.min(axis=1), ranked)
            rows, nodes = np.nonzero((apart <= bound[:, None]) & np.isfinite(apart) & ~done)
            done[rows, nodes] = True
            rows, nodes = np.repeat(rows, self.links.shape[1]), self.links[nodes].ravel()
            pairs = np.unique((rows * k + nodes)[np.isinf(apart[rows, nodes])])
            rows, nodes = pairs // k, pairs % k
        found = apart <= self.spread * apart.min(axis=1)[:, None]
        for i in np.flatnonzero((found * self.sizes).sum(axis=1) < least):
            order = np.argsort(_squared(queries[i : i + 1], self.centroids)[0], kind="stable")
            enough = int(np.searchsorted(np.cumsum(self.sizes[order]), least)) + 1
            found[i, order[:enough]] = True
        return np.nonzero(found)


def graph(centroids: np.ndarray, seed: int = 7) -> np.ndarray:
    """Links of every centroid to its nearest and to a few drawn ones."""
    k = len(centroids)
    rng = np.random.default_rng(seed)
    parts = []
    for i in range(0, k, 1024):
        apart = _squared(centroids[i : i + 1024], centroids)
        parts.append(np.argsort(apart, axis=1, kind="stable")[:, : LINKS + 1])
    ring = (np.arange(k) + 1) % k
    return np.concatenate([np.concatenate(parts), rng.integers(0, k, (k, JUMPS)), ring[:, None]], axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, k: int, least: np.ndarray | float = -np.inf):
    """Query, vector and score of the ``k`` largest products of each query, ties to the smaller id.

    Products below ``least`` are left out, up to rounding.

    A matrix product picks the candidates, with all that rounding could tie; their scores are then
    summed number by number in one order, so equal vectors have equal scores.
    """
    rough = queries @ vectors.T
    rough[ids[:, None] == vec_ids[None]] = -np.inf
    n = min(k, rough.shape[1])
    cut = np.maximum(-np.partition(-rough, n - 1, axis=1)[:, n - 1], least)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
    q, v = np.nonzero((rough >= (cut - slack)[:, None]) & np.isfinite(rough))
    score = np.zeros(len(q))
    for i in range(0, len(q), 1 << 16):
        score[i : i + (1 << 16)] = np.cumsum(queries[q[i : i + (1 << 16)]] * vectors[v[i : i + (1 << 16)]], axis=1)[:, -1]
    order = np.lexsort((vec_ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], v[rank < k], score[rank < k]


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_neighbours(vectors: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    """The ``k`` nearest of a few given queries among all rows: query_id, vec_id, score, embedding, rank."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_ids = shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding")
                q, v, score = _best(own, own_ids, _matrix(x), batch.column("vec_id").to_numpy(), k)
                at = pa.array(v)
                yield pa.record_batch(
                    {"query_id": own_ids[q], "vec_id": batch.column("vec_id").take(at), "score": score, "embedding": x.take(at)}
                )

    found = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double, embedding array<float>")
    return _top(found, k)


def fit(vectors: DataFrame, queries: DataFrame, k: int, recall: float = RECALL) -> Lists:
    """Centroids from a bounded sample, and the spread at which ``recall`` of the sample's neighbours are found.

    The sample has the smallest hashes of vec_id. The spread comes from ``PROBES`` queries that are
    also compared with every row: each true neighbour asks for the ratio at which one of its
    lists is searched, and the spread is the quantile of these ratios.
    """
    facts = vectors.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max(F.size("embedding")).alias("dim")).first()
    rows = min(SAMPLE_ROWS, SAMPLE_NUMBERS // facts["dim"])
    place = F.xxhash64("vec_id")
    sample = vectors.orderBy(place, "vec_id").limit(rows).select("embedding").toArrow()
    made = Lists(np.zeros((1, 1)), np.zeros((1, 1), int), float(np.sqrt(facts["norm"])) * (1 + 1e-9), 1.0, np.zeros(1))
    x = made.lifted(_matrix(sample.column("embedding")))
    made.centroids = balanced_centroids(x, int(min(max(1, facts["n"] // LIST), CENTROIDS, max(1, len(x) // 4))))
    made.links = graph(made.centroids)
    asked = queries.orderBy(place, "vec_id").limit(PROBES).select("vec_id", "embedding").toArrow()
    if asked.num_rows:
        own, ids = _matrix(asked.column("embedding")), asked.column("vec_id").to_numpy()
        truth = exact_neighbours(vectors, own, ids, k).toArrow()
        if truth.num_rows:
            at = {int(i): n for n, i in enumerate(ids)}
            raised = made.raised(own)
            apart = np.sqrt(_squared(raised, made.centroids))
            ratio = apart / np.maximum(apart.min(axis=1), 1e-12)[:, None]
            row, home = made.homes(made.lifted(_matrix(truth.column("embedding"))))
            query = np.array([at[int(i)] for i in truth.column("query_id").to_numpy()])
            asks = np.full(truth.num_rows, np.inf)
            np.minimum.at(asks, row, ratio[query[row], home])
            made.spread = float(np.quantile(asks, recall, method="higher")) * (1 + 1e-9)
    return made


def neighbours(table: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row, nearest first.

    Candidates are all rows but those with the query's vec_id; all of them, if fewer than ``k``.
    Vectors that are null, zero or hold a null or non-finite number take no part, as queries or
    candidates, nor do rows without vec_id or with another dimension than the longest. Of rows with
    one vec_id the smallest vector counts. Ties go to the smaller vec_id; an empty table gives none;
    other columns are not read.

    Every vector stands in its nearest list and, near a boundary, in up to ``COPIES``. A list with
    many vectors, or looked into by many queries, is cut into blocks that meet two by two, so no
    task holds more than ``BLOCK`` of either.
    """
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable() & F.col("vec_id").isNotNull())
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks"))
    squares = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    vectors = stage(rows.withColumn("norm", squares), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("embedding") == longest)
    lists = fit(vectors, vectors.where("asks"), k, recall)
    shared = spark.sparkContext.broadcast(lists)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                row, home = shared.value.homes(shared.value.lifted(_matrix(part.column("embedding"))))
                at = pa.array(row)
                yield pa.record_batch(
                    {"list": pa.array(home, pa.int32()), "vec_id": part.column("vec_id").take(at), "embedding": part.column("embedding").take(at)}
                )

    posted = stage(vectors.select("vec_id", "embedding").mapInArrow(post, "list int, vec_id long, embedding array<float>"), "lists")
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}
    lists.sizes = np.array([sizes.get(i, 0) for i in range(len(lists.centroids))])
    told = spark.sparkContext.broadcast(lists)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                own = told.value.raised(_matrix(part.column("embedding")))
                row, found = told.value.search(own, COPIES * (k + 1))
                apart = ((own[row] - told.value.centroids[found]) ** 2).sum(axis=1)
                order = np.lexsort((found, apart, row))
                row, found = row[order], found[order]
                at = pa.array(row)
                yield pa.record_batch(
                    {
                        "list": pa.array(found, pa.int32()),
                        "query_id": part.column("vec_id").take(at),
                        "embedding": part.column("embedding").take(at),
                        "first": pa.array(np.arange(len(row)) - np.searchsorted(row, row) < FIRST),
                    }
                )

    asked = vectors.where("asks").select("vec_id", "embedding").mapInArrow(ask, "list int, query_id long, embedding array<float>, first boolean")
    asked = stage(asked, "asked")
    queried = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = [(i, -(-sizes.get(i, 0) // BLOCK), -(-queried[i] // BLOCK)) for i in sorted(queried) if sizes.get(i)]
    cut = F.broadcast(spark.createDataFrame(blocks, "list int, v int, q int"))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(cut, "list").withColumn("qb", one("query_id", "q")).withColumn("vb", every("v")).drop("v", "q")
    right = posted.join(cut, "list").withColumn("vb", one("vec_id", "v")).withColumn("qb", every("q")).drop("v", "q")

    def meet(queries: pa.Table, postings: pa.Table) -> pa.Table:
        if not queries.num_rows or not postings.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, vec_ids = queries.column("query_id").to_numpy(), postings.column("vec_id").to_numpy()
        own, x = _matrix(queries.column("embedding")), _matrix(postings.column("embedding"))
        least = queries.column("least").to_numpy()
        parts = [(_best(own[i : i + 512], ids[i : i + 512], x, vec_ids, k, least[i : i + 512]), i) for i in range(0, len(own), 512)]
        q = np.concatenate([p[0] + i for p, i in parts])
        v, score = (np.concatenate([p[j] for p, _ in parts]) for j in (1, 2))
        return pa.table({"query_id": ids[q], "vec_id": vec_ids[v], "score": score})

    keys = ["list", "vb", "qb"]

    def met(asking: DataFrame) -> DataFrame:
        """The best of each query in each list, once where copies of a vector were met."""
        pairs = asking.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
        return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    nothing = F.lit(float("-inf"))
    first = stage(_top(met(left.where("first").withColumn("least", nothing)), k), "nearest")
    # A query's other lists have to beat the last of its first ``k``; without ``k``, nothing.
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    others = left.where("not first").join(least, "query_id", "left").withColumn("least", F.coalesce("least", nothing))
    found = met(others).unionByName(first.drop("rank")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
