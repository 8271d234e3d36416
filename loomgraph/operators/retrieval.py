"""Semantic documents, embeddings, vector top-k and hybrid search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import FEATURE_TOKEN, hybrid_terms

#: Feature codes a worker remembers at once.
KNOWN_CODES = 1 << 16
#: Query vectors shipped to tasks at once; more are matched block by block.
INLINE_QUERIES = 1024
MAX_RELATIONS = 20


def feature_hash(dimensions: int = 384):
    """Arrow UDF ``text -> array<double>``: hashed words and word pairs, L2-normalised.

    One narrow pass over the texts: no token is ever shuffled. Codes are remembered up to
    ``KNOWN_CODES``; most word pairs come once, and those of a whole batch would take gigabytes.
    """
    if dimensions < 64:
        raise ValueError("dimensions must be >= 64")
    token = re.compile(FEATURE_TOKEN)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def code(feature: str) -> int:
            value = known.get(feature)
            if value is None:
                if len(known) >= KNOWN_CODES:
                    known.clear()
                digest = hashlib.blake2b(feature.encode("utf-8"), digest_size=8).digest()
                value = known[feature] = int.from_bytes(digest, "little")
            return value

        def one(text: str | None) -> np.ndarray:
            words = [w.lower() for w in token.findall(text or "")]
            pairs = (f"{a}::{b}" for a, b in pairwise(words))
            raw = np.fromiter(map(code, chain(words, pairs)), np.uint64)
            signs = np.where(raw & np.uint64(1), -1.0, 1.0)
            vector = np.bincount((raw % np.uint64(dimensions)).astype(np.int64), signs, dimensions)
            return vector / (np.sqrt((vector * vector).sum()) or 1.0)

        return texts.map(one)

    return embed


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = rows.sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def _score_block(ids, vectors, query_ids, queries, k: int) -> pd.DataFrame:
    """Cosine of one block of vectors with one block of queries of the same length."""
    frames = []
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique([len(q) for q in queries]):
        rows = np.flatnonzero(sizes == size)
        if size == 0 or len(rows) == 0:
            continue
        picked = [i for i, q in enumerate(queries) if len(q) == size]
        left = np.stack([np.asarray(vectors[i], dtype=np.float64) for i in rows])
        right = np.stack([np.asarray(queries[i], dtype=np.float64) for i in picked])
        norms = np.outer(np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1))
        scores = np.divide(left @ right.T, norms, out=np.zeros_like(norms), where=norms > 0)
        for column, at in enumerate(picked):
            values = np.round(scores[:, column], 9)
            if len(values) > k:
                floor = np.partition(values, len(values) - k)[len(values) - k]
                keep = np.flatnonzero(values >= floor)
            else:
                keep = np.arange(len(values))
            frame = pd.DataFrame({"id": np.asarray(ids)[rows[keep]], "score": values[keep]})
            frame["query_id"] = query_ids[at]
            frames.append(_best(frame, k))
    columns = ["query_id", "id", "score"]
    return pd.concat(frames)[columns] if frames else pd.DataFrame([], columns=columns)


def vector_topk(
    vectors: DataFrame, queries: DataFrame, k: int, *, inline: int = INLINE_QUERIES
) -> DataFrame:
    """Exact cosine top-k per query among vectors of the same length: ``query_id, id, score, position``.

    Up to ``inline`` query vectors (counted first) travel with the tasks; each task keeps its
    own best ``k`` per query, so only ``k`` rows per query and task are exchanged. More
    queries are cut into blocks: every slice of vectors meets every block through an
    equi-join on (slice, block), and memory per task stays one slice plus one block.
    Scores are rounded to nine places so ties do not depend on summation order; a zero vector
    scores 0.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, score double"
    asked = queries.select("query_id", "vector")
    sample = asked.limit(inline + 1).collect()
    slim = vectors.select("id", "vector")
    if len(sample) <= inline:
        query_ids = [r["query_id"] for r in sample]
        matrix = [np.asarray(r["vector"], dtype=np.float64) for r in sample]

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                found = _score_block(batch["id"].to_numpy(), batch["vector"].to_numpy(), query_ids, matrix, k)
                best = found if best is None else _best(pd.concat([best, found]), k)
            if best is not None:
                yield best

        partial = slim.mapInPandas(local, schema)
    else:
        blocks = max(2, -(-asked.count() // inline))
        slices = max(1, slim.rdd.getNumPartitions())
        sliced = slim.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(slices))).withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )
        blocked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
            "_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))
        )

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _score_block(
                left["id"].to_numpy(), left["vector"].to_numpy(), list(right["query_id"]), list(right["vector"]), k
            )

        partial = (
            sliced.groupBy("_slice", "_block").cogroup(blocked.groupBy("_slice", "_block")).applyInPandas(meet, schema)
        )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("position", F.row_number().over(ranked)).filter(F.col("position") <= max(1, k))


def hybrid_search(
    documents: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    limit: int = 20,
    weights: tuple[float, float, float] = (0.60, 0.30, 0.10),
) -> DataFrame:
    """Vector candidates reranked by words and by path or symbol hits.

    ``documents``: ``id, text, path, symbol``; ``queries``: ``query_id, query, vector``. The
    ``max(4 * limit, 40)`` best cosine matches are candidates; text is read for those only.
    """
    total = sum(weights)
    if total <= 0:
        raise ValueError("retrieval weights must sum to a positive value")
    vector_w, lexical_w, structural_w = (w / total for w in weights)
    near = vector_topk(vectors, queries, max(limit * 4, 40))
    wanted = queries.select("query_id", hybrid_terms(F.col("query")).alias("_q"))
    joined = near.join(documents, "id").join(wanted, "query_id")
    lexical = F.size(F.array_intersect(hybrid_terms(F.col("text")), F.col("_q"))) / F.greatest(
        F.size("_q"), F.lit(1)
    )
    path, symbol = F.lower(F.coalesce("path", F.lit(""))), F.lower(F.coalesce("symbol", F.lit("")))
    structural = F.least(
        F.lit(1.0),
        F.when(F.exists("_q", lambda t: F.contains(path, t)), 0.45).otherwise(0.0)
        + F.when(F.array_contains("_q", symbol), 0.55).otherwise(0.0),
    )
    scored = joined.withColumns(
        {
            "vector_score": (F.col("score") + 1.0) / 2.0,
            "lexical_score": lexical,
            "structural_score": structural,
        }
    ).withColumn(
        "score",
        F.round(
            vector_w * F.col("vector_score")
            + lexical_w * F.col("lexical_score")
            + structural_w * F.col("structural_score"),
            9,
        ),
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        scored.withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= limit)
        .select("query_id", "position", "id", "score", "vector_score", "lexical_score", "structural_score")
    )


def semantic_documents(nodes: DataFrame, edges: DataFrame, snippets: DataFrame) -> DataFrame:
    """Text to embed per node: ``kind name``, path, at most twenty relations, snippet.

    ``snippets``: ``id, snippet``. The relation bound is applied in (line text) order before
    rows are gathered, so a hub node never collects its whole neighbourhood.
    """
    real = nodes.filter(~F.col("kind").isin("module", "reference"))
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    ahead = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "kind", F.lit(True).alias("out"))
    back = edges.filter("source <> target").select(
        F.col("target").alias("id"), F.col("source").alias("other"), "kind", F.lit(False).alias("out")
    )
    line = F.when(F.col("out"), F.concat("kind", F.lit(" "), "other_name")).otherwise(
        F.concat(F.lit("used-by "), "other_name", F.lit(" via "), "kind")
    )
    lines = ahead.unionByName(back).join(names, "other").select("id", line.alias("line"), "other")
    order = Window.partitionBy("id").orderBy("line", "other")
    kept = lines.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= MAX_RELATIONS)
    relations = kept.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "line"))), lambda x: x["line"]), "\n").alias("relations")
    )
    joined = real.join(relations, "id", "left").join(snippets, "id", "left")
    parts = F.filter(
        F.array(
            F.concat("kind", F.lit(" "), "name"),
            F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit("path "), "path")),
            F.col("relations"),
            F.col("snippet"),
        ),
        lambda p: p.isNotNull() & (p != ""),
    )
    return joined.select(
        "id",
        F.array_join(parts, "\n").alias("text"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.when(F.col("kind") != "file", F.col("name")).otherwise("").alias("symbol"),
        "kind",
        F.coalesce("line", F.lit(0)).alias("line"),
    )
