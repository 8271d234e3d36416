"""Shared memory: revisions, optimistic writes, vector-clock merge.

A key's writes form a sequence, and the obvious plan folds one key in one task. These
versions rewrite each fold as running sums and maxima, which split across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import memory_terms
from loomgraph.operators.scans import SEGMENT_ROWS, ordinal, prefix, segment_of, top_per
from loomgraph.operators.search import term_matches
from loomgraph.session import durable

KEY = ["namespace", "key"]


def revisions(writes: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Every write with its revision number (n-th write of its key by ``seq``)."""
    rows = writes.withColumn("_segment", segment_of(F.col("seq"), segment_rows))
    return ordinal(rows, KEY, ["seq"], "_segment", "revision").drop("_segment")


def latest(writes: DataFrame) -> DataFrame:
    """Current value and revision per key: one map-side combined aggregate."""
    rest = [c for c in writes.columns if c not in KEY]
    return writes.groupBy(*KEY).agg(
        F.max_by(F.struct(*rest), "seq").alias("r"), F.count("*").alias("revision")
    ).select(*KEY, "r.*", "revision")


def history(writes: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` writes of each key with their revisions.

    Counting from the newest end needs only the key's total, so no key is numbered in full.
    """
    newest = Window.partitionBy(*KEY).orderBy(F.desc("seq"))
    kept = writes.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= limit)
    totals = writes.groupBy(*KEY).agg(F.count("*").alias("_total"))
    return kept.join(totals, KEY).withColumn("revision", F.col("_total") - F.col("_rn") + 1).drop("_rn", "_total")


def search_plain(entries: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Number of query terms found in ``key value``; zero scores are left out."""
    return _search(entries, queries, limit, team=False)


def search_team(entries: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """3 per term in the key, 1 per term elsewhere; no terms returns all; ties oldest first."""
    return _search(entries, queries, limit, team=True)


def _search(entries: DataFrame, queries: DataFrame, limit: int, team: bool) -> DataFrame:
    """``queries`` has ``query_id, namespace, query``.

    Entries are tested against the distinct terms once; only matches are joined to the
    queries of their namespace, so a namespace is not read again for every query. A query
    without terms returns the first entries of its namespace (team memory only).
    """
    terms = memory_terms(F.lower("query"))
    parsed = queries.select("query_id", "namespace", (terms if team else F.array_distinct(terms)).alias("_terms"))
    wanted = (
        parsed.select("query_id", "namespace", F.explode("_terms").alias("term"))
        .groupBy("query_id", "namespace", "term")
        .agg(F.count("*").alias("_times"))
    )
    tail = [F.array_join("tags", " ")] if team else []
    hay, low_key = F.lower(F.concat_ws(" ", "key", "value", *tail)), F.lower("key")

    def weigh(term):
        inside = F.contains(hay, term)
        found = F.when(F.contains(low_key, term), 3).otherwise(1) if team else F.lit(1)
        return F.when(inside, found).otherwise(0)

    rest = [c for c in entries.columns if c not in KEY]
    scored = (
        term_matches(entries, wanted, [hay], weigh)
        .join(wanted, ["namespace", "term"])
        .groupBy("query_id", *KEY)
        .agg(F.sum(F.col("w") * F.col("_times")).cast("int").alias("score"), F.first(F.struct(*rest)).alias("r"))
        .select("query_id", *KEY, "r.*", "score")
    )
    ties = [*([F.asc("updated_at")] if team else []), F.asc("key")]
    if team:
        blank = parsed.filter(F.size("_terms") == 0).select("query_id", "namespace")
        first = top_per(entries, ["namespace"], ties, max(1, limit)).join(blank, "namespace")
        scored = scored.unionByName(first.withColumn("score", F.lit(0)).select(*scored.columns))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= max(1, limit))


def optimistic_writes(writes: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Accept or reject writes that name the revision they expect.

    ``writes`` has ``namespace, key, seq, expected`` (null expects nothing). A write is
    accepted when ``expected`` equals the number of writes accepted before it; unconditional
    writes are always accepted.

    With ``u`` unconditional writes before a row, a conditional row is accepted when
    ``expected - u`` equals the number of *conditional* writes accepted before it. So the
    accepted rows form one chain: the first row asking for 0, the next later row asking for
    1, and so on. Each row's successor is a running lookup, and the chain is marked by
    doubling: the number of rounds is the logarithm of its length.
    """
    rows = writes.withColumn("_segment", segment_of(F.col("seq"), segment_rows))
    rows = prefix(
        rows, KEY, ["seq"], "_segment", {"_u": ("sum", F.col("expected").isNull().cast("long"))}, inclusive=False
    ).withColumn("_u", F.coalesce("_u", F.lit(0)))
    rows = durable(rows.withColumn("_want", F.col("expected") - F.col("_u")))
    conditional = rows.filter("expected is not null and _want >= 0").select(*KEY, "seq", "_want")

    # Successor: the earliest later row of the key that asks for one more.
    reverse = (-F.col("_at")).alias("_rev")
    sources = conditional.select(*KEY, "_want", F.col("seq").alias("_at"), F.lit(1).alias("_side"), "seq")
    seekers = conditional.select(
        *KEY,
        (F.col("_want") + 1).alias("_want"),
        F.col("seq").alias("_at"),
        F.lit(0).alias("_side"),
        F.lit(None).cast("long").alias("seq"),
    )
    mixed = sources.unionByName(seekers).select("*", reverse)
    mixed = mixed.withColumn("_segment", F.floor(F.col("_rev") / segment_rows).cast("long"))
    # Seekers sort before sources at one position, so a row never finds itself.
    linked = prefix(
        mixed, [*KEY, "_want"], ["_rev", "_side"], "_segment", {"_next": ("last", F.col("seq"))}
    )
    jump = durable(
        linked.filter("_side = 0").select(*KEY, F.col("_at").alias("seq"), F.col("_next").alias("next"))
    )
    reached = durable(
        conditional.filter("_want = 0").groupBy(*KEY).agg(F.min("seq").alias("seq"))
    )
    while True:
        step = durable(
            reached.join(jump.filter("next is not null"), [*KEY, "seq"])
            .select(*KEY, F.col("next").alias("seq"))
            .join(reached, [*KEY, "seq"], "left_anti")
        )
        if step.isEmpty():
            break
        reached = durable(reached.unionByName(step).distinct())
        hop = jump.select(*KEY, F.col("seq").alias("next"), F.col("next").alias("after"))
        jump = durable(
            jump.join(hop, [*KEY, "next"], "left").select(*KEY, "seq", F.col("after").alias("next"))
        )
    chain = reached.withColumn("_hit", F.lit(True))
    decided = rows.join(chain, [*KEY, "seq"], "left").withColumn(
        "accepted", F.col("expected").isNull() | F.coalesce("_hit", F.lit(False))
    )
    # An accepted row's revision needs no further scan: it is u plus its place in the chain.
    before = F.when(F.col("expected").isNotNull(), F.col("expected"))
    numbered = prefix(
        decided.drop("_hit"),
        KEY,
        ["seq"],
        "_segment",
        {"_accepted_before": ("sum", F.col("accepted").cast("long"))},
        inclusive=False,
    )
    current = F.coalesce(F.when(F.col("accepted"), before), F.col("_accepted_before"), F.lit(0))
    return numbered.select(
        *writes.columns,
        "accepted",
        F.when(F.col("accepted"), current + 1).alias("revision"),
        F.when(~F.col("accepted"), F.coalesce("_accepted_before", F.lit(0))).alias("found"),
    )


def merge_mutations(mutations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Relation of every mutation to the state it met, in ``seq`` order per key.

    Whatever a step does, the clock afterwards is the per-node maximum of all clocks so far:
    a dominating write *is* that maximum, a dominated one changes nothing, a concurrent one
    is merged. So the state a mutation meets is a running maximum, not a fold.
    Adds ``relation``: new, after, before, equal or concurrent (incoming versus current).
    """
    rows = mutations.withColumn("_segment", segment_of(F.col("seq"), segment_rows))
    nodes = rows.select(*KEY, "seq", "_segment", F.explode("clock").alias("_node", "_n")).filter("_n > 0")
    seen = prefix(
        nodes, [*KEY, "_node"], ["seq"], "_segment", {"_prev": ("max", F.col("_n"))}, inclusive=False
    )
    per_row = seen.groupBy(*KEY, "seq").agg(
        F.bool_and(F.col("_n") >= F.coalesce("_prev", F.lit(0))).alias("_ge"),
        F.bool_and(F.col("_n") <= F.coalesce("_prev", F.lit(0))).alias("_le"),
        F.count("_prev").alias("_known"),
        F.count_if(F.col("_prev").isNull()).alias("_fresh"),
    )
    joined = rows.join(per_row, [*KEY, "seq"], "left").withColumns(
        {
            "_ge": F.coalesce("_ge", F.lit(True)),
            "_le": F.coalesce("_le", F.lit(True)),
            "_known": F.coalesce("_known", F.lit(0)),
            "_fresh": F.coalesce("_fresh", F.lit(0)),
        }
    )
    placed = prefix(
        joined,
        KEY,
        ["seq"],
        "_segment",
        {"_nodes": ("sum", F.col("_fresh")), "_rows": ("sum", F.lit(1))},
        inclusive=False,
    )
    covers = F.col("_ge") & (F.coalesce("_nodes", F.lit(0)) == F.col("_known"))
    relation = (
        F.when(F.col("_rows").isNull(), "new")
        .when(covers & F.col("_le"), "equal")
        .when(covers, "after")
        .when(F.col("_le"), "before")
        .otherwise("concurrent")
    )
    return placed.select(*mutations.columns, "_segment", relation.alias("relation"))


def memory_sync(mutations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Final state per key with applied / ignored / conflict counts.

    A dominating write starts a new era; inside the last era the largest ``(updated_at,
    node_id)`` wins and the earlier of two equal ones stays. Concurrent writes count as
    applied even when the local value wins, because the merged clock is stored.
    """
    related = merge_mutations(mutations, segment_rows)
    opens = F.col("relation").isin("new", "after")
    eras = prefix(related, KEY, ["seq"], "_segment", {"_era": ("sum", opens.cast("long"))})
    stored = F.col("relation").isin("new", "after", "concurrent")
    winner = F.max_by(
        F.struct("value", "node_id", "updated_at", "tombstone"),
        F.when(stored, F.struct("_era", "updated_at", "node_id", (-F.col("seq")).alias("first"))),
    )
    state = eras.groupBy(*KEY).agg(
        winner.alias("w"),
        F.count_if(stored).alias("applied"),
        F.count_if(~stored).alias("ignored"),
        F.count_if(F.col("relation") == "concurrent").alias("conflicts"),
    )
    clock = (
        mutations.select(*KEY, F.explode("clock").alias("node", "n"))
        .groupBy(*KEY, "node")
        .agg(F.max("n").alias("n"))
        .groupBy(*KEY)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "n")))).alias("clock"))
    )
    return state.join(clock, KEY, "left").select(
        *KEY, "w.value", "w.node_id", "w.updated_at", "w.tombstone", "clock", "applied", "ignored", "conflicts"
    )
