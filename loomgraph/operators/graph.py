"""Knowledge-graph analytics over ``nodes`` and ``edges`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scoring import edge_resolution, edge_weight
from loomgraph.functions.text import is_test
from loomgraph.operators.search import search_nodes
from loomgraph.session import durable

UNRESOLVED_KINDS = ("module", "reference")
NON_SYMBOL_KINDS = ("file", "module", "reference")
IMPACT_DEPTH = 5
#: Nodes that stand for a link between each two of their neighbours from different repositories.
HUB_KIND = "hub"


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge per (repo, source, target, kind): the last one wins, self-loops go."""
    keys = [c for c in ("repo", "source", "target", "kind") if c in edges.columns]
    rest = [c for c in edges.columns if c not in keys]
    return (
        edges.filter("source <> target")
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "ordinal").alias("r"))
        .select(*keys, "r.*")
    )


def counts_by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("nodes"))


def hot_nodes(edges: DataFrame, top: int = 12) -> DataFrame:
    """Highest total degree. Counts combine map-side, so a hub costs one row per task."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return degree.orderBy(F.desc("degree"), "id").limit(top)


def _digest(*columns: str):
    """The first 60 bits of the MD5 of the values, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x00", *columns)), 1, 15), 16, 10).cast("decimal(38,0)")


def graph_fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Order-insensitive digest: sums of 60-bit hashes commute, so nothing is sorted."""
    n = nodes.agg(
        F.count("*").alias("nodes"),
        F.sum(_digest("id")).alias("node_sum"),
    )
    e = edges.agg(
        F.count("*").alias("edges"),
        F.sum(_digest("source", "kind", "target")).alias("edge_sum"),
    )
    return n.select(
        "nodes", "node_sum", e.select("edges").scalar().alias("edges"), e.select("edge_sum").scalar().alias("edge_sum")
    )


def weighted(edges: DataFrame) -> DataFrame:
    """Edges with resolution label and impact weight."""
    blank = F.lit(None)
    declared = F.col("resolution") if "resolution" in edges.columns else blank.cast("string")
    conf = F.col("resolution_confidence") if "resolution_confidence" in edges.columns else blank.cast("double")
    resolved = edges.withColumn("_label", edge_resolution(declared, conf))
    return resolved.select(
        "source", "target", "kind", F.col("_label").alias("resolution"), edge_weight(F.col("kind"), F.col("_label")).alias("weight")
    )


def find_targets(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Node each query names: exact name first (symbols before files), else the best search hit."""
    order = F.struct((F.col("kind") == "file").alias("f"), F.coalesce("path", F.lit("")).alias("p"), "id")
    asked = queries.withColumn("_name", F.lower("query"))
    exact = durable(
        nodes.withColumn("_name", F.lower("name"))
        .join(asked, "_name")
        .groupBy("query_id", "query")
        .agg(F.min_by("id", order).alias("id"))
    )
    rest = queries.join(exact, "query_id", "left_anti")
    if rest.isEmpty():
        return exact
    return exact.unionByName(search_nodes(nodes, rest, 1).select("query_id", "query", "id"))


def _hub_crossing(nodes: DataFrame, edges: DataFrame, hubs: DataFrame):
    """A function from a frontier ``target, at, carried`` to the ways through hubs.

    At each hub the strongest arrival and the strongest from another repository suffice, so a
    hub with many members costs its members, not their pairs.
    """
    repos = nodes.select(F.col("id").alias("member"), "repo")
    inward = edges.join(hubs.select(F.col("id").alias("target")), "target", "left_semi").select(
        F.col("target").alias("hub"), F.col("source").alias("member"), "weight", F.col("kind").alias("via"), F.col("resolution").alias("evidence")
    )
    outward = edges.join(hubs.select(F.col("id").alias("source")), "source", "left_semi").select(
        F.col("source").alias("hub"), F.col("target").alias("member")
    )
    # A hub without links of its own to nodes holds both ways.
    mutual = inward.join(outward.select("hub").distinct(), "hub", "left_anti").select("hub", "member")
    entries = durable(outward.unionByName(mutual).join(repos, "member"))
    exits = durable(inward.join(repos, "member"))

    def cross(frontier: DataFrame) -> DataFrame:
        arrived = frontier.join(entries, frontier["at"] == entries["member"]).groupBy("target", "hub", "repo").agg(F.max("carried").alias("carried"))
        first = F.max(F.struct("carried", "repo")).alias("first")
        best = arrived.groupBy("target", "hub").agg(first)
        again = arrived.join(best, ["target", "hub"]).filter("repo <> first.repo").groupBy("target", "hub").agg(F.max("carried").alias("second"))
        at_hub = best.join(again, ["target", "hub"], "left")
        carried = F.when(F.col("repo") != F.col("first.repo"), F.col("first.carried")).otherwise(F.col("second"))
        ways = at_hub.join(exits, "hub").withColumn("strength", carried * F.col("weight")).filter("strength is not null")
        return ways.select("target", F.col("member").alias("node"), "strength", "via", "evidence")

    return cross


def impact(nodes: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = IMPACT_DEPTH) -> DataFrame:
    """Nodes reached from each target over reverse edges, with depth and risk.

    Strength multiplies along the path and ``risk = strength / max(1, 0.85 * depth)``. Per
    level only the strongest way to each (target, node) is kept, and it replaces an earlier
    visit only when its risk is higher; a deeper but stronger path can therefore lose, as in
    a breadth-first relaxation by risk. ``evidence`` is the label of the last hop. Ties go to
    the smaller (via, evidence).

    A hub (federation) is walked through in one hop, from a node to the other nodes linked to
    it in another repository; it is no result itself. A link from a node to its hub holds both
    ways, one from a hub to a node leads back to the nodes that link to the hub.

    Pass ``edges`` as a stored table: every hop reads it once and joins the improved frontier
    on ``target``. A small frontier is broadcast by its measured size, a large one is
    shuffled, and AQE splits a hot target's edges.
    """
    steps = weighted(edges).select(
        F.col("target").alias("at"),
        F.col("source").alias("node"),
        "weight",
        F.col("kind").alias("via"),
        F.col("resolution").alias("evidence"),
    )
    hubs = nodes.filter(F.col("kind") == HUB_KIND).select("id")
    crossing = _hub_crossing(nodes, weighted(edges), hubs) if not hubs.isEmpty() else None
    known_nodes = nodes.filter(F.col("kind") != HUB_KIND).select(F.col("id").alias("node"))
    key = ["target", "node"]
    best_way = F.min_by(
        F.struct("strength", "via", "evidence"), F.struct(-F.col("strength"), "via", "evidence")
    ).alias("b")
    frontier = targets.select(
        F.col("id").alias("target"), F.col("id").alias("at"), F.lit(1.0).alias("carried")
    ).distinct()
    seen = None
    for depth in range(1, max_depth + 1):
        ways = frontier.join(steps, "at").select("target", "node", (F.col("carried") * F.col("weight")).alias("strength"), "via", "evidence")
        if crossing is not None:
            ways = ways.unionByName(crossing(frontier))
        reached = (
            ways.filter("node <> target")
            .groupBy(*key)
            .agg(best_way)
            .join(known_nodes, "node", "left_semi")
            .select(
                *key,
                "b.*",
                F.lit(depth).alias("depth"),
                (F.col("b.strength") / max(1.0, depth * 0.85)).alias("risk"),
            )
        )
        if seen is not None:
            known = seen.groupBy(*key).agg(F.max("risk").alias("_known"))
            reached = reached.join(known, key, "left").filter(
                F.col("_known").isNull() | (F.col("risk") > F.col("_known"))
            ).drop("_known")
        level = durable(reached)
        if level.isEmpty():
            break
        # A visit that is improved on stays below its better one; the best of each is taken at the end.
        seen = level if seen is None else seen.unionByName(level)
        frontier = level.select("target", F.col("node").alias("at"), F.col("strength").alias("carried"))
    if seen is None:
        seen = reached.limit(0)
    # Risks of one node rise from level to level, so the last visit is the best.
    last = F.max_by(F.struct("depth", "via", "risk", "evidence"), "depth").alias("b")
    seen = seen.groupBy(*key).agg(last).select(*key, "b.*")
    info = nodes.select(F.col("id").alias("node"), "kind", "name", "path")
    return seen.join(info, "node").select(
        "target", "node", "kind", "name", "path", "depth", "via", F.least("risk", F.lit(1.0)).alias("risk"), "evidence",
        is_test(F.col("path"), F.col("name")).alias("is_test"),
    )


def impact_report(items: DataFrame) -> DataFrame:
    """Direct, indirect and test counts and the risk score per target."""
    score = F.least(
        F.lit(1.0), F.avg("risk") * 0.7 + F.least(F.lit(1.0), F.count("*") / 25) * 0.3
    )
    return items.groupBy("target").agg(
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.count_if(F.col("depth") > 1).alias("indirect"),
        F.count_if("is_test").alias("tests"),
        score.alias("risk_score"),
    )


def evidence_quality(items: DataFrame) -> DataFrame:
    return items.groupBy("target", "evidence").agg(F.count("*").alias("nodes"))


def highest_risk(items: DataFrame, limit: int = 20) -> DataFrame:
    order = Window.partitionBy("target").orderBy(F.desc("risk"), "depth", "name", "node")
    return items.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def incident_edges(edges: DataFrame, ids: DataFrame, *, incoming_only: bool = False) -> DataFrame:
    """Edges touching any of the given nodes (two semi-joins on a small id list)."""
    into = edges.join(ids.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    if incoming_only:
        return into.select(*edges.columns)
    out = edges.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    both = into.select(*edges.columns).unionByName(out.select(*edges.columns))
    return both.dropDuplicates(["source", "target", "kind"])


def subgraph(nodes: DataFrame, edges: DataFrame, query: str, *, references: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges around the three best hits of a query and the nodes they connect."""
    request = nodes.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    hits = durable(search_nodes(nodes, request, 3).select("id"))
    touched = durable(incident_edges(edges, hits, incoming_only=references))
    connected = (
        hits.unionByName(touched.select(F.explode(F.array("source", "target")).alias("id"))).distinct()
    )
    return nodes.join(connected, "id", "left_semi"), touched


def _hub_sides(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """``id, hub, side`` of the members of hubs. All members of a hub without links of its own are on both sides."""
    asks = edges.select(F.col("source").alias("id"), F.col("target").alias("hub")).join(hubs, "hub", "left_semi")
    offers = edges.select(F.col("target").alias("id"), F.col("source").alias("hub")).join(hubs, "hub", "left_semi")
    mutual = asks.join(offers.select("hub").distinct(), "hub", "left_anti")
    there = offers.unionByName(mutual).withColumn("side", F.lit("offer"))
    return asks.withColumn("side", F.lit("ask")).unionByName(there).select("id", "hub", "side").distinct()


def _across(members: DataFrame, met: DataFrame) -> DataFrame:
    """The ``members(id, hub, side, repo)`` that face one of ``met`` from another repository, without pairs."""
    other = F.when(F.col("side") == "ask", "offer").otherwise("ask").alias("side")
    facing = met.groupBy("hub", other).agg(F.min("repo").alias("a"), F.max("repo").alias("b"))
    # Two repositories on the other side face all members, one all but its own.
    return members.join(facing, ["hub", "side"]).filter("repo <> a or repo <> b").select(*members.columns)


def neighbourhood(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1, relation: str = "", limit: int = 400
) -> tuple[DataFrame, DataFrame]:
    """Undirected expansion around seeds, ``depth`` hops, nodes nearest first up to ``limit``.

    Only the new frontier is joined at each hop, and the hop stops once ``limit`` nodes are
    known, so the result bound also bounds the work. Ends that are no nodes don't count. Ties
    inside a hop go to the smaller id.

    A hub is walked through in one hop, to other repositories only, and is not listed. Where it
    has links of its own, that is from the nodes that link to it to those it links to, and back;
    else between all that link to it. Edges to or from a hub are returned where they are part of
    such a way between two nodes kept.
    """
    eligible = edges.filter(F.col("kind") == relation) if relation else edges
    both = eligible.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(
        eligible.select(F.col("target").alias("id"), F.col("source").alias("other"))
    )
    real = nodes.filter(F.col("kind") != HUB_KIND)
    hubs = nodes.filter(F.col("kind") == HUB_KIND).select(F.col("id").alias("other"))
    through = None
    if not hubs.isEmpty():
        sides = _hub_sides(eligible, hubs.select(F.col("other").alias("hub")))
        through = durable(sides.join(real.select("id", "repo"), "id"))
    known = durable(real.join(seeds.select("id").distinct(), "id", "left_semi").select("id", F.lit(0).alias("hop")))
    frontier = known
    for hop in range(1, max(0, depth) + 1):
        if known.count() >= limit:
            break
        reached = both.join(frontier.select("id"), "id", "left_semi").select(F.col("other").alias("id"))
        if through is not None:
            reached = reached.unionByName(_across(through, through.join(frontier.select("id"), "id", "left_semi")).select("id"))
        frontier = durable(
            reached.distinct()
            .join(known.select("id"), "id", "left_anti")
            .join(real.select("id"), "id", "left_semi")
            .orderBy("id")
            .limit(limit)
            .withColumn("hop", F.lit(hop))
        )
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    kept = durable(
        nodes.join(known, "id").orderBy("hop", "id").limit(limit)
    )
    ids = kept.select("id")
    inside = (
        eligible.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        .select(*edges.columns)
    )
    if through is not None:
        here = through.join(ids, "id", "left_semi")
        asks = F.col("side") == "ask"
        ends = _across(here, here).select(
            F.when(asks, F.col("id")).otherwise(F.col("hub")).alias("source"), F.when(asks, F.col("hub")).otherwise(F.col("id")).alias("target")
        )
        inside = inside.unionByName(eligible.join(ends, ["source", "target"], "left_semi").select(*edges.columns))
    inside = inside.orderBy("source", "target", "kind").limit(min(limit * 4, (1 << 31) - 1))
    return kept, inside


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """One path with the fewest hops (undirected); ties take the smaller parent id.

    Rows are ``position, id``; none if there is no path, or none within ``max_hops`` where that
    is given. Each hop keeps one parent per newly reached node. The back trace reads one row
    per hop.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("source").alias("at"), F.col("target").alias("id")).unionByName(
        edges.select(F.col("target").alias("at"), F.col("source").alias("id"))
    )
    first = spark.createDataFrame([(source,)], "id string")
    frontier = seen = durable(first)
    levels: list[DataFrame] = []
    found = source == target
    while not found and (max_hops is None or len(levels) < max_hops):
        level = durable(
            both.join(frontier.select(F.col("id").alias("at")), "at")
            .join(seen.select("id"), "id", "left_anti")
            .groupBy("id")
            .agg(F.min("at").alias("parent"))
        )
        if level.isEmpty():
            break
        levels.append(level)
        found = not level.filter(F.col("id") == target).isEmpty()
        frontier = level
        seen = durable(seen.unionByName(level.select("id")))
    if not found:
        return spark.createDataFrame([], "position int, id string")
    path = [target]
    for level in reversed(levels):
        path.append(level.filter(F.col("id") == path[-1]).first()["parent"])
    rows = [(i, node) for i, node in enumerate(reversed(path))]
    return spark.createDataFrame(rows, "position int, id string")


def context_lines(nodes: DataFrame, edges: DataFrame, queries: DataFrame, per_query: int = 20) -> DataFrame:
    """``a --kind--> b`` lines around the eight best hits of each query, at most twenty.

    Lines are ordered by hit rank, then kind, then the other end, so the result does not
    depend on set iteration order. One row per line; ``graph_chunks`` joins them into text.
    """
    hits = durable(search_nodes(nodes, queries, 8).select("query_id", "id", "position"))
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    ahead = edges.select(F.col("source").alias("id"), "kind", F.col("target").alias("other"))
    back = edges.select(
        F.col("target").alias("id"), F.concat(F.lit("reverse:"), "kind").alias("kind"), F.col("source").alias("other")
    )
    order = Window.partitionBy("query_id").orderBy("position", "kind", "other")
    near = ahead.unionByName(back).join(hits, "id")
    # Ends that are not nodes are skipped before the bound, as the bound counts kept lines.
    known = near.join(names.select("other"), "other", "left_semi")
    kept = known.withColumn("line_no", F.row_number().over(order)).filter(F.col("line_no") <= per_query)
    own = nodes.select("id", F.col("name").alias("own_name"))
    return kept.join(own, "id").join(names, "other").select(
        "query_id",
        "line_no",
        F.concat("own_name", F.lit(" --"), "kind", F.lit("--> "), "other_name").alias("line"),
    )


def graph_chunks(lines: DataFrame) -> DataFrame:
    """One knowledge-graph chunk per query from at most twenty lines."""
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"
    )
    return lines.groupBy("query_id").agg(text.alias("content")).select(
        "query_id",
        F.lit("graph").alias("chunk_id"),
        F.lit("knowledge-graph").alias("source"),
        "content",
        F.lit(0.88).alias("relevance"),
        F.lit(None).cast("string").alias("path"),
    )
