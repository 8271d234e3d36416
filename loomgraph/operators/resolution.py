"""Cross-file name resolution and position lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import directory, path_parts
from loomgraph.operators.scans import asof, stab, top_per
from loomgraph.session import durable, large

CALLABLE_KINDS = ("function", "async_function", "method")
TYPE_KINDS = ("class", "interface")
MAX_CANDIDATES = 5
#: Candidate folders of a list that are compared one by one, and shared names that count at most.
LIST = 64
DEEPEST = 4


def _folder_names(folder: Column) -> Column:
    """Distinct names on the way to a folder."""
    return F.array_distinct(F.filter(path_parts(folder), lambda name: name != ""))


def _best(met: DataFrame, keys: list[str]) -> DataFrame:
    """Best five candidates per ask as an array of ``(neg score, id, reasons)``."""
    fits = F.col("group") == F.col("fit")
    extra = F.when(fits, F.when(F.col("group") == "callable", "callable_kind").otherwise("type_kind"))
    score = F.least(F.lit(1.0), F.round(0.35 + F.col("worth") + F.when(fits, 0.08).otherwise(0.0), 6))
    reasons = F.filter(
        F.array(F.lit("exact_symbol_name"), F.nullif("reason", F.lit("")), extra), lambda r: r.isNotNull()
    )
    scored = (
        met.withColumn("_score", score)
        .groupBy(*keys, "id")
        .agg(F.max_by(F.struct("_score", reasons.alias("reasons")), "_score").alias("c"))
    )
    best = F.struct((-F.col("c._score")).alias("neg"), "id", F.col("c.reasons").alias("reasons"))
    ranked = top_per(scored.select(*keys, best.alias("best")), keys, [F.asc("best")], MAX_CANDIDATES)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("best")).alias("top"))


def _lists(places: DataFrame, sizes: DataFrame) -> DataFrame:
    """``repo, target, folder, names, key, rest``: a folder under each of its names, those of short lists first."""
    place = ["repo", "target", "folder"]
    names = places.select(*place, F.explode(_folder_names(F.col("folder"))).alias("name")).join(sizes, ["repo", "target", "name"])
    ranked = names.groupBy(*place).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("names"))
    return _further(ranked.select(*place, "names", F.lit("").alias("key"), F.col("names").alias("rest")))


def _further(lists: DataFrame) -> DataFrame:
    """Each folder under its list's key with any one of the names that follow."""
    spread = lists.select("repo", "target", "folder", "names", "key", "rest", F.posexplode("rest").alias("at", "name"))
    key = F.concat("key", F.lit("/"), "name").alias("key")
    return spread.select("repo", "target", "folder", "names", key, F.expr("slice(rest, at + 2, size(rest))").alias("rest"))


def _shared(asks: DataFrame, places: DataFrame, offers: DataFrame) -> DataFrame:
    """``repo, target, folder, group, id, worth`` of candidates whose folder shares names with an asking folder.

    Folders meet in lists of one name. In a list of at most ``LIST`` candidate folders all are
    compared. A longer one offers its smallest ids, and is split by another name, up to the four
    that count: five ids of a list, or folders with another name in common, are all that can
    be among the five best. Names that start short lists come first, so a path
    of many folders has a list for each and more only behind crowded ones.
    """
    sizes = places.select("repo", "target", F.explode(_folder_names(F.col("folder"))).alias("name"))
    sizes = large(durable(sizes.groupBy("repo", "target", "name").agg(F.count("*").alias("n"))))
    held, sought = large(durable(_lists(places, sizes))), large(durable(_lists(asks, sizes)))
    on, place = ["repo", "target", "key"], ["repo", "target", "folder"]
    pairs, found = None, None
    for depth in range(1, DEEPEST + 1):
        counts = large(durable(held.groupBy(*on).agg(F.count("*").alias("n"))))
        few, crowded = (counts.filter(c).select(*on) for c in (F.col("n") <= LIST, F.col("n") > LIST))
        close = large(sought.join(few, on)).join(held.select(*on, F.col("folder").alias("other"), F.col("names").alias("theirs")), on)
        close = close.select(*place, "names", "other", "theirs")
        pairs = close if pairs is None else pairs.unionByName(close)
        if counts.filter(F.col("n") > LIST).isEmpty():
            break
        many = large(durable(held.join(crowded, on)))
        first = _offers(many.select(*place, "key").join(offers, place), on)
        reached = sought.join(first, on).select(*place, "group", "id", F.lit(0.03 * depth).alias("worth"))
        found = reached if found is None else found.unionByName(reached)
        held, sought = large(durable(_further(many))), large(durable(_further(sought.join(crowded, on, "left_semi"))))
    alike = F.least(F.lit(DEEPEST), F.size(F.array_intersect("names", "theirs"))) * 0.03
    close = pairs.select(*place, "other", alike.alias("worth")).distinct()
    close = close.join(offers.withColumnRenamed("folder", "other"), ["repo", "target", "other"]).select(*place, "group", "id", "worth")
    return close if found is None else close.unionByName(found)


def _offers(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The five smallest ids per key and kind group; no other can reach a result."""
    return top_per(candidates.select(*keys, "group", "id"), [*keys, "group"], [F.asc("id")], MAX_CANDIDATES)


def _four_places(value: Column) -> Column:
    """Decimal rounding, half up, so a tie does not depend on binary representation."""
    return F.round(value.cast("decimal(18,10)"), 4).cast("double")


def resolve_targets(relations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rank same-name symbols for each relation without pairing them.

    ``relations``: ``repo, path, kind, target`` (plus any columns); ``candidates``: ``repo,
    id, name, kind, path``. A candidate scores 0.35, plus 0.35 in the same file, 0.20 in the
    same folder or 0.03 per shared folder name (at most 0.12), plus 0.08 when its kind fits.

    Only the five smallest ids of a kind group can matter in a folder, under a set of folder names,
    or of a name at all, so a name defined a million times shrinks to a few rows per folder
    before it meets its relations, and folders meet in lists by the names they share (see
    ``_shared``). Folders are settled once for all of their files, then joined by the candidates
    of the file itself. The result equals ranking all pairs.
    """
    kind = F.col("kind")
    group = F.when(kind.isin(*CALLABLE_KINDS), "callable").when(kind.isin(*TYPE_KINDS), "type").otherwise("other")
    known = candidates.filter("path is not null").select(
        "repo", F.col("name").alias("target"), "id", "path", group.alias("group")
    )
    fit = F.when(kind == "calls", "callable").when(kind.isin("inherits", "implements"), "type").otherwise("none")
    asks = large(relations.select("repo", "path", "target", fit.alias("fit"), directory(F.col("path")).alias("folder")))
    folder_key = ["repo", "target", "folder"]
    offers = large(durable(_offers(known.withColumn("folder", directory(F.col("path"))), folder_key)))
    folders = large(durable(asks.select("repo", "folder", "target", "fit").distinct()))
    shared = _shared(folders.select(*folder_key).distinct(), offers.select(*folder_key).distinct(), offers)
    rows = ["repo", "folder", "target", "fit", "group", "id"]
    same = folders.join(offers, folder_key).select(*rows, F.lit(0.20).alias("worth"), F.lit("same_directory").alias("reason"))
    some = folders.join(shared, folder_key).select(*rows, "worth", F.lit("shared_package_path").alias("reason"))
    anywhere = folders.join(_offers(known, ["repo", "target"]), ["repo", "target"])
    anywhere = anywhere.select(*rows, F.lit(0.0).alias("worth"), F.lit("").alias("reason"))
    by_folder = _best(same.unionByName(some).unionByName(anywhere), ["repo", "folder", "target", "fit"])
    own = asks.select("repo", "path", "target", "fit").distinct().withColumns(
        {"worth": F.lit(0.35), "reason": F.lit("same_file")}
    )
    file_key = ["repo", "path", "target"]
    by_file = _best(own.join(_offers(known, file_key), file_key), [*file_key, "fit"]).withColumnRenamed("top", "mine")
    placed = large(relations.withColumns({"fit": fit, "folder": directory(F.col("path"))}))
    joined = placed.join(by_folder, ["repo", "folder", "target", "fit"], "left").join(
        large(by_file), [*file_key, "fit"], "left"
    )
    none = F.array().cast("array<struct<neg:double,id:string,reasons:array<string>>>")
    merged = F.array_sort(F.concat(F.coalesce("mine", none), F.coalesce("top", none)))
    ids = F.transform(merged, lambda c: c["id"])
    once = F.filter(merged, lambda c, i: F.array_position(ids, c["id"]) == i + 1)
    listed = joined.withColumn("_top", F.slice(once, 1, MAX_CANDIDATES))
    best = -F.get("_top", F.lit(0))["neg"]
    second = F.coalesce(-F.get("_top", F.lit(1))["neg"], F.lit(0.0))
    margin = F.greatest(F.lit(0.0), best - second)
    ambiguity = F.when(F.size("_top") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - margin)))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), best * (1.0 - 0.45 * ambiguity)))
    found = F.size("_top") > 0
    prefix = F.when(F.col("kind") == "imports", "module:").otherwise("reference:")
    return listed.select(
        *relations.columns,
        F.when(found, F.get("_top", F.lit(0))["id"]).otherwise(F.concat(prefix, "target")).alias("target_id"),
        F.when(found, _four_places(confidence)).otherwise(0.0).alias("resolution_confidence"),
        F.when(found, _four_places(ambiguity)).otherwise(1.0).alias("ambiguity"),
        F.size("_top").alias("candidate_count"),
        F.transform(
            "_top", lambda c: F.struct(c["id"].alias("id"), F.round(-c["neg"], 4).alias("score"), c["reasons"].alias("reasons"))
        ).alias("candidates"),
    )


def relation_sources(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node each relation starts from: the latest same-name node at or above its line, else the file."""
    named = nodes.select("repo", "path", F.col("name").alias("source_symbol"), "line", "id")
    tagged = asof(
        large(relations.withColumn("_line", F.coalesce("line", F.lit(0)).cast("long"))),
        named.withColumn("line", F.coalesce("line", F.lit(0)).cast("long")),
        ["repo", "path", "source_symbol"],
        "_line",
        "line",
        F.col("id"),
        "_found",
        prefer=F.col("id"),
    )
    return tagged.select(
        *relations.columns, F.coalesce("_found", F.concat(F.lit("file:"), "path")).alias("source_id")
    )


def enclosing_nodes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Innermost symbol whose lines cover each point: largest start, then largest id."""
    spans = nodes.select(
        "repo",
        "path",
        F.coalesce("line", F.lit(0)).cast("long").alias("_s"),
        F.coalesce("end_line", "line", F.lit(0)).cast("long").alias("_e"),
        "id",
    )
    found = stab(
        points, spans, ["repo", "path"], "line", "_s", "_e", F.struct(F.col("_s"), F.col("id")), "_hit"
    )
    return found.select(*points.columns, F.col("_hit.id").alias("enclosing_id"))
