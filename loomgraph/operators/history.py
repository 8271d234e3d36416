"""Commit history: hot files, authors, co-change, ownership, changed symbols, review risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.scans import overlapping, prefix, segment_of, top_per
from loomgraph.session import durable, large, release

#: Commits touching more files than this are counted by file groups, not by file pairs.
WIDE_COMMIT = 64
#: Groups of a wide commit that one task pairs with as many others, and wide commits whose first pairs give a bound.
TILE = 1024
SEEDS = 64


def touches(commits: DataFrame) -> DataFrame:
    return commits.filter("path is not null").select("sha", "path").distinct()


def hot_files(commits: DataFrame, top: int = 30) -> DataFrame:
    changes = touches(commits).groupBy("path").agg(F.count("*").alias("changes"))
    return changes.orderBy(F.desc("changes"), "path").limit(top)


def author_activity(commits: DataFrame, top: int = 20) -> DataFrame:
    per_author = commits.select("sha", "author", "email").distinct().groupBy("author", "email")
    return per_author.agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "author", "email").limit(top)


def _histories(broad: DataFrame) -> DataFrame:
    """``path, group, touched``: files that took part in the same commits share a group, named by its first file.

    A set of commits is named by its size and by the sum and exclusive or of two 64-bit hashes of
    its members, which add up commit by commit: no file's history is ever one value.
    """
    one, other = F.xxhash64("sha"), F.xxhash64(F.lit("other"), "sha")
    low = one.bitwiseAND((1 << 32) - 1)
    sketch = broad.groupBy("path").agg(
        F.count("*").alias("touched"), F.sum(low).alias("_s"), F.bit_xor(one).alias("_x"), F.bit_xor(other).alias("_y")
    )
    alike = ["touched", "_s", "_x", "_y"]
    named = sketch.groupBy(*alike).agg(F.min("path").alias("group"))
    return sketch.join(large(named), alike).select("path", "group", "touched")


def _counted(member: DataFrame) -> DataFrame:
    """``ga, gb, common``: commits of at most ``WIDE_COMMIT`` files that two groups share, of all pairs ``ga < gb`` that do."""
    few = member.filter(F.col("_files") <= WIDE_COMMIT)
    met = few.select("sha", F.col("group").alias("ga")).join(few.select("sha", F.col("group").alias("gb")), "sha").filter("ga < gb")
    return met.groupBy("ga", "gb").agg(F.count("*").alias("common"))


def _overlaps(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """``ga, gb, common``: commits that two groups share, for the pairs ``ga < gb`` asked for.

    A commit of at most ``WIDE_COMMIT`` files counts its own pairs, so a membership costs a bounded
    number of rows, however long the histories are. Wider commits are looked up pair by pair.
    """
    met = _counted(member).join(large(pairs.select("ga", "gb")), ["ga", "gb"], "left_semi")
    many = member.filter(F.col("_files") > WIDE_COMMIT)
    first = pairs.join(many.select(F.col("group").alias("ga"), "sha"), "ga")
    found = first.join(many.select(F.col("group").alias("gb"), "sha"), ["gb", "sha"]).groupBy("ga", "gb").agg(F.count("*").alias("common"))
    return met.unionByName(found).groupBy("ga", "gb").agg(F.sum("common").alias("common"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs ``ga < gb`` of groups that meet in a commit, tile by tile.

    ``left`` and ``right`` hold ``sha, group``. A commit's groups are dealt to tiles of about ``TILE``
    on both sides, and every pair of tiles is a join key of its own. A frame with itself meets in one order.
    """
    tiles = right.groupBy("sha").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_rights"))
    tiles = left.groupBy("sha").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_lefts")).join(tiles, "sha")

    def dealt(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        tile = F.pmod(F.xxhash64("group"), F.col(f"_{own}")).alias(f"_{own[0]}")
        spread = F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1)).alias(f"_{other[0]}")
        return side.join(tiles, "sha").select("sha", F.col("group").alias(name), tile.cast("int").alias(f"_{own[0]}"), spread)

    met = dealt(left, "x", "lefts", "rights").join(dealt(right, "y", "rights", "lefts"), ["sha", "_l", "_r"]).filter("x < y" if left is right else "x <> y")
    return met.select(F.least("x", "y").alias("ga"), F.greatest("x", "y").alias("gb")).distinct()


def _but_widest(member: DataFrame, n: int) -> DataFrame:
    """Memberships without every group's ``n`` widest commits.

    Two groups that share more than ``n`` commits also meet in one of these: with commits in one
    order, the last ``n`` of either cannot hold all that they share.
    """
    if n < 1:
        return member.select("sha", "group")
    widest = top_per(member, ["group"], [F.desc("_files"), F.desc("sha")], n)
    return member.filter(F.col("touched") > n).join(widest.select("sha", "group"), ["sha", "group"], "left_anti").select("sha", "group")


def co_change(commits: DataFrame, top: int = 30, wide: int = WIDE_COMMIT) -> DataFrame:
    """File pairs that change together most often.

    A commit of at most ``wide`` files is expanded into its pairs, so one row grows by a
    bounded factor. A wider commit is not. Files that took part in exactly the same wide commits
    form one group, as any two files of two given groups share the same number of them.

    A pair that meets in a narrow commit is counted exactly, by adding its groups' overlap. With
    some pairs of the most touched groups and of the widest commits that gives ``top`` pairs, and
    so a count ``least`` that a pair must exceed, or reach with a path in front of the
    last one's. Two groups that share so many commits also meet in one that is not among the
    widest few of either, so the widest commits are left out of the search; what meets is
    recounted. Of the pairs of two groups, all equal, only those of the ``top + 1`` first files
    of each can reach the result. So the result equals the full count.

    Files are numbered in the order of their paths, so that pairs are two numbers.
    """
    named = touches(commits)
    numbers = durable(named.select("path").distinct().orderBy("path").withColumn("_number", F.monotonically_increasing_id()))
    files = durable(named.join(large(numbers), "path").select("sha", F.col("_number").alias("path")))

    def first_pairs(found: DataFrame) -> DataFrame:
        """The first pairs in order, under the paths of their files."""
        best = found.orderBy(*order).limit(top)
        for end in ("left", "right"):
            best = best.join(numbers.select(F.col("_number").alias(end), F.col("path").alias(f"_{end}")), end)
        return best.select(F.col("_left").alias("left"), F.col("_right").alias("right"), "commits").orderBy(*order)

    sizes = files.groupBy("sha").agg(F.count("*").alias("_files"))
    is_wide = F.col("_files") > wide
    narrow = files.join(sizes.filter(~is_wide).select("sha"), "sha", "left_semi")
    left = narrow.select("sha", F.col("path").alias("left"))
    right = narrow.select("sha", F.col("path").alias("right"))
    met = (
        left.join(right, "sha")
        .filter("left < right")
        .groupBy("left", "right")
        .agg(F.count("*").alias("narrow"))
    )
    order = [F.desc("commits"), F.asc("left"), F.asc("right")]
    broad = durable(files.join(sizes.filter(is_wide), "sha"))
    if broad.isEmpty():
        return first_pairs(met.select("left", "right", F.col("narrow").alias("commits")))
    met = durable(met)
    label = durable(_histories(broad))
    groups = label.groupBy("group").agg(F.min("path").alias("path"), F.max("touched").alias("touched"), F.count("*").alias("files"))
    groups = durable(groups)
    member = durable(broad.join(groups.select("path", "group", "touched"), "path").select("sha", "_files", "group", "touched", "path"))
    release(files)
    firsts = durable(top_per(label.select("path", "group"), ["group"], [F.asc("path")], top + 1))

    def side(name: str) -> DataFrame:
        return label.select(F.col("path").alias(name), F.col("group").alias(f"g_{name}"), F.col("touched").alias(f"n_{name}"))

    def counted(pairs: DataFrame) -> DataFrame:
        """``ga, gb, common`` of pairs of groups, with those of one group."""
        apart = _overlaps(pairs.filter("ga <> gb"), member)
        same = pairs.filter("ga = gb").join(groups.select(F.col("group").alias("ga"), F.col("touched").alias("common")), "ga")
        return apart.unionByName(same)

    def expanded(overlaps: DataFrame) -> DataFrame:
        """The first pairs of files of pairs of groups, but those that a narrow commit counts."""
        turned = overlaps.unionByName(overlaps.filter("ga <> gb").selectExpr("gb as ga", "ga as gb", "common"))
        return (
            turned.join(firsts.select(F.col("group").alias("ga"), F.col("path").alias("left")), "ga")
            .join(firsts.select(F.col("group").alias("gb"), F.col("path").alias("right")), "gb")
            .filter("left < right")
            .select("left", "right", F.col("common").alias("commits"))
            .join(met, ["left", "right"], "left_anti")
        )

    # Pairs of narrow commits: one that even its groups' smaller history cannot lift is left out.
    known = met.orderBy(F.desc("narrow")).limit(top).agg(F.count("*").alias("n"), F.min("narrow").alias("least")).first()
    most = F.col("narrow") + F.coalesce(F.least("n_left", "n_right"), F.lit(0))
    most = F.when(F.col("n_left").isNull() | F.col("n_right").isNull(), F.col("narrow")).otherwise(most)
    held = met.join(side("left"), "left", "left").join(side("right"), "right", "left")
    held = durable(held.filter(most >= (known["least"] if known["n"] == top else 1)))
    both = held.filter("g_left is not null and g_right is not null")
    asked = both.select(F.least("g_left", "g_right").alias("ga"), F.greatest("g_left", "g_right").alias("gb")).distinct()
    lifts = counted(asked)
    pair = [F.least("g_left", "g_right") == F.col("ga"), F.greatest("g_left", "g_right") == F.col("gb")]
    exact = held.join(lifts, pair, "left").select("left", "right", (F.col("narrow") + F.coalesce("common", F.lit(0))).alias("commits"))
    exact = durable(exact.orderBy(*order).limit(top))

    # Some pairs of wide commits, for a good bound: any others would be as right, and cost more.
    copies = groups.filter("files > 1").orderBy(F.desc("touched"), "path").limit(top).select(F.col("group").alias("ga"), F.col("group").alias("gb"))
    widest = broad.select("sha", "_files").distinct().orderBy(F.desc("_files"), "sha").limit(SEEDS)
    early = top_per(member.join(widest.select("sha"), "sha"), ["sha"], [F.asc("path")], top + 1)
    lead = early.groupBy("sha").agg(F.min_by("group", "path").alias("x"))
    early = early.join(lead, "sha").filter("x <> group").select(F.least("x", "group").alias("ga"), F.greatest("x", "group").alias("gb"))
    seeds = expanded(counted(durable(copies.unionByName(early.distinct()))))
    best = exact.unionByName(seeds).orderBy(*order).limit(top)
    bound = best.agg(F.count("*").alias("n"), F.min("commits").alias("least"), F.max_by("left", F.struct(-F.col("commits"), "left")).alias("last")).first()
    least, last = (bound["least"], bound["last"]) if bound["n"] == top else (0, None)

    def same(condition) -> DataFrame:
        return groups.filter("files > 1").filter(condition).select(F.col("group").alias("ga"), F.col("group").alias("gb"))

    if member.filter(F.col("_files") > WIDE_COMMIT).isEmpty():
        # Every commit counts its own pairs: there is nothing to look up.
        apart = _counted(member).filter(F.col("common") >= max(least, 1))
        alike = same(F.col("touched") >= max(least, 1)).join(groups.select(F.col("group").alias("ga"), F.col("touched").alias("common")), "ga")
        fresh = expanded(durable(apart.unionByName(alike)))
        release(broad, label, groups, member, held)
        return first_pairs(exact.unionByName(fresh))
    more = _but_widest(member, least)
    found = _met(more, more).unionByName(same(F.col("touched") > least))
    if least:
        # As many as the last of the best: only in front of it, so one file's group starts no later.
        ties = _but_widest(member, least - 1)
        front = groups.filter(F.col("path") <= last).select("group")
        found = found.unionByName(_met(ties.join(front, "group", "left_semi"), ties))
        found = found.unionByName(same((F.col("touched") == least) & (F.col("path") <= last)))
    fresh = expanded(counted(durable(found.distinct())).filter(F.col("common") >= max(least, 1)))
    return first_pairs(exact.unionByName(fresh))


def line_ownership(blame: DataFrame, keys: list[str]) -> DataFrame:
    owned = blame.filter("author is not null and author <> ''")
    return owned.groupBy(*keys, "author", "email").agg(F.count("*").alias("lines"))


def symbol_history(
    blame: DataFrame, commits: DataFrame, path: str, start: int, end: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commits, blame lines and owners of one line range."""
    lines = blame.filter((F.col("path") == path) & F.col("line").between(start, end))
    touching = commits.join(lines.select("sha").distinct(), "sha", "left_semi")
    unique = touching.select("sha", "author", "email", "date", "subject").dropDuplicates(["sha"])
    return unique, lines, line_ownership(lines, ["path"])


def symbol_ranges(units: DataFrame, totals: DataFrame) -> DataFrame:
    """Line range per unit; an open end runs to the line before the next unit of the file.

    ``totals`` has ``repo, path, lines``. Units are ordered by (line, name), so only the last
    unit of a line can reach past it; the next line is a running lookup over distinct lines.
    """
    key = ["repo", "path"]
    lines = units.groupBy(*key, "line").agg(F.max("name").alias("_last"))
    lines = lines.withColumn("_rev", -F.col("line")).withColumn("_seg", segment_of(F.col("_rev"), 1024))
    spaced = prefix(lines, key, ["_rev"], "_seg", {"_next": ("last", F.col("line"))}, inclusive=False)
    placed = units.join(large(spaced.select(*key, "line", "_last", "_next")), [*key, "line"]).join(large(totals), key, "left")
    after = F.when(F.col("name") < F.col("_last"), F.col("line")).otherwise(
        F.coalesce("_next", F.coalesce("lines", F.lit(1)) + 1)
    )
    return placed.select(
        *units.columns, F.coalesce("end_line", F.greatest("line", after - 1)).alias("end")
    )


def changed_symbols(symbols: DataFrame, files: DataFrame, hunks: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols a change touches: any range overlaps a hunk, or the file has no hunks at all.

    ``symbols``: ``keys, line, end``; ``files``: changed files; ``hunks``: ``keys, start, end``.
    """
    inside = large(symbols).join(files.select(*keys).distinct(), keys, "left_semi")
    real = hunks.filter("start is not null").select(*keys, F.col("start").alias("_hs"), F.col("end").alias("_he"))
    hit = overlapping(inside, real, keys, "line", "end", "_hs", "_he")
    whole = large(inside).join(real.select(*keys).distinct(), keys, "left_anti")
    return hit.unionByName(whole)


def risk_level(score):
    return F.when(score >= 0.70, "high").when(score >= 0.40, "medium").otherwise("low")


def pr_risk(files: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Risk per change: 0.55 strongest impact, 0.25 breadth, 0.20 churn.

    ``files``: ``keys, additions, deletions``; ``symbols``: ``keys, impact_risk``.
    """
    size = files.groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum(F.col("additions") + F.col("deletions")).alias("churn")
    )
    strongest = symbols.groupBy(*keys).agg(
        F.max("impact_risk").alias("max_impact"), F.count("*").alias("symbols")
    )
    joined = size.join(strongest, keys, "left")
    score = F.least(
        F.lit(1.0),
        F.coalesce("max_impact", F.lit(0.0)) * 0.55
        + F.least(F.lit(1.0), F.col("files") / 20) * 0.25
        + F.least(F.lit(1.0), F.col("churn") / 600) * 0.20,
    )
    return joined.select(
        *keys,
        "files",
        "churn",
        F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols"),
        F.round(score, 4).alias("risk_score"),
        risk_level(score).alias("risk_level"),
    )
