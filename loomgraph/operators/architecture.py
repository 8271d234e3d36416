"""Architecture fingerprints, pattern inference and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import path_parts, zone

DEPENDENCY_KINDS = ("calls", "imports", "inherits", "implements")

# Signal groups of each pattern as (label, aliases, weight).
PATTERNS = {
    "hexagonal": (
        ("domain", ("domain", "entities", "aggregate"), 0.24),
        ("ports", ("ports", "port", "interfaces"), 0.24),
        ("adapters", ("adapters", "adapter"), 0.22),
        ("application", ("application", "usecases", "use_cases"), 0.18),
        ("infrastructure", ("infrastructure", "infra"), 0.12),
    ),
    "clean-architecture": (
        ("domain", ("domain", "entities"), 0.25),
        ("use-cases", ("usecases", "use_cases", "application"), 0.25),
        ("interfaces", ("interfaces", "presenters", "controllers"), 0.20),
        ("infrastructure", ("infrastructure", "frameworks", "drivers"), 0.20),
        ("dependency-boundaries", ("repository", "gateway"), 0.10),
    ),
    "layered": (
        ("presentation", ("controllers", "controller", "api", "routes"), 0.22),
        ("service", ("services", "service"), 0.24),
        ("persistence", ("repositories", "repository", "dao"), 0.24),
        ("model", ("models", "model", "entities"), 0.16),
        ("configuration", ("config", "configuration"), 0.14),
    ),
    "mvc": (
        ("models", ("models", "model"), 0.34),
        ("views", ("views", "templates", "view"), 0.33),
        ("controllers", ("controllers", "controller"), 0.33),
    ),
    "service-repository": (
        ("services", ("services", "service"), 0.38),
        ("repositories", ("repositories", "repository"), 0.38),
        ("models", ("models", "entities", "model"), 0.14),
        ("contracts", ("protocol", "interface", "contracts"), 0.10),
    ),
    "monorepo": (
        ("apps", ("apps", "applications"), 0.30),
        ("packages", ("packages", "libs", "libraries"), 0.30),
        ("workspace", ("workspace", "workspaces"), 0.15),
        ("shared", ("shared", "common"), 0.15),
        ("tooling", ("tools", "tooling"), 0.10),
    ),
    "plugin-oriented": (
        ("plugins", ("plugins", "plugin", "extensions"), 0.42),
        ("adapters", ("adapters", "providers"), 0.22),
        ("registry", ("registry", "registries"), 0.18),
        ("hooks", ("hooks", "hook"), 0.18),
    ),
}
PATTERN_THRESHOLD = 0.20


def pattern_table() -> list[tuple[str, str, str, float]]:
    return [
        (pattern, label, alias, weight)
        for pattern, groups in PATTERNS.items()
        for label, aliases, weight in groups
        for alias in aliases
    ]


def corpus_terms(nodes: DataFrame) -> DataFrame:
    """Vocabulary of each repository that any pattern mentions.

    Terms outside the fixed alias list are dropped before the distinct, so the shuffle holds
    at most a few dozen rows per repository.
    """

    def normal(value):
        return F.replace(F.lower(value), F.lit("-"), F.lit("_"))

    def pieces(value):
        return F.concat(F.array(value), F.split(value, "_"))

    stems = F.transform(
        path_parts(F.coalesce("path", F.lit(""))),
        lambda p: normal(F.regexp_replace(p, r"([^/])\.[^./]+$", "$1")),
    )
    terms = F.concat(
        F.flatten(F.transform(stems, pieces)), pieces(normal(F.col("name")))
    )
    aliases = sorted({row[2] for row in pattern_table()})
    wanted = F.filter(F.array_distinct(terms), lambda t: t.isin(*aliases))
    return nodes.select("repo", F.explode(wanted).alias("term")).distinct()


def infer_architecture(nodes: DataFrame) -> DataFrame:
    """Patterns above the threshold per repository: rank 1 is primary, 2 to 4 alternatives."""
    spark = nodes.sparkSession
    table = spark.createDataFrame(pattern_table(), "pattern string, label string, term string, weight double")
    # The table is a fixed list of a few dozen rows, whatever the corpus size.
    matched = (
        corpus_terms(nodes)
        .join(F.broadcast(table), "term")
        .groupBy("repo", "pattern", "label")
        .agg(F.max("weight").alias("weight"), F.array_sort(F.collect_set("term")).alias("terms"))
    )
    sizes = F.lit(None).cast("int")
    for name, groups in PATTERNS.items():
        sizes = F.when(F.col("pattern") == name, len(groups)).otherwise(sizes)
    found = F.concat("label", F.lit(": "), F.array_join(F.slice("terms", 1, 3), ", "))
    scored = (
        matched.withColumn("_line", found)
        .groupBy("repo", "pattern")
        .agg(
            F.sum(F.col("weight").cast("decimal(6,4)")).cast("double").alias("total"),
            F.count("*").alias("matched"),
            F.array_join(F.array_sort(F.collect_list("_line")), "; ").alias("evidence"),
        )
        .withColumn(
            "confidence",
            F.round(F.least(F.lit(1.0), F.col("total") * (0.70 + 0.30 * F.col("matched") / sizes)), 4),
        )
        .filter(F.col("confidence") >= PATTERN_THRESHOLD)
    )
    order = Window.partitionBy("repo").orderBy(F.desc("confidence"), "pattern")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 4")
    return ranked.select("repo", "rank", "pattern", "confidence", "evidence")


def zone_files(nodes: DataFrame) -> DataFrame:
    files = nodes.filter("kind = 'file' and path is not null and path <> ''")
    return files.groupBy("repo", zone(F.col("path")).alias("zone")).agg(F.count("*").alias("files"))


def dependency_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, signature, edges, unresolved`` over the four dependency kinds.

    After the join on ``source`` edges are already counted by (zone, target, kind), so the
    join on ``target`` carries a handful of rows per target however popular it is.
    """
    place = F.when(F.col("path").isNotNull() & (F.col("path") != ""), zone(F.col("path"))).otherwise("external")
    located = nodes.select("repo", "id", place.alias("zone"), F.col("kind").alias("node_kind"))
    source = located.select("repo", F.col("id").alias("source"), F.col("zone").alias("from"))
    target = located.select(
        "repo", F.col("id").alias("target"), F.col("zone").alias("to"), F.col("node_kind").alias("to_kind")
    )
    partial = (
        edges.filter(F.col("kind").isin(*DEPENDENCY_KINDS))
        .join(source, ["repo", "source"], "left")
        .groupBy("repo", F.coalesce("from", F.lit("external")).alias("from"), "target", "kind")
        .agg(F.count("*").alias("n"))
    )
    lost = F.col("to_kind").isNull() | F.col("to_kind").isin("reference", "module")
    signature = F.concat("from", F.lit("->"), F.coalesce("to", F.lit("external")), F.lit(":"), "kind")
    return (
        partial.join(target, ["repo", "target"], "left")
        .groupBy("repo", signature.alias("signature"))
        .agg(F.sum("n").alias("edges"), F.sum(F.when(lost, F.col("n")).otherwise(0)).alias("unresolved"))
    )


def unresolved_ratio(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy("repo").agg(
        (F.sum("unresolved") / F.greatest(F.sum("edges"), F.lit(1))).alias("ratio")
    )


def drift(
    base: DataFrame,
    current: DataFrame,
    base_patterns: DataFrame,
    current_patterns: DataFrame,
    growth_limit: float = 0.75,
) -> DataFrame:
    """Findings between two fingerprints: ``repo, kind, severity, score, message``.

    ``base`` and ``current`` come from ``dependency_counts``; the pattern tables hold the
    primary pattern of each repository.
    """
    before, now = F.coalesce("before", F.lit(0)), F.col("now")
    pairs = current.select("repo", "signature", F.col("edges").alias("now")).join(
        base.select("repo", "signature", F.col("edges").alias("before")), ["repo", "signature"], "left"
    )
    is_new = before == 0
    strong = F.contains("signature", F.lit(":calls")) | F.contains("signature", F.lit(":inherits"))
    growth = (now - before) / F.greatest(before, F.lit(1))
    grew = ~is_new & (now - before >= 2) & (growth > growth_limit)
    signatures = pairs.filter(is_new | grew).select(
        "repo",
        F.when(is_new, "new-dependency-direction").otherwise("dependency-growth").alias("kind"),
        F.when(is_new & strong, "high").otherwise("medium").alias("severity"),
        F.when(is_new & strong, 0.70)
        .when(is_new, 0.45)
        .otherwise(F.least(F.lit(0.70), 0.35 + growth * 0.20))
        .alias("score"),
        F.when(is_new, F.concat(F.lit("New dependency direction detected: "), "signature", F.lit(".")))
        .otherwise(F.concat(F.lit("Dependency volume increased sharply: "), "signature", F.lit(".")))
        .alias("message"),
    )

    def primary(patterns: DataFrame, prefix: str) -> DataFrame:
        return patterns.filter("rank = 1").select(
            "repo", F.col("pattern").alias(f"{prefix}_p"), F.col("confidence").alias(f"{prefix}_c")
        )

    both = primary(base_patterns, "b").join(primary(current_patterns, "c"), "repo", "full_outer")
    changed = F.col("b_p").isNotNull() & F.col("c_p").isNotNull() & (F.col("b_p") != F.col("c_p"))
    drop = F.round(F.coalesce("b_c", F.lit(0.0)) - F.coalesce("c_c", F.lit(0.0)), 9) >= 0.20
    patterns = both.filter(changed | drop).select(
        "repo",
        F.when(changed, "primary-pattern-change").otherwise("pattern-confidence-drop").alias("kind"),
        F.when(changed, "high").otherwise("medium").alias("severity"),
        F.when(changed, 0.90).otherwise(0.55).alias("score"),
        F.when(
            changed,
            F.concat(F.lit("Primary architecture changed from "), "b_p", F.lit(" to "), "c_p", F.lit(".")),
        )
        .otherwise("Architecture pattern confidence dropped materially.")
        .alias("message"),
    )
    ratios = unresolved_ratio(current).withColumnRenamed("ratio", "now").join(
        unresolved_ratio(base).withColumnRenamed("ratio", "before"), "repo", "left"
    )
    delta = F.col("now") - F.coalesce("before", F.lit(0.0))
    quality = ratios.filter(delta >= 0.12).select(
        "repo",
        F.lit("resolution-quality-drop").alias("kind"),
        F.lit("medium").alias("severity"),
        F.least(F.lit(0.65), 0.40 + delta).alias("score"),
        F.lit("Unresolved dependency ratio increased.").alias("message"),
    )
    return signatures.unionByName(patterns).unionByName(quality)


def drift_score(findings: DataFrame) -> DataFrame:
    """``1 - product(1 - min(0.95, score))`` per repository, as a sum of logarithms."""
    log = F.sum(F.log1p(-F.least(F.lit(0.95), F.col("score"))))
    return findings.groupBy("repo").agg(
        F.count("*").alias("findings"), F.round(1 - F.exp(log), 4).alias("score")
    )
