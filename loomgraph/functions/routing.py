"""Request classification, capability scores and evidence layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that suggest each request kind, in tie-break order.
KIND_TERMS = {
    "locate": ("find", "where", "locate", "symbol", "definition", "reference"),
    "debug": ("bug", "debug", "error", "fail", "crash", "race", "trace"),
    "refactor": ("refactor", "rename", "extract", "move", "restructure"),
    "change": ("change", "edit", "implement", "add", "remove", "fix"),
    "review": ("review", "risk", "regression", "security", "inspect"),
    "explain": ("explain", "why", "how", "architecture", "understand"),
}
# Base score, boost and boosted kinds of each capability.
CAPABILITIES = {
    "repository": (0.35, 0.45, ("explain", "debug", "review")),
    "symbols": (0.30, 0.50, ("locate", "debug", "refactor", "change")),
    "context": (0.45, 0.0, ()),
    "memory": (0.20, 0.0, ()),
    "validation": (0.10, 0.55, ("debug", "refactor", "change", "review")),
}
# Words that boost memory and context.
MEMORY_TERMS = ("history", "previous", "decision", "remember", "again")
CONTEXT_TERMS = ("large", "logs", "context", "tokens", "many files")
SELECT_THRESHOLD = 0.50

# Words that call for each optional evidence layer.
PRECISION_TERMS = (
    "definition", "defined", "declaration", "references", "reference", "who calls", "callers",
    "call sites", "usages", "implements", "implementation", "implementations", "subclass",
    "override",
)
DEPENDENCY_TERMS = (
    "library", "package", "dependency", "dependencies", "upgrade", "migrate", "migration",
    "deprecated", "deprecation", "framework", "sdk", "api version", "installed version",
    "compatible", "compatibility", "breaking change", "release notes", "changelog",
    "supported api", "current api",
)
STRUCTURAL_TERMS = (
    "all usages", "all calls", "every call", "pattern", "shaped like", "codemod", "rewrite",
    "replace all", "find all", "across the codebase", "mechanical", "bulk",
)
BROAD_TERMS = ("all", "every", "everywhere")


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(text, F.lit(term))
    return hit


def _equals(name: str):
    return lambda item: item == name


def classify(query: Column) -> Column:
    """Kind with most distinct term hits; the first listed kind wins a tie."""
    text = F.lower(query)
    ranked = []
    for order, (kind, terms) in enumerate(KIND_TERMS.items()):
        hits = sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))
        ranked.append(F.struct(hits.alias("hits"), F.lit(-order).alias("first"), F.lit(kind).alias("kind")))
    best = F.array_max(F.array(*ranked))
    return F.when(best["hits"] > 0, best["kind"]).otherwise(F.lit("explain"))


def capability_scores(
    query: Column,
    kind: Column,
    *,
    repository_files: Column | None = None,
    latency_sensitive: Column | None = None,
    preferred: Column | None = None,
) -> Column:
    """``MAP<capability, score>`` before feedback and clamping."""
    text = F.lower(query)
    entries = []
    for name, (base, boost, kinds) in CAPABILITIES.items():
        score = F.lit(base)
        if kinds:
            score = score + F.when(kind.isin(*kinds), boost).otherwise(0.0)
        if name == "memory":
            score = score + F.when(contains_any(text, MEMORY_TERMS), 0.65).otherwise(0.0)
        if name == "context":
            score = score + F.when(contains_any(text, CONTEXT_TERMS), 0.35).otherwise(0.0)
        if repository_files is not None and name in ("context", "repository"):
            extra = 0.20 if name == "context" else 0.10
            score = score + F.when(repository_files >= 100_000, extra).otherwise(0.0)
        if latency_sensitive is not None and name in ("context", "memory"):
            cost = 0.10 if name == "context" else 0.05
            score = score - F.when(latency_sensitive, cost).otherwise(0.0)
        if preferred is not None:
            wanted = F.size(F.filter(preferred, _equals(name)))
            score = score + F.greatest(wanted, F.lit(0)) * 0.20
        entries += [F.lit(name), score]
    return F.create_map(*entries)


def evidence_plan(
    query: Column,
    kind: Column,
    *,
    has_position: Column | None = None,
    has_library: Column | None = None,
    has_pattern: Column | None = None,
) -> Column:
    """Ordered array of ``(layer, reason)``; the first matching reason of a layer is kept."""
    text = F.lower(query)
    no = F.lit(False)

    def layer(name: str, *rules: tuple[Column, Column]) -> Column:
        reason = F.coalesce(*[F.when(test, why) for test, why in rules])
        return F.when(
            reason.isNotNull(), F.struct(F.lit(name).alias("layer"), reason.alias("reason"))
        )

    precision = layer(
        "precision",
        (no if has_position is None else has_position, F.lit("the request names an exact file position")),
        (contains_any(text, PRECISION_TERMS), F.lit("the request asks about symbol relationships")),
        (
            kind.isin("locate", "refactor"),
            F.concat(F.lit("a "), kind, F.lit(" request benefits from exact navigation")),
        ),
    )
    docs = layer(
        "dependency_docs",
        (contains_any(text, DEPENDENCY_TERMS), F.lit("the request concerns a third-party dependency")),
        (no if has_library is None else has_library, F.lit("the request names a library explicitly")),
    )
    shape = layer(
        "structural",
        (contains_any(text, STRUCTURAL_TERMS), F.lit("the request describes a repeated code shape")),
        (no if has_pattern is None else has_pattern, F.lit("the request carries a structural pattern")),
        (
            (kind == "refactor") & contains_any(text, BROAD_TERMS),
            F.lit("a broad refactor benefits from structural matching"),
        ),
    )
    return F.filter(F.array(precision, docs, shape), lambda item: item.isNotNull())
