"""Evidence and edge scoring, validity rules, redaction, freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranking weight and rank of each trust tier, strongest first.
TRUST_WEIGHTS = {
    "exact": 1.00,
    "near_exact": 0.88,
    "structural": 0.72,
    "inferred_high": 0.58,
    "inferred": 0.42,
    "weak": 0.20,
}
CONFIDENCE_FLOOR = 0.35
STALE_PENALTY = 0.24948

# Strongest tier a provenance may claim.
TRUST_CEILING = {
    "precision-index": "exact",
    "structural-match": "structural",
    "dependency-documentation": "near_exact",
    "cross-file-heuristic": "inferred_high",
}

# Edge weights by kind, multipliers by how the edge was resolved.
EDGE_WEIGHTS = {
    "references": 1.0,
    "calls": 1.0,
    "inherits": 1.0,
    "implements": 0.9,
    "imports": 0.7,
    "contains": 0.35,
}
DEFAULT_EDGE_WEIGHT = 0.5
RESOLUTION_MULTIPLIERS = {
    "exact": 1.0,
    "stale_exact": 0.75,
    "inferred": 0.85,
    "unresolved": 0.6,
}

# Attribute names whose value is never stored.
SENSITIVE_KEY = (
    r"(?i)^(?:secret|password|passwd|api[_-]?key|authorization|cookie|token)$"
    r"|(?:^|[_-])(?:access|refresh|auth)[_-]?token(?:$|[_-])"
)


def lookup(table: dict, key: Column, default=None) -> Column:
    """``CASE`` over a small fixed table: no join and no broadcast."""
    value = F.lit(default)
    for name, entry in reversed(list(table.items())):
        value = F.when(key == name, F.lit(entry)).otherwise(value)
    return value


def evidence_score(trust: Column, confidence: Column, stale: Column) -> Column:
    weight = lookup(TRUST_WEIGHTS, trust, TRUST_WEIGHTS["weak"])
    fresh = weight * (CONFIDENCE_FLOOR + (1.0 - CONFIDENCE_FLOOR) * confidence)
    score = F.when(stale, fresh * STALE_PENALTY).otherwise(fresh)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)


def tier_rank(trust: Column) -> Column:
    return lookup({tier: i for i, tier in enumerate(TRUST_WEIGHTS)}, trust, len(TRUST_WEIGHTS))


def evidence_error(trust: Column, provenance: Column, exact: Column, stale: Column) -> Column:
    """Reason a record is quarantined; null when it is valid."""
    ceiling = lookup(
        {name: list(TRUST_WEIGHTS).index(tier) for name, tier in TRUST_CEILING.items()}, provenance, 0
    )
    return (
        F.when(exact & (trust != "exact"), F.lit("exact evidence needs the exact tier"))
        .when(exact & stale, F.lit("stale evidence cannot be exact"))
        .when(tier_rank(trust) < ceiling, F.lit("tier above provenance ceiling"))
    )


def location(path: Column, line: Column, column: Column) -> Column:
    """``path:line:column``, shortened where a part is unknown."""
    return (
        F.when(path.isNull(), F.lit(""))
        .when(line.isNull(), path)
        .when(column.isNull(), F.concat_ws(":", path, line.cast("string")))
        .otherwise(F.concat_ws(":", path, line.cast("string"), column.cast("string")))
    )


def evidence_header(trust: Column, kind: Column, place: Column, symbol: Column) -> Column:
    head = F.concat(F.lit("["), trust, F.lit("] "), kind)
    head = F.when(place != "", F.concat(head, F.lit(" "), place)).otherwise(head)
    named = symbol.isNotNull() & (symbol != "")
    return F.when(named, F.concat(head, F.lit(" — "), symbol)).otherwise(head)


def fingerprint(*parts: Column) -> Column:
    """Stable identity of a tuple of texts; equal inputs give equal ids."""
    return F.sha2(F.concat_ws("␟", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def edge_resolution(resolution: Column, confidence: Column) -> Column:
    return (
        F.when(resolution.isin(*RESOLUTION_MULTIPLIERS), resolution)
        .when(confidence <= 0.0, F.lit("unresolved"))
        .otherwise(F.lit("inferred"))
    )


def edge_weight(kind: Column, resolved: Column) -> Column:
    return lookup(EDGE_WEIGHTS, kind, DEFAULT_EDGE_WEIGHT) * lookup(RESOLUTION_MULTIPLIERS, resolved, 0.85)


def redact(attributes: Column) -> Column:
    """Mask sensitive keys of a string map."""
    return F.transform_values(
        attributes,
        lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit("[REDACTED]")).otherwise(v),
    )


def is_stale(created: Column, now: Column, ttl_seconds: int) -> Column:
    """True when a microsecond timestamp is older than the time to live."""
    return (now - created) > F.lit(ttl_seconds * 1_000_000)


def lenient_int(value: Column) -> Column:
    """Integer part of a numeric text or boolean, zero for anything else."""
    number = F.expr("double(null)") if value is None else value.try_cast("double")
    flag = F.when(F.lower(value) == "true", 1).when(F.lower(value) == "false", 0)
    whole = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)
    return F.coalesce(flag.cast("long"), whole.try_cast("long"), F.lit(0).cast("long"))
