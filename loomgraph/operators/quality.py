"""Retrieval quality, benchmark results and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric, direction, allowed relative and absolute regression.
DEFAULT_POLICIES = (
    ("success_rate", "higher", None, 0.02),
    ("avg_path_recall", "higher", None, 0.03),
    ("avg_symbol_recall", "higher", None, 0.03),
    ("avg_duration_ms", "lower", 0.20, None),
    ("avg_context_tokens", "lower", 0.10, None),
    ("avg_files_read", "lower", 0.15, None),
    ("avg_tool_calls", "lower", 0.15, None),
)
SCALE_TARGETS = (100_000, 1_000_000)


def retrieval_quality(hits: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """Recall over distinct expected ids, precision over hits, reciprocal rank per case.

    ``hits``: ``case_id, rank, id``; ``expected``: ``case_id, id``; ``cases``: ``case_id``.
    """
    wanted = expected.distinct().withColumn("_want", F.lit(True))
    marked = hits.join(wanted, ["case_id", "id"], "left")
    found = marked.groupBy("case_id").agg(
        F.count("*").alias("hits"),
        F.count("_want").alias("good"),
        F.min(F.when(F.col("_want"), F.col("rank"))).alias("first"),
    )
    # Distinct recovered ids: one row per (case, id) first, then a plain count.
    recovered = hits.select("case_id", "id").distinct().join(wanted, ["case_id", "id"], "left_semi")
    recovered = recovered.groupBy("case_id").agg(F.count("*").alias("recovered"))
    size = wanted.groupBy("case_id").agg(F.count("*").alias("expected"))
    joined = (
        cases.select("case_id")
        .join(found, "case_id", "left")
        .join(recovered, "case_id", "left")
        .join(size, "case_id", "left")
    )
    none = F.lit(0)
    return joined.select(
        "case_id",
        F.when(F.col("expected").isNull(), 1.0)
        .otherwise(F.coalesce("recovered", none) / F.col("expected"))
        .alias("recall"),
        F.when(F.col("hits").isNull(), 0.0).otherwise(F.col("good") / F.col("hits")).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def quality_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").cast("double").alias("cases"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("avg_recall"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("avg_precision"),
        F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
    )


def lenient_recall(cases: DataFrame, actual: DataFrame, expected: str) -> DataFrame:
    """Share of expected texts found inside any returned text of the case (case-insensitive).

    ``cases``: ``case_id`` and the expected array; ``actual``: ``case_id, value``. Matches are
    OR-ed flag by flag, so a case with many results never becomes one list.
    """
    wanted = cases.select("case_id", F.posexplode_outer(expected).alias("_pos", "_text"))
    tested = wanted.filter("_text is not null").join(actual.select("case_id", F.lower("value").alias("_v")), "case_id", "left")
    per_text = tested.groupBy("case_id", "_pos").agg(
        F.coalesce(F.bool_or(F.contains("_v", F.lower("_text"))), F.lit(False)).alias("_hit")
    )
    share = per_text.groupBy("case_id").agg(F.avg(F.col("_hit").cast("double")).alias("recall"))
    return cases.select("case_id").join(share, "case_id", "left").select(
        "case_id", F.coalesce("recall", F.lit(1.0)).alias("recall")
    )


def case_success(expected_paths: Column, expected_symbols: Column, path_recall: Column, symbol_recall: Column) -> Column:
    paths_ok = (F.size(expected_paths) <= 0) | (path_recall > 0)
    symbols_ok = (F.size(expected_symbols) <= 0) | (symbol_recall > 0)
    return paths_ok & symbols_ok


def target_precision(results: DataFrame) -> DataFrame:
    """Precision per strategy from correct and false target counts."""
    totals = results.groupBy("strategy").agg(
        F.sum("correct_targets").alias("correct_targets"), F.sum("false_targets").alias("false_targets")
    )
    total = F.col("correct_targets") + F.col("false_targets")
    return totals.withColumn(
        "precision", F.when(total == 0, 0.0).otherwise(F.round(F.col("correct_targets") / total, 4))
    )


def scale_sample(files: DataFrame) -> DataFrame:
    """Files seen against the published scale targets."""
    seen = files.agg(F.count("*").alias("files"))
    return seen.select(
        F.explode(F.array(*[F.lit(t) for t in SCALE_TARGETS])).alias("target"), "files"
    ).select("target", "files", (F.col("files") >= F.col("target")).alias("reached"))


def regression_gate(current: DataFrame, baseline: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Every compared metric with its change and the reason it violates its policy, if any.

    Metrics are long form: ``strategy, metric, value``.
    """
    if policies is None:
        policies = current.sparkSession.createDataFrame(
            list(DEFAULT_POLICIES), "metric string, direction string, max_relative double, max_absolute double"
        )
    joined = (
        current.select("strategy", "metric", F.col("value").alias("now"))
        .join(baseline.select("strategy", "metric", F.col("value").alias("before")), ["strategy", "metric"])
        .join(policies, "metric")
    )
    absolute = F.col("now") - F.col("before")
    regression = F.when(F.col("direction") == "higher", -absolute).otherwise(absolute)
    relative = F.when(F.col("before") != 0, regression / F.abs("before"))
    absolute_reason = F.when(
        regression > F.col("max_absolute"),
        F.format_string("absolute regression %.4f > %.4f", regression, F.col("max_absolute")),
    )
    relative_reason = F.when(
        relative > F.col("max_relative"),
        F.format_string("relative regression %.2f%% > %.2f%%", relative * 100, F.col("max_relative") * 100),
    )
    reason = F.when(regression > 0, F.concat_ws("; ", absolute_reason, relative_reason)).otherwise("")
    return joined.select(
        "strategy",
        "metric",
        F.col("before").alias("baseline"),
        F.col("now").alias("current"),
        F.when(F.col("before") != 0, absolute / F.abs("before")).alias("relative_change"),
        absolute.alias("absolute_change"),
        reason.alias("reason"),
    )


def gate_report(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.coalesce(F.bool_and(F.col("reason") == ""), F.lit(True)).alias("passed"),
        F.count("*").alias("compared_metrics"),
        F.count_if(F.col("reason") != "").alias("violations"),
    )
