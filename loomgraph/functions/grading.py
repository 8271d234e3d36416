"""Deterministic grading of answers against expectations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grade(
    answer: Column,
    files_touched: Column,
    tokens: Column,
    tool_calls: Column,
    required: Column,
    forbidden: Column,
    required_paths: Column,
    max_tokens: Column,
    max_tool_calls: Column,
) -> Column:
    """Struct of passed, score, checks and failures (both arrays of labels)."""
    low = F.lower(answer)
    touched = F.transform(files_touched, lambda p: F.replace(p, F.lit("\\"), F.lit("/")))

    def check(label: Column, ok: Column) -> Column:
        return F.struct(label.alias("label"), ok.alias("ok"))

    def limit(name: str, bound: Column, value: Column) -> Column:
        label = F.concat(F.lit(f"{name}:"), bound.cast("string"))
        return F.when(bound.isNull(), F.array().cast("array<struct<label:string,ok:boolean>>")).otherwise(
            F.array(check(label, value <= bound))
        )

    checks = F.concat(
        F.transform(
            required,
            lambda v: check(F.concat(F.lit("required-string:"), v), F.contains(low, F.lower(v))),
        ),
        F.transform(
            forbidden,
            lambda v: check(F.concat(F.lit("forbidden-string:"), v), ~F.contains(low, F.lower(v))),
        ),
        F.transform(
            required_paths,
            lambda p: check(
                F.concat(F.lit("required-path:"), p),
                F.array_contains(touched, F.replace(p, F.lit("\\"), F.lit("/"))),
            ),
        ),
        limit("max-tokens", max_tokens, tokens),
        limit("max-tool-calls", max_tool_calls, tool_calls),
    )
    failures = F.filter(checks, lambda c: ~c["ok"])
    total = F.size(checks)
    return F.struct(
        (F.size(failures) == 0).alias("passed"),
        F.when(total == 0, F.lit(1.0))
        .otherwise((total - F.size(failures)) / F.greatest(total, F.lit(1)))
        .alias("score"),
        F.transform(checks, lambda c: c["label"]).alias("checks"),
        F.transform(failures, lambda c: c["label"]).alias("failures"),
    )
