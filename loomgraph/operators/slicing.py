"""Compact source excerpts around symbols and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import SLICE_TERM, token_count, truncate_tokens
from loomgraph.operators.extract import source_lines
from loomgraph.operators.scans import asof, prefix, segment_of
from loomgraph.session import durable, large

CONTEXT_LINES = 2


def _next_lines(units: DataFrame) -> DataFrame:
    """Next declaration line after each line that declares something, per file."""
    lines = units.select("repo", "path", "line").distinct().withColumn("_rev", -F.col("line"))
    lines = lines.withColumn("_seg", segment_of(F.col("_rev"), 1024))
    return prefix(lines, ["repo", "path"], ["_rev"], "_seg", {"_next": ("last", F.col("line"))}, inclusive=False).select(
        "repo", "path", "line", "_next"
    )


def _window(lines: Column, start: Column, end: Column) -> Column:
    """Lines with zero-based start (inclusive) and end (exclusive), joined."""
    size = F.greatest(end - start, F.lit(0)).cast("int")
    return F.array_join(F.slice(lines, (start + 1).cast("int"), size), "\n")


def slice_symbols(requests: DataFrame, files: DataFrame, units: DataFrame, max_tokens: int | str = 800) -> DataFrame:
    """Source of the declaration nearest to each requested line.

    ``requests``: ``request_id, repo, path, symbol, line`` (line may be null: the first
    declaration). Two context lines are kept around it. A declaration without an end runs to
    the next one, or 80 lines on. An unknown symbol yields 12 lines before and 24 after the
    line. The nearest declaration comes from one lookup downwards and one upwards.
    ``max_tokens`` is a number or the name of a request column.
    """
    key = ["repo", "path", "symbol"]
    named = units.select(
        "repo", "path", F.col("name").alias("symbol"), F.col("line").cast("long").alias("line"),
        F.struct(F.col("line").alias("line"), "end_line").alias("_u"),
    )
    asked = requests.withColumn("_at", F.coalesce(F.col("line").cast("long"), F.lit(0).cast("long"))).withColumn("_neg", -F.col("_at"))
    below = asof(asked, named, key, "_at", "line", F.col("_u"), "_below")
    above = asof(below, named.withColumn("line", -F.col("line")), key, "_neg", "line", F.col("_u"), "_above")
    down, up = F.abs(F.col("_at") - F.col("_below.line")), F.abs(F.col("_above.line") - F.col("_at"))
    nearest = F.when(F.col("_above").isNull() | (down <= up), F.col("_below")).otherwise(F.col("_above"))
    unit = F.when(F.col("line").isNull(), F.col("_above")).otherwise(F.coalesce(nearest, F.col("_above")))
    chosen = above.withColumn("_unit", unit)
    following = _next_lines(units).select("repo", "path", F.col("line").alias("_ul"), "_next")
    chosen = chosen.withColumn("_ul", F.col("_unit.line")).join(large(following), ["repo", "path", "_ul"], "left")
    text = chosen.join(large(files.select("repo", "path", source_lines(F.col("content")).alias("_lines"))), ["repo", "path"])
    total = F.size("_lines")
    start = F.greatest(F.lit(0), F.col("_ul") - 1 - CONTEXT_LINES)
    open_end = F.when(F.col("_next").isNotNull(), F.col("_next") - 1).otherwise(F.least(total, F.col("_ul") + 80))
    end = F.least(total, F.coalesce(F.col("_unit.end_line"), open_end) + CONTEXT_LINES)
    center = F.greatest(F.lit(1).cast("long"), F.coalesce(F.nullif(F.col("line").cast("long"), F.lit(0)), F.lit(1)))
    around = _window(F.col("_lines"), F.greatest(F.lit(0), center - 12), F.least(total, center + 24))
    body = F.when(F.col("_unit").isNotNull(), _window(F.col("_lines"), start, end)).otherwise(around)
    limit = F.lit(max_tokens) if isinstance(max_tokens, int) else F.col(max_tokens)
    return text.select(
        *requests.columns, truncate_tokens(body, F.greatest(limit, F.lit(1))).alias("content"), F.col("_unit.end_line").alias("end_line")
    )


def slice_queries(queries: DataFrame, files: DataFrame, units: DataFrame, max_tokens: int = 1200, limit: int = 6) -> DataFrame:
    """Chunks of the declarations a question names, per (query, file).

    ``queries``: ``query_id, repo, path, query``. A declaration scores 4 per term equal to its
    name and 1 per term it references; the budget is shared evenly, at least 64 tokens each.
    Declarations meet questions through their words, so no pair without a hit is formed. Units are
    kept, because every lookup would parse all files again.
    """
    units = large(durable(units))
    terms = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(SLICE_TERM), F.lit(0)))
    wanted = queries.select("query_id", "repo", "path", F.explode(terms).alias("term"))
    own = F.struct(F.lower("name").alias("term"), F.lit(4).alias("w"))
    refs = F.transform(
        F.filter(F.array_distinct(F.transform("references", F.lower)), lambda r: r != F.lower("name")),
        lambda r: F.struct(r.alias("term"), F.lit(1).alias("w")),
    )
    words = units.select(
        "repo", "path", "name", "line", "end_line", "container", F.explode(F.concat(F.array(own), refs)).alias("t")
    ).select("repo", "path", "name", "line", "end_line", "container", "t.term", "t.w")
    scored = (
        words.join(large(wanted), ["repo", "path", "term"])
        .groupBy("query_id", "repo", "path", "name", "line", "end_line", "container")
        .agg(F.sum("w").alias("score"))
    )
    order = Window.partitionBy("query_id", "repo", "path").orderBy(F.desc("score"), "line", "name")
    top = scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= max(1, limit))
    count = top.groupBy("query_id", "repo", "path").agg(F.count("*").alias("_n"))
    share = F.greatest(F.lit(64), F.floor(F.lit(max_tokens) / F.greatest("_n", F.lit(1))).cast("int"))
    asked = top.join(large(count), ["query_id", "repo", "path"]).select(
        "query_id", "position", "repo", "path", F.col("name").alias("symbol"), "line", "container", share.alias("share")
    )
    cut = slice_symbols(asked, files, units, "share").filter("content <> ''")
    return cut.select(
        "query_id",
        "position",
        F.concat(F.lit("ast:"), "path", F.lit(":"), "symbol").alias("source"),
        "repo",
        "path",
        "symbol",
        "line",
        "container",
        "content",
        token_count(F.col("content")).alias("tokens"),
        F.lit(0.96).alias("relevance"),
    )
