"""Syntax-shaped search and rewrite plans over Python files."""

from __future__ import annotations

import ast
import difflib
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import suffix

#: Files from which a rewrite counts as broad.
BROAD_FILES = 50
DIFF_CONTEXT = 3

_CAPTURE = re.compile(r"\$([A-Z_][A-Z0-9_]*)")
_HOLE = "__hole_"
MATCH_ROW = (
    "repo string, path string, start_line int, start_column int, end_line int, end_column int, "
    "byte_start int, byte_end int, matched_text string, captures map<string,string>, replacement string"
)


class RewriteRejected(ValueError):
    """A rewrite that goes past its limits or matches nothing."""


def _glob(pattern: str) -> str:
    out = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*")
    return "^" + out.replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"


def in_scope(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Paths that match an include glob (if any are given) and no exclude glob."""
    wanted = F.lit(not include)
    for pattern in include:
        wanted = wanted | path.rlike(_glob(pattern))
    for pattern in exclude:
        wanted = wanted & ~path.rlike(_glob(pattern))
    return wanted


def _bind(shape: object, node: object, holes: dict[str, ast.AST]) -> bool:
    """Whether a syntax node has the pattern's shape; one capture must bind equal code."""
    if isinstance(shape, ast.Expr) and not isinstance(node, ast.Expr):
        shape = shape.value
    if isinstance(shape, ast.Name) and shape.id.startswith(_HOLE):
        name = shape.id.removeprefix(_HOLE)
        if not isinstance(node, ast.expr):
            return False
        bound = holes.setdefault(name, node)
        return bound is node or ast.dump(bound) == ast.dump(node)
    if isinstance(shape, list):
        return isinstance(node, list) and len(shape) == len(node) and all(
            _bind(s, n, holes) for s, n in zip(shape, node, strict=True)
        )
    if isinstance(shape, ast.AST):
        return type(shape) is type(node) and all(
            _bind(value, getattr(node, field, None), holes)
            for field, value in ast.iter_fields(shape)
            if field not in ("ctx", "type_comment")
        )
    return shape == node


def _file_matches(source: str, shape: ast.AST, rewrite: str | None) -> Iterator[dict]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    data = source.encode("utf-8")
    starts = [0]
    for line in data.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    for node in ast.walk(tree):
        holes: dict[str, ast.AST] = {}
        if not isinstance(node, ast.expr) or not _bind(shape, node, holes):
            continue
        first, last = starts[node.lineno - 1], starts[node.end_lineno - 1]
        begin, end = first + node.col_offset, last + node.end_col_offset
        captures = {k: ast.get_source_segment(source, v) or ast.unparse(v) for k, v in holes.items()}
        yield {
            "start_line": node.lineno,
            "start_column": len(data[first:begin].decode("utf-8", "replace")) + 1,
            "end_line": node.end_lineno,
            "end_column": len(data[last:end].decode("utf-8", "replace")) + 1,
            "byte_start": begin,
            "byte_end": end,
            "matched_text": data[begin:end].decode("utf-8", "replace"),
            "captures": list(captures.items()),
            "replacement": None
            if rewrite is None
            else _CAPTURE.sub(lambda m: captures.get(m.group(1), m.group(0)), rewrite),
        }


def structural_search(
    files: DataFrame,
    pattern: str,
    *,
    rewrite: str | None = None,
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    limit: int | None = None,
) -> DataFrame:
    """Expressions shaped like ``pattern``, where ``$NAME`` stands for any expression.

    Scope globs and a required-word test run before any file reaches Python. Every match is
    kept unless a ``limit`` is given.
    """
    shape = ast.parse(_CAPTURE.sub(lambda m: _HOLE + m.group(1), pattern), mode="eval").body
    fixed = [w for w in re.findall(r"\w+", _CAPTURE.sub(" ", pattern)) if w.isidentifier()]
    kinds = {"string": pa.string(), "int": pa.int32(), "map<string": pa.map_(pa.string(), pa.string())}
    fields = [c.split() for c in MATCH_ROW.replace("map<string,string>", "map<string").split(", ")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"repo": file["repo"], "path": file["path"], **match}
                for file in batch.to_pylist()
                for match in _file_matches(file["content"], shape, rewrite)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kept = files.filter((suffix(F.col("path")) == ".py") & in_scope(F.col("path"), include, exclude))
    for word in fixed:
        kept = kept.filter(F.contains("content", F.lit(word)))
    matches = kept.select("repo", "path", "content").mapInArrow(scan, MATCH_ROW)
    return matches if limit is None else matches.orderBy("repo", "path", "start_line", "start_column").limit(limit)


@F.pandas_udf(T.StructType().add("updated", "string").add("diff", "string").add("sha256", "string").add("skipped", "integer"))
def _apply(path: pd.Series, content: pd.Series, edits: pd.Series) -> pd.DataFrame:
    rows = []
    for name, text, changes in zip(path, content, edits, strict=True):
        data = original = text.encode("utf-8")
        skipped = 0
        for edit in sorted(changes, key=lambda e: -e["byte_start"]):
            begin, end = edit["byte_start"], edit["byte_end"]
            if end > len(data) or begin > end:
                skipped += 1
                continue
            data = data[:begin] + edit["replacement"].encode("utf-8") + data[end:]
        updated = data.decode("utf-8", "replace")
        diff = difflib.unified_diff(
            text.splitlines(keepends=True), updated.splitlines(keepends=True), f"a/{name}", f"b/{name}", n=DIFF_CONTEXT
        )
        rows.append((updated, "".join(diff), hashlib.sha256(original).hexdigest(), skipped))
    return pd.DataFrame(rows, columns=["updated", "diff", "sha256", "skipped"])


def rewrite_plan(
    matches: DataFrame,
    files: DataFrame,
    *,
    max_files: int | None = None,
    max_matches: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """New content, diff and hash per file; rejected as a whole where a given limit is passed.

    Limits are checked by aggregates. Edits of a file are applied from its end, so earlier
    offsets stay valid.
    """
    totals = matches.agg(
        F.count("*").alias("matches"), F.count_distinct("repo", "path").alias("files")
    ).first()
    if totals["matches"] == 0:
        raise RewriteRejected("pattern matched nothing")
    if any(most is not None and totals[c] > most for c, most in (("files", max_files), ("matches", max_matches))):
        raise RewriteRejected(f"rewrite spans {totals['files']} files and {totals['matches']} matches")
    edits = matches.filter("replacement is not null").groupBy("repo", "path").agg(
        F.collect_list(F.struct("byte_start", "byte_end", "replacement")).alias("edits"), F.count("*").alias("matches")
    )
    planned = (
        edits.join(files.select("repo", "path", "content"), ["repo", "path"])
        .withColumn("p", _apply("path", "content", "edits"))
        .filter(F.col("p.updated") != F.col("content"))
    )
    grown = F.abs(F.octet_length("p.updated") - F.octet_length("content"))
    plan = planned.select(
        "repo",
        "path",
        "matches",
        F.col("p.sha256").alias("original_sha256"),
        (grown + F.col("matches")).alias("changed_bytes"),
        F.col("p.diff").alias("diff"),
        F.col("p.updated").alias("content"),
        F.col("p.skipped").alias("skipped"),
    )
    size = plan.agg(F.coalesce(F.sum("changed_bytes"), F.lit(0))).first()[0] if max_bytes is not None else 0
    if max_bytes is not None and size > max_bytes:
        raise RewriteRejected(f"rewrite would change {size} bytes")
    return plan


def rewrite_risk(plan: DataFrame, impacts: DataFrame, broad: int = BROAD_FILES) -> DataFrame:
    """``0.6`` strongest impact of the rewritten files' symbols plus ``0.4`` breadth."""
    breadth = F.least(F.lit(1.0), F.count("*") / max(1, broad))
    deepest = F.coalesce(impacts.agg(F.max("risk_score")).scalar(), F.lit(0.0))
    return plan.agg(breadth.alias("breadth")).select(
        F.round(F.least(F.lit(1.0), 0.6 * deepest + 0.4 * F.col("breadth")), 4).alias("risk_score")
    )
