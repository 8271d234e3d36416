"""URL rules: a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules in one broadcast trie; longer lists are walked as several tries.
TRIE_RULES = 100_000

#: What no rule decides.
DEFAULT_VERDICT = "allow"

#: Ordered so that the greatest answer is the longest; a block wins a tie.
ANSWER = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("labels", "chars", "blocks")]
    + [T.StructField(n, T.StringType()) for n in ("rule", "verdict")]
)


class Rule(NamedTuple):
    """``verdict`` is allow or block; the path may be a whole prefix or end inside a segment."""

    verdict: str
    host: str
    path: str = "/"


def parse_rule(verdict: str, text: str) -> Rule:
    """A rule written as ``host/path``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def build_trie(rules: Iterable[Rule]) -> dict:
    """Host labels from the right, then under ``"/"`` the path's whole segments.

    A node's ``""`` entry lists what has to follow its segments, with the rule. A rule given
    twice with both verdicts blocks.
    """
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault(("host", label), {})
        *whole, rest = rule.path.split("/")
        for segment in whole:
            node = node.setdefault(("path", segment), {})
        entries = node.setdefault("", {})
        if entries.get(rest, ("",))[0] != "block":
            entries[rest] = (rule.verdict, rule.host + rule.path, rule.host.count(".") + 1, len(rule.path))
    return root


def longest(trie: dict, host: str, path: str) -> tuple | None:
    """The entry with the most host labels and then the longest path that fits."""
    best = None
    node = trie
    for label in reversed(host.split(".")):
        node = node.get(("host", label))
        if node is None:
            break
        found = _in_path(node, path)
        if found:
            best = found
    return best


def _in_path(node: dict, path: str) -> tuple | None:
    best, start = None, 0
    while node is not None:
        for rest, entry in node.get("", {}).items():
            if path.startswith(rest, start) and (best is None or entry[3] > best[3]):
                best = entry
        end = path.find("/", start)
        if end < 0:
            break
        node, start = node.get(("path", path[start:end])), end + 1
    return best


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the path, A-Z in lower case; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _walker(shared):
    @F.pandas_udf(ANSWER)
    def walk(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in parts:
            found = [longest(trie, h, p) for h, p in zip(hosts, paths, strict=True)]
            rows = [(x[2], x[3], int(x[0] == "block"), x[1], x[0]) if x else (None,) * 5 for x in found]
            yield pd.DataFrame(rows, columns=ANSWER.names).astype({n: "Int32" for n in ANSWER.names[:3]})

    return walk


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = DEFAULT_VERDICT, key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule and verdict of every row's url, by the longest rule that fits.

    A rule fits its host and all hosts below it if the path starts with the rule's. More host
    labels win, then the longer path. Null urls and urls without ``://`` have an empty host and
    path and fall to ``default``, with a null rule, like all that no rule fits. Repeated rows
    stay, an empty table or rule list is fine, other columns are not read.

    Up to ``TRIE_RULES`` rules go into a broadcast trie; a longer list is cut into several, and
    the longest of their answers counts, so no broadcast outgrows its bound.
    """
    answers = [
        _walker(pages.sparkSession.sparkContext.broadcast(build_trie(rules[i : i + TRIE_RULES])))("host", "path")
        for i in range(0, len(rules), TRIE_RULES)
    ]
    asked = pages.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    for i, answer in enumerate(answers):
        asked = asked.withColumn(f"__{i}", answer)
    found = [F.when(F.col(f"__{i}.rule").isNotNull(), F.col(f"__{i}")) for i in range(len(answers))]
    nothing = F.lit(None).cast(ANSWER)
    best = F.greatest(nothing, nothing, *found)
    return asked.withColumn("__best", best).select(
        key, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict")
    )
