"""SQL fragments shared by the oracle statements."""

from __future__ import annotations

SQL_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_words(col: str) -> str:
    return f"list_filter(string_split_regex({col}, '{SQL_BLANK}'), lambda w: w <> '')"


def sql_strip(col: str, chars: str) -> str:
    chars = chars.replace("'", "''")
    return f"regexp_replace({col}, '^[{chars}]+|[{chars}]+$', '', 'g')"


def sql_graph_terms(col: str) -> str:
    kept = f"list_filter({sql_words(col)}, lambda w: length(w) > 2)"
    inner = sql_strip("lower(w)", r".,:;()\[\]{}")
    return f"list_distinct(list_transform({kept}, lambda w: {inner}))"


def sql_context_terms(col: str) -> str:
    kept = f"list_filter({sql_words(col)}, lambda w: length(w) > 2)"
    inner = sql_strip("w", r".,:;()\[\]{}<>\"'`_\-+")
    return f"list_distinct(list_transform({kept}, lambda w: lower({inner})))"


def sql_hybrid_terms(col: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({col}), '[A-Za-z_][\\p{{L}}\\p{{N}}_.-]*'))"


def sql_any(text: str, terms) -> str:
    return "(" + " or ".join(f"contains({text}, {quote(t)})" for t in terms) + ")"


def sql_case(table: dict, key: str, default) -> str:
    def lit(v):
        return quote(v) if isinstance(v, str) else str(v)

    arms = " ".join(f"when {key} = {quote(k)} then {lit(v)}" for k, v in table.items())
    return f"(case {arms} else {lit(default)} end)"
