"""Text functions: tokens, query terms, paths, versions.

Python string semantics are the contract (Unicode blanks split words, letters and digits of
every script count as word characters), so the character classes are spelled out instead of
relying on Java's ASCII ``\\s`` and ``\\w``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"
EDGE_BLANK = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"

# Punctuation stripped from the ends of a query word.
GRAPH_STRIP = r".,:;()\[\]{}"
CONTEXT_STRIP = r".,:;()\[\]{}<>\"'`_\-+"

# Word shapes of the three query parsers.
HYBRID_TERM = r"[A-Za-z_][\p{L}\p{N}_.-]*"
FEATURE_TOKEN = r"[A-Za-z_][A-Za-z0-9_.$:/-]*"
SLICE_TERM = r"[A-Za-z_][A-Za-z0-9_]{2,}"

# Directories skipped when naming a zone, and suffixes of importable files.
ZONE_IGNORED = ("src", "lib", "app", "source")
DEPENDENCY_SUFFIXES = ("py", "js", "ts", "go", "rs")

# Directories that never belong to a corpus. A tool's own state folder is
# passed by the caller.
EXCLUDED_DIRECTORIES = (
    ".git",
    ".venv",
    "venv",
    "node_modules",
    "dist",
    "build",
    "__pycache__",
)


def strip(value: Column) -> Column:
    return F.regexp_replace(value, EDGE_BLANK, "")


def rstrip(value: Column) -> Column:
    return F.regexp_replace(value, BLANK.removesuffix("+") + r"+\z", "")


def words(value: Column) -> Column:
    """Blank-separated words, as ``str.split()`` gives them."""
    return F.filter(F.split(value, BLANK), lambda w: w != "")


def collapse(value: Column) -> Column:
    """Words joined by one space: the form used for exact duplicate checks."""
    return F.array_join(words(value), " ")


def token_count(value: Column) -> Column:
    """Four characters per token, rounded up; empty text costs nothing."""
    return F.ceil(F.length(value) / F.lit(4)).cast("int")


def truncate_tokens(value: Column, limit: Column | int) -> Column:
    size = (F.lit(limit) if isinstance(limit, int) else limit) * 4
    return F.when(size < 4, F.lit("")).otherwise(rstrip(value.substr(F.lit(1), size.cast("int"))))


def _strip_ends(value: Column, chars: str) -> Column:
    return F.regexp_replace(value, f"^[{chars}]+|[{chars}]+$", "")


def graph_terms(query: Column) -> Column:
    """Distinct lower-case words longer than two characters, punctuation trimmed after the test."""
    kept = F.filter(words(query), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(kept, lambda w: _strip_ends(F.lower(w), GRAPH_STRIP)))


def context_terms(text: Column) -> Column:
    kept = F.filter(words(text), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(kept, lambda w: F.lower(_strip_ends(w, CONTEXT_STRIP))))


def hybrid_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(HYBRID_TERM), F.lit(0)))


def memory_terms(query: Column) -> Column:
    return F.transform(words(query), F.lower)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, empty when the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def is_excluded(path: Column, extra: tuple[str, ...] = ()) -> Column:
    names = (*EXCLUDED_DIRECTORIES, *extra)
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in names]))


def zone(path: Column) -> Column:
    """First directory that is not a generic source root, else ``root``."""
    parts = path_parts(path)
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.transform(folders, lambda p: F.replace(F.lower(p), F.lit("-"), F.lit("_")))
    return F.coalesce(F.get(F.filter(named, lambda p: ~p.isin(*ZONE_IGNORED)), F.lit(0)), F.lit("root"))


def normalize_dependency(name: Column) -> Column:
    """Module or path spelling reduced to slash-separated segments."""
    slashed = F.regexp_replace(F.replace(strip(name), F.lit("\\"), F.lit("/")), r"^[./]+", "")
    bare = F.regexp_replace(slashed, rf"\.({'|'.join(DEPENDENCY_SUFFIXES)})$", "")
    return F.regexp_replace(F.replace(bare, F.lit("."), F.lit("/")), r"^/+|/+$", "")


def path_aliases(path: Column) -> Column:
    """Spellings under which a file may be imported."""
    bare = F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")
    return F.array_distinct(
        F.array(
            normalize_dependency(bare),
            bare,
            F.replace(bare, F.lit("/"), F.lit(".")),
            base_name(bare),
        )
    )


def normalize_version(version: Column) -> Column:
    """Drop pin operators and a leading v; prerelease and build parts stay."""
    return F.regexp_replace(strip(version), r"^(==|=|v|V)+", "")


def pin_library(library: Column, version: Column) -> Column:
    base = F.regexp_replace(library, r"/+$", "")
    tail = F.element_at(F.split(base, "/"), -1)
    pinned = F.contains(tail, F.lit("@")) | (normalize_version(tail) == normalize_version(version))
    return (
        F.when(version.isNull() | (version == ""), library)
        .when(pinned, base)
        .otherwise(F.concat(base, F.lit("/"), version))
    )


def is_test(path: Column, name: Column) -> Column:
    low_path = F.lower(F.coalesce(path, F.lit("")))
    low_name = F.lower(name)
    return (
        F.contains(F.concat(F.lit("/"), low_path), F.lit("/test"))
        | F.contains(low_path, F.lit("tests/"))
        | F.startswith(low_name, F.lit("test_"))
        | F.endswith(low_name, F.lit("test"))
        | F.endswith(low_name, F.lit("tests"))
    )


def index_path_error(path: Column) -> Column:
    """Reason an indexed document path is refused; null when it is acceptable."""
    flat = strip(F.replace(path, F.lit("\\"), F.lit("/")))
    segments = F.split(flat, "/", -1)
    return (
        F.when(flat == "", F.lit("missing"))
        .when(F.contains(flat, F.lit("\u0000")), F.lit("nul byte"))
        .when(flat.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.lit("uri"))
        .when(strip(path).rlike(r"^[A-Za-z]:[\\/]"), F.lit("absolute drive"))
        .when(F.startswith(flat, F.lit("/")), F.lit("absolute"))
        .when(F.exists(segments, lambda s: s == ""), F.lit("empty component"))
        .when(F.exists(segments, lambda s: s.isin(".", "..")), F.lit("not canonical"))
    )


def index_path(path: Column) -> Column:
    return strip(F.replace(path, F.lit("\\"), F.lit("/")))


def scoped_symbol(path: Column, symbol: Column) -> Column:
    """Local symbols are keyed by their document; global ones by themselves."""
    return F.when(
        F.startswith(symbol, F.lit("local ")), F.concat(path, F.lit("\u0000"), symbol)
    ).otherwise(symbol)


def occurrences_of(haystack: Column, needle: Column) -> Column:
    """Non-overlapping count of a non-empty substring."""
    removed = F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))
    return (removed / F.length(needle)).cast("long")
