"""Dependency manifests and lock files of many repositories, one pass over their rows.

Each manifest row is turned into an array of records by one ``CASE`` over its format, then
exploded once. JSON formats are read with ``from_json`` and line formats with regular
expressions; only TOML and XML need a small Arrow UDF that restates the text as JSON.
"""

from __future__ import annotations

import json
import tomllib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import base_name, strip
from loomgraph.session import durable

# Folders never searched for manifests. A tool's own state folder is passed in.
SKIPPED_DIRECTORIES = (
    ".git",
    "node_modules",
    "vendor",
    "target",
    "dist",
    "build",
    ".venv",
    "venv",
    "__pycache__",
    ".tox",
    ".mypy_cache",
    ".pytest_cache",
)

# Ecosystem and format by file name.
MANIFESTS = {
    "pyproject.toml": ("python", "pyproject"),
    "poetry.lock": ("python", "package_lock_toml"),
    "uv.lock": ("python", "package_lock_toml"),
    "Pipfile": ("python", "pipfile"),
    "Pipfile.lock": ("python", "pipfile_lock"),
    "requirements.txt": ("python", "requirements"),
    "package.json": ("node", "package_json"),
    "package-lock.json": ("node", "npm_lock"),
    "pnpm-lock.yaml": ("node", "pnpm_lock"),
    "yarn.lock": ("node", "yarn_lock"),
    "Cargo.toml": ("rust", "cargo_toml"),
    "Cargo.lock": ("rust", "package_lock_toml"),
    "go.mod": ("go", "go_mod"),
    "go.sum": ("go", "go_sum"),
    "pom.xml": ("jvm", "pom"),
    "build.gradle": ("jvm", "gradle"),
    "build.gradle.kts": ("jvm", "gradle"),
    "packages.lock.json": ("dotnet", "nuget_lock"),
    "Directory.Packages.props": ("dotnet", "props"),
}
LOCK_FORMATS = (
    "package_lock_toml",
    "pipfile_lock",
    "npm_lock",
    "pnpm_lock",
    "yarn_lock",
    "go_sum",
    "nuget_lock",
)
TOML_FORMATS = ("pyproject", "package_lock_toml", "pipfile", "cargo_toml")
XML_FORMATS = ("pom", "csproj", "props")

# Manifest line shapes.
REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$"
GO_REQUIRE = r"^\s*(?:require\s+)?([^\s()]+/[^\s()]+|[^\s()]+\.[^\s()]+)\s+(v[^\s/]+)"
GRADLE = r"""["']([A-Za-z0-9._-]+:[A-Za-z0-9._-]+):([A-Za-z0-9._+-]+)["']"""

RECORD = "struct<name:string,declared:string,resolved:string,scope:string>"


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (str, bool, int, float)) else str(value)


def _toml(text: str) -> str:
    return json.dumps(_plain(tomllib.loads(text)))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml(text: str) -> str:
    if "<!DOCTYPE" in text.upper() or "<!ENTITY" in text.upper():
        raise ValueError("document type declarations are refused")
    items, properties = [], {}
    for element in ElementTree.fromstring(text).iter():
        children = {_local(c.tag): (c.text or "").strip() for c in element}
        if _local(element.tag) == "properties":
            properties.update({k: v for k, v in children.items() if v})
        items.append({"tag": _local(element.tag), "attributes": dict(element.attrib), "children": children})
    wanted = ("dependency", "PackageReference", "PackageVersion")
    return json.dumps({"items": [i for i in items if i["tag"] in wanted], "properties": properties})


@F.pandas_udf(T.StructType().add("json", "string").add("error", "string"))
def restate(content: pd.Series, form: pd.Series) -> pd.DataFrame:
    """TOML and XML manifests as JSON text, or the reason they are malformed."""
    rows = []
    for text, name in zip(content, form, strict=True):
        try:
            if text is None or name not in TOML_FORMATS + XML_FORMATS:
                rows.append((None, None))
            else:
                rows.append((_toml(text) if name in TOML_FORMATS else _xml(text), None))
        except (ValueError, ElementTree.ParseError) as error:
            rows.append((None, f"malformed manifest: {error}"))
    return pd.DataFrame(rows, columns=["json", "error"])


def _record(name: Column, declared: Column | None = None, resolved: Column | None = None, scope: Column | str = "runtime") -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"),
        (none if declared is None else declared).cast("string").alias("declared"),
        (none if resolved is None else resolved).cast("string").alias("resolved"),
        (F.lit(scope) if isinstance(scope, str) else scope).alias("scope"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{RECORD}>")


def _orempty(records: Column) -> Column:
    return F.coalesce(records, _none())


def _sections(text: Column, sections: dict[str, str], make) -> Column:
    """Concatenate the entries of several ``name -> spec`` objects of a JSON document."""

    def section(path: str, scope: str) -> Column:
        entries = F.map_entries(F.from_json(F.get_json_object(text, path), "map<string,string>"))
        return _orempty(F.transform(entries, lambda e: make(e["key"], e["value"], scope)))

    return F.concat(*[section(path, scope) for path, scope in sections.items()])


def _spec_version(spec: Column) -> Column:
    """A version written directly or as the ``version`` text of a table."""
    return F.when(F.startswith(spec, F.lit("{")), F.get_json_object(spec, "$.version")).otherwise(
        F.when(F.startswith(spec, F.lit("[")), None).otherwise(spec)
    )


def _requirement(text: Column, scope: Column | str) -> Column:
    rest = strip(F.split_part(F.regexp_extract(text, REQUIREMENT, 2), F.lit(";"), F.lit(1)))
    return _record(F.regexp_extract(text, REQUIREMENT, 1), F.nullif(rest, F.lit("")), None, scope)


def _pairs(text: Column, pattern: str, make) -> Column:
    first = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(first, second, make)


def _first_of_name(listed: DataFrame, columns: list[str]) -> DataFrame:
    """Manifests with the first record of each name only, for formats that list a name once."""
    each = listed.select(*columns, F.posexplode_outer("_all").alias("_pos", "_r"))
    first = each.groupBy(*columns, F.col("_r.name").alias("_name")).agg(F.min_by(F.struct("_pos", "_r"), "_pos").alias("_f"))
    kept = F.array_sort(F.collect_list(F.when(F.col("_f._pos").isNotNull(), F.col("_f"))))
    return first.groupBy(*columns).agg(F.transform(kept, lambda x: x["_r"]).alias("records"))


PACKAGES = "map<string,struct<version:string>>"
XML_DOC = (
    "struct<items:array<struct<tag:string,attributes:map<string,string>,children:map<string,string>>>,"
    "properties:map<string,string>>"
)


def _format_records(
    form: Column, text: Column, doc: Column, path: Column, lines: Column, packages: Column, xml: Column
) -> Column:
    def declared(name, spec, scope):
        return _record(name, _spec_version(spec), None, scope)

    def pinned(name, spec, scope):
        return _record(name, None, F.regexp_replace(_spec_version(spec), "^=+", ""), scope)

    dev_file = F.contains(F.lower(path), F.lit("dev")) | F.contains(F.lower(path), F.lit("test"))
    bare = F.transform(lines, lambda x: strip(F.split_part(x, F.lit("#"), F.lit(1))))
    usable = F.filter(bare, lambda x: (x != "") & ~x.rlike(r"^(-r|--|-c|-e|\.|/)") & x.rlike(REQUIREMENT))
    requirements = F.transform(
        usable, lambda x: _requirement(x, F.when(dev_file, "development").otherwise("runtime"))
    )
    project = F.from_json(F.get_json_object(doc, "$.project.dependencies"), "array<string>")
    groups = F.map_entries(
        F.from_json(F.get_json_object(doc, "$.project.optional-dependencies"), "map<string,array<string>>")
    )
    grouped = F.flatten(
        F.transform(
            groups,
            lambda g: F.transform(
                F.filter(g["value"], lambda x: x.rlike(REQUIREMENT)),
                lambda x: _requirement(
                    x, F.when(g["key"].isin("dev", "test", "tests"), "development").otherwise("optional")
                ),
            ),
        )
    )
    poetry = F.filter(
        _sections(
            doc,
            {"$.tool.poetry.dependencies": "runtime", "$.tool.poetry.dev-dependencies": "development"},
            declared,
        ),
        lambda r: r["name"] != "python",
    )
    pyproject = F.concat(
        _orempty(
            F.transform(
                F.filter(project, lambda x: x.rlike(REQUIREMENT)), lambda x: _requirement(x, "runtime")
            )
        ),
        _orempty(grouped),
        poetry,
    )
    locked = F.from_json(F.get_json_object(doc, "$.package"), "array<struct<name:string,version:string>>")
    lock_toml = F.transform(
        F.filter(locked, lambda p: F.coalesce(p["name"], F.lit("")) != ""),
        lambda p: _record(p["name"], None, F.nullif(p["version"], F.lit(""))),
    )
    pipfile = F.transform(
        _sections(doc, {"$.packages": "runtime", "$.dev-packages": "development"}, declared),
        lambda r: _record(r["name"], F.nullif(r["declared"], F.lit("*")), None, r["scope"]),
    )
    modern = F.transform(
        F.filter(
            F.map_entries(packages),
            lambda e: F.startswith(e["key"], F.lit("node_modules/"))
            & (F.coalesce(e["value"]["version"], F.lit("")) != ""),
        ),
        lambda e: _record(F.regexp_extract(e["key"], r"(?:.*node_modules/)(.*)$", 1), None, e["value"]["version"]),
    )
    legacy = F.transform(
        F.filter(
            F.map_entries(
                F.from_json(F.get_json_object(text, "$.dependencies"), "map<string,struct<version:string>>")
            ),
            lambda e: F.coalesce(e["value"]["version"], F.lit("")) != "",
        ),
        lambda e: _record(e["key"], None, e["value"]["version"]),
    )
    nuget = F.flatten(
        F.transform(
            F.map_values(
                F.from_json(
                    F.get_json_object(text, "$.dependencies"), "map<string,map<string,struct<resolved:string>>>"
                )
            ),
            lambda m: F.transform(
                F.map_entries(m), lambda e: _record(e["key"], None, F.nullif(e["value"]["resolved"], F.lit("")))
            ),
        )
    )
    go_lines = F.filter(
        F.transform(lines, lambda x: F.split_part(x, F.lit("//"), F.lit(1))),
        lambda x: ~F.trim(x).rlike("^(module |go |toolchain )") & x.rlike(GO_REQUIRE),
    )
    go_mod = F.transform(
        go_lines, lambda x: _record(F.regexp_extract(x, GO_REQUIRE, 1), F.regexp_extract(x, GO_REQUIRE, 2))
    )
    sums = F.filter(
        F.transform(lines, lambda x: F.split(F.trim(x), r"\s+")),
        lambda p: (F.size(p) >= 2) & ~F.endswith(F.get(p, F.lit(1)), F.lit("/go.mod")),
    )
    go_sum = F.transform(sums, lambda p: _record(p[0], None, p[1]))
    gradle = _pairs(text, GRADLE, lambda n, v: _record(n, v))
    yarn = _pairs(
        text,
        r"(?m)^\"?((?:@[^/\s\"]+/)?[^@\s\"#]+)@[^\n]*:[ \t]*\r?\n(?:[ \t]+(?!\"?version)[^\n]*\r?\n)*?[ \t]+\"?version\"?:?\s+\"?([^\"\s]+)",
        lambda n, v: _record(n, None, v),
    )
    pnpm = _pairs(
        text,
        r"(?m)^\s{2,}'?([^'\s:]+)'?:[ \t]*\r?\n(?:(?!\s{2,}'?[^'\s:]+'?:[ \t]*\r?$)(?!\s+version:)[^\n]*\r?\n)*?[ \t]+version:\s*['\"]?([^'\"\s(]+)",
        lambda n, v: _record(n, None, v),
    )
    def attribute(item, key):
        return F.try_element_at(item["attributes"], F.lit(key))

    def child(item, key):
        return F.coalesce(F.try_element_at(item["children"], F.lit(key)), F.lit(""))

    def pom_record(item):
        version = F.nullif(child(item, "version"), F.lit(""))
        variable = F.regexp_extract(version, r"^\$\{(.*)\}$", 1)
        known = F.try_element_at(xml["properties"], variable)
        group = child(item, "groupId")
        return _record(
            F.when(group != "", F.concat(group, F.lit(":"), child(item, "artifactId"))).otherwise(
                child(item, "artifactId")
            ),
            F.when(variable != "", F.coalesce(known, version)).otherwise(version),
            None,
            F.when(child(item, "scope") == "test", "development").otherwise("runtime"),
        )

    pom = F.transform(
        F.filter(xml["items"], lambda i: (i["tag"] == "dependency") & (child(i, "artifactId") != "")),
        pom_record,
    )

    def reference(tag, name):
        found = F.filter(xml["items"], lambda i: (i["tag"] == tag) & name(i).isNotNull())
        return F.transform(found, lambda i: _record(name(i), attribute(i, "Version")))

    csproj = reference(
        "PackageReference", lambda i: F.nullif(F.coalesce(attribute(i, "Include"), attribute(i, "Update")), F.lit(""))
    )
    props = reference("PackageVersion", lambda i: F.nullif(attribute(i, "Include"), F.lit("")))
    npm = {
        "$.dependencies": "runtime",
        "$.devDependencies": "development",
        "$.peerDependencies": "optional",
        "$.optionalDependencies": "optional",
    }
    cargo = {
        "$.dependencies": "runtime",
        "$.dev-dependencies": "development",
        "$.build-dependencies": "build",
    }
    table = {
        "pyproject": pyproject,
        "package_lock_toml": lock_toml,
        "pipfile": pipfile,
        "pipfile_lock": _sections(text, {"$.default": "runtime", "$.develop": "development"}, pinned),
        "requirements": requirements,
        "package_json": _sections(
            text, npm, lambda n, spec, s: _record(n, F.nullif(spec, F.lit("")), None, s)
        ),
        "npm_lock": F.when(packages.isNotNull(), modern).otherwise(legacy),
        "pnpm_lock": pnpm,
        "yarn_lock": yarn,
        "cargo_toml": _sections(doc, cargo, declared),
        "go_mod": go_mod,
        "go_sum": go_sum,
        "pom": pom,
        "gradle": gradle,
        "csproj": csproj,
        "props": props,
        "nuget_lock": nuget,
    }
    value = _none()
    for name, records in table.items():
        value = F.when(form == name, _orempty(records)).otherwise(value)
    return value


def manifest_files(files: DataFrame, extra_skipped: tuple[str, ...] = ()) -> DataFrame:
    """Rows that are manifests, with their ecosystem and format. Filters before any parsing."""
    name = base_name(F.col("path"))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    skipped = F.array(*[F.lit(d) for d in (*SKIPPED_DIRECTORIES, *extra_skipped)])
    in_requirements = F.endswith(name, F.lit(".txt")) & (
        F.coalesce(F.try_element_at(folders, F.lit(-1)), F.lit("")) == "requirements"
    )
    known = F.lit(None).cast("struct<ecosystem:string,form:string>")
    for label, (ecosystem, form) in MANIFESTS.items():
        known = F.when(
            name == label, F.struct(F.lit(ecosystem).alias("ecosystem"), F.lit(form).alias("form"))
        ).otherwise(known)
    kind = (
        F.when(known.isNotNull(), known)
        .when(
            F.endswith(name, F.lit(".csproj")),
            F.struct(F.lit("dotnet").alias("ecosystem"), F.lit("csproj").alias("form")),
        )
        .when(
            in_requirements, F.struct(F.lit("python").alias("ecosystem"), F.lit("requirements").alias("form"))
        )
    )
    return (
        files.filter(~F.arrays_overlap(folders, skipped))
        .withColumn("_kind", kind)
        .filter("_kind is not null")
        .select("repo", "path", "content", "_kind.ecosystem", "_kind.form")
    )


def parse_manifests(files: DataFrame, extra_skipped: tuple[str, ...] = ()) -> DataFrame:
    """One row per manifest: records array plus the error that stopped it, if any."""
    # Manifests are a sliver of a corpus: kept once, so the corpus is scanned a single time.
    rows = durable(manifest_files(files, extra_skipped))
    rows = rows.withColumn("_text", F.col("content"))
    needs_help = F.col("form").isin(*TOML_FORMATS, *XML_FORMATS)
    # The Arrow UDF sees TOML and XML only: other rows pass null through it.
    rows = durable(rows.withColumn("_doc", restate(F.when(needs_help, F.col("_text")), "form")))
    json_form = F.col("form").isin("package_json", "npm_lock", "pipfile_lock", "nuget_lock")
    bad_json = json_form & F.try_parse_json("_text").isNull()
    error = (
        F.when(F.col("_text").isNull(), "unreadable manifest")
        .when(F.col("_doc.error").isNotNull(), F.col("_doc.error"))
        .when(bad_json, "malformed manifest: not JSON")
    )
    # Inputs used by several formats are staged once instead of being repeated in the CASE.
    staged = rows.withColumns(
        {
            "error": error,
            "_json": F.when(F.col("form").isin(*TOML_FORMATS), F.col("_doc.json")),
            "_lines": F.when(F.col("form").isin("requirements", "go_mod", "go_sum"), F.split("_text", r"\r?\n")),
            "_packages": F.when(F.col("form") == "npm_lock", F.from_json(F.get_json_object("_text", "$.packages"), PACKAGES)),
            "_xml": F.when(F.col("form").isin(*XML_FORMATS), F.from_json("_doc.json", XML_DOC)),
        }
    )
    records = _format_records(
        F.col("form"), F.col("_text"), F.col("_json"), F.col("path"), F.col("_lines"), F.col("_packages"), F.col("_xml")
    )
    listed = staged.filter("error is null").withColumn("_all", records)
    columns = ["repo", "path", "ecosystem", "form"]
    single = F.col("form").isin("go_sum", "gradle")
    good = listed.filter(~single).select(*columns, F.col("_all").alias("records")).unionByName(
        _first_of_name(listed.filter(single), columns)
    )
    good = good.withColumn("error", F.lit(None).cast("string"))
    bad = staged.filter("error is not null").select(*columns, _none().alias("records"), "error")
    return good.unionByName(bad)


def dependency_records(manifests: DataFrame) -> DataFrame:
    """Exploded records in scan order (path, then position)."""
    lock = F.col("form").isin(*LOCK_FORMATS)
    return manifests.select(
        "repo", "path", "ecosystem", "form", F.posexplode("records").alias("_pos", "r")
    ).select(
        "repo",
        "ecosystem",
        "r.name",
        "r.declared",
        "r.resolved",
        F.col("path").alias("manifest"),
        F.when(lock, F.col("path")).alias("lock_source"),
        "r.scope",
        F.struct("path", "_pos").alias("ordinal"),
    )


def manifest_reports(manifests: DataFrame) -> DataFrame:
    return manifests.select(
        "repo",
        "path",
        "ecosystem",
        F.col("error").isNull().alias("parsed"),
        F.coalesce("error", F.lit("")).alias("detail"),
        F.size("records").alias("dependencies"),
    )
