"""Extraction, slicing, structural and precise queries.

The driver tables hold no source code, so files are written from their rows: one Python
module per part and one file in five other languages per customer. The SQL twins state what
must be found straight from the columns, without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import build, extract, knowledge, listing, precise, slicing, structural
from loomgraph.plans.registry import query
from loomgraph.plans.sqltext import SQL_BLANK, sql_any
from loomgraph.session import durable, scratch


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def python_files(t) -> DataFrame:
    """Twenty repositories of modules; every 17th module does not parse."""
    key = F.col("p_partkey")
    word = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    body = text(
        "import os\nfrom pkg.m", key % 50, " import helper\n\n\nclass C", F.col("p_size"), "(Base", key % 7, "):\n",
        "    def run(self, x: int) -> str:\n        return helper(x) + ", word, "(x)\n\n\n",
        "async def ", word, "(a, *b, c=1, **d):\n    log('", key, "', a)\n    return os.path.join(a)\n",
    )
    broken = F.when(key % 17 == 0, text("def broken(:\n", body)).otherwise(body)
    return t.spread("part").select(
        F.concat(F.lit("r"), (key % 20).cast("string")).alias("repo"),
        text("pkg/m", key, ".py").alias("path"),
        broken.alias("content"),
        F.octet_length(broken).cast("long").alias("size"),
    )


PY_SQL = "p as (select 'r' || (p_partkey % 20) as repo, 'pkg/m' || p_partkey || '.py' as path, p_partkey as k, p_size as size, replace(p_name, ' ', '_') as w from part where p_partkey % 17 <> 0)"
PY_UNITS_SQL = """
  select repo, path, 'C' || size as name, 'class' as kind, 5 as line, 7 as end_line, '' as signature, '' as return_type, 'Base' || (k % 7) as bases, '' as refs, '' as container, 'python' as language from p
  union all select repo, path, 'run', 'method', 6, 7, '(self, x)', 'str', '', 'str,int,helper,x,' || w || ',x', 'C' || size, 'python' from p
  union all select repo, path, w, 'async_function', 10, 12, '(a, *c, *b, **d)', '', '', 'log,a,a,os', '', 'python' from p
"""


def other_files(t) -> DataFrame:
    key = F.col("c_custkey")
    seg = F.lower("c_mktsegment")
    kind = key % 5
    content = (
        F.when(
            kind == 0,
            text(
                "import { a } from './lib", key % 9, "'\n\nexport class P", key, " extends Base", key % 3, " {\n  async go(x: number): void {\n    ", seg, "(x);\n  }\n}\n",
                "export const ", seg, " = async (y) => helper", key % 4, "(y);\n",
            ),
        )
        .when(kind == 1, text("package main\nimport \"fmt", key % 4, "\"\n\nfunc Run", key, "(a int) string {\n\tif (a) { ", seg, "(a) }\n}\n"))
        .when(
            kind == 2,
            text("import java.util.", seg, ";\n\npublic final class J", key, " implements Runnable, Closer {\n  public static int run", key % 6, "(int a) {\n    return call", key % 8, "(a);\n  }\n}\n"),
        )
        .when(kind == 3, text("require 'json", key % 3, "'\n\nclass R", key, "\n  def go!(x)\n    puts(x)\n  end\nend\n"))
        .otherwise(text("use std::", seg, ";\n\npub struct S", key, " {\n}\npub fn f", key % 7, "(x: u8) -> u8 {\n    g", key % 5, "(x)\n}\n"))
    )
    ending = F.when(kind == 0, "ts").when(kind == 1, "go").when(kind == 2, "java").when(kind == 3, "rb").otherwise("rs")
    return t.spread("customer").select(
        F.concat(F.lit("q"), (key % 10).cast("string")).alias("repo"),
        F.concat(F.lit("src/f"), key.cast("string"), F.lit("."), ending).alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("long").alias("size"),
    )


OTHER_SQL = "c as (select 'q' || (c_custkey % 10) as repo, 'src/f' || c_custkey || '.' || ['ts','go','java','rb','rs'][c_custkey % 5 + 1] as path, c_custkey as k, c_custkey % 5 as t, lower(c_mktsegment) as s from customer)"


def code_files(t) -> DataFrame:
    return python_files(t).unionByName(other_files(t))


@query(
    "python_units",
    f"with {PY_SQL} select repo, path, name, kind, line, end_line, signature, return_type, bases, refs, container, language from ({PY_UNITS_SQL})",
)
def python_units(t) -> DataFrame:
    found = extract.units(python_files(t))
    return found.select(
        "repo", "path", "name", "kind", "line", "end_line",
        F.coalesce("signature", F.lit("")).alias("signature"),
        F.coalesce("return_type", F.lit("")).alias("return_type"),
        F.array_join("bases", ",").alias("bases"),
        F.array_join("references", ",").alias("refs"),
        F.coalesce("container", F.lit("")).alias("container"),
        "language",
    )


@query(
    "line_units",
    f"""
    with {OTHER_SQL}
    select repo, path, 'P' || k as name, 'class' as kind, 3 as line, '' as signature, '' as return_type, 'Base' || (k % 3) as bases, 'typescript' as language from c where t = 0
    union all select repo, path, s, 'function', 8, '(y)', '', '', 'typescript' from c where t = 0
    union all select repo, path, 'Run' || k, 'function', 4, '(a int)', '', '', 'go' from c where t = 1
    union all select repo, path, 'if', 'function', 5, '(a)', '', '', 'go' from c where t = 1
    union all select repo, path, 'J' || k, 'class', 3, '', '', 'Runnable,Closer', 'java' from c where t = 2
    union all select repo, path, 'run' || (k % 6), 'function', 4, '(int a)', 'int', '', 'java' from c where t = 2
    union all select repo, path, 'R' || k, 'class', 3, '', '', '', 'ruby' from c where t = 3
    union all select repo, path, 'go!', 'function', 4, '(x)', '', '', 'ruby' from c where t = 3
    union all select repo, path, 'S' || k, 'class', 3, '', '', '', 'rust' from c where t = 4
    union all select repo, path, 'f' || (k % 7), 'function', 5, '(x: u8)', 'u8', '', 'rust' from c where t = 4
    """,
)
def line_units(t) -> DataFrame:
    found = extract.line_units(other_files(t))
    return found.select(
        "repo", "path", "name", "kind", "line",
        F.coalesce("signature", F.lit("")).alias("signature"),
        F.trim(F.coalesce("return_type", F.lit(""))).alias("return_type"),
        F.array_join("bases", ",").alias("bases"),
        "language",
    )


@query(
    "code_relations",
    f"""
    with {PY_SQL}, {OTHER_SQL}
    select repo, path, 'imports' as kind, 'os' as target, 1 as line, '' as source_symbol from p
    union all select repo, path, 'imports', 'pkg.m' || (k % 50), 2, '' from p
    union all select repo, path, 'inherits', 'Base' || (k % 7), 5, 'C' || size from p
    union all select repo, path, 'calls', 'helper', 7, 'run' from p
    union all select repo, path, 'calls', w, 7, 'run' from p
    union all select repo, path, 'calls', 'log', 11, w from p
    union all select repo, path, 'calls', 'join', 12, w from p
    union all select repo, path, 'imports', './lib' || (k % 9), 1, '' from c where t = 0
    union all select repo, path, 'inherits', 'Base' || (k % 3), 3, 'P' || k from c where t = 0
    union all select repo, path, 'calls', 'go', 4, '' from c where t = 0
    union all select repo, path, 'calls', s, 5, '' from c where t = 0
    union all select repo, path, 'calls', 'async', 8, '' from c where t = 0
    union all select repo, path, 'calls', 'helper' || (k % 4), 8, '' from c where t = 0
    union all select repo, path, 'imports', 'fmt' || (k % 4), 2, '' from c where t = 1
    union all select repo, path, 'calls', 'Run' || k, 4, '' from c where t = 1
    union all select repo, path, 'calls', s, 5, '' from c where t = 1
    union all select repo, path, 'imports', 'java.util.' || s, 1, '' from c where t = 2
    union all select repo, path, 'implements', unnest(['Runnable', 'Closer']), 3, 'J' || k from c where t = 2
    union all select repo, path, 'calls', 'run' || (k % 6), 4, '' from c where t = 2
    union all select repo, path, 'calls', 'call' || (k % 8), 5, '' from c where t = 2
    union all select repo, path, 'imports', 'json' || (k % 3), 1, '' from c where t = 3
    union all select repo, path, 'calls', 'puts', 5, '' from c where t = 3
    union all select repo, path, 'imports', 'std::' || s, 1, '' from c where t = 4
    union all select repo, path, 'calls', 'f' || (k % 7), 5, '' from c where t = 4
    union all select repo, path, 'calls', 'g' || (k % 5), 6, '' from c where t = 4
    """,
)
def code_relations(t) -> DataFrame:
    return extract.relations(code_files(t)).withColumn("source_symbol", F.coalesce("source_symbol", F.lit("")))


@query(
    "symbol_records",
    f"""
    with {PY_SQL}, {OTHER_SQL}
    select repo, path, 'C' || size as name, 'class' as kind, 5 as line, '' as container from p
    union all select repo, path, 'run', 'method', 6, 'C' || size from p
    union all select repo, path, w, 'async_function', 10, '' from p
    union all select repo, path, 'os', 'import', 1, '' from p
    union all select repo, path, 'pkg.m' || (k % 50), 'import', 2, '' from p
    union all select repo, path, 'P' || k, 'class', 2, '' from c where t = 0
    union all select repo, path, s, 'function', 8, '' from c where t = 0
    union all select repo, path, './lib' || (k % 9), 'import', 1, '' from c where t = 0
    union all select repo, path, 'Run' || k, 'function', 3, '' from c where t = 1
    union all select repo, path, 'fmt' || (k % 4), 'import', 2, '' from c where t = 1
    union all select repo, path, 'J' || k, 'class', 2, '' from c where t = 2
    union all select repo, path, 'java.util.' || s, 'import', 1, '' from c where t = 2
    union all select repo, path, 'run' || (k % 6), 'method', 4, '' from c where t = 2
    union all select repo, path, 'call' || (k % 8), 'method', 5, '' from c where t = 2
    union all select repo, path, 'R' || k, 'class', 2, '' from c where t = 3
    union all select repo, path, 'go!', 'method', 4, '' from c where t = 3
    union all select repo, path, 'json' || (k % 3), 'import', 1, '' from c where t = 3
    union all select repo, path, 'S' || k, 'struct', 2, '' from c where t = 4
    union all select repo, path, 'f' || (k % 7), 'function', 5, '' from c where t = 4
    union all select repo, path, 'std::' || s, 'import', 1, '' from c where t = 4
    """,
)
def symbol_records(t) -> DataFrame:
    return extract.symbol_records(code_files(t)).withColumn("container", F.coalesce("container", F.lit("")))


@query(
    "type_resolution",
    """
    with c as (select c_custkey as k, 'C' || (c_custkey % 40) as name, 'File' || (c_custkey % 12) as f, 'List<C' || (c_custkey % 60) || '>, C' || (c_custkey % 25) as base from customer),
    n as (select distinct f, name from c), a as (select distinct f, name, unnest([regexp_extract(base, 'C(\\d+)>', 0), regexp_extract(base, 'C\\d+$', 0)]) as tt from c)
    select distinct a.f as path, a.name, n.name as type_name from a join n on n.f = a.f and n.name = replace(a.tt, '>', '')
    """,
)
def type_resolution(t) -> DataFrame:
    key = F.col("c_custkey")
    units = t.customer.select(
        F.lit("main").alias("repo"),
        text("File", key % 12).alias("path"),
        text("C", key % 40).alias("name"),
        F.array(text("List<C", key % 60, ">, C", key % 25)).alias("bases"),
        F.create_map().cast("map<string,string>").alias("annotations"),
        F.lit(None).cast("string").alias("return_type"),
    )
    return extract.resolve_types(units).drop("repo")


@query(
    "syntax_validation",
    """
    with p as (select 'r' || (p_partkey % 20) as repo, p_partkey % 17 = 0 as bad from part)
    select repo, count(*) as checked, count(*) filter (bad) as issues from p group by 1
    """,
)
def syntax_validation(t) -> DataFrame:
    files = python_files(t)
    issues = extract.syntax_issues(extract.python_rows(files))
    return extract.validation_report(files, issues).select("repo", "checked", "issues")


@query(
    "document_slice",
    f"""
    with d as (select doc_id, string_split(text, chr(10)) as ls, doc_id % 60 + 1 as line from documents),
    x as (select doc_id, line, case when ls[-1] = '' then ls[1:len(ls) - 1] else ls end as ls from d),
    s as (select doc_id, array_to_string(ls[greatest(0, line - 12) + 1:least(len(ls), line + 24)], chr(10)) as body from x)
    select doc_id, md5(regexp_replace(body[1:400], '{SQL_BLANK}$', '')) as digest from s
    """,
)
def document_slice(t) -> DataFrame:
    """Documents have no declarations: a window of lines around the asked line, 100 tokens."""
    files = t.documents.select(F.lit("main").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    requests = t.documents.select(
        F.col("doc_id").alias("request_id"), F.lit("main").alias("repo"), F.col("doc_id").cast("string").alias("path"),
        F.lit("x").alias("symbol"), (F.col("doc_id") % 60 + 1).cast("int").alias("line"),
    )
    none = extract.line_units(files)
    cut = slicing.slice_symbols(requests, files, none, 100)
    return cut.select(F.col("request_id").alias("doc_id"), F.md5("content").alias("digest"))


@query(
    "symbol_slice",
    f"""
    with {PY_SQL}
    select path, 'run' as symbol, 'class C' || size || '(Base' || (k % 7) || '):' || chr(10) || '    def run(self, x: int) -> str:' || chr(10) || '        return helper(x) + ' || w || '(x)' as content from p
    union all select path, w, 'async def ' || w || '(a, *b, c=1, **d):' || chr(10) || '    log(''' || k || ''', a)' || chr(10) || '    return os.path.join(a)' from p
    """,
)
def symbol_slice(t) -> DataFrame:
    files = python_files(t)
    # Requests and lookups read the units several times; the files are parsed once.
    units = durable(extract.units(files))
    requests = units.filter("kind <> 'class'").select(
        F.concat_ws(":", "path", "name").alias("request_id"), "repo", "path", F.col("name").alias("symbol"), (F.col("line") + 3).alias("line")
    )
    cut = slicing.slice_symbols(requests, files, units, 800)
    return cut.select("path", "symbol", F.trim(F.regexp_replace("content", r"^\n+|\n+$", "")).alias("content"))


@query(
    "query_slice",
    f"""
    with {PY_SQL}
    select path, 1 as position, 'run' as symbol, 'ast:' || path || ':run' as source from p
    union all select path, 2, w, 'ast:' || path || ':' || w from p
    """,
)
def query_slice(t) -> DataFrame:
    """``run`` by name (4) plus its reference to helper (1); the logger only by reference (1)."""
    files = python_files(t)
    queries = files.select(
        F.concat_ws("/", "repo", "path").alias("query_id"), "repo", "path", F.lit("how does run use helper or log it?").alias("query")
    )
    cut = slicing.slice_queries(queries, files, extract.units(files))
    return cut.select("path", "position", "symbol", "source")


STRUCTURAL_SQL = f"""
    with {PY_SQL}
    select repo, path, 11 as start_line, 5 as start_column, 'log(''' || k || ''', a)' as matched_text, '''' || k || '''' as x, 'a' as y, 'audit(a, ''' || k || ''')' as replacement from p
"""


@query("structural_search", STRUCTURAL_SQL)
def structural_search(t) -> DataFrame:
    found = structural.structural_search(python_files(t), "log($X, $Y)", rewrite="audit($Y, $X)")
    return found.select(
        "repo", "path", "start_line", "start_column", "matched_text", F.col("captures")["X"].alias("x"), F.col("captures")["Y"].alias("y"), "replacement"
    )


@query(
    "rewrite_plan",
    f"with {PY_SQL} select repo, path, cast(1 as bigint) as matches, cast(3 as bigint) as changed_bytes, true as rewritten from p",
)
def rewrite_plan(t) -> DataFrame:
    files = python_files(t)
    found = structural.structural_search(files, "log($X, $Y)", rewrite="audit($Y, $X)")
    plan = structural.rewrite_plan(found, files)
    changed = F.contains("diff", F.lit("+    audit(a, ")) & ~F.contains("content", F.lit("log('"))
    return plan.select("repo", "path", "matches", F.col("changed_bytes").cast("long").alias("changed_bytes"), changed.alias("rewritten"))


@query(
    "rewrite_risk",
    f"""
    with {PY_SQL}, d as (select max(round(abs(value) / 1000, 6)) as deepest from events), b as (select least(1.0, count(*) / 50.0) as breadth from p)
    select round(least(1.0, 0.6 * deepest + 0.4 * breadth), 4) as risk_score from d, b
    """,
)
def rewrite_risk(t) -> DataFrame:
    """The rewrite of every module, with event values as the impacts of its symbols."""
    files = python_files(t)
    plan = structural.rewrite_plan(structural.structural_search(files, "log($X, $Y)", rewrite="audit($Y, $X)"), files)
    return structural.rewrite_risk(plan, t.events.select(F.round(F.abs("value") / 1000, 6).alias("risk_score")))


@query(
    "project_knowledge",
    f"""
    with f as (select lang as repo, 'src/' || ['api','models','x','core'][doc_id % 4 + 1] || '/' || ['main.py','b.ts','go.mod','Cargo.toml','t.rb'][doc_id % 5 + 1] as path, lower(text) as low, octet_length(encode(text)) as size from documents),
    n as (select *, string_split(path, '/')[-1] as name from f)
    select repo, 'language' as fact, case name when 'main.py' then 'Python' when 'b.ts' then 'TypeScript' else 'Ruby' end as value, count(*) as count from n where name in ('main.py', 'b.ts', 't.rb') group by all
    union all select repo, 'package_system', case name when 'go.mod' then 'Go modules' else 'Cargo' end, count(*) from n where name in ('go.mod', 'Cargo.toml') group by all
    union all select repo, 'entry_point', path, count(*) from n where name = 'main.py' group by all
    union all select repo, 'architecture', case string_split(path, '/')[2] when 'api' then 'API layer' when 'models' then 'model layer' else 'core layer' end, count(*) from n where string_split(path, '/')[2] <> 'x' group by all
    union all select repo, 'test_framework', 'pytest', 1 from n group by repo having bool_or({sql_any('low', ('pytest',))})
    union all select repo, 'test_framework', 'jest', 1 from n group by repo having bool_or({sql_any('low', ('jest',))})
    union all select repo, 'test_framework', 'JUnit', 1 from n group by repo having bool_or({sql_any('low', ('junit', '@test'))})
    union all select repo, 'test_framework', 'RSpec', 1 from n group by repo having bool_or({sql_any('low', ('rspec', 'spec_helper'))})
    union all select repo, 'test_framework', 'vitest', 1 from n group by repo having bool_or({sql_any('low', ('vitest',))})
    """,
)
def project_knowledge(t) -> DataFrame:
    folder = F.get(F.array(*[F.lit(x) for x in ("api", "models", "x", "core")]), (F.col("doc_id") % 4).cast("int"))
    name = F.get(F.array(*[F.lit(x) for x in ("main.py", "b.ts", "go.mod", "Cargo.toml", "t.rb")]), (F.col("doc_id") % 5).cast("int"))
    files = t.documents.select(
        F.col("lang").alias("repo"),
        F.concat(F.lit("src/"), folder, F.lit("/"), name).alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").alias("size"),
    )
    return knowledge.project_knowledge(files)


@query(
    "build_graph",
    f"""
    with {PY_SQL}, {OTHER_SQL}
    select 'contains' as kind, (select count(*) * 3 from p) + (select count(*) * 2 from c) as edges union all select 'defines', (select count(*) * 3 from p) + (select count(*) * 2 from c)
    union all select 'imports', (select count(*) * 2 from p) + (select count(*) from c)
    union all select 'inherits', (select count(*) from p) + (select count(*) from c where t = 0)
    union all select 'implements', (select count(*) * 2 from c where t = 2)
    """,
)
def build_graph(t) -> DataFrame:
    """Edge counts per kind; calls are left out because parallel calls fold into one edge."""
    _, edges = build.build_graph(code_files(t))
    return edges.filter("kind <> 'calls'").groupBy("kind").agg(F.count("*").alias("edges"))


@query("incremental_graph")
def incremental_graph(t) -> DataFrame:
    """Rows in which an incremental update differs from a full build, per kind of edge.

    One module in twenty is edited, one in thirty removed, one in forty is new.
    """
    key = F.regexp_extract("path", r"m(\d+)\.py", 1).cast("int")
    files = python_files(t)
    before = files.filter(key % 40 != 7)
    after = files.filter(key % 30 != 3).withColumn(
        "content", F.when(key % 20 == 5, F.replace(F.col("content"), F.lit("def run"), F.lit("def walk"))).otherwise(F.col("content"))
    )

    def state(df):
        return df.select(
            "repo", "path", F.octet_length("content").alias("size"), F.lit(0).alias("mtime_ns"), F.md5(F.col("content").cast("binary")).alias("digest")
        )

    with scratch() as keep:
        units, relations = build.extract_files(before)
        _, old = build.assemble(before, units, relations)
        changes = listing.snapshot_diff(state(before).withColumn("mtime_ns", F.lit(1)), state(after), ["repo", "path"])
        _, fresh, _, _ = build.update_graph(after, changes, units, relations, old)
        _, full = build.build_graph(after)
        fresh, full = keep(fresh), keep(full)
    columns = ["repo", "source", "target", "kind", "resolution_confidence", "candidate_count"]
    left, right = fresh.select(*columns), full.select(*columns)
    return (
        left.exceptAll(right).withColumn("side", F.lit("incremental only"))
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("full only")))
        .unionByName(full.select(*columns).withColumn("side", F.lit("full")))
        .groupBy("side", "kind").agg(F.count("*").alias("edges"))
    )


# -- precise index -----------------------------------------------------------------------


def occurrences(t) -> DataFrame:
    start = (F.col("event_id") % 97).cast("int")
    col = (F.col("event_id") % 30).cast("int")
    tall = F.col("event_id") % 11 == 0
    return t.events.filter("event_id % 5 <> 0").select(
        F.lit("main").alias("repo"),
        F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.when(F.col("event_id") % 9 == 0, "local ").otherwise("x p k 1 "), "event_type", (F.col("event_id") % 31).cast("string"), F.lit("#")).alias("symbol"),
        start.alias("start_line"),
        col.alias("start_col"),
        F.when(tall, start + 2).otherwise(start).alias("end_line"),
        F.when(tall, F.lit(3)).otherwise(col + 1 + (F.col("event_id") % 13).cast("int")).alias("end_col"),
        F.when(F.col("event_id") % 7 == 0, 1).otherwise(8).alias("roles"),
    )


OCC_SQL = """o as (select 'd' || (user_id % 40) || '.py' as path, case when event_id % 9 = 0 then 'local ' else 'x p k 1 ' end || event_type || (event_id % 31) || '#' as symbol,
    event_id % 97 as sl, event_id % 30 as sc, event_id % 97 + case when event_id % 11 = 0 then 2 else 0 end as el,
    case when event_id % 11 = 0 then 3 else event_id % 30 + 1 + event_id % 13 end as ec, case when event_id % 7 = 0 then 1 else 8 end as roles from events where event_id % 5 <> 0)"""
CARET_SQL = "k as (select event_id as caret_id, 'd' || (user_id % 40) || '.py' as path, event_id % 89 as line, event_id % 37 as col from events where event_id % 5 = 0)"
AT_SQL = """a as (select caret_id, k.path, arg_max(symbol, (case when sl = el then -greatest(0, ec - sc) else -(el - sl) * 10000 end, -sc, symbol)) as symbol
    from k left join o on o.path = k.path and line between sl and el and not (line = sl and col < sc) and not (line = el and col >= ec) group by 1, 2)"""


def carets(t) -> DataFrame:
    return t.events.filter("event_id % 5 = 0").select(
        F.col("event_id").alias("caret_id"),
        F.lit("main").alias("repo"),
        F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string"), F.lit(".py")).alias("path"),
        (F.col("event_id") % 89).cast("int").alias("line"),
        (F.col("event_id") % 37).cast("int").alias("col"),
    )


@query("occurrence_at", f"with {OCC_SQL}, {CARET_SQL}, {AT_SQL} select caret_id, symbol from a")
def occurrence_at(t) -> DataFrame:
    return precise.occurrence_at(carets(t), occurrences(t)).select("caret_id", "symbol")


KEY_SQL = "case when starts_with(symbol, 'local ') then path || '|' || symbol else symbol end"


@query(
    "symbol_occurrences",
    f"""
    with {OCC_SQL}, w as (select distinct path, symbol from o where sc = 4)
    select role, count(*) as rows, count(distinct o.path) as paths from (select path, symbol, {KEY_SQL} as key, case when roles = 1 then 'definition' else 'reference' end as role from o) o
      join (select distinct {KEY_SQL} as key from w) w using (key) group by 1
    """,
)
def symbol_occurrences(t) -> DataFrame:
    rows = occurrences(t)
    wanted = rows.filter("start_col = 4").select("repo", "symbol", F.when(F.startswith("symbol", F.lit("local ")), F.col("path")).alias("document"))
    wanted = wanted.withColumn("document", F.coalesce("document", F.lit(""))).distinct()
    parts = [
        precise.occurrences_of_symbols(rows, wanted, role).select(F.lit(role).alias("role"), "path")
        for role in ("definition", "reference")
    ]
    return parts[0].unionByName(parts[1]).groupBy("role").agg(
        F.count("*").alias("rows"), F.count_distinct("path").alias("paths")
    )


def symbol_information(t) -> DataFrame:
    """Every third symbol implements the symbol with the next number."""
    rows = occurrences(t).select("repo", "path", "symbol").distinct()
    number = F.regexp_extract("symbol", r"(\d+)#$", 1).cast("int")
    target = F.concat(F.lit("x p k 1 click"), (number + 1).cast("string"), F.lit("#"))
    return rows.withColumn(
        "relationships",
        F.when(
            number % 3 == 0,
            F.array(
                F.struct(
                    target.alias("symbol"), F.lit(False).alias("is_reference"), F.lit(True).alias("is_implementation"),
                    F.lit(False).alias("is_type_definition"), F.lit(False).alias("is_definition"),
                )
            ),
        ).otherwise(F.array().cast("array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean>>")),
    )


@query(
    "symbol_implementations",
    f"""
    with {OCC_SQL}, l as (select distinct path, symbol, 'x p k 1 click' || (cast(regexp_extract(symbol, '(\\d+)#$', 1) as integer) + 1) || '#' as of from o where cast(regexp_extract(symbol, '(\\d+)#$', 1) as integer) % 3 = 0),
    m as (select distinct of, {KEY_SQL} as key from l), w as (select distinct symbol as of from o where not starts_with(symbol, 'local '))
    select m.of, count(*) as definitions from (select *, {KEY_SQL} as key from o where roles = 1) d join m using (key) where m.of in (select of from w) group by 1
    """,
)
def symbol_implementations(t) -> DataFrame:
    rows = occurrences(t)
    wanted = rows.select("repo", "symbol").distinct().withColumn("of", F.col("symbol"))
    found = precise.implementations_of(rows, symbol_information(t), wanted)
    return found.groupBy(F.col("asked_of").alias("of")).agg(F.count("*").alias("definitions"))


@query(
    "caret_evidence",
    f"""
    with {OCC_SQL}, {CARET_SQL}, {AT_SQL},
    r as (select a.caret_id, o.path, o.sl, o.sc, cast(regexp_extract(o.path, '\\d+') as integer) % 4 = 0 as stale
      from a join o on a.symbol is not null and roles = 1 and case when starts_with(a.symbol, 'local ') then o.path = a.path and o.symbol = a.symbol else o.symbol = a.symbol end)
    select caret_id, path, cast(sl + 1 as integer) as start_line, cast(sc + 1 as integer) as start_column, case when stale then 'inferred_high' else 'exact' end as trust,
      case when stale then 0.55 else 1.0 end as confidence from r
    """,
)
def caret_evidence(t) -> DataFrame:
    """Definitions under carets; the index of every fourth document is stale."""
    rows = occurrences(t)
    documents = rows.select("repo", "path").distinct().select(
        "repo", "path", F.lit("utf32").alias("encoding"), F.lit(True).alias("authoritative"),
        (F.regexp_extract("path", r"(\d+)", 1).cast("int") % 4 == 0).alias("stale"),
    )
    lines = documents.select("repo", "path", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("line")).withColumn("text", F.repeat(F.lit("x"), F.lit(80)))
    asked = carets(t).select("caret_id", "repo", "path", (F.col("line") + 1).alias("line"), (F.col("col") + 1).alias("column"))
    found = precise.caret_evidence(asked, rows, symbol_information(t), documents, lines, "definition")
    return found.select("caret_id", "path", "start_line", "start_column", "trust", "confidence")


@query(
    "precise_fusion",
    f"""
    with {OCC_SQL},
    n as (select distinct 'n:' || path || ':' || sl as id, path, sl + 1 as line, sl + 4 as end_line from o where roles = 1 and sl % 2 = 0),
    f as (select distinct path from o where length(path) > 5),
    d as (select key, arg_min(n.id, (o.path, sl, sc)) as target from (select *, {KEY_SQL} as key from o where roles = 1) o join n on n.path = o.path and n.line = sl + 1 group by 1),
    u as (select u.*, d.target from (select *, row_number() over () as rid, {KEY_SQL} as key from o where roles <> 1) u left join d using (key)),
    s as (select u.rid, u.target, coalesce(arg_max(n.id, (n.line, n.id)), max(case when f.path is not null then 'file:' || u.path end)) as source from u left join n on n.path = u.path and u.sl + 1 between n.line and n.end_line
       left join f on f.path = u.path group by 1, 2),
    g as (select distinct source, target from s where source is not null and target is not null and source <> target),
    c as (select distinct 'n:' || path || ':' || sl as source, lead('n:' || path || ':' || sl) over (partition by path order by sl) as target from (select distinct path, sl from o where roles = 1 and sl % 2 = 0))
    select (select count(*) from g) as exact_edges, (select count(*) from c join g using (source, target)) as superseded_edges,
      (select count(*) from s where source is null or target is null or source = target) as unresolved_occurrences
    """,
)
def precise_fusion(t) -> DataFrame:
    """Occurrences fused into a graph whose ``calls`` edges link neighbouring declarations."""
    rows = occurrences(t)
    spots = rows.filter("roles = 1 and start_line % 2 = 0").select("repo", "path", "start_line").distinct()
    identity = F.concat(F.lit("n:"), "path", F.lit(":"), F.col("start_line").cast("string"))
    symbols = spots.select(
        "repo", identity.alias("id"), F.lit("function").alias("kind"), "path", (F.col("start_line") + 1).alias("line"), (F.col("start_line") + 4).alias("end_line")
    )
    files = rows.filter(F.length("path") > 5).select("repo", "path").distinct().select(
        "repo", F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), "path",
        F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"),
    )
    order = Window.partitionBy("repo", "path").orderBy("line")
    edges = symbols.withColumn("target", F.lead("id").over(order)).filter("target is not null").select(
        "repo", F.col("id").alias("source"), "target", F.lit("calls").alias("kind"),
        F.lit(None).cast("string").alias("resolution"), F.lit(0.5).alias("resolution_confidence"),
    )
    _, report = precise.fuse_precise(symbols.unionByName(files), edges, rows)
    return report.drop("repo")


@query(
    "pull_request_report",
    """
    with f as (select o_custkey % 10 as pr, count(*) as files, cast(sum(o_orderkey % 13 + o_orderkey % 5) as bigint) as churn from orders group by 1),
    s as (select o_custkey % 10 as pr, count(*) * 2 as symbols from orders where o_orderkey % 20 = 1 and o_orderkey % 17 <> 0 and o_orderkey in (select p_partkey from part) group by 1)
    select pr, files, churn, coalesce(symbols, 0) as symbols from f left join s using (pr)
    """,
)
def pull_request_report(t) -> DataFrame:
    """Patches over the code corpus: changed symbols, their impact, risk and affected tests."""
    from loomgraph.operators.review import review

    changes = t.orders.select(
        (F.col("o_custkey") % 10).alias("pr"), F.lit("r1").alias("repo"), text("pkg/m", F.col("o_orderkey"), ".py").alias("path"),
        (F.col("o_orderkey") % 13).cast("int").alias("additions"), (F.col("o_orderkey") % 5).cast("int").alias("deletions"),
    )
    hunks = changes.select("pr", "repo", "path", F.lit(7).alias("start"), F.lit(7).alias("end"))
    files = python_files(t)
    nodes, edges = build.build_graph(files)
    totals = files.select("repo", "path", F.size(extract.source_lines(F.col("content"))).alias("lines"))
    report, _, _ = review(changes, hunks, nodes, edges, totals)
    return report.select("pr", "files", "churn", "symbols")
