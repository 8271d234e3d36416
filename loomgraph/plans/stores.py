"""Sources, stores, listings, evidence and memory bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import dependencies, evidence, listing, memory, quota
from loomgraph.plans.events import k_value, micros
from loomgraph.plans.registry import query
from loomgraph.plans.scalars import EVIDENCE_SQL, SCORE_SQL, evidence_rows
from loomgraph.sources import diffs, files, gitlog, jsonl, manifests, stores

# -- sources -----------------------------------------------------------------------------


def document_files(t) -> DataFrame:
    folder = F.when(F.col("doc_id") % 10 == 0, "node_modules/").when(
        F.col("doc_id") % 10 == 1, "a/.git/"
    ).when(F.col("doc_id") % 10 == 2, "src/build2/").otherwise("src/")
    return t.documents.select(
        F.col("lang").alias("repo"),
        F.concat(folder, "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("n_chars").alias("size"),
    )


@query(
    "files_scan",
    """
    with f as (select lang as repo, case doc_id % 10 when 0 then 'node_modules/' when 1 then 'a/.git/' when 2 then 'src/build2/' else 'src/' end
      || source || '/' || doc_id || '.txt' as path, n_chars as size from documents)
    select repo, path, size from f where len(list_filter(string_split(path, '/'),
      lambda p: p in ('.git','.venv','venv','node_modules','dist','build','__pycache__'))) = 0
    """,
)
def files_scan(t) -> DataFrame:
    return files.scan_files(document_files(t))


@query(
    "span_log",
    """
    select cast(user_id as varchar) as trace_id, event_id, event_type as name, value as duration_ms,
      case when event_type = 'error' then 'boom' end as error, json_extract_string(props, '$.k') as tokens
    from events where event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 17 <> 0
    """,
)
def span_log(t) -> DataFrame:
    """Events written as span lines, some broken, of another version or incomplete."""
    day = F.col("ts").cast("string")
    span = F.struct(
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.lit("").alias("parent_id"),
        F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("name"),
        F.lit("ok").alias("status"),
        day.alias("started_at"),
        day.alias("ended_at"),
        F.col("value").alias("duration_ms"),
        F.create_map(F.lit("context_tokens"), k_value()).alias("attributes"),
        F.when(F.col("event_type") == "error", "boom").alias("error"),
    )
    version = F.when(F.col("event_id") % 13 == 0, 2).otherwise(1)
    line = F.to_json(F.struct(version.alias("version"), span.alias("span")))
    lines = t.events.select(
        "event_id", F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value")
    )
    return jsonl.parse_spans(lines).select(
        "trace_id", "event_id", "name", "duration_ms", "error", F.col("attributes")["context_tokens"].alias("tokens")
    )


@query(
    "telemetry_log",
    """
    select event_id, event_type as name, round(value * 10, 3) as timestamp, json_extract_string(props, '$.k') as k from events where event_id % 11 <> 0
    """,
)
def telemetry_log(t) -> DataFrame:
    """Events written as telemetry lines, some of them broken off."""
    line = F.to_json(
        F.struct(
            F.col("event_type").alias("name"),
            F.round(F.col("value") * 10, 3).alias("timestamp"),
            F.create_map(F.lit("k"), k_value().cast("string")).alias("attributes"),
        )
    )
    broken = F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 20)).otherwise(line)
    parsed = jsonl.parse_telemetry(t.events.select("event_id", broken.alias("value")))
    return parsed.select("event_id", "name", "timestamp", F.col("attributes")["k"].alias("k"))


@query(
    "request_log",
    """
    select 'r' || event_id as request_id, 't' || user_id as trace_id, case event_id % 2 when 0 then 'GET' else 'POST' end as method,
      '/v1/' || event_type as path, cast(200 + event_id % 300 as integer) as status, value as duration_ms from events where event_id % 7 <> 0
    """,
)
def request_log(t) -> DataFrame:
    """Events written as request lines, some of them not JSON."""
    text = lambda c: F.col(c).cast("string")
    line = F.to_json(
        F.struct(
            text("ts").alias("timestamp"),
            F.concat(F.lit("r"), text("event_id")).alias("request_id"),
            F.concat(F.lit("t"), text("user_id")).alias("trace_id"),
            F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
            F.concat(F.lit("/v1/"), "event_type").alias("path"),
            (F.col("event_id") % 300 + 200).cast("int").alias("status"),
            F.col("value").alias("duration_ms"),
        )
    )
    lines = t.events.select(F.when(F.col("event_id") % 7 == 0, "not a line").otherwise(line).alias("value"))
    return jsonl.parse_requests(lines).select("request_id", "trace_id", "method", "path", "status", "duration_ms")


@query(
    "blame_lines",
    """
    select o_orderkey as file, cast(l_linenumber as integer) as line, lpad(cast(l_partkey as varchar), 8, '0') as sha, 'dev' || (l_suppkey % 30) as author,
      'dev' || (l_suppkey % 30) || '@x.org' as email, l_orderkey * 100 + l_linenumber as timestamp, 'x = ' || l_partkey as content
    from lineitem join orders on l_orderkey = o_orderkey
    """,
)
def blame_lines(t) -> DataFrame:
    """Orders as files whose lines are their items, in porcelain blame form."""
    text = lambda c: F.col(c).cast("string")
    dev = F.concat(F.lit("dev"), (F.col("l_suppkey") % 30).cast("string"))
    number = text("l_linenumber")
    entry = F.concat(
        F.lpad(text("l_partkey"), 8, "0"), F.lit(" "), number, F.lit(" "), number, F.lit(" 1\nauthor "), dev,
        F.lit("\nauthor-mail <"), dev, F.lit("@x.org>\nauthor-time "), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("string"),
        F.lit("\nsummary s\n\tx = "), text("l_partkey"), F.lit("\n"),
    )
    records = t.lineitem.groupBy(F.col("l_orderkey").alias("file")).agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", entry.alias("e")))), lambda x: x["e"])).alias("value")
    )
    return gitlog.parse_blame(records)


@query(
    "history_lines",
    """
    select cast(o_orderkey as varchar) as sha, 'dev' || (o_custkey % 50) as author, 'd' || o_custkey as email, strftime(o_orderdate, '%Y-%m-%d') as date,
      'fix | ' || o_orderpriority as subject from orders where o_orderkey % 6 <> 0
    """,
)
def history_lines(t) -> DataFrame:
    """Line-log records with separators in the subject; every sixth one lacks fields."""
    text = lambda c: F.col(c).cast("string")
    full = F.concat_ws(
        "|", text("o_orderkey"), F.concat(F.lit("dev"), (F.col("o_custkey") % 50).cast("string")), F.concat(F.lit("d"), text("o_custkey")),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("fix | "), "o_orderpriority"),
    )
    return gitlog.parse_history_lines(t.orders.select(F.when(F.col("o_orderkey") % 6 == 0, "broken|line").otherwise(full).alias("value")))


@query(
    "commit_log",
    """
    with o as (select o_orderkey, o_custkey, o_orderdate from orders),
    p as (select o_orderkey as sha, 'dev' || (o_custkey % 50) as author, 'dev' || (o_custkey % 50) || '@x.org' as email, epoch_us(o_orderdate) as ts,
      unnest(list_distinct(['src/a' || (o_orderkey % 40) || '.py', 'src/b' || (o_custkey % 30) || '.py', 'src/b' || (o_orderkey % 30) || '.py'])) as path from o)
    select cast(sha as varchar) as sha, author, email, ts, path from p
    """,
)
def commit_log(t) -> DataFrame:
    """Orders exported as ``@@sha|name|mail|date`` records followed by paths."""
    dev = F.concat(F.lit("dev"), (F.col("o_custkey") % 50).cast("string"))
    order = F.col("o_orderkey")
    record = F.concat(
        F.lit("@@"),
        F.concat_ws("|", order.cast("string"), dev, F.concat(dev, F.lit("@x.org")), F.col("o_orderdate").cast("string")),
        F.lit("\n\nsrc/a"),
        (order % 40).cast("string"),
        F.lit(".py\nsrc/b"),
        (F.col("o_custkey") % 30).cast("string"),
        F.lit(".py\nsrc/b"),
        (order % 30).cast("string"),
        F.lit(".py\n"),
    )
    return gitlog.parse_commit_log(t.orders.select(record.alias("value"))).withColumn("ts", micros("ts"))


@query(
    "diff_hunks",
    """
    with d as (select doc_id, lang as pr, 'src/' || source || '/' || doc_id || '.py' as path, doc_id % 97 + 1 as s1, doc_id % 4 as c1, n_chars % 500 + 120 as s2 from documents),
    h as (select pr, path, s1 as "start", s1 + c1 - 1 as "end" from d where c1 > 0 union all select pr, path, s2, s2 from d)
    select pr, path, cast("start" as integer) as start_line, cast("end" as integer) as end_line from h
    """,
)
def diff_hunks(t) -> DataFrame:
    """Patches with a counted hunk (dropped when its count is 0) and a single-line hunk."""
    name = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    record = F.concat(
        F.lit("a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name,
        F.lit("\n@@ -3,0 +"), (F.col("doc_id") % 97 + 1).cast("string"), F.lit(","), (F.col("doc_id") % 4).cast("string"),
        F.lit(" @@ def f()\n-old @@ text\n+new\n@@ -9 +"), (F.col("n_chars") % 500 + 120).cast("string"), F.lit(" @@\n+x\n"),
    )
    hunks = diffs.parse_hunks(t.documents.select(F.col("lang").alias("pr"), record.alias("value")))
    return hunks.filter("start is not null").select(
        "pr", "path", F.col("start").alias("start_line"), F.col("end").alias("end_line")
    )


@query(
    "file_changes",
    """
    with d as (select doc_id, lang as pr, source || '/' || doc_id || '.py' as path, n_chars from documents),
    n as (select pr, path, case when doc_id % 9 = 0 then 0 else n_chars % 300 end as additions, doc_id % 7 as deletions from d where doc_id % 5 <> 0),
    s as (select pr, path, case when doc_id % 2 = 0 then 'A' else 'R100' end as status from d where doc_id % 3 = 0),
    r as (select pr, path, 1 as ranges from d where doc_id % 4 <> 0)
    select pr, path, coalesce(status, 'M') as status, cast(coalesce(additions, 0) as integer) as additions, cast(coalesce(deletions, 0) as integer) as deletions,
      cast(coalesce(ranges, 0) as bigint) as ranges
    from n full join s using (pr, path) full join r using (pr, path)
    """,
)
def file_changes(t) -> DataFrame:
    d = t.documents.select(
        F.col("lang").alias("pr"),
        "doc_id",
        "n_chars",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("p"),
    )
    numstat = d.filter("doc_id % 5 <> 0").select(
        "pr",
        F.concat_ws(
            "\t",
            F.when(F.col("doc_id") % 9 == 0, "-").otherwise((F.col("n_chars") % 300).cast("string")),
            (F.col("doc_id") % 7).cast("string"),
            "p",
        ).alias("value"),
    )
    status = d.filter("doc_id % 3 = 0").select(
        "pr",
        F.when(F.col("doc_id") % 2 == 0, F.concat_ws("\t", F.lit("A"), "p"))
        .otherwise(F.concat_ws("\t", F.lit("R100"), F.lit("old.py"), "p"))
        .alias("value"),
    )
    patch = d.filter("doc_id % 4 <> 0").select(
        "pr", F.concat(F.lit("x\n+++ b/"), "p", F.lit("\n@@ -1 +2 @@\n+z")).alias("value")
    )
    return diffs.file_changes(
        diffs.parse_numstat(numstat), diffs.parse_name_status(status), diffs.parse_hunks(patch), ("pr",)
    )


def manifest_corpus(t) -> DataFrame:
    """Parts written as manifests of several formats, one small repository per part."""
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    size = F.col("p_size").cast("string")
    key = F.col("p_partkey") % 6

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    path = (
        F.when(key == 0, "requirements.txt")
        .when(key == 1, "web/package.json")
        .when(key == 2, "Cargo.toml")
        .when(key == 3, "go.mod")
        .when(key == 4, "pom.xml")
        .otherwise("web/yarn.lock")
    )
    content = (
        F.when(key == 0, text("# pinned\n", name, "[x]>=", size, ".0 ; python_version > '3'\n-r other.txt\nbase==", size, "\n"))
        .when(key == 1, text('{"dependencies": {"', name, '": "^', size, '.1.0"}, "devDependencies": {"jest": "', size, '"}}'))
        .when(key == 2, text("[dependencies]\n", name, ' = "', size, '.2"\n[build-dependencies]\ncc = { version = "1.', size, '" }\n'))
        .when(key == 3, text("module example.com/m\ngo 1.22\nrequire example.com/", name, " v", size, ".0.1 // indirect\n"))
        .when(
            key == 4,
            text(
                "<project><properties><v>", size, "</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>",
                name, "</artifactId><version>${v}</version><scope>test</scope></dependency></dependencies></project>",
            ),
        )
        .otherwise(text('# yarn\n\n"', name, "@^", size, '":\n  version "', size, '.3.1"\n  resolved "u"\n'))
    )
    broken = (F.col("p_partkey") % 6 == 1) & (F.col("p_partkey") % 4 == 3)
    return t.spread("part").select(
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("repo"),
        path.alias("path"),
        F.when(broken, F.lit('{"dependencies": ')).otherwise(content).alias("content"),
    )


MANIFEST_SQL = """
    with p as (select 'r' || p_partkey as repo, p_partkey % 6 as k, p_partkey % 4 as q, replace(p_name, ' ', '-') as n, cast(p_size as varchar) as s from part)
    select repo, 'python' as ecosystem, n as name, '>=' || s || '.0' as declared, null as resolved, 'requirements.txt' as manifest, 'runtime' as scope from p where k = 0
    union all select repo, 'python', 'base', '==' || s, null, 'requirements.txt', 'runtime' from p where k = 0
    union all select repo, 'node', n, '^' || s || '.1.0', null, 'web/package.json', 'runtime' from p where k = 1 and q <> 3
    union all select repo, 'node', 'jest', s, null, 'web/package.json', 'development' from p where k = 1 and q <> 3
    union all select repo, 'rust', n, s || '.2', null, 'Cargo.toml', 'runtime' from p where k = 2
    union all select repo, 'rust', 'cc', '1.' || s, null, 'Cargo.toml', 'build' from p where k = 2
    union all select repo, 'go', 'example.com/' || n, 'v' || s || '.0.1', null, 'go.mod', 'runtime' from p where k = 3
    union all select repo, 'jvm', 'g:' || n, s, null, 'pom.xml', 'development' from p where k = 4
    union all select repo, 'node', n, null, s || '.3.1', 'web/yarn.lock', 'runtime' from p where k = 5
"""


@query("manifest_records", MANIFEST_SQL)
def manifest_records(t) -> DataFrame:
    parsed = manifests.parse_manifests(manifest_corpus(t))
    return manifests.dependency_records(parsed).drop("ordinal", "lock_source")


@query(
    "manifest_reports",
    """
    select 'r' || p_partkey as repo, p_partkey % 6 <> 1 or p_partkey % 4 <> 3 as parsed,
      cast(case p_partkey % 6 when 0 then 2 when 1 then (case when p_partkey % 4 = 3 then 0 else 2 end) when 2 then 2 else 1 end as integer) as dependencies
    from part
    """,
)
def manifest_reports(t) -> DataFrame:
    parsed = manifests.parse_manifests(manifest_corpus(t))
    return manifests.manifest_reports(parsed).select("repo", "parsed", "dependencies")


@query(
    "dependency_inventory",
    f"""
    with m as ({MANIFEST_SQL}),
    f as (select 'c' || (cast(repo[2:] as integer) % 20) as repo, cast(repo[2:] as integer) as ord, * exclude (repo) from m),
    g as (select repo, ecosystem, lower(name) as k, arg_min(name, (ord, manifest)) as name,
      arg_min(declared, (ord, manifest)) filter (declared is not null) as declared,
      arg_min(resolved, (ord, manifest)) filter (resolved is not null) as resolved,
      min(case scope when 'runtime' then 0 when 'build' then 1 when 'optional' then 2 else 3 end) as s from f group by all)
    select repo, ecosystem, name, declared, resolved, case s when 0 then 'runtime' when 1 then 'build' when 2 then 'optional' else 'development' end as scope from g
    """,
)
def dependency_inventory(t) -> DataFrame:
    """Manifests of twenty parts pooled into one repository, declared and resolved merged."""
    records = manifests.dependency_records(manifests.parse_manifests(manifest_corpus(t)))
    number = F.substring("repo", 2, 20).cast("int")
    pooled = records.withColumns(
        {
            "ordinal": F.struct(number.alias("n"), F.col("ordinal")),
            "repo": F.concat(F.lit("c"), (number % 20).cast("string")),
        }
    )
    return dependencies.merge_inventory(pooled).select(
        "repo", "ecosystem", "name", "declared", "resolved", "scope"
    )


def part_inventory(t) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("ecosystem"), F.col("p_name").alias("name")).agg(
        F.min("p_type").alias("declared"),
        F.max(F.when(F.col("p_size") > 25, F.col("p_size").cast("string"))).alias("resolved"),
    )


INVENTORY_SQL = """select p_brand as ecosystem, p_name as name, min(p_type) as declared,
  max(case when p_size > 25 then cast(p_size as varchar) end) as resolved from part group by 1, 2"""


@query(
    "dependency_find",
    f"""
    with i as ({INVENTORY_SQL}), h as (select *, lower(name) = 'ring' as ex from i where contains(lower(name), 'ring'))
    select ecosystem, name, declared, resolved from h where ex or not (select coalesce(bool_or(ex), false) from h)
    """,
)
def dependency_find(t) -> DataFrame:
    return dependencies.find_dependency(part_inventory(t), " Ring ")


@query(
    "dependency_for_library",
    f"""
    with i as ({INVENTORY_SQL}), w as (select distinct ' ' || upper(p_name) as requested from part union all select 'nothing'),
    r as (select lower(name) as k, *, row_number() over (partition by lower(name) order by resolved is null, name, ecosystem) as rn from i)
    select requested, ecosystem, name, declared, resolved from w left join r on r.k = lower(trim(requested)) and rn = 1
    """,
)
def dependency_for_library(t) -> DataFrame:
    wanted = t.part.select(F.concat(F.lit(" "), F.upper("p_name")).alias("name")).distinct()
    wanted = wanted.unionByName(t.region.filter("r_regionkey = 0").select(F.lit("nothing").alias("name")))
    return dependencies.dependency_for(part_inventory(t), wanted)


# -- stores ------------------------------------------------------------------------------


def revision_rows(t) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("repo"),
        F.date_format("ts", "yyyy-MM-dd").alias("revision"),
        micros().alias("created_at"),
        "event_id",
    )


@query(
    "graph_revisions",
    """
    with r as (select event_type as repo, strftime(ts, '%Y-%m-%d') as revision, max(epoch_us(ts)) as created_at, count(*) as rows from events group by 1, 2),
    l as (select repo, arg_max(revision, (created_at, revision)) as latest from r group by 1)
    select repo, revision, created_at, rows, revision = latest as is_latest
    from (select *, row_number() over (partition by repo order by created_at desc, revision desc) as rn from r) join l using (repo) where rn <= 3
    """,
)
def graph_revisions(t) -> DataFrame:
    """The three newest revisions of each repository, the latest one marked."""
    kept = stores.prune_revisions(stores.list_revisions(revision_rows(t)), 3)
    latest = stores.latest_revision(revision_rows(t)).withColumnRenamed("revision", "latest")
    return kept.join(latest, "repo").select(
        "repo", "revision", "created_at", "rows", (F.col("revision") == F.col("latest")).alias("is_latest")
    )


@query(
    "snapshot_upsert",
    """
    with a as (select user_id as snapshot_id, event_type as metric, value, epoch_us(ts) as recorded_at, event_id % 3 = 0 as incoming from events),
    r as (select *, row_number() over (partition by snapshot_id, metric order by incoming desc, recorded_at desc) as rn from a)
    select snapshot_id, metric, value, recorded_at from r where rn = 1
    """,
)
def snapshot_upsert(t) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").alias("snapshot_id"),
        F.col("event_type").alias("metric"),
        "value",
        micros().alias("recorded_at"),
        (F.col("event_id") % 3 == 0).alias("incoming"),
    )
    return stores.upsert_snapshots(
        rows.filter("not incoming").drop("incoming"), rows.filter("incoming").drop("incoming")
    )


@query(
    "snapshot_export",
    """
    select cast(event_id as varchar) as snapshot_id, event_type as suite, value as latency, epoch_us(ts) as recorded_at
    from events where event_type <> 'signup'
    """,
)
def snapshot_export(t) -> DataFrame:
    """Newest snapshots written as JSON lines and read back; rows without metrics are refused."""
    rows = t.events.select(
        F.col("event_id").cast("string").alias("snapshot_id"),
        F.lit("c0").alias("commit"),
        F.col("event_type").alias("suite"),
        F.when(F.col("event_type") != "signup", F.create_map(F.lit("latency"), F.col("value"))).alias("metrics"),
        F.lpad(micros().cast("string"), 20, "0").alias("recorded_at"),
    )
    ordered = rows.withColumn("_id", F.lpad("snapshot_id", 20, "0"))
    newest = stores.snapshot_lines(
        ordered.withColumn("snapshot_id", F.col("_id")).drop("_id")
    )
    back = stores.parse_snapshot_lines(newest)
    return back.select(
        F.col("snapshot_id").cast("long").cast("string").alias("snapshot_id"),
        "suite",
        F.col("metrics")["latency"].alias("latency"),
        F.col("recorded_at").cast("long").alias("recorded_at"),
    )


@query(
    "metrics_flatten",
    """
    with e as (select event_id, cast(json_extract(props, '$.k') as double) as k, event_id % 2 = 0 as b, value from events)
    select event_id, 'k' as metric, k as value from e union all select event_id, 'run.ok', cast(b as integer)::double from e
    union all select event_id, 'run.ms[0]', value from e union all select event_id, 'run.ms[1]', null from e
    """,
)
def metrics_flatten(t) -> DataFrame:
    nested = F.concat(
        F.regexp_replace("props", r"\}$", ""),
        F.lit(', "run": {"ok": '),
        (F.col("event_id") % 2 == 0).cast("string"),
        F.lit(', "label": "x", "ms": ['),
        F.col("value").cast("string"),
        F.lit(", null]}}"),
    )
    rows = t.events.select("event_id", F.explode(stores.flatten_metrics(nested)).alias("m"))
    return rows.select("event_id", "m.metric", "m.value")


@query(
    "change_feed",
    "select event_id as seq, event_type, value from events where event_id > 500 order by event_id limit 1000",
)
def change_feed(t) -> DataFrame:
    return stores.pull_changes(t.events.select(F.col("event_id").alias("seq"), "event_type", "value"), 500, 1000)


def vector_rows(t) -> DataFrame:
    broken = F.when(
        F.col("vec_id") % 10 == 0, F.transform("embedding", lambda v: F.lit(0.0).cast("float"))
    ).when(F.col("vec_id") % 10 == 1, F.array().cast("array<float>"))
    return t.embeddings.select(
        F.col("label").cast("string").alias("namespace"),
        (F.col("vec_id") % 25).cast("string").alias("key"),
        F.coalesce(broken, F.col("embedding")).alias("vector"),
        F.col("vec_id").alias("seq"),
    )


@query(
    "vector_store",
    """
    with v as (select cast(label as varchar) as namespace, cast(vec_id % 25 as varchar) as key, case when vec_id % 2 = 1 then vec_id else -vec_id end as seq from embeddings where vec_id % 10 > 1),
    l as (select namespace, key, coalesce(max(seq) filter (seq > 0), -min(-seq)) as seq from v group by all)
    select namespace, count(*) as vectors, cast(sum(seq) as bigint) as seqs from l where key <> '7' group by 1
    """,
)
def vector_store(t) -> DataFrame:
    """Odd rows upserted over the even ones, one key deleted, vectors counted.

    The even rows, negated, were all written before, whatever their number.
    """
    rows = vector_rows(t)
    odd = F.col("seq") % 2 == 1
    before = rows.filter(~odd).withColumn("seq", -F.col("seq"))
    stored = stores.upsert_vectors(before.filter("false"), before).select(*rows.columns)
    newer = stores.upsert_vectors(stored, rows.filter(odd))
    gone = newer.filter("key = '7'").select("namespace", "key")
    left = stores.delete_vectors(newer, gone)
    return stores.count_vectors(left).join(
        left.groupBy("namespace").agg(F.sum("seq").alias("seqs")), "namespace"
    )


# -- listings ----------------------------------------------------------------------------


@query(
    "edge_dedup",
    """
    with e as (select l_suppkey as source, l_partkey % 100 as target, l_returnflag as kind, l_extendedprice as w, (l_orderkey, l_linenumber, l_extendedprice) as ord from lineitem)
    select source, target, kind, arg_max(w, ord) as weight from e where source <> target group by 1, 2, 3
    """,
)
def edge_dedup(t) -> DataFrame:
    from loomgraph.operators.graph import dedup_edges

    edges = t.lineitem.select(
        F.col("l_suppkey").alias("source"),
        (F.col("l_partkey") % 100).alias("target"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_extendedprice").alias("weight"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("ordinal"),
    )
    return dedup_edges(edges).drop("ordinal")


RANK_ORDER = "score desc, trust, path, start_line, coalesce(start_column, 0), evidence_id"


@query(
    "evidence_rank",
    f"select evidence_id, score from (select *, {SCORE_SQL} as score from ({EVIDENCE_SQL})) order by {RANK_ORDER} limit 100",
)
def evidence_rank(t) -> DataFrame:
    return evidence.rank(evidence_rows(t), 100).select("evidence_id", "score")


@query(
    "evidence_rank_per_path",
    f"""
    select path, position, evidence_id from (select *, row_number() over (partition by path order by {RANK_ORDER}) as position
      from (select *, {SCORE_SQL} as score from ({EVIDENCE_SQL}))) where position <= 5
    """,
)
def evidence_rank_per_path(t) -> DataFrame:
    return evidence.rank_per(evidence_rows(t), ["path"], 5).select(
        "path", F.col("position").cast("long").alias("position"), "evidence_id"
    )


FUSED_SQL = f"""
    select *, first_value(evidence_id) over w as kept_id, first_value(trust) over w as kept_trust,
      count(*) over (partition by kind, path, start_line, start_column, symbol) as n
    from (select *, {SCORE_SQL} as score from ({EVIDENCE_SQL}))
    window w as (partition by kind, path, start_line, start_column, symbol order by {RANK_ORDER})
"""


@query("evidence_fuse", f"select evidence_id, kept_id, n as records_at_location from ({FUSED_SQL})")
def evidence_fuse(t) -> DataFrame:
    return evidence.fuse(evidence_rows(t)).select("evidence_id", "kept_id", "records_at_location")


# The tier of the first binding depends on the symbol, so conflicts need a tier that varies.
def conflicted(t) -> DataFrame:
    rows = evidence_rows(t)
    tier = F.when(F.col("evidence_id").cast("long") % 4 == 0, "weak").otherwise(F.col("trust"))
    return rows.withColumn("trust", tier)


CONFLICT_SQL = EVIDENCE_SQL.replace(
    "as trust", "as tier0, case when event_id % 4 = 0 then 'weak' else tier0 end as trust", 1
)


@query(
    "evidence_conflicts",
    f"""
    with s as (select *, {SCORE_SQL} as score from ({CONFLICT_SQL})),
    r as (select *, row_number() over (partition by kind, path, start_line, start_column, symbol order by {RANK_ORDER}) as rn,
      min(trust) over p <> max(trust) over p as differs, count(*) over p - 1 as superseded from s
      window p as (partition by kind, path, start_line, start_column, symbol))
    select evidence_id, trust, superseded from r where rn = 1 and differs
    """,
)
def evidence_conflicts(t) -> DataFrame:
    return evidence.conflicts(conflicted(t)).select("evidence_id", "trust", "superseded")


@query(
    "evidence_bundles",
    f"""
    with s as (select *, {SCORE_SQL} as score from ({CONFLICT_SQL})),
    r as (select *, row_number() over (partition by kind, path, start_line, start_column, symbol order by {RANK_ORDER}) as rn from s)
    select provider, count(*) as kept, true as degraded from r where rn = 1 group by 1
    """,
)
def evidence_bundles(t) -> DataFrame:
    rows = conflicted(t)
    reports = rows.groupBy("provider").agg(
        F.when(F.max("stale"), "stale").otherwise("available").alias("state")
    )
    records, degraded = evidence.merge_bundles(
        [rows.filter(F.col("provider") == p) for p in ("p0", "p1", "p2")], reports
    )
    return (
        records.groupBy("provider")
        .agg(F.count("*").alias("kept"))
        .withColumn("degraded", degraded.scalar())
    )


@query(
    "recent_audit",
    "select event_id, user_id from events where event_type = 'purchase' and user_id % 2 = 0 order by ts desc, event_id desc limit 200",
)
def recent_audit(t) -> DataFrame:
    where = (F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0)
    return listing.recent(t.events, "ts", "event_id", 200, where).select("event_id", "user_id")


@query(
    "recent_jobs",
    "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey desc limit 100",
)
def recent_jobs(t) -> DataFrame:
    return listing.recent(t.orders, "o_orderdate", "o_orderkey", 100, F.col("o_orderstatus") == "F").select(
        "o_orderkey", "o_orderstatus"
    )


@query(
    "first_seen_files",
    "select l_suppkey as path, min(l_orderkey) as first_seen from lineitem group by 1 order by 2, 1 limit 50",
)
def first_seen_files(t) -> DataFrame:
    return listing.first_seen(t.lineitem.withColumnRenamed("l_suppkey", "path"), "path", "l_orderkey", 50)


@query(
    "retention_prune",
    "select event_type, count(*) as kept from events where epoch_us(ts) >= (select max(epoch_us(ts)) from events) - 5 * 86400000000 group by 1",
)
def retention_prune(t) -> DataFrame:
    events = t.events.withColumn("us", micros())
    now = events.agg(F.max("us")).scalar()
    kept = listing.prune(events, "us", now, 5)
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"))


@query(
    "stale_documents",
    """
    with i as (select doc_id as id, md5(text) as text, lang from documents where doc_id % 5 <> 0),
    c as (select doc_id as id, md5(case when doc_id % 7 = 0 then text || '!' else text end) as text, lang from documents where doc_id % 4 <> 0)
    select id, 'removed' as action from i where id not in (select id from c)
    union all select c.id, 'changed' from c left join i using (id) where i.id is null or c.text <> i.text
    """,
)
def stale_documents(t) -> DataFrame:
    indexed = t.documents.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), "text", "lang")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = t.documents.filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), edited.alias("text"), "lang")
    return listing.document_changes(indexed, current)


@query(
    "manifest_diff",
    """
    with b as (select lang as repo, doc_id as path, n_chars as size, doc_id % 4 as m, md5(text) as digest from documents where doc_id % 6 <> 0),
    a as (select lang as repo, doc_id as path, n_chars + (doc_id % 9 = 0)::int as size, doc_id % 5 as m, md5(case when doc_id % 9 = 0 then text || '!' else text end) as digest from documents where doc_id % 7 <> 0)
    select coalesce(a.repo, b.repo) as repo, coalesce(a.path, b.path) as path,
      case when b.path is null then 'added' when a.path is null then 'removed' when (a.size = b.size and a.m = b.m) or a.digest = b.digest then 'unchanged' else 'changed' end as status
    from b full join a on a.repo = b.repo and a.path = b.path
    """,
)
def manifest_diff(t) -> DataFrame:
    d = t.documents.withColumnRenamed("lang", "repo").withColumnRenamed("doc_id", "path")
    edited = F.col("path") % 9 == 0
    before = d.filter("path % 6 <> 0").select(
        "repo", "path", F.col("n_chars").alias("size"), (F.col("path") % 4).alias("mtime_ns"), F.md5("text").alias("digest")
    )
    after = d.filter("path % 7 <> 0").select(
        "repo",
        "path",
        (F.col("n_chars") + edited.cast("int")).alias("size"),
        (F.col("path") % 5).alias("mtime_ns"),
        F.md5(F.when(edited, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest"),
    )
    return listing.snapshot_diff(before, after, ["repo", "path"])


@query(
    "index_freshness",
    """
    with j as (select d.doc_id, d.lang, l.doc_id is null as missing, coalesce(l.quality = 0, false) as newer from documents d left join labels l using (doc_id)),
    g as (select lang as repo, count(*) filter (missing) as missing, count(*) filter (newer) as newer,
      (list_sort(list('p' || doc_id) filter (newer)))[1:3] as nl, (list_sort(list('p' || doc_id) filter (missing)))[1:3] as ml from j group by 1)
    select repo, missing + newer > 0 as stale, case when newer > 0 then 'source changed after indexing: ' || array_to_string(nl, ', ') || case when newer > 3 then ' (and ' || (newer - 3) || ' more)' else '' end
      when missing > 0 then 'indexed files are missing: ' || array_to_string(ml, ', ') || case when missing > 3 then ' (and ' || (missing - 3) || ' more)' else '' end else '' end as reason
    from g
    """,
)
def index_freshness(t) -> DataFrame:
    from loomgraph.operators.precise import freshness

    indexed = t.documents.select(
        F.col("lang").alias("repo"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"),
        F.lit(0).cast("long").alias("index_mtime"),
    )
    present = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        F.col("lang").alias("repo"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"),
        (1 - F.col("quality")).cast("long").alias("mtime_ns"),
    )
    return freshness(indexed, present)


# -- memory ------------------------------------------------------------------------------


def writes(t) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("namespace"),
        (F.col("user_id") % 20).cast("string").alias("key"),
        F.col("props").alias("value"),
        F.col("event_id").alias("seq"),
    )


WRITES_SQL = "select event_type as namespace, cast(user_id % 20 as varchar) as key, props as value, event_id as seq from events"


@query(
    "memory_revisions",
    f"select namespace, key, seq, row_number() over (partition by namespace, key order by seq) as revision from ({WRITES_SQL})",
)
def memory_revisions(t) -> DataFrame:
    return memory.revisions(writes(t)).select("namespace", "key", "seq", "revision")


@query(
    "memory_latest",
    f"select namespace, key, arg_max(value, seq) as value, max(seq) as seq, count(*) as revision from ({WRITES_SQL}) group by 1, 2",
)
def memory_latest(t) -> DataFrame:
    return memory.latest(writes(t))


@query(
    "memory_history",
    f"""
    select namespace, key, seq, revision from (select *, row_number() over (partition by namespace, key order by seq) as revision,
      row_number() over (partition by namespace, key order by seq desc) as rn from ({WRITES_SQL})) where rn <= 50
    """,
)
def memory_history(t) -> DataFrame:
    return memory.history(writes(t), 50).select("namespace", "key", "seq", "revision")


@query(
    "optimistic_writes",
    f"""
    with recursive w as (select *, case when seq % 5 = 0 then null else (seq * 7) % 23 // 4 + (seq // 800) end as expected,
        row_number() over (partition by namespace, key order by seq) as rn from ({WRITES_SQL})),
    r as (
      select namespace, key, seq, rn, expected is null or expected = 0 as accepted, (expected is null or expected = 0)::int as cur from w where rn = 1
      union all
      select w.namespace, w.key, w.seq, w.rn, w.expected is null or w.expected = r.cur, r.cur + (w.expected is null or w.expected = r.cur)::int
      from r join w on w.namespace = r.namespace and w.key = r.key and w.rn = r.rn + 1)
    select namespace, key, seq, accepted, case when accepted then cast(cur as bigint) else -1 end as revision, case when not accepted then cast(cur as bigint) else -1 end as found from r
    """,
)
def optimistic_writes(t) -> DataFrame:
    seq = F.col("seq")
    expected = F.when(
        seq % 5 != 0, F.floor((seq * 7) % 23 / 4) + F.floor(seq / 800)
    ).cast("long")
    return memory.optimistic_writes(writes(t).withColumn("expected", expected)).select(
        "namespace",
        "key",
        "seq",
        "accepted",
        F.coalesce("revision", F.lit(-1)).cast("long").alias("revision"),
        F.coalesce("found", F.lit(-1)).cast("long").alias("found"),
    )


def mutations(t) -> DataFrame:
    e = F.col("event_id")
    return t.events.select(
        F.lit("team").alias("namespace"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        F.when(e % 2 == 0, "a").otherwise("b").alias("node_id"),
        F.create_map(
            F.lit("a"),
            F.floor(e * 7 % 61 + e / 400).cast("int"),
            F.lit("b"),
            F.floor(e * 11 % 67 + e / 300).cast("int"),
        ).alias("clock"),
        F.lpad((e * 37 % 1009).cast("string"), 6, "0").alias("updated_at"),
        (e % 10 == 0).alias("tombstone"),
        e.alias("seq"),
    )


@query(
    "memory_sync",
    """
    with recursive m as (select cast(user_id as varchar) as key, event_id as seq, props as value, case when event_id % 2 = 0 then 'a' else 'b' end as node,
        cast(floor(event_id * 7 % 61 + event_id / 400) as integer) as ca, cast(floor(event_id * 11 % 67 + event_id / 300) as integer) as cb,
        lpad(cast(event_id * 37 % 1009 as varchar), 6, '0') as upd, event_id % 10 = 0 as tomb,
        row_number() over (partition by user_id order by event_id) as rn from events),
    r as (
      select key, rn, value, node, ca, cb, upd, tomb, 1 as applied, 0 as ignored, 0 as conflicts from m where rn = 1
      union all
      select m.key, m.rn, case when take then m.value else r.value end, case when take then m.node else r.node end,
        case when skip then r.ca else greatest(m.ca, r.ca) end, case when skip then r.cb else greatest(m.cb, r.cb) end,
        case when take then m.upd else r.upd end, case when take then m.tomb else r.tomb end,
        r.applied + (not skip)::int, r.ignored + skip::int, r.conflicts + (not skip and not dom)::int
      from r join (select m.*, 0 as z from m) m on m.key = r.key and m.rn = r.rn + 1,
        lateral (select m.ca >= r.ca and m.cb >= r.cb and (m.ca > r.ca or m.cb > r.cb) as dom, m.ca <= r.ca and m.cb <= r.cb as skip) d,
        lateral (select not skip and (dom or (m.upd, m.node) > (r.upd, r.node)) as take) e)
    select 'team' as namespace, key, value, node as node_id, upd as updated_at, tomb as tombstone, ca as clock_a, cb as clock_b,
      cast(applied as bigint) as applied, cast(ignored as bigint) as ignored, cast(conflicts as bigint) as conflicts
    from r qualify row_number() over (partition by key order by rn desc) = 1
    """,
)
def memory_sync(t) -> DataFrame:
    state = memory.memory_sync(mutations(t))
    return state.withColumns({"clock_a": F.col("clock")["a"], "clock_b": F.col("clock")["b"]}).drop("clock")


@query(
    "sliding_quota",
    """
    with recursive c as (select cast(user_id % 40 as varchar) as principal, epoch_us(ts) as t, event_id as seq,
        row_number() over (partition by user_id % 40 order by event_id) as rn from events),
    r as (
      select principal, seq, rn, true as allowed, [t] as open from c where rn = 1
      union all
      select c.principal, c.seq, c.rn, len(live) < 3, case when len(live) < 3 then list_append(live, c.t) else live end
      from r join c on c.principal = r.principal and c.rn = r.rn + 1, lateral (select list_filter(r.open, lambda x: x > c.t - 21600000000) as live) l)
    select principal, seq, allowed from r
    """,
)
def sliding_quota(t) -> DataFrame:
    """Three calls per six hours and principal."""
    calls = t.events.select(
        (F.col("user_id") % 40).cast("string").alias("principal"), micros().alias("t"), F.col("event_id").alias("seq")
    )
    return quota.sliding_quota(calls, 3, 6 * 3_600_000_000).select("principal", "seq", "allowed")


@query(
    "memory_search_plain",
    f"""
    with q(query_id, namespace, a, b) as (values (1, 'click', '3', '5'), (2, 'view', '12', 'k'), (3, 'error', 'zzz', '17')),
    l as (select namespace, key, arg_max(value, seq) as value from ({WRITES_SQL}) group by 1, 2),
    s as (select query_id, l.*, contains(lower(key || ' ' || value), a)::int + contains(lower(key || ' ' || value), b)::int as score from l join q using (namespace))
    select query_id, key, cast(score as integer) as score, row_number() over (partition by query_id order by score desc, key) as position from s where score > 0
    qualify position <= 10
    """,
)
def memory_search_plain(t) -> DataFrame:
    spark = t.spark
    queries = spark.createDataFrame(
        [(1, "click", "3 5"), (2, "view", "12 K"), (3, "error", "zzz 17")], "query_id int, namespace string, query string"
    )
    hits = memory.search_plain(memory.latest(writes(t)), queries, 10)
    return hits.select("query_id", "key", "score", F.col("position").cast("long").alias("position"))


@query(
    "memory_search_team",
    f"""
    with q(query_id, namespace, a, b) as (values (1, 'click', '3', '5'), (2, 'view', '12', 'k')),
    l as (select namespace, key, arg_max(value, seq) as value, max(seq) as seq from ({WRITES_SQL}) group by 1, 2),
    h as (select query_id, l.*, a, b, lower(key || ' ' || value || ' tag' || key) as hay from l join q using (namespace)),
    s as (select *, case when not contains(hay, a) then 0 when contains(key, a) then 3 else 1 end + case when not contains(hay, b) then 0 when contains(key, b) then 3 else 1 end as score from h)
    select query_id, key, cast(score as integer) as score, row_number() over (partition by query_id order by score desc, seq, key) as position from s where score > 0
    qualify position <= 10
    union all select 3, key, 0, row_number() over (order by seq, key) as position from l where namespace = 'error' qualify position <= 10
    """,
)
def memory_search_team(t) -> DataFrame:
    queries = t.spark.createDataFrame(
        [(1, "click", "3 5"), (2, "view", "12 K"), (3, "error", "  ")], "query_id int, namespace string, query string"
    )
    entries = memory.latest(writes(t)).withColumns(
        {"tags": F.array(F.concat(F.lit("tag"), "key")), "updated_at": F.col("seq")}
    )
    hits = memory.search_team(entries, queries, 10)
    return hits.select("query_id", "key", "score", F.col("position").cast("long").alias("position"))


@query(
    "memory_results",
    f"""
    with l as (select namespace, key, arg_max(value, seq) as value from ({WRITES_SQL}) group by 1, 2),
    s as (select *, contains(lower(key || ' ' || value), '1')::int + contains(lower(key || ' ' || value), '9')::int as score from l where namespace in ('click', 'view')),
    p as (select *, row_number() over (partition by namespace order by score desc, key) as position from s where score > 0)
    select namespace, key, position from p where position <= 10
    """,
)
def memory_results(t) -> DataFrame:
    """Two memory namespaces searched and concatenated, at most twenty rows."""
    queries = t.spark.createDataFrame(
        [(1, "click", "1 9"), (2, "view", "1 9")], "query_id int, namespace string, query string"
    )
    hits = memory.search_plain(memory.latest(writes(t)), queries, 10).withColumn(
        "position", F.col("position").cast("long")
    )
    parts = [hits.filter(F.col("query_id") == i).select("namespace", "key", "position") for i in (1, 2)]
    return listing.concat_results(parts, 20)
