"""Graph, search, history and quality queries over a graph built from the foreign keys.

Nodes are regions, nations, customers, suppliers, parts and orders. Nations are contained in
regions, customers and suppliers reference nations, orders call customers and import parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scoring import EDGE_WEIGHTS, RESOLUTION_MULTIPLIERS
from loomgraph.operators import access, architecture, federation, graph, history, quality, resolution, search
from loomgraph.plans.events import K_SQL, k_value, micros
from loomgraph.plans.registry import query
from loomgraph.plans.scalars import HOST_PATH_SQL, host_path, sql_aliases, sql_normalize, sql_zone
from loomgraph.plans.sqltext import quote, sql_case, sql_graph_terms
from loomgraph.session import durable


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _node(df, prefix, key, kind, name, path) -> DataFrame:
    return df.select(
        F.lit("main").alias("repo"),
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"),
        kind.alias("kind"),
        name.alias("name"),
        path.alias("path"),
        F.col(key).cast("int").alias("line"),
    )


def fk_nodes(t) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    customer_path = F.concat(
        F.lit("src/"), F.lower("c_mktsegment"), F.lit("/services/c"), text("c_nationkey"), F.lit(".py")
    )
    order_path = F.when(
        F.col("o_orderkey") % 10 == 0, F.concat(F.lit("tests/o"), (F.col("o_custkey") % 97).cast("string"), F.lit(".py"))
    ).otherwise(F.concat(F.lit("lib/api/o"), (F.col("o_custkey") % 97).cast("string"), F.lit(".py")))
    return union(
        [
            _node(t.region, "r", "r_regionkey", F.lit("file"), F.col("r_name"), F.concat(F.lit("src/domain/"), F.lower("r_name"), F.lit(".py"))),
            _node(t.nation, "n", "n_nationkey", F.lit("class"), F.col("n_name"), F.concat(F.lit("src/models/r"), text("n_regionkey"), F.lit("/nation.py"))),
            _node(t.customer, "c", "c_custkey", F.lit("function"), F.col("c_name"), customer_path),
            _node(t.supplier, "s", "s_suppkey", F.lit("method"), F.col("s_name"), F.concat(F.lit("src/adapters/s"), text("s_nationkey"), F.lit(".py"))),
            _node(t.part, "p", "p_partkey", F.when(F.col("p_size") % 10 == 0, "module").otherwise("class"), F.col("p_name"),
                  F.when(F.col("p_size") % 10 == 0, none).otherwise(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/repository/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit(".py")))),
            _node(t.orders, "o", "o_orderkey", F.lit("function"), F.concat(F.lit("order_"), text("o_orderkey")), order_path),
        ]
    )


NODES_SQL = """
  select 'main' as repo, 'r' || r_regionkey as id, 'file' as kind, r_name as name, 'src/domain/' || lower(r_name) || '.py' as path, cast(r_regionkey as integer) as line from region
  union all select 'main', 'n' || n_nationkey, 'class', n_name, 'src/models/r' || n_regionkey || '/nation.py', cast(n_nationkey as integer) from nation
  union all select 'main', 'c' || c_custkey, 'function', c_name, 'src/' || lower(c_mktsegment) || '/services/c' || c_nationkey || '.py', cast(c_custkey as integer) from customer
  union all select 'main', 's' || s_suppkey, 'method', s_name, 'src/adapters/s' || s_nationkey || '.py', cast(s_suppkey as integer) from supplier
  union all select 'main', 'p' || p_partkey, case when p_size % 10 = 0 then 'module' else 'class' end, p_name,
    case when p_size % 10 = 0 then null else 'src/' || lower(p_type) || '/repository/' || replace(lower(p_brand), '#', '-') || '.py' end, cast(p_partkey as integer) from part
  union all select 'main', 'o' || o_orderkey, 'function', 'order_' || o_orderkey, case when o_orderkey % 10 = 0 then 'tests/o' else 'lib/api/o' end || (o_custkey % 97) || '.py', cast(o_orderkey as integer) from orders
"""


def _edge(df, sp, s, tp, tgt, kind, resolution=None, confidence=None) -> DataFrame:
    return df.select(
        F.lit("main").alias("repo"),
        F.concat(F.lit(sp), F.col(s).cast("string")).alias("source"),
        F.concat(F.lit(tp), F.col(tgt).cast("string")).alias("target"),
        F.lit(kind).alias("kind"),
        (F.lit(None) if resolution is None else resolution).cast("string").alias("resolution"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("resolution_confidence"),
    )


def fk_edges(t) -> DataFrame:
    imports = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    return union(
        [
            _edge(t.nation, "n", "n_nationkey", "r", "n_regionkey", "contains"),
            _edge(t.customer, "c", "c_custkey", "n", "c_nationkey", "references", F.when(F.col("c_custkey") % 4 == 0, "exact").when(F.col("c_custkey") % 4 == 1, "stale_exact")),
            _edge(t.supplier, "s", "s_suppkey", "n", "s_nationkey", "references"),
            _edge(t.orders, "o", "o_orderkey", "c", "o_custkey", "calls", None, F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(0.5)),
            _edge(imports, "o", "l_orderkey", "p", "l_partkey", "imports"),
        ]
    )


EDGES_SQL = """
  select 'main' as repo, 'n' || n_nationkey as source, 'r' || n_regionkey as target, 'contains' as kind, null as resolution, null as resolution_confidence from nation
  union all select 'main', 'c' || c_custkey, 'n' || c_nationkey, 'references', case c_custkey % 4 when 0 then 'exact' when 1 then 'stale_exact' end, null from customer
  union all select 'main', 's' || s_suppkey, 'n' || s_nationkey, 'references', null, null from supplier
  union all select 'main', 'o' || o_orderkey, 'c' || o_custkey, 'calls', null, case when o_orderkey % 5 = 0 then 0.0 else 0.5 end from orders
  union all select distinct 'main', 'o' || l_orderkey, 'p' || l_partkey, 'imports', null, null from lineitem
"""
WEIGHTED_SQL = f"""
  select *, {sql_case(EDGE_WEIGHTS, 'kind', 0.5)} * {sql_case(RESOLUTION_MULTIPLIERS, 'label', 0.85)} as weight from
  (select *, case when resolution is not null then resolution when resolution_confidence <= 0 then 'unresolved' else 'inferred' end as label from ({EDGES_SQL}))
"""


@query("node_counts", f"select kind, count(*) as nodes from ({NODES_SQL}) group by 1")
def node_counts(t) -> DataFrame:
    return graph.counts_by_kind(fk_nodes(t))


@query(
    "hot_nodes",
    f"select id, count(*) as degree from (select source as id from ({EDGES_SQL}) union all select target from ({EDGES_SQL})) group by 1 order by 2 desc, 1 limit 12",
)
def hot_nodes(t) -> DataFrame:
    return graph.hot_nodes(fk_edges(t), 12)


@query(
    "graph_fingerprint",
    f"""
    with n as (select count(*) as nodes, sum(cast('0x' || md5(id)[1:15] as bigint)) as node_sum from ({NODES_SQL})),
    e as (select count(*) as edges, sum(cast('0x' || md5(source || chr(0) || kind || chr(0) || target)[1:15] as bigint)) as edge_sum from ({EDGES_SQL}))
    select nodes, cast(node_sum as varchar) as node_sum, edges, cast(edge_sum as varchar) as edge_sum from n, e
    """,
)
def graph_fingerprint(t) -> DataFrame:
    digest = graph.graph_fingerprint(fk_nodes(t), fk_edges(t))
    return digest.withColumns({c: F.col(c).cast("string") for c in ("node_sum", "edge_sum")})


# -- impact ------------------------------------------------------------------------------

TARGET_NAMES = ("AFRICA", "asia", "NATION_3", "nation_11", "small ring", "Customer#000000007")


def request_table(t, names) -> DataFrame:
    return t.spark.createDataFrame(list(enumerate(names)), "query_id int, query string")


def impact_items(t) -> DataFrame:
    nodes = fk_nodes(t)
    targets = graph.find_targets(nodes, request_table(t, TARGET_NAMES))
    return graph.impact(nodes, durable(fk_edges(t)), targets)


TARGETS_SQL = f"""
  select id from (select id, row_number() over (partition by lower(name) order by kind = 'file', coalesce(path, ''), id) as rn
    from ({NODES_SQL}) where lower(name) in ({', '.join(quote(n.lower()) for n in TARGET_NAMES)})) where rn = 1
"""
# The key graph is layered, so every node is reached at one depth: three unrolled levels.
IMPACT_SQL = f"""
  with w as ({WEIGHTED_SQL}), n as ({NODES_SQL}), t as ({TARGETS_SQL}),
  l1 as (select t.id as target, w.source as node, 1 as depth, weight as strength, w.kind as via, label as evidence from t join w on w.target = t.id),
  l2 as (select l1.target, w.source as node, 2 as depth, strength * weight as strength, w.kind as via, label as evidence from l1 join w on w.target = l1.node),
  l3 as (select l2.target, w.source as node, 3 as depth, strength * weight as strength, w.kind as via, label as evidence from l2 join w on w.target = l2.node),
  a as (select * from l1 union all select * from l2 union all select * from l3),
  r as (select *, row_number() over (partition by target, node, depth order by strength desc, via, evidence) as rn from a)
  select target, node, n.kind, n.name, n.path, depth, via, least(1.0, strength / greatest(1.0, depth * 0.85)) as risk, evidence,
    contains('/' || lower(coalesce(path, '')), '/test') or contains(lower(coalesce(path, '')), 'tests/') or starts_with(lower(name), 'test_')
     or ends_with(lower(name), 'test') or ends_with(lower(name), 'tests') as is_test
  from r join n on n.id = r.node where rn = 1
"""


@query(
    "impact",
    f"select target, node, depth, via, round(risk, 6) as risk, evidence, is_test from ({IMPACT_SQL})",
)
def impact(t) -> DataFrame:
    return impact_items(t).select(
        "target", "node", "depth", "via", F.round("risk", 6).alias("risk"), "evidence", "is_test"
    )


@query(
    "impact_report",
    f"""
    select target, count(*) filter (depth = 1) as direct, count(*) filter (depth > 1) as indirect, count(*) filter (is_test) as tests,
      round(least(1.0, avg(risk) * 0.7 + least(1.0, count(*) / 25.0) * 0.3), 6) as risk_score from ({IMPACT_SQL}) group by 1
    """,
)
def impact_report(t) -> DataFrame:
    report = graph.impact_report(impact_items(t))
    return report.withColumn("risk_score", F.round("risk_score", 6))


@query(
    "impact_evidence",
    f"select target, evidence, count(*) as nodes from ({IMPACT_SQL}) group by 1, 2",
)
def impact_evidence(t) -> DataFrame:
    return graph.evidence_quality(impact_items(t))


@query(
    "impact_highest",
    f"""
    select target, node, row_number() over (partition by target order by round(risk, 9) desc, depth, name, node) as position from ({IMPACT_SQL}) qualify position <= 20
    """,
)
def impact_highest(t) -> DataFrame:
    items = impact_items(t).withColumn("risk", F.round("risk", 9))
    return graph.highest_risk(items, 20).select("target", "node", F.col("position").cast("long").alias("position"))


# -- architecture ------------------------------------------------------------------------


def dependencies_sql(edges: str) -> str:
    place = f"case when path is not null and path <> '' then {sql_zone('path')} else 'external' end"
    return f"""
      select 'main' as repo, coalesce(a.zone, 'external') || '->' || coalesce(b.zone, 'external') || ':' || e.kind as signature, count(*) as edges,
        cast(sum(case when b.id is null or b.kind in ('reference', 'module') then 1 else 0 end) as bigint) as unresolved
      from ({edges}) e left join (select id, {place} as zone from ({NODES_SQL})) a on a.id = e.source
        left join (select id, kind, {place} as zone from ({NODES_SQL})) b on b.id = e.target
      where e.kind in ('calls', 'imports', 'inherits', 'implements') group by all
    """


@query("architecture_dependencies", dependencies_sql(EDGES_SQL))
def architecture_dependencies(t) -> DataFrame:
    return architecture.dependency_counts(fk_nodes(t), fk_edges(t))


@query(
    "architecture_zones",
    f"select repo, {sql_zone('path')} as zone, count(*) as files from ({NODES_SQL}) where kind = 'file' group by all",
)
def architecture_zones(t) -> DataFrame:
    return architecture.zone_files(fk_nodes(t))


def page_nodes(t) -> DataFrame:
    """Pages as files of one repository per language, plus layer folders taken from the page number."""
    folders = ["domain", "ports", "adapters", "services", "repository", "models", "views", "controllers", "plugins", "hooks", "packages", "config-api"]
    folder = F.get(F.array(*[F.lit(f) for f in folders]), (F.col("page_id") % len(folders)).cast("int"))
    lang = F.regexp_extract("url", r"/(en|de|fr|es)/", 1)
    return t.pages.select(
        F.concat(lang, (F.col("page_id") % 5).cast("string")).alias("repo"),
        F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("id"),
        F.lit("file").alias("kind"),
        F.concat(F.lit("x_"), lang).alias("name"),
        F.concat(F.lit("src/"), folder, F.lit("/"), F.regexp_extract("url", r"//([^/]*)/", 1), F.lit("/p.py")).alias("path"),
    )


FOLDER_LIST = "['domain','ports','adapters','services','repository','models','views','controllers','plugins','hooks','packages','config-api']"


def _patterns_values() -> str:
    rows = ", ".join(
        f"({quote(p)}, {quote(label)}, {quote(a)}, {w})" for p, label, a, w in architecture.pattern_table()
    )
    return f"(values {rows}) as pt(pattern, label, term, weight)"


_SIZES = {p: len(g) for p, g in architecture.PATTERNS.items()}
INFER_SQL = f"""
  with n as (select regexp_extract(url, '/(en|de|fr|es)/', 1) || (page_id % 5) as repo, {FOLDER_LIST}[page_id % 12 + 1] as folder, regexp_extract(url, '//([^/]*)/', 1) as host from pages),
  s as (select distinct repo, replace(unnest(list_concat([folder], string_split(replace(folder, '-', '_'), '_'))), '-', '_') as term from n
        union select distinct repo, unnest(string_split(replace(regexp_replace(lower(host), '([^/])\\.[^./]+$', '\\1'), '-', '_'), '_')) from n),
  m as (select repo, pattern, label, max(weight) as weight, list_sort(list(distinct s.term)) as terms from s join {_patterns_values()} on pt.term = s.term group by 1, 2, 3),
  c as (select repo, pattern, count(*) as matched, sum(weight) as total, array_to_string(list_sort(list(label || ': ' || array_to_string(terms[1:3], ', '))), '; ') as evidence from m group by 1, 2),
  k as (select *, round(least(1.0, cast(total as double) * (0.70 + 0.30 * matched / {sql_case(_SIZES, 'pattern', 1)})), 4) as confidence from c)
  select repo, row_number() over (partition by repo order by confidence desc, pattern) as rank, pattern, confidence, evidence from k where confidence >= 0.2 qualify rank <= 4
"""


@query("architecture_inference", INFER_SQL)
def architecture_inference(t) -> DataFrame:
    return architecture.infer_architecture(page_nodes(t)).withColumn("rank", F.col("rank").cast("long"))


HALF_SQL = f"select * from ({EDGES_SQL}) where cast(regexp_replace(source, '^[a-z]', '') as bigint) % 3 = 0 and kind <> 'imports' or kind = 'imports' and target like '%7'"


def half_edges(t) -> DataFrame:
    number = F.regexp_replace("source", "^[a-z]", "").cast("long")
    calls = (number % 3 == 0) & (F.col("kind") != "imports")
    return fk_edges(t).filter(calls | ((F.col("kind") == "imports") & F.endswith("target", F.lit("7"))))


FINDINGS_SQL = f"""
  with b as ({dependencies_sql(HALF_SQL)}), c as ({dependencies_sql(EDGES_SQL)}),
  j as (select c.signature, c.edges as now, coalesce(b.edges, 0) as before from c left join b using (signature)),
  ur as (select (select sum(unresolved) / greatest(sum(edges), 1) from c) as now, (select sum(unresolved) / greatest(sum(edges), 1) from b) as before)
  select 'main' as repo, 'new-dependency-direction' as kind, case when contains(signature, ':calls') or contains(signature, ':inherits') then 'high' else 'medium' end as severity,
    case when contains(signature, ':calls') or contains(signature, ':inherits') then 0.70 else 0.45 end as score, 'New dependency direction detected: ' || signature || '.' as message from j where before = 0
  union all select 'main', 'dependency-growth', 'medium', least(0.70, 0.35 + (now - before) / greatest(before, 1) * 0.20), 'Dependency volume increased sharply: ' || signature || '.'
    from j where before > 0 and now - before >= 2 and (now - before) / greatest(before, 1) > 0.75
  union all select 'main', 'resolution-quality-drop', 'medium', least(0.65, 0.40 + now - before), 'Unresolved dependency ratio increased.' from ur where now - before >= 0.12
"""


def drift_findings(t) -> DataFrame:
    nodes = fk_nodes(t)
    base = architecture.dependency_counts(nodes, half_edges(t))
    now = architecture.dependency_counts(nodes, fk_edges(t))
    patterns = architecture.infer_architecture(nodes)
    return architecture.drift(base, now, patterns, patterns)


@query("architecture_drift", f"select repo, kind, severity, round(score, 6) as score, message from ({FINDINGS_SQL})")
def architecture_drift(t) -> DataFrame:
    return drift_findings(t).withColumn("score", F.round("score", 6))


@query(
    "drift_score",
    f"select repo, count(*) as findings, round(1 - exp(sum(ln(1 - least(0.95, score)))), 4) as score from ({FINDINGS_SQL}) group by 1",
)
def drift_score(t) -> DataFrame:
    return architecture.drift_score(drift_findings(t))


# -- search ------------------------------------------------------------------------------

NODE_QUERIES = ("find Customer#000000007 services", "ring (blue) bolt.", "order_12 tests", "asia domain, nation_1")


def search_sql(rows: str, names, key: str, order: str, limit: int, per: str = "") -> str:
    values = ", ".join(f"({i}, {quote(q)})" for i, q in enumerate(names))
    return f"""
      with q as (select * from (values {values}) as v(query_id, query)),
      k as (select distinct query_id, unnest({sql_graph_terms('query')}) as term from q),
      s as (select query_id, n.*, sum(case when lower(name) = term then 5 when contains(lower(name), term) then 3
        when contains(lower(coalesce(path, '')), term) then 1 else 0 end) as score from ({rows}) n, k group by all)
      select query_id, {key}, cast(score as bigint) as score, row_number() over (partition by query_id {per} order by score desc, {order}) as position
      from s where score > 0 qualify position <= {limit}
    """


@query("graph_search", search_sql(NODES_SQL, NODE_QUERIES, "id", "kind, name, id", 40))
def graph_search(t) -> DataFrame:
    hits = search.search_nodes(fk_nodes(t), request_table(t, NODE_QUERIES), 40)
    return hits.select("query_id", "id", "score", F.col("position").cast("long").alias("position"))


@query("graph_search_many", search_sql(NODES_SQL, NODE_QUERIES, "id", "kind, name, id", 40))
def graph_search_many(t) -> DataFrame:
    """The same search on the path for very many terms."""
    hits = search.search_nodes(fk_nodes(t), request_table(t, NODE_QUERIES), 40, inline_limit=0)
    return hits.select("query_id", "id", "score", F.col("position").cast("long").alias("position"))


SYMBOL_QUERIES = ("red widget", "... ring", "brand-12 repository bolt")
PART_SQL = """select 'p' || p_partkey as id, 'class' as kind, p_name as name, 'src/' || lower(p_type) || '/repository/' || replace(lower(p_brand), '#', '-') || '.py' as path, cast(p_partkey as integer) as line from part"""


def part_symbols(t) -> DataFrame:
    return t.part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.lit("class").alias("kind"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/repository/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit(".py")).alias("path"),
        F.col("p_partkey").cast("int").alias("line"),
    )


@query("symbol_search", search_sql(PART_SQL, SYMBOL_QUERIES, "id", "line, name, id", 50))
def symbol_search(t) -> DataFrame:
    hits = search.search_symbols(part_symbols(t), request_table(t, SYMBOL_QUERIES), 50)
    return hits.select("query_id", "id", "score", F.col("position").cast("long").alias("position"))


FEDERATED_QUERIES = ("ring widget", "repository gear", "large plate")


@query(
    "federated_search",
    f"""
    with l as (select r.*, brand from ({search_sql("select p_brand as brand, * from (select p.*, p_brand from (" + PART_SQL + ") p join part on 'p' || p_partkey = p.id)", FEDERATED_QUERIES, "brand, id, kind", "kind, name, id", 20, ", brand")}) r),
    s as (select query_id, brand as repo, id, score * (0.5 + cast(regexp_extract(brand, '[0-9]+') as integer) / 10.0) * 1.10 as score from l)
    select query_id, repo, id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, repo, id) as position from s qualify position <= 40
    """,
)
def federated_search(t) -> DataFrame:
    brands = t.part.select("p_partkey", F.col("p_brand").alias("repo"))
    nodes = part_symbols(t).withColumn("p_partkey", F.col("line").cast("long")).join(brands, "p_partkey").drop("p_partkey")
    weights = t.part.select(F.col("p_brand").alias("repo")).distinct().withColumn(
        "weight", 0.5 + F.regexp_extract("repo", "[0-9]+", 0).cast("int") / 10.0
    )
    hits = search.search_federated(nodes, request_table(t, FEDERATED_QUERIES), weights, 40, 20)
    return hits.select(
        "query_id", "repo", "id", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position")
    )


TEXT_QUERIES = ("the and of", "que ouaux src3", "ering thand 17")


@query(
    "full_text",
    """
    with q(query_id, query) as (values (0, 'the and of'), (1, 'que ouaux src3'), (2, 'ering thand 17')),
    k as (select distinct query_id, unnest(list_filter(string_split(lower(query), ' '), lambda w: length(w) > 2)) as term from q),
    f as (select source || '/' || doc_id as path, lower(text) as low from documents),
    s as (select query_id, path, sum((length(low) - length(replace(low, term, ''))) // length(term) + case when contains(path, term) then 3 else 0 end) as score from f, k group by 1, 2)
    select query_id, path, cast(score as bigint) as score, row_number() over (partition by query_id order by score desc, path) as position from s where score > 0 qualify position <= 50
    """,
)
def full_text(t) -> DataFrame:
    files = t.spread("documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")
    )
    hits = search.full_text(files, request_table(t, TEXT_QUERIES), 50)
    return hits.select("query_id", "path", "score", F.col("position").cast("long").alias("position"))


@query(
    "full_text_many",
    """
    with k as (select distinct item_id as query_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 2)) as term from benchmark),
    t as (select distinct term from k),
    f as (select source || '/' || doc_id as path, lower(text) as low from documents),
    m as (select path, term, (length(low) - length(replace(low, term, ''))) // length(term) + case when contains(path, term) then 3 else 0 end as w from f, t where contains(low, term) or contains(path, term)),
    s as (select query_id, path, sum(w) as score from m join k using (term) group by 1, 2)
    select query_id, path, cast(score as bigint) as score, row_number() over (partition by query_id order by score desc, path) as position from s where score > 0 qualify position <= 50
    """,
)
def full_text_many(t) -> DataFrame:
    """Every benchmark text as a query: hundreds of terms at once, by automaton."""
    files = t.spread("documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")
    )
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    terms = F.array_distinct(F.filter(F.split(F.lower("query"), "[^a-z]+"), lambda w: F.length(w) > 2))
    hits = search.full_text(files, queries, 50, terms=terms)
    return hits.select("query_id", "path", "score", F.col("position").cast("long").alias("position"))


@query(
    "graph_context",
    f"""
    with h as (select query_id, id, position from ({search_sql(NODES_SQL, NODE_QUERIES, "id", "kind, name, id", 8)})),
    n as ({NODES_SQL}), e as ({EDGES_SQL}),
    a as (select h.query_id, h.position, h.id, e.kind, e.target as other from h join e on e.source = h.id
      union all select h.query_id, h.position, h.id, 'reverse:' || e.kind, e.source from h join e on e.target = h.id),
    r as (select a.*, row_number() over (partition by query_id order by position, a.kind, other) as line_no from a where other in (select id from n))
    select query_id, line_no, x.name || ' --' || r.kind || '--> ' || y.name as line from r join n x on x.id = r.id join n y on y.id = r.other where line_no <= 20
    """,
)
def graph_context(t) -> DataFrame:
    lines = graph.context_lines(fk_nodes(t), fk_edges(t), request_table(t, NODE_QUERIES))
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "reference_subgraph",
    f"""
    with h as (select id from ({search_sql(NODES_SQL, ("asia nation_1",), "id", "kind, name, id", 3)})), e as ({EDGES_SQL})
    select source, target, kind from e where target in (select id from h)
    """,
)
def reference_subgraph(t) -> DataFrame:
    _, edges = graph.subgraph(fk_nodes(t), fk_edges(t), "asia nation_1", references=True)
    return edges.select("source", "target", "kind")


@query(
    "dependency_subgraph",
    f"""
    with h as (select id from ({search_sql(NODES_SQL, ("asia nation_1",), "id", "kind, name, id", 3)})), e as ({EDGES_SQL}),
    c as (select source, target from e where target in (select id from h) or source in (select id from h))
    select distinct id from (select id from h union all select source from c union all select target from c)
    """,
)
def dependency_subgraph(t) -> DataFrame:
    nodes, _ = graph.subgraph(fk_nodes(t), fk_edges(t), "asia nation_1")
    return nodes.select("id")


@query(
    "neighbourhood",
    f"""
    with e as ({EDGES_SQL}), b as (select source as a, target as b from e union all select target, source from e),
    h0 as (select 'n3' as id), h1 as (select distinct b as id from b join h0 on a = id where b not in (select id from h0)),
    h2 as (select distinct b as id from b join h1 on a = id where b not in (select id from h0) and b not in (select id from h1))
    select id, hop from (select id, 0 as hop from h0 union all select id, 1 from h1 union all select id, 2 from h2) order by hop, id limit 400
    """,
)
def neighbourhood(t) -> DataFrame:
    seeds = fk_nodes(t).filter("id = 'n3'")
    nodes, _ = graph.neighbourhood(fk_nodes(t), fk_edges(t), seeds, 2, "", 400)
    return nodes.select("id", "hop")


@query(
    "shortest_path",
    """
    with r as (select c_custkey as c, 'n' || c_nationkey as n, 'r' || n_regionkey as r from customer join nation on c_nationkey = n_nationkey where c_custkey = 1)
    select 'region' as path, 0 as position, 'c1' as id union all select 'region', 1, n from r union all select 'region', 2, r from r
    union all select 'chain', cast(i as integer), 'k' || i from range(0, 13) x(i) where i <= 12
    """,
)
def shortest_path(t) -> DataFrame:
    """From a customer to its region, along a chain of twelve hops, and to a node out of reach."""
    region = t.customer.filter("c_custkey = 1").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    key = lambda c: F.concat(F.lit("k"), c.cast("string"))
    chain = t.customer.filter("c_custkey <= 20").select(key(F.col("c_custkey") - 1).alias("source"), key(F.col("c_custkey")).alias("target"))
    paths = [
        graph.shortest_path(fk_edges(t), "c1", f"r{region}").withColumn("path", F.lit("region")),
        graph.shortest_path(chain, "k0", "k12").withColumn("path", F.lit("chain")),
        graph.shortest_path(chain, "k0", "c1").withColumn("path", F.lit("none")),
    ]
    return union(paths).select("path", "position", "id")


# -- joins -------------------------------------------------------------------------------


def path_relations(t) -> DataFrame:
    """Orders calling or inheriting from names that many nations define."""
    key = F.col("o_orderkey")
    return t.orders.select(
        F.lit("main").alias("repo"),
        F.concat(F.lit("src/a"), (key % 7).cast("string"), F.lit("/b"), (key % 3).cast("string"), F.lit("/f"), (F.col("o_custkey") % 11).cast("string"), F.lit(".py")).alias("path"),
        F.when(key % 3 == 0, "inherits").when(key % 3 == 1, "imports").otherwise("calls").alias("kind"),
        F.concat(F.lit("name"), (F.col("o_custkey") % 60).cast("string")).alias("target"),
        key.alias("line"),
    )


def path_candidates(t) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select(
        F.lit("main").alias("repo"),
        F.concat(F.lit("s"), F.lpad(key.cast("string"), 6, "0")).alias("id"),
        F.concat(F.lit("name"), (key % 50).cast("string")).alias("name"),
        F.when(key % 4 == 0, "class").when(key % 4 == 1, "function").when(key % 4 == 2, "method").otherwise("type").alias("kind"),
        F.concat(F.lit("src/a"), (F.col("c_nationkey") % 7).cast("string"), F.lit("/b"), (key % 3).cast("string"), F.lit("/f"), (key % 11).cast("string"), F.lit(".py")).alias("path"),
    )


@query(
    "resolve_targets",
    """
    with r as (select distinct 'src/a' || (o_orderkey % 7) || '/b' || (o_orderkey % 3) || '/f' || (o_custkey % 11) || '.py' as path,
        case o_orderkey % 3 when 0 then 'inherits' when 1 then 'imports' else 'calls' end as kind, 'name' || (o_custkey % 60) as target from orders),
    c as (select 's' || lpad(cast(c_custkey as varchar), 6, '0') as id, 'name' || (c_custkey % 50) as name,
        case c_custkey % 4 when 0 then 'class' when 1 then 'function' when 2 then 'method' else 'type' end as kind,
        'src/a' || (c_nationkey % 7) || '/b' || (c_custkey % 3) || '/f' || (c_custkey % 11) || '.py' as path from customer),
    p as (select r.path, r.kind, r.target, c.id, round(0.35 + case when r.path = c.path then 0.35
          when regexp_replace(r.path, '/[^/]*$', '') = regexp_replace(c.path, '/[^/]*$', '') then 0.20
          else least(0.12, 0.03 * len(list_intersect(string_split(r.path, '/')[1:3], string_split(c.path, '/')[1:3]))) end
        + case when r.kind = 'calls' and c.kind in ('function', 'method') or r.kind = 'inherits' and c.kind = 'class' then 0.08 else 0 end, 6) as score
      from r join c on c.name = r.target),
    k as (select *, row_number() over (partition by path, kind, target order by score desc, id) as rn from p),
    d as (select path, kind, target, max(id) filter (rn = 1) as target_id, max(score) filter (rn = 1) as s1, coalesce(max(score) filter (rn = 2), 0.0) as s2, least(5, count(*)) as n from k group by all),
    x as (select *, case when n = 1 then 0.0 else greatest(0.0, least(1.0, 1.0 - greatest(0.0, s1 - s2))) end as amb from d)
    select r.path, r.kind, r.target, coalesce(target_id, case when r.kind = 'imports' then 'module:' else 'reference:' end || r.target) as target_id,
      case when target_id is null then 0.0::double else round(greatest(0.0, least(1.0, s1 * (1.0 - 0.45 * amb)))::decimal(18, 10), 4)::double end as resolution_confidence, case when target_id is null then 1.0::double else round(amb::decimal(18, 10), 4)::double end as ambiguity, cast(coalesce(n, 0) as integer) as candidate_count
    from r left join x using (path, kind, target)
    """,
)
def resolve_targets(t) -> DataFrame:
    relations = path_relations(t).drop("line").distinct()
    found = resolution.resolve_targets(relations, path_candidates(t))
    return found.select("path", "kind", "target", "target_id", "resolution_confidence", "ambiguity", "candidate_count")


@query(
    "relation_sources",
    """
    with n as (select user_id as path, event_type as name, event_id % 997 as line, 'n' || lpad(cast(event_id as varchar), 6, '0') as id from events where event_id % 3 = 0),
    r as (select event_id, user_id as path, event_type as name, event_id % 1009 as line from events where event_id % 3 <> 0),
    j as (select r.event_id, r.path, arg_max(n.id, (n.line, n.id)) as id from r left join n on n.path = r.path and n.name = r.name and n.line <= r.line group by 1, 2)
    select event_id, coalesce(id, 'file:' || path) as source_id from j
    """,
)
def relation_sources(t) -> DataFrame:
    base = t.events.select(
        F.lit("main").alias("repo"),
        F.col("user_id").cast("string").alias("path"),
        F.col("event_type").alias("name"),
        "event_id",
    )
    nodes = base.filter("event_id % 3 = 0").withColumns(
        {"line": (F.col("event_id") % 997).cast("int"), "id": F.concat(F.lit("n"), F.lpad(F.col("event_id").cast("string"), 6, "0"))}
    )
    relations = base.filter("event_id % 3 <> 0").select(
        "repo", "path", F.col("name").alias("source_symbol"), (F.col("event_id") % 1009).cast("int").alias("line"), "event_id"
    )
    return resolution.relation_sources(relations, nodes).select("event_id", "source_id")


ENCLOSING_SQL = """
    with n as (select user_id as path, event_id % 400 as s, event_id % 400 + cast(json_extract(props, '$.k') as integer) * (1 + event_id % 4) as e, 'n' || lpad(cast(event_id as varchar), 6, '0') as id from events where event_id % 2 = 0),
    p as (select event_id, user_id as path, event_id % 613 as line from events where event_id % 2 = 1)
    select p.event_id, arg_max(n.id, (n.s, n.id)) as enclosing_id from p left join n on n.path = p.path and p.line between n.s and n.e group by 1
"""


@query("enclosing_node", ENCLOSING_SQL)
def enclosing_node(t) -> DataFrame:
    base = t.events.select(F.lit("main").alias("repo"), F.col("user_id").cast("string").alias("path"), "event_id", "props")
    start = (F.col("event_id") % 400).cast("int")
    nodes = base.filter("event_id % 2 = 0").select(
        "repo",
        "path",
        start.alias("line"),
        (start + k_value().cast("int") * (1 + F.col("event_id") % 4)).cast("int").alias("end_line"),
        F.concat(F.lit("n"), F.lpad(F.col("event_id").cast("string"), 6, "0")).alias("id"),
    )
    points = base.filter("event_id % 2 = 1").select("repo", "path", (F.col("event_id") % 613).cast("int").alias("line"), "event_id")
    return resolution.enclosing_nodes(points, nodes).select("event_id", "enclosing_id")


@query(
    "changed_symbols",
    """
    with u as (select event_id, user_id as path, event_id % 500 as s, event_id % 500 + cast(json_extract(props, '$.k') as integer) // 10 as e from events where event_type <> 'error'),
    f as (select distinct user_id as path from events where user_id % 3 <> 0),
    h as (select user_id as path, event_id % 700 as s, event_id % 700 + event_id % 4 as e from events where event_type = 'error' and user_id % 5 <> 0)
    select event_id from u where path in (select path from f) and (path not in (select path from h) or exists (select 1 from h where h.path = u.path and h.s <= u.e and u.s <= h.e))
    """,
)
def changed_symbols(t) -> DataFrame:
    path = F.col("user_id").cast("string").alias("path")
    start = (F.col("event_id") % 500).cast("int")
    symbols = t.events.filter("event_type <> 'error'").select(
        "event_id", path, start.alias("line"), (start + F.floor(k_value().cast("int") / 10)).cast("int").alias("end")
    )
    files = t.events.filter("user_id % 3 <> 0").select(path)
    at = (F.col("event_id") % 700).cast("int")
    hunks = t.events.filter("event_type = 'error' and user_id % 5 <> 0").select(
        path, at.alias("start"), (at + F.col("event_id") % 4).cast("int").alias("end")
    )
    return history.changed_symbols(symbols, files, hunks, ["path"]).select("event_id")


# -- federation --------------------------------------------------------------------------


def market_nodes(t) -> DataFrame:
    """Customers and suppliers as symbols of one repository per nation, names shared by value."""
    customers = t.customer.select(
        F.col("c_nationkey").cast("string").alias("repo"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.when(F.col("c_custkey") % 5 == 0, "file").otherwise("class").alias("kind"),
        F.concat(F.col("c_mktsegment"), (F.col("c_custkey") % 40).cast("string")).alias("name"),
    )
    suppliers = t.supplier.select(
        F.col("s_nationkey").cast("string").alias("repo"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.lit("class").alias("kind"),
        F.concat(F.lit("building"), (F.col("s_suppkey") % 40).cast("string")).alias("name"),
    )
    return federation.namespaced(customers.unionByName(suppliers))


MARKET_SQL = """
  select 'repo:' || c_nationkey || ':c' || c_custkey as id, cast(c_nationkey as varchar) as repo, case when c_custkey % 5 = 0 then 'file' else 'class' end as kind, c_mktsegment || (c_custkey % 40) as name from customer
  union all select 'repo:' || s_nationkey || ':s' || s_suppkey, cast(s_nationkey as varchar), 'class', 'building' || (s_suppkey % 40) from supplier
"""


@query(
    "cross_repo_symbols",
    f"""
    with m as (select *, lower(name) as k from ({MARKET_SQL}) where kind = 'class')
    select a.id, count(b.id) as partners from m a join m b on a.kind = b.kind and a.k = b.k and a.repo <> b.repo group by 1
    """,
)
def cross_repo_symbols(t) -> DataFrame:
    """Number of cross-repository partners per symbol, from counts instead of pairs."""
    return federation.symbol_groups(market_nodes(t)).select("id", "partners")


@query(
    "cross_repo_symbol_links",
    f"""
    with m as (select *, lower(name) as k from ({MARKET_SQL}) where kind = 'class')
    select distinct a.id as source, 'hub:symbol:class:' || a.k as target, 'cross_repo_symbol' as kind from m a join m b on a.k = b.k and a.repo <> b.repo
    """,
)
def cross_repo_symbol_links(t) -> DataFrame:
    return federation.symbol_links(federation.symbol_groups(market_nodes(t))).select("source", "target", "kind")


@query(
    "cross_repo_symbol_pairs",
    f"""
    with m as (select *, lower(name) as k from ({MARKET_SQL}) where kind = 'class')
    select a.id as source, b.id as target from m a join m b on a.k = b.k and a.repo <> b.repo where a.id like '%:s%'
    """,
)
def cross_repo_symbol_pairs(t) -> DataFrame:
    """The pairs behind the hubs, for the suppliers."""
    groups = federation.symbol_groups(market_nodes(t))
    return federation.symbol_partners(groups, groups.filter(F.col("id").contains(":s")))


def page_graph(t) -> DataFrame:
    """Pages as files of repositories, with unresolved names that spell other pages."""
    host = host_path()
    files = t.pages.select(
        F.regexp_extract("url", r"/(en|de|fr|es)/", 1).alias("repo"),
        F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("id"),
        F.lit("file").alias("kind"),
        F.lit("p").alias("name"),
        host.alias("path"),
    )
    wanted = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(host, r"\.html$", "")).when(
        F.col("page_id") % 3 == 1, F.regexp_extract(host, r"/(.*?)(?:\.html|/)?$", 1)
    ).otherwise("nothing.here")
    refs = t.pages.select(
        F.get(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]), (F.col("page_id") % 4).cast("int")).alias("repo"),
        F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("id"),
        F.lit("module").alias("kind"),
        wanted.alias("name"),
        F.lit(None).cast("string").alias("path"),
    )
    return federation.namespaced(files.unionByName(refs))


PAGE_GRAPH_SQL = f"""
  f as (select regexp_extract(url, '/(en|de|fr|es)/', 1) as repo, 'f' || page_id as id, unnest({sql_aliases(HOST_PATH_SQL)}) as alias from pages),
  m as (select ['en','de','fr','es'][page_id % 4 + 1] as repo, 'm' || page_id as id, case page_id % 3 when 0 then regexp_replace({HOST_PATH_SQL}, '\\.html$', '')
     when 1 then regexp_extract({HOST_PATH_SQL}, '/(.*?)(?:\\.html|/)?$', 1) else 'nothing.here' end as name from pages),
  a as (select *, {sql_normalize('name')} as k from m),
  ex as (select a.*, f.repo as frepo, f.id as fid from a join f on f.alias = a.k),
  lo as (select distinct a.*, f.repo as frepo, f.id as fid from a join f on ends_with(f.alias, '/' || a.k) or ends_with(f.alias, '.' || a.k) where a.k not in (select alias from f))
"""


LINKED_PAIRS_SQL = f"""
    with {PAGE_GRAPH_SQL},
    p as (select repo, id, k, frepo, fid, name, 0.92 as confidence from ex where repo <> frepo
      union all select repo, id, k, frepo, fid, name, 0.76 from lo where repo <> frepo)
"""


@query(
    "cross_repo_dependencies",
    f"""
    {LINKED_PAIRS_SQL}
    select distinct 'repo:' || repo || ':' || id as source, 'hub:path:' || confidence || ':' || k as target, confidence, name as dependency from p
    union all select distinct 'hub:path:' || confidence || ':' || k, 'repo:' || frepo || ':' || fid, confidence, k from p
    """,
)
def cross_repo_dependencies(t) -> DataFrame:
    links = federation.dependency_links(page_graph(t))
    return links.select("source", "target", "confidence", "dependency").distinct()


@query(
    "federated_graph",
    f"""
    {LINKED_PAIRS_SQL},
    e as (select distinct 'repo:' || repo || ':' || id as s, confidence || ':' || k as t from p union select distinct confidence || ':' || k, 'repo:' || frepo || ':' || fid from p),
    n as (select count(*) * 2 + (select count(distinct confidence || ':' || k) from p) as nodes from pages)
    select 'contains' as kind, count(*) as edges, (select nodes from n) as nodes from pages union all select 'cross_repo_dependency', count(*), (select nodes from n) from e
    """,
)
def federated_graph(t) -> DataFrame:
    """Page files with one containment edge each, federated over the languages."""
    rows = page_graph(t).withColumn("id", F.regexp_replace("id", "^repo:[^:]*:", ""))
    own = rows.filter("kind = 'file'").select(
        "repo", F.concat(F.lit("d"), "id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind")
    )
    nodes, edges = federation.federate(rows, own)
    return edges.groupBy("kind").agg(F.count("*").alias("edges")).withColumn("nodes", nodes.agg(F.count("*")).scalar())


def shop_graph(t) -> tuple[DataFrame, DataFrame]:
    """Customers as classes of one repository per nation, calling the next; names in groups of a
    third of the table, of some forty, and of few."""
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    name = (
        F.when(key % 3 == 0, "common")
        .when(key % 3 == 1, F.concat(F.lit("Mid"), text(key % 13)))
        .otherwise(F.concat(F.lit("rare"), text(F.floor(key / 6))))
    )
    rows = t.customer.select(
        text(F.col("c_nationkey")).alias("repo"), text(key).alias("id"), F.lit("class").alias("kind"), name.alias("name"),
        F.concat(F.lit("src/"), text(key), F.lit(".py")).alias("path"),
    )
    calls = t.customer.select(
        text(F.col("c_nationkey")).alias("repo"), text(key).alias("source"), text(key + 1).alias("target"), F.lit("calls").alias("kind")
    )
    nodes, edges = federation.federate(rows, calls)
    return durable(nodes), durable(edges)


SHOP_SQL = f"""
  n as (select 'repo:' || c_nationkey || ':' || c_custkey as id, c_nationkey as repo, c_custkey as key,
    case c_custkey % 3 when 0 then 'common' when 1 then 'mid' || (c_custkey % 13) else 'rare' || (c_custkey // 6) end as name from customer),
  c as (select a.id as source, 'repo:' || a.repo || ':' || (a.key + 1) as target, 'calls' as kind from n a),
  p as (select a.id as source, b.id as target, 'cross_repo_symbol' as kind from n a join n b on a.name = b.name and a.repo <> b.repo),
  w as (select source, target, kind, {sql_case(EDGE_WEIGHTS, 'kind', 0.5)} * {sql_case(RESOLUTION_MULTIPLIERS, "'inferred'", 0.85)} as weight from (select * from c union all select * from p))
"""
SHOP_SEEDS = ("2", "4", "9")


@query(
    "federated_impact",
    f"""
    with {SHOP_SQL},
    t as (select id from n where key in ({", ".join(SHOP_SEEDS)})),
    l1 as (select t.id as target, w.source as node, max(weight) as strength from t join w on w.target = t.id where w.source <> t.id and w.source in (select id from n) group by 1, 2),
    l2 as (select l1.target, w.source as node, max(strength * weight) as strength from l1 join w on w.target = l1.node where w.source <> l1.target and w.source in (select id from n) group by 1, 2),
    r as (select target, node, 1 as depth, strength as risk from l1 union all select target, node, 2, strength / 1.7 from l2)
    select target, node, min(depth) as depth, round(least(1.0, max(risk)), 6) as risk from (
      select *, row_number() over (partition by target, node order by risk desc, depth) as rn from r) where rn = 1 group by 1, 2
    """,
)
def federated_impact(t) -> DataFrame:
    """What two hops of impact reach through groups of every size."""
    nodes, edges = shop_graph(t)
    seeds = nodes.filter(F.regexp_extract("id", r"([^:]*)$", 1).isin(*SHOP_SEEDS) & (F.col("kind") != "hub"))
    return graph.impact(nodes, edges, seeds, 2).select("target", "node", "depth", F.round("risk", 6).alias("risk"))


@query(
    "federated_neighbourhood",
    f"""
    with {SHOP_SQL},
    b as (select source as a, target as z from w union all select target, source from w),
    h0 as (select id from n where key in ({", ".join(SHOP_SEEDS[:2])})),
    h1 as (select distinct z as id from b join h0 on a = id where z in (select id from n) and z not in (select id from h0)),
    h2 as (select distinct z as id from b join h1 on a = id where z in (select id from n) and z not in (select id from h0) and z not in (select id from h1))
    select id, 0 as hop from h0 union all select id, 1 from h1 union all select id, 2 from h2
    """,
)
def federated_neighbourhood(t) -> DataFrame:
    nodes, edges = shop_graph(t)
    seeds = nodes.filter(F.regexp_extract("id", r"([^:]*)$", 1).isin(*SHOP_SEEDS[:2]) & (F.col("kind") != "hub"))
    found, _ = graph.neighbourhood(nodes, edges, seeds, 2, "", 1 << 28)
    return found.select("id", "hop")


PAGE_SEEDS = (3, 4, 6)


@query(
    "federated_path_neighbourhood",
    f"""
    {LINKED_PAIRS_SQL},
    l as (select distinct 'repo:' || repo || ':' || id as ask, 'hub:path:' || confidence || ':' || k as hub, 'repo:' || frepo || ':' || fid as offer from p),
    b as (select ask as a, offer as z from l union select offer, ask from l),
    h0 as (select 'repo:' || repo || ':' || id as id from m where id in ({", ".join(f"'m{i}'" for i in PAGE_SEEDS)})),
    h1 as (select distinct z as id from b join h0 on a = id where z not in (select id from h0)),
    h2 as (select distinct z as id from b join h1 on a = id where z not in (select id from h0) and z not in (select id from h1)),
    h as (select id, 0 as hop from h0 union all select id, 1 from h1 union all select id, 2 from h2),
    i as (select l.* from l where ask in (select id from h) and offer in (select id from h))
    select id as source, null as target, hop from h
    union all select * from (select distinct ask, hub, null::int from i union select distinct hub, offer, null::int from i)
    """,
)
def federated_path_neighbourhood(t) -> DataFrame:
    """Nodes within two hops of modules through the hubs of aliases, and the links between them."""
    rows = page_graph(t).withColumn("id", F.regexp_replace("id", "^repo:[^:]*:", ""))
    own = rows.limit(0).select("repo", F.col("id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"))
    nodes, edges = (durable(x) for x in federation.federate(rows, own))
    seeds = nodes.filter(F.regexp_extract("id", r"([^:]*)$", 1).isin(*[f"m{i}" for i in PAGE_SEEDS]) & (F.col("kind") == "module"))
    found, inside = graph.neighbourhood(nodes, edges, seeds, 2, "", nodes.count() + edges.count())
    blank = F.lit(None)
    return found.select(F.col("id").alias("source"), blank.cast("string").alias("target"), "hop").unionByName(
        inside.select("source", "target", blank.cast("int").alias("hop"))
    )


# -- history -----------------------------------------------------------------------------


def line_commits(t) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("sha"), F.concat(F.lit("f"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("path")
    )


COMMITS_SQL = "select distinct cast(l_orderkey as varchar) as sha, 'f' || lpad(cast(l_suppkey as varchar), 5, '0') as path from lineitem"
PAIRS_SQL = f"select a.path as left, b.path as right, count(*) as commits from ({COMMITS_SQL}) a join ({COMMITS_SQL}) b on a.sha = b.sha and a.path < b.path group by 1, 2 order by 3 desc, 1, 2 limit 30"


@query("hot_files", f"select path, count(*) as changes from ({COMMITS_SQL}) group by 1 order by 2 desc, 1 limit 30")
def hot_files(t) -> DataFrame:
    return history.hot_files(line_commits(t))


@query(
    "author_activity",
    "select 'dev' || (o_custkey % 50) as author, 'm' || (o_custkey % 50) as email, count(*) as commits from orders group by 1, 2 order by 3 desc, 1, 2 limit 20",
)
def author_activity(t) -> DataFrame:
    who = (F.col("o_custkey") % 50).cast("string")
    rows = t.orders.select(
        F.col("o_orderkey").alias("sha"), F.concat(F.lit("dev"), who).alias("author"), F.concat(F.lit("m"), who).alias("email")
    )
    return history.author_activity(rows)


@query("co_change", PAIRS_SQL)
def co_change(t) -> DataFrame:
    return history.co_change(line_commits(t))


@query("co_change_wide", PAIRS_SQL)
def co_change_wide(t) -> DataFrame:
    """The same pairs with commits of more than five files counted by file groups."""
    return history.co_change(line_commits(t), wide=5)


BLAME_SQL = "select 'f' || l_suppkey as path, cast(l_orderkey % 1000 as integer) as line, cast(l_orderkey as varchar) as sha, 'dev' || (l_partkey % 30) as author, 'm' || (l_partkey % 30) as email from lineitem"


def blame_rows(t) -> DataFrame:
    who = (F.col("l_partkey") % 30).cast("string")
    return t.lineitem.select(
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("path"),
        (F.col("l_orderkey") % 1000).cast("int").alias("line"),
        F.col("l_orderkey").cast("string").alias("sha"),
        F.concat(F.lit("dev"), who).alias("author"),
        F.concat(F.lit("m"), who).alias("email"),
    )


@query("line_ownership", f"select path, author, email, count(*) as lines from ({BLAME_SQL}) group by 1, 2, 3")
def line_ownership(t) -> DataFrame:
    return history.line_ownership(blame_rows(t), ["path"])


@query(
    "symbol_history",
    f"""
    with b as (select * from ({BLAME_SQL}) where path = 'f3' and line between 100 and 300)
    select 'owner' as section, author as key, count(*) as n from b group by 2 union all select 'commits', '', count(distinct sha) from b union all select 'lines', '', count(*) from b
    """,
)
def symbol_history(t) -> DataFrame:
    commits = t.orders.select(
        F.col("o_orderkey").cast("string").alias("sha"),
        F.lit("a").alias("author"),
        F.lit("e").alias("email"),
        F.col("o_orderdate").cast("string").alias("date"),
        F.lit("s").alias("subject"),
    )
    unique, lines, owners = history.symbol_history(blame_rows(t), commits, "f3", 100, 300)
    return union(
        [
            owners.select(F.lit("owner").alias("section"), F.col("author").alias("key"), F.col("lines").alias("n")),
            unique.agg(F.count("*").alias("n")).select(F.lit("commits").alias("section"), F.lit("").alias("key"), "n"),
            lines.agg(F.count("*").alias("n")).select(F.lit("lines").alias("section"), F.lit("").alias("key"), "n"),
        ]
    )


@query(
    "pr_risk",
    """
    with f as (select o_custkey as pr, count(*) as files, cast(sum(l_quantity) as bigint) as churn from orders join lineitem on l_orderkey = o_orderkey group by 1),
    s as (select o_custkey as pr, max(l_discount * 8) as mi, count(*) as symbols from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' group by 1),
    x as (select pr, files, churn, coalesce(symbols, 0) as symbols, least(1.0, coalesce(mi, 0) * 0.55 + least(1.0, files / 20) * 0.25 + least(1.0, churn / 600) * 0.20) as s from f left join s using (pr))
    select pr, files, churn, symbols, round(s, 4) as risk_score, case when s >= 0.7 then 'high' when s >= 0.4 then 'medium' else 'low' end as risk_level from x
    """,
)
def pr_risk(t) -> DataFrame:
    joined = t.lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_returnflag").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pr")), "l_orderkey"
    )
    files = joined.select("pr", F.col("l_quantity").cast("long").alias("additions"), F.lit(0).alias("deletions"))
    symbols = joined.filter("l_returnflag = 'R'").select("pr", (F.col("l_discount") * 8).alias("impact_risk"))
    return history.pr_risk(files, symbols, ["pr"])


# -- access ------------------------------------------------------------------------------


def access_inputs(t):
    members = t.customer.select(
        (F.col("c_nationkey") % 5).cast("string").alias("organization"),
        F.col("c_custkey").cast("string").alias("principal"),
        F.get(F.array(*[F.lit(r) for r in ("viewer", "member", "admin", "owner")]), (F.col("c_custkey") % 4).cast("int")).alias("role"),
    )
    policies = t.nation.select(
        (F.col("n_nationkey") % 5).cast("string").alias("organization"),
        F.concat(F.lit("w"), F.floor(F.col("n_nationkey") / 5).cast("string")).alias("workspace"),
        F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("*"))).otherwise(F.array(F.lit("click"), F.lit("view"))).alias("allowed_tools"),
        (F.col("n_nationkey") % 2 == 0).alias("remote_access"),
    )
    requests = t.events.select(
        "event_id",
        (F.col("event_id") % 5).cast("string").alias("organization"),
        F.concat(F.lit("w"), (F.col("event_id") % 6).cast("string")).alias("workspace"),
        F.col("user_id").cast("string").alias("principal"),
        F.col("event_type").alias("tool"),
        (F.col("event_id") % 4 == 0).alias("remote"),
    )
    return requests, members, policies


ACCESS_SQL = """
    with m as (select cast(c_nationkey % 5 as varchar) as organization, cast(c_custkey as varchar) as principal from customer),
    p as (select cast(n_nationkey % 5 as varchar) as organization, 'w' || (n_nationkey // 5) as workspace, n_nationkey % 3 = 0 as anyt, n_nationkey % 2 = 0 as remote_access from nation),
    r as (select event_id, cast(event_id % 5 as varchar) as organization, 'w' || (event_id % 6) as workspace, cast(user_id as varchar) as principal, event_type as tool, event_id % 4 = 0 as remote from events)
    select event_id, m.principal is not null and p.workspace is not null and (not remote or coalesce(remote_access, false)) and (coalesce(anyt, false) or tool in ('click', 'view')) as allowed
    from r left join m using (organization, principal) left join p using (organization, workspace)
"""


@query("policy_decision", ACCESS_SQL)
def policy_decision(t) -> DataFrame:
    return access.decide(*access_inputs(t)).select("event_id", "allowed")


@query("policy_audit", f"select case when allowed then 'allowed' else 'denied' end as outcome, count(*) as records from ({ACCESS_SQL}) group by 1")
def policy_audit(t) -> DataFrame:
    return access.audit_rows(access.decide(*access_inputs(t))).groupBy("outcome").agg(F.count("*").alias("records"))


@query(
    "role_check",
    "select c_custkey, c_custkey % 4 >= 2 as is_admin, c_custkey % 4 >= 1 as is_member from customer",
)
def role_check(t) -> DataFrame:
    role = F.get(F.array(*[F.lit(r) for r in ("viewer", "member", "admin", "owner")]), (F.col("c_custkey") % 4).cast("int"))
    return t.customer.select(
        "c_custkey", access.role_at_least(role, "admin").alias("is_admin"), access.role_at_least(role, "member").alias("is_member")
    )


# -- quality -----------------------------------------------------------------------------

QUALITY_SQL = """
    with h as (select vec_id // 10 as case_id, vec_id % 10 + 1 as rank, label as id from embeddings),
    e as (select distinct vec_id // 10 as case_id, label as id from embeddings where vec_id % 10 in (3, 7) and vec_id // 10 % 6 <> 0 union select distinct vec_id // 10, 99 from embeddings where vec_id // 10 % 6 <> 0),
    c as (select distinct vec_id // 10 as case_id from embeddings),
    m as (select h.*, e.id is not null as good from h left join e using (case_id, id)),
    s as (select case_id, count(*) as n, count(*) filter (good) as g, count(distinct id) filter (good) as d, min(rank) filter (good) as f from m group by 1),
    x as (select case_id, count(*) as ex from e group by 1)
    select case_id, case when ex is null then 1.0 else d / ex end as recall, g / n as precision, coalesce(1.0 / f, 0.0) as reciprocal_rank from c left join s using (case_id) left join x using (case_id)
"""


def quality_rows(t) -> DataFrame:
    case = F.floor(F.col("vec_id") / 10).alias("case_id")
    hits = t.embeddings.select(case, (F.col("vec_id") % 10 + 1).alias("rank"), F.col("label").alias("id"))
    real = t.embeddings.filter("vec_id % 10 in (3, 7) and floor(vec_id / 10) % 6 <> 0").select(case, F.col("label").alias("id"))
    missing = t.embeddings.filter("floor(vec_id / 10) % 6 <> 0").select(case, F.lit(99).alias("id"))
    return quality.retrieval_quality(hits, real.unionByName(missing), t.embeddings.select(case).distinct())


@query("retrieval_quality", f"select case_id, round(recall, 6) as recall, round(precision, 6) as precision, round(reciprocal_rank, 6) as reciprocal_rank from ({QUALITY_SQL})")
def retrieval_quality(t) -> DataFrame:
    out = quality_rows(t)
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")])


@query("quality_summary", f"select cast(count(*) as double) as cases, round(avg(recall), 6) as avg_recall, round(avg(precision), 6) as avg_precision, round(avg(reciprocal_rank), 6) as mrr from ({QUALITY_SQL})")
def quality_summary(t) -> DataFrame:
    out = quality.quality_summary(quality_rows(t))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "lenient_recall",
    """
    with c as (select item_id as case_id, list_filter(string_split(text, ' '), lambda w: w <> '') as exp from benchmark),
    e as (select case_id, generate_subscripts(exp, 1) as pos, lower(unnest(exp)) as w from c),
    a as (select doc_id % (select count(*) from benchmark) as case_id, lower(text) as v from documents),
    h as (select e.case_id, e.pos, coalesce(bool_or(contains(v, w)), false) as hit from e left join a using (case_id) group by 1, 2)
    select case_id, round(avg(hit::int), 6) as recall, avg(hit::int) > 0 as success from h group by 1
    """,
)
def lenient_recall(t) -> DataFrame:
    cases = t.benchmark.select(
        F.col("item_id").alias("case_id"), F.filter(F.split("text", " "), lambda w: w != "").alias("expected")
    )
    total = t.benchmark.agg(F.count("*")).scalar()
    actual = t.documents.select((F.col("doc_id") % total).alias("case_id"), F.col("text").alias("value"))
    recall = quality.lenient_recall(cases, actual, "expected").join(cases, "case_id")
    none = F.array().cast("array<string>")
    ok = quality.case_success(F.col("expected"), none, F.col("recall"), F.lit(1.0))
    return recall.select("case_id", F.round("recall", 6).alias("recall"), ok.alias("success"))


@query(
    "target_precision",
    """
    select case when doc_id % 2 = 0 then 'a' else 'b' end as strategy, cast(sum(quality) as bigint) as correct_targets, cast(sum(toxic) as bigint) as false_targets,
      case when sum(quality) + sum(toxic) = 0 then 0.0 else round(sum(quality) / (sum(quality) + sum(toxic)), 4) end as precision from labels group by 1
    """,
)
def target_precision(t) -> DataFrame:
    rows = t.labels.select(
        F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("strategy"),
        F.col("quality").alias("correct_targets"),
        F.col("toxic").alias("false_targets"),
    )
    return quality.target_precision(rows)


@query(
    "scale_sample",
    "select target, files, files >= target as reached from (values (100000), (1000000)) as v(target), (select count(*) as files from lineitem)",
)
def scale_sample(t) -> DataFrame:
    return quality.scale_sample(t.lineitem)


GATE_SQL = f"""
    with e as (select event_type as strategy, event_id % 2 as half, value, {K_SQL} as k, event_id from events),
    m as (select strategy, half, round(avg(case when event_id % 4 <> 0 then 1.0 else 0 end), 4) as success_rate, round(avg(value), 4) as avg_duration_ms, round(avg(k), 4) as avg_context_tokens, round(avg(k % 7), 4) as avg_files_read from e group by 1, 2),
    u as (unpivot m on success_rate, avg_duration_ms, avg_context_tokens, avg_files_read into name metric value value),
    p(metric, direction, mr, ma) as (values ('success_rate', 'higher', null, 0.02), ('avg_duration_ms', 'lower', 0.20, null), ('avg_context_tokens', 'lower', 0.10, null), ('avg_files_read', 'lower', 0.15, null)),
    j as (select c.strategy, metric, b.value as baseline, c.value as current, c.value - b.value as ch, case when direction = 'higher' then b.value - c.value else c.value - b.value end as reg, mr, ma
      from u c join u b using (strategy, metric) join p using (metric) where c.half = 1 and b.half = 0)
    select strategy, metric, baseline, current, reg > 0 and (coalesce(reg > ma, false) or coalesce(reg / abs(baseline) > mr, false)) as violated from j
"""


def gate_rows(t) -> DataFrame:
    k = k_value().cast("int")
    rows = t.events.withColumn("half", F.col("event_id") % 2).groupBy(F.col("event_type").alias("strategy"), "half").agg(
        F.round(F.avg(F.when(F.col("event_id") % 4 != 0, 1.0).otherwise(0.0)), 4).alias("success_rate"),
        F.round(F.avg("value"), 4).alias("avg_duration_ms"),
        F.round(F.avg(k), 4).alias("avg_context_tokens"),
        F.round(F.avg(k % 7), 4).alias("avg_files_read"),
    )
    names = ["success_rate", "avg_duration_ms", "avg_context_tokens", "avg_files_read"]
    long = rows.unpivot(["strategy", "half"], names, "metric", "value")
    return quality.regression_gate(long.filter("half = 1"), long.filter("half = 0"))


@query("regression_gate", GATE_SQL)
def regression_gate(t) -> DataFrame:
    return gate_rows(t).select("strategy", "metric", "baseline", "current", (F.col("reason") != "").alias("violated"))


@query(
    "gate_report",
    f"select count(*) filter (violated) = 0 as passed, count(*) as compared_metrics, count(*) filter (violated) as violations from ({GATE_SQL})",
)
def gate_report(t) -> DataFrame:
    return quality.gate_report(gate_rows(t))


@query(
    "repository_rollup",
    f"""
    select 'nodes:' || kind as key, count(*) as value from ({NODES_SQL}) group by 1 union all select 'edges', count(*) from ({EDGES_SQL})
    union all select 'commits', count(*) from orders union all select 'documents', count(*) from documents union all select 'events', count(*) from events
    union all select 'last_event', max(epoch_us(ts)) from events
    """,
)
def repository_rollup(t) -> DataFrame:
    def total(df, name):
        return df.agg(F.count("*").alias("value")).select(F.lit(name).alias("key"), "value")

    kinds = graph.counts_by_kind(fk_nodes(t)).select(F.concat(F.lit("nodes:"), "kind").alias("key"), F.col("nodes").alias("value"))
    last = t.events.agg(F.max(micros()).alias("value")).select(F.lit("last_event").alias("key"), "value")
    return union([kinds, total(fk_edges(t), "edges"), total(t.orders, "commits"), total(t.documents, "documents"), total(t.events, "events"), last])


@query(
    "symbol_index_search",
    """
    with s as (select p_partkey, case when p_partkey % 6 = 0 then 'local ' || p_name else 'x pip pkg . ' || replace(p_name, ' ', '_') || '#run().' end as symbol,
      case when p_partkey % 6 = 0 then p_name else replace(p_name, ' ', '_') || '.run' end as q, p_brand as document from part),
    k as (select case when p_partkey % 6 = 0 then document else '' end as owner, symbol, min(document) as document, any_value(q) as qualified from s where contains(lower(q), 'ring') group by 1, 2)
    select document, symbol, qualified from k order by document, symbol limit 25
    """,
)
def symbol_index_search(t) -> DataFrame:
    from loomgraph.operators.precise import search_symbols

    symbol = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("local "), "p_name")).otherwise(
        F.concat(F.lit("x pip pkg . "), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("#run()."))
    )
    rows = t.part.select(F.lit("main").alias("repo"), F.col("p_brand").alias("path"), symbol.alias("symbol"))
    return search_symbols(rows, " Ring ", 25).select(F.col("path").alias("document"), "symbol", "qualified")
