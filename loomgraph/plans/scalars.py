"""Scalar functions over whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import clocks, grading, positions, routing, scoring, text
from loomgraph.functions.identity import container, display_name, parse_symbol, qualified_name
from loomgraph.plans.registry import query
from loomgraph.plans.sqltext import (
    SQL_BLANK,
    quote,
    sql_any,
    sql_case,
    sql_context_terms,
    sql_graph_terms,
    sql_hybrid_terms,
)

SITE_PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1)"
HOST_PATH_SQL = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


def site_path(url="url"):
    return F.regexp_extract(url, r"^[a-z]+://[^/]*/([^?#]*)", 1)


def host_path(url="url"):
    return F.regexp_extract(url, r"^[a-z]+://([^?#]*)", 1)


@query(
    "token_count",
    f"""
    select doc_id, cast(ceil(length(text) / 4.0) as integer) as tokens,
      md5(regexp_replace(text[1:256], '{SQL_BLANK}$', '')) as head
    from documents
    """,
)
def token_count(t) -> DataFrame:
    return t.documents.select(
        "doc_id",
        text.token_count(F.col("text")).alias("tokens"),
        F.md5(text.truncate_tokens(F.col("text"), 64).cast("binary")).alias("head"),
    )


def _terms_sql(fragment: str) -> str:
    return f"""
    select conv_id, turn, len({fragment}) as n_terms,
      array_to_string(list_sort({fragment}), ' ') as terms
    from conversations
    """


def _terms(t, fn) -> DataFrame:
    terms = fn(F.col("text"))
    return t.conversations.select(
        "conv_id",
        "turn",
        F.size(terms).cast("long").alias("n_terms"),
        F.array_join(F.array_sort(terms), " ").alias("terms"),
    )


@query("query_terms_graph", _terms_sql(sql_graph_terms("text")))
def query_terms_graph(t) -> DataFrame:
    return _terms(t, text.graph_terms)


@query("query_terms_context", _terms_sql(sql_context_terms("text")))
def query_terms_context(t) -> DataFrame:
    return _terms(t, text.context_terms)


@query("query_terms_hybrid", _terms_sql(sql_hybrid_terms("text")))
def query_terms_hybrid(t) -> DataFrame:
    return _terms(t, text.hybrid_terms)


def _kind_sql(low: str) -> str:
    ranked = []
    for order, (kind, terms) in enumerate(routing.KIND_TERMS.items()):
        hits = " + ".join(f"cast(contains({low}, {quote(w)}) as integer)" for w in terms)
        ranked.append(f"({hits}) * 100 - {order}")
    best = f"greatest({', '.join(ranked)})"
    arms = " ".join(
        f"when {best} = {expr} then {quote(kind)}"
        for expr, kind in zip(ranked, routing.KIND_TERMS, strict=True)
    )
    return f"(case when {best} <= 0 then 'explain' {arms} end)"


CLASSIFIED = f"select conv_id, turn, role, text, lower(text) as low, {_kind_sql('lower(text)')} as kind from conversations"


@query("classify_request", f"select conv_id, turn, kind from ({CLASSIFIED})")
def classify_request(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", routing.classify(F.col("text")).alias("kind"))


def _score_arms(name: str) -> str:
    base, boost, kinds = routing.CAPABILITIES[name]
    parts = [str(base)]
    if kinds:
        parts.append(f"case when kind in ({', '.join(map(quote, kinds))}) then {boost} else 0 end")
    if name == "memory":
        parts.append(f"case when {sql_any('low', routing.MEMORY_TERMS)} then 0.65 else 0 end")
    if name == "context":
        parts.append(f"case when {sql_any('low', routing.CONTEXT_TERMS)} then 0.35 else 0 end")
    return " + ".join(parts)


FEEDBACK_SQL = """
    select capability,
      case when n < 3 then 0.0 else greatest(-0.15, least(0.15,
        (rate - 0.5) * 0.24 - least(0.08, latency / 60000.0 * 0.08))) end as adjustment
    from (
      select event_type as capability, count(*) as n,
        avg(case when event_type <> 'error' and event_id % 3 <> 0 then 1.0 else 0.0 end) as rate,
        avg(greatest(0.0, value)) as latency
      from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events)
      where rn <= 200 group by event_type)
"""


@query(
    "route_scores",
    f"""
    with q as ({CLASSIFIED}),
    s as ({" union all ".join(f"select conv_id, turn, kind, '{n}' as capability, {_score_arms(n)} as base from q" for n in routing.CAPABILITIES)}),
    f as ({FEEDBACK_SQL}),
    m(capability, feed) as (values ('repository','view'),('symbols','click'),('context','signup'),('memory','purchase'),('validation','error')),
    r as (select s.*, round(greatest(0.0, least(1.0, base + coalesce(f.adjustment, 0.0))), 6) as score
      from s join m using (capability) left join f on f.capability = m.feed),
    x as (select *, max(case when score >= 0.5 then 1 else 0 end) over (partition by conv_id, turn) as any_sel from r)
    select conv_id, turn, kind, capability, score,
      case when any_sel = 1 then score >= 0.5 else capability = 'repository' end as selected
    from x
    """,
)
def route_scores(t) -> DataFrame:
    from loomgraph.operators.routes import route
    from loomgraph.plans.events import feedback_rows

    capability = {
        "view": "repository",
        "click": "symbols",
        "signup": "context",
        "purchase": "memory",
        "error": "validation",
    }
    from loomgraph.operators.ops import feedback_adjustment

    adjust = feedback_adjustment(feedback_rows(t)).withColumn(
        "capability", scoring.lookup(capability, F.col("capability"))
    )
    routed = route(t.conversations.withColumn("query", F.col("text")), ["conv_id", "turn"], adjust)
    return routed.select(
        "conv_id", "turn", "kind", "capability", F.round("score", 6).alias("score"), "selected"
    )


def _plan_sql() -> str:
    p = f"""case when {sql_any('low', routing.PRECISION_TERMS)} then 'the request asks about symbol relationships'
        when kind in ('locate','refactor') then 'a ' || kind || ' request benefits from exact navigation' end"""
    d = f"case when {sql_any('low', routing.DEPENDENCY_TERMS)} then 'the request concerns a third-party dependency' end"
    s = f"""case when {sql_any('low', routing.STRUCTURAL_TERMS)} then 'the request describes a repeated code shape'
        when kind = 'refactor' and {sql_any('low', routing.BROAD_TERMS)} then 'a broad refactor benefits from structural matching' end"""
    return f"""
    with q as ({CLASSIFIED}),
    p as (select conv_id, turn, {p} as p, {d} as d, {s} as s from q)
    select conv_id, turn,
      concat_ws(',', case when p is not null then 'precision' end, case when d is not null then 'dependency_docs' end,
        case when s is not null then 'structural' end) as layers,
      concat_ws('; ', p, d, s) as reasons
    from p
    """


@query("evidence_plan", _plan_sql())
def evidence_plan(t) -> DataFrame:
    plan = routing.evidence_plan(F.col("text"), routing.classify(F.col("text")))
    return t.conversations.select(
        "conv_id",
        "turn",
        F.array_join(F.transform(plan, lambda p: p["layer"]), ",").alias("layers"),
        F.array_join(F.transform(plan, lambda p: p["reason"]), "; ").alias("reasons"),
    )


def sql_zone(path: str) -> str:
    parts = f"list_filter(string_split({path}, '/'), lambda p: p <> '' and p <> '.')"
    named = f"list_transform({parts}[1:greatest(len({parts}) - 1, 0)], lambda p: replace(lower(p), '-', '_'))"
    return f"coalesce(list_filter({named}, lambda p: p not in ('src','lib','app','source'))[1], 'root')"


@query(
    "path_zone",
    f"select page_id, {sql_zone(SITE_PATH_SQL)} as site_zone, {sql_zone(HOST_PATH_SQL)} as host_zone from pages",
)
def path_zone(t) -> DataFrame:
    return t.pages.select(
        "page_id", text.zone(site_path()).alias("site_zone"), text.zone(host_path()).alias("host_zone")
    )


def sql_normalize(name: str) -> str:
    slashed = f"regexp_replace(replace({name}, '\\', '/'), '^[./]+', '')"
    bare = f"regexp_replace({slashed}, '\\.(py|js|ts|go|rs)$', '')"
    return f"regexp_replace(replace({bare}, '.', '/'), '^/+|/+$', '', 'g')"


def sql_aliases(path: str) -> str:
    bare = f"regexp_replace({path}, '([^/])\\.[^./]+$', '\\1')"
    return (
        f"list_distinct([{sql_normalize(bare)}, {bare}, replace({bare}, '/', '.'), "
        f"string_split({bare}, '/')[-1]])"
    )


@query(
    "dependency_paths",
    f"""
    select page_id, {sql_normalize(HOST_PATH_SQL)} as normalized,
      array_to_string(list_sort({sql_aliases(HOST_PATH_SQL)}), ' ') as aliases
    from pages
    """,
)
def dependency_paths(t) -> DataFrame:
    return t.pages.select(
        "page_id",
        text.normalize_dependency(host_path()).alias("normalized"),
        F.array_join(F.array_sort(text.path_aliases(host_path())), " ").alias("aliases"),
    )


@query(
    "version_select",
    r"""
    with r as (select p_partkey, p_type as library, case when p_partkey % 11 = 0 then null
        else (case when p_partkey % 2 = 0 then 'v' else '' end) || p_size || '.' || (p_partkey % 4) end as requested from part),
    a as (select p_type as library, (case when p_partkey % 3 = 0 then 'V' else '' end) || p_size || '.' || (p_partkey % 2) as version,
        min(p_partkey) as ord from part where p_type <> 'PROMO' group by all),
    n as (select library, regexp_replace(version, '^(==|=|v|V)+', '') as norm, arg_min(version, ord) as version from a group by 1, 2),
    l as (select distinct library from a)
    select p_partkey, r.requested,
      case when r.requested is null then 'unversioned' when a.version is not null then 'exact'
        when n.version is not null then 'normalized' when l.library is null then 'unmatched' else 'fallback' end as match,
      coalesce(a.version, n.version) as provider_version
    from r left join a on a.library = r.library and a.version = r.requested
      left join n on n.library = r.library and n.norm = regexp_replace(r.requested, '^(==|=|v|V)+', '')
      left join l on l.library = r.library
    """,
)
def version_select(t) -> DataFrame:
    from loomgraph.operators.dependencies import select_versions

    key = F.col("p_partkey")
    requests = t.part.select(
        "p_partkey",
        F.col("p_type").alias("library"),
        F.when(key % 11 == 0, None)
        .otherwise(
            F.concat(F.when(key % 2 == 0, "v").otherwise(""), "p_size", F.lit("."), (key % 4).cast("string"))
        )
        .alias("requested"),
    )
    available = (
        t.part.filter("p_type <> 'PROMO'")
        .groupBy(
            F.col("p_type").alias("library"),
            F.concat(
                F.when(key % 3 == 0, "V").otherwise(""), "p_size", F.lit("."), (key % 2).cast("string")
            ).alias("version"),
        )
        .agg(F.min("p_partkey").alias("ordinal"))
    )
    return select_versions(requests, available).select(
        "p_partkey", "requested", "match", "provider_version"
    )


@query(
    "pin_library",
    r"""
    with x as (select p_partkey, '/' || lower(p_type) || '/' || replace(p_name, ' ', '-') ||
        (case p_partkey % 4 when 0 then '' when 1 then '@1.' || p_size when 2 then '/v' || p_size || '.0' else '/' end) as library,
        case when p_partkey % 5 = 0 then '' else p_size || '.0' end as version from part),
    y as (select *, regexp_replace(library, '/+$', '') as base from x)
    select p_partkey, case when version = '' then library
      when contains(string_split(base, '/')[-1], '@') or regexp_replace(string_split(base, '/')[-1], '^(==|=|v|V)+', '') = version then base
      else base || '/' || version end as pinned
    from y
    """,
)
def pin_library(t) -> DataFrame:
    key = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    library = F.concat(
        F.lit("/"),
        F.lower("p_type"),
        F.lit("/"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
        F.when(key % 4 == 0, "")
        .when(key % 4 == 1, F.concat(F.lit("@1."), size))
        .when(key % 4 == 2, F.concat(F.lit("/v"), size, F.lit(".0")))
        .otherwise("/"),
    )
    version = F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(size, F.lit(".0")))
    return t.part.select("p_partkey", text.pin_library(library, version).alias("pinned"))


@query(
    "symbol_identity",
    r"""
    select c_custkey,
      case c_custkey % 5 when 0 then 'local' else 'scip-x' end as scheme,
      case c_custkey % 5 when 0 then '' when 4 then 'npm' else 'pip' end as manager,
      case c_custkey % 5 when 0 then '' when 4 then '' else lower(c_mktsegment) || ' pkg' end as package,
      case c_custkey % 5 when 0 then '' when 4 then '' else '1.' || c_nationkey end as version,
      case c_custkey % 5 when 0 then c_name when 1 then 'src.mod.' || lower(c_mktsegment) || '.run'
        when 2 then 'src.a#b.T' when 3 then '' else 'K.x' end as qualified,
      case c_custkey % 5 when 0 then c_name when 1 then 'run' when 2 then 'T'
        when 3 then 'scip-x pip ' || lower(c_mktsegment) || '  pkg 1.' || c_nationkey || ' src/!' else 'x' end as display,
      case c_custkey % 5 when 0 then 'term' when 1 then 'method' when 2 then 'type_parameter' when 3 then 'unknown' else 'parameter' end as kind,
      case c_custkey % 5 when 1 then 'src.mod.' || lower(c_mktsegment) when 2 then 'src.a#b' when 4 then 'K' else '' end as container,
      case c_custkey % 5 when 3 then 'malformed descriptors' else '' end as parse_error
    from customer
    """,
)
def symbol_identity(t) -> DataFrame:
    """Symbol strings built from customers in four grammar shapes and one broken one."""
    seg = F.lower("c_mktsegment")
    head = F.concat(
        F.lit("scip-x pip "), seg, F.lit("  pkg 1."), F.col("c_nationkey").cast("string"), F.lit(" ")
    )
    key = F.col("c_custkey") % 5
    symbol = (
        F.when(key == 0, F.concat(F.lit("local "), F.col("c_name")))
        .when(key == 1, F.concat(head, F.lit("src/mod/"), seg, F.lit("#run(+1).")))
        .when(key == 2, F.concat(head, F.lit("src/`a#b`#[T]")))
        .when(key == 3, F.concat(head, F.lit("src/!")))
        .otherwise(F.lit("scip-x npm . . K#(x)"))
    )
    parsed = t.customer.select("c_custkey", symbol.alias("symbol")).withColumn(
        "id", parse_symbol(F.col("symbol"))
    )
    parts = F.col("id.descriptors")
    return parsed.select(
        "c_custkey",
        "id.scheme",
        "id.manager",
        "id.package",
        "id.version",
        qualified_name(parts).alias("qualified"),
        display_name(parts, F.col("symbol")).alias("display"),
        F.coalesce(F.try_element_at(parts, F.lit(-1))["kind"], F.lit("unknown")).alias("kind"),
        container(parts).alias("container"),
        "id.parse_error",
    )


@query(
    "position_convert",
    r"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
    c as (select *, strlen(line) // 2 as col from l where length(line) > 0),
    b as (select *, list_sum(list_transform(range(1, length(line) + 1), lambda i: case when strlen(line[1:i]) <= col then 1 else 0 end)) as chars from c)
    select doc_id, line_no, cast(col as integer) as col, cast(chars as integer) as utf8_char, strlen(line[1:chars]) <> col as ambiguous,
      cast(strlen(line[1:length(line) // 2]) as integer) as utf8_col, cast(length(line) // 2 as integer) as utf16_col,
      strlen(line[1:length(line) // 2]) <> length(line) // 2 as undecidable
    from b
    """,
)
def position_convert(t) -> DataFrame:
    lines = t.spread("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(
        F.length("line") > 0
    )
    col = F.floor(F.octet_length("line") / 2).cast("int")
    half = F.floor(F.length("line") / 2).cast("int")
    line = F.col("line")
    to_char = positions.to_character(line, col, F.lit("utf8"))
    return lines.select(
        "doc_id",
        (F.col("pos") + 1).cast("long").alias("line_no"),
        col.alias("col"),
        to_char["column"].alias("utf8_char"),
        to_char["ambiguous"].alias("ambiguous"),
        positions.to_protocol(line, half, F.lit("utf8")).alias("utf8_col"),
        positions.to_protocol(line, half, F.lit("utf16")).alias("utf16_col"),
        positions.undecidable(line, half).alias("undecidable"),
    )


@query(
    "encoding_resolution",
    r"""
    with e as (select event_id, case when event_id % 3 = 0 then 'utf8' else 'unspecified' end as declared,
      'idx-' || case event_type when 'click' then 'python' when 'view' then 'TypeScript' else event_type end as tool,
      case when event_id % 2 = 0 then '0.6.6' else '0.4.0' end as version from events)
    select event_id,
      case when declared <> 'unspecified' then declared
        when (ends_with(lower(tool), '-python') and version = '0.6.6') or (ends_with(lower(tool), '-typescript') and version = '0.4.0') then 'utf16'
        else 'utf32' end as encoding,
      case when declared <> 'unspecified' then 'declared'
        when (ends_with(lower(tool), '-python') and version = '0.6.6') or (ends_with(lower(tool), '-typescript') and version = '0.4.0') then 'compatibility-profile'
        else 'assumed-code-points' end as source
    from e
    """,
)
def encoding_resolution(t) -> DataFrame:
    tool = F.concat(
        F.lit("idx-"),
        F.when(F.col("event_type") == "click", "python")
        .when(F.col("event_type") == "view", "TypeScript")
        .otherwise(F.col("event_type")),
    )
    resolved = positions.resolve_encoding(
        F.when(F.col("event_id") % 3 == 0, "utf8").otherwise("unspecified"),
        tool,
        F.when(F.col("event_id") % 2 == 0, "0.6.6").otherwise("0.4.0"),
    )
    return t.events.select("event_id", resolved.alias("r")).select("event_id", "r.encoding", "r.source")


# Five spellings of an index path per page, most of them unacceptable.
GUARD_SQL = f"case page_id % 5 when 0 then url when 1 then {SITE_PATH_SQL} when 2 then '/' || {SITE_PATH_SQL} when 3 then 'C:\\' || {SITE_PATH_SQL} else 'a/../' || {SITE_PATH_SQL} end"


@query(
    "index_path_guard",
    f"""
    with p as (select page_id, {GUARD_SQL} as raw from pages),
    f as (select page_id, raw, replace(raw, '\\', '/') as flat from p)
    select page_id, case when flat = '' then 'missing' when regexp_matches(flat, '^[A-Za-z][A-Za-z0-9+.\\-]*://') then 'uri'
      when regexp_matches(raw, '^[A-Za-z]:[\\\\/]') then 'absolute drive' when starts_with(flat, '/') then 'absolute'
      when len(list_filter(string_split(flat, '/'), lambda s: s = '')) > 0 then 'empty component'
      when len(list_filter(string_split(flat, '/'), lambda s: s in ('.', '..'))) > 0 then 'not canonical' end as error, flat as path
    from f
    """,
)
def index_path_guard(t) -> DataFrame:
    key = F.col("page_id") % 5
    raw = (
        F.when(key == 0, F.col("url"))
        .when(key == 1, site_path())
        .when(key == 2, F.concat(F.lit("/"), site_path()))
        .when(key == 3, F.concat(F.lit("C:\\"), site_path()))
        .otherwise(F.concat(F.lit("a/../"), site_path()))
    )
    return t.pages.select("page_id", raw.alias("raw")).select(
        "page_id",
        text.index_path_error(F.col("raw")).alias("error"),
        text.index_path(F.col("raw")).alias("path"),
    )


@query(
    "scoped_symbol",
    """
    select event_id, case when event_id % 2 = 0 then 'doc' || user_id || '|local ' || event_type else event_type end as scoped
    from events
    """,
)
def scoped_symbol(t) -> DataFrame:
    symbol = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("local "), "event_type")).otherwise(
        F.col("event_type")
    )
    key = text.scoped_symbol(F.concat(F.lit("doc"), F.col("user_id").cast("string")), symbol)
    return t.events.select(
        "event_id", F.replace(key, F.lit("\u0000"), F.lit("|")).alias("scoped")
    )


@query(
    "redact",
    """
    select event_id, case when event_type in ('view', 'purchase') then '[REDACTED]' else json_extract_string(props, '$.k') end as secret_or_k,
      repeat(event_type, 500) as long_text
    from events
    """,
)
def redact(t) -> DataFrame:
    name = F.when(F.col("event_type") == "view", "api_key").when(
        F.col("event_type") == "purchase", "x-refresh_token"
    ).otherwise("tokens")
    attributes = F.create_map(
        name, F.get_json_object("props", "$.k"), F.lit("note"), F.repeat("event_type", F.lit(500))
    )
    clean = t.events.select("event_id", name.alias("name"), scoring.redact(attributes).alias("a"))
    return clean.select(
        "event_id",
        F.try_element_at("a", F.col("name")).alias("secret_or_k"),
        F.col("a")["note"].alias("long_text"),
    )


# Evidence bound to events: type gives the tier, value the confidence.
EVENT_TIER = {
    "signup": "exact",
    "purchase": "near_exact",
    "click": "structural",
    "view": "inferred",
    "error": "weak",
}


def evidence_rows(t) -> DataFrame:
    """Events as evidence records; many events share a location, so fusion has work to do."""
    return t.events.select(
        F.col("event_id").cast("string").alias("evidence_id"),
        F.when(F.col("event_id") % 2 == 0, "reference").otherwise("definition").alias("kind"),
        F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("provider"),
        F.when(F.col("event_id") % 4 == 0, "precision-index")
        .when(F.col("event_id") % 4 == 1, "structural-match")
        .otherwise("cross-file-heuristic")
        .alias("provenance"),
        scoring.lookup(EVENT_TIER, F.col("event_type"), "weak").alias("trust"),
        F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"),
        (F.col("event_id") % 7).cast("int").alias("start_line"),
        F.when(F.col("event_id") % 5 == 0, None).otherwise((F.col("event_id") % 2).cast("int")).alias(
            "start_column"
        ),
        F.col("event_type").alias("symbol"),
        F.least(F.lit(1.0), F.floor("value") / 100).alias("confidence"),
        ((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)).alias("exact"),
        (F.col("event_id") % 6 == 0).alias("stale"),
        F.col("props").alias("content"),
    )


EVIDENCE_SQL = f"""
    select cast(event_id as varchar) as evidence_id, case when event_id % 2 = 0 then 'reference' else 'definition' end as kind,
      'p' || (event_id % 3) as provider,
      case event_id % 4 when 0 then 'precision-index' when 1 then 'structural-match' else 'cross-file-heuristic' end as provenance,
      {sql_case(EVENT_TIER, 'event_type', 'weak')} as trust, 'src/u' || user_id || '.py' as path,
      cast(event_id % 7 as integer) as start_line, case when event_id % 5 = 0 then null else cast(event_id % 2 as integer) end as start_column,
      event_type as symbol, least(1.0, floor(value) / 100) as confidence,
      event_type = 'signup' and event_id % 3 = 0 as exact, event_id % 6 = 0 as stale, props as content
    from events
"""
SCORE_SQL = f"""round(least(1.0, greatest(0.0, {sql_case(scoring.TRUST_WEIGHTS, 'trust', 0.2)} *
    (0.35 + 0.65 * confidence) * (case when stale then 0.24948 else 1.0 end))), 6)"""


@query("evidence_score", f"select evidence_id, {SCORE_SQL} as score from ({EVIDENCE_SQL})")
def evidence_score(t) -> DataFrame:
    return evidence_rows(t).select(
        "evidence_id",
        scoring.evidence_score(F.col("trust"), F.col("confidence"), F.col("stale")).alias("score"),
    )


_RANKS = {tier: i for i, tier in enumerate(scoring.TRUST_WEIGHTS)}
_CEILINGS = {p: _RANKS[tier] for p, tier in scoring.TRUST_CEILING.items()}


@query(
    "evidence_validity",
    f"""
    select coalesce(error, 'valid') as verdict, count(*) as records from (
      select case when exact and trust <> 'exact' then 'exact evidence needs the exact tier'
        when exact and stale then 'stale evidence cannot be exact'
        when {sql_case(_RANKS, 'trust', 6)} < {sql_case(_CEILINGS, 'provenance', 0)} then 'tier above provenance ceiling' end as error
      from ({EVIDENCE_SQL})) group by all
    """,
)
def evidence_validity(t) -> DataFrame:
    error = scoring.evidence_error(
        F.col("trust"), F.col("provenance"), F.col("exact"), F.col("stale")
    )
    return (
        evidence_rows(t)
        .groupBy(F.coalesce(error, F.lit("valid")).alias("verdict"))
        .agg(F.count("*").alias("records"))
    )


@query(
    "content_fingerprint",
    f"""
    with d as (select doc_id, sha256(source || '␟' || array_to_string(
      list_filter(string_split_regex(lower(text), '{SQL_BLANK}'), lambda w: w <> ''), ' ')) as fp from documents)
    select min(doc_id) as first_doc, count(*) as copies from d group by fp
    """,
)
def content_fingerprint(t) -> DataFrame:
    fp = scoring.fingerprint(F.col("source"), text.collapse(F.lower("text")))
    return (
        t.documents.groupBy(fp.alias("fp"))
        .agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
        .drop("fp")
    )


@query(
    "evidence_header",
    f"""
    select evidence_id, '[' || trust || '] ' || kind || ' ' || loc || case when symbol <> '' then ' — ' || symbol else '' end as header
    from (select *, path || ':' || start_line || coalesce(':' || start_column, '') as loc from ({EVIDENCE_SQL}))
    """,
)
def evidence_header(t) -> DataFrame:
    place = scoring.location(F.col("path"), F.col("start_line"), F.col("start_column"))
    return evidence_rows(t).select(
        "evidence_id",
        scoring.evidence_header(F.col("trust"), F.col("kind"), place, F.col("symbol")).alias("header"),
    )


@query(
    "is_test",
    f"""
    with p as (select page_id, lower({SITE_PATH_SQL}) as path, lower(regexp_extract(url, '([^/.]+)\\.example', 1)) as name from pages)
    select page_id, contains('/' || path, '/test') or contains(path, 'tests/') or starts_with(name, 'test_')
      or ends_with(name, 'test') or ends_with(name, 'tests') as is_test,
      contains('/' || replace(path, '/', '/test'), '/test') or contains(path, 'tests/') or starts_with(name, 'test_')
      or ends_with(name, 'test') or ends_with(name, 'tests') as is_test_folder
    from p
    """,
)
def is_test(t) -> DataFrame:
    name = F.regexp_extract("url", r"([^/.]+)\.example", 1)
    moved = F.replace(site_path(), F.lit("/"), F.lit("/test"))
    return t.pages.select(
        "page_id",
        text.is_test(site_path(), name).alias("is_test"),
        text.is_test(moved, name).alias("is_test_folder"),
    )


@query(
    "edge_weight",
    f"""
    with e as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
        case l_returnflag when 'A' then 'calls' when 'N' then 'imports' else 'other' end as kind,
        case when l_tax < 0.02 then 'exact' when l_tax < 0.04 then 'stale_exact' end as declared, l_discount as conf from lineitem),
    r as (select *, case when declared is not null then declared when conf <= 0 then 'unresolved' else 'inferred' end as resolution from e)
    select kind, resolution, count(*) as edges, round({sql_case(scoring.EDGE_WEIGHTS, 'kind', 0.5)} *
      {sql_case(scoring.RESOLUTION_MULTIPLIERS, 'resolution', 0.85)}, 6) as weight
    from r group by all
    """,
)
def edge_weight(t) -> DataFrame:
    kind = scoring.lookup({"A": "calls", "N": "imports"}, F.col("l_returnflag"), "other")
    declared = F.when(F.col("l_tax") < 0.02, "exact").when(F.col("l_tax") < 0.04, "stale_exact")
    return (
        t.lineitem.select(
            kind.alias("kind"), scoring.edge_resolution(declared, F.col("l_discount")).alias("resolution")
        )
        .groupBy("kind", "resolution")
        .agg(F.count("*").alias("edges"))
        .withColumn(
            "weight", F.round(scoring.edge_weight(F.col("kind"), F.col("resolution")), 6)
        )
    )


@query(
    "clock_compare",
    """
    with c as (select event_id, event_id % 4 as la, event_id % 3 as lb, user_id % 4 as ra, user_id % 3 as rb from events)
    select event_id, case when la <= ra and lb <= rb and ra <= la and rb <= lb then 'equal' when la <= ra and lb <= rb then 'before'
      when ra <= la and rb <= lb then 'after' else 'concurrent' end as relation,
      cast(greatest(la, ra) as integer) as merged_a, cast(greatest(lb, rb) as integer) as merged_b
    from c
    """,
)
def clock_compare(t) -> DataFrame:
    def clock(key):
        return F.create_map(
            F.lit("a"), (F.col(key) % 4).cast("int"), F.lit("b"), (F.col(key) % 3).cast("int")
        )

    left, right = clock("event_id"), clock("user_id")
    return t.events.select(
        "event_id",
        clocks.compare(left, right).alias("relation"),
        clocks.merge(left, right)["a"].alias("merged_a"),
        clocks.merge(left, right)["b"].alias("merged_b"),
    )


@query(
    "grade_answers",
    """
    with c as (select conv_id, turn, lower(text) as low, length(text) as n from conversations),
    k as (select *, cast(contains(low, 'the') as integer) as c1, cast(contains(low, 'er') as integer) as c2,
      cast(not contains(low, 'and') as integer) as c3, cast(conv_id % 2 = 0 as integer) as c4,
      cast(ceil(n / 4.0) <= 60 as integer) as c5, cast(turn <= 3 as integer) as c6 from c)
    select conv_id, turn, c1 + c2 + c3 + c4 + c5 + c6 = 6 as passed, round((c1 + c2 + c3 + c4 + c5 + c6) / 6.0, 6) as score,
      concat_ws(',', case when c1 = 0 then 'required-string:The' end, case when c2 = 0 then 'required-string:er' end,
       case when c3 = 0 then 'forbidden-string:And' end, case when c4 = 0 then 'required-path:src/a.py' end,
       case when c5 = 0 then 'max-tokens:60' end, case when c6 = 0 then 'max-tool-calls:3' end) as failures
    from k
    """,
)
def grade_answers(t) -> DataFrame:
    touched = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("src\\a.py"))).otherwise(
        F.array(F.lit("b.py"))
    )
    graded = grading.grade(
        F.col("text"),
        touched,
        text.token_count(F.col("text")),
        F.col("turn"),
        F.array(F.lit("The"), F.lit("er")),
        F.array(F.lit("And")),
        F.array(F.lit("src/a.py")),
        F.lit(60),
        F.lit(3),
    )
    return t.conversations.select("conv_id", "turn", graded.alias("g")).select(
        "conv_id",
        "turn",
        "g.passed",
        F.round("g.score", 6).alias("score"),
        F.array_join("g.failures", ",").alias("failures"),
    )


@query(
    "ttl_freshness",
    """
    with n as (select max(epoch_us(ts)) as now from events)
    select user_id, count(*) as entries, sum(cast(now - epoch_us(ts) > 86400000000 as bigint))::bigint as stale
    from events, n group by user_id
    """,
)
def ttl_freshness(t) -> DataFrame:
    from loomgraph.plans.events import micros

    events = t.events.withColumn("us", micros())
    now = events.agg(F.max("us")).scalar()
    flagged = events.withColumn("old", scoring.is_stale(F.col("us"), now, 86400))
    return flagged.groupBy("user_id").agg(
        F.count("*").alias("entries"), F.count_if("old").alias("stale")
    )
