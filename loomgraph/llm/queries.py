"""The operators bound to the driver tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exact, huffman, mixing, neighbours, packing, quality, simhash, substrings, toxicity, urls, variants, warc, whitening
from loomgraph.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


@query("op1_coded_ids")
def op1(t: Tables) -> DataFrame:
    read = huffman.read_ids(*huffman.write_ids(t.documents, public_tokenizers.path("word_bpe_49k.json")))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(
    "op2_exact_dedup",
    r"""
    with texts as (
      select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
    select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
      doc_id = min(doc_id) over w as kept, text_sha256
    from texts window w as (partition by text_sha256)
    """,
)
def op2(t: Tables) -> DataFrame:
    return exact.exact_dedup(t.documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op5_substrings")
def op5(t: Tables) -> DataFrame:
    left = substrings.remove_repeats(t.documents)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The rules of the contract.
URL_RULES = [
    urls.parse_rule("allow", "com/"),
    urls.parse_rule("block", "example.com/en/"),
    urls.parse_rule("allow", "www.example.com/en/"),
    urls.parse_rule("block", "net/es/"),
    urls.parse_rule("block", "net/fr/"),
]


@query(
    "op6_url_filter",
    r"""
    with parts as (
      select page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
      from pages),
    judged as (
      select *, case
        when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
        when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
        when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/'
        when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
        when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
        end as rule from parts)
    select page_id, host, path, rule,
      case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict
    from judged
    """,
)
def op6(t: Tables) -> DataFrame:
    return urls.judge_urls(t.pages, URL_RULES)


@query(
    "op7_mixing",
    r"""
    with recursive sized as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
    sources as (
      select source, cast(sum(size) as bigint) as source_size,
        [5, 2, 1][(row_number() over (order by encode(source) nulls last) - 1) % 3 + 1] as weight
      from sized group by source),
    -- Cap every source above twice its size, share the rest anew, until none is above.
    rounds as (
      select 0 as i, source, source_size, weight, false as capped from sources
      union all
      select i + 1, source, source_size, weight,
        capped or weight * left_over > 4 * source_size * open_weight
      from (
        select *,
          3 * sum(source_size) over () - 4 * sum(case when capped then source_size else 0 end) over () as left_over,
          sum(case when capped then 0 else weight end) over () as open_weight
        from rounds)
      where i < 100),
    last_round as (
      select *,
        3 * sum(source_size) over () - 4 * sum(case when capped then source_size else 0 end) over () as left_over,
        sum(case when capped then 0 else weight end) over () as open_weight
      from rounds where i = 100),
    targets as (
      select source, source_size,
        case when capped then cast(2 * source_size as double)
        else cast(cast(weight * left_over as bigint) as double) / cast(cast(2 * open_weight as bigint) as double) end as target
      from last_round),
    rated as (
      select d.doc_id, d.size, s.source_size, s.target,
        case when s.source_size > 0 then s.target / s.source_size else 0 end as rate,
        ('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint / 4503599627370496.0 as draw
      from sized d join targets s on d.source is not distinct from s.source)
    select doc_id, size, source_size, target,
      cast(size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end) as bigint) as taken
    from rated
    """,
)
def op7(t: Tables) -> DataFrame:
    mixed = mixing.mix(t.documents)
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken")


@query("op3_simhash")
def op3(t: Tables) -> DataFrame:
    return simhash.near_duplicates(t.documents).select("doc_id", "fingerprint", "component_id")


@query("op4_packing")
def op4(t: Tables) -> DataFrame:
    packed = packing.pack(t.documents, public_tokenizers.path("byte_bpe_50k.json"))
    # Without the ids themselves, the pieces that meet their places stay narrow.
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


@query(
    "op8_warc",
    """
    with payloads as (
      select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as payload_bytes from pages),
    kept as (
      select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload) else page_id end as keeper from payloads)
    select page_id, payload_bytes, sha1(payload) as payload_digest,
      case when page_id = keeper then 'response' else 'revisit' end as record_type,
      case when page_id <> keeper then keeper end as refers_to
    from kept
    """,
)
def op8(t: Tables) -> DataFrame:
    return warc.read_warc(*warc.write_warc(t.pages))


@query("op9_neighbours")
def op9(t: Tables) -> DataFrame:
    return neighbours.neighbours(t.embeddings, F.col("vec_id") % 20 == 0)


@query("op10_toxicity")
def op10(t: Tables) -> DataFrame:
    return toxicity.toxicity(t.documents, t.labels).select("doc_id", "held_out", "score", "predicted")


@query("op11_quality")
def op11(t: Tables) -> DataFrame:
    return quality.quality(t.documents, t.labels, 0.3).select("doc_id", "held_out", "score", "predicted")


@query("op12_whitening")
def op12(t: Tables) -> DataFrame:
    return whitening.whiten(t.embeddings).withColumn("deviation", F.expr("try_cast(deviation as long)"))


@query("op13_variants")
def op13(t: Tables) -> DataFrame:
    return variants.variants(t.documents)
