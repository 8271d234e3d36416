"""URL rules, mixing, toxicity, the pipeline and the registered queries."""

import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from loomgraph.llm import mixing, queries, toxicity, urls

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")

RULES = [
    urls.parse_rule(*x.split())
    for x in "allow com/|block example.com/en/|allow www.example.com/en/|block net/es/|block net/e|allow net/es/x/|block a.b/|allow a.b/|block org".split("|")
]
URLS = [
    "http://example.com/en/1", "HTTP://WWW.Example.COM/en/1", "https://x.www.example.com/en/", "http://example.com/en", "http://example.com",
    "http://badexample.com/en/", "http://x.net/es/1", "http://x.net/es/x/1", "http://x.net/es/x", "http://x.net/else", "http://net/es/", "http://a.b/",
    "http://x.a.b/", "no scheme", None, "", "://", "a://b://c/d", "http://x.org?x#y", "http://x.org#y?z", "http://com:80/", "http://example.com/en/?q=/fr/", "http://\nx.net/es/\n", "http://x.net?/es/",
]


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


@pytest.mark.parametrize("cut", [100, 2])
def test_longest_rule_wins(spark, monkeypatch, cut):
    monkeypatch.setattr(urls, "TRIE_RULES", cut)
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string")
    found = urls.judge_urls(pages, RULES).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found) == [
        (i, *brute_verdict(u)) for i, u in enumerate(URLS + URLS[:2])
    ]
    assert urls.judge_urls(pages.where("false"), RULES).collect() == []
    assert {r["verdict"] for r in urls.judge_urls(pages, [], "block").collect()} == {"block"}


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        weights = sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and weight[s] * rest / weights > 2 * sizes[s]}
        if not new:
            return {s: 2 * sizes[s] if s in capped else weight[s] * rest / weights for s in order}
        capped |= new


def test_targets_are_shared_by_weight_below_their_caps(spark):
    for seed in range(6):
        draw = random.Random(seed)
        sizes = {s: draw.choice([0, 1, 10, 100, 10_000]) * draw.randint(1, 9) for s in ["a", "b", "ä", "z", "ﬁ", "😀", None][: seed + 2]}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        assert found == pytest.approx(brute_targets(sizes))


def test_mixing(docs, rows, no_docs):
    found = mixing.mix(docs).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = brute_targets(sizes)
    for r in found:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert (r["source_size"], r["target"]) == (sizes[r["source"]], pytest.approx(targets[r["source"]]))
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= min(2, int(rate) + 1)
    plain = lambda x: sorted(map(repr, x))
    assert plain(mixing.mix(docs).collect()) == plain(found)
    mixed = mixing.emit(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)
    assert mixing.mix(no_docs).collect() == [] and mixing.emit(no_docs).collect() == []


def test_targets_that_are_not_broadcast(docs, monkeypatch):
    plain = lambda frame: sorted(map(repr, frame.select("doc_id", "text", "copies", "target").collect()))
    few = plain(mixing.mix(docs))
    monkeypatch.setattr(mixing, "TARGET_BYTES", -1)
    assert plain(mixing.mix(docs)) == few


def test_mixing_comes_near_its_targets(spark):
    frame = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 9 as int)) as text", "concat('s', id % 4) as source")
    found = mixing.mix(frame).selectExpr("*", "size * copies as taken").groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] / r["target"] - 1) < 0.03 for r in found)


def labelled(n=600):
    """Toxic if an insult meets a group; either alone is clean."""
    draw = random.Random(5)
    filler = ["".join(draw.choice("aeioudlnrst") for _ in range(5)) for _ in range(60)]
    out = []
    for i in range(n):
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        words = [draw.choice(filler) for _ in range(20)] + ["vermin"] * insult + ["foreigners"] * group
        draw.shuffle(words)
        out.append((i, " ".join(words), int(insult and group)))
    return out


def test_machine_learns_pairs_that_no_sum_of_weights_shows(spark):
    rows = labelled()
    known = {}
    terms = [toxicity.text_terms(t, known) for _, t, _ in rows]
    machine = toxicity.train(lambda: zip(terms, [y for *_, y in rows], strict=True))
    insult, group, both = machine.logits([toxicity.text_terms(t, known) for t in ("vermin", "foreigners", "vermin foreigners")])
    assert both > 0 > max(insult, group)
    flat = toxicity.Machine(machine.bias, machine.slot, machine.weights, machine.factors * 0)
    assert both > flat.logits([toxicity.text_terms("vermin foreigners", known)])[0] + 0.5


def test_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(0.5, np.arange(10, dtype=np.int32), rng.normal(size=10), rng.normal(size=(10, toxicity.RANK)))
    for terms in ([], [3], [1, 4, 9]):
        want = 0.5 + machine.weights[terms].sum()
        want += sum(machine.factors[a] @ machine.factors[b] for a in terms for b in terms if a < b)
        assert machine.logits([np.array(terms, np.int32)])[0] == pytest.approx(want)


def test_toxicity_scores_every_row(spark, docs, no_docs):
    rows = labelled()
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "vermin"), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, 1), (None, 1), (7777, 0), (8, None), (9, 4)], "doc_id long, toxic int")
    found = toxicity.toxicity(frame, labels).collect()
    assert len(found) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 5]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert len({r["score"] for r in found if not r["text"]}) == 1
    again = toxicity.toxicity(frame, labels).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    # Without labels, and with clashing names, empty tables and fewer rows to learn from.
    none = toxicity.toxicity(docs, labels.where("false"))
    assert none.count() == docs.count() and {r["score"] for r in none.collect()} == {0.5}
    assert toxicity.toxicity(no_docs, labels).collect() == []
    assert toxicity.toxicity(frame, labels, train_rows=50).count() == len(found)


@here
def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, step in corpus_pipeline.STAGES:
        before = docs
        step(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "toxicity":
            judged = toxicity.toxicity(before, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r["doc_id"] for r in judged.where("predicted = 0").collect())
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in docs.collect()]
            assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in before.collect()})
        if name == "mixing":
            assert counts[-1] == mixing.mix(before).agg({"copies": "sum"}).first()[0]
        if name != "packing":
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2] and counts[5] >= counts[4]
    assert corpus_pipeline.run(spark, DATA).count() == counts[5]


def test_pipeline_stages_on_frames_that_are_no_files(spark):
    """Both passes of a stage meet the same rows, whatever the frame is made of."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (2, text), (3, text + " more"), (4, None), (5, ""), (6, "else"), (6, "else"), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x"))
    exact = corpus_pipeline.drop_copies(spark, frame, DATA)
    assert sorted((r["doc_id"] or 0) for r in exact.collect()) == [0, 1, 3, 4, 6] and exact.columns == frame.columns
    near = corpus_pipeline.drop_near_copies(spark, exact.union(frame.where("doc_id = 2")), DATA)
    assert sorted((r["doc_id"] or 0) for r in near.collect()) == [0, 1, 4, 6] and near.columns == frame.columns
    for step in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert step(spark, frame.where("doc_id > 99"), DATA).collect() == []


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages"):
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = connection.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def plain(frame):
        frame = frame[columns].astype(object)
        return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))

    assert plain(got) == plain(want)


@here
def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
