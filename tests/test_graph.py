"""Impact, resolution, drift, federation, co-change and path search on small graphs."""

import random
import tracemalloc
from collections import Counter, deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scoring
from loomgraph.operators import architecture, federation, graph, history, quality, resolution, retrieval, search

NODE = "repo string, id string, kind string, name string, path string, line int"
EDGE = "repo string, source string, target string, kind string, resolution string, resolution_confidence double"


def nodes(spark, data):
    return spark.createDataFrame([("m", *d) for d in data], NODE)


def edges(spark, data):
    return spark.createDataFrame([("m", *d, None, None) for d in data], EDGE)


def request(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_impact_chain(spark):
    n = nodes(
        spark,
        [
            ("a", "function", "token", "src/a.py", 1),
            ("b", "function", "login", "src/b.py", 1),
            ("c", "function", "checkout", "src/c.py", 1),
            ("t", "function", "test_checkout", "tests/test_pay.py", 1),
        ],
    )
    e = edges(spark, [("b", "a", "calls"), ("c", "b", "calls"), ("t", "c", "calls")])
    items = graph.impact(n, e, graph.find_targets(n, request(spark, "token"))).collect()
    assert {i.name for i in items if i.depth == 1} == {"login"}
    assert {i.name for i in items if i.depth > 1} == {"checkout", "test_checkout"}
    assert {i.name for i in items if i.is_test} == {"test_checkout"}
    report = graph.impact_report(graph.impact(n, e, graph.find_targets(n, request(spark, "token")))).first()
    assert report.risk_score > 0


def bfs_impact(edge_rows, target, max_depth=5):
    """First-in-first-out relaxation by risk."""
    incoming = {}
    for s, t, k in edge_rows:
        incoming.setdefault(t, []).append((s, scoring.EDGE_WEIGHTS.get(k, 0.5) * 0.85))
    queue = deque((s, 1, w) for s, w in incoming.get(target, []))
    seen = {}
    while queue:
        node, depth, strength = queue.popleft()
        if depth > max_depth or node == target:
            continue
        risk = strength / max(1.0, depth * 0.85)
        if node in seen and seen[node][1] >= risk:
            continue
        seen[node] = (depth, min(1.0, risk))
        queue.extend((s, depth + 1, strength * w) for s, w in incoming.get(node, []))
    return {k: (d, round(r, 9)) for k, (d, r) in seen.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_impact_equals_relaxation(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(12)]
    data = [(rng.choice(ids), rng.choice(ids), rng.choice(["calls", "imports", "contains", "x"])) for _ in range(40)]
    n = nodes(spark, [(i, "function", i, f"src/{i}.py", 1) for i in ids])
    targets = spark.createDataFrame([("n0",), ("n5",)], "id string")
    items = graph.impact(n, edges(spark, data), targets).collect()
    for target in ("n0", "n5"):
        got = {i.node: (i.depth, round(i.risk, 9)) for i in items if i.target == target}
        assert got == bfs_impact(data, target)


def test_resolution_prefers_nearby_symbol(spark):
    candidates = spark.createDataFrame(
        [("m", "a", "run", "function", "src/auth/helper.py"), ("m", "b", "run", "function", "other/helper.py")],
        "repo string, id string, name string, kind string, path string",
    )
    relations = spark.createDataFrame(
        [("m", "src/auth/service.py", "calls", "run"), ("m", "x.py", "imports", "os"), ("m", "x.py", "calls", "zzz")],
        "repo string, path string, kind string, target string",
    )
    got = {r.target: r for r in resolution.resolve_targets(relations, candidates).collect()}
    assert got["run"].target_id == "a" and got["run"].candidate_count == 2
    assert got["run"].resolution_confidence > 0.4
    assert got["os"].target_id == "module:os" and got["zzz"].target_id == "reference:zzz"


def ranked_candidates(relation, candidates):
    """Every candidate of the name, scored one by one."""
    _, path, kind, target = relation
    out = []
    for _, ident, name, k, other in candidates:
        if name != target or other is None:
            continue
        mine, theirs = path.split("/")[:-1], other.split("/")[:-1]
        near = 0.35 if path == other else 0.2 if mine == theirs else min(0.12, 0.03 * len(set(mine) & set(theirs)))
        fit = kind == "calls" and k in resolution.CALLABLE_KINDS or kind in ("inherits", "implements") and k in resolution.TYPE_KINDS
        out.append((-round(0.35 + near + (0.08 if fit else 0), 6), ident))
    return [(ident, round(-neg, 4)) for neg, ident in sorted(out)[:5]]


@pytest.mark.parametrize("seed, limit", [(1, 64), (2, 2), (3, 1), (4, 0)])
def test_resolution_equals_ranking_all_candidates(spark, monkeypatch, seed, limit):
    """Short lists compared, and crowded ones split down to four names."""
    monkeypatch.setattr(resolution, "LIST", limit)
    rng = random.Random(seed)

    def path():
        return "/".join(["src", *rng.choices("abcdefg", k=rng.randint(0, 6)), f"f{rng.randint(0, 3)}.py"])

    candidates = [("m", f"s{i:03}", rng.choice("xy"), rng.choice(["class", "function", "type"]), path()) for i in range(150)]
    candidates += [("m", "none", "x", "class", None), ("m", "top", "x", "class", "f0.py"), ("n", "other", "x", "class", "src/a/f0.py")]
    relations = list({("m", path(), rng.choice(["calls", "inherits", "imports"]), rng.choice("xyz")) for _ in range(40)})
    relations += [("m", "f9.py", "calls", "x")]
    got = resolution.resolve_targets(
        spark.createDataFrame(relations, "repo string, path string, kind string, target string"),
        spark.createDataFrame(candidates, "repo string, id string, name string, kind string, path string"),
    ).collect()
    own = [c for c in candidates if c[0] == "m"]
    assert {(r.path, r.kind, r.target): [(c.id, c.score) for c in r.candidates or []] for r in got} == {
        r[1:]: ranked_candidates(r, own) for r in relations
    }


def test_a_deep_path_has_a_list_for_each_folder(spark):
    deep = "/".join(f"d{i}" for i in range(20))
    places = spark.createDataFrame([("m", "x", deep)], "repo string, target string, folder string")
    sizes = spark.createDataFrame([("m", "x", f"d{i}", i) for i in range(20)], "repo string, target string, name string, n long")
    lists = resolution._lists(places, sizes)
    assert lists.count() == 20
    assert resolution._further(lists.filter("key = '/d19'")).count() == 0


def test_drift_reports_new_direction(spark):
    base_nodes = [("a", "file", "a", "src/domain/a.py", None), ("b", "file", "b", "src/application/b.py", None)]
    base_edges = [("b", "a", "imports")]
    more_nodes = [*base_nodes, ("i", "file", "i", "src/infrastructure/db.py", None)]
    more_edges = [*base_edges, ("a", "i", "imports")]

    def prints(n, e):
        n = nodes(spark, n)
        return architecture.dependency_counts(n, edges(spark, e)), architecture.infer_architecture(n)

    base, base_patterns = prints(base_nodes, base_edges)
    now, now_patterns = prints(more_nodes, more_edges)
    found = architecture.drift(base, now, base_patterns, now_patterns).collect()
    assert "new-dependency-direction" in {f.kind for f in found}


def federation_sample(spark):
    data = [
        ("api", "s1", "function", "refresh_token", "api/auth.py", 1),
        ("worker", "s2", "function", "Refresh_Token", "worker/jobs.py", 1),
        ("worker", "s3", "function", "refresh_token", "worker/more.py", 1),
        ("app", "m1", "module", "shared.util", None, None),
        ("shared", "f1", "file", "util.py", "shared/util.py", None),
        ("shared", "m2", "module", "shared.util", None, None),
    ]
    n = spark.createDataFrame(data, NODE)
    own = spark.createDataFrame([("api", "f", "s1", "contains")], "repo string, source string, target string, kind string")
    return federation.federate(n, own)


def test_federation_links(spark, rows):
    all_nodes, all_edges = federation_sample(spark)
    got, ids = rows(all_edges), {r.id for r in all_nodes.collect()}
    name, path = "hub:symbol:function:refresh_token", "hub:path:0.92:shared/util"
    assert {name, path} < ids and all(i.startswith(("repo:", "hub:")) for i in ids)
    assert ("repo:api:s1", name, "cross_repo_symbol") in got and ("repo:worker:s2", name, "cross_repo_symbol") in got
    assert ("repo:app:m1", path, "cross_repo_dependency") in got and (path, "repo:shared:f1", "cross_repo_dependency") in got
    # A repository asks nothing of itself.
    assert not any(source == "repo:shared:m2" for source, *_ in got)
    assert ("repo:api:f", "repo:api:s1", "contains") in got


def test_impact_and_neighbourhood_walk_through_hubs(spark):
    nodes, edges = federation_sample(spark)
    ask = lambda i: spark.createDataFrame([(i,)], "id string")

    def reached(i, depth=1):
        return {(r.node, r.depth) for r in graph.impact(nodes, edges, ask(i), depth).collect()}

    assert reached("repo:api:s1") == {("repo:worker:s2", 1), ("repo:worker:s3", 1)}
    assert reached("repo:worker:s2") == {("repo:api:s1", 1)}
    assert reached("repo:worker:s2", 2) == {("repo:api:s1", 1), ("repo:worker:s3", 2)}
    assert reached("repo:shared:f1") == {("repo:app:m1", 1)} and reached("repo:app:m1") == set()
    near = lambda i, d: {r.id for r in graph.neighbourhood(nodes, edges, ask(i), d)[0].collect()}
    assert near("repo:worker:s2", 1) == {"repo:worker:s2", "repo:api:s1"}
    assert near("repo:shared:f1", 1) == {"repo:shared:f1", "repo:app:m1"}


def test_neighbourhood_goes_from_asks_to_offers(spark):
    data = [(f"app{i}", f"m{i}", "module", "shared.util", None, None) for i in range(4)]
    data += [("shared", "f1", "file", "util.py", "shared/util.py", None), ("shared", "m9", "module", "shared.util", None, None)]
    none = spark.createDataFrame([], "repo string, source string, target string, kind string")
    nodes, edges = federation.federate(spark.createDataFrame(data, NODE), none)
    hub = "hub:path:0.92:shared/util"

    def near(i, depth, limit=400):
        found, inside = graph.neighbourhood(nodes, edges, spark.createDataFrame([(i,)], "id string"), depth, "", limit)
        return [r.id for r in found.orderBy("hop", "id").collect()], {(r.source, r.target) for r in inside.collect()}

    # Who asks for the same file is two hops away, and does not push it out.
    first, file = "repo:app3:m3", "repo:shared:f1"
    assert near(first, 1, 2) == ([first, file], {(first, hub), (hub, file)})
    assert near(first, 2)[0] == [first, file, "repo:app0:m0", "repo:app1:m1", "repo:app2:m2"]
    assert near(file, 1)[1] == {(hub, file)} | {(f"repo:app{i}:m{i}", hub) for i in range(4)}
    assert near("repo:shared:m9", 1) == (["repo:shared:m9"], set())
    # A hub that all members share in both ways returns theirs, and none of a member alone.
    nodes, edges = federation_sample(spark)
    name = "hub:symbol:function:refresh_token"
    assert near("repo:worker:s2", 1)[1] == {("repo:api:s1", name), ("repo:worker:s2", name)}
    assert near("repo:worker:s2", 0)[1] == set()


@pytest.mark.parametrize("repositories", [2, 40])
def test_groups_of_any_size_link_alike(spark, repositories):
    data = [(f"r{i}", f"s{i}", "function", "get", "x.py", 1) for i in range(repositories)]
    frame = spark.createDataFrame(data, NODE)
    groups = federation.symbol_groups(federation.namespaced(frame))
    links = federation.symbol_links(groups).collect()
    assert {h.target for h in links} == {"hub:symbol:function:get"} and len(links) == repositories
    ids = spark.createDataFrame([("repo:r0:s0",)], "id string")
    assert federation.symbol_partners(groups, ids).count() == repositories - 1
    none = spark.createDataFrame([], "repo string, source string, target string, kind string")
    nodes, edges = federation.federate(frame, none)
    assert graph.impact(nodes, edges, ids).count() == repositories - 1
    assert graph.neighbourhood(nodes, edges, ids, 1)[0].count() == repositories


def test_path_longer_than_eight_hops_and_no_path(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "source string, target string")
    assert graph.shortest_path(edges, "n0", "n11").count() == 12
    assert graph.shortest_path(edges, "n0", "x").count() == 0
    assert graph.shortest_path(edges, "n0", "n11", 8).count() == 0


@pytest.mark.parametrize("wide", [1, 3, 64])
def test_co_change_equals_pair_counts(spark, wide):
    rng = random.Random(wide)
    commits = {f"c{i}": rng.sample([f"f{j}" for j in range(9)], rng.choice([1, 2, 3, 6, 8])) for i in range(25)}
    pairs = Counter()
    for files in commits.values():
        for a in files:
            for b in files:
                if a < b:
                    pairs[a, b] += 1
    want = sorted(((a, b, c) for (a, b), c in pairs.items()), key=lambda x: (-x[2], x[0], x[1]))[:10]
    df = spark.createDataFrame([(s, p) for s, ps in commits.items() for p in ps], "sha string, path string")
    got = [tuple(r) for r in history.co_change(df, 10, wide).orderBy(F.desc("commits"), "left", "right").collect()]
    assert got == want


def pair_counts(commits, top):
    pairs = Counter()
    for files in commits.values():
        ranked = sorted(set(files))
        pairs.update((a, b) for i, a in enumerate(ranked) for b in ranked[i + 1 :])
    return sorted(((a, b, c) for (a, b), c in pairs.items()), key=lambda x: (-x[2], x[0], x[1]))[:top]


@pytest.mark.parametrize("seed", range(4))
def test_co_change_of_wide_commits(spark, monkeypatch, seed):
    """Ties, copies of one history, commits of several tiles and no narrow commit at all."""
    monkeypatch.setattr(history, "TILE", 3)
    monkeypatch.setattr(history, "SEEDS", [1, 64, 0, 2][seed])
    rng = random.Random(seed)
    names = [f"f{j:02}" for j in range(24)]
    commits = {f"c{i}": rng.sample(names, rng.choice([4, 9, 20] if seed < 3 else [1, 2, 12])) for i in range(30)}
    for i in range(3):
        commits[f"d{i}"] = [*names[5:9], "x1", "x2", "x3"]
    df = spark.createDataFrame([(s, p) for s, ps in commits.items() for p in ps], "sha string, path string")
    got = [tuple(r) for r in history.co_change(df, 7, 3).orderBy(F.desc("commits"), "left", "right").collect()]
    assert got == pair_counts(commits, 7)


def test_overlaps_of_commits_on_both_sides_of_the_limit(spark, monkeypatch):
    """Commits of few files count their own pairs, those of many are looked up; only the pairs asked for are given."""
    monkeypatch.setattr(history, "WIDE_COMMIT", 6)
    rng = random.Random(3)
    commits = {f"c{i}": rng.sample([f"g{j:02}" for j in range(12)], rng.choice([2, 4, 6, 7, 11])) for i in range(40)}
    counts = {(a, b): c for a, b, c in pair_counts(commits, 1000)}
    asked = sorted(counts)[::3] + [("g00", "zz")]
    rows = [(s, len(gs), g, 1, g) for s, gs in commits.items() for g in gs]
    member = spark.createDataFrame(rows, "sha string, _files long, group string, touched long, path string")
    found = history._overlaps(spark.createDataFrame(asked, "ga string, gb string"), member)
    assert {(r.ga, r.gb): r.common for r in found.collect()} == {p: counts[p] for p in asked[:-1]}
    # No pair is joined with a history where all commits are of few files.
    few = history._overlaps(spark.createDataFrame(asked, "ga string, gb string"), member.filter("_files <= 6"))
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan


def test_a_giant_commit_is_not_expanded(spark):
    """All files meet in one commit and have each another one of their own: two giant ones would make 10^10 pairs."""
    n = 100_000
    giant = spark.range(n).selectExpr("'giant' as sha", "format_string('f%06d', id) as path")
    giant = giant.unionByName(giant.withColumn("sha", F.lit("giant2")).filter("path > 'f000009'"))
    own = spark.range(n).selectExpr("concat('s', id div 70) as sha", "format_string('f%06d', (id * 7919) % 100000) as path")
    got = [tuple(r) for r in history.co_change(giant.unionByName(own), 5).orderBy(F.desc("commits"), "left", "right").collect()]
    assert [c for *_, c in got] == [3] * 5 and all(a < b for a, b, _ in got)


def test_two_commits(spark):
    df = spark.createDataFrame([("1", "a.py"), ("1", "b.py"), ("2", "a.py")], "sha string, path string")
    assert [tuple(r) for r in history.hot_files(df).collect()] == [("a.py", 2), ("b.py", 1)]
    assert [tuple(r) for r in history.co_change(df).collect()] == [("a.py", "b.py", 1)]


def test_symbol_ranges_run_to_next_declaration(spark):
    units = spark.createDataFrame(
        [("m", "a", "f", 1, None), ("m", "a", "g", 4, None), ("m", "a", "h", 4, None), ("m", "a", "k", 9, 20)],
        "repo string, path string, name string, line int, end_line int",
    )
    totals = spark.createDataFrame([("m", "a", 30)], "repo string, path string, lines int")
    got = {r.name: r.end for r in history.symbol_ranges(units, totals).collect()}
    assert got == {"f": 3, "g": 4, "h": 8, "k": 20}


def test_search_many_terms_equals_inline(spark, rows):
    n = nodes(spark, [(f"n{i}", "class", f"alpha{i} beta", f"src/gamma{i % 3}.py", i) for i in range(20)])
    q = request(spark, "alpha1 gamma2", "beta ... zzz", "nothing")
    inline = search.search_nodes(n, q, 5)
    windows = search.search_nodes(n, q, 5, inline_limit=0)
    columns = ["query_id", "id", "score", "position"]
    assert rows(inline, *columns) == rows(windows, *columns)
    # A word of punctuation scores every node, so the second question fills its limit.
    assert inline.filter("query_id = 1").count() == 5


def test_path_and_neighbourhood(spark):
    e = edges(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("x", "c", "calls"), ("a", "x", "calls"), ("c", "d", "imports")])
    path = [r.id for r in graph.shortest_path(e, "a", "d").orderBy("position").collect()]
    assert path == ["a", "b", "c", "d"]
    assert graph.shortest_path(e, "a", "zz").count() == 0
    n = nodes(spark, [(i, "function", i, "p", 1) for i in "abcdx"])
    seeds = n.filter("id = 'a'")
    near, inside = graph.neighbourhood(n, e, seeds, depth=1)
    assert {r.id for r in near.collect()} == {"a", "b", "x"} and inside.count() == 2
    few, _ = graph.neighbourhood(n, e, seeds, depth=4, limit=3)
    assert {r.id for r in few.collect()} == {"a", "b", "x"}


def test_regression_gate(spark):
    def metrics(success, ms):
        return spark.createDataFrame(
            [("s", "success_rate", success), ("s", "avg_duration_ms", ms)], "strategy string, metric string, value double"
        )

    worse = quality.gate_report(quality.regression_gate(metrics(0.90, 140.0), metrics(1.0, 100.0))).first()
    assert (worse.passed, worse.violations, worse.compared_metrics) == (False, 2, 2)
    better = quality.gate_report(quality.regression_gate(metrics(1.0, 50.0), metrics(0.9, 100.0))).first()
    assert better.passed


def test_retrieval_quality(spark):
    hits = spark.createDataFrame([(0, 1, "wrong"), (0, 2, "expected"), (0, 3, "other")], "case_id int, rank int, id string")
    expected = spark.createDataFrame([(0, "expected")], "case_id int, id string")
    cases = spark.createDataFrame([(0,), (1,)], "case_id int")
    got = {r.case_id: tuple(r)[1:] for r in quality.retrieval_quality(hits, expected, cases).collect()}
    assert got == {0: (1.0, 1 / 3, 0.5), 1: (1.0, 0.0, 0.0)}


def test_hybrid_puts_named_symbol_first(spark):
    docs = spark.createDataFrame(
        [("auth", "refresh_token authentication session", "src/auth.py", "refresh_token"), ("billing", "invoice payment total", "src/billing.py", "pay")],
        "id string, text string, path string, symbol string",
    )
    embed = retrieval.feature_hash(128)
    vectors = docs.select("id", embed("text").alias("vector"))
    q = request(spark, "refresh_token authentication").withColumn("vector", embed("query"))
    hits = retrieval.hybrid_search(docs, vectors, q).orderBy("position").collect()
    assert hits[0].id == "auth" and hits[0].score > hits[1].score


def test_feature_hash_golden(spark):
    import hashlib
    import math
    import re

    text = "Refresh_token calls src/auth.py twice twice"
    words = [w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_.$:/-]*", text)]
    want = [0.0] * 64
    for feature in words + [f"{a}::{b}" for a, b in zip(words, words[1:])]:
        raw = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
        want[raw % 64] += -1.0 if raw & 1 else 1.0
    norm = math.sqrt(sum(v * v for v in want))
    df = spark.createDataFrame([(text,), ("",)], "t string").select(retrieval.feature_hash(64)("t").alias("v"))
    got = [r.v for r in df.collect()]
    assert got[0] == pytest.approx([v / norm for v in want]) and got[1] == [0.0] * 64


def test_feature_hash_memory_does_not_grow_with_the_batch():
    """Nearly every word pair comes once, so remembering all of a batch takes as much as the batch has words."""
    rng = random.Random(4)
    texts = pd.Series([" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(400)])
    embed = retrieval.feature_hash(64).func
    first = embed(texts[:3])
    tracemalloc.start()
    whole = embed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    assert all((a == b).all() for a, b in zip(first, whole, strict=False))


@pytest.mark.parametrize("cells, passes", [(search.CELLS, search.PASS_TERMS), (20, 7)])
def test_full_text_of_many_terms_hands_on_few_rows(spark, monkeypatch, cells, passes):
    """Scores are added up where the text is, so no row is made for every document and query."""
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "PASS_TERMS", passes)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aAb") for _ in range(rng.randint(3, 5)))
    files = [(f"p/{word()}{i}", " ".join(word() for _ in range(20))) for i in range(150)]
    files += [files[0], (files[1][0], "aaaa aaaaaa"), (None, "aaa bbb"), (None, "aaa"), ("p/aaa", None), ("p/aab", ""), ("q", "ÄÄ aaaa")]
    queries = [(i, " ".join(word() for _ in range(4))) for i in range(30)] + [(None, "aaa bab"), (99, "zzz"), (100, "b")]
    f = spark.createDataFrame(files, "path string, content string").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, query string")
    columns = ["query_id", "path", "score", "position"]
    want = search.full_text(f, q, 5).select(columns).collect()
    found = search.full_text(f, q, 5, inline_limit=0)
    assert sorted(map(repr, found.select(columns).collect())) == sorted(map(repr, want)) and want
    made = []
    group = type(f).groupBy
    monkeypatch.setattr(type(f), "groupBy", lambda frame, *keys: (made.append(frame) if "query_id" in frame.columns else None) or group(frame, *keys))
    search.full_text(f.limit(150).filter("path is not null").dropDuplicates(["path"]).coalesce(1), q, 5, inline_limit=0)
    assert all("term" not in frame.columns and frame.count() <= 5 * len(queries) for frame in made) and made


def test_commits_that_count_their_pairs_are_not_searched(spark, monkeypatch):
    """Where no commit is too wide for its pairs, no pairs are looked for first, and rows hold numbers, not histories."""
    rng = random.Random(12)
    rows = [(f"c{i}", f"f{j:02d}", "x", "y") for i in range(60) for j in rng.sample(range(25), rng.randint(1, 9))]
    rows += [(f"d{i}", f"f{j:02d}", "x", "y") for i in range(5) for j in (90, 91, 92, 93)]
    seen = []
    counted = history._counted
    monkeypatch.setattr(history, "_counted", lambda member: seen.append(member) or counted(member))
    monkeypatch.setattr(history, "_met", lambda *sides: pytest.fail("pairs were looked for"))
    got = [tuple(r) for r in history.co_change(spark.createDataFrame(rows, "sha string, path string, author string, email string"), 12, 3).collect()]
    commits = {}
    for sha, path, *_ in rows:
        commits.setdefault(sha, set()).add(path)
    pairs = Counter((a, b) for files in commits.values() for a in files for b in files if a < b)
    assert got == [(a, b, n) for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:12]]
    assert dict(seen[0].dtypes)["group"] == "bigint"
