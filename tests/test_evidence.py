"""Evidence scores and invariants over the whole grid, fusion, text functions, positions."""

import itertools

from pyspark.sql import functions as F

from loomgraph.functions import positions, scoring, text
from loomgraph.functions.identity import parse_symbol, qualified_name
from loomgraph.operators import evidence, ops, precise

RECORD = (
    "evidence_id string, kind string, provider string, provenance string, trust string, path string, start_line int, "
    "start_column int, symbol string, content string, confidence double, exact boolean, stale boolean"
)


def grid(spark):
    data = [
        (f"{t}{c}{s}", "reference", "p", "x", t, "a.py", i, 1, "s", "", c, False, s)
        for i, (t, c, s) in enumerate(itertools.product(scoring.TRUST_WEIGHTS, (0.0, 0.25, 0.5, 0.75, 1.0), (False, True)))
    ]
    return spark.createDataFrame(data, RECORD)


def test_stale_never_beats_fresh_structural(spark):
    rows = evidence.scored(grid(spark)).collect()
    fresh = min(r.score for r in rows if not r.stale and r.trust in ("exact", "near_exact", "structural"))
    assert max(r.score for r in rows if r.stale) < fresh
    for tier in scoring.TRUST_WEIGHTS:
        for stale in (False, True):
            scores = [r.score for r in sorted(rows, key=lambda r: r.confidence) if r.trust == tier and r.stale == stale]
            assert scores == sorted(scores) and len(set(scores)) == len(scores)


def test_fusion_keeps_strongest_and_lists_the_rest(spark):
    base = ("reference", "p", "x")
    data = [
        ("e1", *base, "weak", "a.py", 1, 1, "s", "", 0.5, False, False),
        ("e2", *base, "exact", "a.py", 1, 1, "s", "", 0.5, True, False),
        ("e3", *base, "inferred", "b.py", 1, 1, "s", "body", 0.5, False, False),
    ]
    df = spark.createDataFrame(data, RECORD)
    assert {r.evidence_id: r.kept_id for r in evidence.fuse(df).collect()} == {"e1": "e2", "e2": "e2", "e3": "e3"}
    assert [r.evidence_id for r in evidence.conflicts(df).collect()] == ["e2"]
    chunks = {r.chunk_id: r.content for r in evidence.to_chunks(df).collect()}
    assert chunks == {"e2": "[exact] reference a.py:1:1 — s", "e3": "[inferred] reference b.py:1:1 — s\nbody"}


def test_validity(spark):
    cases = [
        ("exact", "precision-index", True, False, None),
        ("weak", "x", True, False, "exact evidence needs the exact tier"),
        ("exact", "x", True, True, "stale evidence cannot be exact"),
        ("exact", "structural-match", False, False, "tier above provenance ceiling"),
        ("inferred_high", "cross-file-heuristic", False, True, None),
    ]
    df = spark.createDataFrame(cases, "t string, p string, e boolean, s boolean, want string")
    got = df.select(scoring.evidence_error(F.col("t"), F.col("p"), F.col("e"), F.col("s")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_trace_summary_and_redaction(spark):
    df = spark.createDataFrame(
        [("t", "tool.search", "ok", 5.0, {"context_tokens": "120", "api_key": "x", "note": "n" * 3000})],
        "trace_id string, name string, status string, duration_ms double, attributes map<string,string>",
    )
    clean = df.withColumn("attributes", scoring.redact(F.col("attributes")))
    row = clean.first()
    assert row.attributes["api_key"] == "[REDACTED]" and len(row.attributes["note"]) == 3000
    summary = ops.trace_summary(clean).first()
    assert (summary.tool_calls, summary.context_tokens) == (1, 120)


def test_feedback_adjustment_signs(spark):
    data = [(i, "good", True, 20.0, i) for i in range(4)] + [(i, "bad", False, 20.0, i) for i in range(4, 8)] + [(9, "few", True, 1.0, 1)]
    df = spark.createDataFrame(data, "event_id int, capability string, success boolean, latency_ms double, created_at int")
    got = {r.capability: r.adjustment for r in ops.feedback_adjustment(df).collect()}
    assert got["good"] > 0 > got["bad"] and got["few"] == 0.0


def test_text_functions(spark):
    row = spark.createDataFrame([("Find (the) RUN... of a.b, x",)], "q string").select(
        text.graph_terms(F.col("q")).alias("g"), text.context_terms(F.col("q")).alias("c"), text.hybrid_terms(F.col("q")).alias("h")
    ).first()
    assert row.g == ["find", "the", "run", "a.b"] and row.c == ["find", "the", "run", "a.b"]
    assert row.h == ["find", "the", "run...", "of", "a.b", "x"]
    paths = spark.createDataFrame([("src/my-App/x.py",), ("src/lib/x.py",), ("x.py",)], "p string")
    assert [r.z for r in paths.select(text.zone(F.col("p")).alias("z")).collect()] == ["my_app", "root", "root"]
    names = spark.createDataFrame([("./a/b.py",), ("..\\a\\b.ts",), ("pkg.mod",)], "n string")
    assert [r.d for r in names.select(text.normalize_dependency(F.col("n")).alias("d")).collect()] == ["a/b", "a/b", "pkg/mod"]
    pins = spark.createDataFrame([("/o/r", "1.0"), ("/o/r@2", "1.0"), ("/o/r/v1.0/", "1.0"), ("/o/r", None)], "l string, v string")
    got = [r.p for r in pins.select(text.pin_library(F.col("l"), F.col("v")).alias("p")).collect()]
    assert got == ["/o/r/1.0", "/o/r@2", "/o/r/v1.0", "/o/r"]


LINES = ("plain ascii", "é = naïve", "😀 ok 😀", "")


def units_before(line, encoding):
    width = {"utf8": lambda c: len(c.encode()), "utf16": lambda c: 2 if ord(c) > 0xFFFF else 1, "utf32": lambda c: 1}[encoding]
    out = [0]
    for c in line:
        out.append(out[-1] + width(c))
    return out


def test_position_grid(spark):
    data = [(line, enc, col) for line in LINES for enc in ("utf8", "utf16", "utf32") for col in range(16)]
    df = spark.createDataFrame(data, "line string, enc string, col int")
    out = df.select(
        "*",
        positions.to_character(F.col("line"), F.col("col"), F.col("enc")).alias("c"),
        positions.to_protocol(F.col("line"), F.col("col"), F.col("enc")).alias("p"),
    )
    for r in out.collect():
        offsets = units_before(r.line, r.enc)
        if r.enc == "utf32" or r.col == 0:
            want = (r.col, False)
        elif r.col >= offsets[-1]:
            want = (len(r.line) + r.col - offsets[-1], False)
        elif r.col in offsets:
            want = (offsets.index(r.col), False)
        else:
            want = (max(i for i, o in enumerate(offsets) if o < r.col), True)
        assert (r.c.column, r.c.ambiguous) == want, r
        if r.enc == "utf32":
            assert r.p == r.col
        else:
            assert r.p == (offsets[r.col] if r.col < len(offsets) else offsets[-1] + r.col - len(r.line)), r


def test_symbol_identity(spark):
    symbols = ["x pip a  b 1 src/`m#n`#run(+1).", "local 4", "x pip a", "x pip a 1 src/?", "", "x . . . K#[T](p)"]
    df = spark.createDataFrame([(s,) for s in symbols], "s string").select(parse_symbol(F.col("s")).alias("i"))
    got = [r.i for r in df.collect()]
    assert (got[0].package, [d.name for d in got[0].descriptors], got[0].descriptors[2].disambiguator) == ("a b", ["src", "m#n", "run"], "+1")
    assert [d.kind for d in got[0].descriptors] == ["namespace", "type", "method"]
    assert got[1].is_local and got[1].descriptors[0].name == "4"
    assert all(got[i].parse_error for i in (2, 3, 4)) and not got[5].parse_error
    assert [d.kind for d in got[5].descriptors] == ["type", "type_parameter", "parameter"]
    assert df.select(qualified_name(F.col("i.descriptors")).alias("q")).first().q == "src.m#n.run"


def test_caret_half_open_and_tightest(spark):
    occ = spark.createDataFrame(
        [("m", "f", "a", 0, 0, 0, 1, 8), ("m", "f", "b", 0, 2, 0, 3, 8), ("m", "f", "outer", 0, 0, 2, 5, 8)],
        "repo string, path string, symbol string, start_line int, start_col int, end_line int, end_col int, roles int",
    )
    carets = spark.createDataFrame(
        [(1, "m", "f", 0, 0), (2, "m", "f", 0, 1), (3, "m", "f", 0, 2), (4, "m", "f", 2, 5), (5, "m", "f", 1, 900)],
        "caret_id int, repo string, path string, line int, col int",
    )
    got = {r.caret_id: r.symbol for r in precise.occurrence_at(carets, occ).collect()}
    assert got == {1: "a", 2: "outer", 3: "b", 4: None, 5: "outer"}


def test_ambiguous_position_is_not_exact(spark):
    occ = spark.createDataFrame(
        [("m", "f", "x p k 1 S#", 0, 4, 0, 5, 1), ("m", "f", "x p k 1 S#", 1, 0, 1, 1, 8)],
        "repo string, path string, symbol string, start_line int, start_col int, end_line int, end_col int, roles int",
    )
    lines = spark.createDataFrame([("m", "f", 0, "é é S"), ("m", "f", 1, "S()")], "repo string, path string, line int, text string")
    carets = spark.createDataFrame([(1, "m", "f", 2, 1)], "caret_id int, repo string, path string, line int, column int")
    info = spark.createDataFrame(
        [], "repo string, path string, symbol string, relationships array<struct<symbol:string,is_implementation:boolean>>"
    )
    for authoritative, stale, want in ((True, False, ("exact", 1.0)), (False, False, ("inferred_high", 0.8)), (True, True, ("inferred_high", 0.55))):
        docs = spark.createDataFrame([("m", "f", "utf32", authoritative, stale)], "repo string, path string, encoding string, authoritative boolean, stale boolean")
        row = precise.caret_evidence(carets, occ, info, docs, lines).first()
        assert (row.trust, row.confidence) == want
        assert (row.start_line, row.start_column, row.symbol) == (1, 5, "S")


def test_definitions_are_described_before_carets_multiply_them(spark):
    """The join of carets and definitions is the last one, so lines and documents are read once a definition."""
    occ = spark.createDataFrame(
        [("m", f"f{i}", "x p k 1 S#", 0, 6, 0, 7, 1) for i in range(3)] + [("m", "f0", "x p k 1 S#", 1, 0, 1, 1, 8)],
        "repo string, path string, symbol string, start_line int, start_col int, end_line int, end_col int, roles int",
    )
    info = spark.createDataFrame(
        [], "repo string, path string, symbol string, relationships array<struct<symbol:string,is_implementation:boolean>>"
    )
    lines = spark.createDataFrame([("m", f"f{i}", 0, "é é S") for i in (0, 1)] + [("m", "f0", 1, "S()")], "repo string, path string, line int, text string")
    carets = spark.createDataFrame([(i, "m", "f0", 2, 1) for i in range(50)], "caret_id int, repo string, path string, line int, column int")
    docs = spark.createDataFrame([("m", f"f{i}", "utf8", True, i == 1) for i in range(3)], "repo string, path string, encoding string, authoritative boolean, stale boolean")
    found = precise.caret_evidence(carets, occ, info, docs, lines)
    got = sorted((r.caret_id, r.path, r.start_column, r.end_column, r.trust, r.confidence, r.symbol, r.target_symbol) for r in found.collect())
    one = [("f0", 5, 6, "exact", 1.0), ("f1", 5, 6, "inferred_high", 0.55), ("f2", 7, 8, "inferred_high", 0.8)]
    assert got == [(i, *row, "S", "x p k 1 S#") for i in range(50) for row in one]
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "_key" in plan.condition().get().toString()
