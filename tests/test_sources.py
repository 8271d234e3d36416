"""Readers: file trees, JSON lines, commit logs, diffs, blame, manifests, stores."""

import json

from pyspark.sql import functions as F

from loomgraph.operators import dependencies
from loomgraph.session import shared_path
from loomgraph.sources import diffs, files, gitlog, jsonl, manifests, stores


def write(folder, name, text):
    target = folder / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_file_tree(spark, tmp_path):
    for name in ("src/a.py", "node_modules/x.js", "b/.git/config", "big.txt", "raw.bin"):
        write(tmp_path, name, b"\xff\xfe" if name == "raw.bin" else "x" * (500 if name == "big.txt" else 3))
    got = files.scan_files(files.read_files(spark, str(tmp_path), "r"), 100)
    assert {r.path for r in got.collect()} == {"src/a.py", "raw.bin"}
    assert got.filter("path = 'raw.bin'").first().content is None
    assert got.filter("path = 'src/a.py'").first().content == "xxx"
    extra = files.scan_files(got, extra_excluded=("src",))
    assert {r.path for r in extra.collect()} == {"raw.bin"}


def test_logs(spark, tmp_path):
    span = {"trace_id": "t", "span_id": "s", "name": "tool.search", "status": "ok", "started_at": "1", "ended_at": "2", "duration_ms": 3, "attributes": {"context_tokens": 120}}
    lines = [json.dumps({"version": 1, "span": span}), "{oops", json.dumps({"version": 2, "span": span}), json.dumps({"version": 1, "span": {"name": "x"}})]
    write(tmp_path, "spans.jsonl", "\n".join(lines))
    got = jsonl.parse_spans(jsonl.read_lines(spark, str(tmp_path))).collect()
    assert len(got) == 1 and got[0].attributes == {"context_tokens": "120"} and got[0].parent_id is None
    back = jsonl.parse_spans(jsonl.parse_spans(jsonl.read_lines(spark, str(tmp_path))).select(jsonl.span_line().alias("value")))
    assert back.count() == 1
    events = spark.createDataFrame([('{"name": "a", "timestamp": 1.5, "attributes": {"k": 2}}',), ("nope",)], "value string")
    assert jsonl.parse_telemetry(events).first().attributes == {"k": "2"}
    calls = spark.createDataFrame([('{"path": "/x", "status": 500, "duration_ms": 2.5}',)], "value string")
    assert jsonl.parse_requests(calls).first().status == 500


def test_commit_log(spark, tmp_path):
    text = "@@abc|Ann|a@x|2024-01-01T00:00:00+00:00\n\nsrc/a.py\nsrc/b.py\n\n@@def|Bob|b@x|2024-01-02T00:00:00+00:00\n\nsrc/a.py\n@@eee|Cy|c@x|2024-01-03T00:00:00+00:00\n"
    write(tmp_path, "log.txt", text)
    got = gitlog.parse_commit_log(gitlog.read_commit_log(spark, str(tmp_path))).collect()
    assert sorted((r.sha, r.author, r.path) for r in got if r.path) == [
        ("abc", "Ann", "src/a.py"), ("abc", "Ann", "src/b.py"), ("def", "Bob", "src/a.py"),
    ]
    assert [r.sha for r in got if r.path is None] == ["eee"]
    lines = spark.createDataFrame([("s|a|e|d|subject | with bar",), ("short|line",)], "value string")
    assert [r.subject for r in gitlog.parse_history_lines(lines).collect()] == ["subject | with bar"]


def test_blame(spark):
    text = (
        "0123456789abcdef 1 1 2\nauthor Ann\nauthor-mail <a@x>\nauthor-time 17\nfilename f\n\tline one\n"
        "^123456789abcdef 2 2\nauthor Bob\nauthor-mail <b@x>\nauthor-time 18\nfilename f\n\tline two\n"
    )
    got = gitlog.parse_blame(spark.createDataFrame([("f", text)], "path string, value string")).orderBy("line").collect()
    assert [(r.line, r.author, r.email, r.timestamp, r.content) for r in got] == [(1, "Ann", "a@x", 17, "line one"), (2, "Bob", "b@x", 18, "line two")]


def test_diff(spark, tmp_path):
    patch = (
        "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-a\n+b\n+c\n@@ -9,2 +10,0 @@\n-gone\n"
        "diff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n@@ -3 +5 @@ def f():\n+z\n"
    )
    write(tmp_path, "p.diff", patch)
    hunks = diffs.parse_hunks(diffs.read_patch(spark, str(tmp_path)))
    assert sorted((r.path, r.start, r.end) for r in hunks.collect()) == [("x.py", 1, 2), ("y.py", 5, 5)]
    stat = spark.createDataFrame([("2\t1\tx.py",), ("-\t-\tbin.png",)], "value string")
    status = spark.createDataFrame([("A\ty.py",), ("R90\told.py\tx.py",)], "value string")
    got = {r.path: tuple(r)[1:] for r in diffs.file_changes(diffs.parse_numstat(stat), diffs.parse_name_status(status), hunks).collect()}
    assert got == {"x.py": ("R90", 2, 1, 1), "bin.png": ("M", 0, 0, 0), "y.py": ("A", 0, 0, 1)}


MANIFESTS = {
    "pyproject.toml": '[project]\ndependencies = ["requests>=2; python_version > \'3\'", "rich"]\n[project.optional-dependencies]\ndev = ["pytest==8"]\ndocs = ["mkdocs"]\n[tool.poetry.dependencies]\npython = "^3"\nflask = {version = "^3.0", extras = ["x"]}\n',
    "poetry.lock": '[[package]]\nname = "requests"\nversion = "2.31.0"\n',
    "Pipfile": '[packages]\ndjango = "*"\n[dev-packages]\nblack = {version = "==24"}\n',
    "Pipfile.lock": '{"default": {"django": {"version": "==5.0"}}, "develop": {}}',
    "web/package-lock.json": '{"packages": {"": {"version": "1"}, "node_modules/left-pad": {"version": "1.3.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}}}',
    "old/package-lock.json": '{"dependencies": {"q": {"version": "1.0"}, "r": {}}}',
    "pnpm-lock.yaml": "importers:\n  .:\n    dependencies:\n      react:\n        specifier: ^18\n        version: 18.2.0(x@1)\n      '@s/c':\n        version: 1.1.0\n",
    "yarn.lock": '# yarn\n\n"@babel/core@^7.0.0", "@babel/core@^7.1":\n  version "7.2.0"\n  dependencies:\n    x "1"\n\nleft-pad@1:\n  version "1.3.0"\n',
    "go.sum": "a.com/b v1.0.0 h1:x\na.com/b v1.0.0/go.mod h1:y\n",
    "app/x.csproj": '<Project><ItemGroup><PackageReference Include="N" Version="1.2" /></ItemGroup></Project>',
    "packages.lock.json": '{"dependencies": {"net8": {"N": {"resolved": "1.2.0"}}}}',
    "Directory.Packages.props": '<Project><PackageVersion Include="P" Version="3"/></Project>',
    "build.gradle": "implementation 'g:a:1.0'\ntestImplementation \"g:a:2.0\"\n",
    "requirements/dev.txt": "black==24  # style\n-r base.txt\n",
    "bad/pyproject.toml": "[[[",
    "evil/pom.xml": "<!DOCTYPE x><project/>",
    "a/b/c/d/e/go.mod": "require x.com/y v1\n",
    "node_modules/p/package.json": '{"dependencies": {"z": "1"}}',
}


def test_manifests(spark):
    df = spark.createDataFrame([("m", p, t) for p, t in MANIFESTS.items()], "repo string, path string, content string")
    parsed = manifests.parse_manifests(df)
    reports = {r.path: r for r in manifests.manifest_reports(parsed).collect()}
    assert set(MANIFESTS) - set(reports) == {"node_modules/p/package.json"}
    assert {p for p, r in reports.items() if not r.parsed} == {"bad/pyproject.toml", "evil/pom.xml"}
    got = {(r.manifest, r.name, r.declared, r.resolved, r.scope) for r in manifests.dependency_records(parsed).collect()}
    assert got == {
        ("a/b/c/d/e/go.mod", "x.com/y", "v1", None, "runtime"),
        ("pyproject.toml", "requests", ">=2", None, "runtime"), ("pyproject.toml", "rich", None, None, "runtime"),
        ("pyproject.toml", "pytest", "==8", None, "development"), ("pyproject.toml", "mkdocs", None, None, "optional"),
        ("pyproject.toml", "flask", "^3.0", None, "runtime"), ("poetry.lock", "requests", None, "2.31.0", "runtime"),
        ("Pipfile", "django", None, None, "runtime"), ("Pipfile", "black", "==24", None, "development"),
        ("Pipfile.lock", "django", None, "5.0", "runtime"), ("web/package-lock.json", "left-pad", None, "1.3.0", "runtime"),
        ("web/package-lock.json", "@s/b", None, "2.0.0", "runtime"), ("old/package-lock.json", "q", None, "1.0", "runtime"),
        ("pnpm-lock.yaml", "react", None, "18.2.0", "runtime"), ("pnpm-lock.yaml", "@s/c", None, "1.1.0", "runtime"),
        ("yarn.lock", "@babel/core", None, "7.2.0", "runtime"), ("yarn.lock", "left-pad", None, "1.3.0", "runtime"),
        ("go.sum", "a.com/b", None, "v1.0.0", "runtime"), ("app/x.csproj", "N", "1.2", None, "runtime"),
        ("packages.lock.json", "N", None, "1.2.0", "runtime"), ("Directory.Packages.props", "P", "3", None, "runtime"),
        ("build.gradle", "g:a", "1.0", None, "runtime"), ("requirements/dev.txt", "black", "==24", None, "development"),
    }
    merged = {r.name: r for r in dependencies.merge_inventory(manifests.dependency_records(parsed)).collect()}
    assert (merged["requests"].declared, merged["requests"].resolved) == (">=2", "2.31.0")
    assert merged["N"].declared == "1.2" and merged["N"].resolved == "1.2.0"


def test_versions(spark):
    available = spark.createDataFrame([("l", "v15.1.8", 0), ("l", "2.0.0-rc.1", 1)], "library string, version string, ordinal int")
    asked = spark.createDataFrame(
        [("l", "15.1.8"), ("l", "v15.1.8"), ("l", "2.0.0"), ("l", " "), ("none", "1")], "library string, requested string"
    )
    got = {r.requested: (r.match, r.provider_version) for r in dependencies.select_versions(asked, available).collect()}
    assert got == {
        "15.1.8": ("normalized", "v15.1.8"), "v15.1.8": ("exact", "v15.1.8"), "2.0.0": ("fallback", None),
        " ": ("unversioned", None), "1": ("unmatched", None),
    }


def test_revision_store(spark):
    path = shared_path(spark, "graph")
    schema = "repo string, revision string, created_at long, id string"
    stores.write_revision(spark.createDataFrame([("a", "r1", 1, "x"), ("a", "r2", 2, "y"), ("b", "r1", 1, "z")], schema), path)
    stores.write_revision(spark.createDataFrame([("a", "r1", 3, "w")], schema), path)
    stored = spark.read.parquet(path)
    assert sorted(r.id for r in stored.collect()) == ["w", "y", "z"]
    assert {r.repo: r.revision for r in stores.latest_revision(stored).collect()} == {"a": "r1", "b": "r1"}
    kept = stores.prune_revisions(stores.list_revisions(stored), 0)
    assert sorted((r.repo, r.revision) for r in kept.collect()) == [("a", "r1"), ("b", "r1")]


def test_vectors_and_metrics(spark):
    data = [([1.0, 2.0],), ([],), ([float("nan")],), ([0.0, 0.0],), (None,)]
    df = spark.createDataFrame(data, "v array<double>")
    assert [r.e for r in df.select(stores.vector_error(F.col("v")).alias("e")).collect()] == [None, "empty", "not finite", "all zeros", "empty"]
    nested = spark.createDataFrame([('{"a": {"b": 1, "c": [true, null, "x"]}, "d": 2.5}',), ("broken",)], "j string")
    got = [{(m.metric, m.value) for m in r.m} for r in nested.select(stores.flatten_metrics("j").alias("m")).collect()]
    assert got == [{("a.b", 1.0), ("a.c[0]", 1.0), ("a.c[1]", None), ("d", 2.5)}, set()]
