"""What a repository is made of: languages, package systems, entry points, layers, tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scoring import lookup
from loomgraph.functions.text import EXCLUDED_DIRECTORIES, base_name, path_parts, suffix

# Language names by suffix.
LANGUAGE_NAMES = {
    ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".c": "C", ".h": "C/C++", ".cc": "C++", ".cpp": "C++",
    ".cxx": "C++", ".hpp": "C++", ".cs": "C#", ".php": "PHP", ".rb": "Ruby",
}
# Package systems by file name.
PACKAGE_FILES = {
    "pyproject.toml": "Python/pip", "requirements.txt": "Python/pip", "package.json": "Node.js",
    "pnpm-lock.yaml": "pnpm", "yarn.lock": "Yarn", "go.mod": "Go modules", "Cargo.toml": "Cargo",
    "pom.xml": "Maven", "build.gradle": "Gradle", "composer.json": "Composer", "Gemfile": "Bundler",
}
# Texts that reveal a test framework, in lower case.
TEST_MARKERS = {
    "pytest": ("pytest.ini", "conftest.py", "pytest"),
    "vitest": ("vitest.config", "vitest"),
    "jest": ("jest.config", "jest"),
    "go test": ("_test.go",),
    "cargo test": ("#[test]",),
    "JUnit": ("junit", "@test"),
    "RSpec": ("spec_helper", "rspec"),
}
# Layers by folder name.
LAYER_FOLDERS = {
    "controllers": "controller layer", "controller": "controller layer", "services": "service layer",
    "service": "service layer", "repositories": "repository layer", "repository": "repository layer",
    "models": "model layer", "domain": "domain layer", "api": "API layer", "routes": "routing layer",
    "adapters": "adapter layer", "ports": "ports layer", "core": "core layer",
    "infra": "infrastructure layer", "infrastructure": "infrastructure layer",
}
# Names of program entry files.
ENTRY_NAMES = (
    "main.py", "app.py", "manage.py", "index.js", "index.ts", "server.js", "server.ts", "main.go",
    "main.rs", "Program.cs", "Main.java",
)


def project_knowledge(files: DataFrame, hot_files: DataFrame | None = None) -> DataFrame:
    """Facts as ``repo, fact, value, count`` rows. ``files``: ``repo, path, content, size``.

    Framework markers become one boolean each, OR-ed map-side, so texts are read once and
    never shuffled.
    """
    folders = F.split("path", "/")
    excluded = F.array(*[F.lit(d) for d in EXCLUDED_DIRECTORIES if d != "__pycache__"])
    kept = files.filter(~F.arrays_overlap(folders, excluded))
    name = base_name(F.col("path"))

    def fact(rows: DataFrame, label: str) -> DataFrame:
        return rows.groupBy("repo", "value").agg(F.count("*").alias("count")).select(
            "repo", F.lit(label).alias("fact"), "value", "count"
        )

    def valued(value) -> DataFrame:
        return kept.select("repo", value.alias("value")).filter("value is not null")

    parts = F.slice(path_parts(F.col("path")), F.lit(1), F.greatest(F.size(path_parts(F.col("path"))) - 1, F.lit(0)))
    layers = F.filter(F.transform(parts, lambda p: lookup(LAYER_FOLDERS, F.lower(p))), lambda x: x.isNotNull())
    low_name = F.lower(name)
    text = F.lower("content")

    def revealed(markers):
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(low_name, F.lit(marker)) | F.coalesce(F.contains(text, F.lit(marker)), F.lit(False))
        return F.bool_or(hit)

    frameworks = kept.groupBy("repo").agg(*[revealed(m).alias(n) for n, m in TEST_MARKERS.items()])
    tests = frameworks.unpivot("repo", list(TEST_MARKERS), "value", "used").filter("used").select(
        "repo", F.lit("test_framework").alias("fact"), "value", F.lit(1).cast("long").alias("count")
    )
    facts = [
        fact(valued(lookup(LANGUAGE_NAMES, suffix(F.col("path")))), "language"),
        fact(valued(lookup(PACKAGE_FILES, name)), "package_system"),
        fact(kept.filter(name.isin(*ENTRY_NAMES)).select("repo", F.col("path").alias("value")), "entry_point"),
        fact(kept.select("repo", F.explode(layers).alias("value")), "architecture"),
        tests,
    ]
    if hot_files is not None:
        order = Window.partitionBy("repo").orderBy(F.desc("changes"), "path")
        top = hot_files.withColumn("_rn", F.row_number().over(order)).filter("_rn <= 10")
        facts.append(top.select("repo", F.lit("hot_file").alias("fact"), F.col("path").alias("value"), F.col("changes").alias("count")))
    return reduce(DataFrame.unionByName, facts)
