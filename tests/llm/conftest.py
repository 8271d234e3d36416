"""Small tables with every awkward case: nulls, empty and long texts, repeated rows, clashing names."""

import random

import pytest

CLASHES = "h long, norm string, key long, score double, size long, kept boolean, keeper string, copies long, target double, n long"


def texts(seed: int = 3, rows: int = 60) -> list[tuple]:
    """(doc_id, text, source): passages dealt from one string, copies, repeats and odd texts."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeéfgh") for _ in range(draw.randint(1, 9))) for _ in range(400)]
    base = " ".join(draw.choice(words) for _ in range(2000))
    out = []
    for i in range(rows):
        parts = []
        for _ in range(draw.randint(1, 4)):
            at = draw.randint(0, len(base) - 400)
            parts.append(base[at : at + draw.randint(20, 400)])
        out.append((i * 7, " ".join(parts), draw.choice(["a", "b", "ü", None])))
    out += [(1000, None, "a"), (1001, "", "b"), (1002, " \t\n", None), (1003, "Word", "c"), (None, "no id", "a"), (None, None, None)]
    out += [(2000, base * 4, "a"), (2001, out[3][1].replace(" ", " \t "), "a"), (2002, out[3][1].upper(), "a")]
    out += [out[5], out[5], (5, out[5][1], "b"), (2003, "ab" * 3000, "a"), (2004, "x" * 700 + "y" + "x" * 700, "b")]
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The rows as Parquet files, with extra columns that operators may use themselves."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    extra = [f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASHES.split(", ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    frame.selectExpr("*", *extra).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
