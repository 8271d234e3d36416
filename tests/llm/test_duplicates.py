"""Exact and near duplicates, repeated substrings, components."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import exact, jaccard, simhash, substrings
from loomgraph.llm.common import FILE, ROW, bitmaps, located, marked_rows
from loomgraph.llm.components import components


def key(doc_id):
    return (doc_id is None, doc_id or 0)


def test_marked_rows_and_the_others(docs, monkeypatch):
    from loomgraph.llm import common

    rows = located(docs, "doc_id", "text")
    some = rows.where("doc_id % 3 = 0")
    for wave in (common.WAVE_BYTES, 4096):
        monkeypatch.setattr(common, "WAVE_BYTES", wave)
        bits = bitmaps(some.select(FILE, ROW))
        assert marked_rows(rows, bits).exceptAll(some).count() == 0
        assert marked_rows(rows, bits).count() == some.count()
        assert marked_rows(rows, bits, marked=False).count() == rows.count() - some.count()


def test_located_names_rows_of_any_frame(docs):
    doubled = docs.unionByName(docs).withColumn("_metadata", F.lit(1))
    assert located(doubled, "doc_id").select(FILE, ROW).distinct().count() == 2 * docs.count()


@pytest.mark.parametrize("sizes", [(exact.OWNED, exact.SENT), (7, 11)])
def test_exact_classes(docs, rows, monkeypatch, sizes):
    monkeypatch.setattr(exact, "OWNED", sizes[0])
    monkeypatch.setattr(exact, "SENT", sizes[1])
    found = exact.exact_dedup(docs).collect()
    classes = {}
    for doc_id, text, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        classes.setdefault(hashlib.sha256(norm.encode()).hexdigest(), []).append(doc_id)
    want = sorted((key(d), k, key(min(ids, key=key)), len(ids)) for k, ids in classes.items() for d in ids)
    assert sorted((key(r["doc_id"]), r["text_sha256"], key(r["keep_id"]), r["group_size"]) for r in found) == want
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(classes) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_classes_of_staged_and_empty_frames(docs, no_docs):
    assert exact.exact_dedup(docs.unionByName(docs)).where("kept").count() == exact.exact_dedup(docs).where("kept").count()
    assert exact.exact_dedup(no_docs).collect() == []


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, node in enumerate(nodes):
        least[find(i)] = min(least.get(find(i), node), node, key=key)
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
def test_near_duplicates(docs, rows, crowd):
    found = simhash.near_duplicates(docs, crowd).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = brute_components([r[0] for r in rows], fps)
    expected = sorted((key(r[0]), f"{f:016x}", key(c)) for r, f, c in zip(rows, fps, want, strict=True))
    assert sorted((key(r["doc_id"]), r["fingerprint"], key(r["component_id"])) for r in found) == expected
    kept = [r for r in found if r["kept"]]
    assert len({(r["fingerprint"], r["component_id"]) for r in kept}) == len(kept)
    assert all(r["doc_id"] == r["component_id"] for r in kept)
    assert simhash.near_duplicates(docs.where("false"), crowd).collect() == []


@pytest.mark.parametrize("crowd", [simhash.CROWD, 5])
def test_links_join_all_that_is_close(spark, crowd):
    rng = np.random.default_rng(0)
    fps = set()
    for centre in rng.integers(0, 2**63, 8).tolist():
        for _ in range(40):
            bits = rng.integers(0, 64, rng.integers(0, 6)).tolist()
            fps.add(centre ^ sum(1 << b for b in set(bits)))
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    label = {r["node"]: r["component"] for r in components(simhash.links(frame, crowd)).collect()}
    want = brute_components(fps, fps)
    got = [label.get(simhash._signed(x), simhash._signed(x)) for x in fps]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(300, 300), (401, 400), (400, 401)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(101)} == {0} and {found[i] for i in range(200, 260)} == {200}
    assert found[401] == 400 and 300 not in found
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_repeats(rows, length):
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            string = data[i : i + length]
            if string in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(string)
        left = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((key(doc_id), len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), left))
    return out


@pytest.mark.parametrize("segment, held, crowd", [(1 << 19, 1 << 25, 20_000), (500, 3000, 20_000), (700, 1 << 25, 2)])
def test_repeated_substrings_go(docs, rows, monkeypatch, segment, held, crowd):
    monkeypatch.setattr(substrings, "SEGMENT", segment)
    monkeypatch.setattr(substrings, "HELD", held)
    found = substrings.remove_repeats(docs, crowd=crowd).collect()
    # Rows with one id lose their repeats in the order of the table; which of them does not change the counts.
    want = brute_repeats(sorted(((d, t) for d, t, _ in rows), key=lambda r: (*key(r[0]), r[1] is None)), 100)
    got = [(key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found]
    assert sorted(got) == sorted(want)


def test_substrings_of_short_length_and_no_texts(docs, no_docs):
    assert substrings.remove_repeats(no_docs).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, length=20)


@pytest.mark.parametrize("length", [64, 130])
def test_other_lengths(spark, length):
    draw = random.Random(length)
    base = "".join(draw.choice("abc") for _ in range(900))
    rows = [(i, base[(a := draw.randint(0, 700)) : a + draw.randint(50, 200)] + str(i)) for i in range(60)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    got = [(key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found]
    assert sorted(got) == sorted(brute_repeats(rows, length))


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near_copies(rows):
    """The smallest doc_id that each row reaches over similarities of 0.8."""
    sets = [five_words(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return {d: min((e for (e, _), h in zip(rows, group, strict=True) if h == g), key=key) for (d, _), g in zip(rows, group, strict=True)}


def edited(seed=11):
    """Texts with zero to many changed words, one large group of them, a line that most share, and odd texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(12))
    texts = []
    for size, copies in [(100, 40), *[(draw.randint(4, 150), 4)] * 5, *[(draw.randint(4, 400), 3) for _ in range(20)]]:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randint(0, size // 25)):
                text[draw.randrange(size)] = word()
            texts.append(" ".join(text[: size - draw.randint(0, size // 10)] + draw.choice([[], [line]])))
    texts += [None, "", " ", "Two words", "two  WORDS", line, line + " " + word(), line.upper()]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("wider, common, sample", [(jaccard.WIDER, jaccard.COMMON, jaccard.SAMPLE), (2, 5, 20)])
def test_near_copies_equal_all_pairs(spark, tmp_path, monkeypatch, wider, common, sample):
    for name, value in (("WIDER", wider), ("COMMON", common), ("SAMPLE", sample)):
        monkeypatch.setattr(jaccard, name, value)
    rows = edited()
    want = brute_near_copies(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs).collect()} == want
    # The stage keeps the first of each group, and finds more than fingerprints three bits apart.
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(want.values())
    assert len(kept) < simhash.near_duplicates(docs).where("kept").count()
    assert jaccard.near_copies(docs.where("false")).collect() == []


def test_long_texts_that_share_a_line_are_no_pairs(spark, monkeypatch):
    """The sketch of an entry is wide enough to tell them apart, so pairs do not grow with the square of a bucket."""
    draw = random.Random(4)
    line = " ".join(f"line{i}" for i in range(24))
    rows = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(700)) + " " + line) for i in range(12)]
    made, stage_at = {}, jaccard.stage_at

    def counted(frame, label):
        out = stage_at(frame, label)
        made[label] = made.get(label, 0) + out[0].count()
        return out

    monkeypatch.setattr(jaccard, "stage_at", counted)
    monkeypatch.setattr(jaccard, "COMMON", 1)
    found = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["kept"] for r in found) and len(found) == 12
    assert made["pairs"] == 0


def test_near_copies_of_repeated_rows(docs, rows):
    found = jaccard.near_copies(docs).collect()
    want = brute_near_copies([(i, t) for i, (_, t, _) in enumerate(rows)])
    assert len(found) == len(rows) and sum(r["kept"] for r in found) == len(set(want.values()))


def test_near_copies_come_by_fingerprints_first(spark, tmp_path, monkeypatch):
    """The pipeline's stage hands the links of fingerprints to the exact check, which spares what they join."""
    draw = random.Random(8)
    base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(30)] + [(i, f"other{i} text{i}") for i in range(30, 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    asked, verified, near_duplicates = [], [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a: asked.append(1) or near_duplicates(*a))
    check = jaccard._verified

    def counted(pairs, *rest):
        verified.append(pairs.distinct().count())
        return check(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(30, 40)]
    assert len(asked) == 1 and verified[0] >= 20 and sum(verified[1:]) < verified[0]
    # A wrong link does not pass the check.
    judged = located(docs, "doc_id").withColumn("component_id", F.lit(0).cast("long"))
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs, judged).collect()}
    assert found == {i: 0 if i < 30 else i for i in range(40)}


def test_pipeline_drops_what_fingerprints_link(spark, tmp_path):
    """Fingerprints weigh repeats, sets do not: a link of either counts, also by way of the other's."""
    tail = lambda x: " ".join(f"{x}{i}" for i in range(30))
    chant = "one two three " * 600
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(5, chant + tail("a")), (3, chant + tail("b")), (2, chant[14:] + tail("b")), (7, long), (1, long + " more"), (6, "else"), (6, "other"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    near = simhash.near_duplicates(docs)
    exact = jaccard.near_copies(docs, near)
    assert {r["doc_id"] for r in exact.where("kept").collect()} >= {2, 5}
    found = jaccard.united(exact, near).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (1, 1), (2, 2), (3, 2), (5, 2), (6, 6), (6, 6), (7, 1)]
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 6, 6]
