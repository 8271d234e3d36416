"""Quality classifier, embedding whitening and spelling variants against plain versions."""

import random
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import quality, variants, whitening

# Quality


def plain_words(text):
    """Runs of one kind of byte, case kept."""
    out, last = [], 0
    for byte in (text or "").encode():
        kind = quality.KINDS[byte]
        if kind and kind == last:
            out[-1] += bytes([byte])
        elif kind:
            out.append(bytes([byte]))
        last = kind
    return out


TEXTS = ["The cat. The CAT!! 12 caté", None, "", " \t ", "x", "a" * 50, "éé ß-ß", "The cat. The CAT!! 12 caté", "1a2b", "  lead", "trail  "]


@pytest.mark.parametrize("part", [1 << 20, 64])
def test_words_are_runs_of_one_kind(monkeypatch, part):
    monkeypatch.setattr(quality, "PART", part)
    buckets, counts = quality.word_buckets(pa.array(TEXTS, pa.string()))
    words = [plain_words(t) for t in TEXTS]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    seen = {}
    for word, bucket in zip(flat, buckets.tolist(), strict=True):
        assert seen.setdefault(word, bucket) == bucket and 0 <= bucket < quality.BUCKETS
    assert len(set(seen.values())) == len(seen)
    # A slice of an array starts inside its buffers.
    later, _ = quality.word_buckets(pa.array(TEXTS, pa.string())[4:])
    assert later.tolist() == buckets[counts[:4].sum() :].tolist()


def test_long_texts_are_cut_into_words_part_by_part(monkeypatch):
    long = "word, Word " * 40
    whole, n = quality.word_buckets(pa.array([long, "end"]))
    monkeypatch.setattr(quality, "PART", 11)
    parts, m = quality.word_buckets(pa.array([long, "end"]))
    assert whole.tolist() == parts.tolist() and n.tolist() == m.tolist() == [120, 1]


def test_context_sums_count_neighbours_on_both_sides():
    draw = random.Random(4)
    documents = [[draw.randrange(9) for _ in range(n)] for n in (0, 1, 2, 7, 30)]
    index = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for d in documents:
        for i, word in enumerate(d):
            for j in range(max(0, i - quality.WINDOW), min(len(d), i + quality.WINDOW + 1)):
                if i != j:
                    want[word] += index[d[j]]
    flat = quality.bordered(np.array([w for d in documents for w in d], np.int32), np.array([len(d) for d in documents]))
    assert (quality.context_sums(flat, flat, index) == want).all()
    assert (np.abs(index[:-1]).sum(axis=1) == quality.SPARSE).all() and not index[-1].any()


@pytest.mark.parametrize("block", [1 << 13, 4])
def test_pooling(monkeypatch, block):
    monkeypatch.setattr(quality, "WORDS", block)
    rng = np.random.default_rng(3)
    vectors = np.rint(rng.normal(0, 9, (50, 6)))
    documents = [rng.integers(0, 50, n) for n in (3, 0, 1, 9, 20)]
    got = quality.pooled(np.concatenate(documents).astype(np.int32), np.array([len(d) for d in documents]), vectors)
    for row, d in zip(got, documents, strict=True):
        v = vectors[d] / quality.FINE
        want = [np.zeros(6), np.zeros(6), 0, 0]
        if len(d):
            want = [v.mean(axis=0), v.std(axis=0), *((v[k:] * v[:-k]).sum() / len(d) if len(d) > k else 0 for k in (1, 2))]
        assert np.allclose(row, np.concatenate([np.atleast_1d(x) for x in want]), atol=1e-5)


def test_network_learns_what_no_line_parts():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    network = quality.train(x, y)
    assert ((quality.scores(network.plain(), x) > 0.5) == y).mean() > 0.95


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 20_000)
    y = (rng.uniform(size=z.size) < 1 / (1 + np.exp(-z))).astype(int)
    assert quality.temperature_for(3 * z, y) == pytest.approx(3, rel=0.1)
    assert 0.05 < quality.temperature_for(np.where(y, 9.0, -9.0), y) < 16


def corpus(n=600):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdeghilmnorstu") for _ in range(draw.randint(2, 7))) for _ in range(80)]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(20, 90))]
        kind = i % 8
        text = {0: " ".join(w.upper() + "!!" for w in words), 1: " | ".join(words), 2: " ".join([words[0]] * 40)}.get(kind, " ".join(words) + ".")
        rows.append((i, text, None, "x"))
        labels.append((i, int(kind > 2)))
    rows += [(n, None, 1.0, "x"), (n + 1, "", 1.0, "x"), (n + 2, " \n", 1.0, "x"), (None, rows[3][1], None, "x"), (3, rows[3][1], None, "x")]
    return rows, labels + [(0, 0), (9, None), (None, 1), (n + 9, 1), (17, 7)]


@pytest.fixture(scope="module")
def graded(spark):
    rows, labels = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string").repartition(3)
    return rows, labels, quality.quality(frame, spark.createDataFrame(labels, "doc_id long, quality int"), 0.3)


def test_quality_of_held_out_rows(graded):
    rows, labels, frame = graded
    found = frame.collect()
    assert sorted((r["doc_id"], r["text"]) for r in found if r["text"] and r["doc_id"] is not None) == sorted((i, t) for i, t, *_ in rows if t and i is not None)
    truth = dict(labels[:600])
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
    assert len({r["score"] for r in found if not (r["text"] or "").strip()}) == 1
    assert len({r["score"] for r in found if r["text"] == rows[3][1]}) == 1


def test_quality_without_labels_or_rows(spark, graded):
    rows, labels, _ = graded
    frame = spark.createDataFrame([r[:2] for r in rows[:20]], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(frame, none).collect()} == {0.5}
    assert quality.quality(frame.where("false"), none).collect() == []
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert len({r["score"] for r in quality.quality(frame, one).collect()}) == 1


def test_word_vectors_do_not_depend_on_partitions(spark):
    frame = spark.createDataFrame([(t,) for t, in [(r[1],) for r in corpus(60)[0]]], "text string")
    assert (quality.word_vectors(frame.coalesce(1)) == quality.word_vectors(frame.repartition(5))).all()


# Whitening


def vectors(seed=5, n=70, dim=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (n, dim)) @ rng.normal(0, 1, (dim, dim))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    # A vector that a third of the rows share, repeated ids, and rows that play no part.
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [rows[1], (None, rows[2][1])]
    return rows + [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * dim), (203, [float("inf")] * dim), (204, [])]


def plain_whitening(rows, components, weights=True):
    kept = [(k, v) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    fit = x if weights else np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    y = ((x * n - sums) / n).astype(float) @ axes / np.sqrt(values)
    return kept, n, ((x * n - sums) ** 2).sum(axis=1), y, values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("weights", [True, False])
def test_whitening_equals_plain_version(spark, weights):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<double>, n double, whitened string")
    found = whitening.whiten(frame, components=4, multiplicity=weights).collect()
    kept, n, deviations, y, shares = plain_whitening(rows, 4, weights)
    assert len(found) == 4 * len(kept)
    assert Counter(r["vec_id"] for r in found) == Counter({k: 4 * c for k, c in Counter(k for k, _ in kept).items()})
    at = {k: i for i, (k, _) in enumerate(kept)}
    signs = {}
    for r in found:
        i, c = at[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, Decimal(int(deviations[i])))
        assert abs(r["whitened"]) == pytest.approx(abs(y[i, c]), abs=1e-9) and r["explained"] == pytest.approx(shares[c])
        if abs(y[i, c]) > 1e-6:
            assert signs.setdefault(c, np.sign(r["whitened"] * y[i, c])) == np.sign(r["whitened"] * y[i, c])
        assert r["identity_error"] < 1e-10


def test_lengths_are_fitted_apart_and_flat_directions_left_out(spark):
    one, other = [(i, [float(i % 7), float(i % 3)]) for i in range(30)], [(100 + i, [float(i), 1.0, 2.0 * i]) for i in range(9)]
    frame = spark.createDataFrame(one + other + [(999, [1.0])], "vec_id long, embedding array<float>")
    found = whitening.whiten(frame).collect()
    got = {k: sorted((r["vec_id"], r["component"], abs(r["whitened"])) for r in found if (r["vec_id"] < 100) == k) for k in (True, False)}
    for k, rows, width in ((True, one, 2), (False, other, 1)):
        kept, _, _, y, _ = plain_whitening(rows, width)
        want = sorted((key, c + 1, abs(y[i, c])) for i, (key, _) in enumerate(kept) for c in range(width))
        assert [g[:2] for g in got[k]] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got[k]], [w[2] for w in want], atol=1e-9)
    assert whitening.whiten(frame.where("false")).collect() == []
    assert whitening.whiten(frame.where("vec_id = 3")).collect() == []


def test_deviations_beyond_longs_stay_exact(spark):
    rows = [(i, [1e12 * i, -3.0 * i]) for i in range(6)] + [(9, [1e300, 0.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    x = [[int(np.floor(max(min(64 * c, 2.0**52), -(2.0**52)))) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {k: sum((7 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for (k, _), v in zip(rows, x, strict=True)}
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == want


@pytest.mark.parametrize("heavy", [1024, 2])
def test_common_vectors_are_joined_like_others(spark, monkeypatch, heavy):
    monkeypatch.setattr(whitening, "HEAVY", heavy)
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    assert whitening.whiten(frame).count() == 5 * 112


# Spelling variants


def plain_variants(rows, least_length=5, least_count=3):
    counts = Counter()
    letters = {chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c in letters:
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            for c in {x for v in words for x in v}:
                for v in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :] if i < len(w) else w):
                    if v != w and v in words:
                        near[w].add(v)
                        near[v].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v))
        if words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


def word_rows(seed, syllables=("ana", "ban", "ché", "an", "Na", "é", "ñ")):
    draw = random.Random(seed)
    words = ["".join(draw.choice(syllables) for _ in range(draw.randint(2, 4))) for _ in range(60)]
    rows = [(i, " ".join(draw.choice(words) + draw.choice(["", "", "s", "ÿ", "-x"]) for _ in range(60))) for i in range(50)]
    return rows + [(None, rows[0][1]), (7, None), (8, ""), (7, rows[7][1]), (9, "ab" * 3000), (10, "ANANAN’banana×÷banana")]


def as_rows(frame):
    return sorted((tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("seed, crowd, rare", [(1, 128, 16), (2, 2, 1), (3, 3, 0), (4, 2, 10**6)])
def test_variants_equal_plain_version(spark, monkeypatch, seed, crowd, rare):
    """Lists split down to their last gram, and dictionaries from all grams to none, give the same."""
    monkeypatch.setattr(variants, "CROWD", crowd)
    monkeypatch.setattr(variants, "RARE", rare)
    rows = word_rows(seed)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    want = plain_variants(rows)
    assert len(want) > 60 and sum(r[1] is not None for r in want) > 10
    assert as_rows(variants.variants(frame)) == want
    assert variants.variants(frame.where("false")).collect() == []


def test_variants_of_long_texts_in_parts(spark, monkeypatch):
    rows = word_rows(6)
    monkeypatch.setattr(variants, "PART", 17)
    monkeypatch.setattr(variants, "HELD", 5)
    assert as_rows(variants.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_variants(rows)
    with pytest.raises(ValueError):
        variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), least_length=3)


def edits(word, letters="abc"):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:], 1
            if i < len(word) and word[i] != c:
                yield word[:i] + c + word[i + 1 :], 0
        if i < len(word):
            yield word[:i] + word[i + 1 :], -1


def test_an_edit_touches_no_more_grams_than_said():
    draw = random.Random(7)
    for _ in range(150):
        extended = {"".join(draw.choice("abc^$") for _ in range(draw.choice([2, 3]))): draw.randint(17, 99) for _ in range(draw.choice([0, 8, 60]))}
        word = "".join(draw.choice("abc") for _ in range(draw.randint(4, 9)))
        grams, touched, parted = variants.decompose(word, extended)
        assert len(grams) == len(word) + 1 and parted <= touched <= variants.LONGEST
        for other, longer in edits(word):
            others, other_touched, other_parted = variants.decompose(other, extended)
            if longer == 0:
                shared = len(set(grams) & set(others))
                assert shared >= len(grams) - touched and shared >= len(others) - other_touched
            else:
                counts = [Counter(g for _, g, _ in x) for x in (grams, others)]
                shared = (counts[0] & counts[1]).total()
                assert shared >= len(grams) - (parted if longer > 0 else touched)
                assert shared >= len(others) - (other_touched if longer > 0 else other_parted)


def test_form_and_root(spark):
    frame = spark.createDataFrame([(i, "letter letter lettr lettr letters") for i in range(9)], "doc_id long, text string")
    found = {r["word"]: r for r in variants.variants(frame).collect()}
    assert found["letters"]["form"] == found["letters"]["root"] == "letter" and found["letter"]["form"] is None


def test_word_vectors_of_tasks_without_rows(spark):
    frame = spark.createDataFrame([("one two three two",), ("three two one",)], "text string")
    whole = quality.word_vectors(frame.coalesce(1))
    assert whole.any() and (quality.word_vectors(frame.repartition(6)) == whole).all()
