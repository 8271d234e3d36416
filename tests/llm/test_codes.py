"""Token ids, their codes and files, and packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import golomb, huffman, packing, tokens

ODD = ["foo", "Bar", "ÉCOLE", "it's", "<|endoftext|>", " ", "  ", "\n", " \n", "\t", " ", "\x1c", "\x85", ".", ",", "'s", " 's"]
ODD += ["123", "a_b", "é", "H̱", "İ", "ΑΣ", "漢字", "😀", "ß", "K", "?!", "\r\n", "ǅ", " 'LL", " "]


@pytest.mark.parametrize("name", sorted(tokens.SPACES))
def test_cached_encoding_is_exact(name):
    draw = random.Random(1)
    texts = ["".join(draw.choice(ODD + [" "] * 6) for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    path = public_tokenizers.path(name)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.Encoder(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


@pytest.mark.parametrize("name", sorted(tokens.SPACES))
def test_common_words_are_not_learned_again(name, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 40)
    encoder = tokens.Encoder(public_tokenizers.path(name))
    learned = []
    monkeypatch.setattr(encoder, "_learn", lambda missing, learn=encoder._learn: (learned.extend(missing), learn(missing)))
    texts = [f"a common {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}x{'uvw'[i // 100]}" for i in range(300)]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    for i in range(0, 300, 20):
        want = [e.ids for e in whole.encode_batch(texts[i : i + 20], add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[i : i + 20])] == want
        assert len(encoder.words) + len(encoder.older) <= 2 * (40 + 23)
    assert len(learned) == len(set(learned)) > 300


@pytest.mark.parametrize("name", sorted(tokens.SPACES))
def test_empty_texts_have_the_end_id_only(name):
    assert list(tokens.encode_all(public_tokenizers.path(name), ["", None], 2)) == [(2).to_bytes(4, "little")] * 2


def test_texts_are_handed_over_in_small_batches(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def most(batches, rows):
        for batch in batches:
            seen.add(batch.num_rows > rows)
            yield batch

    monkeypatch.setattr(packing, "slices", most)
    monkeypatch.setattr(huffman, "slices", most)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), spark.range(0, 1500, 1, 1).selectExpr("id as doc_id", "'a b' as text")
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 1500
    assert huffman.read_ids(*huffman.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"))).count() == 1500
    assert seen.value == 0 and spark.conf.get(name) == before


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values):
    values = np.sort(np.array(values, np.uint64))
    k, code = golomb.encode(values)
    assert (golomb.decode(len(values), k, code) == values).all()


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300), st.integers(9, 14))
@settings(max_examples=60, deadline=None)
def test_code_lengths_are_a_full_code_within_the_limit(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit).astype(int)
    used = lengths[lengths > 0]
    assert (lengths > 0).tolist() == [c > 0 for c in counts]
    assert (used <= limit).all()
    if len(used) > 1:
        assert sum(2.0**-x for x in used) == 1


def test_limited_code_is_no_worse_than_needed():
    lengths = huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32]), 20)
    assert sorted(lengths.tolist()) == [1, 2, 3, 4, 5, 6, 6]
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32]), 3).max() == 3
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000])
def test_any_block_decodes_by_itself(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 3000).astype(np.uint32)
    sizes = huffman.code_lengths(np.bincount(ids, minlength=3001))
    held = [(7, n)] if n else [(None, 0)]
    data = huffman._file(held, [ids], sizes.tobytes(), huffman.canonical_codes(sizes), sizes)
    reader = huffman.Reader(data)
    assert (reader.all() == ids).all()
    for i in range(len(reader.blocks)):
        assert (reader.block(i) == ids[i * huffman.BLOCK : (i + 1) * huffman.BLOCK]).all()


def brute_ids(name, rows, end=2):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    encoded = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([r[1] or "" for r in ordered], add_special_tokens=False)
    return [(r[0], np.array(e.ids + [end], "<u4")) for r, e in zip(ordered, encoded, strict=True)]


def test_written_ids_come_back(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_IDS", 2000)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(huffman.read_ids(*huffman.write_ids(docs, path)).collect(), key=lambda r: r["start"])
    want = brute_ids("word_bpe_49k.json", rows)
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in got) == sorted((d if d is not None else -1, x.tobytes()) for d, x in want)
    ends = np.cumsum([r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == [0, *ends[:-1].tolist()]


def test_no_documents_write_no_file(no_docs):
    assert huffman.read_ids(*huffman.write_ids(no_docs, public_tokenizers.path("word_bpe_49k.json"))).collect() == []


@given(st.lists(st.integers(1, 99), max_size=80))
@settings(max_examples=60, deadline=None)
def test_packed_bins_are_whole_and_few(lengths):
    bins = packing.pack_group(np.array(lengths, np.int64), 100)
    fill = np.bincount(bins.bin, np.array(lengths, float), len(bins.fill)) if lengths else np.zeros(0)
    assert (fill == bins.fill).all() and (fill <= 100).all()
    greedy = packing.Bins(np.array(lengths, np.int64), 100)
    greedy.best_fit()
    assert (bins.fill > 0).sum() <= (greedy.fill > 0).sum()


def test_exchanges_empty_a_bin_that_best_fit_leaves():
    lengths = np.array([60, 50, 30, 20, 20, 20])
    greedy = packing.Bins(lengths, 100)
    greedy.best_fit()
    assert (greedy.fill > 0).sum() == 3
    assert (packing.pack_group(lengths, 100).fill > 0).sum() == 2


def test_pieces_and_places(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(docs, path, size=64)
    got = packed.collect()
    want = []
    for doc_id, ids in brute_ids("byte_bpe_50k.json", rows):
        start = 0
        for piece, n in enumerate(packing.cut_lengths(len(ids), 64)):
            part = ids[start : start + n].tobytes()
            want.append((doc_id if doc_id is not None else -1, piece, start, n, zlib.crc32(part), part))
            start += n
    columns = ("piece", "start", "length", "ids_crc32")
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in columns), bytes(r["ids"])) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for name, parts in held.items():
        ends = np.cumsum([p[1] for p in sorted(parts)])
        assert [p[0] for p in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 64
        assert whole[name] == b"".join(p[2] for p in sorted(parts))
    assert len(held) <= 1.02 * sum(r["length"] for r in got) / 64 + 1


def test_packing_in_rounds_places_every_piece_once(spark):
    draw = random.Random(2)
    items = [(i, draw.randint(1, 63)) for i in range(900)]
    got = packing.place(spark.createDataFrame(items, "key long, length int"), 64, group=50).collect()
    assert sorted(r["key"] for r in got) == list(range(900))
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + items[r["key"]][1]
    assert max(fill.values()) <= 64
    greedy = packing.Bins(np.array([n for _, n in items]), 64)
    greedy.best_fit()
    assert len(fill) <= 1.04 * (greedy.fill > 0).sum()


def test_no_documents_pack_to_nothing(no_docs):
    assert packing.pack(no_docs, public_tokenizers.path("byte_bpe_50k.json")).collect() == []
