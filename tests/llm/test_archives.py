"""WARC bundles and nearest neighbours."""

import hashlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from loomgraph.llm import neighbours, warc
from loomgraph.llm.common import FILE, ROW


def pages():
    big, odd = "<p>" + "x" * 1200, "é" * 600
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (9, "http://é/", big), (3, "u", odd), (4, "u", odd), (5, "u", "x" * 999), (6, "u", "x" * 999)]
    rows += [(7, "u", None), (8, "u", ""), (None, "u", big), (10, "u", "y" * 1000), (10, "u", "y" * 1000), (11, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 90)]
    return rows + [(20 + i, f"http://h/{i}", str(i) * 700) for i in range(60)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("keeper", F.lit("x")).withColumn("payload", F.lit(1))
    frame.repartition(3).write.parquet(path)
    frame = spark.read.parquet(path)
    sizes = warc.FRAME, warc.BUNDLE
    warc.FRAME, warc.BUNDLE = 4000, 300
    yield warc.write_warc(frame)
    warc.FRAME, warc.BUNDLE = sizes


def test_archives_hold_equal_payloads_once(archive):
    found = warc.read_warc(*archive).collect()
    keeper = {}
    for page, _, html in pages():
        if len((html or "").encode()) >= 1000:
            keeper[html] = max(keeper.get(html, -1), -1 if page is None else page)
    want = []
    for page, _, html in pages():
        data = (html or "").encode()
        keep = keeper.get(html)
        revisit = keep is not None and page != keep
        want.append((-1 if page is None else page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    want.remove((10, 1000, hashlib.sha1(b"y" * 1000).hexdigest(), "response", None))
    want.append((10, 1000, hashlib.sha1(b"y" * 1000).hexdigest(), "revisit", 10))
    columns = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    got = [(-1 if r["page_id"] is None else r["page_id"], *(r[c] for c in columns)) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_index_leads_to_each_record(spark, archive):
    folder, index = archive
    files = {r["path"].rpartition("/")[2]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(folder).collect()}
    rows = index.collect()
    assert len(files) > 1 and set(files) == {r["name"] for r in rows}
    for r in rows:
        head, _ = warc.read_record(files[r["name"]], r["frame"], r["at"])
        assert head["WARC-Record-ID"] == warc.record_id(r["page_id"], r[FILE], r[ROW])
        assert set(head) >= {"WARC-Type", "WARC-Target-URI", "Content-Length"}
    # Any reader of the format takes the bundle as one stream: the seek table is a frame to skip.
    for data in files.values():
        plain = sum(size for *_, size in warc.read_seek_table(data))
        assert len(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(plain + 1)) == plain


def test_no_pages_no_bundles(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(*warc.write_warc(none)).collect() == []


def test_large_payloads_in_full_are_checked():
    row = {"page_id": 1, FILE: 2, ROW: 3, "url": "u", "payload": b"abc", "payload_digest": hashlib.sha1(b"abc").hexdigest(), "payload_bytes": 3, "keeper": None}
    (_, head, payload), = warc.parse_records(warc.record(row))
    assert warc._told(head, payload)[0] == 1
    with pytest.raises(ValueError):
        warc._told(head, b"abd")


def brute(vectors, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.cumsum(x * x[i], axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def search(spark, vectors, k=20):
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in vectors], "vec_id long, embedding array<float>, score double")
    found = {}
    for r in neighbours.neighbours(frame.repartition(3), F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def test_few_vectors_and_odd_ones(spark):
    good = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (5, [-1.0, -1.0]), (None, [1.0, 1.0]), (1, [3.0, 1.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [None, 1.0]), (3, [float("inf"), 1.0]), (4, []), (120, [1.0])]
    found = search(spark, good + bad)
    assert found == brute([x for x in good[:5]], 20)
    assert search(spark, bad[:5]) == {} and search(spark, bad[:1]) == {}
    assert neighbours.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect() == []


def test_recall_and_ties_in_many_small_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 24)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = [(i, (rng.normal(size=16) * 0.4 + centres[i % 12]).tolist()) for i in range(900)]
    # A third of all rows are one vector: its copies tie.
    vectors = [(i, vectors[7][1] if i % 3 == 1 else v) for i, v in vectors]
    found, want = search(spark, vectors), brute(vectors, 20)
    assert set(found) == set(want) and all(len(x) == 20 for x in found.values())
    scores = {(q, i): s for q, x in want.items() for i, s in x}
    assert all(s == scores[q, i] for q, x in found.items() for i, s in x if (q, i) in scores)
    assert all(x == sorted(x, key=lambda r: (-r[1], r[0])) for x in found.values())
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_balanced_parts():
    x = np.random.default_rng(0).normal(size=(1000, 8))
    assert len(neighbours.balanced_centroids(x, 37)) == 37
    assert len(neighbours.balanced_centroids(x[:3], 37)) <= 3


def test_walk_finds_what_a_full_scan_finds():
    rng = np.random.default_rng(2)
    lists = neighbours.Lists(rng.normal(size=(500, 9)), np.zeros((1, 1), int), 1.0, 1.15, np.full(500, 100))
    lists.links = neighbours.graph(lists.centroids)
    queries = rng.normal(size=(50, 9))
    apart = np.sqrt(neighbours._squared(queries, lists.centroids))
    want = set(zip(*np.nonzero(apart <= 1.15 * apart.min(axis=1)[:, None]), strict=True))
    got = set(zip(*lists.search(queries, 1), strict=True))
    assert len(got & want) >= 0.99 * len(want)
