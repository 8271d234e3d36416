"""Near copies by the exact Jaccard similarity of their sets of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import FILE, KEEPER, ROW, bitmaps, drop_stage, hand_back, located, marked_rows, row_name, slices, stage, stage_at
from loomgraph.llm.components import components
from loomgraph.llm.simhash import SEED, shingle_hashes

SHINGLE = 5
#: Similar are sets that share LEAST[0] of LEAST[1] of their union.
LEAST = (4, 5)
#: Cells of the small sketch that travels with every entry of a shared bucket. A whole sketch has a cell a shingle or more.
CELLS = 1024
#: Texts whose shingles are counted to put common ones last, and how many of these are told to the workers.
SAMPLE = 4096
COMMON = 1 << 16
#: The neighbours of a bucket that one round compares reach so many times further than in the round before.
WIDER = 8
#: Texts whose shingles a worker holds at a time.
HELD = 256


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; one for fewer words than a shingle, none without words."""
    return np.unique(shingle_hashes(text, SHINGLE))


def _name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _sketch(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The parity of the shingles in each of so many cells: two sets differ in at least as many elements as in bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(32)).astype(np.int64) % cells, minlength=cells) & 1)


def _cells(size: int) -> int:
    """A power of two, so that the halves of a sketch add up to the sketch of half as many cells."""
    return max(64, 1 << (size - 1).bit_length()) if size else 64


def _prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first elements in one order for all sets, common ones last: similar sets share one of them."""
    some = len(hashes) - -(-len(hashes) * LEAST[0] // LEAST[1]) + 1
    usual = np.isin(hashes, common, assume_unique=True)
    return np.concatenate([hashes[~usual], hashes[usual]])[:some]


def _common(rows: DataFrame) -> np.ndarray:
    """Shingles that several texts of a sample have. What is in the list decides costs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], HELD):
                hashes = [shingles(x.as_py()) for x in part.column("text")]
                yield pa.record_batch({"key": pa.array(np.concatenate([*hashes, np.array([], np.uint64)]).view(np.int64))})

    apart = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64(FILE, ROW), F.lit(apart)) == 0)
    counted = sample.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 3")
    found = counted.orderBy(F.desc("n"), "key").limit(COMMON).select("key").toArrow()
    return np.sort(found.column("key").to_numpy().view(np.uint64))


def _sets(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, ``FILE``, ``ROW``, the set's name and size, its small and its whole sketch, and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HELD):
            sets = [shingles(x.as_py()) for x in batch.column("text")]
            yield pa.record_batch(
                {c: batch.column(c) for c in ("doc_id", FILE, ROW)}
                | {
                    "name": pa.array(np.array([_name(s) for s in sets], np.uint64).view(np.int64)),
                    "size": pa.array([len(s) for s in sets], pa.int64()),
                    "small": pa.array([_sketch(s, CELLS).tobytes() for s in sets], pa.binary()),
                    "sketch": pa.array([_sketch(s, _cells(len(s))).tobytes() for s in sets], pa.binary()),
                    "prefix": pa.array([_prefix(s, common).view(np.int64) for s in sets], pa.list_(pa.int64())),
                }
            )
        hand_back()

    schema = f"doc_id long, {FILE} long, {ROW} long, name long, size long, small binary, sketch binary, prefix array<long>"
    return rows.select(F.col("doc_id").cast("long"), FILE, ROW, "text").mapInArrow(run, schema)


def _whole_sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, HELD):
            sets = [shingles(x.as_py()) for x in batch.column("text")]
            names = np.array([_name(s) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch({"name": pa.array(names), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})
        hand_back()

    return texts.select("text").mapInArrow(run, "name long, hashes binary")


def _pairs(start: int, stop: int):
    """Pairs of a bucket that may be similar and are in different components, ``start`` < steps apart <= ``stop``."""
    names = ["key", "name", "size", "component"]

    def close(rows: np.ndarray, sketch: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        key, name, size, component = rows
        a, b = [], []
        for step in range(1, min(stop, len(key) - 1) + 1):
            # Sizes rise inside a bucket, so a step too far in size leaves no longer one.
            i = np.flatnonzero((key[:-step] == key[step:]) & (LEAST[1] * size[:-step] >= LEAST[0] * size[step:]))
            if not len(i):
                break
            i = i[component[i] != component[i + step]] if step > start else i[:0]
            for k in range(0, len(i), 1 << 14):
                x = i[k : k + (1 << 14)]
                apart = np.bitwise_count(sketch[x] ^ sketch[x + step]).sum(axis=1, dtype=np.int64)
                x = x[(LEAST[0] + LEAST[1]) * apart <= (LEAST[1] - LEAST[0]) * (size[x] + size[x + step])]
                a.append(np.minimum(name[x], name[x + step]))
                b.append(np.maximum(name[x], name[x + step]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        batches = iter(batches)
        batch = next(batches, None)
        while batch is not None:
            following = next(batches, None)
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            sketch = np.frombuffer(b"".join(batch.column("small").to_pylist()), np.uint64).reshape(-1, CELLS // 64)
            if kept is not None:
                rows, sketch = np.concatenate([kept[0], rows], axis=1), np.concatenate([kept[1], sketch])
            # A bucket that goes on in the next batch waits for it.
            whole = rows.shape[1] if following is None or not rows.shape[1] else int(np.argmax(rows[0] == rows[0, -1]))
            a, b = close(rows[:, :whole], sketch[:whole])
            none = np.array([], np.int64)
            found = np.unique(np.stack([np.concatenate([*a, none]), np.concatenate([*b, none])]), axis=1)
            yield pa.record_batch({"a": pa.array(found[0].copy()), "b": pa.array(found[1].copy())})
            kept, batch = (rows[:, whole:], sketch[whole:]), following
        hand_back()

    return run


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that the whole sketches allow; the longer one is folded to the shorter one's cells."""
    for batch in slices(batches, 4096):
        held = []
        for x, y, n in zip(batch.column("x"), batch.column("y"), batch.column("size").to_pylist(), strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint8) for s in (x, y))
            while len(x) != len(y):
                x, y = (x, y) if len(x) < len(y) else (y, x)
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            held.append((LEAST[0] + LEAST[1]) * int(np.bitwise_count(x ^ y).sum()) <= (LEAST[1] - LEAST[0]) * n)
        yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))
    hand_back()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that whole sets confirm."""
    for batch in slices(batches, HELD):
        held = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            held.append(LEAST[1] * shared >= LEAST[0] * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))
    hand_back()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key and name, those of keys with several names, once each."""
    last = None
    waiting: pa.RecordBatch | None = None
    batches = iter(batches)
    batch = next(batches, None)
    while batch is not None:
        following = next((b for b in batches if b.num_rows), None)
        if batch.num_rows:
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            key, name = (batch.column(c).to_numpy() for c in ("key", "name"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            batch = batch.filter(pa.array(new))
            key = key[new]
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            # The last row waits for the next batch, and knows whether the row before it had its key.
            known = same[:-1] | same[1:]
            known[0] |= last == key[0]
            if following is None:
                yield batch.filter(pa.array(known))
            else:
                last = key[-2] if len(key) > 1 else last
                yield batch.slice(0, len(key) - 1).filter(pa.array(known[:-1]))
                waiting = batch.slice(len(key) - 1)
        batch = following


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of names, staged, that whole sets confirm."""
    spark = rows.sparkSession
    pairs, first = stage_at(pairs.distinct(), "pairs")
    # Whole sketches, an eighth of a byte a shingle, spare most pairs the eight bytes a shingle of their sets.
    sketches = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "name", "left_semi")
    sketches = sketches.groupBy("name").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    x = sketches.selectExpr("name as a", "size as m", "sketch as x")
    y = sketches.selectExpr("name as b", "size as n", "sketch as y")
    told = pairs.join(x, "a").join(y, "b").selectExpr("a", "b", "m + n as size", "x", "y")
    close, second = stage_at(told.mapInArrow(_allowed, "a long, b long"), "close")
    asked = close.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    places = distinct.join(asked, "name", "left_semi").select(f"first.{FILE}", f"first.{ROW}")
    whole, third = stage_at(_whole_sets(marked_rows(rows, bitmaps(places))), "sets")
    both = close.join(whole.selectExpr("name as a", "hashes as x"), "a").join(whole.selectExpr("name as b", "hashes as y"), "b")
    new = stage(both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), "similar")
    for path in (first, second, third):
        drop_stage(spark, path)
    return new


def _stars(sets: DataFrame, judged: DataFrame) -> DataFrame:
    """``a, b``: in every component of ``judged`` rows, the smallest name with each other one."""
    members = sets.select(FILE, ROW, "name").join(judged.where("component_id is not null").select(FILE, ROW, "component_id"), [FILE, ROW])
    members = members.select("component_id", "name").distinct()
    least = members.groupBy("component_id").agg(F.min("name").alias("a"), F.max("name").alias("most")).where("a < most")
    return members.join(least.select("component_id", "a"), "component_id").where("a < name").selectExpr("a", "name as b")


def _linked(rows: DataFrame, sets: DataFrame, distinct: DataFrame, judged: DataFrame | None) -> DataFrame | None:
    """``node, component`` of the names that are similar to another, by way of others too."""
    links = found = None
    if judged is not None:
        links = _verified(_stars(sets, judged), rows, sets, distinct)
        links = None if links.isEmpty() else links
        found = None if links is None else stage(components(links), "components")
    keyed = sets.select(F.explode("prefix").alias("key"), "name", "size")
    met = keyed.repartition("key").sortWithinPartitions("key", "name").mapInArrow(_met, keyed.schema)
    met = stage(met, "met")
    # Only entries that met another one get a sketch, so it can be wide enough to tell long texts apart.
    small = stage(sets.join(met.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.first("small").alias("small")), "small")
    largest = met.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    start, stop = 0, 1
    while start < largest - 1:
        known = met.withColumn("component", F.col("name"))
        if found is not None:
            known = met.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
            # What is joined already needs no further look.
            open_keys = known.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
            known = known.join(open_keys.select("key"), "key", "left_semi")
        dealt = known.join(small, "name").repartition("key").sortWithinPartitions("key", "size", "name")
        pairs = dealt.select("key", "name", "size", "component", "small").mapInArrow(_pairs(start, stop), "a long, b long")
        start, stop = stop, stop * WIDER
        new = _verified(pairs, rows, sets, distinct)
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        found = stage(components(links), "components")
    return found


def near_copies(docs: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """doc_id, component_id and kept of every row, with ``FILE``, ``ROW`` and ``KEEPER``.

    Texts are linked if their sets of five-word shingles (ASCII letters lowered, words parted
    by blanks) have a Jaccard similarity of 0.8 or more; component_id is the smallest doc_id
    reachable and that row is kept. Equal sets are one; texts without words are alike. Null doc_ids
    sort last. Shingles and sets are named by 64-bit hashes.

    Every similar pair is found: with all sets in one order, two of them share one of their first
    ``n - ceil(0.8 n) + 1`` shingles. A bucket of such a shingle is sorted by size, and rounds
    compare ever further neighbours, but none that is in one component already; pairs that sizes and
    sketches allow, which are bounds, are decided on the whole sets. So a large group of near
    copies costs its members, not its pairs, and rounds grow with the logarithm of a bucket.

    ``judged`` has ``component_id`` by ``FILE`` and ``ROW`` of an operator that links rows, such as
    ``simhash.near_duplicates``: its links are checked on the whole sets first, and rows that they join
    are not compared again. The result is the same with and without.

    Null and empty texts, and texts of blanks, have the empty set and are copies of each other; of
    repeated rows and ids every row is judged; a very long text is one set in one worker; an
    empty table gives none; other columns, whatever their names, play no part.
    """
    rows = located(docs, "doc_id", "text")
    sets = stage(_sets(rows, _common(rows)), "prefixes")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)
    distinct = stage(sets.groupBy("name").agg(F.min(first).alias("first")), "distinct")
    found = _linked(rows, sets, distinct, judged)
    joined = distinct.withColumn("component", F.col("name"))
    if found is not None:
        joined = distinct.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    keepers = joined.groupBy("component").agg(F.min("first").alias("keeper"))
    labels = joined.select("name", "component").join(keepers, "component").select("name", "keeper")
    same = [F.col(f"keeper.{c}") == F.col(c) for c in (FILE, ROW)]
    return sets.select("doc_id", "name", FILE, ROW).join(labels, "name").select(
        "doc_id",
        F.col("keeper.doc_id").alias("component_id"),
        (same[0] & same[1]).alias("kept"),
        FILE,
        ROW,
        row_name(f"keeper.{FILE}", f"keeper.{ROW}").alias(KEEPER),
    )


def united(found: DataFrame, judged: DataFrame) -> DataFrame:
    """``found`` of ``near_copies`` with components joined where ``judged`` links their rows.

    ``judged`` has ``kept`` and ``KEEPER`` by ``FILE`` and ``ROW``, over the same rows. Each of its links holds,
    whatever the similarity, and so do those by way of both; the row with the smallest doc_id stays.
    """
    found = stage(found, "found")
    home = found.select(row_name().alias("row"), F.col(KEEPER).alias("home"))
    moved = judged.where("not kept").select(row_name().alias("row"), F.col(KEEPER).alias("far")).join(home, "row")
    links = moved.join(home.selectExpr("row as far", "home as other"), "far").where("home <> other")
    links = stage(links.selectExpr("home as a", "other as b").distinct(), "links")
    if links.isEmpty():
        return found
    grown = stage(components(links), "components")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)
    keepers = found.where("kept").select(row_name().alias("node"), first.alias("first")).join(grown, "node")
    keepers = keepers.groupBy("component").agg(F.min("first").alias("keeper"))
    moved = grown.join(keepers, "component").select(F.col("node").alias(KEEPER), "keeper")
    stays = F.col("keeper").isNull() | (F.col(f"keeper.{FILE}") == F.col(FILE)) & (F.col(f"keeper.{ROW}") == F.col(ROW))
    return found.join(moved, KEEPER, "left").select(
        "doc_id",
        F.when(F.col("keeper").isNull(), F.col("component_id")).otherwise(F.col("keeper.doc_id")).alias("component_id"),
        (F.col("kept") & stays).alias("kept"),
        FILE,
        ROW,
        F.when(F.col("keeper").isNull(), F.col(KEEPER)).otherwise(row_name(f"keeper.{FILE}", f"keeper.{ROW}")).alias(KEEPER),
    )
