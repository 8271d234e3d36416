"""Removal of repeated substrings by prefix doubling.

Strings get names by doubling: a string of 2n bytes is named by the pair of the names of its
halves, the second at offset n, from single bytes on. Sorting the pairs of every position is
out of reach of a corpus (eight bytes a name for each byte of text, at every offset), so the
first sort is over minimizers: of the names of the 32-byte strings in every 100 bytes, the
smallest. Equal 100-byte strings have equal minimizers at equal places, so nothing is lost.
Spark sorts these by name; unique ones are done. It reranks the others by what
surrounds them, which settles all but the texts near an edit; there the pair of 64-byte names at
offset 0 and 36 ranks every single 100-byte string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import FILE, ROW, bitmaps, filled, located, marked_rows, slices, stage

LENGTH = 100
#: Length of the strings that minimizers name; a string of LENGTH is named by two of twice that.
GRAM = 32
#: Bytes named at once, and bytes whose minimizers one task holds together.
SEGMENT, HELD = 1 << 18, 12 << 20
#: Contexts of one minimizer that are settled in one task; above it each string is a row.
CROWD = 5000

ODD = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    out = first * np.uint64(ODD)
    out += second
    out ^= out >> np.uint64(29)
    out *= np.uint64(MIX)
    out ^= out >> np.uint64(32)
    return out


def names(data: np.ndarray, length: int) -> np.ndarray:
    """Name of the ``length`` bytes (a power of two) from each position on."""
    byte = np.arange(1, 257, dtype=np.uint64)
    out = _pairs(byte, byte * np.uint64(MIX))[data]
    step = 1
    while step < length:
        out = _pairs(out[:-step], out[step:]) if len(out) > step else out[:0]
        step *= 2
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position on."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def minimizers(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Minimizers of all strings of ``length`` inside texts that end at ``ends``.

    For each: text, place, first and last start of the strings it stands for, the name of its
    32 bytes, and the name of all bytes of these strings with its place among them.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    short = names(data, GRAM)
    wide = _pairs(short[:-GRAM], short[GRAM:])
    key = (short >> np.uint64(32) << np.uint64(32)) | np.arange(len(short), dtype=np.uint64)
    chosen = (_least(key, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(chosen)]
    start = np.flatnonzero(ends[text] - np.arange(len(chosen)) >= length)
    if not len(start):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    chosen, text = chosen[start], text[start]
    turn = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    first, last = start[turn], start[np.append(turn[1:], len(start)) - 1]
    place, text = chosen[turn], text[turn]
    size = last - first + length
    # Three overlapping 64-byte strings cover up to 192 bytes, more than any run of strings has.
    around = _pairs(_pairs(wide[first], wide[first + (size - 2 * GRAM) // 2]), wide[first + size - 2 * GRAM])
    around = _pairs(around, ((place - first) << 16 | size).astype(np.uint64))
    return text, place, first, last, short[place], around


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of ``(text, offset, bytes)``; long texts are cut with an overlap that keeps every string."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            part = text[at : at + SEGMENT + length - 1]
            group.append((i, at, part))
            held += len(part)
            if held >= SEGMENT:
                yield group
                group, held = [], 0
    if group:
        yield group


def _text_minimizers(texts: list[bytes], length: int) -> list[np.ndarray]:
    """As ``minimizers``, with places counted from the start of their text."""
    parts = []
    for group in _segments(texts, length):
        ends = np.cumsum([len(x) for *_, x in group])
        text, place, first, last, name, around = minimizers(np.frombuffer(b"".join(x for *_, x in group), np.uint8), ends, length)
        shift = (np.array([o for _, o, _ in group]) - np.concatenate([[0], ends[:-1]]))[text]
        parts.append((np.array([i for i, *_ in group])[text], place + shift, first + shift, last + shift, name, around))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6


def _order(ids: np.ndarray, none: np.ndarray, file: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Rank of each row: by doc_id, null last, then by place in the table."""
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((row, file, ids, none))] = np.arange(len(ids))
    return rank


RANKED = f"name long, around long, doc_id long, {FILE} long, {ROW} long, start long, more int"


def _rank(length: int):
    """Minimizers, one for each context in the task; the strings of the others are done: they repeat.

    ``more`` is the last start less the first, or, for finished ranges, minus their length.
    """

    def settle(rows: list[tuple], texts: list[bytes]) -> pa.RecordBatch:
        ids, none, file, row = (np.concatenate(x) for x in zip(*rows, strict=True))
        text, _, first, last, name, around = _text_minimizers(texts, length)
        rank = _order(ids, none, file, row)[text] if len(text) else text
        order = np.lexsort((first, rank, around, name))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (name[order][1:] == name[order][:-1]) & (around[order][1:] == around[order][:-1])
        out = ~again
        done = _joined(text[again], first[again], last[again] + length)
        at = np.concatenate([text[out], done[0]]).astype(np.int64)
        start = np.concatenate([first[out], done[1]])
        more = np.concatenate([(last - first)[out], done[1] - done[2]])
        # Finished ranges only pass through the sort; any name that spreads them will do.
        own = _pairs(row.astype(np.uint64)[done[0]], done[1].astype(np.uint64))
        return pa.record_batch(
            [
                pa.array(np.concatenate([name[out], own]).view(np.int64)),
                pa.array(np.concatenate([around[out], own]).view(np.int64)),
                pa.array(ids[at], mask=none[at]),
                pa.array(file[at]),
                pa.array(row[at]),
                pa.array(start, pa.int64()),
                pa.array(more, pa.int32()),
            ],
            [x.split()[0] for x in RANKED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        texts: list[bytes] = []
        held = 0
        for part in slices(batches, 256):
            own = [(x.as_py() or "").encode() for x in part.column("text")]
            ids = part.column("doc_id")
            places = [part.column(c).to_numpy(zero_copy_only=False) for c in (FILE, ROW)]
            rows.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), *places))
            texts.extend(own)
            held += sum(map(len, own))
            if held >= HELD:
                yield settle(rows, texts)
                rows, texts, held = [], [], 0
        if rows:
            yield settle(rows, texts)

    return run


def _joined(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges with those that touch or overlap made one."""
    if not len(text):
        return text.astype(np.int64), start, end
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    # Ends as they would be with every text on its own stretch of one line.
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + text * wide)
    new = np.append(True, start[1:] + text[1:] * wide > reach[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text)) - 1
    return text[at], start[at], reach[last] - text[at] * wide


CONTEXTS = f"name long, m long, doc_id long, {FILE} long, {ROW} long, start long, data binary"


def _contexts(length: int):
    """The bytes of each context that is not settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        heads = [c.split()[0] for c in CONTEXTS.split(", ")]
        for batch in slices(batches, 64):
            rows: list[tuple] = []
            for x in batch.to_pylist():
                text = (x["text"] or "").encode()
                for p in x["places"]:
                    data = text[p["start"] : p["start"] + p["more"] + length]
                    rows.append((p["name"], p["m"], x["doc_id"], x[FILE], x[ROW], p["start"], data))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], heads)

    return run


def _string_names(data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of ``length`` inside the contexts: its context, its start there, its name."""
    sizes = np.array([len(d) for d in data])
    wide = names(np.frombuffer(b"".join(data), np.uint8), 2 * GRAM)
    counts = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(data)), counts)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[of] + inside
    return of, inside, _pairs(wide[at], wide[at + length - 2 * GRAM])


def _settle(length: int):
    """Ranges whose strings start earlier in another context of the same minimizer."""

    def ranges(rows: dict[str, np.ndarray], data: list[bytes]) -> pa.RecordBatch:
        order = np.lexsort((rows["start"], rows[ROW], rows[FILE], rows["doc_id"], rows["none"]))
        rows = {c: v[order] for c, v in rows.items()}
        of, inside, name = _string_names([data[i] for i in order], length)
        # Contexts are in order, so the first of equal strings is the one that starts first.
        name = _pairs(name, rows["name"].view(np.uint64)[of])
        place = np.argsort(name, kind="stable")
        again = np.zeros(len(of), bool)
        again[place[1:]] = name[place][1:] == name[place][:-1]
        start = rows["start"][of[again]] + inside[again]
        text, start, end = _joined(of[again], start, start + length)
        return pa.record_batch({FILE: rows[FILE][text], ROW: rows[ROW][text], "start": start, "end": end})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        batches = iter(batches)
        batch = next(batches, None)
        while batch is not None:
            following = next(batches, None)
            held.append(batch)
            if following is None or sum(b.num_rows for b in held) >= CROWD:
                table = pa.Table.from_batches(held)
                name = table.column("name").to_numpy()
                whole = len(name) if following is None else int(np.searchsorted(name, name[-1])) if len(name) else 0
                if whole:
                    part = table.slice(0, whole)
                    rows = {c: part.column(c).to_numpy() for c in ("name", FILE, ROW, "start")}
                    rows["none"] = part.column("doc_id").is_null().to_numpy()
                    rows["doc_id"] = part.column("doc_id").fill_null(0).to_numpy()
                    yield ranges(rows, part.column("data").to_pylist())
                held = table.slice(whole).to_batches()
            batch = following

    return run


def _strings(length: int):
    """A row for every string of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            if batch.num_rows:
                of, inside, name = _string_names(batch.column("data").to_pylist(), length)
                rows = batch.take(pa.array(of))
                start = rows.column("start").to_numpy(zero_copy_only=False) + inside
                own = {c: rows.column(c) for c in ("name", "doc_id", FILE, ROW)}
                yield pa.record_batch(own | {"string": pa.array(name.view(np.int64)), "start": pa.array(start)})

    return run


def _first() -> F.Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW, "start"))


def repeats(rows: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """Ranges ``FILE, ROW, start, end`` of ``located(docs, doc_id, text)`` that hold repeated strings.

    The ranges of a row together cover exactly the bytes of strings of ``length`` that also
    start earlier. They may overlap.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings of less than {2 * GRAM} bytes have no pair of names")
    ranked = rows.mapInArrow(_rank(length), RANKED)
    group = Window.partitionBy("name")
    order = group.orderBy("around", F.col("doc_id").asc_nulls_last(), FILE, ROW, "start")
    before = F.lag("around").over(order)
    ranked = ranked.withColumn("new", (before.isNull() | (before != F.col("around"))).cast("long"))
    ranked = ranked.withColumn("m", F.sum("new").over(group))
    open_ = stage(ranked.where("more < 0 or new = 0 or m > 1").drop("around"), "ranked")
    done = open_.where("more < 0 or new = 0").select(
        FILE, ROW, "start", F.expr(f"start + if(more < 0, -more, more + {length})").alias("end")
    )
    places = open_.where("more >= 0 and new = 1").groupBy(FILE, ROW).agg(
        F.collect_list(F.struct("name", "m", "start", "more")).alias("places")
    )
    texts = marked_rows(rows, bitmaps(open_.where("more >= 0 and new = 1").select(FILE, ROW)))
    contexts = stage(texts.join(places, [FILE, ROW]).mapInArrow(_contexts(length), CONTEXTS), "contexts")
    near = contexts.where(F.col("m") <= crowd).repartition("name").sortWithinPartitions("name")
    near = near.mapInArrow(_settle(length), f"{FILE} long, {ROW} long, start long, end long")
    strings = stage(
        contexts.where(F.col("m") > crowd).mapInArrow(
            _strings(length), f"name long, doc_id long, {FILE} long, {ROW} long, string long, start long"
        ),
        "strings",
    )
    first = strings.groupBy("name", "string").agg(_first().alias("first"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW, "start")
    many = strings.join(first, ["name", "string"]).where(~F.col("first").eqNullSafe(own))
    many = many.select(FILE, ROW, "start", (F.col("start") + length).alias("end"))
    return done.unionByName(near).unionByName(many)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        rows = []
        for x in batch.to_pylist():
            data, kept, reach, spans = (x["text"] or "").encode(), [], 0, 0
            for r in sorted((r["start"], r["end"]) for r in x["ranges"]):
                if r[0] > reach or not spans:
                    kept.append(data[reach : r[0]])
                    spans += 1
                reach = max(reach, r[1])
            kept.append(data[reach:])
            left = b"".join(kept)
            rows.append((x["doc_id"], len(data), len(data) - len(left), spans, left))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        heads = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], heads)


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of every row.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a row with a
    smaller doc_id, or before in the same text. Null ids come last, and rows with one doc_id
    in the order of the table, so of repeated rows the first keeps its text. Null texts are
    empty; texts shorter than ``length`` and empty tables lose nothing. Other columns are not
    read. Only texts that lose something are shuffled.
    """
    rows = located(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = stage(repeats(rows, length, crowd), "ranges")
    bits = bitmaps(found.select(FILE, ROW))
    ranges = found.groupBy(FILE, ROW).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    touched = marked_rows(rows, bits).join(ranges, [FILE, ROW])
    touched = touched.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    whole = marked_rows(rows, bits, marked=False)
    data = filled("text").cast("binary")
    nothing = F.lit(0).cast("long")
    return touched.unionByName(
        whole.select("doc_id", F.length(data).cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), data.alias("kept"))
    )
