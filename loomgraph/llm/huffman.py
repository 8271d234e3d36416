"""Length-limited canonical Huffman coding of token ids, in independently decodable blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import batches_of, hand_back, slices, stage
from loomgraph.llm.files import write_file
from loomgraph.llm.tokens import ROWS, encode_all, encoder
from loomgraph.session import shared_path

#: Longest code in bits: above the 16 that any 65,536 ids need, and the decoding table stays small.
LIMIT = 20
#: Bits for the length of a code, beside its id in the decoding table.
SIZE_BITS = 5
#: Ids of a block, and between two of its checkpoints.
BLOCK, STEP = 1 << 16, 256
#: Ids of a file. A file is built in one task's memory.
FILE_IDS = 1 << 23

MAGIC = b"LHUF0001"
HEAD = "<8sQQQQ"
BLOCK_HEAD = "<QQ"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for unused ids.

    A single used id gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64) if counts.sum() > 1 << 62 else counts[order].astype(np.int64)
    row, packed = leaves, [np.zeros(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        row = both[place]
        packed.append(place >= len(leaves))
    need, got = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for is_pair in reversed(packed):
        pairs = int(is_pair[:need].sum())
        got[: need - pairs] += 1
        need = 2 * pairs
    lengths[order] = got
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == size)
        code <<= size - last
        codes[ids] = np.uint64(code) + np.arange(len(ids), dtype=np.uint64)
        code, last = code + len(ids), size
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every possible next ``limit`` bits."""
    ids, sizes = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(1, limit - lengths[order].astype(np.int64))
    end = int(spans.sum())
    ids[:end], sizes[:end] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Head, bit offsets of every ``STEP``-th id, and the bits, filled up to a whole byte."""
    sizes = lengths.astype(np.int64)[ids]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if len(ids) else 0
    # A code reaches into at most two 32-bit words; the parts in one word don't overlap.
    word, room = starts >> 5, 64 - (starts & 31) - sizes
    wide = codes[ids] << room.astype(np.uint64)
    out = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    bits = out.astype(">u4").tobytes()[: (total + 7) // 8]
    return struct.pack(BLOCK_HEAD, len(ids), total) + starts[::STEP].astype("<u4").tobytes() + bits


class Reader:
    """A file's documents and ids. Any block can be decoded by itself, from any checkpoint."""

    def __init__(self, data: bytes) -> None:
        magic, self.n_docs, self.n_ids, table, footer = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a file of coded ids")
        self.data = data
        lengths = np.frombuffer(zlib.decompress(data[struct.calcsize(HEAD) : struct.calcsize(HEAD) + table]), np.uint8)
        ids, sizes = decode_table(lengths)
        self.table = ids << np.uint32(SIZE_BITS) | sizes
        rows = np.frombuffer(zlib.decompress(data[footer:]), "<i8")
        self.doc_ids, self.n_tokens = rows[: self.n_docs], rows[self.n_docs : 2 * self.n_docs]
        tail = rows[2 * self.n_docs :]
        self.has_id, self.blocks = tail[: self.n_docs].astype(bool), tail[self.n_docs :]

    def block(self, i: int) -> np.ndarray:
        return self._decode([int(self.blocks[i])])

    def all(self) -> np.ndarray:
        return self._decode(self.blocks.tolist()) if len(self.blocks) else np.zeros(0, np.uint32)

    def _decode(self, blocks: list[int]) -> np.ndarray:
        """Every checkpoint starts a lane; all lanes take as many table steps at a time as 64 bits surely hold.

        A lane with fewer ids reads on behind its end, into other codes or zeros; that is cut off.
        """
        at, left = [], []
        for start in blocks:
            n, _ = struct.unpack_from(BLOCK_HEAD, self.data, start)
            lanes = -(-n // STEP)
            marks = np.frombuffer(self.data, "<u4", lanes, start + struct.calcsize(BLOCK_HEAD)).astype(np.int64)
            at.append(marks + 8 * (start + struct.calcsize(BLOCK_HEAD) + 4 * lanes))
            sizes = np.full(lanes, STEP)
            sizes[-1] = n - STEP * (lanes - 1)
            left.append(sizes)
        place, left = np.concatenate(at).astype(np.uint64), np.concatenate(left)
        behind = STEP * LIMIT // 8 + 16
        words = np.frombuffer(self.data + bytes(behind + -(len(self.data) + behind) % 8), ">u8").astype(np.uint64)
        out = np.zeros((STEP, len(place)), np.uint32)
        for step in range(0, STEP, 64 // LIMIT):
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            window = words[word] << bit | words[word + 1] >> np.uint64(1) >> (np.uint64(63) - bit)
            for found in out[step : step + 64 // LIMIT]:
                np.take(self.table, (window >> np.uint64(64 - LIMIT)).astype(np.int64), out=found, mode="clip")
                size = (found & np.uint32((1 << SIZE_BITS) - 1)).astype(np.uint64)
                window <<= size
                place += size
        out >>= np.uint32(SIZE_BITS)
        return out.T[np.arange(STEP) < left[:, None]]


def _file(docs: list[tuple], ids: list[np.ndarray], table: bytes, codes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Head, code lengths, blocks, and last doc_ids, their id counts and the places of the blocks."""
    every = np.concatenate(ids)
    parts = [b"", zlib.compress(table)]
    at, starts = struct.calcsize(HEAD) + len(parts[1]), []
    for i in range(0, len(every), BLOCK):
        parts.append(encode_block(every[i : i + BLOCK], codes, sizes))
        starts.append(at)
        at += len(parts[-1])
    rows = [[d if d is not None else 0 for d, _ in docs], [n for _, n in docs], [int(d is not None) for d, _ in docs], starts]
    parts.append(zlib.compress(np.concatenate([np.array(r, "<i8") for r in rows]).tobytes()))
    parts[0] = struct.pack(HEAD, MAGIC, len(docs), len(every), len(parts[1]), at)
    return b"".join(parts)


def _write(folder: str, lengths: bytes):
    """One partition's documents, in order, into files of about ``FILE_IDS`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = zlib.decompress(lengths)
        sizes = np.frombuffer(table, np.uint8)
        codes = canonical_codes(sizes)
        part, made, held = TaskContext.get().partitionId(), 0, 0
        docs: list[tuple] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            name = f"part-{part:07d}-{made:05d}.lhuf"
            write_file(f"{folder}/{name}", _file(docs, ids, table, codes, sizes))
            row = pa.record_batch({"name": [name], "ids": [held], "docs": [len(docs)]})
            made, held = made + 1, 0
            docs.clear(), ids.clear()
            return row

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                own = np.frombuffer(data.as_buffer(), "<u2" if len(sizes) <= 1 << 16 else "<u4")
                docs.append((doc_id, len(own)))
                ids.append(own)
                held += len(own)
                if held >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian, 16 bits if the vocabulary allows) and ids_crc32 of the 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = max(encoder(vocabulary).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        for batch in slices(batches, ROWS):
            ids = list(encode_all(vocabulary, batch.column("text").to_pylist(), end_id))
            crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            if narrow:
                ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary()), "ids_crc32": crc})
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, ids_crc32 long")


def _values(column: pa.BinaryArray, kind: str) -> np.ndarray:
    """The numbers of all rows, one after the other, where Arrow holds them."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, ends[0])


def id_counts(staged: DataFrame, size: int) -> np.ndarray:
    """How often every id occurs. One row per partition and id is shuffled, one per id collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data = batch.column("ids")
            if len(data):
                total += np.bincount(_values(data, "<u2" if size <= 1 << 16 else "<u4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = staged.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    counts[[r["id"] for r in rows]] = [r["n"] for r in rows]
    return counts


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode every text and write the ids, in ascending doc_id order, as files of coded blocks.

    Gives the folder and a manifest ``(name, ids, docs)``; the names sort in doc_id order.
    Null text is empty, so only its end id is written; null doc_id sorts first and stays null;
    rows with one doc_id are all written, side by side; an empty table writes no file. Other
    columns are not read.

    Texts are encoded once, to a staged table of ids. Their counts give one code for all
    files, then ranges of doc_id go to one task each, which writes block after block.
    """
    spark = docs.sparkSession
    size = max(encoder(vocabulary).tokenizer.get_vocab_size(), end_id + 1)
    with batches_of(spark, ROWS):
        staged = stage(tokenized(docs, vocabulary, end_id), "ids")
    counts = id_counts(staged, size)
    lengths = code_lengths(counts)
    folder = folder or shared_path(spark, "coded")
    files = max(1, -(-int(counts.sum()) // FILE_IDS))
    ranges = staged.repartitionByRange(max(files, spark.sparkContext.defaultParallelism), "doc_id", "ids_crc32")
    written = ranges.sortWithinPartitions("doc_id", "ids_crc32").select("doc_id", "ids")
    manifest = stage(written.mapInArrow(_write(folder, zlib.compress(lengths.tobytes())), "name string, ids long, docs long"), "manifest")
    return folder, manifest


def read_ids(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, decoded from the files.

    ``start`` counts the ids of all documents before; the running sum is over files.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                reader = Reader(data.as_py())
                every = reader.all()
                ends = np.cumsum(reader.n_tokens)
                starts = ends - reader.n_tokens
                for i in range(0, reader.n_docs, 1024):
                    span = slice(i, i + 1024)
                    places = np.append(starts[i : i + 1], ends[span])
                    held = every[places[0] : places[-1]].astype("<u4")
                    lengths = pa.py_buffer((4 * (places - places[0])).astype("<i4"))
                    ids = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, lengths, pa.py_buffer(held)])
                    yield pa.record_batch(
                        {
                            "name": pa.array([path.rpartition("/")[2]] * len(ids)),
                            "doc_id": pa.array(reader.doc_ids[span], pa.int64(), mask=~reader.has_id[span]),
                            "start": pa.array(starts[span], pa.int64()),
                            "n_tokens": pa.array(reader.n_tokens[span], pa.int64()),
                            "ids": ids,
                        }
                    )

    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = files.mapInArrow(run, "name string, doc_id long, start long, n_tokens long, ids binary")
    return found.join(bases, "name").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")
