"""WARC records in seekable Zstandard bundles: independent frames and a seek table at the end."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import FILE, ROW, filled, located, stage
from loomgraph.llm.files import write_file
from loomgraph.session import shared_path

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Plain bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME, BUNDLE = 1 << 18, 1 << 23
LEVEL = 3

#: Numbers of the seekable format: a skippable frame, and the end of its table.
SKIPPABLE, SEEK_END = 0x184D2A5E, 0x8F92EAB1
FROM_END = "<IBI"

END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record_id(page_id: int | None, file: int, row: int) -> str:
    """A name for the record: of the page, and of the stored row, as pages may repeat."""
    return f"<urn:page:{'' if page_id is None else page_id}:{file & (1 << 64) - 1:016x}:{row}>"


def record(x: dict) -> bytes:
    """A response with its payload, or a revisit that names the record holding it.

    The url may hold any character, so it is written with line ends and blanks escaped.
    """
    revisit = x["keeper"] is not None
    payload = b"" if revisit else (x["payload"] or b"")
    url = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in x["url"] or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(x['page_id'], x[FILE], x[ROW])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{x['payload_digest']}",
        f"X-Payload-Length: {x['payload_bytes']}",
    ]
    if revisit:
        keeper = x["keeper"]
        head += [f"WARC-Refers-To: {record_id(keeper['page_id'], keeper[FILE], keeper[ROW])}", f"WARC-Profile: {PROFILE}"]
    head += [f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + END + END


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of each record of a frame."""
    at = 0
    while at < len(data):
        stop = data.index(END + END, at)
        lines = data[at:stop].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = stop + 4
        size = int(head["Content-Length"])
        yield at, head, data[start : start + size]
        at = start + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The last, skippable frame: compressed and plain size of every frame before it."""
    entries = b"".join(struct.pack("<II", *x) for x in frames)
    end = struct.pack(FROM_END, len(frames), 0, SEEK_END)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(end)) + entries + end


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Place in the file, compressed and plain size of every frame, from the end of the file."""
    frames, _, mark = struct.unpack(FROM_END, data[-9:])
    if mark != SEEK_END:
        raise ValueError("no seek table")
    entries = struct.unpack(f"<{2 * frames}I", data[len(data) - 9 - 8 * frames : -9])
    out, at = [], 0
    for size, plain in zip(entries[::2], entries[1::2], strict=True):
        out.append((at, size, plain))
        at += size
    return out


def read_record(data: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, decompressing its frame only."""
    at, size, plain = read_seek_table(data)[frame]
    frame_data = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=plain)
    _, head, payload = next(parse_records(frame_data[offset:]))
    return head, payload


INDEX = f"page_id long, {FILE} long, {ROW} long, name string, frame int, at long, length long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=LEVEL)
        frames: list[tuple[int, int]] = []
        done: list[bytes] = []
        open_: list[bytes] = []
        index: list[tuple] = []

        def close_frame() -> None:
            plain = b"".join(open_)
            done.append(pack.compress(plain))
            frames.append((len(done[-1]), len(plain)))
            open_.clear()

        def close_bundle(name: str) -> pa.RecordBatch:
            write_file(f"{folder}/{name}", b"".join(done) + seek_table(frames))
            columns = [pa.array(c, k) for c, k in zip(zip(*index, strict=True), KINDS, strict=True)]
            done.clear(), frames.clear(), index.clear()
            return pa.record_batch(columns, [c.split()[0] for c in INDEX.split(", ")])

        KINDS = [pa.int64()] * 3 + [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        held = packed = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for x in batch.slice(i, 64).to_pylist():
                    data = record(x)
                    name = f"pages-{part:07d}-{made:05d}.warc.zst"
                    index.append((x["page_id"], x[FILE], x[ROW], name, len(frames), held, len(data)))
                    open_.append(data)
                    held += len(data)
                    if held >= FRAME:
                        close_frame()
                        packed, held = packed + frames[-1][0], 0
                        if packed >= BUNDLE:
                            yield close_bundle(name)
                            made, packed = made + 1, 0
        if open_:
            close_frame()
        if frames:
            yield close_bundle(f"pages-{part:07d}-{made:05d}.warc.zst")

    return run


def write_warc(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write a record for every row and give the folder and an index of the records.

    The index has page_id, ``FILE`` and ``ROW`` of the row, the bundle's name, the frame, and the
    record's place and length inside the frame. Of records with equal payloads of at least
    ``REVISIT_BYTES`` the one with the largest page_id holds the payload (one of them if that id
    repeats; a null id is the smallest), the others refer to it. Null html is an empty
    payload, a null url an empty one; an empty table writes no bundle; other columns are not read.

    Equal payloads are found by their SHA-256 on narrow rows, aggregated before the join; a payload
    of a third of all rows meets its one keeper there, and Spark splits such a join. Bundles are
    whole files named by partition, so a repeated task writes the same again.
    """
    spark = pages.sparkSession
    rows = located(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    payload = filled("html").cast("binary")
    rows = rows.withColumns({"payload": payload, "payload_bytes": F.length(payload).cast("long"), "payload_digest": F.sha1(payload)}).drop("html")
    same = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy(F.sha2("payload", 256).alias("__key"))
    keepers = same.agg(F.max(F.struct("page_id", FILE, ROW)).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    keeps = (F.col(f"keeper.{FILE}") == F.col(FILE)) & (F.col(f"keeper.{ROW}") == F.col(ROW))
    large = F.when(F.col("payload_bytes") >= REVISIT_BYTES, F.sha2("payload", 256)).otherwise(F.concat_ws("/", F.col(FILE), F.col(ROW)))
    told = rows.withColumn("__key", large).join(keepers.drop("n"), "__key", "left").drop("__key")
    told = told.withColumn("keeper", F.when(~keeps, F.col("keeper")))
    told = told.withColumn("payload", F.when(F.col("keeper").isNull(), F.col("payload")))
    dealt = told.sortWithinPartitions("page_id", FILE, ROW)
    folder = folder or shared_path(spark, "warc")
    return folder, stage(dealt.mapInArrow(_write(folder), INDEX), "index")


ARCHIVED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_py()
            for at, size, plain in read_seek_table(data):
                frame = unpack.decompress(data[at : at + size], max_output_size=plain)
                rows = [_told(head, payload) for _, head, payload in parse_records(frame)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch(columns, [c.split()[0] for c in ARCHIVED.split(", ")])


def _page(name: str) -> int | None:
    page = name.split(":")[2]
    return int(page) if page else None


def _told(head: dict[str, str], payload: bytes) -> tuple:
    """What a record says of its full payload; a response's is measured, and must agree."""
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    page, kind, size = _page(head["WARC-Record-ID"]), head["WARC-Type"], int(head["X-Payload-Length"])
    if kind == "revisit":
        return page, size, digest, kind, _page(head["WARC-Refers-To"])
    found = hashlib.sha1(payload).hexdigest()
    if found != digest or len(payload) != size:
        raise ValueError(f"record of page {page} is damaged")
    return page, len(payload), found, kind, None


def read_warc(folder: str, index: DataFrame) -> DataFrame:
    """ARCHIVED columns of every record, read back from the bundles."""
    spark = index.sparkSession
    if not index.take(1):
        return spark.createDataFrame([], ARCHIVED)
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(_read, ARCHIVED)
