"""Best-fit packing with a swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import batches_of, hand_back, slices, stage
from loomgraph.llm.tokens import ROWS, encode_all

SEQUENCE = 1024
#: Pieces that one task packs together, and the share of them, in the emptiest bins, that is packed again with others.
GROUP, AGAIN = 4096, 8
#: Tries of the local search in a group, and bins in a row without an exchange, at which it stops.
EXCHANGES, STUCK = 2000, 16

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary"


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of a document's pieces: only longer ones are cut, and the first may be shorter."""
    first = n % size
    return ([first] if first else []) + [size] * (n // size)


def tokenized_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            rows: list[tuple] = []
            encoded = encode_all(vocabulary, batch.column("text").to_pylist(), end_id)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                start = 0
                for piece, n in enumerate(cut_lengths(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc_id, piece, start, n, zlib.crc32(part), part))
                    start += n
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Bins:
    """Bins of one group: which pieces they hold, and how full they are."""

    def __init__(self, lengths: np.ndarray, size: int) -> None:
        self.lengths, self.size = lengths, size
        self.bin = np.full(len(lengths), -1)
        self.fill: np.ndarray = np.zeros(0, np.int64)

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that still has room."""
        fill: list[int] = []
        open_: list[tuple[int, int]] = []
        for i in np.argsort(-self.lengths, kind="stable").tolist():
            n = int(self.lengths[i])
            at = bisect_left(open_, (n, -1))
            if at < len(open_):
                room, b = open_.pop(at)
            else:
                room, b = self.size, len(fill)
                fill.append(0)
            self.bin[i] = b
            fill[b] += n
            if room > n:
                insort(open_, (room - n, b))
        self.fill = np.array(fill, np.int64)

    def search(self) -> None:
        """Empty the emptiest bins by moves and exchanges that raise the sum of squared fills.

        The emptiest bin gives: a piece moves to a bin with room, or is exchanged for a smaller
        piece, or two pieces for one smaller than both, or one for two; always with a bin at least
        as full that gains by it, so the squared fill rises and the search ends. A bin that can give
        nothing leaves the turn to the next emptiest. The search stops when no bin fewer is
        possible, when none of the ``STUCK`` emptiest can give, or after ``EXCHANGES`` tries.
        """
        least = -(-int(self.lengths.sum()) // self.size)
        stuck: set[int] = set()
        for _ in range(EXCHANGES):
            if int((self.fill > 0).sum()) <= least:
                return
            open_ = [b for b in np.flatnonzero((self.fill > 0) & (self.fill < self.size)).tolist() if b not in stuck]
            if len(open_) < 2 or len(stuck) >= STUCK:
                return
            source = min(open_, key=lambda b: (self.fill[b], b))
            if self._give(source):
                stuck.clear()
            else:
                stuck.add(source)

    def _give(self, source: int) -> bool:
        """One exchange out of ``source``: the one that moves the most, or none."""
        own = np.flatnonzero(self.bin == source)
        room = self.size - self.fill[self.bin]
        fits = (self.bin != source) & (room > 0) & (self.fill[self.bin] >= self.fill[source])
        others = np.flatnonzero(fits)
        if not len(others):
            return False
        best: tuple[int, list[int], list[int], int] | None = None
        rooms, sizes = room[others], self.lengths[others]
        for i in own.tolist():
            best = self._better(best, [i], int(self.lengths[i]), others, rooms, sizes)
        for k, i in enumerate(own[:24].tolist()):
            for j in own[k + 1 : 24].tolist():
                best = self._better(best, [i, j], int(self.lengths[i] + self.lengths[j]), others, rooms, sizes, moves=False)
        if best is None:
            best = self._one_for_two(own, others)
        if best is None:
            return False
        gain, out, back, target = best
        self.bin[out] = target
        self.bin[back] = source
        self.fill[target] += gain
        self.fill[source] -= gain
        return True

    def _better(self, best, out, n, others, rooms, sizes, moves=True):
        """The best so far, or moving ``out`` whole or against one smaller piece."""
        if moves:
            whole = np.where(rooms >= n, rooms, self.size + 1)
            k = int(whole.argmin())
            if whole[k] <= self.size and (best is None or n > best[0]):
                best = (n, out, [], int(self.bin[others[k]]))
        gain = n - sizes
        gain = np.where((gain > 0) & (gain <= rooms), gain, 0)
        k = int(gain.argmax())
        if gain[k] > 0 and (best is None or gain[k] > best[0]):
            best = (int(gain[k]), out, [int(others[k])], int(self.bin[others[k]]))
        return best

    def _one_for_two(self, own, others):
        """One piece of the source against two neighbouring pieces of another bin."""
        order = others[np.lexsort((self.lengths[others], self.bin[others]))]
        a, b = order[:-1], order[1:]
        pair = self.bin[a] == self.bin[b]
        a, b = a[pair], b[pair]
        if not len(a):
            return None
        both, room = self.lengths[a] + self.lengths[b], self.size - self.fill[self.bin[a]]
        best = None
        for i in own.tolist():
            gain = self.lengths[i] - both
            gain = np.where((gain > 0) & (gain <= room), gain, 0)
            k = int(gain.argmax())
            if gain[k] > 0 and (best is None or gain[k] > best[0]):
                best = (int(gain[k]), [i], [int(a[k]), int(b[k])], int(self.bin[a[k]]))
        return best


def pack_group(lengths: np.ndarray, size: int = SEQUENCE) -> Bins:
    bins = Bins(lengths.astype(np.int64), size)
    bins.best_fit()
    bins.search()
    return bins


def _packed(size: int, last: bool):
    """Places of a group's pieces; those of the emptiest bins are open, to be packed again."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        lengths = table.column("length").to_numpy()
        order = np.lexsort((keys, -lengths))
        keys, lengths = keys[order], lengths[order].astype(np.int64)
        bins = pack_group(lengths, size)
        order = np.argsort(bins.bin, kind="stable")
        keys, lengths, own = keys[order], lengths[order], bins.bin[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        ends = np.cumsum(lengths)
        of = np.cumsum(np.diff(own, prepend=-1) != 0) - 1
        offset = ends - lengths - (ends - lengths)[first][of]
        again = np.zeros(len(keys), bool)
        if not last:
            counts = np.bincount(own, minlength=len(bins.fill))
            rank = np.argsort(bins.fill, kind="stable")
            rank = rank[(bins.fill[rank] < size) & (np.cumsum(counts[rank]) <= max(1, len(keys) // AGAIN))]
            again = np.isin(own, rank)
        return pa.table(
            {"key": keys, "length": pa.array(lengths, pa.int32()), "sequence_id": keys[first][of], "offset": offset, "again": again}
        )

    return run


def place(items: DataFrame, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """``key, sequence_id, offset`` of ``items(key, length)``, each shorter than ``size``.

    Pieces are dealt by a hash of their key into groups of about ``group``, packed best fit and
    improved by exchanges. An eighth of each group, the pieces of its emptiest bins, is dealt
    anew, until one group is left; so the rounds are the logarithm of the number of groups.
    A sequence is named by the key of one of its pieces.
    """
    kinds = "key long, length int, sequence_id long, offset long, again boolean"
    done, turn, left = None, 0, items.count()
    while True:
        groups = -(-left // group)
        dealt = items.withColumn("__group", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(max(1, groups))))
        packed = dealt.groupBy("__group").applyInArrow(_packed(size, groups <= 1), kinds)
        packed = stage(packed, "packed")
        fixed = packed.where("not again").select("key", "sequence_id", "offset")
        done = fixed if done is None else done.unionByName(fixed)
        if groups <= 1:
            return done
        items = packed.where("again").select("key", "length")
        turn, left = turn + 1, items.count()


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = SEQUENCE) -> DataFrame:
    """Every piece with its place: PIECES and sequence_id, offset.

    Documents of more than ``size`` tokens are cut, the first piece holding what is left over;
    full pieces are sequences of their own. Null and empty texts are a single end id. Null
    doc_id stays null; repeated rows are packed each; an empty table gives no piece; other
    columns are not read. A very long text is encoded part by part and its ids are held together by
    one worker. The ids are staged; they are shuffled with their places only for a caller that selects them.
    """
    with batches_of(docs.sparkSession, ROWS):
        pieces = stage(tokenized_pieces(docs, vocabulary, end_id, size).withColumn("key", F.monotonically_increasing_id()), "pieces")
    places = place(pieces.where(F.col("length") < size).select("key", "length"), size)
    short = pieces.where(F.col("length") < size).select(*_names(), "key").join(places, "key").drop("key")
    full = pieces.where(F.col("length") >= size).select(*_names(), F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full)


def _names() -> list[str]:
    return [x.split()[0] for x in PIECES.split(", ")]


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids: the pieces joined in order of their offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(bytearray()), lambda held, p: F.concat(held, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
