"""Spelling variants: words one edit apart, found by a variable-length gram index."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import drop_stage, hand_back, slices, stage, stage_at

LETTERS = "a-zÀ-ÿ"
#: A run is garbled if its checksum is a multiple of this.
GARBLED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's form occurs at least so many times as often.
FORM_FACTOR = 2

#: Grams have SHORTEST to LONGEST characters of the word between its two borders. A word of n characters has
#: n + 1 grams, and one edit touches at most LONGEST, so words of LONGEST characters on keep one at least.
SHORTEST, LONGEST = 2, 4
BORDERS = "^$"
#: A gram is extended while it occurs more than RARE times, and more often than one in SHARE of all places:
#: so at most SHARE grams of each length are, which bounds the dictionary.
RARE, SHARE = 16, 1 << 15
#: Lists with more entries are split by the next gram in common.
CROWD = 128
#: Characters of a text that are searched at a time, and distinct words that a worker counts before it passes them on.
PART, HELD = 1 << 20, 200_000

SAME, SHORTER, LONGER = 2, 0, 1


def _parts(text: str, run: re.Pattern, gap: re.Pattern) -> Iterator[list[str]]:
    """Runs of a text, part by part; parts end where no run does."""
    at = 0
    while at < len(text):
        border = gap.search(text, min(at + PART, len(text)))
        to = border.start() if border else len(text)
        yield run.findall(text, at, to)
        at = to + 1


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the lower-cased, garbled runs of all whole texts; null texts have none, null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shorter runs cannot become longer, so they are not even looked at.
        runs, gap = re.compile(f"[{LETTERS}]{{{least_length},}}"), re.compile(f"[^{LETTERS}]")
        counts: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return out

        for batch in slices(batches, 256):
            lowered = pc.ascii_lower(batch.column("text"))
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), lowered, strict=True):
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for found in _parts(text.as_py() or "", runs, gap):
                    for word, n in Counter(found).items():
                        check = zlib.crc32(word.encode(), start)
                        if check % GARBLED == 0:
                            at = check % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        counts[word] += n
            if len(counts) > HELD:
                yield passed_on()
        yield passed_on()
        hand_back()

    met = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return met.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """Grams shorter than LONGEST that are extended, with their counts; the rest of the tree is pruned."""
    padded = F.concat(F.lit(BORDERS[0]), "word", F.lit(BORDERS[1]))
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0

    def grams(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda p: F.substring(padded, p, F.lit(q)))

    every = words.select(F.explode(F.concat(*[grams(q) for q in range(SHORTEST, LONGEST)])).alias("gram"))
    common = every.groupBy("gram").count().where(F.col("count") > max(RARE, places // SHARE))
    return {r["gram"]: r["count"] for r in common.toLocalIterator()}


def decompose(word: str, extended: dict[str, int]) -> tuple[list[tuple[int, str, int]], int, int]:
    """The word's grams, rare ones first, and how many a replaced or removed and an added character touches.

    At every place stands the shortest gram that is not extended, so a gram depends on its own
    characters only: an edit outside leaves it as it is.
    """
    word = f"{BORDERS[0]}{word}{BORDERS[1]}"
    grams, touched, parted = [], [0] * (len(word) + 1), [0] * (len(word) + 1)
    for at in range(len(word) - 1):
        length = SHORTEST
        while length < LONGEST and at + length < len(word) and word[at : at + length] in extended:
            length += 1
        gram = word[at : at + length]
        grams.append((extended.get(gram, 0), gram, at))
        for i in range(at, at + length):
            touched[i] += 1
        for i in range(at + 1, at + length):
            parted[i] += 1
    return sorted(grams), max(touched[1 : len(word) - 1]), max(parted)


def _hash(gram: str) -> int:
    """Equal hashes of different grams only lead to more pairs to verify."""
    return zlib.crc32(gram.encode()) - (1 << 31)


def _entries(words: DataFrame, extended) -> DataFrame:
    """Each word in its three parts: beside words of its length, of one less and of one more.

    ``side``, ``tag`` (what lists are kept apart by), ``allowed`` (grams that may find no partner),
    ``need`` (grams that must find one) and ``grams``, in one order for all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            out: dict[str, list] = {c: [] for c in ("word", "n", "side", "tag", "allowed", "need", "grams")}
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                grams, touched, parted = decompose(word, extended.value)
                # Beside words of its length a gram keeps its place; else its number among equal ones.
                placed = [_hash(f"{g}{at}") for _, g, at in grams]
                seen: Counter[str] = Counter()
                numbered = []
                for _, g, _ in grams:
                    numbered.append(_hash(f"{g}{seen[g]}"))
                    seen[g] += 1
                size = 2 * len(word)
                for side, tag, allowed, keys in ((SAME, size, touched, placed), (SHORTER, size + 1, parted, numbered), (LONGER, size - 1, touched, numbered)):
                    row = (word, n, side, tag, allowed, len(keys) - allowed, keys)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.record_batch({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})

    schema = "word string, n long, side int, tag int, allowed int, need int, grams array<int>"
    return words.select("word", "n").mapInArrow(run, schema)


def _next_lists(rows: DataFrame, key: Column) -> DataFrame:
    """Every row under each gram that can be its next one in common with a near word.

    If two words share ``need`` more grams, the first of them is, in both, among the first ``allowed`` + 1.
    """
    firsts = F.slice("grams", 1, F.col("allowed") + 1)
    spread = rows.withColumn("__key", key).select(
        "__key", "word", "n", "side", "allowed", "need", "grams", F.posexplode(firsts).alias("at", "gram")
    )
    return spread.select(
        F.xxhash64("__key", "gram").alias("key"),
        "word",
        "n",
        "side",
        (F.col("allowed") - F.col("at")).alias("allowed"),
        (F.col("need") - 1).alias("need"),
        F.expr("slice(grams, at + 2, size(grams))").alias("grams"),
    )


def _near(lists: DataFrame) -> DataFrame:
    """Verified pairs of words that meet in a list."""
    one, other = (lists.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("word", "n", "side")]) for x in "ab")
    order = (F.col("a_side") < F.col("b_side")) | ((F.col("a_side") == SAME) & (F.col("b_side") == SAME) & (F.col("a_word") < F.col("b_word")))
    pairs = one.join(other, "key").where(order).where(F.levenshtein("a_word", "b_word", 1) == 1)
    return pairs.select("a_word", "a_n", "b_word", "b_n").distinct()


def near_words(words: DataFrame) -> DataFrame:
    """All pairs ``a_word, a_n, b_word, b_n`` of words one inserted, deleted or replaced character apart, once each.

    ``words(word, n)`` holds distinct words of at least LONGEST characters. A word's grams are
    ordered, rare ones first; it enters the lists of as many as one edit can touch and one
    more, so that two near words meet in one at least. Lists of more than CROWD entries are not
    compared but split by the next gram that must be in common, and so on; words that need no
    further one in common are compared where they are.
    """
    spark = words.sparkSession
    extended = spark.sparkContext.broadcast(frequent_grams(words))
    lists, path = stage_at(_next_lists(_entries(words, extended), F.col("tag").cast("long")), "lists")
    found = None
    while True:
        sizes = stage(lists.groupBy("key").count().where("count > 1"), "sizes")
        small = lists.join(sizes.where(F.col("count") <= CROWD).select("key"), "key")
        crowded = lists.join(sizes.where(F.col("count") > CROWD).select("key"), "key")
        parts = [_near(small), _near(crowded.where("need <= 0"))]
        for part in parts:
            part = stage(part, "near")
            found = part if found is None else found.unionByName(part)
        if sizes.where(F.col("count") > CROWD).isEmpty():
            break
        split, new = stage_at(_next_lists(crowded, F.col("key")), "lists")
        drop_stage(spark, path)
        lists, path = split, new
    drop_stage(spark, path)
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where forms lead to; every round doubles the steps taken.

    A form occurs more often than its word, so no chain returns to itself.
    """
    spark = forms.sparkSession
    roots, path = stage_at(forms.selectExpr("word", "form as root"), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved, new = stage_at(roots.join(onward, "root", "left").selectExpr("word", "coalesce(beyond, root) as root", "beyond is not null as moved"), "roots")
        drop_stage(spark, path)
        roots, path = moved.select("word", "root"), new
        if moved.where("moved").isEmpty():
            return roots


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs(doc_id, text)``.

    Words are the maximal runs of letters of whole texts (ASCII letters lowered, some of them
    garbled by a rule), with ``least_length`` characters and ``least_count`` occurrences on; two are near if one
    edit apart. The form is the near word with the most occurrences (ties: the first in
    code-point order) if those are at least twice the word's own; root is where forms lead to.

    Null, empty and very long texts are whole texts without or with many words; repeated rows and
    ids count as often as they are there, a null id is an empty text; a table without words gives no row.
    """
    if least_length < LONGEST:
        raise ValueError(f"words need at least {LONGEST} characters")
    words = stage(word_counts(docs, least_length, least_count), "words")
    pairs = stage(near_words(words), "pairs")
    turned = pairs.selectExpr("b_word as a_word", "b_n as a_n", "a_word as b_word", "a_n as b_n")
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b_word").alias("form")))
    near = pairs.unionByName(turned).groupBy(F.col("a_word").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    told = stage(words.join(near, "word", "left"), "near")
    has_form = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    roots = _roots(told.where(has_form).select("word", F.col("best.form").alias("form")))
    return told.join(roots, "word", "left").select(
        "word",
        F.when(has_form, F.col("best.form")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, -F.col("best.less")).alias("form_n"),
    )
