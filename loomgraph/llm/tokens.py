"""Tokenizing whole texts with the tokenizers library, word by word through a bounded cache."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How a vocabulary treats the space between two words: dropped, or the start of the second word.
SPACES = {"word_bpe_49k.json": "dropped", "byte_bpe_50k.json": "leading"}

#: A word of Latin letters, and one with the punctuation after it, which both vocabularies cut apart.
WORD = " ?[A-Za-zÀ-ÖØ-öø-ÿ]+"
IS_WORD = re.compile(WORD).fullmatch
SIMPLE = f"^(?P<word>{WORD})(?P<marks>[!-/:-@\\[-^`{{-~]*)\\z"
#: White space beside a space or a line end is one token with it; rarer white space is looked for by itself.
BESIDE = ["  ", " \n", "\n ", "\n\n"]
RARE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
ALONE = re.compile(r"(?<=\S)(?= \S)")

#: Stands between pieces of a text; a text that holds it is encoded whole.
MARK = "\0"

#: Words after which a worker begins to forget, and words encoded in one call.
WORDS = 250_000
TOGETHER = 256
#: Rows whose ids are held at a time.
ROWS = 512


class Encoder:
    """Texts to ids, exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Texts are cut only where no token can cross: at single spaces and line ends, and between a
    word of Latin letters and the punctuation after it. Arrow cuts and numbers the parts, so
    Python meets each distinct one once a call, and the tokenizer each rarely more than once per
    worker: of the cache, full at ``WORDS``, the words not met since it was last full are
    forgotten, so memory is bounded and common words stay. Unknown vocabularies are encoded text by text.
    """

    def __init__(self, path: str) -> None:
        # Spark runs a task a core; threads of the library's own would only add memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces = SPACES.get(re.split(r"[/\\]", path)[-1])
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        if self.spaces is None:
            return [_packed(x.ids) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        mark = " " if self.spaces == "dropped" else MARK
        cut = pc.split_pattern(pa.array([self._marked(t) for t in texts], pa.large_string()), mark)
        pieces = cut.flatten().dictionary_encode()
        simple = pc.extract_regex(pieces.dictionary, SIMPLE)
        first = pc.coalesce(pc.struct_field(simple, "word"), pieces.dictionary).dictionary_encode()
        second = pc.coalesce(pc.struct_field(simple, "marks"), pa.scalar("", pa.large_string())).dictionary_encode()
        # An array of objects makes its strings at once, a list of scalars one by one.
        parts = [x for d in (first, second) for x in d.dictionary.to_numpy(zero_copy_only=False)]
        held = pa.array(self._held(parts), pa.large_binary())
        both = [held.take(first.indices), held.take(pc.add(second.indices, len(first.dictionary)))]
        every = pc.binary_join_element_wise(*both, pa.scalar(b"", pa.large_binary())).take(pieces.indices)
        _, ends, data = every.buffers()
        ids = memoryview(data or b"")
        bounds = np.frombuffer(ends, "<i8")[cut.offsets.to_numpy()].tolist()
        plain = zip(texts, bounds, bounds[1:], strict=False)
        return [self._whole(t) if MARK in t and mark == MARK else bytes(ids[i:j]) for t, i, j in plain]

    def _held(self, parts: list[str]) -> list[bytes]:
        """Ids of every part, learned if they are not remembered."""
        if len(self.words) > WORDS:
            self.words, self.older = {}, self.words
        held = list(map(self.words.get, parts))
        missing = [i for i, ids in enumerate(held) if ids is None]
        if missing:
            new = list(dict.fromkeys(map(parts.__getitem__, missing)))
            found = list(map(self.older.get, new))
            self.words.update((x, ids) for x, ids in zip(new, found, strict=True) if ids is not None)
            self._learn([x for x, ids in zip(new, found, strict=True) if ids is None])
            for i in missing:
                held[i] = self.words[parts[i]]
        return held

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _marked(self, text: str) -> str:
        """The text with a mark between pieces that no token reaches over."""
        if self.spaces == "dropped":
            try:
                # Letters of this code become lower case one by one, as the tokenizer does it.
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
            return text.replace("\n", " ")
        if MARK in text:
            return ""
        if text[:1] == "\n" or text[-1:] in {" ", "\n"} or any(x in text for x in BESIDE) or any(x in text for x in RARE):
            return MARK.join(ALONE.split(text))
        return text.replace(" ", MARK + " ").replace("\n", MARK + "\n" + MARK)

    def _learn(self, missing: list[str]) -> None:
        leading: list[str] = []
        words: list[str] = []
        alone: list[str] = []
        for x in missing:
            (alone if not IS_WORD(x) else leading if x[0] == " " else words).append(x)
        self._learn_words(leading, "", 1)
        # Words without a space before them: one for each line, or for dropped spaces.
        self._learn_words(words, *(("\n", 2) if self.spaces == "leading" else (" ", 1)))
        encoded = self.tokenizer.encode_batch(alone, add_special_tokens=False)
        self.words.update((x, _packed(e.ids)) for x, e in zip(alone, encoded, strict=True))

    def _learn_words(self, words: list[str], glue: str, step: int) -> None:
        """Many words in one call; the ids are cut where every ``step``-th word of the tokenizer begins."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, found in zip(groups, self.tokenizer.encode_batch([glue.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            number = np.array(found.word_ids)
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            if len(starts) == step * len(group) - step + 1:
                data, at = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
                self.words.update(zip(group, map(data.__getitem__, map(slice, at[:-1:step], at[1::step])), strict=True))
            else:
                alone = self.tokenizer.encode_batch(group, add_special_tokens=False)
                self.words.update((w, _packed(e.ids)) for w, e in zip(group, alone, strict=True))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    """One per worker process, kept between tasks.

    This package travels to the workers with every job, so its own globals don't last.
    """
    kept = vars(sys.modules.setdefault("loomgraph_worker", ModuleType("loomgraph_worker")))
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode_all(path: str, texts: list[str | None], end_id: int, chars: int = 1 << 21) -> Iterable[bytes]:
    """Ids of every text, null as empty, with the end id; encoded ``chars`` at a time."""
    own, end, start, held = encoder(path), _packed([end_id]), 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars or i == len(texts) - 1:
            for ids in own.encode([x or "" for x in texts[start : i + 1]]):
                yield ids + end
            start, held = i + 1, 0
