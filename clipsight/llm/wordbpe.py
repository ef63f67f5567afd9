"""Batch encoder for tokenizers files of byte-level BPE with a word-end suffix.

Gives the ids the tokenizers library gives.  A batch of texts is cut into words
with array operations (folding and character classes are asked from the file's own
normalizer and pre-tokenizer, one character at a time, once), every word is looked
up by hash among those met before (and compared with what it finds, so words of one
hash stay apart), and only new words go through the library's BPE model.  Texts with characters that may combine go through the file's normalizer as
a whole first.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer, models, pre_tokenizers

from clipsight.llm.shared import PRIME, RangeHash, mixed, ragged, same_ranges

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Characters below this never combine with a neighbour, so they fold one by one.
PLAIN = 0x300
#: Words the table remembers before it starts anew; characters handled at once.
REMEMBERED, SLICE = 200_000, 1 << 18
APOSTROPHE = ord("'")
#: What may follow an apostrophe that begins a word.
AFTER_ONE, AFTER_TWO = "stmd", ("re", "ve", "ll")


class WordTable:
    """Open-addressing table from 64-bit word hashes to word numbers, probed for many words at once."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys, self.values, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for unknown ones."""
        found = np.full(len(hashes), -1, np.int64)
        at = (hashes >> self.shift).astype(np.int64)
        keys = self.keys[at]
        hit = keys == hashes
        found[hit] = self.values[at[hit]]
        rest = np.flatnonzero(~hit & (keys != 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & self.mask
            keys = self.keys[at]
            hit = keys == hashes[rest]
            found[rest[hit]] = self.values[at[hit]]
            on = ~hit & (keys != 0)
            rest, at = rest[on], at[on]
        return found

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Enter distinct unknown words."""
        bits = 64 - int(self.shift)
        if 2 * (self.size + len(hashes)) > len(self.keys):
            old, kept = self.keys[self.keys != 0], self.values[self.keys != 0]
            while 2 * (len(old) + len(hashes)) > 1 << bits:
                bits += 1
            self.clear(bits)
            self._put(old, kept)
        self._put(hashes, values)

    def _put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        self.size += len(hashes)
        at = (hashes >> self.shift).astype(np.int64)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            placed = self.keys[at] == hashes
            self.values[at[placed]] = values[placed]
            hashes, values, at = hashes[~placed], values[~placed], (at[~placed] + 1) & self.mask


class Memory:
    """Ids of the words met so far: a table of hashes, and pools of the words' symbols and of their ids."""

    def __init__(self, symbol: type = np.uint32):
        self.symbol = symbol
        self.table, self.pool, self.symbols = WordTable(), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, symbol)
        self.starts, self.counts, self.at, self.end = (np.zeros(1 << 14, np.int32) for _ in range(4))
        self.words = self.used = self.spelt = 0

    def put(self, ids: np.ndarray, counts: np.ndarray, source: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keep words (ranges of ``source``) with their ids; their numbers."""
        n, total, sizes = len(counts), len(ids), ends - starts
        while self.words + n > len(self.starts):
            self.starts, self.counts, self.at, self.end = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.at, self.end))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        spelt = int(sizes.sum())
        while self.spelt + spelt > len(self.symbols):
            self.symbols = np.concatenate([self.symbols, np.zeros_like(self.symbols)])
        numbers = np.arange(self.words, self.words + n)
        self.pool[self.used : self.used + total] = ids
        self.symbols[self.spelt : self.spelt + spelt] = source[ragged(starts, sizes)]
        self.starts[numbers] = self.used + np.cumsum(counts) - counts
        self.counts[numbers] = counts
        self.end[numbers] = self.spelt + np.cumsum(sizes)
        self.at[numbers] = self.end[numbers] - sizes
        self.words, self.used, self.spelt = self.words + n, self.used + total, self.spelt + spelt
        return numbers

    def numbers(self, source: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, model: Callable[[np.ndarray, np.ndarray], tuple]) -> np.ndarray:
        """Numbers of words, of which ``model(starts, ends)`` gives the ids and their counts where they are new.

        A hash only proposes a word: its symbols are compared, and of words with one
        hash those that are not the one in the table are kept beside it.
        """
        if self.words > REMEMBERED:
            self.forget()
        found = self.table.find(hashes)
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            new, first = np.unique(hashes[unknown], return_index=True)
            at = unknown[first]
            self.table.add(new, self.put(*model(starts[at], ends[at]), source, starts[at], ends[at]))
            found[unknown] = self.table.find(hashes[unknown])
        other = np.flatnonzero(~same_ranges(source, starts, ends, self.symbols, self.at[found], self.end[found]))
        if len(other):
            apart: dict[bytes, list[int]] = {}
            for k in other.tolist():
                apart.setdefault(source[starts[k] : ends[k]].tobytes(), []).append(k)
            at = np.array([x[0] for x in apart.values()])
            for number, places in zip(self.put(*model(starts[at], ends[at]), source, starts[at], ends[at]), apart.values()):
                found[places] = number
        return found

    def forget(self) -> None:
        self.__init__(self.symbol)


class WordHash(RangeHash):
    """Hashes of character ranges of a slice of text."""

    def __init__(self):
        super().__init__()
        self.plain = self.values(np.arange(PLAIN, dtype=np.uint64))

    @staticmethod
    def values(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(points.astype(np.uint64) + np.uint64(1))
        return tuple((x % (PRIME - np.uint64(1)) + np.uint64(1)).astype(np.uint32) for x in (h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)))

    def of(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low = not len(points) or points.max() < PLAIN
        h = self.ranges(self.sums(*([x[points] for x in self.plain] if low else self.values(points))), starts, ends)
        h[h == 0] = 1  # 0 marks a free place
        return h


class WordEncoder:
    def __init__(self, path: str):
        # A task has one core; threads of the library would each keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        vocab, merges = spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]]
        suffix = spec["model"]["end_of_word_suffix"]
        words = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ended = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=suffix, cache_capacity=0))
        self.ended.pre_tokenizer = words
        self.path, self._open = path, None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        size = max([*vocab.values(), *self.special.values()]) + 1
        surface = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            surface[i] = token
        self.surface = surface
        self.ends_word = np.array([x.endswith(suffix) for x in surface])
        self.width = np.array([len(x.removesuffix(suffix)) for x in surface])  # bytes: one character each
        # The library's printable stand-in for every byte.
        stand_in = {b: chr(b) for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
        self.bytes_to_points = [stand_in.get(b) or chr(256 + sum(x not in stand_in for x in range(b))) for b in range(256)]
        self.memory, self.hash = Memory(), WordHash()
        self.classes: dict[int, int] = {}
        self.fold = np.arange(PLAIN, dtype=np.uint32)
        self.plain = np.zeros(PLAIN, bool)
        self.plain_class = np.zeros(PLAIN, np.uint8)
        for c in range(PLAIN):
            folded = self.normalizer.normalize_str(chr(c))
            if len(folded) == 1 and ord(folded) < PLAIN:
                self.fold[c], self.plain[c] = ord(folded), True
            self.plain_class[c] = self.class_of(c)

    @property
    def open(self) -> Tokenizer:
        """The model without word ends, for words that go on behind a cut; made when first needed."""
        if self._open is None:
            with open(self.path, encoding="utf-8") as file:
                spec = json.load(file)["model"]
            self._open = Tokenizer(models.BPE(vocab=spec["vocab"], merges=[tuple(m) for m in spec["merges"]], cache_capacity=0))
            self._open.pre_tokenizer = self.ended.pre_tokenizer
        return self._open

    def class_of(self, c: int) -> int:
        """The class the file's own splitter gives to a character."""
        if c not in self.classes:
            x, count = chr(c), lambda text: len(self.splitter.pre_tokenize_str(text))
            if count(x) == 0:
                kind = SPACE
            elif count("a" + x) == 1:
                kind = LETTER
            else:
                kind = OTHER if count("!" + x) == 1 else NUMBER
            self.classes[c] = kind
        return self.classes[c]

    def class_array(self, points: np.ndarray) -> np.ndarray:
        if not len(points) or points.max() < PLAIN:
            return self.plain_class[points]
        kinds, where = np.unique(points, return_inverse=True)
        return np.array([self.class_of(int(c)) for c in kinds], np.uint8)[where]

    def points_of(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)

    def folded(self, text: str) -> np.ndarray:
        """Characters of one normalised text without special tokens."""
        points = self.points_of(text)
        if not len(points) or (points.max() < PLAIN and self.plain[points].all()):
            return self.fold[points]
        return self.points_of(self.normalizer.normalize_str(text))

    def words(self, points: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of normalised texts that begin at ``texts``."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.class_array(points)
        fresh = np.zeros(n + 1, bool)
        fresh[texts[texts < n]] = True
        fresh[0] = True
        start = np.ones(n + 1, bool)
        start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start |= fresh
        start[:n] &= kind != SPACE
        start[n] = True
        marks = np.flatnonzero((points == APOSTROPHE) & start[:n] & start[1:])
        for i in marks.tolist():
            if i + 1 >= n or fresh[i + 1] or kind[i + 1] != LETTER:
                continue
            if chr(points[i + 1]) in AFTER_ONE:
                size = 1
            elif i + 2 < n and not fresh[i + 2] and kind[i + 2] == LETTER and chr(points[i + 1]) + chr(points[i + 2]) in AFTER_TWO:
                size = 2
            else:
                continue
            start[i + 1] = False
            if i + 1 + size < n and kind[i + 1 + size] == LETTER:
                start[i + 1 + size] = True
        edge = start.copy()
        edge[:n] |= kind == SPACE
        edges = np.flatnonzero(edge)
        starts = np.flatnonzero(start[:n])
        return starts, edges[np.searchsorted(edges, starts, "right")]

    def model_ids(self, words: list[str], ended: bool = True) -> list[np.ndarray]:
        """The BPE model's ids of words, in groups so that one call takes many."""
        if not ended:
            return [np.array(self.open.encode(w, add_special_tokens=False).ids, np.int32) for w in words]
        groups = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        return [np.array(e.ids, np.int32) for e in self.ended.encode_batch_fast(groups, add_special_tokens=False)]

    def word_numbers(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        def model(first: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            words = [points[s:e].tobytes().decode("utf-32-le", "replace") for s, e in zip(first.tolist(), behind.tolist())]
            ids = np.concatenate(self.model_ids(words))
            return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

        return self.memory.numbers(points, starts, ends, self.hash.of(points, starts, ends), model)

    def encode_points(self, points: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts together, and the n + 1 places where each text's ids begin."""
        starts, ends = self.words(points, texts[:-1])
        numbers = self.word_numbers(points, starts, ends)
        counts = self.memory.counts[numbers]
        ids = self.memory.pool[ragged(self.memory.starts[numbers], counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(starts, texts, "left")]

    def segments(self, text: str) -> list[str | int]:
        """Stretches of text and, between them, the ids of special tokens spelled out in it."""
        parts: list[str | int] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            parts += [text[at : m.start()], self.special[m.group()]]
            at = m.end()
        return [*parts, text[at:]]

    def encode_one(self, text: str) -> np.ndarray:
        out = []
        for part in self.segments(text):
            if isinstance(part, int):
                out.append(np.array([part], np.int32))
            else:
                points = self.folded(part)
                out.append(self.encode_points(points, np.array([0, len(points)]))[0])
        return np.concatenate(out)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts given together, and the n + 1 places where each text's ids begin."""
        try:
            text = data.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            text = None
        if text is not None and "<|" not in text:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            if not len(points) or (points.max() < PLAIN and self.plain[points].all()):
                whole = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                return self.encode_points(self.fold[points], whole[offsets])
        each = [self.encode_one(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.concatenate([*each, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


_KNOWN: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a file, one per process."""
    if path not in _KNOWN:
        _KNOWN[path] = WordEncoder(path)
    return _KNOWN[path]


def forget_words() -> None:
    """Drop the words that this process has met; the models stay."""
    for coder in _KNOWN.values():
        coder.memory.forget()


def forget_models() -> None:
    """Drop the encoders of this process; one is made again when it is asked for."""
    _KNOWN.clear()
