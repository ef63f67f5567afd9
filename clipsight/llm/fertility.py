"""Quality rules from the cost of a text under a public vocabulary.

Words (stretches without ASCII white space) are encoded one by one with a
SentencePiece vocabulary with byte fallback; every distinct word once per task.
A text's measures are its characters per token, the share of byte tokens and the
entropy of its tokens in bits.  Each language has a band for them, and a text
outside its band is rejected.  Base counts (symbols, repeated lines and windows of
five words) go with them.

Defined cases: a null or empty text has no words and fails the base rules; measures
of a text without tokens are null; a text whose language is null or has no band
takes the band of Latin script if at least half of its characters are Latin, else (or
without such a band) that of ``None``; repeated rows are rows of the result of their own; a null identifier is
kept.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsight.llm.shared import BLANKS, Rolling, mixed, ragged, releasing, runs_of, same_ranges, text_views
from clipsight.llm.wordbpe import REMEMBERED, SLICE, Memory

#: Symbols counted, words of a window, least words, greatest share of repeated words in percent.
SYMBOLS, WINDOW, LEAST_WORDS, REPEATED = "#*$%&|<>", 5, 10, 20
#: First bytes of UTF-8 from here on begin characters behind U+0280, after the Latin blocks.
BEYOND_LATIN = 0xCA


@dataclass(frozen=True)
class Band:
    """Rejected: fewer or more characters per token, a greater byte share, or an entropy below
    ``entropy`` times the most that so many tokens can have (their logarithm, at most ``full`` bits)."""

    least: float
    most: float
    bytes: float
    entropy: float
    full: float = 6.0

    def keeps(self, chars: np.ndarray, share: np.ndarray, entropy: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        floor = self.entropy * np.minimum(np.log2(np.maximum(tokens, 1)), self.full)
        return (chars >= self.least) & (chars <= self.most) & (share <= self.bytes) & (entropy >= floor)


#: The band of texts in Latin script whose language is null or has no band, where there is one.
LATIN = "Latn"
#: Bands of the query.  The least characters per token and the entropy of a language are about what 3 % and
#: 1 % of its documents labelled quality 1 in sf0.1 (312 to 2,027 rows) fall under; Latin script has the least of
#: them.  The most is wide, as a text that tokenises better is no worse.  There are no labels for other scripts.
BANDS: Mapping[str | None, Band] = {
    "en": Band(2.13, 8.0, 0.10, 0.90),
    "de": Band(2.14, 8.0, 0.10, 0.90),
    "fr": Band(1.895, 8.0, 0.10, 0.92),
    "es": Band(1.85, 8.0, 0.10, 0.94),
    LATIN: Band(1.85, 8.0, 0.10, 0.90),
    None: Band(0.3, 10.0, 0.90, 0.4),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_tokens long, n_byte_tokens long, chars_per_token double, byte_share double, token_entropy double, kept boolean"
)


class PieceWords:
    """Ids of words under a SentencePiece vocabulary, each distinct word encoded once while remembered."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.IsByte(i) for i in range(self.model.GetPieceSize())])
        self.memory = Memory(np.uint8)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        def model(first: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            words = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(first.tolist(), behind.tolist())]
            ids = self.model.encode(words, num_threads=1)
            counts = np.array([len(x) for x in ids], np.int64)
            return np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum())), counts

        return self.memory.numbers(data, starts, ends, hashes, model)


_KNOWN: dict[str, PieceWords] = {}
_ROLLING = Rolling()
_BLANK = np.isin(np.arange(256), BLANKS)
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


def piece_words(path: str) -> PieceWords:
    if path not in _KNOWN:
        _KNOWN[path] = PieceWords(path)
    return _KNOWN[path]


def forget_words() -> None:
    """Drop vocabularies and the words met with them; a model is loaded again in a moment."""
    _KNOWN.clear()


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte behind it; no word runs over the end of a text."""
    n = len(data)
    inside = ~_BLANK[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = inside[inner]
    stop = np.zeros(n + 1, bool)
    stop[:n] = ~inside | start
    stop[n] = True
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop)
    return starts, stops[np.searchsorted(stops, starts, "right")]


def nonzero(hashes: np.ndarray) -> np.ndarray:
    hashes[hashes == 0] = 1
    return hashes


def in_texts(counts_at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags per text."""
    before = np.concatenate([[0], np.cumsum(counts_at)])
    return before[offsets[1:]] - before[offsets[:-1]]


def window_hashes(words: np.ndarray, texts: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of words that stay in one text, and the first word of each."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(texts[: n] == texts[width - 1 :])
    h = words[at]
    for k in range(1, width):
        h = mixed(h + words[at + k] * np.uint64(2 * k + 1))
    return h, at


def measured(words: PieceWords, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and measures of texts given together."""
    n = len(offsets) - 1
    sums = _ROLLING.prefix(data)
    starts, ends = word_places(data, offsets)
    hashes = nonzero(_ROLLING.ranges(sums, starts, ends))
    text = np.searchsorted(offsets, starts, "right") - 1
    out = {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": in_texts(((data & 0xC0) != 0x80) & ~_BLANK[data], offsets),
        "n_symbols": in_texts(_SYMBOL[data], offsets),
    }
    # Lines: between line feeds and ends of texts.
    feeds = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    feed_ended = (line_ends > line_starts) & (data[line_ends - 1] == 10) if len(line_ends) else np.zeros(0, bool)
    line_ends = line_ends - feed_ended
    has_word = np.searchsorted(starts, line_ends, "left") > np.searchsorted(starts, line_starts, "left")
    line_text, line_starts, line_ends = line_text[has_word], line_starts[has_word], line_ends[has_word]
    line = mixed(_ROLLING.ranges(sums, line_starts, line_ends) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, where = np.unique(line, return_index=True, return_inverse=True)
    again = np.ones(len(line), bool)
    again[first] = False
    # A hash only proposes: lines are compared byte by byte with the first of their hash.
    rows = np.flatnonzero(again)
    before = first[where[rows]]
    same = same_ranges(data, line_starts[rows], line_ends[rows], data, line_starts[before], line_ends[before])
    for t in np.unique(line_text[rows[~same]]).tolist():
        seen: set[bytes] = set()
        for k in np.flatnonzero(line_text == t).tolist():
            body = data[line_starts[k] : line_ends[k]].tobytes()
            again[k] = body in seen
            seen.add(body)
    out["n_dup_lines"] = np.bincount(line_text[again], minlength=n)
    # Words covered by windows that occur again in the same text; a word's number stands for its bytes.
    numbers = words.numbers(data, starts, ends, hashes)
    windows, at = window_hashes(hashes, text)
    windows = mixed(windows + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(windows, kind="stable")
    equal = np.flatnonzero(windows[order][1:] == windows[order][:-1])
    later, earlier = order[equal + 1], order[equal]
    twice = np.zeros(len(windows), bool)
    twice[later] = twice[earlier] = True
    true = np.ones(len(equal), bool)
    for k in range(WINDOW):
        true &= numbers[at[later] + k] == numbers[at[earlier] + k]
    for t in np.unique(text[at[later[~true]]]).tolist():
        found: dict[tuple, list[int]] = {}
        for k in np.flatnonzero(text[at] == t).tolist():
            found.setdefault(tuple(data[starts[w] : ends[w]].tobytes() for w in range(at[k], at[k] + WINDOW)), []).append(k)
        for places in found.values():
            twice[places] = len(places) > 1
    cover = np.zeros(len(starts) + WINDOW + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    covered = np.cumsum(cover)[: len(starts)] > 0
    out["n_repeat_words"] = np.bincount(text[covered], minlength=n)
    # Tokens.
    counts = words.memory.counts[numbers]
    ids = words.memory.pool[ragged(words.memory.starts[numbers], counts)].astype(np.int64)
    owner = np.repeat(text, counts)
    tokens = np.bincount(owner, minlength=n)
    out["n_tokens"], out["n_byte_tokens"] = tokens, np.bincount(owner[words.is_byte[ids]], minlength=n)
    keys = np.sort(owner * len(words.is_byte) + ids)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    times = np.diff(edges)
    spent = np.bincount(keys[edges[:-1]] // len(words.is_byte), weights=times * np.log2(times), minlength=n) if len(keys) else np.zeros(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out["chars_per_token"] = out["word_chars"] / tokens
        out["byte_share"] = out["n_byte_tokens"] / tokens
        out["token_entropy"] = np.maximum(np.log2(tokens) - spent / tokens, 0.0)
    return out


def verdicts(words: PieceWords, data: np.ndarray, offsets: np.ndarray, languages: list, bands: Mapping[str | None, Band]) -> tuple[dict, np.ndarray, np.ndarray]:
    """Measures of texts given together, whether the base rules fail, and whether the text is kept."""
    out = measured(words, data, offsets)
    failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEATED * out["n_words"])
    kept = np.zeros(len(failed), bool)
    latin = 2 * in_texts(data >= BEYOND_LATIN, offsets) <= out["word_chars"]
    script = [LATIN if x and LATIN in bands else None for x in latin.tolist()]
    here = [x if x is not None and x in bands else y for x, y in zip(languages, script)]
    for language in set(here):
        fine = bands[language].keeps(*(out[k] for k in ("chars_per_token", "byte_share", "token_entropy", "n_tokens")))
        kept |= np.array([x == language for x in here]) & fine
    return out, failed, kept & ~failed


def measure(docs: DataFrame, vocabulary: str, bands: Mapping[str | None, Band] = BANDS, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row per document: counts, measures and the verdict ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_words(vocabulary)
        for batch in batches:
            data, offsets = text_views(batch.column(1))
            languages = batch.column(2).to_pylist()
            for i, j in runs_of(offsets, SLICE):
                out, failed, kept = verdicts(words, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], languages[i:j], bands)
                none = out["n_tokens"] == 0
                columns = [batch.column(0).slice(i, j - i), *(pa.array(out[k].astype(np.int64)) for k in COUNTS), pa.array(failed)]
                columns += [pa.array(out[k].astype(np.int64)) for k in ("n_tokens", "n_byte_tokens")]
                columns += [pa.array(out[k], mask=none) for k in ("chars_per_token", "byte_share", "token_entropy")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    return rows.mapInArrow(releasing(run, forget_words), SCHEMA)


def kept_rows(docs: DataFrame, vocabulary: str, bands: Mapping[str | None, Band] = BANDS, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; nothing is shuffled."""
    text, lang = docs.columns.index(text_column), docs.columns.index(lang_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_words(vocabulary)
        for batch in batches:
            data, offsets = text_views(batch.column(text))
            languages = batch.column(lang).to_pylist()
            for i, j in runs_of(offsets, SLICE):
                _, _, kept = verdicts(words, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], languages[i:j], bands)
                yield batch.slice(i, j - i).filter(pa.array(kept))

    return docs.mapInArrow(releasing(run, forget_words), docs.schema)
