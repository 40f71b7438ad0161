"""Operator 6: quality rules on words, and on how well public vocabularies fit a text.

A text that a vocabulary was not made for falls into many short tokens. Two public vocabularies
measure each whole text, word by word:

    piece_chars   code points for each token of the byte-fallback vocabulary
    multi_chars   code points for each token of the multilingual byte-level vocabulary
    byte_share    share of tokens that are single bytes for want of a piece
    entropy       bits for each token of the text's own token distribution

BANDS bounds each by the script of most of the text's letters. Entropy is bounded only from
MIN_TOKENS tokens on, as a short text cannot reach a high one.

A null or empty text has no words, fails the base rules and is not kept. Each row is judged by
itself, so rows that repeat a doc_id or a text have equal results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import id_and_text, map_arrow, table, vocabulary
from ledgerloom.llm.pieces import PATTERN

SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, REPEAT_PERCENT, MIN_TOKENS = 10, 5, 20, 100
#: Entries after which the cache starts anew: a bound on memory, which changes no result.
CACHE = 500_000
#: Above every token id; adds up the tokens of the second vocabulary.
MARK = 40_000

#: How the bands were set. Latin: on the sf0.1 tables, labelled good texts of over 300 code points have piece_chars 1.75 to
#: 2.43, multi_chars 1.86 to 2.43, no byte tokens and entropy 5.7 to 7.1; the band leaves room on every side, above all
#: upwards, as real prose has longer words. Other scripts don't occur there: their lower bounds lie near what byte fallback
#: alone would give (a code point in two to four tokens), so that only text which a vocabulary reads byte by byte is rejected.
#: Script: lowest and highest piece_chars, lowest multi_chars, highest byte_share, lowest entropy.
BANDS = {
    "latin": (1.30, 12.0, 1.62, 0.10, 3.5),
    "greek": (0.8, 8.0, 0.6, 0.30, 4.0),
    "cyrillic": (1.0, 10.0, 0.8, 0.20, 4.0),
    "hebrew": (0.6, 8.0, 0.5, 0.60, 4.0),
    "arabic": (0.6, 8.0, 0.5, 0.60, 4.0),
    "devanagari": (0.4, 8.0, 0.3, 0.90, 3.5),
    "thai": (0.4, 8.0, 0.3, 0.90, 3.5),
    "kana": (0.5, 6.0, 0.4, 0.70, 4.0),
    "hangul": (0.3, 6.0, 0.3, 0.95, 3.5),
    "han": (0.4, 6.0, 0.3, 0.80, 4.0),
    "other": (0.25, 12.0, 0.2, 1.00, 3.0),
    "none": (0.5, 12.0, 0.4, 0.50, 2.5),
}
#: First code points of ranges, and the script that each begins (fixed values of the Unicode blocks).
RANGES = [
    (0x0, "none"), (0x41, "latin"), (0x5B, "none"), (0x61, "latin"), (0x7B, "none"), (0xC0, "latin"), (0x250, "latin"), (0x2B0, "none"),
    (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x750, "arabic"),
    (0x780, "other"), (0x8A0, "arabic"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "other"), (0x1F000, "none"),
    (0x20000, "han"), (0x32000, "none"),
]
SCRIPTS = list(BANDS)
STARTS = np.array([a for a, _ in RANGES], np.uint32)
KINDS = np.array([SCRIPTS.index(s) for _, s in RANGES])

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to str.split() that does not part words here.
JOINS = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, n_tokens long, piece_chars double, multi_chars double, byte_share double, entropy double"
)
TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int64()] + [pa.float64()] * 4


def words_of(text: str) -> list[str]:
    return WORDS.findall(text) if JOINS.search(text) else text.split()


def repeated_words(words: list[str]) -> int:
    """Words in windows of five that occur twice or more in the text, the first occurrence included.

    Windows meet by a 64-bit hash and count only if their words are equal."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words])
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    keys = mixed[:n].copy()
    for k in range(1, WINDOW):
        keys = keys * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    equal = np.ones(len(same), bool)
    for k in range(WINDOW):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():  # two windows share a hash
        places: dict[tuple, list[int]] = {}
        for k in range(n):
            places.setdefault(tuple(ids[k : k + WINDOW].tolist()), []).append(k)
        starts = [k for found in places.values() if len(found) > 1 for k in found]
    else:
        starts = np.unique(np.concatenate([a, b]))
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[np.asarray(starts) + k] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """Script of most letters; none without letters."""
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else "none"
    kinds = np.bincount(KINDS[np.searchsorted(STARTS, np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), "right") - 1], minlength=len(SCRIPTS))
    kinds[SCRIPTS.index("none")] = 0
    return SCRIPTS[int(kinds.argmax())] if kinds.any() else "none"


class Fertility(dict):
    """Maps a word to its ids in the first vocabulary and marks for its tokens in the second, as 16-bit bytes."""

    def __init__(self, piece_path: str, multi_path: str):
        import base64

        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(multi_path, "rb"))}
        self.multi = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.piece.is_byte(k) for k in range(self.piece.get_piece_size())])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        n, marks, top = len(self.multi.encode_ordinary(f" {word}")), [], 65_535 - MARK
        while n > 0:
            marks.append(MARK + min(n, top))
            n -= top
        self[word] = found = np.array(self.piece.encode(word) + marks, "<u2").tobytes()
        return found

    def measure(self, words: list[str], chars: int) -> tuple[int, float, float, float, float]:
        """n_tokens, piece_chars, multi_chars, byte_share, entropy."""
        both = np.frombuffer(b"".join(map(self.__getitem__, words)), "<u2")
        marks = both >= MARK
        ids, n_multi = both[~marks], int((both[marks].astype(np.int64) - MARK).sum())
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0, 0.0
        counts = np.unique(ids, return_counts=True)[1]
        return n, chars / n, chars / max(n_multi, 1), float(self.is_byte[ids].sum() / n), float(np.log2(n) - (counts * np.log2(counts)).sum() / n)


def fits(script: str, n: int, piece_chars: float, multi_chars: float, byte_share: float, entropy: float) -> bool:
    low, high, multi_low, bytes_high, entropy_low = BANDS[script]
    return low <= piece_chars <= high and multi_chars >= multi_low and byte_share <= bytes_high and (n < MIN_TOKENS or entropy >= entropy_low)


_made: dict[tuple, Fertility] = {}


def judge(text: str, fertility: Fertility) -> tuple:
    words = words_of(text)
    n, chars, repeats = len(words), sum(map(len, words)), repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
    script, measures = script_of(text), fertility.measure(words, chars)
    return (n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed, not failed and fits(script, *measures), script, *measures)


def judge_documents(docs: DataFrame, piece_vocab: str | None = None, multi_vocab: str | None = None) -> DataFrame:
    """One row for each document: base counts, verdicts and the measures behind them."""
    paths = piece_vocab or vocabulary("piece_bpe_32k.model"), multi_vocab or vocabulary("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        if paths not in _made:
            _made[paths] = Fertility(*paths)
        for batch in batches:
            rows = [judge(t.as_py(), _made[paths]) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, TYPES, strict=True))], names=NAMES)

    return map_arrow(id_and_text(docs), run, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))
