"""Operator 3: byte-pair encoding as a streaming transducer with bounded lookahead, and decoding.

A merge list fixes how far to the left text that is still to come can change tokens. Where a
merge crosses a place p for the first time, it joins a token u that ends at p with a token v that
starts there, and what differs at p stems from an earlier merge whose text starts at p and agrees
with v. So

    reach(u, v) = |u| + max(0, reach of earlier merges whose text starts with v or v with it)

and the largest reach, `lookahead`, is enough: a token that ends at least so many symbols before
the end of what has been read is stable, is emitted, and is forgotten.

A text is a stream of blocks. White space, and places between words, part what can be encoded
apart; the words of a block are emitted with it, and a word that goes on beyond the block stays in
a transducer that holds lookahead + BLOCK symbols at most, however long it is. Words that end
before anything could be stable are merged in one go and kept in a bounded memo.

Decoding is a state machine as well: ids give bytes, complete UTF-8 sequences give text, and at
most three bytes wait for the next id. Ids reach digests and decoder block by block.

Null texts are empty and give no ids; special strings in a text are special tokens, as the
tokenizers library has them by default. Each row is encoded by itself, so rows that repeat a
doc_id or a text have equal results.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import id_and_text, map_arrow, table, vocabulary

BLOCK = 1024
#: Code points of text that are read at once, and of a piece without white space from which on it is read in parts.
READ, HOLD = 65_536, 4096
#: Entries after which a cache starts anew: a bound on memory, which changes no result.
PIECES, WORDS = 600_000, 400_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """A printable symbol for each byte: itself if printable Latin-1, else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length=len) -> int:
    """Symbols after which no further text can change a token (see the module's text)."""
    starts: dict[str, int] = {}
    whole: dict[str, int] = {}
    most = 1
    for u, v in merges:
        earlier = max([starts.get(v, 0), *(whole.get(v[:k], 0) for k in range(1, len(v) + 1))])
        reach = length(u) + earlier
        text = u + v
        whole[text] = max(whole.get(text, 0), reach)
        for k in range(1, len(text) + 1):
            if starts.get(text[:k], 0) < reach:
                starts[text[:k]] = reach
        most = max(most, reach)
    return most


class MergeModel:
    """Vocabulary, merges and normalisation of a tokenizers JSON file of the kind with word ends."""

    def __init__(self, path: str, lookahead: int | None = None):
        data = json.loads(open(path, encoding="utf-8").read())
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lookahead = lookahead or sufficient_lookahead(merges, lambda x: len(x.removesuffix(self.suffix)) if self.suffix else len(x))
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for text, k in [*self.vocab.items(), *self.special.items()]:
            self.strings[k] = text
        self.symbols = byte_symbols()

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes that each token stands for; special tokens stand for none."""
        own = {s: b for b, s in enumerate(self.symbols)}
        return [b"" if t in self.special else bytes(own[c] for c in t.removesuffix(self.suffix)) for t in self.strings]

    @functools.cached_property
    def library_bytes(self) -> list[bytes]:
        """Each token's string behind a space, as UTF-8."""
        return [f" {t}".encode() for t in self.strings]

    def merge(self, parts: list[str]) -> list[str]:
        """All merges, lowest rank first, leftmost first."""
        ranks = self.ranks
        if len(parts) > 48:
            return self._merge_long(parts)
        get, none = ranks.get, 1 << 30
        found = [get(pair, none) for pair in zip(parts, parts[1:])]
        while found and (least := min(found)) < none:
            k = found.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del found[k]
            if k < len(found):
                found[k] = get((parts[k], parts[k + 1]), none)
            if k:
                found[k - 1] = get((parts[k - 1], parts[k]), none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap over a linked list, in n log n steps."""
        n, ranks = len(parts), self.ranks
        parts, after, before = list(parts), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k) for k, pair in enumerate(zip(parts, parts[1:])) if (r := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if not parts[k] or (j := after[k]) < 0 or ranks.get((parts[k], parts[j])) != rank:
                continue
            parts[k], parts[j] = parts[k] + parts[j], ""
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] >= 0 and (r := ranks.get((parts[a], parts[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in parts if x]


class Transducer:
    """Encodes one word that arrives symbol by symbol; `held` is all the state there is."""

    def __init__(self, model: MergeModel, block: int = BLOCK):
        self.model, self.block, self.held = model, block, []

    def feed(self, symbols: Iterable[str]) -> Iterator[int]:
        limit = self.model.lookahead + self.block
        for symbol in symbols:
            self.held.append(symbol)
            if len(self.held) > limit:
                yield from self._settle()

    def _settle(self) -> Iterator[int]:
        """Emit what is stable. The last symbol may yet turn out to end the word, so it never is."""
        stable, end = len(self.held) - 1 - self.model.lookahead, 0
        for token in self.model.merge(list(self.held)):
            if end + len(token) > stable:
                break
            end += len(token)
            if (k := self.model.vocab.get(token)) is not None:
                yield k
        del self.held[:end]

    def finish(self) -> Iterator[int]:
        if self.held:
            self.held[-1] += self.model.suffix
            yield from (k for t in self.model.merge(self.held) if (k := self.model.vocab.get(t)) is not None)
            self.held = []


def blocks(text: str, size: int = READ) -> Iterator[str]:
    return (text[k : k + size] for k in range(0, len(text), size))


@functools.cache
def composing() -> frozenset[str]:
    """Characters that may join the one before them when text is composed."""
    pairs = (unicodedata.decomposition(chr(k)).split() for k in range(0xC0, sys.maxunicode + 1))
    return frozenset([*(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"), *map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))])


class Encoder(dict):
    """Encodes streams of text; maps a piece between white space to its ids as 32-bit bytes.

    The map is a memo of what the transducer gives for whole pieces and changes no result."""

    #: How the vocabulary splits pieces into words (fixed value).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Separators that only some engines count as white space.
    ODD = re.compile(r"[\x1c-\x1f]")
    SPACE = re.compile(r"[ \t-\r]")

    def __init__(self, model: MergeModel):
        import regex

        self.model, self.words, self.table = model, {}, dict(enumerate(model.symbols))
        self.words_in, self.spaces = regex.compile(self.SPLIT), regex.compile(r"\s+")
        self.split = self.words_in.findall
        self.runs = {"letters": regex.compile(r"[\p{L}]*"), "signs": regex.compile(r"[^\s\p{L}\p{N}]*")}
        self.at_special = re.compile("(" + "|".join(map(re.escape, model.special)) + ")")

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's own lower case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def symbols(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.table)

    def word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            model, symbols = self.model, self.symbols(word)
            if len(symbols) <= model.lookahead:  # nothing is stable before the word's end
                parts = [*symbols]
                parts[-1] += model.suffix
                found = [k for t in model.merge(parts) if (k := model.vocab.get(t)) is not None]
            else:
                run = Transducer(model)
                found = [*run.feed(symbols), *run.finish()]
            ids = self.words[word] = array("I", found).tobytes()
        return ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        self[piece] = ids = b"".join(map(self.word, self.split(self.normal(piece))))
        return ids

    def stream(self, text: Iterable[str], hold: int = HOLD) -> Iterator[array]:
        """Ids of a text that arrives in blocks, each array as soon as it's stable.

        Between blocks there is only the text behind the last white space. Once that is longer than
        `hold`, it is read up to a place where words can be parted, and a word that goes on beyond
        that place is a transducer that stays open."""
        tail, going = "", None
        for block in text:
            tail += block
            if at := self._behind_space(tail):
                ids, going = self._emit(tail[:at], True, going)
                tail = tail[at:]
                yield ids
            if len(tail) > hold and (at := self._place(tail)):
                ids, going = self._emit(tail[:at], False, going)
                tail = tail[at:]
                yield ids
        yield self._emit(tail, True, going)[0]

    def ids(self, text: str) -> list[int]:
        return [k for ids in self.stream(blocks(text)) for k in ids]

    @staticmethod
    def _behind_space(text: str) -> int:
        """The place behind the last white space, or 0."""
        return 1 + max(map(text.rfind, " \n\t\r\x0b\x0c"))

    def _place(self, tail: str) -> int:
        """A place in text without white space at which its two sides may be normalised and parted apart.

        Neither a special string nor a contraction lies across it, and no character joins the one before."""
        for at in range(len(tail) - 64, 2, -1):
            near = tail[at - 2 : at]
            if not unicodedata.combining(tail[at]) and tail[at] not in composing() and ("'" not in near or near == "''"):
                for m in self.at_special.finditer(tail) if "<|" in tail else ():
                    if m.start() < at < m.end():
                        at = m.start() or m.end()
                return at
        return 0

    def _emit(self, text: str, closed: bool, going: tuple | None) -> tuple[array, tuple | None]:
        """Ids of text, and the word that stays open at its end (its kind and transducer).

        closed: no word of text goes on behind it; going: the word that text begins within."""
        out = array("I")
        parts = self.at_special.split(text) if "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.model.special[part])
                continue
            ends = closed or k < len(parts) - 1
            if going:
                cut = m.start() if (m := self.SPACE.search(part)) else len(part)
                head, part = self.normal(part[:cut]), part[cut:]
                more = self.runs[going[0]].match(head)[0]
                out.extend(going[1].feed(self.symbols(more)))
                if len(more) < len(head) or part or ends:
                    out.extend(going[1].finish())
                    going = None
                    rest, going = self._words(head[len(more) :], ends or bool(part))
                    out.frombytes(rest)
            if ends and not self.ODD.search(part):
                out.frombytes(b"".join(map(self.__getitem__, part.split())))
            else:
                rest, new = self._words(self.normal(self.spaces.sub(" ", part)), ends)
                out.frombytes(rest)
                going = new or going
        return out, going

    def _words(self, text: str, ends: bool) -> tuple[bytes, tuple | None]:
        """Ids of normalised text's words; unless it ends, a last one that may go on is left open."""
        words = self.split(text)
        if ends or not words or not text.endswith(words[-1]):
            return b"".join(map(self.word, words)), None
        last = words.pop()
        kind = "letters" if last[0].isalpha() and self.runs["letters"].fullmatch(last) else "signs" if self.runs["signs"].fullmatch(last) else None
        if kind is None:  # digits and contractions are whole
            return b"".join(map(self.word, [*words, last])), None
        run = Transducer(self.model)
        begun = array("I", run.feed(self.symbols(last)))
        return b"".join(map(self.word, words)) + begun.tobytes(), (kind, run)


class Decoder:
    """Ids to text, a few at a time.

    library=True gives what the tokenizers library's decode gives for a file without a decoder:
    token strings with a space between them. Otherwise bytes become text again: word ends are
    spaces, a special token is its string, broken sequences are U+FFFD."""

    def __init__(self, model: MergeModel, library: bool = False):
        self.model, self.library, self.begun = model, library, False
        self.bytes = model.library_bytes if library else model.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.library:
            raw = b"".join(map(self.bytes.__getitem__, ids))
            raw, self.begun = raw if self.begun else raw[1:], self.begun or bool(raw)
            return self.state.decode(raw)
        out, special, suffix = [], self.model.special, self.model.suffix
        for k in ids:
            token = self.model.strings[k]
            if token in special:
                out.append(self.state.decode(b"", True) + token)
                self.state.reset()
                continue
            out.append(self.state.decode(self.bytes[k]))
            if suffix and token.endswith(suffix):
                out.append(self.state.decode(b"", True) + " ")
                self.state.reset()
        return "".join(out)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@functools.cache
def lookahead_of(path: str) -> int:
    return MergeModel(path).lookahead


_encoders: dict[str, Encoder] = {}


def encoder(path: str, lookahead: int | None = None) -> Encoder:
    """One for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(MergeModel(path, lookahead))
    return _encoders[path]


def encode_documents(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and n_tokens of every whole text."""
    path = vocab or vocabulary("word_bpe_49k.json")
    ahead = lookahead_of(path)

    def run(batches):
        enc = encoder(path, ahead)
        for batch in batches:
            ids = [enc.ids(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return map_arrow(id_and_text(docs), run, "doc_id long, ids array<int>, n_tokens long")


def decode_documents(encoded: DataFrame, vocab: str | None = None, library: bool = False) -> DataFrame:
    """doc_id and text of rows with ids; null ids give empty text."""
    path = vocab or vocabulary("word_bpe_49k.json")
    ahead = lookahead_of(path)

    def run(batches):
        model = encoder(path, ahead).model
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                state, ids = Decoder(model, library), ids or []
                texts.append("".join(state.feed(ids[k : k + READ]) for k in range(0, len(ids), READ)) + state.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocab: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids, and return both digests, and the ids if wanted.

    Text goes through encoder, decoder and digests block by block: beside the text itself and the
    ids that are wanted, a block and what the transducer holds is all there is in memory."""
    path = vocab or vocabulary("word_bpe_49k.json")
    ahead = lookahead_of(path)

    def run(batches):
        enc = encoder(path, ahead)
        decimal = [f" {k}" for k in range(len(enc.model.strings))]

        def one(text: str) -> tuple[int, str, str, bytes]:
            coded, back, state, n, kept = hashlib.sha256(), hashlib.sha256(), Decoder(enc.model, library=True), 0, b""
            for ids in enc.stream(blocks(text)):
                said = "".join(map(decimal.__getitem__, ids)).encode()
                coded.update(said if n else said[1:])
                back.update(state.feed(ids).encode())
                n += len(ids)
                kept += ids.tobytes() if with_ids else b""
            back.update(state.finish().encode())
            return n, coded.hexdigest(), back.hexdigest(), kept

        for batch in batches:
            n, coded, back, kept = list(zip(*(one(text.as_py()) for text in batch.column(1)), strict=True)) or [()] * 4
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *n]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(kept), "<u4").astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(id_and_text(docs), run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
