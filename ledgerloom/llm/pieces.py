"""Encoding by space-delimited pieces, with a bounded cache of pieces already encoded.

The byte-level pattern of the public vocabulary lets a token hold a space only before other
characters of its piece. Where a single space stands between two characters that are not white
space, or after line ends, the text before it and the text from it on are therefore encoded
independently, and most pieces recur. Texts in which this doesn't hold (see ODD) go to the
tokenizers library whole."""

from __future__ import annotations

import base64
import re

import numpy as np

#: Entries after which the cache starts anew: a bound on memory, which changes no result.
CACHE = 400_000
#: White space beyond ASCII's usual kinds, runs with a space before other white space or at the end, and special strings.
ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]|[ ](?:[ \t\n\r]|$)|^ |<\|endoftext\|>")
#: The split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_made: dict[tuple, SpacePieces] = {}


class SpacePieces(dict):
    """Maps a piece, taken with a space before it, to its ids as little-endian bytes, two or four for each.

    With rank_path, pieces are encoded by the rank form of the same vocabulary, which gives the
    same ids several times faster; a test holds the two against each other."""

    def __init__(self, json_path: str, rank_path: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.ranked = None
        if rank_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
            self.ranked = tiktoken.Encoding("piece", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def cached(cls, json_path: str, rank_path: str | None) -> SpacePieces:
        """One for each worker process, kept between tasks."""
        if (key := (json_path, rank_path)) not in _made:
            _made[key] = cls(json_path, rank_path)
        return _made[key]

    def _ids(self, text: str) -> bytes:
        ids = self.ranked.encode_ordinary(text) if self.ranked else self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids = self._ids(f" {piece}")
        return ids

    def encode(self, text: str) -> bytes:
        if ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        first, *rest = text.split(" ")
        return self._ids(first) + b"".join(map(self.__getitem__, rest))
