"""Exact, memoised encoding with the tokenizers library.

The byte-level vocabularies split a text by a pattern before any merge is looked up, and always where white
space follows other characters. So a text is cut there, every distinct piece is encoded once by the library,
and the ids are joined. Texts with longer runs of white space go to the library whole.
"""

from __future__ import annotations

import os
import sys
import types
from array import array

import numpy as np

#: Pieces that a worker remembers in each of two generations, and the longest piece worth remembering.
PIECES, LONGEST = 400_000, 40


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write every byte as one printable character: printable ones as themselves,
    the others as the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library, self.known, self.old, self.letters = Tokenizer.from_file(path), {}, {}, _byte_letters()
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.merge = self.library.model.tokenize
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(f"<u{array(self.code).itemsize}")

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of one match of the vocabulary's pattern, by the library's merges."""
        return array(self.code, [t.id for t in self.merge(part.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _remembered(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                got = self._fresh(piece)
            if len(piece) <= LONGEST:
                if len(self.known) >= PIECES:
                    self.known, self.old = {}, self.known
                self.known[piece] = got
        return got

    def _fresh(self, piece: str) -> bytes:
        """Words of ASCII letters are one part, perhaps with one mark after it; others are cut."""
        if piece.isascii():
            if piece.isalpha():
                return self._part(" " + piece)
            if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
                return self._remembered(piece[:-1]) + self._part(piece[-1])
        return b"".join(map(self._part, self.cut(piece if piece[0] == "\n" else " " + piece)))

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text (null: none) as little-endian integers of ``dtype``."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._whole(text)
        # a piece that starts with a line feed stands as it is, any other follows the space it was cut at
        pieces = text.replace("\n", " \n").split(" ")
        first = pieces[0]
        if not first or first[-1].isspace() or first[0].isspace():
            return self._whole(text)
        got = list(map(self.known.get, pieces))
        got[0] = self._whole(first)
        if None in got:
            fresh = {p for p, g in zip(pieces, got) if g is None}
            # the pieces are judged by the wider of the two notions of white space
            if "" in fresh or any(p[-1].isspace() or (p[0] != "\n" and p[0].isspace()) or p[1:2].isspace() for p in fresh):
                return self._whole(text)
            got = [self._remembered(p) if g is None else g for p, g in zip(pieces, got)]
        return b"".join(got)


#: The usual pattern of byte-level vocabularies, and what cuts every text at the same places without going back.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STRAIGHT = r" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Ranked:
    """Ids by a file of ranks; it remembers no pieces, so its memory doesn't grow."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        self.size = max(ranks.values()) + 1
        pattern = _STRAIGHT if public_tokenizers.PATTERN == _USUAL else public_tokenizers.PATTERN
        # tiktoken needs a special token to give arrays; none is allowed in a text, so it is read as any other
        self.code = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|end|>": self.size}).encode_to_numpy
        # room for the end and for no id
        self.dtype = np.dtype("<u2" if self.size + 2 <= 1 << 16 else "<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole text."""
        try:
            ids = self.code(text, disallowed_special=())
        except UnicodeEncodeError:
            ids = self.code(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), disallowed_special=())
        return ids.astype(self.dtype)


def _kept(path: str, make):
    """One encoder per worker process and file, kept between tasks."""
    kept = sys.modules.setdefault("_rasterloom_encoders", types.ModuleType("_rasterloom_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = make(path)
    return kept.__dict__[path]


def encoder(path: str) -> Encoder:
    return _kept(path, Encoder)


def ranked(path: str) -> Ranked:
    return _kept(path, Ranked)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
