"""Word and hash helpers that the text operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space separates words; every other character belongs to one.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Words remembered by a worker; further ones are hashed each time.
WORD_MEMORY = 300_000


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of ``text`` in UTF-8; none for null. Bytes know ASCII white space and ASCII
    letters only, which is what a word is cut at and what is lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(columns: list[str], stem: str) -> str:
    """A name that starts with ``stem`` and differs from those of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``, equals ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


class _WordHashes(dict):
    def __missing__(self, word: bytes | str) -> int:
        h = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        if len(self) < WORD_MEMORY:
            self[word] = h
        return h


_hashes = _WordHashes()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def word_hashes(ws: list[bytes] | list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` words, in text order; of the whole sequence if it is shorter."""
    n = min(n, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i] * _ODD[i % 8] + np.uint64(i + 1))
    return out


#: Words of at least so many bytes are hashed one by one, others in runs of so many bytes of text.
LONG, RUN = 64, 1 << 15
_ROOT = 0xD1342543DE82EF95


def _powers(root: int) -> np.ndarray:
    out = np.full(RUN + LONG, root, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Bytes:
    """Tables of the byte-wise word hash, made when first needed."""

    def __init__(self):
        self.up, self.down = _powers(_ROOT), _powers(pow(_ROOT, -1, 1 << 64))
        self.letter = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)
        self.letter[65:91] = self.letter[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.letter[self.space] = 0


_bytes: _Bytes | None = None


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all ``texts``, lower-cased (A-Z), and where each text's begin: text ``i``
    has the words ``offsets[i]`` to ``offsets[i + 1]``; a null text has none.

    A word's hash is a polynomial of its bytes' numbers, taken from running sums over the whole buffer, so no
    word becomes an object; long words are hashed one by one."""
    global _bytes
    _bytes = t = _bytes or _Bytes()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = texts.type in (pa.large_string(), pa.large_binary())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    at -= at[0]
    # a place is in a word if its byte is; words end at white space and at the end of their text
    inside = np.concatenate((~t.space.take(raw), [False]))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = at[:-1][at[:-1] < len(raw)]
    begins[cut] = inside[cut]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    end = np.flatnonzero(ends) + 1
    h = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + RUN))
        base = start[i]
        run = raw[base : min(end[j - 1], start[j - 1] + LONG)]
        sums = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(t.letter.take(run) * t.up[: len(run)], out=sums[1:])
        to = np.minimum(end[i:j], start[i:j] + LONG) - base
        h[i:j] = (sums.take(to) - sums.take(start[i:j] - base)) * t.down.take(start[i:j] - base)
        i = j
    for k in np.flatnonzero(end - start >= LONG):
        h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]].tobytes().lower())
    return mix(h), np.searchsorted(start, at)
