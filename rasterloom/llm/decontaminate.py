"""Benchmark decontamination: word n-grams of the test items seed candidate windows in the training
documents, and Smith-Waterman alignment scores each window, so edited and paraphrased copies are found.

The items are a stated query set. They are taken in blocks of bounded size, each block is sent to all tasks
and all documents are read against it. Every n-gram of an item is a seed, however many documents hold it:
an edited copy may have kept only popular ones. Windows that hold too few of the item's words to reach LEAST
are not aligned; for all others the alignment decides. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from .text import ngram_hashes, word_hashes

#: Words of a seed; words of items that one block may hold.
SEED, BLOCK_WORDS = 3, 500_000
#: Alignment scores, and the share of a perfect score from which a document is contaminated.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
LEAST = 0.5
#: Filter bits: a seed's low bits are looked up here before the exact search.
BITS = 22

_words = re.compile(r"[^\W_]+").findall


def plain_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; case and punctuation don't hide a copy."""
    return _words(text.lower()) if text else []


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman score of two word sequences, and where the best alignment starts and ends in the
    window. Row by row; gaps along a row are a running maximum."""
    n = len(window)
    ramp = -GAP * np.arange(n + 1)
    row, from_ = np.zeros(n + 1), np.arange(n + 1)
    best, start, end = 0.0, 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(window == word, MATCH, MISMATCH)
        up = row[1:] + GAP
        step = np.concatenate(([0.0], np.maximum(np.maximum(diagonal, up), 0)))
        origin = np.concatenate(([0], np.where(step[1:] == 0, np.arange(1, n + 1), np.where(diagonal >= up, from_[:-1], from_[1:]))))
        lifted = step + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, from_ = top - ramp, origin[source]
        at = int(row.argmax())
        if row[at] > best:
            best, start, end = float(row[at]), int(from_[at]), at
    return best, start, end


@dataclass
class Block:
    """Items and the sorted distinct n-grams of all of them; owner and place list each occurrence."""

    ids: list
    words: list[np.ndarray]

    def __post_init__(self):
        grams = [ngram_hashes(w, SEED) for w in self.words]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        self.grams, which = np.unique(flat, return_inverse=True)
        owner, place = np.repeat(np.arange(len(grams)), [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams]) if grams else flat
        order = np.argsort(which, kind="stable")
        self.owner, self.place = owner[order], place[order].astype(np.int64)
        self.first = np.searchsorted(which[order], np.arange(len(self.grams) + 1))
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self.grams & np.uint64((1 << BITS) - 1)] = True
        self.short = {len(w) for w in self.words if len(w) < SEED}

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the document, n-gram number) of every n-gram that the block has."""
        at, no = [], []
        for size in {SEED, *self.short}:
            if len(h) < size:
                continue
            g = ngram_hashes(h, size)
            p = np.flatnonzero(self.bits[g & np.uint64((1 << BITS) - 1)])
            if len(p):
                k = np.minimum(np.searchsorted(self.grams, g[p]), len(self.grams) - 1)
                hit = self.grams[k] == g[p]
                at.append(p[hit])
                no.append(k[hit])
        return (np.concatenate(at), np.concatenate(no)) if at else (np.empty(0, np.int64),) * 2

    def hits(self, text: str | None) -> list[tuple]:
        """(item, score, start, end) of every item whose best alignment reaches LEAST; positions in words."""
        h = word_hashes(plain_words(text))
        at, no = self.found(h)
        if not len(at):
            return []
        n = self.first[no + 1] - self.first[no]
        rows = np.repeat(self.first[no], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner, begin = self.owner[rows], np.repeat(at, n) - self.place[rows]
        out = []
        order = np.lexsort((begin, owner))
        owner, begin = owner[order], begin[order]
        for run in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
            if not len(run):
                continue
            item = self.words[owner[run[0]]]
            # a copy that reaches LEAST has at most 2 * (1 - LEAST) words added for each of the item's
            size = len(item)
            best = (0.0, 0, 0)
            # starts that lie within an item's length form one window
            for part in np.split(begin[run], np.flatnonzero(np.diff(begin[run]) > size) + 1):
                lo, hi = max(0, int(part[0]) - size), min(len(h), int(part[-1]) + 2 * size)
                # no alignment scores more than the item's words that the window has
                if MATCH * np.isin(item, h[lo:hi]).sum() < LEAST * MATCH * size:
                    continue
                score, s, e = align(item, h[lo:hi])
                best = max(best, (score / (MATCH * size), lo + s, lo + e))
            if best[0] >= LEAST:
                out.append((self.ids[owner[run[0]]], *best))
        return out


def blocks(items: DataFrame) -> Iterator[Block]:
    """The items (item_id, text, ...) in blocks of at most BLOCK_WORDS words, or one item if it is longer.
    Items without words can't be found and are left out."""
    ids, seqs, size = [], [], 0
    for r in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        w = word_hashes(plain_words(r.text))
        if not len(w):
            continue
        if ids and size + len(w) > BLOCK_WORDS:
            yield Block(ids, seqs)
            ids, seqs, size = [], [], 0
        ids.append(r.item_id)
        seqs.append(w)
        size += len(w)
    if ids:
        yield Block(ids, seqs)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) for every document and item that align well; score is
    the share of a perfect alignment. Null and empty texts give none. Repeated rows are reported each."""
    found = None
    for block in blocks(items):

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"]) for hit in block.hits(t.as_py())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        part = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), scan, "doc_id long, item_id long, score double, first_word long, last_word long")
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, last_word long")
    return found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates."""
    for block in blocks(items):

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not block.hits(t.as_py()) for t in batch["text"]], pa.bool_()))

        docs = arrow_map(docs, scan, docs.schema)
    return docs
