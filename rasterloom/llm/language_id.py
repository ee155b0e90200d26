"""Language ID by compression: the text is encoded with one raw-content zstandard dictionary per language,
and the smallest result names the language; narrow margins are rejected."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from .sampling import bounded_sample, fetch_texts
from .text import held_out

#: Bound of the training sample: documents of each language, and bytes of their letters together. Documents
#: are taken whole.
DOCS, BYTES = 192, 400_000
#: Bytes of text that are compressed at a time; sizes of the pieces are added.
PIECE = 16_384
#: Weight of one byte of margin in the score, and the score below which a prediction is rejected.
STEEP, LEAST = 0.35, 0.5
UNKNOWN = "und"


def letters(text):
    """Lower-cased runs of letters, single spaces between; the classifier sees nothing else."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " "))


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content for each non-null language of ``docs`` (doc_id, text, lang); languages of the
    caller's labels are assumed to be few, and each holds at most DOCS documents and BYTES bytes."""
    usable = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang", "text")
    chosen = bounded_sample(usable.select("doc_id", "lang"), "lang", DOCS)
    out: dict[str, list[str]] = {}
    for lang, _, text in fetch_texts(usable, chosen, BYTES, letters(F.col("text"))):
        if text:
            out.setdefault(lang, []).append(text)
    return {lang: "\n".join(texts).encode() for lang, texts in sorted(out.items())}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard

        self.langs = list(content)
        dicts = [zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for c in content.values()]
        self.by_lang = [zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in dicts]

    def predict(self, text: str) -> tuple[str, float]:
        """(language, score) of a text of letters; the score falls to 1 / languages as margins vanish."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        data = text.encode("utf-8", "surrogatepass")
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.by_lang]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        return self.langs[best], 1 / sum(math.exp(max(-STEEP * (s - sizes[best]), -700)) for s in sizes)


def identify(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """row (all columns of docs, whatever their names), lang_pred, score (0 to 1) and rejected for every row of
    docs (text, ...). ``und`` with score 0 is given for null texts, texts without a letter and where nothing
    was learned. Of languages that compress a text alike, the first by name is taken, with a score of at most
    a half, which is not rejected at a half exactly."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(content)
        for batch in batches:
            got = [classifier.predict(t) for t in batch["letters"].to_pylist()]
            cols = [batch["row"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == UNKNOWN or g[1] < LEAST for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "lang_pred", "score", "rejected"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), letters(F.col("text")).alias("letters"))
    return arrow_map(rows, predict, rows.select("row").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))


def kept(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language isn't rejected."""
    return identify(docs, content).where("not rejected").select("row.*")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs (doc_id, text, lang, ...).

    Learns from documents that aren't held out (crc32 of the id modulo 4 is not 2) and have a language.
    Very long texts are compressed whole, PIECE bytes at a time. Repeated rows are scored alike; other columns
    are ignored, whatever their names; an empty table gives no rows."""
    out = held_out(F.col("doc_id"), 4, 2)
    content = fit(docs.where(~out))
    return identify(docs.select("doc_id", "text"), content).select("row.doc_id", "lang_pred", "score", "rejected").select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
