"""Benchmark summaries, names and captions."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship


def run_percentiles(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Upper median and the value at floor((n - 1) * 95 / 100) of the sorted runs."""
    s = F.sort_array(F.collect_list(value))  # a file has a handful of runs
    kept = runs.groupBy(key).agg(s.alias("s")).withColumn("n", F.size("s"))
    return kept.select(key, F.col("n").cast("long").alias("runs"), F.element_at("s", F.floor(F.col("n") / 2).cast("int") + 1).alias("median"), F.element_at("s", F.floor((F.col("n") - 1) * 95 / 100).cast("int") + 1).alias("p95"))


def csv_cell(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def fixed(value: Column, places: int) -> Column:
    """A double with so many decimals as C prints it: rounded by its exact binary value, where the JVM's formats
    round its shortest decimal form. Null stays null."""

    def text(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"{x:.{places}f}" for x in v.to_pylist()], pa.string())

    return F.arrow_udf(text, "string")(value.cast("double"))


def ordered_mean(value: Column, *order: Column) -> Column:
    """Aggregate: the mean of a group's doubles, added one after the other in ``order``; null where there are
    none. A plain average adds partial sums as they arrive, so its last digits vary from run to run."""
    rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v")))))
    return F.aggregate(rows, F.lit(0.0), lambda total, r: total + r["v"], lambda total: F.try_divide(total, F.size(rows)))


def optional_number(value: Column, places: int = 5) -> Column:
    return F.coalesce(fixed(value, places), F.lit(""))


def saved_line(row: dict, destination: str) -> str:
    """What one optimized file gained."""
    if row["optimized_bytes"] >= row["original_bytes"]:
        return f"Already optimized → {destination}"
    return f"Saved {row['saved_percent']:.1f}% ({row['original_bytes']} → {row['optimized_bytes']} bytes) → {destination}"


def metrics_lines(found: dict) -> str:
    text = {k: "" if v is None else f"{v:.5f}" for k, v in found.items()}
    return f"SSIMULACRA2: {text['ssimulacra2']}\nButteraugli: {text['butteraugli']}"


def timed_line(path: str, saved_percent: float, median_ms: float) -> str:
    return f"{path}: {saved_percent:.1f}% saved in {median_ms:.0f} ms"


def optimized_name(path: Column) -> Column:
    """``stem.optimized.ext``; ``jpg`` without an extension."""
    stem = F.regexp_extract(path, r"^(.+?)(\.[^.]*)?$", 1)
    ext = F.regexp_extract(path, r"^.+\.([^.]*)$", 1)
    return F.concat(stem, F.lit(".optimized."), F.when(ext == "", "jpg").otherwise(ext))


def download_name(name: Column, fmt: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(".squeezed."), F.when(fmt == "jpeg", "jpg").otherwise("png"))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The first free of ``name``, ``name-2``, ``name-3``, in order of appearance.

    Only names that are equal but for trailing numbers can meet. Where no such name bears a number itself the
    row number is the suffix; families with one, like two ``x`` beside an ``x-2``, are dealt in sequence."""
    dot = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    root = F.concat(F.regexp_replace(stem, r"(-[0-9]+)+$", ""), F.lit("/"), dot)
    numbered = F.coalesce(F.max(stem.rlike("-[0-9]+$").cast("int")).over(Window.partitionBy("_root")) == 1, F.lit(False))
    ranked = rows.withColumn("_root", root).withColumn("_numbered", numbered)
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    plain = ranked.where("not _numbered").withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), k.cast("string"), dot)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(unique_name=unique_names_in_order(pdf[name].tolist()))

    ship(rows.sparkSession)
    dealt = ranked.where("_numbered").groupBy("_root").applyInPandas(run, plain.schema)
    return plain.unionByName(dealt).drop("_root", "_numbered")


class Names:
    """Hands out the first free of name, name-2, ... ; each name remembers where to go on."""

    def __init__(self):
        self.taken, self.next = set(), {}

    def free(self, name: str) -> str:
        stem, dot, ext = name.rpartition(".")
        stem, tail = (stem, dot + ext) if dot else (name, "")
        pick, k = name, self.next.get(name, 2)
        while pick in self.taken:
            pick, k = f"{stem}-{k}{tail}", k + 1
        self.next[name] = k
        self.taken.add(pick)
        return pick


def unique_names_in_order(names: list[str]) -> list[str]:
    """Sequential form for one archive."""
    return list(map(Names().free, names))


def zip_outputs(rows: DataFrame, path: str) -> int:
    """Write finished outputs (name, output) into one archive on the driver, streaming; 0 writes none."""
    import itertools
    import zipfile

    it = rows.where("output is not null").orderBy("name").toLocalIterator()
    first = next(it, None)
    if first is None:
        return 0
    names, n = Names(), 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for r in itertools.chain([first], it):
            z.writestr(names.free(r["name"]), bytes(r.output))
            n += 1
    return n


#: Captions of statuses and stages.
STATUS = {"queued": "Czeka w kolejce", "error": "Nie udało się skompresować", "cancelled": "Anulowano", "complete": "Gotowe"}
STAGE = {"decoding": "Odczytuję obraz", "analyzing": "Analizuję zawartość", "compressing": "Kompresuję", "finalizing": "Kończę"}


def status_caption(status: Column, stage: Column) -> Column:
    pick = lambda c, m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c)
    return F.when(status == "processing", pick(F.coalesce(stage, F.lit("decoding")), STAGE)).otherwise(pick(status, STATUS))


#: Captions where an earlier result is still there, where nothing was saved, and status icons.
KEPT = {"error": "Nowa próba nie powiodła się — poprzedni wynik jest dostępny", "cancelled": "Przerwano — poprzedni wynik jest dostępny"}
NO_GAIN = "Gotowe · Brak oszczędności w tym przebiegu"
ICONS = {"processing": "spinner", "complete": "status-dot status-dot--success", "error": "status-dot status-dot--error"}


def job_card(status: Column, stage: Column, has_output: Column, saved_percent: Column, recoverable: Column) -> Column:
    """struct(caption, icon, actions) of a job as a user sees it."""
    caption = F.coalesce(*[F.when((status == s) & has_output, text) for s, text in KEPT.items()], F.when((status == "complete") & (saved_percent == 0), NO_GAIN), status_caption(status, stage))
    icon = F.coalesce(*[F.when(status == s, name) for s, name in ICONS.items()], F.lit("status-dot"))
    again = (status == "cancelled") | ((status == "error") & F.coalesce(recoverable, F.lit(True)))
    shown = {"remove": status != "processing", "cancel": status == "processing", "retry": again, "compare": has_output, "download": has_output}
    actions = F.array_compact(F.array(*[F.when(c, name) for name, c in shown.items()]))
    return F.struct(caption.alias("caption"), icon.alias("icon"), actions.alias("actions"))


#: Code of every error; all are recoverable.
ERROR_CODES = {
    "Cancelled": "CANCELLED", "UnsupportedFormat": "UNSUPPORTED_FORMAT", "AnimatedPng": "ANIMATED_PNG", "InputTooLarge": "RESOURCE_LIMIT", "PixelLimit": "RESOURCE_LIMIT",
    "MemoryLimit": "RESOURCE_LIMIT", "InvalidColorProfile": "INVALID_COLOR_PROFILE", "Decode": "DECODE_FAILED", "Encode": "ENCODE_FAILED", "Metric": "METRIC_FAILED",
}


def error_code(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ERROR_CODES.items() for x in kv])
    return F.coalesce(F.element_at(known, name), F.lit("WORKER_FAILURE"))


def parsed_error(text: Column) -> Column:
    """JSON text to (code, message, recoverable); other text becomes the message of a worker failure."""
    p = F.from_json(text, "code string, message string, recoverable boolean")
    return F.struct(F.coalesce(p["code"], F.lit("WORKER_FAILURE")).alias("code"), F.coalesce(p["message"], text).alias("message"), F.coalesce(p["recoverable"], F.lit(True)).alias("recoverable"))
