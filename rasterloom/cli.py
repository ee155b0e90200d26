"""Command line: optimize, benchmark, metrics and fixtures, on a local or configured Spark session."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import optimize as op
from .operators.reports import metrics_lines, optimized_name, saved_line, timed_line
from .sources import images, rasters


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rasterloom")
    sub = p.add_subparsers(dest="command", required=True)
    o = sub.add_parser("optimize")
    o.add_argument("input")
    o.add_argument("-o", "--output")
    o.add_argument("--json", action="store_true")
    b = sub.add_parser("benchmark")
    b.add_argument("directory")
    b.add_argument("--csv", action="store_true")
    b.add_argument("--json", action="store_true")
    b.add_argument("--runs", type=int, default=5)
    b.add_argument("--warmup", type=int, default=1)
    m = sub.add_parser("metrics")
    m.add_argument("reference")
    m.add_argument("candidate")
    m.add_argument("--json", action="store_true")
    sub.add_parser("fixtures").add_argument("output")
    return p


def _fixture(px, width: int, height: int) -> bytes:
    import numpy as np

    rows = px.orderBy("y", "x").select(*"rgba").toArrow()
    return images.write_png(np.stack([rows[c].to_numpy() for c in "rgba"], -1).astype(np.uint8).reshape(height, width, 4))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "metrics":
        found = op.measure(Path(a.reference).read_bytes(), Path(a.candidate).read_bytes())
        print(json.dumps(found, indent=2) if a.json else metrics_lines(found))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "fixtures":
        Path(a.output).mkdir(parents=True, exist_ok=True)
        for name, w, h, sparse in (("fixture-1317x1030.png", 1317, 1030, False), ("sparse-alpha.png", 128, 96, True)):
            (Path(a.output) / name).write_bytes(_fixture(rasters.fixture_png(spark, w, h, sparse), w, h))
        return 0
    if a.command == "optimize":
        files = spark.read.format("binaryFile").load(a.input).select("path", "content")
        row = op.optimize_files(files).withColumn("name", optimized_name(F.element_at(F.split("path", "/"), -1))).first().asDict()
        if row["error"]:
            print(row["error"], file=sys.stderr)
            return 1
        target = Path(a.output) if a.output else Path(a.input).with_name(row.pop("name"))
        target.write_bytes(row["output"])
        print(op.report_json(row) if a.json else saved_line(row, str(target)))
        return 0
    timed = op.benchmark_runs(images.image_files(spark, a.directory), a.runs, a.warmup)
    timed = timed.cache()
    if a.csv or a.json:
        lines = [r.line for r in op.benchmark_csv(timed).collect()]
        print("\n".join([op.CSV_HEAD, *lines]) if a.csv else json.dumps(lines, indent=2))
    else:
        for r in op.benchmark_summary(timed).toLocalIterator():
            print(timed_line(r.path, r.saved_percent, r.median))
    return 0


if __name__ == "__main__":
    sys.exit(main())
