import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rasterloom import catalog
from rasterloom.operators import reports


def test_benchmark_report_rounds_means_as_its_sql(spark, tmp_path):
    """Means of 16 taxes often lie halfway between two printed numbers; row groups part their rows."""
    rng = random.Random(3)
    rows = [(o, rng.randrange(100, 10**6) / 100, rng.randrange(11) / 100, rng.randrange(9) / 100) for _ in range(16) for o in range(400)]
    pq.write_table(pa.table(dict(zip(("l_orderkey", "l_extendedprice", "l_discount", "l_tax"), zip(*rows)))), tmp_path / "lineitem.parquet", row_group_size=900)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = sorted(r[0] for r in con.execute(catalog.ORACLES["benchmark_report"]).fetchall())
    assert sorted(r.line for r in catalog.QUERIES["benchmark_report"](spark, str(tmp_path)).collect()) == want


def test_ordered_means_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(9) / 100 if i % 7 else None) for k in range(50) for i in range(37)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    want = {k: [v for q, _, v in rows if q == k and v is not None] for k in {r[0] for r in rows}}
    for parts in (1, 5, 16):
        got = {r.k: r.m for r in df.repartition(parts).groupBy("k").agg(reports.ordered_mean(df.v, df.i).alias("m")).collect()}
        for k, vs in want.items():
            total = 0.0
            for v in vs:
                total += v
            assert got[k] == (total / len(vs) if vs else None)


def test_fixed_is_rounded_by_the_exact_value(spark):
    values = [0.03125, 0.043125, 2.675, -0.5, 1e15 + 0.5, 0.0, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(reports.fixed(F.col("v"), 2).alias("t")).collect()
    assert [r.t for r in got] == [None if v is None else f"{v:.2f}" for v in values]
