"""The registered queries of the engine and the SQL each must equal.

Bindings: text bytes read as RGBA rasters of width 32 (documents, pages), generated fixture rasters, and
tables that stand in for an operator's input (embeddings as colours, lineitem as benchmark runs, events as
worker messages). They show what the operators compute, not results on real images.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import pixels as fn
from .operators import analysis, metrics, palette, quantize, reports, stencils, tiles
from .plans import encode
from .runtime import spread, table
from .sources import headers, rasters
from .streaming import jobs, queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SQL = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def query(spec: str, sql: str | None = None):
    """Register a query whose columns and types are ``spec``; ``d6`` is a double rounded to six places."""
    cols = [c.split() for c in spec.split(", ")]

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c).cast("double"), int(t[1:])) if t[0] == "d" and t[1:].isdigit() else F.col(c).cast(t)).alias(c) for c, t in cols])

        QUERIES[f.__name__] = functools.wraps(f)(run)
        if sql:
            casts = ", ".join(f"round(CAST({c} AS DOUBLE), {t[1:]}) AS {c}" if t[0] == "d" and t[1:].isdigit() else f"CAST({c} AS {_SQL[t]}) AS {c}" for c, t in cols)
            ORACLES[f.__name__] = f"SELECT {casts} FROM ({sql})"
        return run

    return add


def px_sql(source: str, key: str, text: str, name: str = "px") -> str:
    return f"""{name} AS (SELECT {key}, i, i % 32 AS x, i // 32 AS y, v, (v >> 24) & 255 AS r, (v >> 16) & 255 AS g, (v >> 8) & 255 AS b, v & 255 AS a
 FROM (SELECT {key}, i, ('0x' || substr(h, i * 8 + 1, 8))::BIGINT AS v
  FROM (SELECT {key}, hex(encode(coalesce({text}, ''))) AS h, unnest(range(octet_length(encode(coalesce({text}, ''))) // 4)) AS i FROM {source})))"""


def png_sql(w: int, h: int, name: str = "px") -> str:
    return f"""{name} AS (SELECT x, y, least(255, 72 + f * 38 + (z & 7)) AS r, least(255, 94 + f * 28 + ((z >> 3) & 7)) AS g, least(255, 54 + f * 19 + ((z >> 6) & 7)) AS b, 255 AS a
 FROM (SELECT x, y, (x // 64 + y // 48) % 3 AS f, (hh << u) % 4294967296 + (hh >> (32 - u)) AS z
  FROM (SELECT x, y, (x * 73856093 + y * 19349663) % 4294967296 AS hh, x % 17 + 1 AS u FROM (SELECT i % {w} AS x, i // {w} AS y FROM range({w * h}) t(i)))))"""


DOC_PX = px_sql("documents", "doc_id", "text")
LUMA = "((54 * r + 183 * g + 19 * b) >> 8)"


def doc_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return rasters.byte_raster(docs, "text", "doc_id")


def _luma() -> F.Column:
    return fn.luma(*[F.col(c) for c in "rgb"])


# --- analysis --------------------------------------------------------------------------------------------

_NEAR = "(abs(a.r - {0}.r) + abs(a.g - {0}.g) + abs(a.b - {0}.b)) // 3"
_ANALYSIS = f"""WITH {DOC_PX},
n AS (SELECT doc_id, count(*) AS pixels, greatest(1, count(*) // 250000) AS stride, bool_or(a <> 255) AS has_alpha FROM px GROUP BY doc_id),
s AS (SELECT px.*, stride FROM px JOIN n USING (doc_id) WHERE i % stride = 0),
e AS (SELECT doc_id, sum(-(c / t) * log2(c / t)) AS entropy FROM (SELECT doc_id, {LUMA} AS l, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS t FROM s GROUP BY doc_id, l) GROUP BY doc_id),
d AS (SELECT a.doc_id, greatest({_NEAR.format('l')}, {_NEAR.format('u')}) AS d FROM s a JOIN px l ON l.doc_id = a.doc_id AND l.i = a.i - 1 JOIN px u ON u.doc_id = a.doc_id AND u.i = a.i - 32 WHERE a.x > 0 AND a.y > 0),
k AS (SELECT doc_id, count(*) FILTER (d > 42) AS edges, count(*) FILTER (d BETWEEN 12 AND 42) AS noisy, count(*) FILTER (d < 5) AS flat FROM d GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS sampled, least(least(count(DISTINCT r * 65536 + g * 256 + b), 65536) * any_value(stride), 16777216) AS estimated_colors FROM s GROUP BY doc_id),
j AS (SELECT doc_id, pixels, stride, sampled, entropy, estimated_colors, coalesce(edges, 0) / sampled AS edge_density, coalesce(noisy, 0) / sampled AS noise, coalesce(flat, 0) / sampled AS flat_area_ratio, has_alpha
 FROM n JOIN c USING (doc_id) JOIN e USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT *, CASE WHEN flat_area_ratio > 0.72 AND edge_density > 0.04 THEN 'screenshot' WHEN estimated_colors < 2000 AND flat_area_ratio > 0.55 THEN 'graphic'
 WHEN entropy > 6.8 AND noise > 0.18 THEN 'photo' ELSE 'mixed' END AS kind FROM j"""


def doc_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.with_kind(analysis.analyze(doc_planes(spark, sf_dir), "doc_id", rasters.WIDTH))


@query("doc_id long, pixels long, stride long, sampled long, entropy d6, estimated_colors long, edge_density d6, noise d6, flat_area_ratio d6, has_alpha boolean, kind string", _ANALYSIS)
def content_analysis(spark, sf_dir):
    return doc_stats(spark, sf_dir)


@query("luma long, pixels long", f"WITH {px_sql('pages', 'page_id', 'html')} SELECT {LUMA} AS luma, count(*) AS pixels FROM px GROUP BY ALL")
def luma_histogram(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages", "page_id", "html"), "page_id")
    return rasters.byte_raster(pages, "html", "page_id").groupBy(_luma().alias("luma")).agg(F.count("*").alias("pixels"))


@query("doc_id long, entropy d6", f"""WITH {DOC_PX} SELECT doc_id, sum(-(c / t) * log2(c / t)) AS entropy
FROM (SELECT doc_id, {LUMA} AS l, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS t FROM px GROUP BY doc_id, l) GROUP BY doc_id""")
def luma_entropy(spark, sf_dir):
    bins = doc_pixels(spark, sf_dir).groupBy("doc_id", _luma().alias("l")).agg(F.count("*").cast("double").alias("c"))
    # one pass: the entropy is log2(total) less the mean of log2(count)
    t = F.sum("c")
    return bins.groupBy("doc_id").agg((F.log2(t) - F.sum(F.col("c") * F.log2("c")) / t).alias("entropy"))


@query("doc_id long, colors long", f"WITH {DOC_PX} SELECT doc_id, least(count(DISTINCT r * 65536 + g * 256 + b), 65536) AS colors FROM px GROUP BY doc_id")
def distinct_colors_capped(spark, sf_dir):
    px = doc_pixels(spark, sf_dir)
    return px.groupBy("doc_id").agg(F.least(F.countDistinct(fn.rgb_key(*[F.col(c) for c in "rgb"])), F.lit(analysis.COLOR_CAP)).alias("colors"))


@query("edges long, noisy long, flat long, sampled long", f"""WITH {png_sql(640, 480)} SELECT count(*) FILTER (d > 42) AS edges, count(*) FILTER (d BETWEEN 12 AND 42) AS noisy, count(*) FILTER (d < 5) AS flat, count(*) AS sampled
FROM (SELECT CASE WHEN x > 0 AND y > 0 THEN greatest({_NEAR.format('l')}, {_NEAR.format('u')}) END AS d FROM (SELECT p.*, x - 1 AS lx, y - 1 AS uy FROM px p) a
 LEFT JOIN (SELECT x AS lx, y AS ly, r, g, b FROM px) l ON l.lx = a.lx AND l.ly = a.y LEFT JOIN (SELECT x AS ux, y AS uy, r, g, b FROM px) u ON u.ux = a.x AND u.uy = a.uy)""")
def edge_noise_flat(spark, sf_dir):
    rgb = [F.col(c) for c in "rgb"]
    left = [F.lag(c).over(Window.partitionBy("y").orderBy("x")) for c in "rgb"]
    up = [F.lag(c).over(Window.partitionBy("x").orderBy("y")) for c in "rgb"]
    d = F.when((F.col("x") > 0) & (F.col("y") > 0), F.greatest("dl", "du"))
    px = rasters.fixture_png(spark, 640, 480).withColumn("dl", fn.channel_difference(rgb, left)).withColumn("du", fn.channel_difference(rgb, up)).withColumn("d", d)
    return px.agg(F.count_if(F.col("d") > analysis.EDGE).alias("edges"), F.count_if(F.col("d").between(analysis.NOISE_LOW, analysis.EDGE)).alias("noisy"), F.count_if(F.col("d") < analysis.FLAT).alias("flat"), F.count("*").alias("sampled"))


@query("doc_id long, has_alpha boolean", f"WITH {DOC_PX} SELECT doc_id, bool_or(a <> 255) AS has_alpha FROM px GROUP BY doc_id")
def alpha_presence(spark, sf_dir):
    return doc_pixels(spark, sf_dir).groupBy("doc_id").agg(F.bool_or(F.col("a") != 255).alias("has_alpha"))


# --- fixtures and headers --------------------------------------------------------------------------------


@query("x int, y int, r int, g int, b int, a int", f"WITH {png_sql(128, 96)} SELECT x, y, r, g, b, CASE WHEN x = 127 AND y = 95 THEN 1 ELSE a END AS a FROM px")
def fixture_png(spark, sf_dir):
    return rasters.fixture_png(spark, 128, 96, sparse_alpha=True)


@query("x int, y int, r int, g int, b int", """SELECT x, y, least(255, 30 + h // 2 + w // 10) AS r, least(255, 48 + h + w // 9) AS g, least(255, 82 + (255 - h) // 3 + w // 11) AS b
FROM (SELECT x, y, xor((x // 17) * 29, (y // 23) * 47) & 255 AS w, (y * 180 // 240) & 255 AS h FROM (SELECT i % 320 AS x, i // 320 AS y FROM range(76800) t(i)))""")
def fixture_jpeg(spark, sf_dir):
    return rasters.fixture_jpeg(spark, 320, 240)


_HEADS = [b"\xff\xd8\xff\xe0rest", headers.PNG_SIGNATURE + b"rest", b"GIF89a", b"\xff\xd8", b""]


@query("format string, files long", """WITH f AS (SELECT encode(coalesce(html, '')) AS c FROM pages UNION ALL SELECT unnest([unhex('FFD8FFE072657374'), unhex('89504E470D0A1A0A72657374'), encode('GIF89a'), unhex('FFD8'), encode('')]))
SELECT CASE WHEN hex(c) LIKE 'FFD8FF%' THEN 'jpeg' WHEN hex(c) LIKE '89504E470D0A1A0A%' THEN 'png' ELSE 'unsupported' END AS format, count(*) AS files FROM f GROUP BY ALL""")
def format_sniff(spark, sf_dir):
    heads = spark.createDataFrame([(bytearray(h),) for h in _HEADS], "content binary")
    files = table(spark, sf_dir, "pages", "html").select(F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content")).union(heads)
    return files.groupBy(F.coalesce(headers.format_of(F.col("content")), F.lit("unsupported")).alias("format")).agg(F.count("*").alias("files"))


def _literal_pngs(spark: SparkSession) -> DataFrame:
    import struct

    chunk = lambda n, b=b"": struct.pack(">I", len(b)) + n + b + b"\0\0\0\0"
    head = headers.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 16, 6, 0, 0, 0))
    rows = [("plain", head + chunk(b"IEND")), ("display", head + chunk(b"gAMA", b"\0\0\xb1\x8f") + chunk(b"tEXt", b"x") + chunk(b"pHYs", b"123456789") + chunk(b"IEND")), ("animated", headers.PNG_SIGNATURE + chunk(b"acTL", b"12345678")), ("cut", headers.PNG_SIGNATURE + struct.pack(">I", 99) + b"acTL"), ("empty", b"")]
    return spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "path string, content binary")


@query("path string, width long, height long, bit_depth int, animated boolean, chunks string", """SELECT * FROM (VALUES ('plain', 7, 5, 16, false, ''), ('display', 7, 5, 16, false, 'gAMA,pHYs'), ('animated', 825373492, 892745528, 0, true, ''),
 ('cut', NULL, NULL, 8, false, ''), ('empty', NULL, NULL, 8, false, '')) v(path, width, height, bit_depth, animated, chunks)""")
def png_headers(spark, sf_dir):
    return headers.png_info(_literal_pngs(spark)).withColumn("chunks", F.array_join(F.transform("chunks", lambda c: c["name"]), ","))


@query("path string, ok boolean, components int, orientation int, icc_parts int, icc_valid boolean, icc_space string, icc_kind string", """SELECT * FROM (VALUES ('progressive', true, 4, 1, 0, false, NULL, NULL), ('icc', true, 4, 1, 1, false, 'CMYK', NULL),
 ('turned', true, 3, 6, 0, false, NULL, NULL), ('cut', false, NULL, NULL, NULL, NULL, NULL, NULL)) v(path, ok, components, orientation, icc_parts, icc_valid, icc_space, icc_kind)""")
def jpeg_headers(spark, sf_dir):
    sof = lambda n: b"\xff\xc2\x00\x08\x08\x00\x01\x00\x01" + bytes([n])
    icc = b"ICC_PROFILE\0\x01\x01" + bytes(16) + b"CMYK" + bytes(16) + b"acsp" + bytes(88)
    app2 = b"\xff\xe2" + (len(icc) + 2).to_bytes(2, "big") + icc
    end = b"\xff\xda\x00\x02"
    rows = [("progressive", b"\xff\xd8" + sof(4) + end), ("icc", b"\xff\xd8" + app2 + sof(4) + end), ("turned", headers.insert_segments(b"\xff\xd8" + sof(3) + end, [headers.orientation_segment(6)])), ("cut", b"\xff\xd8\xff\xe2\x00\xff")]
    return headers.jpeg_info(spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "path string, content binary"))


@query("orientation int, x int, y int, r int", f"""WITH {png_sql(24, 16)} SELECT orientation, CASE orientation WHEN 2 THEN 23 - x WHEN 3 THEN 23 - x WHEN 5 THEN y WHEN 6 THEN 15 - y WHEN 7 THEN 15 - y WHEN 8 THEN y ELSE x END AS x,
 CASE orientation WHEN 3 THEN 15 - y WHEN 4 THEN 15 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 23 - x WHEN 8 THEN 23 - x ELSE y END AS y, r FROM px, (SELECT unnest(range(1, 9)) AS orientation)""")
def orientation_apply(spark, sf_dir):
    px = rasters.fixture_png(spark, 24, 16).withColumn("orientation", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return px.select("orientation", rasters.oriented(F.col("x"), F.col("y"), F.lit(24), F.lit(16), F.col("orientation")).alias("at"), "r").select("orientation", "at.x", "at.y", "r")


# --- guards and plans ------------------------------------------------------------------------------------


@query("verdict string, orders long", """SELECT CASE WHEN s <= 0 OR s > 104857600 THEN 'RESOURCE_LIMIT:bytes' WHEN m NOT IN ('image/jpeg', 'image/png') THEN 'UNSUPPORTED_FORMAT' WHEN p > 24000000 THEN 'RESOURCE_LIMIT:pixels'
 WHEN 20 * p + 2 * s > 805306368 THEN 'RESOURCE_LIMIT:memory' ELSE 'admitted' END AS verdict, count(*) AS orders
FROM (SELECT o_orderkey % 7 * 20000000 AS s, CASE o_orderkey % 5 WHEN 0 THEN 'image/gif' WHEN 1 THEN 'image/png' ELSE 'image/jpeg' END AS m, o_custkey * 2000 AS p FROM orders) GROUP BY ALL""")
def admission_guards(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    mime = F.when(F.col("o_orderkey") % 5 == 0, "image/gif").when(F.col("o_orderkey") % 5 == 1, "image/png").otherwise("image/jpeg")
    verdict = encode.admission(F.col("o_orderkey") % 7 * 20_000_000, mime, F.col("o_custkey") * 2000)
    return o.groupBy(F.coalesce(verdict, F.lit("admitted")).alias("verdict")).agg(F.count("*").alias("orders"))


@query("doc_id long, kind string, speed int, preset int, zopfli int, jpeg_quality int, chroma string, browser_chroma string, dither_map boolean, trials int", f"""SELECT doc_id, kind, 3 AS speed, 4 AS preset,
 CASE WHEN pixels <= 65536 THEN 15 WHEN pixels <= 300000 THEN 3 END AS zopfli, CASE WHEN kind IN ('graphic', 'screenshot') THEN 90 ELSE 88 END AS jpeg_quality, CASE kind WHEN 'photo' THEN '4:2:0' WHEN 'mixed' THEN '4:2:2' ELSE '4:4:4' END AS chroma,
 CASE WHEN kind IN ('graphic', 'screenshot') THEN '4:4:4' ELSE '4:2:0' END AS browser_chroma, true AS dither_map, 29 AS trials FROM ({_ANALYSIS})""")
def encode_plan(spark, sf_dir):
    s, c = doc_stats(spark, sf_dir), F.col
    speed = encode.quantizer_speed(c("pixels"), c("estimated_colors"))
    more = encode.speed_settings(speed)
    return s.select("doc_id", "kind", speed.alias("speed"), encode.png_preset(c("pixels"), c("estimated_colors")).alias("preset"), encode.zopfli_iterations(c("pixels")).alias("zopfli"), encode.jpeg_quality(c("kind")).alias("jpeg_quality"), encode.jpeg_chroma(c("kind")).alias("chroma"), encode.browser_chroma(c("kind"), F.lit(False)).alias("browser_chroma"), more["dither_map"].alias("dither_map"), more["trials"].alias("trials"))


@query("preset int, zopfli int, optimize_alpha boolean, keep string, speed int, jpeg_quality int, chroma string, orders long", """SELECT CASE WHEN p <= 1000000 OR (c <= 65536 AND p <= 8000000) THEN 4 WHEN p <= 4000000 THEN 2 ELSE 1 END AS preset, CASE WHEN p <= 65536 THEN 15 WHEN p <= 300000 THEN 3 END AS zopfli, true AS optimize_alpha,
 'cICP,iCCP,sRGB,gAMA,cHRM,pHYs,eXIf' AS keep, CASE WHEN c <= 65536 OR p <= 500000 THEN 3 ELSE 5 END AS speed, CASE WHEN k IN ('graphic', 'screenshot') THEN 90 ELSE 88 END AS jpeg_quality, CASE k WHEN 'photo' THEN '4:2:0' WHEN 'mixed' THEN '4:2:2' ELSE '4:4:4' END AS chroma, count(*) AS orders
FROM (SELECT o_custkey * o_custkey * 20 % 12000000 AS p, o_orderkey * 7919 % 131072 AS c, ['photo', 'mixed', 'graphic', 'screenshot'][o_orderkey % 4 + 1] AS k FROM orders) GROUP BY ALL""")
def encode_effort(spark, sf_dir):
    """Every branch of the plans, over sizes and colour counts up to their limits."""
    kind = F.element_at(F.array(*map(F.lit, ["photo", "mixed", "graphic", "screenshot"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select((F.col("o_custkey") * F.col("o_custkey") * 20 % 12_000_000).alias("p"), (F.col("o_orderkey") * 7919 % 131_072).alias("c"), kind.alias("k"))
    plan = o.select(encode.png_options(F.col("p"), F.col("c")).alias("o"), encode.quantizer_speed(F.col("p"), F.col("c")).alias("speed"), encode.jpeg_quality(F.col("k")).alias("jpeg_quality"), encode.jpeg_chroma(F.col("k")).alias("chroma"))
    return plan.groupBy("o.preset", "o.zopfli", "o.optimize_alpha", F.array_join("o.keep", ",").alias("keep"), "speed", "jpeg_quality", "chroma").agg(F.count("*").alias("orders"))


@query("speed int, iterations int, iteration_limit d12, trials int, histogram_entries long, dither_map boolean, contrast_maps boolean", """SELECT s AS speed, greatest(8 - s, 0) + greatest(8 - s, 0) * greatest(8 - s, 0) // 2 AS iterations, 1.0::DOUBLE / (1 << (23 - s)) AS iteration_limit,
 greatest(56 - 9 * s, 0) AS trials, 131072 + 262144 * (10 - s) AS histogram_entries, s <= 5 AS dither_map, s <= 7 AS contrast_maps FROM range(1, 11) t(s)""")
def speed_settings(spark, sf_dir):
    s = spark.range(1, 11).select(F.col("id").cast("int").alias("speed"))
    return s.select("speed", *[v.alias(k) for k, v in encode.speed_settings(F.col("speed")).items()])


@query("has_icc boolean, gray boolean, space string, kind string, convert boolean, keep boolean", """SELECT has_icc, gray, space, kind, CASE WHEN NOT has_icc THEN false WHEN gray THEN space <> 'GRAY' ELSE NOT (space = 'RGB ' AND kind IN ('srgb', 'display-p3')) END AS convert,
 CASE WHEN NOT has_icc THEN false WHEN gray THEN space = 'GRAY' ELSE space = 'RGB ' AND kind = 'display-p3' END AS keep
FROM (SELECT unnest([true, false]) AS has_icc), (SELECT unnest([true, false]) AS gray), (SELECT unnest(['RGB ', 'GRAY', 'CMYK']) AS space), (SELECT unnest(['srgb', 'display-p3', 'other']) AS kind)""")
def profile_plan(spark, sf_dir):
    one = spark.range(1).select(*[F.lit(None).alias("_")])
    for name, values in (("has_icc", [True, False]), ("gray", [True, False]), ("space", ["RGB ", "GRAY", "CMYK"]), ("kind", ["srgb", "display-p3", "other"])):
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return one.withColumn("p", encode.profile_plan(*[F.col(c) for c in ("has_icc", "gray", "space", "kind")])).select("has_icc", "gray", "space", "kind", "p.convert", "p.keep")


@query("l_orderkey long, l_linenumber int, output double, saved d6, saved_percent d6, already_optimized boolean, choice string", """SELECT l_orderkey, l_linenumber, CASE WHEN after >= before THEN before ELSE after END AS output, before - CASE WHEN after >= before THEN before ELSE after END AS saved,
 CASE WHEN before > 0 THEN (before - CASE WHEN after >= before THEN before ELSE after END) / before * 100 ELSE 0 END AS saved_percent, after >= before AS already_optimized, CASE WHEN after <= before * 0.9::DOUBLE THEN 'lossy' ELSE 'lossless' END AS choice
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS before, l_extendedprice + (l_quantity - 40) * 100 AS after FROM lineitem)""")
def no_growth(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    before, after = F.col("l_extendedprice"), F.col("l_extendedprice") + (F.col("l_quantity") - 40) * 100
    return li.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in encode.no_growth(before, after).items()], encode.choose_lossy(after, before).alias("choice"))


# --- colours ---------------------------------------------------------------------------------------------

_G = fn.GAMMA


@query("doc_id long, sa d6, sr d6, sg d6, sb d6", f"""WITH {DOC_PX} SELECT doc_id, avg(a / 255.0::DOUBLE) AS sa, avg(pow(r / 255.0::DOUBLE, {_G!r}::DOUBLE) * (a / 255.0::DOUBLE)) AS sr, avg(pow(g / 255.0::DOUBLE, {_G!r}::DOUBLE) * (a / 255.0::DOUBLE)) AS sg,
 avg(pow(b / 255.0::DOUBLE, {_G!r}::DOUBLE) * (a / 255.0::DOUBLE)) AS sb FROM px GROUP BY doc_id""")
def gamma_premultiply(spark, sf_dir):
    c = fn.premultiplied(*[F.col(n) for n in "rgba"])
    return doc_pixels(spark, sf_dir).groupBy("doc_id").agg(*[F.avg(v).alias(f"s{k}") for k, v in c.items()])


@query("pixels long, off_by_more_than_one long", """SELECT count(*) AS pixels, 0 AS off_by_more_than_one FROM range(64), range(16)""")
def color_roundtrip(spark, sf_dir):
    px = spark.range(1024).select(*[(F.floor(F.col("id") / d) % m * s).cast("int").alias(n) for n, d, m, s in (("r", 1, 4, 85), ("g", 4, 4, 85), ("b", 16, 4, 85))], (F.floor(F.col("id") / 64) * 17).cast("int").alias("a"))
    back = fn.to_bytes(fn.premultiplied(*[F.col(n) for n in "rgba"]))
    far = (F.col("a") > 0) & F.greatest(*[F.abs(back[n] - F.col(n)) for n in "rgba"]).__gt__(1)
    return px.agg(F.count("*").alias("pixels"), F.count_if(far).alias("off_by_more_than_one"))


@query("x int, y int, difference d6, least_difference d6", f"""WITH {png_sql(64, 48)}, q AS (SELECT x, y, 1.0::DOUBLE AS a, pow(r / 255.0::DOUBLE, {_G!r}::DOUBLE) AS r, pow(g / 255.0::DOUBLE, {_G!r}::DOUBLE) AS g, pow(b / 255.0::DOUBLE, {_G!r}::DOUBLE) AS b FROM px),
p AS (SELECT x, y, r AS x1, g AS x2, b AS x3, g * 0.5::DOUBLE AS y1, b * 0.5::DOUBLE AS y2, r * 0.5::DOUBLE AS y3, -0.5::DOUBLE AS d FROM q)
SELECT x, y, pow(x1 - y1, 2) + pow(x1 - y1 + d, 2) + pow(x2 - y2, 2) + pow(x2 - y2 + d, 2) + pow(x3 - y3, 2) + pow(x3 - y3 + d, 2) AS difference,
 2 * (least(pow(x1 - y1, 2), pow(x1 - y1 + d, 2)) + least(pow(x2 - y2, 2), pow(x2 - y2 + d, 2)) + least(pow(x3 - y3, 2), pow(x3 - y3 + d, 2))) AS least_difference FROM p""")
def color_distance(spark, sf_dir):
    c = fn.premultiplied(*[F.col(n) for n in "rgba"])
    px = rasters.fixture_png(spark, 64, 48).select("x", "y", *[v.alias(f"c{k}") for k, v in c.items()])
    one = {k: F.col(f"c{k}") for k in "argb"}
    other = {"a": F.col("ca") * 0.5, "r": F.col("cg") * 0.5, "g": F.col("cb") * 0.5, "b": F.col("cr") * 0.5}
    return px.select("x", "y", fn.color_difference(one, other).alias("difference"), fn.min_color_difference(one, other).alias("least_difference"))


_MSE = "CASE WHEN q = 0 THEN 1e20::DOUBLE WHEN q >= 100 THEN 0.0::DOUBLE ELSE greatest(0.016::DOUBLE / (0.001::DOUBLE + q) - 0.001::DOUBLE, 0) + 2.5::DOUBLE / pow(210.0::DOUBLE + q, 1.2::DOUBLE) * (100.1::DOUBLE - q) / 100.0 END"


@query("q int, mse d9, back int", f"""WITH m AS (SELECT q, {_MSE} AS mse FROM range(1, 101) t(q)) SELECT a.q, a.mse, coalesce(max(b.q), 0) AS back FROM m a LEFT JOIN m b ON b.q >= 1 AND a.mse <= b.mse + 0.000001::DOUBLE GROUP BY a.q, a.mse""")
def quality_scale(spark, sf_dir):
    m = spark.range(1, 101).select(F.col("id").cast("int").alias("q"), fn.quality_to_mse(F.col("id")).alias("mse"))
    # both sides are the fixed scale of 100 rows
    b = m.select(F.col("q").alias("bq"), F.col("mse").alias("bm"))
    return m.join(F.broadcast(b), F.col("mse") <= F.col("bm") + 1e-6, "left").groupBy("q", "mse").agg(F.coalesce(F.max("bq"), F.lit(0)).alias("back"))


# --- palettes --------------------------------------------------------------------------------------------

_POST = "((({0} & 248) | (({0} & 224) >> 5)))"


@query("doc_id long, color long, weight d6", f"""WITH {DOC_PX}, k AS (SELECT doc_id, CASE WHEN a = 0 THEN 0 ELSE r + g * 256 + b * 65536 + a * 16777216 END AS color FROM px)
SELECT doc_id, color, least(count(*)::DOUBLE, 0.1::DOUBLE * any_value(t)) AS weight FROM k JOIN (SELECT doc_id, count(*) AS t FROM k GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, color""")
def color_histogram(spark, sf_dir):
    return palette.histogram(doc_pixels(spark, sf_dir), "doc_id")


@query("r long, g long, b long, pixels long", f"WITH {DOC_PX} SELECT {_POST.format('r')} AS r, {_POST.format('g')} AS g, {_POST.format('b')} AS b, count(*) AS pixels FROM px GROUP BY ALL")
def posterized_histogram(spark, sf_dir):
    keys = [fn.posterized(F.col(c), 3).alias(c) for c in "rgb"]
    return doc_pixels(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("pixels"))


_EXACT = f"""{DOC_PX}, k AS (SELECT doc_id, i, CASE WHEN a = 0 THEN 0 ELSE v END AS color FROM px), f AS (SELECT doc_id, color, min(i) AS first, count(*) AS pixels FROM k GROUP BY ALL),
o AS (SELECT doc_id, color, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS idx, pixels FROM f QUALIFY count(*) OVER (PARTITION BY doc_id) <= {palette.ENTRIES})"""


@query("doc_id long, color long, idx int, pixels long", f"WITH {_EXACT} SELECT * FROM o")
def exact_palette(spark, sf_dir):
    return palette.exact_palette(doc_pixels(spark, sf_dir), "doc_id")


@query("doc_id long, i int, idx int", f"WITH {_EXACT} SELECT k.doc_id, i, idx FROM k JOIN o USING (doc_id, color)")
def palette_index_plane(spark, sf_dir):
    px = doc_pixels(spark, sf_dir)
    return palette.indexed(px, palette.exact_palette(px, "doc_id"), "doc_id")


#: Numbers of an embedding; a colour of the palette queries has as many channels.
DIMS = 64
_CENTERS = "c AS (SELECT label, [" + ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, DIMS + 1)) + "] AS p FROM embeddings GROUP BY label)"
_NEAREST = f"""{_CENTERS}, d AS (SELECT vec_id, embedding, e.label AS own, c.label, round(list_sum(list_transform(range(1, {DIMS + 1}), lambda i: pow(embedding[i]::DOUBLE - p[i], 2))), 6) AS d FROM embeddings e, c),
b AS (SELECT vec_id, any_value(own) AS own, any_value(embedding) AS embedding, min_by(label, (d, label)) AS label, min(d) AS d FROM d GROUP BY vec_id)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    center = F.array(*[F.avg(F.element_at("embedding", i).cast("double")) for i in range(1, DIMS + 1)])
    entries = e.groupBy("label").agg(center.alias("p"))
    return palette.nearest(e.select("vec_id", F.col("embedding").alias("c"), F.col("label").alias("own")), entries, "label")


@query("vec_id long, own int, label int, d d6", f"WITH {_NEAREST} SELECT vec_id, own, label, d FROM b")
def nearest_palette(spark, sf_dir):
    return _nearest(spark, sf_dir)


@query("label int, popularity d6, error d6, " + ", ".join(f"m{i} d6" for i in range(DIMS)), f"""WITH {_NEAREST}, w AS (SELECT *, 1.0::DOUBLE + vec_id % 3 AS w FROM b)
SELECT label, sum(w) AS popularity, sum(d * w) / sum(w) AS error, {', '.join(f'sum(embedding[{i + 1}]::DOUBLE * w) / sum(w) AS m{i}' for i in range(DIMS))} FROM w GROUP BY label""")
def voronoi_step(spark, sf_dir):
    return palette.voronoi_step(_nearest(spark, sf_dir).withColumn("w", 1.0 + F.col("vec_id") % 3), "label", "c", DIMS, "w")


_BIN = """i AS (SELECT label, abs(embedding[k + 1])::DOUBLE AS a, embedding[k + 2]::DOUBLE AS r, embedding[k + 3]::DOUBLE AS g, embedding[k + 4]::DOUBLE AS b, 1.0::DOUBLE + vec_id % 5 AS w, vec_id, k FROM embeddings, range(0, 64, 4) t(k)),
m AS (SELECT label, sum(w) AS weight, count(*) AS colors, sum(a * w) / sum(w) AS m_a, sum(r * w) / sum(w) AS m_r, sum(g * w) / sum(w) AS m_g, sum(b * w) / sum(w) AS m_b FROM i GROUP BY label),
e AS (SELECT *, pow(m_r - r, 2) + pow(m_r - r + a - m_a, 2) + pow(m_g - g, 2) + pow(m_g - g + a - m_a, 2) + pow(m_b - b, 2) + pow(m_b - b + a - m_a, 2) AS e FROM i JOIN m USING (label)),
s AS (SELECT label, any_value(weight) AS weight, any_value(colors) AS colors, """ + ", ".join(f"any_value(m_{c}) AS m_{c}, sum(CASE WHEN pow(m_{c} - {c}, 2) < pow({g!r}::DOUBLE, 2) THEN pow(m_{c} - {c}, 2) * 0.25::DOUBLE ELSE pow(m_{c} - {c}, 2) END * w) * {f!r}::DOUBLE AS v_{c}" for c, (f, g) in palette.FACTORS.items()) + ", max(e) AS max_error, sum(e * w) AS total_error FROM e GROUP BY label)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every four numbers of an embedding as a colour of its label's bin."""
    at = lambda j: F.element_at("embedding", F.col("k") + j).cast("double")
    four = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select("*", F.explode(F.sequence(F.lit(0), F.lit(DIMS - 1), F.lit(4))).alias("k"))
    return four.select("vec_id", "k", "label", F.abs(at(1)).alias("a"), at(2).alias("r"), at(3).alias("g"), at(4).alias("b"), (1.0 + F.col("vec_id") % 5).alias("w"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.bin_statistics(_items(spark, sf_dir), "label")


@query("label int, weight d6, colors long, m_a d6, m_r d6, m_g d6, m_b d6, v_a d6, v_r d6, v_g d6, v_b d6, max_error d6, total_error d6", f"WITH {_BIN} SELECT * FROM s")
def bin_statistics(spark, sf_dir):
    return _bins(spark, sf_dir)


@query("label int, score d6, channels string", f"""WITH {_BIN}, q AS (SELECT label, weight * greatest(v_a, v_r, v_g, v_b) * CASE WHEN max_error > 0.5 THEN max_error / 0.5::DOUBLE ELSE 1 END AS score,
 array_to_string(list_transform(list_sort([(-v_r, 0, 'r'), (-v_g, 1, 'g'), (-v_b, 2, 'b'), (-v_a, 3, 'a')]), lambda t: t[3]), '') AS channels FROM s) SELECT * FROM q ORDER BY score DESC, label LIMIT 1""")
def best_split(spark, sf_dir):
    scored = _bins(spark, sf_dir).select("label", palette.split_score(0.5).alias("score"), palette.channel_order().alias("channels"))
    return scored.agg(F.max_by(F.struct("label", "score", "channels"), F.struct("score", -F.col("label"))).alias("b")).select("b.*")


@query("vec_id long, d d6, weight d6", f"WITH {_NEAREST} SELECT vec_id, d, (1.0::DOUBLE + vec_id % 3) * sqrt(1 + d) AS weight FROM b")
def reweighted_points(spark, sf_dir):
    return _nearest(spark, sf_dir).withColumn("weight", palette.reweighted(1.0 + F.col("vec_id") % 3, F.col("d")))


@query("label int, a d6, r d6, g d6, b d6", f"""WITH {_BIN}, f AS (SELECT *, w * (1 + pow(0.5::DOUBLE - r, 2) + pow(0.5::DOUBLE - g, 2) + pow(0.5::DOUBLE - b, 2)) AS f FROM i),
v AS (SELECT label, CASE WHEN sum(a * w) / sum(w) >= 1 AND max(a) >= 255.0::DOUBLE / 256 THEN 1.0::DOUBLE ELSE sum(a * w) / sum(w) END AS a, {', '.join(f'sum(CASE WHEN a <> 0 THEN {c} / a ELSE {c} END * f) / sum(f) AS p{c}' for c in 'rgb')} FROM f GROUP BY label)
SELECT label, a, pr * a AS r, pg * a AS g, pb * a AS b FROM v""")
def favoring_average(spark, sf_dir):
    return palette.favoring_average(_items(spark, sf_dir), "label", {c: F.lit(0.5) for c in "rgb"})


@query("vec_id long, k int, channels string, key long", f"""WITH {_BIN}, q AS (SELECT label, array_to_string(list_transform(list_sort([(-v_r, 0, 'r'), (-v_g, 1, 'g'), (-v_b, 2, 'b'), (-v_a, 3, 'a')]), lambda t: t[3]), '') AS channels FROM s),
p AS (SELECT i.*, channels, map {{'a': a, 'r': r, 'g': g, 'b': b}} AS m FROM i JOIN q USING (label))
SELECT vec_id, k, channels, (greatest(0, floor(m[channels[1]] * 65535))::BIGINT * 65536) | greatest(0, floor((m[channels[3]] + m[channels[2]] / 2 + m[channels[4]] / 4) * 65535))::BIGINT AS key FROM p""")
def split_keys(spark, sf_dir):
    # one row per bin of a palette, of which there are at most 256
    order = _bins(spark, sf_dir).select("label", palette.channel_order().alias("channels")).limit(palette.ENTRIES)
    return _items(spark, sf_dir).join(F.broadcast(order), "label").withColumn("key", palette.split_key(F.col("channels")))


@query("l_suppkey long, split_at long, items long, weight d6", """WITH r AS (SELECT l_suppkey, row_number() OVER o AS rn, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS run, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS whole
FROM lineitem WINDOW o AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)) SELECT l_suppkey, min(rn) FILTER (run * 2 >= whole) AS split_at, count(*) AS items, max(whole) AS weight FROM r GROUP BY l_suppkey""")
def half_weight_split(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity")
    return palette.half_weight(li, "l_suppkey", [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], "l_quantity")


_ENTRIES = "SELECT vec_id // 256 AS palette, vec_id AS entry, CASE WHEN vec_id % 4 = 0 THEN 0.5 ELSE 1.0 END AS a, round(abs(embedding[1]), 4) AS popularity FROM embeddings"


@query("palette long, entry long, popularity d4, position long", f"""WITH e AS ({_ENTRIES}), r AS (SELECT *, row_number() OVER (PARTITION BY palette ORDER BY a >= 255.0 / 256, popularity DESC, entry) - 1 AS r, count(*) OVER (PARTITION BY palette) AS n FROM e)
SELECT palette, entry, popularity, CASE WHEN n > 16 AND r BETWEEN 1 AND 3 THEN r + 6 WHEN n > 16 AND r BETWEEN 7 AND 9 THEN r - 6 ELSE r END AS position FROM r""")
def palette_order(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    e = e.select(F.floor(F.col("vec_id") / 256).alias("palette"), F.col("vec_id").alias("entry"), F.when(F.col("vec_id") % 4 == 0, 0.5).otherwise(1.0).alias("a"), F.round(F.abs(F.element_at("embedding", 1)), 4).alias("popularity"))
    return palette.palette_order(e, "palette")


# --- stencils --------------------------------------------------------------------------------------------

_W, _H = 320, 240
_SIDES = "lag({0}) OVER a AS l, lead({0}) OVER a AS r, lag({0}) OVER d AS u, lead({0}) OVER d AS w"
_WINDOWS = "WINDOW a AS (PARTITION BY y ORDER BY x), d AS (PARTITION BY x ORDER BY y)"


@query("x int, y int, h int, v int, noise int, edges int", f"""WITH {png_sql(_W, _H)}, n AS (SELECT x, y, g, coalesce(lag(g) OVER a, g) AS l, coalesce(lead(g) OVER a, g) AS r, coalesce(lag(g) OVER d, g) AS u, coalesce(lead(g) OVER d, g) AS w FROM px {_WINDOWS}),
s AS (SELECT x, y, abs(l + r - 2 * g) AS h, abs(u + w - 2 * g) AS v FROM n), f AS (SELECT *, h / 255.0::DOUBLE AS fh, v / 255.0::DOUBLE AS fv FROM s),
z AS (SELECT *, greatest(fh, fv) AS e, 1.0::DOUBLE - greatest(greatest(fh, fv) - abs(fh - fv) * 0.5::DOUBLE, least(fh, fv)) AS z FROM f)
SELECT x, y, h, v, least(255, greatest(0, floor(round(z * z * z * z * 256, 6)))) AS noise, least(255, greatest(0, floor(round((1.0::DOUBLE - e) * 256, 6)))) AS edges FROM z""")
def second_difference_map(spark, sf_dir):
    return stencils.contrast(rasters.fixture_png(spark, _W, _H), ["g"])


@query("x int, y int, max5 int, min5 int", f"""WITH {png_sql(_W, _H)}, n AS (SELECT x, y, g, coalesce(lag(g) OVER a, g) AS l, coalesce(lead(g) OVER a, g) AS r, coalesce(lag(g) OVER d, g) AS u, coalesce(lead(g) OVER d, g) AS w FROM px {_WINDOWS})
SELECT x, y, greatest(g, l, r, u, w) AS max5, least(g, l, r, u, w) AS min5 FROM n""")
def morphology_minmax(spark, sf_dir):
    return stencils.morphology(rasters.fixture_png(spark, _W, _H), "g")


@query("x int, y int, blurred int", f"""WITH {png_sql(_W, _H)}, o AS (SELECT unnest(range(-2, 4)) AS o),
a AS (SELECT p.x, p.y, sum(q.g) // 6 AS s FROM px p CROSS JOIN o JOIN px q ON q.y = p.y AND q.x = least({_W - 1}, greatest(0, p.x + o)) GROUP BY ALL)
SELECT p.x, p.y, sum(q.s) // 6 AS blurred FROM a p CROSS JOIN o JOIN a q ON q.x = p.x AND q.y = least({_H - 1}, greatest(0, p.y + o)) GROUP BY ALL""")
def box_blur(spark, sf_dir):
    return stencils.box_blur(rasters.fixture_png(spark, _W, _H), "g", 3, _W, _H)


@query("y int, begin int, length long, value int, above long, below long", f"""WITH {png_sql(_W, _H)}, v AS (SELECT x, y, r // 20 AS v FROM px),
m AS (SELECT x, y, v, CASE WHEN lag(v) OVER a = v THEN 0 ELSE 1 END AS s, coalesce((lag(v) OVER d = v)::INT, 0) AS u, coalesce((lead(v) OVER d = v)::INT, 0) AS w FROM v {_WINDOWS}),
i AS (SELECT *, sum(s) OVER (PARTITION BY y ORDER BY x ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT y, min(x) AS begin, count(*) AS length, any_value(v) AS value, sum(u) AS above, sum(w) AS below FROM i GROUP BY y, i""")
def dither_runs(spark, sf_dir):
    px = rasters.fixture_png(spark, _W, _H).withColumn("v", F.floor(F.col("r") / 20))
    return stencils.runs(px, "v")


# --- tiles -----------------------------------------------------------------------------------------------

_DETAIL = "px AS (SELECT x, y, (x * y) % greatest(1, x // 64) * 16 % 256 AS g FROM (SELECT i % 1024 AS x, i // 1024 AS y FROM range(524288) t(i)))"
_TILES = f"""{_DETAIL}, n AS (SELECT x, y, abs(g - lead(g) OVER a) + abs(g - lead(g) OVER d) AS d FROM px {_WINDOWS}),
t AS (SELECT x // 256 * 256 AS tx, y // 256 * 256 AS ty, avg(d) AS activity FROM n WHERE x % 256 < 255 AND y % 256 < 255 AND x % 2 = 0 AND y % 2 = 0 GROUP BY ALL)"""


def _detail(spark: SparkSession) -> DataFrame:
    px = rasters.grid(spark, 1024, 512)
    return px.withColumn("g", F.col("x") * F.col("y") % F.greatest(F.lit(1), F.floor(F.col("x") / 64)) * 16 % 256)


@query("tx int, ty int, activity d6", f"WITH {_TILES} SELECT * FROM t")
def tile_activity(spark, sf_dir):
    return tiles.tile_activity(_detail(spark), 1024, 512)


@query("rank int, tx int, ty int, activity d6, target int", f"""WITH {_TILES}, r AS (SELECT *, row_number() OVER (ORDER BY activity, ty, tx) - 1 AS rank, count(*) OVER () AS n FROM t)
SELECT rank, tx, ty, activity, CASE WHEN (SELECT max(activity) FROM r WHERE rank = floor((n - 1) * 0.75)) < 6 THEN 77 ELSE 71 END AS target FROM r WHERE n <= 6 OR rank IN (SELECT floor(i * (n - 1) / 5 + 0.5) FROM range(6) q(i))""")
def tile_sample(spark, sf_dir):
    return tiles.sample_tiles(tiles.tile_activity(_detail(spark), 1024, 512))


@query("tx int, ty int, pixels long, green long", f"""WITH {_DETAIL} SELECT x // 256 * 256 AS tx, y // 256 * 256 AS ty, count(*) AS pixels, sum(g) AS green FROM px WHERE x // 256 % 2 = 0 GROUP BY ALL""")
def tile_extract(spark, sf_dir):
    px = _detail(spark)
    picked = spark.createDataFrame([(x, y) for x in (0, 512) for y in (0, 256)], "tx int, ty int")
    return tiles.tile_pixels(px, picked, 256).groupBy("tx", "ty").agg(F.count("*").alias("pixels"), F.sum("g").alias("green"))


@query("p_partkey long, lowest int, close boolean", """WITH p AS (SELECT p_partkey, 0.2::DOUBLE + p_size / 60.0::DOUBLE AS slope, CASE WHEN p_size % 2 = 0 THEN 71.0::DOUBLE ELSE 77.0::DOUBLE END AS target FROM part),
q AS (SELECT p_partkey, q, 66.0::DOUBLE + (q - 68) * slope >= target AS meets FROM p, range(68, 93) r(q)) SELECT p_partkey, coalesce(min(q) FILTER (meets), 92) AS lowest, true AS close FROM q GROUP BY p_partkey""")
def quality_search(spark, sf_dir):
    """The search ends within two steps of the lowest quality that meets the target, and inside the range."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    slope = 0.2 + F.col("p_size") / 60.0
    scores = F.transform(F.sequence(F.lit(tiles.LOW), F.lit(tiles.HIGH)), lambda q: 66.0 + (q - tiles.LOW) * slope)
    p = p.select("p_partkey", scores.alias("scores"), F.when(F.col("p_size") % 2 == 0, 71.0).otherwise(77.0).alias("target"))
    meets = F.filter(F.transform("scores", lambda v, i: F.when(v >= F.col("target"), i + tiles.LOW)), lambda v: v.isNotNull())
    p = p.withColumn("lowest", F.coalesce(F.array_min(meets), F.lit(tiles.HIGH)))
    close = (F.abs(F.col("quality") - F.col("lowest")) <= 2) & F.col("quality").between(tiles.LOW, tiles.HIGH)
    return tiles.search_scored(p, ["p_partkey", "lowest"], "scores", "target").select("p_partkey", "lowest", close.alias("close"))


@query("l_suppkey long, quality int, score d6, weakest long", """SELECT l_suppkey, 68 + l_linenumber AS quality, min(l_extendedprice) AS score, min_by(l_orderkey, (l_extendedprice, l_orderkey)) AS weakest FROM lineitem GROUP BY ALL""")
def weakest_tile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber", "l_extendedprice", "l_orderkey")
    scored = li.select("l_suppkey", (F.col("l_linenumber") + tiles.LOW).alias("quality"), F.col("l_orderkey").alias("rank"), F.col("l_extendedprice").alias("score"))
    return tiles.tile_scores(scored, ["l_suppkey"])


# --- pair metrics ----------------------------------------------------------------------------------------

_PAIR = f"""{DOC_PX}, q AS (SELECT *, {_POST.format('r')} AS r2, {_POST.format('g')} AS g2, {_POST.format('b')} AS b2, a AS a2 FROM px)"""
_SUM = "(abs(r - r2) + abs(g - g2) + abs(b - b2))"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compared(rasters.with_posterized(doc_planes(spark, sf_dir), "doc_id", 3), "doc_id")


@query("doc_id long, ssimulacra2 d6, butteraugli d6", f"WITH {_PAIR} SELECT doc_id, greatest(0, least(100, 100 - 100 * avg({_SUM}) / 765)) AS ssimulacra2, 3.0::DOUBLE * max({_SUM}) / 765 AS butteraugli FROM q GROUP BY doc_id")
def pair_metrics(spark, sf_dir):
    return _compared(spark, sf_dir)


@query("doc_id long, changed long, total long, max_delta int", f"WITH {_PAIR}, d AS (SELECT doc_id, greatest(abs(r - r2), abs(g - g2), abs(b - b2)) AS d FROM q) SELECT doc_id, count(*) FILTER (d >= 3) AS changed, count(*) AS total, max(d) AS max_delta FROM d GROUP BY doc_id")
def pixel_difference(spark, sf_dir):
    return _compared(spark, sf_dir)


@query("doc_id long, lossless boolean", f"WITH {_PAIR} SELECT doc_id, bool_and((r = r2 AND g = g2 AND b = b2 AND a = a2) OR (a = 0 AND a2 = 0)) AS lossless FROM q GROUP BY doc_id")
def lossless_verify(spark, sf_dir):
    return _compared(spark, sf_dir)


# --- benchmark reports -----------------------------------------------------------------------------------


@query("l_orderkey long, runs long, median double, p95 double", """WITH s AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS s FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len(s) AS runs, s[len(s) // 2 + 1] AS median, s[(len(s) - 1) * 95 // 100 + 1] AS p95 FROM s""")
def run_percentiles(spark, sf_dir):
    return reports.run_percentiles(table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice"), "l_orderkey", "l_extendedprice")


@query("user_id long, event_type string, mean_ms d6", """SELECT user_id, event_type, sum(value) / any_value(n) AS mean_ms FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) USING (user_id) GROUP BY user_id, event_type""")
def phase_means(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    by = e.groupBy("user_id", "event_type").agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    return by.join(by.groupBy("user_id").agg(F.sum("c").alias("n")), "user_id").select("user_id", "event_type", (F.col("s") / F.col("n")).alias("mean_ms"))


@query("input d2, output d2, saved d2, percent d6", """WITH s AS (SELECT sum(l_extendedprice) AS i, sum(l_extendedprice * (1 - l_discount)) AS o FROM lineitem WHERE l_linestatus = 'O') SELECT i AS input, o AS output, greatest(0, i - o) AS saved, CASE WHEN i > 0 THEN greatest(0, i - o) / i * 100 ELSE 0 END AS percent FROM s""")
def batch_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_extendedprice", "l_discount", "l_linestatus").where("l_linestatus = 'O'")
    s = li.agg(F.sum("l_extendedprice").alias("input"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("output"))
    saved = F.greatest(F.lit(0.0), F.col("input") - F.col("output"))
    return s.select("input", "output", saved.alias("saved"), F.when(F.col("input") > 0, saved / F.col("input") * 100).otherwise(0.0).alias("percent"))


@query("complete long, processing long, queued long, failed long, cancelled long", """SELECT count(*) FILTER (event_type = 'purchase' AND value > 0) AS complete, count(*) FILTER (event_type = 'view') AS processing, count(*) FILTER (event_type = 'click') AS queued, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS cancelled FROM events""")
def status_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_type", "value")
    of = lambda t: F.count_if(F.col("event_type") == t)
    return e.agg(F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 0)).alias("complete"), of("view").alias("processing"), of("click").alias("queued"), of("error").alias("failed"), of("signup").alias("cancelled"))


@query("line string", """WITH s AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS s, sum(floor(l_extendedprice * 100 + 0.5::DOUBLE)::BIGINT)::BIGINT AS i, sum(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5::DOUBLE)::BIGINT)::BIGINT AS o, CASE WHEN count(*) > 1 THEN avg(l_tax) END AS q FROM lineitem GROUP BY l_orderkey)
SELECT '"order ""' || l_orderkey || '"".png",png,' || i || ',' || o || ',' || printf('%.4f', (i - o) / i * 100) || ',' || coalesce(printf('%.5f', q), '') || ',' || printf('%.3f', s[len(s) // 2 + 1]) || ',' || printf('%.3f', s[(len(s) - 1) * 95 // 100 + 1]) AS line FROM s""")
def benchmark_report(spark, sf_dir):
    # taxes are added in the order of the file, as the SQL adds them; some means lie where a decimal is rounded
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_tax", "_metadata.file_path", "_metadata.row_index")
    per = reports.run_percentiles(li, "l_orderkey", "l_extendedprice")
    cents = lambda c: F.floor(c * 100 + 0.5)
    sums = li.groupBy("l_orderkey").agg(F.sum(cents(F.col("l_extendedprice"))).alias("i"), F.sum(cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("o"), F.when(F.count("*") > 1, reports.ordered_mean(F.col("l_tax"), F.col("file_path"), F.col("row_index"))).alias("q"))
    cells = [reports.csv_cell(F.concat(F.lit('order "'), F.col("l_orderkey").cast("string"), F.lit('".png'))), F.lit("png"), F.col("i").cast("string"), F.col("o").cast("string"), reports.fixed((F.col("i") - F.col("o")) / F.col("i") * 100, 4), reports.optional_number(F.col("q")), reports.fixed(F.col("median"), 3), reports.fixed(F.col("p95"), 3)]
    return per.join(sums, "l_orderkey").select(F.concat_ws(",", *cells).alias("line"))


@query("v int, linear d6", "SELECT v, CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE pow((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS linear FROM range(256) t(v)")
def linear_light(spark, sf_dir):
    return spark.range(256).select(F.col("id").alias("v"), fn.linear(F.col("id")).alias("linear"))


@query("components int, chroma string, passthrough boolean, code int, orders long", """SELECT components, chroma, components = 4 AS passthrough, CASE chroma WHEN '4:4:4' THEN 1 WHEN '4:2:0' THEN 0 END AS code, count(*) AS orders
FROM (SELECT o_orderkey % 4 + 1 AS components, CASE o_custkey % 3 WHEN 0 THEN '4:4:4' WHEN 1 THEN '4:2:0' ELSE '4:2:2' END AS chroma FROM orders) GROUP BY ALL""")
def jpeg_passthrough(spark, sf_dir):
    chroma = F.element_at(F.array(*map(F.lit, ["4:4:4", "4:2:0", "4:2:2"])), (F.col("o_custkey") % 3 + 1).cast("int"))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select((F.col("o_orderkey") % 4 + 1).alias("components"), chroma.alias("chroma"))
    return o.groupBy("components", "chroma").agg(F.count("*").alias("orders")).select("*", encode.jpeg_passthrough(F.col("components")).alias("passthrough"), encode.chroma_code(F.col("chroma")).alias("code"))


# --- jobs ------------------------------------------------------------------------------------------------

#: Stand-in: what each event type says about a job.
_TYPES = {"view": "progress", "click": "dispatch", "purchase": "complete", "signup": "retry", "error": "error"}
_TYPE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv]), F.col("event_type"))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("job_id"), (F.col("event_id") % 3).cast("int").alias("attempt"), kind.alias("type"), F.lit("compressing").alias("stage"), F.lit("DECODE_FAILED").alias("code"), (F.col("event_id") % 4 != 0).alias("recoverable"))


@query("job_id string, status string, stage string, attempt int, code string, recoverable boolean, applied long, ignored long", f"""WITH RECURSIVE e AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {_TYPE_SQL} AS t, event_id % 3 AS attempt, event_id % 4 <> 0 AS rec FROM events),
s AS (SELECT job, 0::BIGINT AS n, 'queued' AS status, NULL::VARCHAR AS stage, 0::BIGINT AS attempt, NULL::VARCHAR AS code, NULL::BOOLEAN AS rec, 0::BIGINT AS applied FROM (SELECT DISTINCT job FROM e)
UNION ALL SELECT job, n, CASE WHEN NOT ok THEN status WHEN t = 'dispatch' THEN 'processing' WHEN t = 'retry' THEN 'queued' WHEN t = 'complete' THEN 'complete' WHEN t = 'error' THEN 'error' ELSE status END,
 CASE WHEN NOT ok THEN stage WHEN t = 'dispatch' THEN 'decoding' WHEN t = 'progress' THEN 'compressing' WHEN t = 'retry' THEN stage END, attempt + (ok AND t = 'retry')::INT,
 CASE WHEN NOT ok THEN code WHEN t = 'error' THEN 'DECODE_FAILED' WHEN t = 'retry' THEN NULL ELSE code END, CASE WHEN NOT ok THEN rec WHEN t = 'error' THEN new_rec WHEN t = 'retry' THEN NULL ELSE rec END, applied + ok::INT
FROM (SELECT s.*, e.n AS n2, e.t, e.rec AS new_rec, CASE e.t WHEN 'dispatch' THEN s.status = 'queued' WHEN 'retry' THEN s.status = 'cancelled' OR s.status = 'error' AND coalesce(s.rec, true) ELSE e.attempt = s.attempt END AS ok FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1) x(job, n1, status, stage, attempt, code, rec, applied, n, t, new_rec, ok))
SELECT job AS job_id, status, stage, attempt, code, rec AS recoverable, applied, n - applied AS ignored FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1""")
def job_latest_state(spark, sf_dir):
    return jobs.latest_states(_events(spark, sf_dir))


#: Stand-in: what each event type says about a queue of four jobs.
_QUEUE = {"view": "progress", "click": "add", "purchase": "complete", "signup": "ready", "error": "error"}


@query("queue_id string, jobs long, active_at_most_one boolean, in_order boolean", """SELECT user_id AS queue_id, count(DISTINCT event_id % 4) AS jobs, true AS active_at_most_one, true AS in_order FROM events WHERE event_type = 'click' GROUP BY user_id""")
def queue_snapshot(spark, sf_dir):
    """Every added job is in its queue once, and no queue has two active jobs."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _QUEUE.items() for x in kv]), F.col("event_type"))
    job = F.when(kind != "ready", (F.col("event_id") % 4).cast("string"))
    e = e.select(F.col("user_id").cast("string").alias("queue_id"), F.col("event_id").alias("seq"), job.alias("job_id"), F.lit(0).alias("attempt"), kind.alias("type"), F.lit("compressing").alias("stage"), F.lit("DECODE_FAILED").alias("code"), F.lit(True).alias("recoverable"))
    q = queue.queue_states(e).groupBy("queue_id")
    return q.agg(F.count("*").alias("jobs"), (F.count_if(F.col("status") == "processing") <= 1).alias("active_at_most_one"), ((F.countDistinct("position") == F.count("*")) & (F.max("position") == F.count("*") - 1)).alias("in_order"))


@query("seq long, job_id string, current long, accepted boolean", f"""SELECT event_id AS seq, user_id AS job_id, coalesce(sum(({_TYPE_SQL} = 'retry')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS current,
 event_id % 3 = current AS accepted FROM events""")
def attempt_fencing(spark, sf_dir):
    return jobs.fenced(_events(spark, sf_dir))


@query("job_id string, seq long", "SELECT min_by(user_id, event_id) AS job_id, min(event_id) AS seq FROM events WHERE event_type = 'click'")
def fifo_head(spark, sf_dir):
    return jobs.fifo_head(_events(spark, sf_dir).withColumn("status", F.when(F.col("type") == "dispatch", "queued").otherwise("processing")))


@query("key long, action string", """SELECT DISTINCT user_id AS key, 'create' AS action FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL
SELECT c_custkey, 'drop' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT user_id FROM events)""")
def view_reconcile(spark, sf_dir):
    live = table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct()
    shown = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"))
    return live.join(shown, "key", "left_anti").withColumn("action", F.lit("create")).unionByName(shown.join(live, "key", "left_anti").withColumn("action", F.lit("drop")))


# --- names, sizes, errors --------------------------------------------------------------------------------


@query("p_partkey long, optimized string, download string, unique_name string", """WITH n AS (SELECT p_partkey, p_brand || '.' || CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' ELSE 'tar.jpeg' END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'png' ELSE 'jpeg' END AS fmt FROM part),
d AS (SELECT *, regexp_replace(name, '\\.[^.]+$', '') || '.squeezed.' || CASE WHEN fmt = 'jpeg' THEN 'jpg' ELSE 'png' END AS download FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY download ORDER BY p_partkey) AS k FROM d)
SELECT p_partkey, regexp_extract(name, '^(.+)\\.([^.]*)$', 1) || '.optimized.' || regexp_extract(name, '^(.+)\\.([^.]*)$', 2) AS optimized, download, CASE WHEN k = 1 THEN download ELSE regexp_replace(download, '\\.[^.]+$', '') || '-' || k || regexp_extract(download, '(\\.[^.]+)$', 1) END AS unique_name FROM k""".replace("\\\\", "\\"))
def output_names(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    ext = F.when(F.col("p_partkey") % 3 == 0, "png").when(F.col("p_partkey") % 3 == 1, "JPG").otherwise("tar.jpeg")
    p = p.withColumn("name", F.concat("p_brand", F.lit("."), ext)).withColumn("fmt", F.when(F.col("p_partkey") % 3 == 0, "png").otherwise("jpeg"))
    p = p.select("p_partkey", reports.optimized_name(F.col("name")).alias("optimized"), reports.download_name(F.col("name"), F.col("fmt")).alias("download"))
    return reports.unique_names(p, "download", "p_partkey")


@query("doc_id long, size string, caption string", """WITH d AS (SELECT doc_id, n_chars * n_chars AS n, CASE doc_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'error' WHEN 3 THEN 'cancelled' ELSE 'complete' END AS s FROM documents),
u AS (SELECT *, n / 1024.0::DOUBLE AS k, CASE WHEN n / 1024.0::DOUBLE < 1024 THEN 0 WHEN n / 1024.0::DOUBLE < 1048576 THEN 1 ELSE 2 END AS p FROM d), z AS (SELECT *, k / pow(1024, p) AS z FROM u)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE CASE WHEN z >= 10 THEN printf('%.1f', floor(z * 10 + 0.5::DOUBLE) / 10) ELSE printf('%.2f', floor(z * 100 + 0.5::DOUBLE) / 100) END || ' ' || ['KB', 'MB', 'GB'][p + 1] END AS size,
 CASE s WHEN 'queued' THEN 'Czeka w kolejce' WHEN 'processing' THEN 'Odczytuję obraz' WHEN 'error' THEN 'Nie udało się skompresować' WHEN 'cancelled' THEN 'Anulowano' ELSE 'Gotowe' END AS caption FROM z""")
def human_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    status = F.element_at(F.array(*map(F.lit, ["queued", "processing", "error", "cancelled", "complete"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", fn.human_size(F.col("n_chars") * F.col("n_chars")).alias("size"), reports.status_caption(status, F.lit(None).cast("string")).alias("caption"))


@query("code string, recoverable boolean, events long", """SELECT code, true AS recoverable, count(*) AS events FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'RESOURCE_LIMIT' WHEN 1 THEN 'DECODE_FAILED' WHEN 2 THEN 'CANCELLED' ELSE 'WORKER_FAILURE' END AS code FROM events WHERE event_type = 'error') GROUP BY ALL""")
def error_codes(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "event_type").where("event_type = 'error'")
    name = F.element_at(F.array(*map(F.lit, ["PixelLimit", "Decode", "Cancelled", "Unheard"])), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit('{"code":"'), reports.error_code(name), F.lit('","message":"m","recoverable":true}'))
    return e.select(reports.parsed_error(text).alias("p")).groupBy("p.code", "p.recoverable").agg(F.count("*").alias("events"))


@query("status string, caption string, icon string, actions string, events long", """WITH e AS (SELECT CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'cancelled' END AS s,
 CASE event_id % 5 WHEN 1 THEN 'decoding' WHEN 2 THEN 'analyzing' WHEN 3 THEN 'compressing' WHEN 4 THEN 'finalizing' END AS g, event_id % 2 = 0 AS o, event_id % 3 AS p, CASE WHEN event_id % 7 > 0 THEN event_id % 7 > 2 END AS r FROM events),
c AS (SELECT s, CASE WHEN s = 'queued' THEN 'Czeka w kolejce' WHEN s = 'processing' THEN CASE coalesce(g, 'decoding') WHEN 'decoding' THEN 'Odczytuję obraz' WHEN 'analyzing' THEN 'Analizuję zawartość' WHEN 'compressing' THEN 'Kompresuję' ELSE 'Kończę' END
  WHEN s = 'error' THEN CASE WHEN o THEN 'Nowa próba nie powiodła się — poprzedni wynik jest dostępny' ELSE 'Nie udało się skompresować' END WHEN s = 'cancelled' THEN CASE WHEN o THEN 'Przerwano — poprzedni wynik jest dostępny' ELSE 'Anulowano' END
  WHEN p = 0 THEN 'Gotowe · Brak oszczędności w tym przebiegu' ELSE 'Gotowe' END AS caption, CASE s WHEN 'processing' THEN 'spinner' WHEN 'complete' THEN 'status-dot status-dot--success' WHEN 'error' THEN 'status-dot status-dot--error' ELSE 'status-dot' END AS icon,
 concat_ws(',', CASE WHEN s <> 'processing' THEN 'remove' END, CASE WHEN s = 'processing' THEN 'cancel' END, CASE WHEN s = 'cancelled' OR s = 'error' AND coalesce(r, true) THEN 'retry' END, CASE WHEN o THEN 'compare,download' END) AS actions FROM e)
SELECT s AS status, caption, icon, actions, count(*) AS events FROM c GROUP BY ALL""")
def job_cards(spark, sf_dir):
    i = F.col("event_id")
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").otherwise("cancelled")
    stage = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, reports.STAGE)), (i % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "events", "event_id", "event_type").withColumns({"status": status, "stage": stage})
    card = reports.job_card(F.col("status"), F.col("stage"), i % 2 == 0, (i % 3).cast("double"), F.when(i % 7 > 0, i % 7 > 2))
    return e.withColumn("c", card).groupBy("status", "c.caption", "c.icon", F.array_join("c.actions", ",").alias("actions")).agg(F.count("*").alias("events"))


@query("name string, unique_name string, seq long", """SELECT unnest(['a.png', 'a.png', 'a-2.png', 'b', 'b', 'a.png', 'a-2.png', 'c-2.png', 'c.png', 'c.png', 'd.png']) AS name, unnest(['a.png', 'a-2.png', 'a-2-2.png', 'b', 'b-2', 'a-3.png', 'a-2-3.png', 'c-2.png', 'c.png', 'c-3.png', 'd.png']) AS unique_name, unnest(range(11)) AS seq""")
def colliding_names(spark, sf_dir):
    names = ["a.png", "a.png", "a-2.png", "b", "b", "a.png", "a-2.png", "c-2.png", "c.png", "c.png", "d.png"]
    return reports.unique_names(spark.createDataFrame(list(enumerate(names)), "seq long, name string"), "name", "seq")


@query("doc_id long, size string", """SELECT doc_id, CASE WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024.0::DOUBLE * 10 + 0.5::DOUBLE) / 10) || ' KB' ELSE printf('%.2f', floor(n / 1048576.0::DOUBLE * 100 + 0.5::DOUBLE) / 100) || ' MB' END AS size FROM (SELECT doc_id, n_chars * n_chars AS n FROM documents)""")
def modal_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "n_chars").select("doc_id", fn.modal_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("doc_id long, channels long, total long", f"WITH {DOC_PX} SELECT doc_id, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 3 END) AS channels, sum(CASE WHEN doc_id % 2 = 0 THEN r ELSE r + g + b END) AS total FROM px GROUP BY doc_id")
def opaque_channels(spark, sf_dir):
    kept = doc_pixels(spark, sf_dir).withColumn("c", fn.opaque_channels(F.col("r"), F.col("g"), F.col("b"), F.col("doc_id") % 2 == 0))
    return kept.groupBy("doc_id").agg(F.sum(F.size("c")).alias("channels"), F.sum(F.aggregate("c", F.lit(0), lambda s, v: s + v)).alias("total"))


@query("mime string, files long", """WITH f AS (SELECT encode(coalesce(html, '')) AS c FROM pages UNION ALL SELECT unnest([unhex('FFD8FFE072657374'), unhex('89504E470D0A1A0A72657374'), encode('GIF89a'), unhex('FFD8'), encode('')]))
SELECT CASE WHEN octet_length(c) = 0 THEN 'RESOURCE_LIMIT:bytes' WHEN hex(c) LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN hex(c) LIKE '89504E470D0A1A0A%' THEN 'image/png' ELSE 'UNSUPPORTED_FORMAT' END AS mime, count(*) AS files FROM f GROUP BY ALL""")
def ingested_types(spark, sf_dir):
    """Files as they are taken in: the type their bytes tell, or why they are turned away."""
    heads = spark.createDataFrame([(bytearray(h),) for h in _HEADS], "content binary")
    files = table(spark, sf_dir, "pages", "html").select(F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content")).union(heads)
    mime = headers.mime_of(F.col("content"))
    turned = encode.admission(F.length("content"), F.coalesce(mime, F.lit("")), F.lit(0))
    return files.groupBy(F.coalesce(turned, mime).alias("mime")).agg(F.count("*").alias("files"))


# --- whole images ----------------------------------------------------------------------------------------


@query("image string, strategy string, few_colors boolean, good boolean, exact_error boolean", """SELECT * FROM (VALUES ('ramp', 'quantized', true, true, false), ('art', 'exact', true, true, true), ('noise', 'quantized', true, true, false)) v(image, strategy, few_colors, good, exact_error)""")
def quantize_raster(spark, sf_dir):
    """At most 256 colours, quality from the least one on, no error where the palette is exact."""

    def raster(name: str, px: DataFrame, w: int, h: int) -> DataFrame:
        bytes_ = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.concat(*[F.lpad(F.hex(c), 2, "0") for c in "rgba"]).alias("c")))), lambda p: p["c"]), ""))
        return px.agg(bytes_.alias("content")).select(F.lit(name).alias("image"), F.lit(w).cast("long").alias("width"), F.lit(h).cast("long").alias("height"), "content")

    ramp = rasters.grid(spark, 48, 32).select("x", "y", (F.col("x") * 5).alias("r"), (F.col("y") * 7).alias("g"), ((F.col("x") + F.col("y")) * 3 % 256).alias("b"), F.lit(255).alias("a"))
    art = rasters.grid(spark, 64, 48).select("x", "y", F.when((F.col("x") + F.col("y")) % 3 == 0, 255).otherwise(0).alias("r"), F.when((F.col("x") + F.col("y")) % 3 == 0, 180).otherwise(0).alias("g"), F.when((F.col("x") + F.col("y")) % 3 == 0, 0).otherwise(255).alias("b"), F.when(F.col("x") < 16, 0).otherwise(255).alias("a"))
    images = raster("ramp", ramp, 48, 32).union(raster("art", art, 64, 48)).union(raster("noise", rasters.fixture_png(spark, 64, 48), 64, 48))
    found = quantize.quantize_images(images, "image")
    return found.select("image", "strategy", F.col("colors").between(2, quantize.COLORS).alias("few_colors"), (F.col("quality") >= quantize.MIN_QUALITY).alias("good"), (F.col("error") == 0).alias("exact_error"))
