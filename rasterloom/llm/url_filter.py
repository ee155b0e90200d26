"""URL filtering by a path-template tree per host, in DataFrame operations only.

Rules with a host and a path prefix decide first, the longest one that fits. Every other page is judged by
the template that its path falls under. Digits are generalised at once. Then, level by level below each
host, a segment becomes a wildcard if its parent has many children and it holds few of their pages, or if
its labelled pages don't differ from its siblings' by a two-sided test. A template is rejected when its
labelled share of blocked pages, smoothed towards its host's and that towards the whole table's, is high.
The labels are the rules' verdicts and, where no rule fits, those of a column that the caller names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import staged
from .text import lower_ascii

#: A parent with more children than this has its small children generalised.
MOST_CHILDREN = 16
#: Standard errors within which a branch counts as similar to its siblings.
SIMILAR_Z = 2.0
#: Pages that the prior weighs, and the smoothed share from which a template is rejected.
PRIOR, REJECT = 4.0, 0.7

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule of (verdict, host, path) as struct(rule, verdict); null if none fits.

    The rules are a list that the caller writes, so they are compared in place; nothing is broadcast."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        inside = (host == h) | host.endswith(f".{h}")
        fits.append(F.when(inside & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], label: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages (page_id, url, ...).

    ``label`` names a column of ``block``, ``allow`` or null, which counts as evidence for its template where no
    rule fits; the verdict is still the rule's, else the template's. Other columns are ignored, whatever their
    names, and very long urls are judged whole.
    A null url, or one without ``://``, has an empty host and path; such pages form a host of their own.
    Repeated rows are judged alike and each counts as evidence; an empty table gives no rows.
    """
    host = lower_ascii(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), PATH, 1)
    own = F.lit(None).cast("string") if label is None else F.when(F.col(f"`{label}`").isin("block", "allow"), F.col(f"`{label}`"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"), own.alias("own"))
    shape = F.regexp_replace("path", "[0-9]+", "#")
    rows = rows.select(
        "*",
        rule_for(F.col("host"), F.col("path"), rules).alias("r"),
        F.regexp_replace(shape, "^/", "").alias("leaf"),
    ).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("by_rule"), F.coalesce("r.verdict", "own").alias("said"), "leaf")
    # segments that a short path lacks are empty up to the third
    rows = rows.withColumn("leaf", F.concat("leaf", F.repeat(F.lit("/"), F.greatest(F.lit(0), 3 - F.size(F.split("leaf", "/", -1))))))
    rows = staged(rows, "urls")
    leaf = ["host", "leaf"]
    tree = staged(
        rows.groupBy(*leaf).agg(F.count("*").alias("n"), F.count("said").alias("lab"), F.count_if(F.col("said") == "block").alias("bad")), "leaves"
    ).withColumns({"segments": F.split("leaf", "/", -1), "template": F.col("host")})
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    known, ended, i = ["host", "template"], None, 0
    while True:
        i += 1
        tree = tree.withColumn("s", F.element_at("segments", i))
        kids = tree.groupBy("template", "s").agg(*sums)
        top = kids.groupBy("template").agg(F.count("*").alias("kids"), *[F.sum(c).alias(f"p_{c}") for c in ("n", "lab", "bad")])
        p = (F.col("p_bad") + 0.5) / (F.col("p_lab") + 1.0)
        small = (F.col("kids") > MOST_CHILDREN) & (F.col("n") * MOST_CHILDREN < F.col("p_n"))
        z = F.abs(F.col("bad") / F.col("lab") - p) / F.sqrt(p * (1.0 - p) / F.col("lab"))
        alike = (F.col("lab") == 0) | (z < SIMILAR_Z)
        named = kids.join(top, "template").select("template", "s", F.when(small | alike, "*").otherwise(F.col("s")).alias("t"))
        tree = tree.join(named, ["template", "s"]).withColumn("template", F.concat_ws("/", "template", "t")).drop("s", "t")
        if i >= 3:
            tree = staged(tree, "templates")
            done = tree.where(F.size("segments") <= i)
            ended = done if ended is None else ended.union(done)
            tree = tree.where(F.size("segments") > i)
            if not tree.limit(1).count():
                break
    tree = ended
    every = tree.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"g_{c}") for c in ("lab", "bad")])
    hosts = tree.groupBy("host").agg(*[F.sum(c).alias(f"h_{c}") for c in ("lab", "bad")])
    prior = (F.col("h_bad") + PRIOR * (F.col("g_bad") + 1.0) / (F.col("g_lab") + 2.0)) / (F.col("h_lab") + PRIOR)
    hosts = hosts.crossJoin(F.broadcast(every)).select("host", prior.alias("prior"))  # one row of totals
    judged = tree.groupBy(*known).agg(F.sum("lab").alias("t_lab"), F.sum("bad").alias("t_bad")).join(hosts, "host")
    purity = (F.col("t_bad") + PRIOR * F.col("prior")) / (F.col("t_lab") + PRIOR)
    judged = judged.select(*known, purity.alias("purity"))
    by_leaf = tree.join(judged, known).select(*leaf, "template", "purity")
    verdict = F.coalesce("by_rule", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return rows.join(by_leaf, leaf).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _level(i: int, known: str, before: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in known.split(", "))
    return f"""
k{i} AS (SELECT {known}, s{i}, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM {before} GROUP BY {known}, s{i}),
p{i} AS (SELECT {known}, count(*) AS kids, sum(n) AS pn, (sum(bad) + 0.5::DOUBLE) / (sum(lab) + 1.0::DOUBLE) AS p FROM k{i} GROUP BY {known}),
m{i} AS (SELECT {', '.join('a.' + k for k in known.split(', '))}, s{i}, CASE WHEN (kids > {MOST_CHILDREN} AND n * {MOST_CHILDREN} < pn) OR lab = 0
         OR abs(bad::DOUBLE / lab - p) / sqrt(p * (1.0::DOUBLE - p) / lab) < {SIMILAR_Z} THEN '*' ELSE s{i} END AS t{i} FROM k{i} a JOIN p{i} b ON {on}),
l{i} AS (SELECT a.*, t{i} FROM {before} a JOIN m{i} b ON {on} AND a.s{i} = b.s{i}),"""


ORACLE = (
    r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(verdict, h, p)),
x AS (SELECT *, (SELECT max_by({'rule': h || p, 'verdict': verdict}, length(h || p)) FROM rules
                 WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM u),
y AS (SELECT page_id, host, path, r.rule AS rule, r.verdict AS by_rule, regexp_extract(shape, '^/?([^/]*)', 1) AS s1,
             regexp_extract(shape, '^/?[^/]*/([^/]*)', 1) AS s2, regexp_extract(shape, '(?s)^/?[^/]*/[^/]*/(.*)$', 1) AS s3 FROM x),
l0 AS (SELECT host, s1, s2, s3, count(*) AS n, count(by_rule) AS lab, count(*) FILTER (by_rule = 'block') AS bad FROM y GROUP BY ALL),"""
    + _level(1, "host", "l0") + _level(2, "host, t1", "l1") + _level(3, "host, t1, t2", "l2")
    + f"""
g AS (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(lab) + 2.0::DOUBLE) AS g FROM l3),
h AS (SELECT host, (sum(bad) + {PRIOR}::DOUBLE * any_value(g)) / (sum(lab) + {PRIOR}::DOUBLE) AS prior FROM l3, g GROUP BY host),
t AS (SELECT host, t1, t2, t3, (sum(bad) + {PRIOR}::DOUBLE * any_value(prior)) / (sum(lab) + {PRIOR}::DOUBLE) AS purity FROM l3 JOIN h USING (host) GROUP BY host, t1, t2, t3),
b AS (SELECT host, s1, s2, s3, host || '/' || t1 || '/' || t2 || '/' || t3 AS template, purity FROM l3 JOIN t USING (host, t1, t2, t3))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM y JOIN b USING (host, s1, s2, s3)"""
)
