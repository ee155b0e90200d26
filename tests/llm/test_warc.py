import random

from rasterloom.llm.warc import PERMITTED, canonical_url, resolve_revisits

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload_digest string, bucket int, o string"


def test_canonical_url(spark):
    cases = {
        "http://WWW.Ex.org:80/a/?utm_x=1&b=2&a=1#f": "ex.org/a?a=1&b=2",
        "https://ex.org/a/": "ex.org/a",
        "ex.org": "ex.org",
        "http://ex.org?ref=q": "ex.org",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert [r[0] for r in df.select(canonical_url(df.u)).collect()] == list(cases.values())


def brute(rows):
    out = []
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    weak = lambda e: e if e is None else e.removeprefix("W/")
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [x for x in rows if x[3] == "response" and x[1] == r[1] is not None and None not in (x[2], r[2]) and (x[2], x[0]) < (r[2], r[0])]
        o = max(before, key=lambda x: (x[2], x[0]), default=None)
        if o is None:
            status = "no_original"
        elif r[4] is not None and o[4] is not None:
            status = "resolved" if weak(r[4]) == weak(o[4]) else "mismatch"
        elif r[5] is not None and o[5] is not None:
            status = "resolved" if r[5] == o[5] else "mismatch"
        else:
            status = "unverified"
        ok = status == "resolved"
        headers = low(o[6]) | {k: v for k, v in low(r[6]).items() if k in PERMITTED} if ok else low(r[6])
        out.append((r[0], r[1], o and o[0], status, tuple(sorted(headers.items())), o[7] if ok else None))
    return sorted(out, key=str)


def test_matches_brute_force_with_hot_url_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        url = rng.choice(["x.org/hot"] * 4 + ["x.org/a", "x.org/b", None])
        ts = rng.choice([None, *[t // 2 for t in range(120)]])
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = rng.choice([None, {}, {"ETag": "1", "Set-Cookie": "s"}, {"Date": str(i), "etag": "2", "X": "y"}])
        rows.append((i, url, ts, kind, rng.choice(["a", "W/a", "b", None]), rng.choice(["m", "n", None]), headers, f"d{i}", 1, "o"))
    rows.append(rows[0])
    got = resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((*r[:4], tuple(sorted(r.headers.items())), r.payload_digest) for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
