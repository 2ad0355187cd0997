import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm.warc import PERMITTED, canonical_url, resolve_revisits, with_body

SCHEMA = "record_id string, url string, ts long, kind string, status int, headers map<string,string>, canonical string, slice int, body string"


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://WWW.Example.com:80/a/b/?b=2&a=1&utm_source=x#frag", "example.com/a/b?a=1&b=2"), ("https://u@example.com:443", "example.com"), ("example.com/x", "example.com/x"), ("http://a.b/?", "a.b"), ("", ""), (None, None), ("http://a.b:8080/A/", "a.b:8080/A")],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u")).alias("c")).first().c == want


def rows_of():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        url = None if i % 50 == 0 else f"http://h/{'hot' if rng.random() < 0.4 else rng.integers(6)}"
        ts = None if i % 41 == 0 else int(rng.integers(0, 120))
        revisit = rng.random() < 0.5
        headers = {}
        if rng.random() < 0.7:
            headers["ETag"] = ("W/" if revisit and rng.random() < 0.5 else "") + f'"{rng.integers(2)}"'
        if rng.random() < 0.5:
            headers["Last-Modified"] = f"day {rng.integers(2)}"
        headers |= {"Date": str(i), "Set-Cookie": str(i)}
        rows.append((f"r{i:03d}", url, ts, "revisit" if revisit else "response", 304 if revisit else int(rng.choice([200, 200, 404])), None if i % 37 == 0 else headers, "x", 1, f"body {i}"))
    return rows


def brute(rows):
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    out = []
    for i, url, ts, kind, _, headers, *_ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and r[4] == 200 and r[1] == url and None not in (url, ts, r[2]) and r[2] < ts]
        found, mine = max(before, key=lambda r: (r[2], r[0]), default=None), low(headers)
        theirs = low(found[5]) if found else {}
        tag = lambda h: h["etag"].removeprefix("W/") if "etag" in h else None
        same = tag(mine) == tag(theirs) if "etag" in mine else mine.get("last-modified") == theirs.get("last-modified")
        verdict = "no_response" if not found else "no_validator" if not {"etag", "last-modified"} & set(mine) else "resolved" if same else "mismatch"
        merged = sorted((theirs | {k: v for k, v in mine.items() if k in PERMITTED}).items()) if verdict == "resolved" else None
        out.append((i, verdict, found[0] if verdict == "resolved" else None, merged))
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 7])
def test_revisits_equal_brute_force(spark, slices):
    rows = rows_of()
    rows.append(next(r for r in rows if r[3] == "revisit" and r[2] is not None))
    records = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = [(r.record_id, r.verdict, r.refers_to, None if r.headers is None else [tuple(e) for e in r.headers]) for r in resolve_revisits(records, slices).collect()]
    assert sorted(found) == brute(rows)
    assert {v for _, v, *_ in found} == {"resolved", "mismatch", "no_validator", "no_response"}


def test_bodies_and_empty_tables(spark):
    records = spark.createDataFrame([("a", "u", 1, "response", 200, {"ETag": "1"}, "", 0, "the body"), ("b", "u", 2, "revisit", 304, {"ETag": "1"}, "", 0, None)], SCHEMA)
    assert with_body(resolve_revisits(records), records).select("record_id", "body").collect() == [("b", "the body")]
    assert resolve_revisits(records.where("false")).count() == 0
