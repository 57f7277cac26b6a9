"""Revisit resolution against DuckDB and a plain loop."""
import random

from compare import compare

from veilframe.llm import revisits
from veilframe.llm.registry import CHECKS, QUERIES

SCHEMA = ("record_id bigint, url string, ts bigint, kind string, headers map<string,string>, body_sha256 string, body_length bigint, "
          "full string, latest string, base_id string")


def test_same_as_sql(spark, folder, duck):
    assert compare(spark, duck, folder, QUERIES["op2_warc_revisits"], CHECKS["op2_warc_revisits"]) is None


def frame(spark, rows):
    return spark.createDataFrame([(i, u, t, k, h, s, n, "x", "y", "z") for i, u, t, k, h, s, n in rows], SCHEMA)


def test_like_a_loop_on_hot_urls(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        url = f"http://a.example/{rng.choice([0, 0, 0, rng.randrange(300)])}"
        full = rng.random() < 0.3
        tag = rng.choice(['"1"', 'W/"1"', '"2"', None])
        rows.append((i, url, rng.randrange(900), "response" if full else "revisit", {"ETag": tag} if tag else None, f"s{i}" if full else None, i if full else None))
    got = {r.record_id: r for r in revisits.resolve(frame(spark, rows)).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for i, url, ts, kind, headers, _, _ in rows:
        if kind == "response":
            continue
        before = [(r[2], r[0], r) for r in rows if r[3] == "response" and r[1] == url and r[2] < ts]
        base = max(before)[2] if before else None
        tag = (headers or {}).get("ETag")
        stored = ((base or [None] * 5)[4] or {}).get("ETag")
        want = "orphan" if base is None else "unchecked" if tag is None or stored is None else (
            "etag" if tag.removeprefix("W/") == stored.removeprefix("W/") else "mismatch")
        assert got[i].outcome == want
        good = want in ("etag", "unchecked")
        assert (got[i].base_id, got[i].body_sha256) == ((base[0], base[5]) if good else (None, None))


def test_headers_and_urls(spark):
    rows = [
        (1, "https://www.Example.com:443/a/?b=2&utm_source=x&a=1#top", 10, "response",
         {"ETag": '"e"', "Content-Type": "text/html", "X-Old": "1", "Cache-Control": "old"}, "sha", 7),
        (2, "http://example.com/a?a=1&b=2", 20, "revisit",
         {"etag": 'W/"e"', "cache-control": "new", "Content-Type": "no", "CONTENT-LENGTH": "0", "Connection": "close", "Warning": "w", "warning": "v"}, None, None),
        (2, "http://example.com/a?a=1&b=2", 20, "revisit",
         {"etag": 'W/"e"', "cache-control": "new", "Content-Type": "no", "CONTENT-LENGTH": "0", "Connection": "close", "Warning": "w", "warning": "v"}, None, None),
        (3, None, 30, "revisit", None, None, None), (4, "http://other.example/", None, "revisit", None, None, None),
        (5, "http://example.com/a?a=1&b=2", 10, "revisit", None, None, None), (6, "http://new.example/" + "x" * 50_000, 5, "response", None, "s", 0),
        (7, "http://new.example/" + "x" * 50_000, 6, "revisit", {}, None, None), (None, "http://new.example/" + "x" * 50_000, 6, "revisit", {}, None, None),
    ]
    got = revisits.resolve(frame(spark, rows)).collect()
    assert len(got) == 7
    by_id = {r.record_id: r for r in got}
    assert by_id[2].canonical == "example.com/a?a=1&b=2" and by_id[2].outcome == "etag" and sum(r.record_id == 2 for r in got) == 2
    assert by_id[2].headers == {"etag": 'W/"e"', "content-type": "text/html", "x-old": "1", "cache-control": "new", "warning": "w"}
    assert by_id[3].outcome == by_id[4].outcome == by_id[5].outcome == "orphan"
    assert by_id[7].outcome == "unchecked" and by_id[7].base_id == 6 and by_id[7].headers == {}
    assert revisits.resolve(frame(spark, rows).limit(0)).count() == 0


def test_repeated_record_ids(spark):
    """One record_id on several URLs and times, repeated rows: one row per revisit, each by its own URL."""
    rng = random.Random(6)
    rows = []
    for _ in range(1500):
        full = rng.random() < 0.5
        url, tag = f"http://a.example/{rng.randrange(6)}", rng.choice(['"1"', '"2"', None])
        rows.append((rng.choice([None, *range(8)]), url, rng.choice([None, *range(40)]), "response" if full else "revisit",
                     {"ETag": tag} if tag else None, rng.choice("ab") if full else None, 1 if full else None))
    rows += rng.sample(rows, 200)
    got = sorted(((r.record_id, r.canonical, r.ts, r.outcome, r.base_id, r.body_sha256) for r in revisits.resolve(frame(spark, rows)).collect()), key=repr)
    early = lambda t: -1 if t is None else t
    want = []
    for i, url, ts, kind, headers, _, _ in rows:
        if kind == "response":
            continue
        before = [r for r in rows if r[3] == "response" and r[1] == url and r[0] is not None and early(r[2]) < early(ts)]
        base = max(before, key=lambda r: (early(r[2]), r[0], r[5], repr(r[4]) if r[4] else ""), default=None) if i is not None else None
        a, b = (headers or {}).get("ETag"), ((base or [None] * 5)[4] or {}).get("ETag")
        outcome = "orphan" if base is None else "unchecked" if a is None or b is None else "etag" if a == b else "mismatch"
        good = outcome in ("etag", "unchecked")
        want.append((i, url.removeprefix("http://"), ts, outcome, base[0] if good else None, base[5] if good else None))
    assert got == sorted(want, key=repr)
