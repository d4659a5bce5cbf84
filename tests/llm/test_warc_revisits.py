"""Resolved revisits against a plain search backwards in time."""

import random
from datetime import datetime, timedelta

from editpulse.llm import warc_revisits as wr

SCHEMA = "record_id long, url string, ts timestamp, revisit boolean, etag string, last_modified string, headers map<string,string>, payload_sha256 string, slice int, r string"


def brute(rows, canonical):
    def fields(h):
        out = {}
        for name, value in sorted((k.lower(), v or "") for k, v in (h or {}).items()):
            out[name] = value
        return out

    def tag(x):
        return None if x is None else x.strip().removeprefix("W/")

    out = []
    for i, url, ts, revisit, etag, modified, headers, sha in rows:
        if not revisit:
            out.append((i, "full", i, sha, sorted(fields(headers).items())))
            continue
        earlier = [r for r in rows if not r[3] and r[2] is not None and ts is not None and canonical[r[1]] is not None and canonical[r[1]] == canonical[url] and (r[2], r[0]) < (ts, i)]
        best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        if best is None:
            out.append((i, "no_earlier_response", None, None, None))
            continue
        if tag(etag) is not None and tag(best[4]) is not None:
            outcome = "resolved" if tag(etag) == tag(best[4]) else "validator_mismatch"
        elif modified is not None and best[5] is not None:
            outcome = "resolved" if modified == best[5] else "validator_mismatch"
        else:
            outcome = "no_validator"
        merged = fields(best[6]) | {k: v for k, v in fields(headers).items() if k not in wr.NOT_MERGED}
        good = outcome == "resolved"
        out.append((i, outcome, best[0], best[7] if good else None, sorted(merged.items()) if good else None))
    return sorted(out, key=str)


def test_equals_search(spark, monkeypatch):
    random.seed(12)
    start = datetime(2024, 1, 1)
    urls = ["http://A.example.com:80/x?b=2&a=1#f", "http://a.EXAMPLE.com/x?a=1&b=2", "https://u@b.org", "https://b.org/", "HTTPS://b.org:443#z", "https://b.org:8443/", None, "no url#x", ""]
    rows = []
    for i in range(500):
        url = urls[0] if random.random() < 0.4 else random.choice(urls)
        ts = None if random.random() < 0.03 else start + timedelta(minutes=random.randint(0, 400))
        tag = random.choice([None, '"a"', 'W/"a"', '"b"'])
        headers = random.choice([None, {"Date": str(i), "Content-Length": "0", "X": None}, {"ETAG": "q", "date": "y", "Via": "z"}])
        rows.append((i, url, ts, random.choice([True, True, False]), tag, random.choice([None, "m", "n"]), headers, f"sha{i}"))
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    canonical = {r.url: r.c for r in frame.select("url", wr.canonical_url("url").alias("c")).distinct().collect()}
    assert canonical[urls[0]] == canonical[urls[1]] == "http://a.example.com/x?a=1&b=2" and canonical[urls[2]] == canonical[urls[3]] == canonical[urls[4]] == "https://b.org/"
    assert canonical[urls[5]] == "https://b.org:8443/" and canonical["no url#x"] == "no url"

    def got():
        return sorted(((r.record_id, r.outcome, r.response_id, r.payload_sha256, None if r.fields is None else [tuple(x) for x in r.fields]) for r in wr.resolve_revisits(frame).collect()), key=str)

    expected = brute(rows, canonical)
    assert got() == expected
    monkeypatch.setattr(wr, "SLICED_CAPTURES", 20)
    assert got() == expected
    assert {x[1] for x in expected} == {"full", "resolved", "no_earlier_response", "validator_mismatch", "no_validator"}
    assert wr.resolve_revisits(frame.limit(0)).collect() == []


def test_pages_without_or_with_negative_id_are_captured(spark):
    pages = spark.createDataFrame([(None, "http://a.example.org/", "x"), (-3, "http://b.example.org/", "y"), (8, None, None)], "page_id long, url string, html string")
    captures = wr.captures_of_pages(pages)
    assert captures.groupBy("url").count().orderBy("url").collect()[0]["count"] == 1
    rows = sorted(((r.record_id, r.outcome) for r in wr.resolve_revisits(captures).collect()), key=str)
    assert [r for r in rows if r[0] is None] == [(None, "full")]
    assert len(rows) == captures.count() == 1 + 2 + 1  # -3 has the remainder 1
