"""Base spans against the stated expressions, and verdicts against plain counting."""

import random
import re

from editpulse.llm import secret_scan as ss

PATTERNS = {
    "assign": (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}


def brute(text):
    out = []
    for order, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_base_equals_expressions():
    random.seed(3)
    parts = ["token", "PassWd", "Key", "api_Key", "API", "key", " ", "=", ":", '"', "'", "a1b2c3d4e5f6", "0" * 9, "AKIA", "ZZ99ZZ99", "x", "é", "\n", "-", "secret", "ſecret"]
    for _ in range(20_000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert [tuple(s)[:3] for s in ss.base_spans(text)] == brute(text), repr(text)
    for long in ("a" * 300_000, "token " * 60_000, "token" + " " * 300_000, "A1" * 150_000):
        base = ss.base_spans(long)
        list(ss.proposed_spans(long, base))


def test_ownership(spark):
    random.seed(5)
    def value():
        return "".join(random.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(32))
    shared, few, own = value(), value(), value()
    rows = [(i, f"see {shared} and token={'%032x' % (77 << 100)}", f"s{i % 6}", "en") for i in range(40)]
    rows += [(100, f"use {few} é", "s1", "en"), (101, f"use {few}", "s2", None), (102, f"mine {own} {own}", None, None), (102, f"mine {own} {own}", None, None)]
    rows += [(103, None, "s1", "en"), (104, "", "s1", "en"), (None, "password: changemechangeme1", "s9", "en")]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, lang string, found int, hash string").repartition(3)
    got = {r.row.doc_id: r for r in ss.find_secrets(frame).collect()}
    for d, text, _, _ in rows:
        assert [(s.kind, s.start, s.end) for s in got[d].base] == brute(text)
    assert {s.verdict for s in got[0].base} == {"example"} and len(got[0].spans) == len(got[0].base)
    assert [(s.kind, s.start, s.end, s.verdict) for s in got[100].spans] == [("token", 4, 36, "live")]
    assert [s.kind for s in got[102].spans] == ["token", "token"]
    assert not got[103].spans and not got[104].spans
    assert [(s.kind, s.verdict) for s in got[None].spans] == [("assign", "weak")]
    assert len(ss.find_secrets(frame).collect()) == len(rows)
    assert ss.find_secrets(frame.limit(0)).collect() == []
