"""Base spans against the stated expressions, and looser formats that the trees add."""

import random
import re

from editpulse.llm import pii, pii_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                double = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in double) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_base_equals_expressions():
    random.seed(6)
    parts = ["a", "@", ".", "1", "25", "255.", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-", "é", " ", "-", "x.y@b.c", "+", "0", "\n", "%", "٣"]
    for _ in range(20_000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert [tuple(s) for s in pii_spans.base_spans(text)] == brute(text), repr(text)
    for long in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 100_000, "+1 " * 60_000, "1 -" * 60_000):
        assert isinstance(pii_spans.base_spans(long), list) and isinstance(list(pii_spans.proposed_spans(long)), list)


def corpus():
    random.seed(1)
    def number(n):
        return "".join(random.choice("0123456789") for _ in range(n))
    def card():
        body = number(15)
        return next(body + d for d in "0123456789" if pii_spans.luhn(body + d))
    rows = []
    for i in range(400):
        name = "".join(random.choice("abcdefghij") for _ in range(random.randint(3, 9))) + random.choice(["", ".d", str(i)])
        a = random.choice([f"{name}@{random.choice(['mail', 'post2', 'x'])}.example.{random.choice(['com', 'org'])}", f"+1 ({number(3)}) 555-{number(4)}", card(), f"10.{i % 250}.3.{i % 200}"])
        rows.append((i, f"words {random.choice(['before', 'write to', 'call', 'it is', ''])} {a} and after", 0))
    rows += [(1000 + i, f"build {number(3)}/{number(5)} of {number(8)}a{number(9)} in v{i}.1.2.{900 + i}.7", 0) for i in range(300)]
    return rows + [(2000, "write to jo.doe [at] example.org soon", 1), (2001, None, 0), (2002, "", 0), (2003, "nothing here", 0), (None, "a@b.cd", 0), rows[3]]


def test_spans_of_a_corpus(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)
    got = pii.find_personal_data(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(s.kind, s.start, s.end) for s in r.base]
        assert base == brute(r.row.text)
        every = [(s.start, pii.KINDS.index(s.kind)) for s in r.spans]
        assert set(base) <= {(s.kind, s.start, s.end) for s in r.spans} and every == sorted(every)
    spelled = next(r for r in got if r.row.doc_id == 2000)
    assert [(s.kind, spelled.row.text[s.start : s.end]) for s in spelled.spans] == [("email", "jo.doe [at] example.org")]
    assert all(not r.spans for r in got if r.row.doc_id in (2001, 2002, 2003))
    assert sum(len(r.spans) > len(r.base) for r in got if 1000 <= (r.row.doc_id or 0) < 2000) <= 15
    assert pii.find_personal_data(frame.limit(0)).collect() == []


def test_thresholds_of_rare_kinds_beyond_the_sample(spark):
    rows = [(i, "phone", i % 2, [0.0, float(i % 2)]) for i in range(5000)] + [(9000 + i, "ip", 1, [1.0, 1.0]) for i in range(25)]
    examples = spark.createDataFrame(rows, "key long, kind string, role int, f array<double>")
    _, limits = pii.fit(examples, train_candidates=100)
    assert limits["phone"] <= 1 and limits["ip"] <= 1
