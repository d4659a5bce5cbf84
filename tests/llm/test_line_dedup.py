"""Common lines against plain dictionaries."""

import random

from editpulse.llm.line_dedup import drop_common_lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    def key(line):
        return line.strip(WHITE).translate(LOWER)

    holders = {}
    for d, text in rows:
        if d is not None:
            for line in (text or "").split("\n"):
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(key(line), set())
            common = len(key(line)) >= 20 and len(held) >= 3
            if not common or d == max(held):
                kept.append(line)
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_dictionaries(spark):
    random.seed(2)
    pool = [f"a line of some length number {i} É" for i in range(12)] + ["short", "", " ", "x" * 19, "y" * 20, "é" * 19, "é" * 20]
    rows = []
    for d in range(80):
        lines = [random.choice(pool + [f"only here {d} {k} and nowhere else"]) for k in range(random.randint(0, 9))]
        lines = [random.choice(["", "  ", "\t"]) + random.choice([x, x.upper() if x.isascii() else x]) + random.choice(["", " \r", "\x0b"]) for x in lines]
        rows.append((d, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, "\n".join(pool)), (79, "\n".join(pool)), rows[3]]
    frame = spark.createDataFrame([(d, t, "z", 3) for d, t in rows], "doc_id long, text string, lines string, n_lines int").repartition(4)
    got = [(r.row.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in drop_common_lines(frame).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert drop_common_lines(frame.limit(0)).collect() == []
