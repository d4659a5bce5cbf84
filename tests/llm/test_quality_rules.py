"""Base counts against plain rules, and verdicts against a direct computation of the estimate."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from editpulse.llm import quality_rules as q
from editpulse.llm import words as w


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeat = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat),
    )


def test_counts_equal_plain_rules():
    random.seed(8)
    texts = [None, "", "\n", " a\n a\na", "x " * 9 + "y", "a b c d e a b c d e", "É#é <b>\r\n\x0b\n\x0b"]
    texts += [" ".join(random.choice(["a", "b\n", "É*", "\n\n", "c|"]) for _ in range(random.randint(0, 60))) for _ in range(300)]
    stats = q.text_statistics(w.text_bytes(pa.array(texts)))
    got = list(zip(*(stats[c].tolist() for c in q.COUNTS), strict=True))
    assert got == [base(t) for t in texts]
    assert all(np.isfinite(stats[c]).all() for c in q.STATISTICS)


def distances(rows):
    """The operator's distances computed directly on the rows of all cells, as a series."""
    names = list(q.STATISTICS)
    floors = np.diag(np.array(list(q.STATISTICS.values())) ** 2)
    lang, source = rows.lang.fillna("none"), rows.source.fillna("none")
    cells = {(0, x, y): (lang == x) & (source == y) for x, y in set(zip(lang, source, strict=True))}
    cells |= {(1, x, ""): lang == x for x in set(lang)} | {(2, "", ""): lang == lang}
    cells = {c: rows[at] for c, at in cells.items()}

    def quartile(x, share):
        return np.array([np.sort(np.floor(c * 256))[int(np.ceil(share * len(c))) - 1] + 0.5 for c in x.T]) / 256

    def shrunk(own):
        out = {}
        for level, x, y in own:
            every = own[2, "", ""]
            now = q.towards(every, len(rows), (every[0], floors))
            for at in ([(1, x, "")] if level < 2 else []) + ([(0, x, y)] if level < 1 else []):
                now = q.towards(own[at], len(cells[at]), now)
            out[level, x, y] = now
        return out

    def far(part, model):
        d = part[names].to_numpy() - model[0]
        n = part.n_words.to_numpy()
        return n / (n + 30) * np.einsum("ij,jk,ik->i", d, np.linalg.inv(model[1] + floors), d)

    def step(own, subset=q.SUBSET, reweight=False):
        out = {}
        for cell, model in shrunk(own).items():
            part = cells[cell]
            bins = np.floor(np.log2(np.maximum(far(part, model), 1e-6)) * q.BINS_PER_OCTAVE)
            edge = np.sort(bins)[int(np.ceil(subset * len(bins))) - 1]
            if reweight:
                edge = max(edge, np.floor(np.log2(q.chi2_quantile(q.REWEIGHT, len(names))) * q.BINS_PER_OCTAVE))
            inner = part[bins <= edge][names].to_numpy()
            out[cell] = inner.mean(0), np.cov(inner.T, bias=True) * q.consistency(len(inner) / len(part), len(names))
        return out

    first = {}
    for cell, part in cells.items():
        x = part[names].to_numpy()
        first[cell] = quartile(x, 0.5), np.diag(((quartile(x, 0.75) - quartile(x, 0.25)) / 1.349) ** 2)
    seen = []
    for own in (first, step(first, subset=1.0)):
        for _ in range(q.STEPS):
            own = step(own)
            seen.append(own)
    least = {c: min((own[c] for own in seen), key=lambda e: np.linalg.slogdet(e[1] + floors)[1]) for c in cells}
    final = shrunk(step(least, reweight=True))
    return pd.concat([pd.Series(far(part, final[c]), part.index) for c, part in cells.items() if c[0] == 0])


@pytest.fixture(scope="module")
def corpus():
    random.seed(9)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(random.choice(vocabulary).capitalize() + random.choice(["", "", ".", ","]) if random.random() < 0.1 else random.choice(vocabulary) for _ in range(n))

    rows = []
    for i in range(700):
        lang, source = ("en", "s0") if i % 2 else ("en" if i % 3 else None, f"s{i % 7}" if i % 5 else None)
        text = prose(random.randint(8, 120))
        if i % 25 == 0:
            text = " ".join(x + "###" for x in text.split())
        rows.append((i, text, lang, source))
    return rows + [(900, None, "en", "s0"), (901, "", None, None), (902, "tiny text", "xx", "yy"), (None, rows[1][1], "en", "s0"), rows[3]]


def test_verdicts_equal_direct_computation(spark, corpus):
    schema = "doc_id long, text string, lang string, source string"
    frame = spark.createDataFrame(corpus, schema).selectExpr("*", "1 AS distance", "'c' AS level").repartition(3)
    got = pd.DataFrame([(r.row.doc_id, r.base_failed, r.distance, r.kept, r.n_words) for r in q.judge(frame).collect()], columns=["d", "failed", "distance", "kept", "n"])
    assert len(got) == len(corpus) and set(got.loc[got.n < 10, "kept"]) == {False}

    stats = pd.DataFrame(q.text_statistics(w.text_bytes(pa.array([t for _, t, _, _ in corpus]))))
    stats[["d", "lang", "source"]] = [(d, lang, source) for d, _, lang, source in corpus]
    passed = stats[(stats.n_words >= 10) & (100 * stats.n_repeat_words <= 20 * stats.n_words)].copy()
    passed["expected"] = distances(passed)
    merged = passed.drop_duplicates("d").merge(got.drop_duplicates("d"), on="d")
    assert len(merged) > 600
    assert np.allclose(merged.expected, merged.distance, rtol=1e-4, atol=1e-5)
    assert (merged.kept == (merged.distance <= q.chi2_quantile(q.CUTOFF, len(q.STATISTICS)))).all()
    assert not got[got.d.isin(range(0, 700, 25)) & (got.n > 40)].kept.any()
    assert got[~got.d.isin(range(0, 700, 25)) & ~got.failed].kept.mean() > 0.995


def test_verdicts_do_not_turn_with_the_size_of_a_cell(spark):
    random.seed(4)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 9))) for _ in range(400)]
    clean = [(i, " ".join(random.choices(vocabulary, k=random.randint(40, 90))), "en", "small" if i >= 600 else f"s{i % 3}") for i in range(850)]
    odd = [(5000 + i, " ".join(x.upper() + "##" for x in random.choices(vocabulary, k=60)), "en", "small") for i in range(4)]
    verdicts = []
    for size in (150, 195, 205, 250):
        frame = spark.createDataFrame(clean[: 600 + size] + odd, "doc_id long, text string, lang string, source string")
        verdicts.append({r.row.doc_id: r.kept for r in q.judge(frame).collect()})
    for got in verdicts:
        assert not any(got[d] for d, *_ in odd)
        assert all(keep for d, keep in got.items() if d < 5000)


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g h i j k", None, "s")], "doc_id long, text string, lang string, source string")
    [only] = q.judge(frame).collect()
    assert only.kept and only.distance < 1e-3
    assert q.judge(frame.limit(0)).collect() == []
