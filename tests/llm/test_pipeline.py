"""Stages against plain programs over each stage's own input, and the pipeline end to end."""

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from editpulse.llm.bpe import read_ranks
from editpulse.sources.staging import stage

from . import test_decontaminate, test_line_dedup, test_near_dups, test_quality_rules

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SMALL), f"test-{name}")
        seen.append(docs)
    return [{r.doc_id: r for r in frame.collect()} for frame in seen], seen


def test_columns_stay(stages):
    _, frames = stages
    assert all(f.columns == frames[0].columns and f.dtypes == frames[0].dtypes for f in frames[1:-1])


def test_each_stage(stages, spark):
    rows, _ = stages
    failed = {d for d, r in rows[0].items() for n, _, _, _, repeat in [test_quality_rules.base(r.text)] if n < 10 or 100 * repeat > 20 * n}
    assert not failed & set(rows[1]) and len(rows[1]) > 0.6 * len(rows[0])
    lines = {d: t for d, t, _, _ in test_line_dedup.brute([(d, r.text) for d, r in rows[1].items()])}
    lines = {d: t for d, t in lines.items() if t == rows[1][d].text or test_quality_rules.base(t)[0] >= 10}
    assert {d: r.text for d, r in rows[2].items()} == lines and all(r.n_chars == len(r.text) for r in rows[2].values())
    kept = {d for d, _, _, keep in test_near_dups.brute([(d, r.text) for d, r in rows[2].items()], 5) if keep}
    assert set(rows[3]) == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {d for d, _, hit, _ in test_decontaminate.brute([(d, r.text) for d, r in rows[3].items()], items) if not hit}
    assert set(rows[4]) == clean
    assert all(test_quality_rules.base(r.text)[0] >= 10 for r in rows[4].values())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {d: list(r.ids) for d, r in rows[5].items()} == {d: library.encode_ordinary(r.text) for d, r in rows[4].items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows[5].values())


def test_run_equals_stages(stages, spark):
    rows, _ = stages
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SMALL).collect()} == {d: list(r.ids) for d, r in rows[-1].items()}


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int"
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, None, None, None, None, "a", 1), (2, "", "en", "s", 0, "b", 2), (3, text, None, "s", None, "c", 3), (3, text, None, "s", None, "c", 3), (None, text + " more", "en", None, 5, "d", 4)], schema)
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SMALL), f"odd-{name}")
    assert sorted((r.doc_id or 0, r.round_trip) for r in docs.collect()) == [(0, True), (3, True)]
    empty = spark.createDataFrame([], schema)
    for name, function in corpus_pipeline.STAGES:
        empty = stage(function(spark, empty, SMALL), f"none-{name}")
    assert empty.collect() == []


def test_near_dedup_judges_rows(spark):
    def texts(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
        out = corpus_pipeline.near_dedup(spark, docs, SMALL)
        assert out.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    assert texts([(1, a, "x"), (None, a, "x"), (None, b, "x"), (None, None, "x")]) == [(1, a), (None, b), (None, None)]
    assert texts([(1, a, "x"), (5, a, "x"), (5, b, "x")]) == [(1, a), (5, b)]
    assert texts([(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, b, "x")]) == [(1, a), (5, b)]
    assert texts([(1, a, "x"), (1, a, "y"), (2, b, "x"), (2, b, "x"), (None, c, "x"), (None, c, "y")]) == [(1, a), (2, b), (None, c)]
    assert texts([(2, a, "x"), (5, a + " more", "x"), (5, b, "x"), (None, c, "x"), (5, None, "x")]) == sorted([(2, a), (5, b), (5, None), (None, c)], key=str)


def test_line_dedup_leaves_no_husks(spark):
    shared, own = " ".join(f"shared{i}" for i in range(60)), " ".join(f"own{i}" for i in range(12))
    rows = [(1, shared), (2, f"{shared}\nfew words"), (3, f"{own}\n{shared}"), (4, shared), (5, "short but whole"), (6, None)]
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, own), (4, shared), (5, "short but whole"), (6, None)]
