"""Registered queries of the subpackage against DuckDB on the smallest tables."""

import pytest

from checks.compare import difference, duckdb_views
from editpulse.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return duckdb_views(SMALL)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_duckdb(spark, oracle, name):
    frame = queries.QUERIES[name](spark, SMALL)
    rows = [tuple(row) for row in frame.collect()]
    expected = oracle.execute(f"SELECT {', '.join(frame.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert difference(frame.columns, rows, expected) is None


def test_statements_belong_to_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_byte_bpe_digests(spark):
    import hashlib

    import public_tokenizers as P
    import tiktoken

    from editpulse.llm.bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_byte_bpe"](spark, SMALL).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        expected = (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected


def test_span_digests(spark):
    import hashlib

    from .test_pii import brute as personal
    from .test_secret_scan import brute as secret

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op2_pii"](spark, SMALL).collect():
        base = personal(texts[r.doc_id])
        joined = ",".join(f"{kind}:{a}:{b}" for kind, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(kind == k for k, _, _ in base) for kind in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    for r in queries.QUERIES["op8_secret_scan"](spark, SMALL).collect():
        base = secret(texts[r.doc_id])
        joined = ",".join(f"{kind}:{a}:{b}" for kind, a, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(kind == k for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
