"""Token ids against an independent library, and exact round trips."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from editpulse.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def samples():
    random.seed(4)
    letters = "abcdeé ñ\n\t 019'.,!?#中文🙂 ​\x00"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(400)]
    return texts + [
        "", " ", "  \n ", "it's we'll 'S", "<|endoftext|>", "a" * 3000, " " * 5000, "word " * 70_000 + "x", "\n" * 300_000, "中" * 700,
        "".join(map(chr, range(1, 3000))), "é \r\n\r\n  x",
    ]


def test_ids_equal_library(library, monkeypatch):
    codec = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 500)
    for text in samples() * 2:
        ids = codec.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_frame(spark, library):
    rows = [(i, t, 0) for i, t in enumerate(samples())] + [(None, None, 1), (3, "twice", 2), (3, "twice", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = bpe.encode_decode(frame, PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode_ordinary(r.row.text or "") and bytes(r.decoded) == (r.row.text or "").encode()
    packed = bpe.encode_decode(frame, PATH, P.PATTERN, ["doc_id"], packed=True).where("row.doc_id = 5").first()
    assert np.frombuffer(packed.ids, "<u4").tolist() == library.encode_ordinary(rows[5][1])
    assert bpe.encode_decode(frame.limit(0), PATH, P.PATTERN).collect() == []
