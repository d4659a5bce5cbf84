"""Byte-level BPE through a sentencepiece model that is written from the rank file itself."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece as spm
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as proto

from editpulse.llm import words as w
from editpulse.llm.frames import row_of

KNOWN_PIECES = 150_000
PART_CHARACTERS = 1 << 18
#: Between a non-space and a white-space character no match of the pattern goes on.
_PART_END = regex.compile(r"\S(?=\s)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks from a file of base64 token and rank lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """Serialised BPE model: byte-mapped pieces scored by negative rank, no normalisation.

    Piece 0 is the unknown piece, which never occurs as every byte is a piece; the piece of rank
    order i follows at i + 1.
    """
    letters = byte_characters()
    model = proto.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes pre-tokens and decodes ids; built once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        letters = byte_characters()
        self.table = {ord(chr(b)): letter for b, letter in enumerate(letters)}
        self.pattern = regex.compile(pattern)
        self.model = spm.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of_piece = np.array([-1, *(rank for _, rank in ordered)], dtype=np.int64)
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}
        size = max(ranks.values(), default=-1) + 1
        pieces = [b""] * size
        for token, rank in ranks.items():
            pieces[rank] = token
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _learn(self, pieces: set[str]) -> None:
        """Encodes pieces not seen before; a piece that is a token itself is that token."""
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        split = []
        for piece in pieces:
            token = self.whole.get(piece.encode())
            if token is None:
                split.append(piece)
            else:
                self.known[piece] = token
        mapped = [x.encode().decode("latin-1").translate(self.table) for x in split]
        for piece, ids in zip(split, self.model.encode(mapped, num_threads=1), strict=True):
            self.known[piece] = self.rank_of_piece[ids].astype("<u4").tobytes()

    def _parts(self, text: str) -> Iterator[str]:
        """Parts of a long text that end where no pre-token goes on."""
        first = 0
        while len(text) - first > PART_CHARACTERS:
            end = _PART_END.search(text, first + PART_CHARACTERS)
            if end is None:
                break
            yield text[first : end.end()]
            first = end.end()
        yield text[first:] if first else text

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in self._parts(text):
            pieces = self.pattern.findall(part)
            known = self.known
            try:
                out.append(b"".join([known[x] for x in pieces]))
            except KeyError:
                distinct = set(pieces)
                self._learn({x for x in distinct if x not in known} if len(known) <= KNOWN_PIECES else distinct)
                out.append(b"".join([known[x] for x in pieces]))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens one after another."""
        if not len(ids):
            return b""
        out = []
        for first in range(0, len(ids), 1 << 20):
            part = ids[first : first + (1 << 20)].astype(np.int64)
            sizes = self.lengths[part]
            ends = np.cumsum(sizes)
            at = np.arange(int(ends[-1])) + np.repeat(self.starts[part] - (ends - sizes), sizes)
            out.append(self.bytes[at].tobytes())
        return b"".join(out)


_codecs: dict[str, Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once for each worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(read_ranks(path), pattern)
    return _codecs[path]


def encode_decode(
    documents: DataFrame, ranks_path: str, pattern: str, carry: Iterable[str] | None = None, packed: bool = False
) -> DataFrame:
    """Per row of ``documents`` (text): ``row`` (the columns ``carry``, all by default), ``ids``
    (array of token ids; with ``packed`` their bytes as little-endian unsigned 32-bit integers) and
    ``decoded`` (the bytes that the ids stand for).

    Each match of ``pattern`` is encoded by itself. Its UTF-8 bytes become one character each, and
    a sentencepiece BPE model built from the rank file merges them: the best score is the lowest
    rank. Decoding looks up each id's bytes. ``ranks_path`` names a file at the same place on every
    worker; a folder of installed vocabularies is such a place.

    Rows are independent: no shuffle, nothing kept between rows but a bounded cache of pieces. Long
    texts go through in parts that end between pre-tokens. Null and empty texts have no ids. Repeated
    rows give repeated results, an empty table an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for part in w.slices(batches, "text", 1 << 20):
            ids, decoded = [], []
            for text in part.column("text").to_pylist():
                ids.append(codec.encode(text or ""))
                decoded.append(codec.decode(ids[-1]))
            if packed:
                lists = pa.array([x.tobytes() for x in ids], pa.binary())
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("row"), lists, pa.array(decoded, pa.binary())], names=["row", "ids", "decoded"])

    frame = documents.select(row_of(documents, carry), "text")
    kind = frame.schema["row"].dataType.simpleString()
    return frame.mapInArrow(run, f"row {kind}, ids {'binary' if packed else 'array<int>'}, decoded binary")
