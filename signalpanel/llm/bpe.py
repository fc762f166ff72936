"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is not trained: it is serialised here directly from a rank file. Every
byte becomes one printable character, every vocabulary entry a piece of such
characters whose score is its negative rank, and normalisation is the identity, so
sentencepiece merges exactly the pairs, in the order, that the ranks prescribe.
Texts are first cut into pre-tokens by the vocabulary's pattern; each is encoded on
its own and decoding is the inverse mapping from ids to bytes.

Rows map one to one in one pass, without a shuffle. Null texts are empty and have no
tokens; equal rows stay; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import bound_batches

#: Distinct pre-tokens whose ids a worker keeps; beyond it the store starts anew.
CACHE = 150_000


def byte_chars() -> list[str]:
    """One printable character for each byte: itself if printable, else the next free one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    free = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file (base64 piece, rank), by rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
    assert [r for r, _ in pairs] == list(range(len(pairs))), "ranks must be 0, 1, 2 ..."
    return [p for _, p in pairs]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One protocol-buffer field: an int as varint, a float as 32 bits, else length and bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialize_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes after them."""
    chars = byte_chars()
    pieces = [_field(1, "".join(chars[b] for b in p)) + _field(2, -float(rank)) for rank, p in enumerate(vocabulary)]
    pieces.append(_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = b"".join([_field(3, 2), _field(4, len(pieces)), _field(40, len(vocabulary)), _field(41, -1), _field(42, -1), _field(43, -1), _field(45, "<unk>")])
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes texts by a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(self.vocabulary))
        self.split = regex.compile(pattern).findall
        self.chars = dict(enumerate(byte_chars()))
        self.known: dict[str, bytes] = {}

    def ids_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        tokens = self.split(text)
        known = self.known
        if new := set(tokens).difference(known):
            if len(known) > CACHE:
                known.clear()
                new = set(tokens)
            new = list(new)
            mapped = [t.encode().decode("latin-1").translate(self.chars) for t in new]
            for token, ids in zip(new, self.model.encode(mapped, num_threads=1)):
                known[token] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, tokens))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.ids_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker."""
    return Codec(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text."""
    bound_batches(df.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            raw = [c.ids_bytes(t or "") for t in batch.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off), values)], [id_col, "ids"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def with_ids(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df without its text and with n_tokens and ids (array of int), after decoding the ids back to exactly the text. Columns of
    df that have these names are replaced."""
    bound_batches(df.sparkSession)
    names = [c for c in df.columns if c not in (text_col, "n_tokens", "ids")]

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            raw = []
            for text in batch.column(text_col).to_pylist():
                raw.append(c.ids_bytes(text or ""))
                if c.decode(np.frombuffer(raw[-1], "<u4").tolist()) != (text or "").encode():
                    raise ValueError("ids do not decode to their text")
            off = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.diff(off).astype(np.int64)), ids], [*names, "n_tokens", "ids"])

    return df.mapInArrow(run, StructType([*(df.schema[n] for n in names), StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))]))


def decode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data (binary): the bytes that the ids stand for; null ids give null."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            data = [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return df.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, f"`{id_col}` long, data binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def roundtrip_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids in one pass; digests of both."""
    bound_batches(df.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                raw = c.ids_bytes(text or "")
                back = c.decode(np.frombuffer(raw, "<u4").tolist())
                rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, DIGESTS)
