"""Byte-level BPE encoding and decoding (operator 9) with a sentencepiece model made from the ranks.

The vocabulary is a rank file (base64 of the bytes, a blank, the rank). Each byte is mapped to a
printable character, the pieces are the byte strings so mapped, and a piece's score is its
negative rank, so that sentencepiece merges in the order of the ranks; its normalisation is the
identity. The model is serialised directly from the vocabulary; nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.common import in_lots, sparing

#: Pre-tokens whose ids a task keeps, at most; longer ones than this many characters are never kept.
CACHE, CACHE_CHARS = 200_000, 64


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank (0, 1, 2 ... without gaps)."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in (line.split() for line in f if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model(ranks: list[bytes]) -> bytes:
    """A sentencepiece BPE model as its message's bytes. Id 0 is unknown; rank r is id r + 1."""
    chars = byte_chars()
    out = [_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2))]
    for rank, piece in enumerate(ranks):
        name = "".join(chars[b] for b in piece).encode()
        out.append(_field(1, _field(1, name) + b"\x15" + struct.pack("<f", -float(rank)) + _flag(3, 1)))
    out.append(_field(2, _flag(3, 2) + _flag(4, len(ranks) + 1)))
    # identity normalisation: no map, no dummy prefix, no removal or escaping of white space
    out.append(_field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)))
    return b"".join(out)


def _lay_out(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings end to end: starts, lengths, bytes."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(pieces), np.uint8)


def _gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at starts, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Codec:
    """Encodes and decodes texts; ids are ranks. Pre-tokens seen before keep their ids, within bounds."""

    def __init__(self, serialised: bytes, ranks: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.spm = sentencepiece.SentencePieceProcessor()
        self.spm.LoadFromSerializedProto(serialised)
        self.split = regex.compile(pattern).findall
        self.mapped = dict(enumerate(byte_chars()))
        self.pieces, self.names = _lay_out(ranks), _lay_out([b"%d " % i for i in range(len(ranks))])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat = (np.zeros(0, t) for t in (np.int64, np.int64, np.int32))

    def _learn(self, tokens: list[str]) -> None:
        mapped = [t.encode("utf-8").decode("latin-1").translate(self.mapped) for t in tokens]
        found = self.spm.Encode(mapped, out_type=int, num_threads=1)
        self.known.update(zip(tokens, range(len(self.starts), len(self.starts) + len(tokens))))
        sizes = np.array([len(x) for x in found], np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, sizes.sum()) - 1])

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > CACHE or len(self.flat) > 8 * CACHE:
            self._forget()
        split = [self.split(t) for t in texts]
        tokens = list(chain.from_iterable(split))
        at = np.fromiter(map(self.known.get, tokens, repeat(-1)), np.int64, len(tokens))
        if len(new := np.flatnonzero(at < 0)):
            names = list(dict.fromkeys([tokens[i] for i in new]))
            self._learn(names)
            at[new] = [self.known[tokens[i]] for i in new]
            for name in names:
                if len(name) > CACHE_CHARS:
                    del self.known[name]
        ends = np.cumsum([0, *map(len, split)])
        for a, z in zip(ends, ends[1:]):
            yield _gather(self.starts[at[a:z]], self.sizes[at[a:z]], self.flat)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        return _gather(self.pieces[0][ids], self.pieces[1][ids], self.pieces[2]).tobytes()

    def decimal(self, ids) -> bytes:
        """The ids as decimal numbers joined by one space."""
        ids = np.asarray(ids, np.int64)
        return _gather(self.names[0][ids], self.names[1][ids], self.names[2]).tobytes()[:-1]


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(serialised: bytes, ranks: list[bytes], pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = (hashlib.sha256(serialised).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(serialised, ranks, pattern)
    return _codecs[key]


def _map(docs: DataFrame, columns: list[str], path: str, pattern: str, fields: list[tuple[str, str]], row: Callable) -> DataFrame:
    ranks = read_ranks(path)
    # a vocabulary's size is fixed, whatever the input
    shipped = docs.sparkSession.sparkContext.broadcast((model(ranks), ranks))
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    src = docs.select(*columns)
    keep = [c for c in columns if c in src.columns][:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema] + [f"{n} {t}" for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shipped.value, pattern)
        for b in batches:
            rows = []
            for texts in in_lots(b.column(b.num_columns - 1)):
                rows += [row(codec, ids) for ids in codec.encode_all(texts)]
            cols = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))] + [pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)],
                names=keep + [n for n, _ in fields],
            )
        codec._forget()  # the worker may serve other stages next

    return src.mapInArrow(sparing(run), schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids: the ids of each row's text, as the byte-level BPE of the ranks gives them.

    The pattern's matches are encoded one by one, without special tokens; a null or empty text
    has no ids. One row for each row, repeated and null ids included; other columns are not read, and an
    empty table gives an empty result. A text is split as a whole, however long, beside its batch only.
    """
    return _map(docs, [id_col, text_col], path, pattern, [("ids", "array<int>")], lambda c, ids: (ids,))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: digests of encode()'s ids and of the bytes they decode to.

    Nulls, repeated rows, long texts and empty tables are as in encode().
    """

    def row(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
        return (
            len(ids),
            hashlib.sha256(codec.decimal(ids)).hexdigest(),
            hashlib.sha256(codec.decode(ids)).hexdigest(),
        )

    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return _map(docs, [id_col, text_col], path, pattern, fields, row)
