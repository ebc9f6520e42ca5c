"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every token of the vocabulary becomes a piece: its bytes are mapped to 256 letters of their own and its score is the
negative rank, so that sentencepiece's merging (highest score first, the leftmost of equals) is that of the ranks. The
normaliser is the identity and nothing is added before or after a text. Pre-tokens are encoded in bundles, held apart by a
piece that merges with nothing; decoding maps the letters of the pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .text import from_driver, slices, small_batches, texts, to_tasks

#: The letter of byte b is chr(LETTERS + b); the next one stands between pre-tokens.
LETTERS = 0x100
APART = chr(LETTERS + 256)
LETTER_OF = {b: LETTERS + b for b in range(256)}
#: Pre-tokens that are encoded as one string, characters that are split into pre-tokens at once, pre-tokens remembered.
BUNDLE, PIECE_CHARS, REMEMBERED = 128, 1_000_000, 200_000
#: Field numbers and values of sentencepiece's public model format.
PIECES, TRAINER, NORMALISER = 1, 2, 3
NORMAL, UNKNOWN, BPE = 1, 2, 2


def lettered(raw: bytes) -> str:
    """The bytes as letters."""
    return raw.decode("latin-1").translate(LETTER_OF)


def unlettered(piece: str) -> bytes:
    """The bytes that the letters stand for."""
    return bytes(ord(c) - LETTERS for c in piece)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line the base64 form of a token's bytes and its rank, which is its id too."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value: int | float | bytes) -> bytes:
    """One field of a serialised message: a number, a 32-bit fraction, or bytes with their length before them."""
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def serialised(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary: pieces in the order of their ranks, then unknown and the one between pre-tokens."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary has no token for the bytes {missing}")
    order = sorted(ranks, key=ranks.__getitem__)
    pieces = [(lettered(raw), -float(ranks[raw]), NORMAL) for raw in order] + [("<unk>", 0.0, UNKNOWN), (APART, -2.0 * len(order), NORMAL)]
    model = b"".join(field(PIECES, field(1, p.encode()) + field(2, score) + field(3, kind)) for p, score, kind in pieces)
    trainer = field(3, BPE) + field(40, len(order)) + b"".join(field(n, -1) for n in (41, 42, 43))  # unknown's id; no begin, end, padding
    normaliser = field(1, b"identity") + b"".join(field(n, 0) for n in (3, 4, 5))  # no space added, removed or replaced
    return model + field(TRAINER, trainer) + field(NORMALISER, normaliser)


class Encoder:
    """Ids of texts; pre-tokens met before are remembered."""

    def __init__(self, model: bytes, ranks: np.ndarray, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks, self.apart = ranks, len(ranks) + 1
        self.split = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        # A token that merging its own bytes doesn't give still stands for a pre-token equal to it.
        names = [self.pieces.id_to_piece(i) for i in range(len(ranks))]
        bundles = self.bundled(names)
        self.whole = {name: ranks[i : i + 1].tobytes() for i, (name, ids) in enumerate(zip(names, bundles)) if ids != ranks[i : i + 1].tobytes()}

    def bundled(self, names: list[str]) -> Iterator[bytes]:
        """Ids of lettered pre-tokens as 32-bit numbers."""
        bundles = [APART.join(names[i : i + BUNDLE]) for i in range(0, len(names), BUNDLE)]
        for ids in self.pieces.encode(bundles, num_threads=1):
            flat = np.array(ids, np.int64)
            cuts = np.flatnonzero(flat == self.apart)
            numbers = self.ranks[np.where(flat < len(self.ranks), flat, 0)].tobytes()
            for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(flat)]):
                yield numbers[4 * a : 4 * b]

    def encode(self, bodies: list[str]) -> list[bytes]:
        rows = [self.split(body) for body in bodies]
        fresh = set().union(*rows)
        new = list(fresh - self.words.keys())
        if len(self.words) + len(new) > REMEMBERED:
            self.words, new = {}, list(fresh)
        names = [lettered(w.encode()) for w in new]
        self.words.update(zip(new, self.bundled(names)))
        if self.whole:
            self.words.update((w, self.whole[name]) for w, name in zip(new, names) if name in self.whole)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in rows]


def listed(rows: Iterable[bytes]) -> pa.ListArray:
    """Packed ids as arrays of numbers."""
    rows = list(rows)
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def with_column(schema: StructType, name: str, kind) -> StructType:
    return StructType([f for f in schema.fields if f.name != name] + [StructField(name, kind)])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """Add the ids of each whole text; each match of `pattern` is encoded by itself, special tokens have no meaning.

    `ranks` is the vocabulary (megabytes, a fixed size), broadcast as a serialised model. Ids are array<int>, or with `packed`
    one binary of little-endian unsigned 32-bit numbers, the form in which token files are kept. Null and empty texts have no
    ids; repeated rows repeat; an empty table gives none; a column named `out` is replaced and all others stay. Words of any
    length take n log n steps, and texts are split in slices of bounded size.
    """
    small_batches(docs.sparkSession)
    sent = to_tasks(docs.sparkSession, (serialised(ranks), np.array(sorted(ranks.values()), np.int32)))
    schema = with_column(docs.schema, out, BinaryType() if packed else ArrayType(IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*from_driver(sent), pattern)
        for table in slices(batches, text, PIECE_CHARS):
            ids = encoder.encode(texts(table, text))
            columns = {f.name: table.column(f.name) for f in table.schema} | {out: pa.array(ids, pa.binary()) if packed else listed(ids)}
            yield from pa.table([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields]).to_batches()

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for (binary: ids may cut a character in two); ids as arrays or packed.

    Null and empty ids give no bytes. An id outside the vocabulary is an error, as in the library.
    """
    small_batches(docs.sparkSession)
    sent = to_tasks(docs.sparkSession, (serialised(ranks), np.array(sorted(ranks.values()), np.int32)))
    schema = with_column(docs.schema, out, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbers = from_driver(sent)
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        known = {rank: unlettered(pieces.id_to_piece(i)) for i, rank in enumerate(numbers.tolist())}
        for batch in batches:
            column = batch.column(ids)
            found = []
            for row in column:
                row = row.as_buffer() if pa.types.is_binary(column.type) else row.values
                plain = [] if row is None else np.frombuffer(row, np.int32).tolist() if isinstance(row, pa.Buffer) else row.to_pylist()
                found.append(b"".join(map(known.__getitem__, plain)))
            columns = {f.name: batch.column(f.name) for f in batch.schema} | {out: pa.array(found, pa.binary())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
