"""SentencePiece encoding with offsets, and decoding.

The normaliser is rebuilt from the model file: the compiled character map (a double-array trie and its replacement
strings) is walked for the longest prefix at each place, and each normalised byte keeps the place in the original text
it came from; blanks are escaped, a dummy blank is put first, extra blanks are dropped if the model says so.  Pieces are
then projected through that alignment to spans of original bytes.

Segmentation itself is the sentencepiece library's, on whole texts, and so is decoding: ids must equal the library's.

Null texts count as empty; an empty text has the end id only and decodes to an empty text.  A text may have any length: its
ids and places are in one task's memory.  Among segmentations that tie the library decides.  Repeated rows give equal rows.
New columns replace input columns of the same name, others pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

BLANK = "▁"
ESCAPED = BLANK.encode()


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message: (number, value)."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class CharsMap:
    """The compiled map: the trie's units, and replacements that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        self.first = bytes(b for b in range(1, 256) if self._child(self._offset(self.units[0]), b) is not None) if self.units else b""

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child(self, at: int, byte: int) -> int | None:
        at ^= byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that begins at a place, and the key's length."""
        if not self.units or data[at] not in self.first:
            return None
        node, best = self._offset(self.units[0]), None
        for k in range(at, len(data)):
            place = self._child(node, data[k])
            if place is None:
                break
            unit = self.units[place]
            node = place ^ self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                best = self.texts[value : self.texts.index(b"\0", value)], k + 1 - at
        return best


class Normalizer:
    """Normalised bytes and, for each of them and the end, the place in the original."""

    def __init__(self, model: bytes):
        spec = next((v for n, v in _fields(model) if n == 3), b"")
        got = dict(_fields(spec))
        self.map = CharsMap(got.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(got.get(n, 1)) for n in (3, 4, 5))
        self.suffix = any(n == 24 and v for n, v in _fields(next((v for n, v in _fields(model) if n == 2), b"")))
        self.plain = not self.map.units and not self.squeeze and self.escape and self.dummy and not self.suffix

    def _next(self, data: bytes, at: int) -> tuple[bytes, int]:
        if found := self.map.longest(data, at):
            return found
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return data[at : at + n], n

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            return self._plain(data)
        blank = ESCAPED if self.escape else b" "
        out, places, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(data) and (got := self._next(data, at))[0] == b" ":
                at += got[1]
        if at == len(data):
            return b"", np.array([at])

        def add(piece: bytes, place: int) -> None:
            out.extend(piece)
            places.extend([place] * len(piece))

        if self.dummy and not self.suffix:
            add(blank, at)
        before = self.squeeze
        while at < len(data):
            piece, n = self._next(data, at)
            if before and self.squeeze:
                piece = piece.lstrip(b" ")
            for k in range(len(piece)):
                add(blank if piece[k : k + 1] == b" " else piece[k : k + 1], at)
            if piece:
                before = piece.endswith(b" ")
            at += n
            if not self.squeeze:
                before = False
        if self.squeeze:
            while out.endswith(blank):
                at = places[len(out) - len(blank)]
                del out[-len(blank) :], places[-len(blank) :]
        if self.dummy and self.suffix:
            add(blank, at)
        return bytes(out), np.array([*places, at])

    @staticmethod
    def _plain(data: bytes) -> tuple[bytes, np.ndarray]:
        """No map and no squeezing: blanks become three bytes that stem from one, behind a dummy blank."""
        wide = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
        return ESCAPED + data.replace(b" ", ESCAPED), np.concatenate([[0, 0, 0], np.repeat(np.arange(len(data)), wide), [len(data)]])


class Encoder:
    """Ids, spans in original bytes and the decoded text of whole texts."""

    def __init__(self, model: bytes, end: bool = True):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer, self.end = Normalizer(model), end
        self.end_id, self.unknown = sp.eos_id(), sp.unk_id()
        ids = range(sp.vocab_size())
        self.pieces = [sp.id_to_piece(i).encode() for i in ids]
        self.byte = [sp.is_byte(i) for i in ids]
        self.size = np.array([1 if b else len(p) for p, b in zip(self.pieces, self.byte, strict=True)], np.int64)
        self.digits = [str(i) for i in ids]

    def lengths(self, ids: np.ndarray, text: bytes) -> np.ndarray:
        """Each piece's bytes in the normalised text; those of an unknown piece are in the library's own piece."""
        if self.unknown < 0 or not (ids == self.unknown).any():
            return self.size[ids]
        pieces = self.model.encode(text.decode(), out_type=str)
        return np.array([len(p.encode()) if i == self.unknown else self.size[i] for i, p in zip(ids.tolist(), pieces, strict=True)], np.int64)

    def encode(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str, str]]:
        """For each text (ids, starts, ends, decoded text, the ids' digits joined by a blank); the end id's span is empty."""
        texts = [t or b"" for t in texts]
        for text, plain in zip(texts, self.model.encode([t.decode() for t in texts], num_threads=1, return_type="numpy", add_eos=self.end), strict=True):
            ids, place = plain[: len(plain) - self.end], self.normalizer(text)[1]
            edge = np.concatenate([[0], np.cumsum(self.lengths(ids, text))])
            if edge[-1] != len(place) - 1:
                raise ValueError("the pieces don't add up to the normalised text")
            edge = place[edge]
            last, full = [len(text)] * self.end, plain.tolist()
            yield plain, np.append(edge[:-1], last), np.append(edge[1:], last), self.model.decode(full), " ".join([self.digits[i] for i in full])


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


FIELDS = [("n_tokens", "bigint"), ("ids", "array<int>"), ("starts", "array<int>"), ("ends", "array<int>"), ("decoded", "string"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("spans_sha256", "string")]


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None, end: bool = True, outputs: tuple[str, ...] = ("n_tokens", "ids", "starts", "ends", "decoded")) -> DataFrame:
    """The kept columns and the outputs asked for: ``ids`` with their spans [``starts``, ``ends``) in original bytes,
    ``decoded``, the number of ids, and the hex digests of the ids' digits, of the decoded text, and of the spans (each start
    and end as 32 bits, little-endian)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def lists(values: list[np.ndarray]) -> pa.Array:
        edges = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(values).astype(np.int32)))

    def make():
        encoder = Encoder(shared.value, end)

        def run(texts: list) -> dict:
            got = list(encoder.encode(texts))
            out: dict = {"n_tokens": [len(g[0]) for g in got]}
            for k, name in enumerate(("ids", "starts", "ends")):
                if name in outputs:
                    out[name] = lists([g[k] for g in got])
            if "decoded" in outputs:
                out["decoded"] = [g[3] for g in got]
            if "ids_sha256" in outputs:
                out["ids_sha256"] = [hashlib.sha256(g[4].encode()).hexdigest() for g in got]
            if "decoded_sha256" in outputs:
                out["decoded_sha256"] = [hashlib.sha256(g[3].encode()).hexdigest() for g in got]
            if "spans_sha256" in outputs:
                out["spans_sha256"] = [hashlib.sha256(np.stack(g[1:3], axis=1).astype("<i4").tobytes()).hexdigest() for g in got]
            return out

        return run

    return common.map_text(docs, make, [(n, t) for n, t in FIELDS if n in outputs], text, keep, rows=128)


def encode_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256."""
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    return encode(docs, read_model(docs.sparkSession, model_path), text, [id_col], outputs=outputs).select(id_col, *outputs)


def decode(df: DataFrame, model: bytes, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The frame with the text of each row's ids; null ids give a null text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(column):
        import pandas as pd
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        return pd.Series([None if v is None else sp.decode([int(i) for i in v]) for v in column], dtype=object)

    text.__annotations__ = {}
    return df.withColumn(name, text(F.col(ids)))
