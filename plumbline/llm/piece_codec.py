"""Offset-preserving piece encoding and decoding.

The text is normalised here, by longest-prefix matches in the model's compiled character map, and every normalised byte
keeps the place of its source. The library then only merges: it gets normalised text and a copy of the model whose own
normaliser is switched off. Each piece is projected through the alignment to a span of original UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import map_texts

SPACE = "▁"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    r = s = 0
    while True:
        x = b[i]
        i += 1
        r |= (x & 127) << s
        s += 7
        if x < 128:
            return r, i


def _to_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def proto_fields(b: bytes):
    """(number, wire type, value) of each field of a serialized message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        wire = key & 7
        if wire == 2:
            n, i = _varint(b, i)
            yield key >> 3, wire, b[i : i + n]
            i += n
        elif wire == 0:
            v, i = _varint(b, i)
            yield key >> 3, wire, v
        else:
            n = 4 if wire == 5 else 8
            yield key >> 3, wire, b[i : i + n]
            i += n


def proto_message(fields) -> bytes:
    out = []
    for number, wire, value in fields:
        out.append(_to_varint(number << 3 | wire))
        out.append(_to_varint(value) if wire == 0 else _to_varint(len(value)) + value if wire == 2 else value)
    return b"".join(out)


class CharacterMap:
    """The compiled character map: a double-array trie of source strings and a pool of zero-ended replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if blob else ()
        self.pool = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of data[at:] and its replacement."""
        units, node, best = self.units, 0, None
        if not units:
            return None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.pool[best[1] : self.pool.index(0, best[1])]


class Normalizer:
    """Library-exact normalisation with alignment, from the model's normaliser settings."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, remove_extra: bool = True, escape: bool = True):
        self.map = CharacterMap(charsmap)
        self.dummy_prefix, self.remove_extra, self.escape = dummy_prefix, remove_extra, escape
        self.space = SPACE.encode() if escape else b" "

    def simple(self) -> bool:
        return not self.map.units and not self.remove_extra and self.escape

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the offset of the source byte."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        return self._plain(text, data) if self.simple() else self._mapped(data)

    def _plain(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        width = np.where(raw == 32, 3, 1)
        align = np.repeat(np.arange(len(raw), dtype=np.int64), width)
        head = np.zeros(3 if self.dummy_prefix else 0, np.int64)
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE), np.concatenate([head, align, [len(raw)]])

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        hit = self.map.longest(data, at)
        if hit:
            return hit
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n]

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        out, align, i = bytearray(), [], 0
        if self.remove_extra:
            while i < len(data):
                n, piece = self._prefix(data, i)
                if piece != b" ":
                    break
                i += n
            if i == len(data):
                return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += self.space
            align += [i] * len(self.space)
        before = self.remove_extra
        while i < len(data):
            n, piece = self._prefix(data, i)
            while before and piece[:1] == b" ":
                piece = piece[1:]
            if piece:
                for b in piece:
                    spelled = self.space if b == 32 else bytes([b])
                    out += spelled
                    align += [i] * len(spelled)
                before = piece[-1] == 32
            i += n
            before = before and self.remove_extra
        if self.remove_extra:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                i = align[len(out)]
                del align[len(out) :]
        return out.decode(), np.array([*align, i], np.int64)


class PieceCodec:
    """Encodes and decodes with one model file; every piece carries its span of original bytes."""

    def __init__(self, model_path: str):
        import sentencepiece

        with open(model_path, "rb") as f:
            model = list(proto_fields(f.read()))
        spec = {n: v for n, _, v in next((list(proto_fields(v)) for n, _, v in model if n == 3), [])}
        self.normalizer = Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        bare = proto_message([(1, 2, b"identity"), (2, 2, b""), (3, 0, 0), (4, 0, 0), (5, 0, 0)])
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto_message([*((n, w, v) for n, w, v in model if n != 3), (3, 2, bare)]))
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.eos = self.library.eos_id()
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.is_byte = np.array([self.library.is_byte(i) for i in range(size)])
        self.widths = np.array([1 if b else len(p.encode()) for p, b in zip(pieces, self.is_byte)], np.int64)
        self.unknown = self.library.unk_id()
        self.spelled = [str(i) for i in range(size)]

    def _widths(self, text: str, ids: list[int]) -> np.ndarray:
        if self.unknown in ids and not self.is_byte.any():  # an unknown run is as wide as the library says
            return np.array([len(p.surface.encode()) for p in self.merger.encode(text, return_type="proto").pieces], np.int64)
        return self.widths[ids]

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """For each text: ids with the end id, start and end of each piece in its UTF-8 bytes."""
        aligned = [self.normalizer(t) for t in texts]
        out = []
        for (text, align), ids in zip(aligned, self.merger.encode([n for n, _ in aligned], num_threads=1) if texts else []):
            at = np.zeros(len(ids) + 2, np.int64)
            if ids:
                np.cumsum(self._widths(text, ids), out=at[1:-1])
                at[-1] = at[-2]
                if at[-1] != len(align) - 1:
                    raise ValueError("pieces don't cover the normalised text")
            span = align[at]
            span[0] = 0 if ids else span[0]
            ids.append(self.eos)
            out.append((ids, span[:-1], span[1:]))
        return out

    def joined(self, ids: list[int]) -> str:
        return " ".join(map(self.spelled.__getitem__, ids))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def _spans(path: str) -> Callable:
    codec = PieceCodec(path)

    def work(texts: list[str]) -> dict:
        found = codec.encode(texts)
        return {"ids": [f[0] for f in found], "starts": [f[1] for f in found], "ends": [f[2] for f in found]}

    return work


def _digests(path: str) -> Callable:
    codec = PieceCodec(path)

    def work(texts: list[str]) -> dict:
        found = codec.encode(texts)
        decoded = codec.decode([f[0] for f in found])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        spans = [hashlib.sha256(np.stack([f[1], f[2]], 1).astype("<i8").tobytes()).hexdigest() for f in found]
        return {"n_tokens": [len(f[0]) for f in found], "ids_sha256": [sha(codec.joined(f[0])) for f in found], "decoded_sha256": [*map(sha, decoded)], "spans_sha256": spans, "round_trip": [a == b for a, b in zip(texts, decoded)]}

    return work




def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids, starts, ends: the piece ids of each whole text (end id last) and each piece's half-open span of original bytes.

    Null or empty text: the end id alone, span [0, 0). Of several byte pieces that spell one character each has its own byte.
    Rows repeat as they do in docs; other columns are left behind, whatever their names.
    """
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))]
    return map_texts(docs, id_col, text_col, partial(_spans, model_path), fields)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text: the library's decoding of each list of ids; a null list gives the empty text."""
    from pyspark.sql import functions as F

    from plumbline.llm.common import ship

    import pyarrow as pa

    ship(encoded.sparkSession)
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        codec = PieceCodec(model_path)
        for b in batches:
            texts = codec.decode([x or [] for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, spans_sha256, round_trip: the same encoding and its decoding, as digests.

    spans_sha256 is over the little-endian (start, end) pairs; round_trip says whether decoding gave the text back.
    Null or empty text: one token (the end id), decoded empty.
    """
    S, L = T.StringType(), T.LongType()
    fields = [T.StructField("n_tokens", L), *(T.StructField(n, S) for n in ("ids_sha256", "decoded_sha256", "spans_sha256")), T.StructField("round_trip", T.BooleanType())]
    return map_texts(docs, id_col, text_col, partial(_digests, model_path), fields)
