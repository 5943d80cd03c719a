"""SentencePiece encoding and decoding with every piece projected to its original bytes.

The text is normalised here: the longest prefix known to the model's compiled character map is
replaced by its target, everything else is copied, and each normalised character remembers the
source byte it came from.  The normalised text is cut before each run of word marks that follows
another character (no piece spans such a place, which is checked for the model) and the parts are
encoded by the model without its own normaliser; frequent parts are remembered.  Lengths of pieces
in normalised characters and the source alignment give each piece's span in the original text.

Defined results: null counts as empty, and an empty text has no pieces; very long texts are encoded
whole; equal rows get equal results; columns named like a result are replaced, others kept.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from packspark.llm.common import lean

MARK = "▁"
CACHE_PARTS = 100_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        shift += 7
        if c < 128:
            return x, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """Field number, value and raw bytes of the fields of a protocol-buffer message."""
    i = 0
    while i < len(b):
        start = i
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            v, i = b[i:i + n], i + n
        yield tag >> 3, v, b[start:i]


class CharMap:
    """Longest-prefix rewriting with a compiled character map: a double-array trie over UTF-8 bytes whose
    leaves point into a block of zero-ended targets."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.targets = blob[4 + size:]

    def longest(self, b: bytes, i: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of b[i:] and its target."""
        if not self.units:
            return None
        found, node = None, 0
        node ^= self._offset(self.units[0])
        for k in range(i, len(b)):
            node ^= b[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & ((1 << 31) | 0xFF) != b[k]:
                break
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                at = self.units[node] & ((1 << 31) - 1)
                found = (k + 1 - i, self.targets[at:self.targets.index(b"\0", at)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Encoder:
    """A sentencepiece model with the normaliser taken out and done here."""

    def __init__(self, model: bytes):
        import sentencepiece

        spec: dict[int, int | bytes] = {}
        rest = b""
        for number, value, raw in _fields(model):
            if number == 3:
                spec = {n: v for n, v, _ in _fields(value)}
            else:
                rest += raw
        self.chars = CharMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        bare = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"     # identity, no prefix, no squeezing, no escaping
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=rest + b"\x1a" + bytes([len(bare)]) + bare)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.bare.id_to_piece(i) for i in range(self.bare.get_piece_size())]
        whole = any(MARK in p.lstrip(MARK) for p in pieces)
        self.parts = re.compile("(?s).+" if whole or not self.escape else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        # normalised UTF-8 bytes of a piece
        self.n_bytes = np.array([1 if self.bare.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        self.known: dict[str, tuple[list[int], str]] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its UTF-8 bytes and the end, the source byte it starts at."""
        b = text.encode("utf-8", "replace")
        if not b:
            return "", np.zeros(1, np.int64)
        if not self.chars.units and not self.squeeze:
            return self._copy(text, b)
        out, at = bytearray(), []
        mark = MARK.encode() if self.escape else b" "

        def put(x: bytes, source: int) -> None:
            out.extend(x)
            at.extend([source] * len(x))

        i, space = 0, self.squeeze
        if self.squeeze:
            while i < len(b):
                n, x = self._step(b, i)
                if x.strip(b" "):
                    break
                i += n
            if i == len(b):
                return "", np.full(1, len(b), np.int64)
        if self.prefix:
            put(mark, i)
        while i < len(b):
            n, x = self._step(b, i)
            if self.squeeze and space:
                x = x.lstrip(b" ")
            for piece in re.findall(b" |[^ ]+", x):
                put(mark if piece == b" " else piece, i)
            if x:
                space = x.endswith(b" ")
            i += n
        end = len(b)
        while self.squeeze and out.endswith(mark) and len(out) > 0:
            end = at[-1]
            del out[-len(mark):], at[-len(mark):]
        return out.decode("utf-8", "replace"), np.array([*at, end], np.int64)

    def _copy(self, text: str, b: bytes) -> tuple[str, np.ndarray]:
        """The empty character map: only spaces change, so the alignment is a sum over lengths."""
        width = np.ones(len(b), np.int64)
        norm = b.decode("utf-8")
        if self.escape:
            width[np.frombuffer(b, np.uint8) == 32] = 3
            norm = norm.replace(" ", MARK)
        at = np.repeat(np.arange(len(b), dtype=np.int64), width)
        if self.prefix:
            norm = (MARK if self.escape else " ") + norm
            at = np.concatenate((np.zeros(3 if self.escape else 1, np.int64), at))
        return norm, np.append(at, len(b))

    def _step(self, b: bytes, i: int) -> tuple[int, bytes]:
        found = self.chars.longest(b, i)
        if found:
            return found
        c = b[i]
        n = 1 if c < 128 else 2 if c < 224 else 3 if c < 240 else 4
        return n, b[i:i + n]

    def encode(self, text: str) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """Ids, their decimal text (comma-joined), and each piece's start and end byte in the original text."""
        norm, at = self.normalise(text)
        ids: list[int] = []
        shown: list[str] = []
        known = self.known
        for part in self.parts.findall(norm):
            hit = known.get(part)
            if hit is None:
                own = self.bare.encode(part)
                hit = (own, ",".join(map(str, own)))
                if len(known) >= CACHE_PARTS:
                    known.clear()
                if len(part) < 200:
                    known[part] = hit
            ids += hit[0]
            shown.append(hit[1])
        ends = np.cumsum(self.n_bytes[ids]) if ids else np.zeros(0, np.int64)
        starts = np.concatenate((ends[:0] if not len(ends) else np.zeros(1, np.int64), ends[:-1]))
        return ids, ",".join(shown), at[starts], at[ends]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c not in new] + list(new)
    return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)


def _schema(df: DataFrame, added: str) -> T.StructType:
    extra = T._parse_datatype_string(added)
    return T.StructType([f for f in df.schema if f.name not in extra.names] + list(extra))


def encode(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Adds ``ids``, and ``starts`` and ``ends`` (original UTF-8 byte span of each piece)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    made: list[Encoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Encoder(shared.value))
        for batch in batches:
            rows = [made[0].encode(t or "") for t in batch.column(text).to_pylist()]
            yield _with(batch, {"ids": pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                                "starts": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                                "ends": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})

    return df.mapInArrow(lean(run), _schema(df, "ids array<int>, starts array<bigint>, ends array<bigint>"))


def decode(df: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of ``ids`` (null ids: empty text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    made: list[Encoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Encoder(shared.value))
        for batch in batches:
            yield _with(batch, {"decoded": pa.array([made[0].decode(x or []) for x in batch.column(ids).to_pylist()],
                                                    pa.string())})

    return df.mapInArrow(lean(run), _schema(df, "decoded string"))


def digest(df: DataFrame, model: bytes, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``n_bytes`` (original bytes the piece spans
    cover) from one pass of encoding and decoding; ``ids`` too where asked for."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    made: list[Encoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Encoder(shared.value))
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "ids")}
            for i in range(batch.num_rows):
                ids, shown, starts, ends = made[0].encode(batch.column(text)[i].as_py() or "")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(made[0].decode(ids).encode()).hexdigest())
                out["n_bytes"].append(int((ends - starts).sum()))
                out["ids"].append(np.array(ids, np.int32) if with_ids else None)
            new = {"n_tokens": pa.array(out["n_tokens"], pa.int64()), "ids_sha256": pa.array(out["ids_sha256"], pa.string()),
                   "decoded_sha256": pa.array(out["decoded_sha256"], pa.string()),
                   "n_bytes": pa.array(out["n_bytes"], pa.int64())}
            yield _with(batch.drop_columns([text]), new | (
                {"ids": pa.array(out["ids"], pa.list_(pa.int32()))} if with_ids else {}))
        made.clear()

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint" + ", ids array<int>" * with_ids
    return df.mapInArrow(lean(run), _schema(df.drop(text), added))
