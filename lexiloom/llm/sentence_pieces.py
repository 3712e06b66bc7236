"""SentencePiece encoding with byte offsets, and decoding.

A model file holds a compiled character map: a double-array trie over byte strings and the replacements it points to.
Normalisation takes the longest prefix of the remaining text that the trie holds, writes its replacement, and records
for each normalised byte where in the text it comes from. Pieces are found on the normalised text, so running sums of
their lengths, looked up in that record, are the byte spans of the original text.

Merges are left to the ``sentencepiece`` library, which encodes the texts of a batch. Encoding is per row: one scan, no
shuffle, and nothing but the model (a fixed file) is shipped to tasks. Decoding gives back the library's text.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import map_texts, table

MARK = "▁"
#: Piece types of the model format.
NORMAL, BYTE_PIECE = 1, 6


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else number(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """The compiled character map: longest-prefix replacement with alignment."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement of the longest key at ``at``, and the key's length; None if no key starts there."""
        if not self.units:
            return None
        offset = lambda unit: (unit >> 10) << ((unit & 1 << 9) >> 6)
        node, found = offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & (1 << 31 | 255) != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        return self.strings[found[0] : self.strings.index(b"\0", found[0])], found[1]


class PieceModel:
    """A model file: the character map, the whitespace rules, and the library's encoder."""

    def __init__(self, model: bytes):
        import sentencepiece

        pieces, spec = [], {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), piece.get(3, NORMAL)))
            elif field == 3:
                spec = dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.is_byte = np.array([kind == BYTE_PIECE for _, kind in pieces])
        self.surface = [self._bytes(p, kind == BYTE_PIECE) for p, kind in pieces]
        self.piece_bytes = np.array(list(map(len, self.surface)))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)

    @staticmethod
    def _bytes(piece: str, is_byte: bool) -> bytes:
        return bytes([int(piece[3:5], 16)]) if is_byte else piece.encode()

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) its place in ``text``."""
        space, mark = b" ", MARK.encode()
        if not self.map.units and not self.squeeze:  # nothing but spaces changes
            if not text:
                return b"", np.array([0])
            mark = mark if self.escape else space
            grown = np.where(np.frombuffer(text, np.uint8) == 0x20, len(mark), 1)
            lead = len(mark) if self.dummy else 0
            origin = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(text)), grown), [len(text)]])
            return mark[:lead] + text.replace(space, mark), origin
        out, origin, at = bytearray(), [], 0

        def put(piece: bytes, source: int) -> None:
            piece = piece.replace(space, mark) if self.escape else piece
            out.extend(piece)
            origin.extend([source] * len(piece))

        def step(at: int) -> tuple[bytes, int]:
            found = self.map.longest(text, at)
            if found:
                return found
            size = 1 + (text[at] >= 0xC0) + (text[at] >= 0xE0) + (text[at] >= 0xF0)
            try:
                text[at : at + size].decode()
            except UnicodeDecodeError:
                return "�".encode(), 1
            return text[at : at + size], size

        if self.squeeze:
            while at < len(text) and (first := step(at))[0].strip(space) == b"":
                at += first[1]
        if at == len(text):
            return b"", np.array([at])
        if self.dummy:
            put(space, at)
        after_space = self.squeeze
        while at < len(text):
            piece, size = step(at)
            if after_space:
                piece = piece.lstrip(space)
            put(piece, at)
            after_space = self.squeeze and (piece.endswith(space) or (after_space and not piece))
            at += size
        if self.squeeze:
            tail = mark if self.escape else space
            while out.endswith(tail):
                at = origin[len(out) - len(tail)]
                del out[-len(tail) :], origin[-len(tail) :]
        return bytes(out), np.array([*origin, at])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, as the library merges them."""
        return self.library.encode(texts, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray, bool]:
        """First and last (exclusive) byte of the text that each id stands for, and whether the pieces spell the normalised text."""
        normal, origin = self.normalise(text.encode())
        spelt = b"".join([self.surface[i] for i in ids])
        sizes = self.piece_bytes[ids] if ids else np.zeros(0, int)
        if spelt != normal:  # unknown pieces take what the library says they cover
            proto = self.library.encode(text, return_type="proto")
            surface = [self._bytes(p.piece, bool(self.is_byte[p.id])) for p in proto.pieces]
            spelt, sizes = b"".join(surface), np.array(list(map(len, surface)), int)
        ends = np.cumsum(sizes)
        begins, ends = (np.minimum(x, len(normal)) for x in (ends - sizes, ends))
        return origin[begins], origin[ends], spelt == normal


_models: dict[bytes, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    """One model a Python worker."""
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models[key] = PieceModel(data)
    return _models[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(arrays: list[np.ndarray]):
    """An Arrow list array of integer arrays, without a Python object a number."""
    import pyarrow as pa

    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(arrays).astype(np.int32))


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with ids, begins and ends, array<int> each (byte offsets, end exclusive), and aligned.

    ``aligned``: the library's pieces, put together, are the normalised text that the offsets are taken from.
    Null and empty texts give empty arrays. Rows are independent: repeated rows stay, nulls in other columns pass.
    Columns named like the new ones are replaced.
    """

    def run(texts: list[bytes]) -> dict:
        m = _model(model)
        out: dict[str, list] = {"ids": [], "begins": [], "ends": [], "aligned": []}
        strings = [t.decode() for t in texts]
        for text, ids in zip(strings, m.encode(strings), strict=True):
            begins, ends, aligned = m.spans(text, ids)
            for name, value in (("ids", ids), ("begins", begins), ("ends", ends), ("aligned", aligned)):
                out[name].append(value)
        return out | {name: _lists(out[name]) for name in ("begins", "ends")}

    return map_texts(docs, run, "ids array<int>, begins array<int>, ends array<int>, aligned boolean", text_col, 1 << 18)


def decode_documents(encoded: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``text``, decoded from its ids; null or empty ids give an empty text."""

    def run(batches):
        import pyarrow as pa

        m = _model(model)
        for batch in (b.slice(first, 256) for b in batches for first in range(0, b.num_rows, 256)):
            ids = batch.column(ids_col)
            flat, cut = ids.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()]).tolist()
            texts = m.library.decode([flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], num_threads=1)
            columns = {f: batch.column(f) for f in batch.schema.names if f != "text"} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kept = encoded.drop("text")
    return kept.mapInArrow(run, kept.withColumn("text", F.lit("")).schema)


def digest_documents(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with n_tokens, aligned and the digests of ids, spans and decoded text.

    ids_sha256 is of the ids joined by commas, spans_sha256 of ``begins;ends`` joined likewise, decoded_sha256 of the
    text that the ids give back. All are made from what ``encode_documents`` and ``decode_documents`` return.
    """
    joined = lambda name: F.array_join(F.col(name).cast("array<string>"), ",")
    spans = F.sha2(F.concat(joined("begins"), F.lit(";"), joined("ends")), 256)
    added = {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(joined("ids"), 256), "spans_sha256": spans}
    encoded = encode_documents(docs, model, text_col).withColumns(added).drop("begins", "ends")
    return decode_documents(encoded, model).withColumn("decoded_sha256", F.sha2("text", 256)).drop("ids", "text")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
