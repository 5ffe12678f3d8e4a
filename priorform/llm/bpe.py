"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Every byte is mapped to one printable character, every token of the rank file becomes a piece whose score
is its negative rank, and the normaliser is the identity. Sentencepiece then merges, inside one pre-token,
the adjacent pair whose union has the lowest rank, leftmost first. The model is at most a few MB (it is the
vocabulary) and travels inside the task's closure; nothing is written to a disk.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import regex
import sentencepiece
from pyspark.sql import DataFrame

from priorform.llm._common import map_arrow, text_bytes

REMEMBERED = 300_000  # pre-tokens, and stretches, a worker keeps
LONGEST_REMEMBERED = 64


def byte_characters() -> list[str]:
    """One visible character per byte: itself where printable, else the next one from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece i is the token of rank i, one unused piece stands for the unknown.

    Field numbers (fixed by the public model format): pieces 1 (piece 1, score 2, type 3: 1 normal, 2 unknown,
    5 unused), trainer 2 (model type 3: 2 is BPE), normaliser 3 (name 1, dummy prefix 3, extra blanks 4,
    escaped blanks 5).
    """
    chars = byte_characters()
    size = max(ranks.values(), default=-1) + 1
    by_rank: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        by_rank[rank] = token
    out = bytearray()
    for rank, token in enumerate(by_rank):
        piece, kind = (f"<hole {rank}>", 5) if token is None else ("".join(chars[b] for b in token), 1)
        out += _field(1, _field(1, piece.encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _flag(3, kind))
    out += _field(1, _field(1, b"<unknown>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2))
    out += _field(2, _flag(3, 2))
    out += _field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))
    return bytes(out)


def stretches_of(text: str) -> list[str]:
    """The text cut before every blank that a character other than white space follows.

    With a pattern whose matches hold a blank before anything but white space only at their start, and whose
    white space gives back its last character before other text, matches never cross such a cut. So a stretch
    has the same matches alone, and frequent stretches need the pattern only once.
    """
    pieces = text.split(" ")
    out = [pieces[0]]
    for p in pieces[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


class Codec:
    """Encodes and decodes texts with one model. ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, proto: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.cut = regex.compile(pattern).findall
        chars = byte_characters()
        self.visible = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.token: list[bytes] = []
        self.whole: dict[str, bytes] = {}
        for i in range(self.model.get_piece_size() - 1):
            if self.model.is_unused(i):
                self.token.append(b"")
                continue
            token = bytes(back[c] for c in self.model.id_to_piece(i))
            self.token.append(token)
            try:  # a pre-token that is a token stays whole
                self.whole[token.decode()] = struct.pack("<I", i)
            except UnicodeDecodeError:
                pass
        self.tokens_of: dict[str, bytes] = {}  # packed ids of pre-tokens
        self.stretches: dict[str, bytes] = {}  # and of stretches

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, some, held = [], [], 0
        for text in texts:
            some.append(stretches_of(text))
            held += len(some[-1])
            if held > REMEMBERED:
                out += self._pack(some)
                some, held = [], 0
        return out + self._pack(some)

    def _pack(self, texts: list[list[str]]) -> list[bytes]:
        if len(self.stretches) > REMEMBERED:
            self.stretches = {}
        if len(self.tokens_of) > REMEMBERED:
            self.tokens_of = {}
        new = {s for t in texts for s in t} - self.stretches.keys()
        cuts = {s: self.cut(s) for s in new}
        todo = [p for p in {p for c in cuts.values() for p in c} if p not in self.whole and p not in self.tokens_of]
        mapped = [p.encode().decode("latin-1").translate(self.visible) for p in todo]
        fresh = {p: struct.pack(f"<{len(ids)}I", *ids) for p, ids in zip(todo, self.model.encode(mapped, num_threads=1) if todo else ())}
        look = {**self.whole, **self.tokens_of, **fresh}
        long = {}
        for s, parts in cuts.items():
            (self.stretches if len(s) <= LONGEST_REMEMBERED else long)[s] = b"".join([look[p] for p in parts])
        self.tokens_of.update((p, ids) for p, ids in fresh.items() if len(p) <= LONGEST_REMEMBERED)
        if long:
            look = {**self.stretches, **long}
            return [b"".join([look[s] for s in t]) for t in texts]
        return [b"".join(map(self.stretches.__getitem__, t)) for t in texts]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(packed).cast("I") if packed else ()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(proto: bytes, pattern: str) -> Codec:
    """One codec per worker process and model."""
    key = (hashlib.sha256(proto).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(proto, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids binary, decoded binary``: ids as little-endian unsigned 32-bit integers, and the decoded bytes.

    One row per input row, repeated rows included. A null text is an empty one: no ids, no bytes. Texts are
    encoded whole at any length. Other columns of ``docs`` are not read.
    """
    proto = model_proto(ranks)

    def run(cols):
        c = codec(proto, pattern)
        ids = c.packed([t or "" for t in cols["text"]])
        return {"id": cols["id"], "ids": ids, "decoded": [c.decode(p) for p in ids]}

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_arrow(source, run, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode`, digested where the ids are made."""
    proto = model_proto(ranks)

    def run(cols):
        c = codec(proto, pattern)
        ids = c.packed([t or "" for t in cols["text"]])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {
            "id": cols["id"],
            "n_tokens": [len(p) // 4 for p in ids],
            "ids_sha256": [sha(p) for p in ids],
            "decoded_sha256": [sha(c.decode(p)) for p in ids],
        }

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(source, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
