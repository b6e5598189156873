"""A SentencePiece model file: its protobuf fields, and where texts can be cut without changing the tokens."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire_fields(data: bytes):
    """(field number, value) of a protobuf message: ints, 4 or 8 raw bytes, or the bytes of a submessage."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """Pieces with scores and types, the kind of model, and the normaliser's switches."""

    raw: bytes
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @staticmethod
    def parse(raw: bytes) -> PieceModel:
        model = PieceModel(raw)
        for number, value in wire_fields(raw):
            if number == 1:
                piece = dict(wire_fields(value))
                model.pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(wire_fields(value))
                model.kind, model.byte_fallback, model.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            elif number == 3:
                spec = dict(wire_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.squeeze_spaces, model.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return model

    @staticmethod
    def load(path: str) -> PieceModel:
        with open(path, "rb") as f:
            return PieceModel.parse(f.read())

    def words_are_independent(self) -> bool:
        """Whether a text may be cut before each run of space marks and its parts encoded alone.

        True for BPE models that normalise nothing and have no piece with a space mark after another
        character: no merge can then reach across such a cut.
        """
        plain = self.kind == BPE and not self.charsmap and not self.squeeze_spaces and self.escape_spaces
        return plain and not any(SPACE in p.lstrip(SPACE) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED))

    def without_dummy_prefix(self) -> bytes:
        """The model with add_dummy_prefix off: a later submessage overrides the fields it names."""
        return self.raw + b"\x1a\x02\x18\x00"


_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def chunks(text: str, dummy_prefix: bool = True) -> list[str]:
    """The parts of a text with spaces as marks, cut before every run of marks; joined they are the whole text."""
    text = text.replace(" ", SPACE)
    return _CHUNK.findall(SPACE + text if dummy_prefix and text else text)
