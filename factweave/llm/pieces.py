"""Vocabulary of a SentencePiece model file, and the pre-tokens that its pieces never cross.

Reads the model's protobuf fields directly: pieces (field 1) with score and type, trainer (2) with
the model type, normaliser (3) with its flags. Character maps of normalisers are not supported;
a model that has one is refused.
"""

from __future__ import annotations

import re
import struct

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


class Pieces:
    """ids of pieces that segmentation may use, their scores, byte pieces, and the normaliser's flags."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.surface: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        self.model_type, self.dummy_prefix, self.squeeze = 1, True, True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.surface.append(piece.get(1, b"").decode("utf-8"))
                self.score.append(piece.get(2, 0.0))
                self.kind.append(piece.get(3, NORMAL))
            elif field == 2:
                self.model_type = dict(_fields(value)).get(3, 1)
            elif field == 3:
                flags = dict(_fields(value))
                if flags.get(2):
                    raise ValueError("normalisers with a character map are not supported")
                self.dummy_prefix, self.squeeze = bool(flags.get(3, 1)), bool(flags.get(4, 1))
        if self.squeeze:
            raise ValueError("removal of extra white space is not supported")
        self.usable = {s: i for i, (s, k) in enumerate(zip(self.surface, self.kind)) if k in (NORMAL, USER, UNUSED)}
        self.bytes = {int(s[3:5], 16): i for i, (s, k) in enumerate(zip(self.surface, self.kind)) if k == BYTE}
        self.unknown = self.kind.index(UNKNOWN)
        self.longest = max(map(len, self.usable))
        if any(MARK in s.lstrip(MARK) for s in self.usable):
            raise ValueError("pieces with a word mark inside are not supported")
        #: Characters that stand in no piece of two or more: each is a pre-token of its own.
        joined = {c for s in self.usable if len(s) > 1 for c in s}
        self.alone = [c for c in ("\n", "\t", "\r") if c not in joined]
        stop = "".join(self.alone)
        #: Spaces with a run of one class of characters; classes are Latin letters, digits, the rest.
        letters, digits = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9"
        fine = re.compile(f" *[{letters}]+| *[{digits}]+| *[^ {letters}{digits}{stop}]+| +" + (f"|[{stop}]" if stop else "")).findall
        coarse = re.compile(f" *[^ {stop}]+| +" + (f"|[{stop}]" if stop else "")).findall
        within = all(len(fine(s.replace(MARK, " "))) == 1 for s in self.usable)
        self.split = fine if within else coarse

    def pretokens(self, text: str | None) -> list[str]:
        """Pre-tokens of a text with spaces for word marks; joined they give the normalised text.

        No piece has a mark after another character, nor two classes of characters where the finer
        split is used, so none goes from one pre-token into the next.
        """
        if not text:
            return []
        # a mark in the text is the same symbol as a space
        text = text.replace(MARK, " ")
        return self.split(" " + text if self.dummy_prefix else text)

    def char_ids(self, char: str) -> list[int]:
        """Ids of one character that merges with nothing: its piece, or its bytes, or unknown."""
        char = MARK if char == " " else char
        if char in self.usable:
            return [self.usable[char]]
        if self.bytes:
            return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown]
