"""Byte-level BPE ids of whole texts, with a bounded memory of units already encoded."""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import regex
from tokenizers import Tokenizer

#: units (a space and the letters up to the next space) in either generation of a Python worker's memory
REMEMBERED_UNITS = 800_000

#: fixed values of byte-level BPE: how a text is cut before its merges
CUT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_TWO_SPACES = re.compile(r"\s\s")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class ByteEncoder:
    """Ids of the tokenizer file at ``path``, as little-endian unsigned integers of ``dtype``.

    The result is that of the library's ``encode(text, add_special_tokens=False)``. A text is cut
    at single spaces, where the tokenizer cuts as well; each unit is encoded by the library once and
    remembered; what is not met while one generation of the memory fills goes with the next. Texts with white space beside white space or with a special token in them, and files
    of another kind, are handed to the library whole.
    """

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.library = Tokenizer.from_str(raw.decode())
        self.model = self.library.model  # each look at the library's makes another handle
        told = json.loads(raw)
        cut = told.get("pre_tokenizer") or {}
        self.plain = (
            told.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and not cut.get("add_prefix_space")
            and cut.get("use_regex", True)
            and told["model"]["type"] == "BPE"
        )
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.marks = {mark: self._merged(mark) for mark in ",."} if self.plain else {}
        self.after_space = _AfterSpace(self)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain or any(s in text for s in self.special):
            return self._whole(text)
        first, *rest = text.split(" ")
        units = map(self.after_space.__getitem__, rest)
        # a unit with white space at its end or beside other is None, on which join gives up
        if first and _odd(first):
            return self._whole(text)
        try:
            packed = b"".join(units)
        except TypeError:
            return self._whole(text)
        return self.piece(first) + packed if first else packed

    def _whole(self, text: str) -> bytes:
        return self._pack(self.library.encode(text, add_special_tokens=False).ids)

    def piece(self, unit: str) -> bytes:
        """Ids of a unit without a space in front of it, or of one with."""
        return b"".join([self._merged(piece) for piece in CUT.findall(unit)])

    def _merged(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(mapped)])


def _odd(unit: str) -> bool:
    """Empty, or with white space at an end or beside other: the tokenizer may cut elsewhere."""
    return not unit or unit[0].isspace() or unit[-1].isspace() or _TWO_SPACES.search(unit) is not None


class _AfterSpace(dict):
    """Unit without the space in front of it to its ids: a young generation, and the one before."""

    def __init__(self, owner: ByteEncoder):
        self.owner = owner
        self.old: dict[str, bytes | None] = {}

    def __missing__(self, unit: str) -> bytes | None:
        if len(self) >= REMEMBERED_UNITS:
            self.old = dict(self)
            self.clear()
        packed = self.old.get(unit)
        if packed is None:
            body, last = unit[:-1], unit[-1:]
            if unit.isalpha():
                packed = self.owner._merged(" " + unit)
            elif last in ",." and body.isalpha():
                # the tokenizer cuts between a letter and a mark
                packed = self[body] + self.owner.marks[last]
            elif _odd(unit):
                packed = None
            else:
                packed = self.owner.piece(" " + unit)
        self[unit] = packed
        return packed


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]
