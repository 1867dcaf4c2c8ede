"""Binary point messages from coordinates: what a recorder would have stored."""

from __future__ import annotations

import struct

import numpy as np


class _Out:
    def __init__(self, little: bool):
        self.order = "<" if little else ">"
        self.buf = bytearray([0, 1 if little else 0, 0, 0])

    def number(self, code: str, value: int, size: int = 4) -> None:
        self.buf += b"\0" * (-(len(self.buf) - 4) % size)
        self.buf += struct.pack(self.order + code, value)

    def text(self, value: str) -> None:
        self.number("I", len(value) + 1)
        self.buf += value.encode() + b"\0"


def point_message(xyz: np.ndarray, intensity: np.ndarray | None = None, little: bool = True) -> bytes:
    """n x 3 coordinates (and intensities) as one message with single-precision fields."""
    out = _Out(little)
    names = ["x", "y", "z"] + (["intensity"] if intensity is not None else [])
    out.number("i", 0), out.number("I", 0), out.text("map")
    out.number("I", 1), out.number("I", len(xyz)), out.number("I", len(names))
    for k, name in enumerate(names):
        out.text(name), out.number("I", 4 * k), out.number("B", 7, 1), out.number("I", 1)
    step = 4 * len(names)
    out.number("B", 0, 1), out.number("I", step), out.number("I", step * len(xyz))
    table = xyz if intensity is None else np.column_stack([xyz, intensity])
    data = np.ascontiguousarray(table, "<f4").tobytes()
    out.number("I", len(data))
    out.buf += data + b"\x01"
    return bytes(out.buf)
