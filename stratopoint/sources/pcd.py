"""format("pcd"): ascii, binary and binary_compressed clouds, read in byte ranges."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from .files import read_range
from .records import Column, Layout
from .table import PointFile, PointSource, PointWriter, numeric


def expand(src: bytes, length: int) -> bytes:
    """Undo the LZF compression of a cloud body: literal runs and back references."""
    out = bytearray()
    i = 0
    while i < len(src) and len(out) < length:
        head = src[i]
        i += 1
        if head < 32:
            out += src[i:i + head + 1]
            i += head + 1
            continue
        run, high = head >> 5, head & 31
        if run == 7:
            run += src[i]
            i += 1
        back = (high << 8) + src[i] + 1
        i += 1
        start, run = len(out) - back, run + 2
        if start < 0:
            raise ValueError("back reference before the start of the data")
        piece = bytes(out[start:start + run])
        # a reference may reach into what it is writing: then its pattern repeats
        while len(piece) < run:
            piece += piece[:run - len(piece)]
        out += piece
    return bytes(out)


class PcdFile(PointFile):
    suffixes = (".pcd",)
    packed = ("rgb", "rgba")
    channels = {"red": ("red",), "green": ("green",), "blue": ("blue",)}
    scalar = ("intensity", "reflectivity")

    def layout(self, path: str) -> Layout:
        size, head = 1 << 16, b""
        while True:
            more = read_range(path, len(head), size)
            head += more
            found = self._parse(head)
            if found is not None:
                return found
            if not more:
                raise ValueError("header without a DATA line")

    def _parse(self, head: bytes) -> Layout | None:
        meta: dict[str, list[str]] = {}
        pos = 0
        while (end := head.find(b"\n", pos)) >= 0:
            words = head[pos:end].decode("ascii", "replace").split()
            pos = end + 1
            if not words or words[0].startswith("#"):
                continue
            meta[words[0].upper()] = words[1:]
            if words[0].upper() == "DATA":
                break
        else:
            return None
        names = meta.get("FIELDS", [])
        counts = [int(c) for c in meta.get("COUNT", ["1"] * len(names))]
        kinds = {"F": "f", "U": "u", "I": "i"}
        columns = [Column(n, f"<{kinds[t.upper()]}{s}", c) for n, t, s, c in zip(names, meta["TYPE"], meta["SIZE"], counts)]
        points = int(meta.get("POINTS", ["0"])[0]) or int(meta["WIDTH"][0]) * int(meta.get("HEIGHT", ["1"])[0])
        mode = {"ascii": "ascii", "binary": "binary", "binary_compressed": "compressed"}.get(meta["DATA"][0].lower())
        if mode is None:
            raise ValueError(f"unsupported DATA mode {meta['DATA'][0]!r}")
        lay = Layout(columns, points, pos, mode)
        self.roles(lay)
        return lay

    def sequential(self, path: str, layout: Layout, wanted: set[int]) -> dict[int, np.ndarray]:
        """Compressed clouds store one block per field; only the wanted blocks are decoded."""
        packed, full = struct.unpack("<II", read_range(path, layout.body, 8))
        raw = expand(read_range(path, layout.body + 8, packed), full)
        out, at = {}, 0
        for i, c in enumerate(layout.columns):
            n = layout.points * c.count
            if i in wanted:
                out[i] = np.frombuffer(raw, c.dtype, n, at).reshape(-1, c.count)
            at += n * np.dtype(c.dtype).itemsize
        return out


class PcdWriter(PointWriter):
    def __init__(self, options: dict[str, str], names: list[str]):
        super().__init__(options, names, ".pcd")
        self.fields = ["x", "y", "z"] + (["intensity"] if "intensity" in names else [])

    def header(self, n: int) -> bytes:
        k = len(self.fields)
        # The header lines of the 0.7 format.
        lines = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", f"FIELDS {' '.join(self.fields)}",
                 "SIZE" + " 4" * k, "TYPE" + " F" * k, "COUNT" + " 1" * k, f"WIDTH {n}", "HEIGHT 1",
                 "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA binary"]
        return ("\n".join(lines) + "\n").encode()

    def encode(self, batch: pa.RecordBatch) -> bytes:
        return np.column_stack([numeric(batch, f, "<f4") for f in self.fields]).astype("<f4").tobytes()


class PcdSource(PointSource):
    fmt = PcdFile()
    writer_class = PcdWriter

    @classmethod
    def name(cls) -> str:
        return "pcd"
