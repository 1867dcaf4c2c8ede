"""format("ply"): ascii and both binary encodings; vertex records are read in byte ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .files import read_range
from .records import Column, Layout
from .table import PointFile, PointSource, PointWriter, numeric

# Property type names and their storage.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


class Element:
    def __init__(self, name: str, count: int):
        self.name, self.count = name, count
        self.props: list[tuple[str, str, str | None]] = []   # name, item type, count type of a list

    @property
    def fixed(self) -> bool:
        return all(c is None for _, _, c in self.props)

    def stride(self) -> int:
        return sum(np.dtype(t).itemsize for _, t, _ in self.props)


class PlyFile(PointFile):
    suffixes = (".ply",)
    channels = {"red": ("red", "r", "diffuse_red"), "green": ("green", "g", "diffuse_green"), "blue": ("blue", "b", "diffuse_blue")}
    scalar = ("intensity", "scalar_intensity", "gray", "scalar_field", "quality")
    float_colour = True

    def layout(self, path: str) -> Layout:
        head = b""
        while b"end_header" not in head or b"\n" not in head[head.index(b"end_header"):]:
            more = read_range(path, len(head), 1 << 16)
            if not more:
                raise ValueError("header without end_header")
            head += more
        body = head.index(b"\n", head.index(b"end_header")) + 1
        fmt, elements = "ascii", []
        for line in head[:body].decode("ascii", "replace").splitlines():
            w = line.split()
            if w[:1] == ["format"]:
                fmt = w[1]
            elif w[:1] == ["element"]:
                elements.append(Element(w[1], int(w[2])))
            elif w[:1] == ["property"] and elements:
                is_list = w[1] == "list"
                elements[-1].props.append((w[-1].lower(), TYPES[w[3] if is_list else w[1]], TYPES[w[2]] if is_list else None))
        at = next((i for i, e in enumerate(elements) if e.name == "vertex"), None)
        if at is None:
            raise ValueError("no vertex element")
        vertex, ahead = elements[at], elements[:at]
        order = "" if fmt == "ascii" else "<" if fmt == "binary_little_endian" else ">"
        columns = [Column(n, order + t) for n, t, c in vertex.props if c is None]
        lay = Layout(columns, vertex.count, body, "ascii" if fmt == "ascii" else "binary", [(e.count, e) for e in ahead])
        if fmt == "ascii":
            # other elements share the line stream with the points: only then read it in one go
            if not vertex.fixed or len(elements) > 1:
                lay.mode = "sequential"
        elif vertex.fixed and all(e.fixed for e in ahead):
            lay.body += sum(e.count * e.stride() for e in ahead)
            lay.before = []
        else:
            lay.mode = "sequential"
        lay.vertex, lay.order = vertex, order
        self.roles(lay)
        return lay

    def sequential(self, path: str, layout: Layout, wanted: set[int]) -> dict[int, np.ndarray]:
        """Files with list properties at or ahead of the points have to be walked through."""
        raw = read_range(path, layout.body)
        if layout.order == "":
            return self._walk_text(raw, layout, wanted)
        pos = 0
        for n, e in layout.before:
            pos = self._skip(raw, pos, n, e, layout.order)
        vertex = layout.vertex
        if vertex.fixed:
            dt = layout.dtype()
            rec = np.frombuffer(raw, dt, min(layout.points, (len(raw) - pos) // dt.itemsize), pos)
            return {i: rec[f"f{i}"] for i in wanted}
        values = {i: [] for i in wanted}
        for _ in range(layout.points):
            k = 0
            for _, t, count in vertex.props:
                item = np.dtype(layout.order + t)
                if count is None:
                    if k in values:
                        values[k].append(np.frombuffer(raw, item, 1, pos)[0])
                    pos += item.itemsize
                    k += 1
                else:
                    pos = self._skip_list(raw, pos, count, item, layout.order)
        return {i: np.array(v) for i, v in values.items()}

    @staticmethod
    def _skip_list(raw: bytes, pos: int, count: str, item: np.dtype, order: str) -> int:
        c = np.dtype(order + count)
        return pos + c.itemsize + int(np.frombuffer(raw, c, 1, pos)[0]) * item.itemsize

    def _skip(self, raw: bytes, pos: int, n: int, e: Element, order: str) -> int:
        if e.fixed:
            return pos + n * e.stride()
        for _ in range(n):
            for _, t, count in e.props:
                item = np.dtype(order + t)
                pos = pos + item.itemsize if count is None else self._skip_list(raw, pos, count, item, order)
        return pos

    @staticmethod
    def _walk_text(raw: bytes, layout: Layout, wanted: set[int]) -> dict[int, np.ndarray]:
        values = {i: [] for i in wanted}
        lines = [ln for ln in raw.splitlines()][sum(n for n, _ in layout.before):]
        for line in [ln for ln in lines if ln.strip()][:layout.points]:
            tokens, at, k = line.split(), 0, 0
            for _, _, count in layout.vertex.props:
                if count is None:
                    if k in values:
                        values[k].append(float(tokens[at]))
                    at, k = at + 1, k + 1
                else:
                    at += 1 + int(tokens[at])
        return {i: np.array(v) for i, v in values.items()}


class PlyWriter(PointWriter):
    """x, y, z in single precision and, when given, red, green, blue as bytes."""

    def __init__(self, options: dict[str, str], names: list[str]):
        super().__init__(options, names, ".ply")
        self.colour = all(c in names for c in ("red", "green", "blue"))

    def header(self, n: int) -> bytes:
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property float {c}" for c in "xyz"]]
        if self.colour:
            lines += [f"property uchar {c}" for c in ("red", "green", "blue")]
        return ("\n".join([*lines, "end_header"]) + "\n").encode()

    def encode(self, batch: pa.RecordBatch) -> bytes:
        kinds = [(c, "<f4") for c in "xyz"] + [(c, "u1") for c in ("red", "green", "blue") if self.colour]
        rec = np.zeros(batch.num_rows, kinds)
        for name, dtype in kinds:
            rec[name] = numeric(batch, name, dtype)
        return rec.tobytes()


class PlySource(PointSource):
    fmt = PlyFile()
    writer_class = PlyWriter

    @classmethod
    def name(cls) -> str:
        return "ply"
