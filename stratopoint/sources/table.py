"""The part PCD and PLY share: schema, column pruning, partitions, writing."""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from .files import list_files, open_fs, publish, published, read_range, replace_file, size_of
from .records import SPARK_TYPES, Chunk, Layout, batches, chunks, kind, to_arrow, unpack_colour

DEFAULT_SPLIT = 128 << 20


class PointFile:
    """Format hooks; subclasses know their header and their sequential encodings."""

    suffixes: tuple[str, ...] = ()
    packed: tuple[str, ...] = ()                 # fields holding 0x00RRGGBB
    channels: dict[str, tuple[str, ...]] = {}    # red/green/blue -> accepted names
    scalar: tuple[str, ...] = ()                 # accepted names of the intensity, best first

    def layout(self, path: str) -> Layout:
        raise NotImplementedError

    def sequential(self, path: str, layout: Layout, wanted: set[int]) -> dict[int, np.ndarray]:
        """Columns of a file that has no fixed record stride."""
        raise NotImplementedError

    # ------------------------------------------------------------- columns

    def roles(self, layout: Layout) -> dict[str, tuple[str, int]]:
        """Output column -> (how to make it, index of the stored field)."""
        names = [c.name.lower() for c in layout.columns]
        out: dict[str, tuple[str, int]] = {}
        for axis in "xyz":
            if axis not in names:
                raise ValueError("point file without x, y and z")
            out[axis] = ("double", names.index(axis))
        used = {names.index(a) for a in "xyz"}
        rgb = {c: next((names.index(n) for n in self.channels[c] if n in names), None) for c in self.channels}
        if rgb and all(i is not None for i in rgb.values()):
            for c, i in rgb.items():
                out[c] = ("channel", i)
                used.add(i)
        else:
            p = next((names.index(n) for n in self.packed if n in names), None)
            if p is not None:
                for k, c in enumerate(("red", "green", "blue")):
                    out[c] = (f"packed{k}", p)
                used.add(p)
        s = next((names.index(n) for n in self.scalar if n in names), None)
        if s is not None:
            out["intensity"] = ("float", s)
            used.add(s)
        for i, n in enumerate(names):
            if i not in used and n not in out:
                out[n] = ("raw", i)
        return out

    def schema(self, layout: Layout, only: list[str] | None) -> T.StructType:
        fields = [T.StructField("file", T.StringType()), T.StructField("point_id", T.LongType())]
        for name, (how, i) in self.roles(layout).items():
            c = layout.columns[i]
            t = {"double": T.DoubleType(), "float": T.FloatType(), "raw": SPARK_TYPES[kind(c.dtype)]}.get(how, T.ShortType())
            fields.append(T.StructField(name, T.ArrayType(t) if how == "raw" and c.count > 1 else t))
        return T.StructType([f for f in fields if not only or f.name in only])

    def batch(self, names: list[str], path: str, ids: np.ndarray, layout: Layout, get) -> pa.RecordBatch:
        """Arrow batch of the wanted columns; ``get(i)`` gives the values of stored field i."""
        roles = self.roles(layout)
        cols = []
        for n in names:
            if n == "file":
                cols.append(pa.array([posixpath.basename(path)] * len(ids)))
            elif n == "point_id":
                cols.append(pa.array(ids, pa.int64()))
            else:
                how, i = roles[n]
                v, c = get(i), layout.columns[i]
                first = v[:, 0] if v.ndim == 2 else v
                if how == "double":
                    cols.append(pa.array(first.astype(np.float64)))
                elif how == "float":
                    cols.append(pa.array(first.astype(np.float32)))
                elif how == "channel":
                    k = kind(c.dtype)
                    scaled = np.floor(first.astype(float) * 255 + 0.5) if k.startswith("f") and self.float_colour else first
                    cols.append(pa.array(scaled.astype(np.int16)))
                elif how.startswith("packed"):
                    cols.append(pa.array(unpack_colour(first, c.dtype)[int(how[-1])]))
                else:
                    cols.append(to_arrow(v, c.dtype))
        return pa.RecordBatch.from_arrays(cols, names)

    float_colour = False


def merged_schema(schemas: list[T.StructType]) -> T.StructType:
    """All columns of all files in the order they are met; numbers of different types become doubles."""
    types: dict[str, T.DataType] = {}
    for f in (f for s in schemas for f in s):
        old = types.setdefault(f.name, f.dataType)
        if old != f.dataType:
            if isinstance(old, T.ArrayType) != isinstance(f.dataType, T.ArrayType):
                raise ValueError(f"column {f.name} is a list in some files and a number in others")
            types[f.name] = T.ArrayType(T.DoubleType()) if isinstance(old, T.ArrayType) else T.DoubleType()
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def fitted(batch: pa.RecordBatch, schema: T.StructType) -> pa.RecordBatch:
    """A file's batch in the columns of the whole dataset; what the file does not have is null."""
    target = to_arrow_schema(schema)
    have = set(batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name in have else pa.nulls(len(batch), f.type) for f in target], schema=target)


def numbered(chunks_: list[Chunk], counts: list[int], limits: dict[str, int]) -> list[Chunk]:
    """Chunks with the point_ids of one running count over all files; a file gives its declared number at most."""
    out, total, inside = [], 0, dict.fromkeys(limits, 0)
    for c, n in zip(chunks_, counts):
        take = max(0, min(n, limits[c.path] - inside[c.path]))
        out.append(Chunk(c.path, c.start, c.end, total, take))
        total, inside[c.path] = total + take, inside[c.path] + n
    return out


class PointReader(DataSourceReader):
    """Reads chunks. ``format(..)`` plans them from the headers alone: binary files in ranges of records, an ascii
    file in one chunk. ``read_points`` counts the records of ascii ranges in tasks and so splits them as well."""

    def __init__(self, fmt: PointFile, options: dict[str, str], schema: T.StructType):
        self.fmt, self.options, self.schema, self.names = fmt, options, schema, [f.name for f in schema.fields]

    def partitions(self):
        split = int(self.options.get("splitbytes", DEFAULT_SPLIT))
        paths = list_files(self.options["path"], self.fmt.suffixes)
        with ThreadPoolExecutor(16) as pool:
            planned = list(pool.map(lambda path: self.planned(path, split), paths))
        found = [c for chunks_, _, _ in planned for c in chunks_]
        return numbered(found, [n for _, counts, _ in planned for n in counts], {p: limit for p, (_, _, limit) in zip(paths, planned)})

    def planned(self, path: str, split: int) -> tuple[list[Chunk], list[int], int]:
        """Chunks of one file, their record counts as far as the header tells, and the declared number."""
        lay = self.fmt.layout(path)
        if lay.mode == "binary":
            stride = lay.dtype().itemsize
            n = min(lay.points, (size_of(path) - lay.body) // stride)
            parts = chunks(path, n, stride, split)
            return parts, [c.end - c.start for c in parts], lay.points
        if lay.mode == "ascii":
            return [Chunk(path, lay.body, size_of(path))], [lay.points], lay.points
        return [Chunk(path, 0, lay.points)], [lay.points], lay.points

    def read(self, part: Chunk) -> Iterator[pa.RecordBatch]:
        lay = self.fmt.layout(part.path)
        mine = set(self.fmt.roles(lay)) | {"file", "point_id"}
        names = [n for n in self.names if n in mine]
        for batch in self._batches(part, lay, names):
            yield fitted(batch, self.schema)

    def _batches(self, part: Chunk, lay: Layout, names: list[str]) -> Iterator[pa.RecordBatch]:
        if lay.mode == "binary":
            dt = lay.dtype()
            for a, b in batches(part.end - part.start):
                raw = read_range(part.path, lay.body + (part.start + a) * dt.itemsize, (b - a) * dt.itemsize)
                rec = np.frombuffer(raw, dt)
                ids = np.arange(part.first_id + a, part.first_id + a + len(rec))
                yield self.fmt.batch(names, part.path, ids, lay, lambda i: rec[f"f{i}"])
        elif lay.mode == "ascii":
            at = np.cumsum([0] + [c.count for c in lay.columns])
            seen = 0
            for rows in self.lines(part, lay):
                rows = rows if part.take < 0 else rows[: part.take - seen]
                if not rows:
                    return
                yield self._rows(rows, np.arange(part.first_id + seen, part.first_id + seen + len(rows)), lay, at, part.path, names)
                seen += len(rows)
        else:
            roles = self.fmt.roles(lay)
            cols = self.fmt.sequential(part.path, lay, {i for n, (_, i) in roles.items() if n in names} or {0})
            for a, b in batches(len(next(iter(cols.values())))):
                yield self.fmt.batch(names, part.path, np.arange(part.first_id + a, part.first_id + b), lay, lambda i: cols[i][a:b])

    @staticmethod
    def lines(part: Chunk, lay: Layout) -> Iterator[list[list[bytes]]]:
        """Records of a byte range of an ascii file: the lines that begin in it and have enough values."""
        fs, p = open_fs(part.path)
        width = sum(c.count for c in lay.columns)
        with fs.open_input_file(p) as raw:
            raw.seek(part.start if part.start == lay.body else part.start - 1)
            stream = io.BufferedReader(_Readable(raw), 1 << 20)
            pos = raw.tell()
            if part.start != lay.body:
                pos += len(stream.readline())   # the line crossing the border belongs to the range before
            rows = []
            while pos < part.end and (line := stream.readline()):
                pos += len(line)
                tokens = line.split()
                if len(tokens) >= width:
                    rows.append(tokens[:width])
                if len(rows) == 20_000:
                    yield rows
                    rows = []
            if rows:
                yield rows

    def _rows(self, rows, ids, lay, at, path, names):
        text = np.array(rows)

        def get(i: int) -> np.ndarray:
            c = lay.columns[i]
            block = text[:, at[i]:at[i + 1]]
            if kind(c.dtype).startswith("f"):
                return block.astype(np.float64).astype(c.dtype) if kind(c.dtype) == "f4" and self._is_packed(lay, i) else block.astype(np.float64)
            return np.array([[int(float(v)) if b"." in v or b"e" in v.lower() else int(v) for v in r] for r in block]).astype(c.dtype)

        return self.fmt.batch(names, path, ids, lay, get)

    def _is_packed(self, lay: Layout, i: int) -> bool:
        return any(how.startswith("packed") and k == i for how, k in self.fmt.roles(lay).values())


class _Readable(io.RawIOBase):
    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.f.read(len(b))
        b[:len(data)] = data
        return len(data)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int
    start: int | None


class PointWriter(DataSourceArrowWriter):
    """Every task writes a body; ``single`` joins them into one file, else each becomes a file of a folder.

    Two phases. A task attempt writes below a hidden folder of its job, under a name of its own. The commit knows from the
    messages which attempt of every part counts: only those files are moved into the target, then the list of the
    target's files is replaced as a whole, and only then files that are no longer named go. Attempts that were lost,
    repeated or late stay in the hidden folder, and a commit that is cut off leaves the old list in place, so a
    reader sees all of a write or nothing of it. Commits into one folder must not run at the same time.

    The folder form is the one to use on a cluster. The joined form copies bytes
    part by part in the commit, in order of the lowest point_id of each part.
    """

    overwrite = False

    def __init__(self, options: dict[str, str], names: list[str], suffix: str):
        self.path, self.names, self.suffix = options["path"].rstrip("/"), names, suffix
        self.single = options.get("single", "false").lower() == "true"
        self.job = uuid.uuid4().hex[:12]

    def header(self, n: int) -> bytes:
        raise NotImplementedError

    def encode(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def attempts(self) -> str:
        """The hidden folder of this job."""
        return f"{self.path}._parts-{self.job}" if self.single else f"{self.path}/_attempts-{self.job}"

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, folder = open_fs(self.attempts())
        fs.create_dir(folder, recursive=True)
        name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}"
        target = posixpath.join(folder, name)
        rows, start = 0, None
        with fs.open_output_stream(target + ".body") as out:
            for batch in iterator:
                if batch.num_rows:
                    out.write(self.encode(batch))
                    rows += batch.num_rows
                    if "point_id" in batch.schema.names:
                        low = int(np.min(batch.column("point_id").to_numpy(zero_copy_only=False)))
                        start = low if start is None else min(start, low)
        if self.single:
            return Written(name + ".body", rows, start)
        if rows:
            with fs.open_output_stream(target + self.suffix) as out, fs.open_input_file(target + ".body") as body:
                out.write(self.header(rows))
                while block := body.read(8 << 20):
                    out.write(block)
        fs.delete_file(target + ".body")
        return Written(name + self.suffix, rows, start)

    def commit(self, messages) -> None:
        parts = [m for m in messages if m is not None]
        fs, folder = open_fs(self.attempts())
        fs.create_dir(folder, recursive=True)              # a write without tasks has none
        if self.single:
            self._join(sorted(parts, key=lambda m: (m.start is None, m.start, m.path)))
        else:
            self._publish([m.path for m in parts if m.rows])
        fs.delete_dir(folder)

    def _join(self, parts: list[Written]) -> None:
        fs, folder = open_fs(self.attempts())
        with fs.open_output_stream(posixpath.join(folder, "joined")) as out:
            out.write(self.header(sum(m.rows for m in parts)))
            for m in parts:
                with fs.open_input_file(posixpath.join(folder, m.path)) as body:
                    while block := body.read(8 << 20):
                        out.write(block)
        replace_file(posixpath.join(self.attempts(), "joined"), self.path)

    def _publish(self, attempts: list[str]) -> None:
        root = open_fs(self.path)[1]
        before = [posixpath.relpath(open_fs(f)[1], root) for f in list_files(self.path, (self.suffix,))]
        if published(self.path) is None:
            publish(self.path, before, self.attempts())    # from here on files count only when they are named
        fresh = {a: f"{a[:10]}-{self.job}{self.suffix}" for a in attempts}
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda a: replace_file(posixpath.join(self.attempts(), a), posixpath.join(self.path, fresh[a])), attempts))
        publish(self.path, [*([] if self.overwrite else before), *fresh.values()], self.attempts())
        if self.overwrite:
            fs = open_fs(self.path)[0]
            for old in before:
                fs.delete_file(posixpath.join(root, old))

    def abort(self, messages) -> None:
        fs, folder = open_fs(self.attempts())
        if fs.get_file_info(folder).type.name == "Directory":
            fs.delete_dir(folder)


class PointSource(DataSource):
    """Base of format("pcd") and format("ply")."""

    fmt: PointFile
    writer_class: type[PointWriter]

    def _only(self) -> list[str] | None:
        cols = self.options.get("columns")
        return [c.strip() for c in cols.split(",")] if cols else None

    def schema(self) -> T.StructType:
        files = list_files(self.options["path"], self.fmt.suffixes)
        if not files:
            raise ValueError(f"no {self.name()} files in {self.options['path']}")
        with ThreadPoolExecutor(16) as pool:
            return merged_schema(list(pool.map(lambda f: self.fmt.schema(self.fmt.layout(f), self._only()), files)))

    def reader(self, schema: T.StructType) -> PointReader:
        return PointReader(self.fmt, dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool):
        out = self.writer_class(dict(self.options), [f.name for f in schema.fields])
        out.overwrite = overwrite
        fs, target = open_fs(out.path)
        if out.single and not overwrite and fs.get_file_info(target).type.name != "NotFound":
            raise FileExistsError(f"{out.path} exists, and one file cannot be appended to")
        return out


def numeric(batch: pa.RecordBatch, name: str, dtype: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(dtype)

