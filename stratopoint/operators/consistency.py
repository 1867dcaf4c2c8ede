"""Sums of the colours in which cameras see points, where images stay in the tasks that read them.

Points are written once, tile by tile, to files in the shared folder. A task goes through its images, opens the tiles that a
camera may see, and adds to seven sums per point; it writes the sums of the tiles it has touched when it ends. No image and no
view is shuffled. What is written grows with points x tasks at most, so this is for cameras that overlap much.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera as cam
from ..session import cut, shared_folder
from ..sources.files import make_folder, open_fs, read_range
from .colouring import FALLBACK, _box_bounds, _flat, _view_planes

BLOCK = 1 << 10             # points that a camera is tried with
RUN = 1 << 13               # points of neighbouring blocks that meet a camera at once
ROUND_POINTS = 1 << 23      # points whose sums a task holds; beyond it images are gone through again
TABLE_PIXELS = 1 << 18      # pixels of an image whose addends are looked up whole
MOST_VIEWS = (1 << 16) - 1  # of a point between two writes: a lane of 32 bits holds so many squares
SUM_BYTES = 26              # of a point and task
BROADCAST_CAMERAS = 1 << 18
TILES = "cell long, piece long, n long, path string, boxes binary"
WRITTEN = "cell long, piece long, path string, start long, seen array<long>"
WRITTEN_SCHEMA = pa.schema([("cell", pa.int64()), ("piece", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("seen", pa.list_(pa.int64()))])
SUMS = ("views", *(f"{k}{i}" for k in "sq" for i in range(3)))

_LOW = np.arange(256, dtype=np.uint64)
_SQUARE = _LOW * _LOW
_HIGH = np.uint64(32)


def _cut_in_blocks(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of points (3, n) in which runs lie together, and the ends of the runs: boxes halved along their longest side."""
    todo, done = [np.arange(p.shape[1])], []
    while todo:
        some = todo.pop()
        if len(some) <= BLOCK:
            done.append(some)
            continue
        q = p[:, some]
        parted = np.argpartition(q[int(np.argmax(q.max(1) - q.min(1)))], len(some) // 2)
        todo += [some[parted[:len(some) // 2]], some[parted[len(some) // 2:]]]
    return np.concatenate(done), np.cumsum([len(d) for d in done])


def write_tiles(keyed: DataFrame, folder: str) -> DataFrame:
    """A file per (cell, piece): coordinates and ids of its points; returns where they are and the boxes of their blocks."""

    def run(table: pa.Table) -> pa.Table:
        p = np.stack([table.column(c).to_numpy() for c in "xyz"])
        order, ends = _cut_in_blocks(p)
        p, ids = np.ascontiguousarray(p[:, order]), table.column("point_id").combine_chunks().take(pa.array(order))
        first = np.append(0, ends[:-1])
        boxes = np.column_stack([*(f.reduceat(a, first) for f in (np.minimum, np.maximum) for a in p), first, ends])
        path = f"{folder}/tile-{uuid.uuid4().hex}"
        fs, name = open_fs(path)
        with fs.open_output_stream(name, compression=None) as out:
            for a in (p, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)):
                out.write(a.tobytes())
        where = [table.column(c)[0].as_py() for c in ("cell", "piece")]
        return pa.table([[v] for v in (*where, len(order), path, boxes.tobytes())], schema=pa.schema(
            [("cell", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("path", pa.string()), ("boxes", pa.binary())]))

    return cut(keyed.groupBy("cell", "piece").applyInArrow(run, TILES))


class _Tiles:
    """The tiles of a round and their blocks, as arrays."""

    def __init__(self, rows: list):
        self.where = [(r["cell"], r["piece"], r["n"], r["path"]) for r in rows]
        box = [np.frombuffer(r["boxes"]).reshape(-1, 8) for r in rows]
        self.owner = np.repeat(np.arange(len(box)), [len(b) for b in box])
        self.first = np.append(0, np.cumsum([len(b) for b in box]))
        box = np.concatenate(box)
        self.span = box[:, 6:].astype(np.int64)
        whole = np.column_stack([np.minimum.reduceat(box[:, :3], self.first[:-1]), np.maximum.reduceat(box[:, 3:6], self.first[:-1])])
        self.blocks, self.tiles = self._middles(box), self._middles(whole)

    @staticmethod
    def _middles(box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = box[:, :3], box[:, 3:6]
        return (low + high) / 2, (high - low) / 2 + 1e-6 * (1.0 + np.abs(box[:, :6]).max(1)[:, None])

    def seen(self, c: dict[str, np.ndarray], planes: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
        """Tile, first and last place of the points that one camera may see, and whether it surely sees them all: runs of
        neighbouring blocks."""
        tile = _box_bounds(c, planes, np.zeros(len(self.where), np.int64), *self.tiles, 0.0)[0]
        block = np.concatenate([np.arange(0), *(np.arange(self.first[t], self.first[t + 1]) for t in tile)])
        at, _, sure = _box_bounds(c, planes, np.zeros(len(block), np.int64), *(a[block] for a in self.blocks), 0.0)
        block, sure = block[at], ~np.isnan(sure)
        if len(block):
            begins = np.flatnonzero(np.append(True, (np.diff(block) != 1) | (np.diff(self.owner[block]) != 0) | (np.diff(sure) != 0)))
            tile, whole = self.owner[block].tolist(), sure.tolist()
            start, end = self.span[block].T.tolist()
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(block)]):
                while i < j:
                    k = i + 1
                    while k < j and end[k] - start[i] <= RUN:
                        k += 1
                    yield tile[i], start[i], end[k - 1], whole[i]
                    i = k


class _Sums:
    """Sums of the tiles that a task has touched, per point: three pairs of 32-bit lanes (r g, b rr, gg bb), and views."""

    def __init__(self, tiles: _Tiles, folder: str):
        self.tiles, self.folder, self.views = tiles, folder, 0
        self.places: dict[int, np.ndarray] = {}
        self.held: dict[int, np.ndarray] = {}

    def _place(self, tile: int) -> np.ndarray:
        if tile not in self.places:
            n, path = self.tiles.where[tile][2:]
            fs, name = open_fs(path)
            if fs.type_name == "local":         # the pages stay mapped as long as the buffer is held
                with pa.memory_map(name) as f:
                    raw = f.read_buffer(24 * n)
            else:
                raw = read_range(path, 0, 24 * n)
            self.places[tile] = np.frombuffer(raw, np.float64).reshape(3, n)
        return self.places[tile]

    def of(self, tile: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates of a run of points, and its sums to be added to."""
        if tile not in self.held:
            self.held[tile] = np.zeros((self.tiles.where[tile][2], 4), np.uint64)
        return self._place(tile)[:, a:b], self.held[tile][a:b]

    def written(self) -> pa.RecordBatch | None:
        """Write what is held to a file and begin anew."""
        held = [(t, s) for t, s in sorted(self.held.items()) if s[:, 3].any()]
        self.held, self.views = {}, 0
        if not held:
            return None
        path = f"{self.folder}/sums-{uuid.uuid4().hex}"
        fs, name = open_fs(path)
        with fs.open_output_stream(name, compression=None) as out:
            for _, sums in held:
                out.write(sums[:, 3].astype(np.uint16).tobytes())
                out.write(np.ascontiguousarray(sums[:, :3].T).tobytes())
        start = np.append(0, np.cumsum([SUM_BYTES * len(s) for _, s in held]))[:-1]
        cell, piece = (pa.array([self.tiles.where[t][i] for t, _ in held], pa.int64()) for i in range(2))
        return pa.RecordBatch.from_arrays([cell, piece, pa.array([path] * len(held)), pa.array(start, pa.int64()),
                                           pa.nulls(len(held), pa.list_(pa.int64()))], schema=WRITTEN_SCHEMA)


class _Image:
    """The colours of an image as addends to the lanes."""

    def __init__(self, data: np.ndarray | None, across: int, down: int):
        if data is None:
            across = down = 1
        self.across, self.down, n = across, down, across * down
        self.flat = np.resize(np.array(FALLBACK, np.uint8), 3 * n) if data is None or len(data) < 3 * n else data
        if data is not None and len(data) < 3 * n:       # pixels that the data does not hold
            self.flat[:len(data) // 3 * 3] = data[:len(data) // 3 * 3]
        self.table = None
        if n <= TABLE_PIXELS:           # in front of them nothing, for points that are not seen
            self.table = np.zeros((n + 1, 4), np.uint64)
            self.table[1:] = self._addends(np.arange(n))

    def _addends(self, pixel: np.ndarray) -> np.ndarray:
        r, g, b = (self.flat[3 * pixel + i] for i in range(3))
        lanes = _LOW[r] + (_LOW[g] << _HIGH), _LOW[b] + (_SQUARE[r] << _HIGH), _SQUARE[g] + (_SQUARE[b] << _HIGH)
        return np.stack([*lanes, np.ones(len(r), np.uint64)], 1)

    def add(self, pixel: np.ndarray, seen: np.ndarray | None, sums: np.ndarray, room: np.ndarray) -> None:
        """``seen``: which of the points are (None: all); ``pixel`` of the others has no meaning."""
        if self.table is None:
            at = slice(None) if seen is None else np.flatnonzero(seen)
            sums[at] += self._addends(pixel[at])
            return
        table = self.table[1:]
        if seen is not None:
            pixel += 1
            pixel *= seen
            table = self.table
        sums += np.take(table, pixel, axis=0, out=room, mode="clip")


class _Room:
    """Scratch for the numbers of a run."""

    def __init__(self):
        self.number, self.pixel, self.addend = np.empty((5, RUN)), np.empty((2, RUN), np.int64), np.empty((RUN, 4), np.uint64)


class _View:
    """One camera and its image."""

    def __init__(self, c: dict[str, float], image: _Image):
        self.c, self.image = c, image
        self.rows = [([(j, c[f"m{3 * i + j}"]) for j in range(3) if c[f"m{3 * i + j}"] != 0], c[f"t{i}"]) for i in range(3)]
        self.plain = c["k2"] == 0 and c["p1"] == 0 and c["p2"] == 0

    def add(self, p: np.ndarray, sums: np.ndarray, sure: bool, room: _Room) -> None:
        """Add what the camera sees of a run of points; ``sure``: it sees them all. Terms with a factor of zero are left out, which
        changes no bit; all others keep their order. Points behind the camera come out as anything and are masked."""
        c, n = self.c, len(sums)
        x, y, z, r, d = room.number[:, :n]
        for out, (terms, shift) in zip((x, y, z), self.rows):
            if not terms:
                out[:] = 0.0
            for k, (j, m) in enumerate(terms):
                np.multiply(p[j], m, out=r if k else out)
                if k:
                    out += r
            out += shift
        x /= z
        y /= z
        if self.plain:
            if c["k1"] != 0:
                np.multiply(x, x, out=d)
                d += np.multiply(y, y, out=r)
                d *= c["k1"]
                d += 1.0
                x *= d
                y *= d
            for a, f, o in ((x, "fx", "cx"), (y, "fy", "cy")):
                a *= c[f]
                a += c[o]
        else:
            x, y, _ = cam.distort_arrays(c, x, y)
        seen = None
        if not sure:
            seen = z > cam.FRONT_EPS
            for a, size in ((x, "width"), (y, "height")):
                seen &= a >= 0
                seen &= a < c[size]
            if not seen.any():
                return
        px, py = room.pixel[:, :n]
        np.copyto(px, x, casting="unsafe")
        np.copyto(py, y, casting="unsafe")
        for a, size, most in ((px, "width", self.image.across), (py, "height", self.image.down)):
            if most < c[size]:
                np.minimum(a, most - 1, out=a)
        py *= self.image.across
        px += py
        self.image.add(px, seen, sums, room.addend[:n])


def _colour_sums(tiles: _Tiles, folder: str):
    """Task over (camera, iw, ih, data): where it wrote the sums of tiles, and the ids of the cameras it had."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, room = _Sums(tiles, folder), _Room()
        for batch in batches:
            c = _flat(batch.column("camera"))
            planes = _view_planes(c, 0.0)
            size = [batch.column(k).fill_null(1).to_numpy(zero_copy_only=False) for k in ("iw", "ih")]
            data = batch.column("data")
            for i in range(batch.num_rows):
                some = list(tiles.seen({k: v[i:i + 1] for k, v in c.items()}, planes[i:i + 1]))
                if not some:
                    continue
                if held.views == MOST_VIEWS and (done := held.written()):
                    yield done
                held.views += 1
                raw = np.frombuffer(data[i].as_buffer(), np.uint8) if data[i].is_valid else None
                view = _View({k: v[i] for k, v in c.items()}, _Image(raw, int(size[0][i]), int(size[1][i])))
                with np.errstate(all="ignore"):
                    for tile, a, b, sure in some:
                        view.add(*held.of(tile, a, b), sure, room)
            ids = batch.column("camera").field("cam_id").cast(pa.int64()).drop_null()
            if len(ids):
                none = [pa.nulls(1, f.type) for f in list(WRITTEN_SCHEMA)[:4]]
                yield pa.RecordBatch.from_arrays([*none, pa.ListArray.from_arrays([0, len(ids)], ids)], schema=WRITTEN_SCHEMA)
        if done := held.written():
            yield done

    return run


def _unpacked(batches) -> Iterator[pa.RecordBatch]:
    """Sums per point of tiles, added up over the tasks that saw them."""
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            total = np.zeros((n, 7), np.int64)
            for part in row["parts"]:
                raw = read_range(part["path"], part["start"], SUM_BYTES * n)
                lanes = np.frombuffer(raw, np.uint64, 3 * n, 2 * n).reshape(3, n)
                total[:, 0] += np.frombuffer(raw, np.uint16, n)
                for k, (lane, high) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)), 1):
                    total[:, k] += (lanes[lane] >> _HIGH if high else lanes[lane] & np.uint64((1 << 32) - 1)).astype(np.int64)
            raw = read_range(row["path"], 24 * n, 9 * n)
            ids = pa.array(np.frombuffer(raw, np.int64, n), mask=np.frombuffer(raw, bool, n, 8 * n))
            seen = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(seen)), *[pa.array(total[seen, i]) for i in range(7)]], ["point_id", *SUMS])


def streamed_sums(keyed: DataFrame, views: DataFrame, images: DataFrame, tasks: int) -> DataFrame:
    """(point_id, views, s0 to s2, q0 to q2): a row per point and tile with the sums of its views' colours.

    ``keyed``: point_id, x, y, z, cell, piece. ``views``: written cameras in the frame of the points."""
    spark = views.sparkSession
    cores = spark.sparkContext.defaultParallelism
    folder = shared_folder(spark, "consistency")
    make_folder(folder)
    table = write_tiles(keyed.repartition(tasks, "cell", "piece"), folder)
    rounds, room = [], 0
    for row in table.collect():
        if not rounds or room < row["n"]:
            rounds.append([])
            room = ROUND_POINTS
        rounds[-1].append(row)
        room -= row["n"]
    rasters = images.select(F.col("cam_id").alias("_id"), F.col("width").alias("iw"), F.col("height").alias("ih"), "data")
    if rasters.rdd.getNumPartitions() < cores:
        rasters = rasters.repartition(cores)
    beside = F.broadcast(views) if views.count() <= BROADCAST_CAMERAS else views.hint("merge")
    both = rasters.join(beside, F.col("camera.cam_id") == F.col("_id")).select("camera", "iw", "ih", "data").coalesce(cores)

    def seen_in(cameras: DataFrame) -> DataFrame:
        parts = [cameras.mapInArrow(_colour_sums(_Tiles(rows), folder), WRITTEN) for rows in rounds]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return cut(out)

    found = seen_in(both)
    known = found.select(F.explode("seen").alias("_id")).distinct()
    lone = cut(views.join(known, F.col("camera.cam_id") == F.col("_id"), "left_anti"))
    if not lone.isEmpty():              # cameras without an image have patches without pixels
        none = (F.lit(None).cast("int").alias("iw"), F.lit(None).cast("int").alias("ih"), F.lit(None).cast("binary").alias("data"))
        found = found.union(seen_in(lone.select("camera", *none)))
    parts = found.where("path IS NOT NULL").groupBy("cell", "piece").agg(F.collect_list(F.struct("path", "start")).alias("parts"))
    whole = table.select("cell", "piece", "n", "path").join(parts, ["cell", "piece"])
    return whole.repartition(tasks, "cell", "piece").mapInArrow(_unpacked, "point_id long, " + ", ".join(f"{k} long" for k in SUMS))
