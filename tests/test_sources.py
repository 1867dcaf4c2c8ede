import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratopoint.plans import inputs as I
from stratopoint.sources import photos as PH
from stratopoint.sources import rosbag as RB
from stratopoint.sources import texts as TX
from stratopoint.sources.pcd import expand
from stratopoint.sources.points import read_points, sniff, write_cloud

N = 1000


@pytest.fixture(scope="module")
def cloud(spark, sf):
    df = I.points(spark, sf).select("point_id", "x", "y", "z", F.coalesce("intensity", F.lit(0.0)).alias("intensity")).toPandas()
    return df.sort_values("point_id", ignore_index=True)


def header(fields, sizes, types, counts, n, data):
    return (f"# comment\nversion 0.7\nfields {' '.join(fields)}\nSIZE {' '.join(map(str, sizes))}\nTYPE {' '.join(types)}\n"
            f"COUNT {' '.join(map(str, counts))}\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA {data}\n").encode()


def squeeze(raw: bytes) -> bytes:
    """Tiny compressor: runs of one byte become back references, the rest literals."""
    out, lit, i = bytearray(), bytearray(), 0

    def flush():
        while lit:
            out.append(len(lit[:32]) - 1)
            out.extend(lit[:32])
            del lit[:32]

    while i < len(raw):
        run = 1
        while i + run < len(raw) and raw[i + run] == raw[i] and run < 200:
            run += 1
        if run >= 5:
            lit.append(raw[i])
            flush()
            ln = run - 1 - 2
            out.extend([(ln << 5)] if ln < 7 else [7 << 5, ln - 7])
            out.append(0)
            i += run
        else:
            lit.append(raw[i])
            i += 1
    flush()
    return bytes(out)


def rows(df, *cols):
    return np.array([tuple(r) for r in df.orderBy("point_id").select(*cols).collect()], float)


@pytest.mark.parametrize("mode", ["ascii", "binary", "binary_compressed"])
def test_pcd_modes(spark, tmp_path, cloud, mode):
    xyz = cloud[["x", "y", "z"]].to_numpy("<f4")
    rgb = (np.arange(N, dtype=np.uint32) * 7919) & 0xFFFFFF
    normal = np.arange(3 * N, dtype="<i2").reshape(N, 3)
    head = header(["x", "y", "z", "rgb", "normal", "ring", "stamp"], [4, 4, 4, 4, 2, 2, 8], ["F", "F", "F", "F", "I", "U", "F"],
                  [1, 1, 1, 1, 3, 1, 1], N, mode)
    ring, stamp = (np.arange(N) % 60000).astype("<u2"), np.arange(N) / 8.0
    rec = np.zeros(N, [("p", "<f4", 3), ("rgb", "<u4"), ("normal", "<i2", 3), ("ring", "<u2"), ("stamp", "<f8")])
    rec["p"], rec["rgb"], rec["normal"], rec["ring"], rec["stamp"] = xyz, rgb, normal, ring, stamp
    if mode == "binary":
        body = rec.tobytes()
    elif mode == "binary_compressed":
        raw = b"".join([*[xyz[:, i].tobytes() for i in range(3)], rgb.astype("<u4").tobytes(), normal.tobytes(), ring.tobytes(), stamp.tobytes()])
        packed = squeeze(raw)
        assert expand(packed, len(raw)) == raw
        body = struct.pack("<II", len(packed), len(raw)) + packed
    else:
        as_float = rgb.astype("<u4").view("<f4")
        lines = [" ".join([*(repr(float(v)) for v in p), f"{c:.9g}", *map(str, nm), str(r), repr(float(s))])
                 for p, c, nm, r, s in zip(xyz, as_float, normal, ring, stamp)]
        lines.insert(5, "1.0 2.0")
        body = ("\n".join(lines) + "\n").encode()
    (tmp_path / "a.pcd").write_bytes(head + body)
    df = spark.read.format("pcd").option("splitBytes", "4096").load(str(tmp_path / "a.pcd"))
    got = rows(df, "x", "y", "z", "red", "green", "blue", "ring", "stamp")
    assert len(got) == N
    assert np.allclose(got[:, :3], xyz, atol=1e-6)
    assert (got[:, 3] == (rgb >> 16 & 255)).all() and (got[:, 5] == (rgb & 255)).all()
    assert (got[:, 6] == ring).all() and (got[:, 7] == stamp).all()
    assert df.orderBy("point_id").first()["normal"] == [0, 1, 2]
    few = spark.read.format("pcd").option("columns", "point_id,z").load(str(tmp_path / "a.pcd"))
    assert few.columns == ["point_id", "z"] and few.count() == N


def test_pcd_truncated_and_broken(spark, tmp_path, cloud):
    xyz = cloud[["x", "y", "z"]].to_numpy("<f4")
    (tmp_path / "t.pcd").write_bytes(header(["x", "y", "z"], [4] * 3, ["F"] * 3, [1] * 3, N, "binary") + xyz.tobytes()[:12 * 10 + 5])
    assert spark.read.format("pcd").load(str(tmp_path / "t.pcd")).count() == 10
    (tmp_path / "b.pcd").write_bytes(header(["x", "y"], [4] * 2, ["F"] * 2, [1] * 2, 1, "binary") + b"\0" * 8)
    with pytest.raises(Exception, match="without x, y and z"):
        spark.read.format("pcd").load(str(tmp_path / "b.pcd")).count()
    with pytest.raises(ValueError, match="back reference"):
        expand(bytes([0, 1, (1 << 5) | 1, 0]), 8)


@pytest.mark.parametrize("fmt", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_formats(spark, tmp_path, cloud, fmt):
    xyz = cloud[["x", "y", "z"]].to_numpy(np.float64)
    colour = (np.arange(N) % 256) / 255.0
    order = ">" if fmt.endswith("big_endian") else "<"
    head = (f"ply\nformat {fmt} 1.0\nelement face 2\nproperty list uchar int vertex_indices\nelement vertex {N}\n"
            "property double x\nproperty double y\nproperty double z\nproperty float Diffuse_Red\nproperty float diffuse_green\n"
            "property float diffuse_blue\nproperty float quality\nelement edge 1\nproperty int a\nend_header\n").encode()
    if fmt == "ascii":
        lines = ["3 0 1 2", "4 0 1 2 3"] + [" ".join(map(repr, map(float, (*p, c, c, c, c * 2)))) for p, c in zip(xyz, colour)] + ["7"]
        body = ("\n".join(lines) + "\n").encode()
    else:
        rec = np.zeros(N, [("p", order + "f8", 3), ("c", order + "f4", 4)])
        rec["p"] = xyz
        rec["c"] = np.column_stack([colour] * 3 + [colour * 2])
        faces = b"".join(bytes([k]) + np.arange(k).astype(order + "i4").tobytes() for k in (3, 4))
        body = faces + rec.tobytes() + struct.pack(order + "i", 7)
    (tmp_path / "a.ply").write_bytes(head + body)
    got = rows(spark.read.format("ply").load(str(tmp_path / "a.ply")), "x", "y", "z", "red", "blue", "intensity")
    assert len(got) == N and np.allclose(got[:, :3], xyz)
    assert (got[:, 3] == np.arange(N) % 256).all() and np.allclose(got[:, 5], colour * 2)


def test_ply_list_in_vertex(spark, tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty list uchar short k\nproperty float y\nproperty float z\nend_header\n"
    body = struct.pack("<fBhhff", 1, 2, 5, 6, 2, 3) + struct.pack("<fBff", 4, 0, 5, 6)
    (tmp_path / "l.ply").write_bytes(head + body)
    assert rows(spark.read.format("ply").load(str(tmp_path / "l.ply")), "x", "y", "z").tolist() == [[1, 2, 3], [4, 5, 6]]


@pytest.mark.parametrize("kind", ["ply", "pcd"])
@pytest.mark.parametrize("single", [True, False])
def test_round_trip(spark, tmp_path, cloud, kind, single):
    df = spark.createDataFrame(cloud)
    if kind == "ply":
        df = df.drop("intensity").withColumns({c: (F.col("point_id") % k).cast("short") for c, k in (("red", 256), ("green", 100), ("blue", 7))})
    target = str(tmp_path / f"out.{kind}")
    write_cloud(df, target, kind, single)
    back = read_points(spark, target)
    got = np.array(sorted(tuple(map(float, r)) for r in back.select("x", "y", "z").collect()))
    want = np.array(sorted(map(tuple, cloud[["x", "y", "z"]].to_numpy("<f4").astype(float))))
    assert np.allclose(got, want)
    if single:
        assert np.allclose(rows(back, "x", "y", "z"), cloud[["x", "y", "z"]].to_numpy("<f4"))
        assert (tmp_path / f"out.{kind}").is_file() and sniff(target) == kind
    if single and kind == "ply":
        head = b"ply\nformat binary_little_endian 1.0\nelement vertex %d\nproperty float x\nproperty float y\nproperty float z\n" % N
        assert (tmp_path / "out.ply").read_bytes().startswith(head)
        assert len((tmp_path / "out.ply").read_bytes().split(b"end_header\n", 1)[1]) == 15 * N


# --------------------------------------------------------------------- bags

def message(xyz, intensity=None, little=True, drop="", corrupt=False):
    e = "<" if little else ">"
    buf = bytearray([0, 1 if little else 0, 0, 0])

    def num(code, v, size=4):
        buf.extend(b"\0" * (-(len(buf) - 4) % size))
        buf.extend(struct.pack(e + code, v))

    def text(s):
        num("I", len(s) + 1)
        buf.extend(s.encode() + b"\0")

    fields = [c for c in ("x", "y", "z") if c != drop] + (["intensity"] if intensity is not None else [])
    num("i", 1), num("I", 2), text("map"), num("I", 1), num("I", len(xyz)), num("I", len(fields))
    for k, f in enumerate(fields):
        text(f), num("I", 4 * k), num("B", 7, 1), num("I", 1)
    num("B", 0, 1), num("I", 4 * len(fields)), num("I", 4 * len(fields) * len(xyz))
    data = np.column_stack([xyz[:, "xyz".index(c)] for c in fields if c != "intensity"] + ([intensity] if intensity is not None else [])).astype("<f4").tobytes()
    num("I", len(data))
    buf.extend(data)
    return bytes(buf[:40] if corrupt else buf)


@pytest.fixture(scope="module")
def bag(tmp_path_factory, cloud):
    folder = tmp_path_factory.mktemp("bag")
    xyz = cloud[["x", "y", "z"]].to_numpy("<f4")
    k = 0
    for name in ("run_10.db3", "run_0.db3", "run_1.db3"):
        con = sqlite3.connect(folder / name)
        con.execute("CREATE TABLE topics(id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
        con.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        con.executemany("INSERT INTO topics VALUES (?,?,?)", [(1, "/map", "sensor_msgs/msg/PointCloud2"), (2, "/imu", "sensor_msgs/msg/Imu"),
                                                             (3, "/empty", "sensor_msgs/msg/PointCloud2")])
        base = {"run_0.db3": 0, "run_1.db3": 1, "run_10.db3": 2}[name]
        for i in range(4):
            part = xyz[base * 300 + i * 75: base * 300 + (i + 1) * 75].copy()
            if base == 0 and i == 0:
                part[3] = np.nan
            bad = base == 1 and i == 3
            con.execute("INSERT INTO messages(topic_id,timestamp,data) VALUES (1,?,?)",
                        (base * 100 + i, message(part, part[:, 2] * 2, little=i % 2 == 0, corrupt=bad)))
            k += 1
        con.execute("INSERT INTO messages(topic_id,timestamp,data) VALUES (2,5,x'00')")
        con.commit()
        con.close()
    return str(folder)


def test_bag(spark, bag, cloud):
    msgs = spark.read.format("rosbag").load(bag)
    topics = spark.read.format("rosbag").option("table", "topics").load(bag)
    assert [tuple(r) for r in RB.bag_topics(topics, msgs).orderBy("topic").collect()] == [
        ("/empty", "sensor_msgs/msg/PointCloud2", 0), ("/map", "sensor_msgs/msg/PointCloud2", 12)]
    every = RB.bag_cloud(msgs, "/map", "concat")
    assert every.count() == 12 * 75 - 75 - 1
    assert every.where("intensity IS NULL").count() == 0
    last = RB.bag_cloud(msgs, "/map", "last")
    want = cloud[["x", "y", "z"]].to_numpy("<f4")[825:900]
    assert np.allclose(rows(last, "x", "y", "z"), want)
    thin = RB.bag_cloud(msgs, "/map", "map", voxel=5.0)
    full = every.toPandas().sort_values("point_id")
    key = np.floor(full[["x", "y", "z"]].to_numpy() / 5.0)
    _, first = np.unique(key, axis=0, return_index=True)
    assert sorted(r[0] for r in thin.select("point_id").collect()) == sorted(full["point_id"].to_numpy()[first])
    assert RB.bag_cloud(msgs, "/map", "concat", max_messages=2).count() == 149
    with pytest.raises(ValueError, match="not in the recording"):
        RB.bag_cloud(msgs, "/nope")
    with pytest.raises(ValueError, match="not in the recording|no usable"):
        RB.bag_cloud(msgs, "/empty")
    plan = msgs.where("topic = '/map'")._jdf.queryExecution().executedPlan().toString()
    assert "topic" in plan


# ------------------------------------------------------------------- photos

def jpeg_head(alt="+50.031", lat=None, lon=None, exif=None, spelling="GpsLongitude"):
    out = b"\xff\xd8"
    if exif:
        def dms(v):
            v = abs(v)
            d, m = int(v), int((v % 1) * 60)
            s = round(((v % 1) * 60 % 1) * 60 * 10000)
            return struct.pack("<6I", d, 1, m, 1, s, 10000)

        tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8825, 4, 1, 26) + struct.pack("<I", 0)
        at = 26 + 2 + 4 * 12 + 4
        gps = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, b"S\0" if exif[0] < 0 else b"N\0") + struct.pack("<HHII", 2, 5, 3, at)
        gps += struct.pack("<HHI4s", 3, 2, 2, b"W\0" if exif[1] < 0 else b"E\0") + struct.pack("<HHII", 4, 5, 3, at + 24) + struct.pack("<I", 0)
        out += b"\xff\xe1\0\0Exif\0\0" + tiff + gps + dms(exif[0]) + dms(exif[1])
    xmp = ""
    if alt:
        xmp += f'drone-dji:RelativeAltitude="{alt}" '
    if lat:
        xmp += f'drone-dji:GpsLatitude="{lat}" drone-dji:{spelling}="{lon}" '
    return out + xmp.encode() + b"\0" * 50


def test_photos(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "DJI_1_0001_V.JPG").write_bytes(jpeg_head(exif=(51.5488, -7.3738)))
    (tmp_path / "sub" / "DJI_1_0002_V.jpg").write_bytes(jpeg_head(lat="+51.5", lon="7.4"))
    (tmp_path / "DJI_1_0003_V.JPG").write_bytes(jpeg_head(lat="+51.5", lon="7.4", spelling="GpsLongtitude"))
    (tmp_path / "DJI_1_0001_T.JPG").write_bytes(jpeg_head())
    (tmp_path / "other.jpeg").write_bytes(jpeg_head(alt=None, lat="1", lon="2"))
    found = PH.scan_photos(spark, str(tmp_path))
    assert sorted(r["name"] for r in found.collect()) == ["DJI_1_0001_V.JPG", "DJI_1_0002_V.jpg", "DJI_1_0003_V.JPG"]
    s = PH.photo_summary(found, PH.scan_thermal(spark, str(tmp_path))).first()
    assert (s["images"], s["thermal"], s["example"]) == (3, 1, "DJI_1_0001_V.JPG")
    tags = {r["name"]: (r["lat"], r["lon"], r["rel_alt"]) for r in PH.geotags(PH.read_heads(spark, str(tmp_path))).collect()}
    assert set(tags) == {"DJI_1_0001_V.JPG", "DJI_1_0002_V.jpg"}
    assert np.allclose(tags["DJI_1_0001_V.JPG"], (51.5488, -7.3738, 50.031), atol=1e-6)
    assert np.allclose(tags["DJI_1_0002_V.jpg"], (51.5, 7.4, 50.031))
    a = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "name string, lat double, lon double, rel_alt double")
    b = spark.createDataFrame([("a", 9.0, 9.0, 9.0), ("b", 4.0, 5.0, 6.0)], a.schema)
    assert sorted(tuple(r) for r in PH.merge_geotags(a, b).collect()) == [("a", 1.0, 2.0, 3.0), ("b", 4.0, 5.0, 6.0)]


def png(img):
    h, w, _ = img.shape
    raw = b"".join(b"\0" + img[i].tobytes() for i in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_prepare_images(spark, tmp_path):
    small = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    big = np.full((40, 80, 3), (200, 100, 50), np.uint8)
    (tmp_path / "s.png").write_bytes(png(small))
    (tmp_path / "b.png").write_bytes(png(big))
    out = {r["name"]: r for r in PH.prepare_images(PH.read_images(spark, str(tmp_path)), 20).collect()}
    assert np.frombuffer(out["s.png"]["data"], np.uint8).reshape(3, 4, 3).tolist() == small.tolist()
    assert (out["b.png"]["height"], out["b.png"]["width"]) == (10, 20)
    assert set(np.frombuffer(out["b.png"]["data"], np.uint8).reshape(-1, 3)[7]) == {200, 100, 50}
    done = spark.createDataFrame([("b.png",)], "name string")
    assert PH.prepare_images(PH.read_images(spark, str(tmp_path)), 20, done).count() == 1


def test_temperature_rasters(spark, tmp_path):
    grid = np.arange(640 * 512, dtype="<f4")
    (tmp_path / "0001.f32").write_bytes(grid.tobytes())
    (tmp_path / "0002.f32").write_bytes(b"\0" * 100)
    r = PH.temperature_rasters(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0]["data"][641] == 641.0


# -------------------------------------------------------------------- texts

def test_telemetry(spark, tmp_path):
    text = ("1\n00:00:02,500 --> 00:00:03,000\n[latitude: 51.5] [longitude: -7.4] [rel_alt: 12.5 abs_alt: 99]\n \n"
            "2\n00:00:01,000 --> x\n[latitude: 51.6] [longitude: 7.5] [rel_alt: 13]\n\n3\n00:00:09,000 --> x\n[latitude: 1] [longitude: 2]\n")
    (tmp_path / "a.srt").write_text(text)
    got = [tuple(r) for r in TX.read_telemetry(spark, str(tmp_path / "a.srt")).collect()]
    assert got == [(1.0, 51.6, 7.5, 13.0), (2.5, 51.5, -7.4, 12.5)]


def test_model_round_trip(spark, tmp_path, sf):
    cams = I.cameras(spark, sf).withColumn("camera_no", F.lit(1))
    pts = I.points(spark, sf).select(F.col("point_id").alias("pid"), "x", "y", "z", *[F.lit(k).cast("short").alias(c) for c, k in
                                     (("red", 1), ("green", 2), ("blue", 3))], F.lit(0.25).alias("err"))
    TX.write_model(cams, pts, str(tmp_path))
    back, points = TX.read_model(spark, str(tmp_path))
    a = {r["cam_id"]: r for r in cams.collect()}
    b = {r["cam_id"]: r for r in back.collect()}
    assert set(a) == set(b)
    for k in a:
        assert np.allclose(a[k]["r"], b[k]["r"], atol=1e-8) and np.allclose(a[k]["c"], b[k]["c"], atol=1e-6)
        assert a[k]["params"] == b[k]["params"] and a[k]["name"] == b[k]["name"]
    assert points.count() == pts.count() and points.first()["err"] == 0.25


def test_json_and_stage(spark, tmp_path):
    (tmp_path / "gps.json").write_text(json.dumps({"a.JPG": [1.0, 2.0, 3.0], "b.JPG": [4.0, 5.0, 6.0]}, indent=1))
    tags = TX.read_geotag_json(spark, str(tmp_path / "gps.json"))
    assert sorted(tuple(r) for r in tags.collect()) == [("a.JPG", 1.0, 2.0, 3.0), ("b.JPG", 4.0, 5.0, 6.0)]
    assert sorted(json.loads(r[0]).popitem() for r in TX.geotag_json(tags).collect())[0] == ("a.JPG", [1.0, 2.0, 3.0])
    (tmp_path / "t.json").write_text(json.dumps({"T": [[1.0, 0.0], [0.5, 2.0]]}))
    assert TX.read_matrix_json(spark, str(tmp_path / "t.json"), "T") == [[1.0, 0.0], [0.5, 2.0]]
    calls = []

    def build():
        calls.append(1)
        return tags

    for _ in range(2):
        assert TX.stage(spark, str(tmp_path / "work"), "tags", build).count() == 2
    assert len(calls) == 1


# ------------------------------------------------------- folders of many files

def write_folder(folder, cloud):
    """The cloud's points dealt to five files of both formats; ascii ones hold a short line and surplus records."""
    folder.mkdir()
    xyz = cloud[["x", "y", "z"]].to_numpy("<f4")
    parts = np.array_split(xyz, 5)
    text = [" ".join(repr(float(v)) for v in p) for p in parts[0]]
    text.insert(3, "1.0 2.0")
    (folder / "a.pcd").write_bytes(header(["x", "y", "z"], [4] * 3, ["F"] * 3, [1] * 3, len(parts[0]), "ascii") + ("\n".join(text + ["9 9 9"] * 4) + "\n").encode())
    (folder / "b.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex %d\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
                                   % len(parts[1]) + parts[1].tobytes())
    rec = np.zeros(len(parts[2]), [("p", "<f4", 3), ("i", "<f4")])
    rec["p"], rec["i"] = parts[2], np.arange(len(parts[2]))
    (folder / "c.pcd").write_bytes(header(["x", "y", "z", "intensity"], [4] * 4, ["F"] * 4, [1] * 4, len(rec), "binary") + rec.tobytes())
    raw = b"".join(parts[3][:, i].tobytes() for i in range(3))
    packed = squeeze(raw)
    (folder / "d.pcd").write_bytes(header(["x", "y", "z"], [4] * 3, ["F"] * 3, [1] * 3, len(parts[3]), "binary_compressed")
                                   + struct.pack("<II", len(packed), len(raw)) + packed)
    body = "\n".join(" ".join(repr(float(v)) for v in p) + " 1 2 3" for p in parts[4])
    (folder / "e.ply").write_bytes(f"ply\nformat ascii 1.0\nelement vertex {len(parts[4])}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\n"
                                   f"property uchar green\nproperty uchar blue\nend_header\n{body}\n".encode())
    return xyz, [len(p) for p in parts]


@pytest.mark.parametrize("split", [64, 700, 128 << 20])
def test_folder_of_mixed_files(spark, tmp_path, cloud, split):
    xyz, sizes = write_folder(tmp_path / "clouds", cloud)
    df = read_points(spark, str(tmp_path / "clouds"), split=split)
    got = df.orderBy("point_id").toPandas()
    assert got["point_id"].tolist() == list(range(N))
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), xyz, atol=1e-6)
    ends = np.cumsum(sizes)
    assert got["intensity"].notna().sum() == sizes[2] and got["intensity"][ends[1]:ends[2]].tolist() == list(range(sizes[2]))
    assert (got["red"].dropna() == 1).all() and got["red"].notna().sum() == sizes[4]
    assert got["file"].tolist() == [f for f, k in zip(("a.pcd", "b.ply", "c.pcd", "d.pcd", "e.ply"), sizes) for _ in range(k)]
    few = read_points(spark, str(tmp_path / "clouds"), columns=["point_id", "z"], split=split)
    assert few.columns == ["point_id", "z"] and few.count() == N


def test_plain_format_numbers_all_files_and_merges_columns(spark, tmp_path, cloud):
    _, sizes = write_folder(tmp_path / "clouds", cloud)
    df = spark.read.format("pcd").option("splitBytes", "256").load(str(tmp_path / "clouds"))
    assert "intensity" in df.columns
    assert sorted(r[0] for r in df.select("point_id").collect()) == list(range(sizes[0] + sizes[2] + sizes[3]))


def test_joins_on_a_folder_keep_one_row_per_point(spark, tmp_path, cloud):
    from stratopoint.operators import neighbours

    write_folder(tmp_path / "clouds", cloud)
    p = read_points(spark, str(tmp_path / "clouds")).select("point_id", "x", "y", "z")
    ref = p.withColumns({c: F.lit(7).cast("short") for c in ("red", "green", "blue")})
    assert neighbours.nn_transfer(p, ref, ("red", "green", "blue"), (0, 0, 0), 1.0).count() == N


# ---- writing in two phases ------------------------------------------------------------------------------------

def little_cloud(spark, n=1000, shift=0.0):
    return spark.range(n).selectExpr("id as point_id", f"id + {shift}D as x", "id * 2D as y", "1D as z")


@pytest.mark.parametrize("kind", ["ply", "pcd"])
def test_a_second_write_leaves_one_copy_or_raises(spark, tmp_path, kind):
    target = str(tmp_path / "cloud")
    write_cloud(little_cloud(spark), target, kind)
    with pytest.raises(FileExistsError):
        write_cloud(little_cloud(spark), target, kind)
    assert read_points(spark, target).count() == 1000
    write_cloud(little_cloud(spark, 700, 5.0), target, kind, mode="overwrite")
    got = read_points(spark, target)
    assert got.count() == 700 and got.agg({"x": "min"}).first()[0] == 5.0
    assert spark.read.format(kind).load(target).count() == 700
    write_cloud(little_cloud(spark, 300), target, kind, mode="append")
    assert read_points(spark, target).count() == 1000
    left = {p.name for p in (tmp_path / "cloud").iterdir()}
    assert not any(n.startswith("_attempts") for n in left) and left - {"_published"} == set((tmp_path / "cloud" / "_published").read_text().split())


def test_one_joined_file_is_replaced_or_raises(spark, tmp_path):
    target = str(tmp_path / "cloud.ply")
    write_cloud(little_cloud(spark), target, single=True)
    with pytest.raises(FileExistsError):
        write_cloud(little_cloud(spark), target, single=True)
    with pytest.raises(Exception, match="cannot be appended"):
        write_cloud(little_cloud(spark), target, single=True, mode="append")
    write_cloud(little_cloud(spark, 40), target, single=True, mode="overwrite")
    assert read_points(spark, target).count() == 40 and [p.name for p in tmp_path.iterdir()] == ["cloud.ply"]


@pytest.mark.parametrize("single", [False, True])
def test_lost_repeated_and_late_attempts_leave_no_rows(spark, tmp_path, monkeypatch, single):
    """Every part is written by three attempts, of which the messages name the second; the third ends after the commit."""
    import pyarrow as pa
    from pyspark import TaskContext

    from stratopoint.sources.ply import PlyWriter

    class Attempt:
        def __init__(self, part, number):
            self.partitionId, self.taskAttemptId = lambda: part, lambda: number

    rows = lambda part: iter([pa.table({"point_id": list(range(part * 10, part * 10 + 10)), "x": [1.0] * 10, "y": [0.0] * 10, "z": [0.0] * 10}).to_batches()[0]])
    target = str(tmp_path / ("cloud.ply" if single else "cloud"))
    writer = PlyWriter({"path": target, "single": str(single)}, ["point_id", "x", "y", "z"])

    def attempt(part, number):
        monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: Attempt(part, number)))
        return writer.write(rows(part))

    messages = []
    for part in range(3):
        attempt(part, 100 + part)                        # finished its file, then its executor was lost
        messages.append(attempt(part, 200 + part))
    monkeypatch.undo()
    writer.commit([*messages, None])
    assert read_points(spark, target).count() == 30
    attempt(1, 301)
    monkeypatch.undo()
    assert read_points(spark, target).count() == 30
    again = PlyWriter({"path": target, "single": str(single)}, ["point_id", "x", "y", "z"])
    writer = again
    attempt(0, 400)
    monkeypatch.undo()
    again.abort([])
    assert read_points(spark, target).count() == 30


def test_a_commit_that_is_cut_off_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    from stratopoint.sources import table
    from stratopoint.sources.ply import PlyWriter
    from stratopoint.sources.table import Written

    target = str(tmp_path / "cloud")
    write_cloud(little_cloud(spark, 50), target)
    writer = PlyWriter({"path": target}, ["point_id", "x", "y", "z"])
    writer.overwrite = True
    (tmp_path / "cloud" / f"_attempts-{writer.job}").mkdir()
    (tmp_path / "cloud" / f"_attempts-{writer.job}" / "part-00000-7.ply").write_bytes(writer.header(0))

    def stop(*_):
        raise OSError("driver lost")

    monkeypatch.setattr(table, "publish", stop)
    with pytest.raises(OSError):
        writer.commit([Written("part-00000-7.ply", 1, 0)])
    assert read_points(spark, target).count() == 50
