"""Rasters, manifests, stores, features and streams on files."""
import struct
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridcast import dims
from gridcast.functions import columns as fx
from gridcast.operators import features as ft, manifest as mf, samples, stats, verify
from gridcast.sources import archive, files, norm_stats, rasters, store, tiff
from gridcast.streaming import ingest, verification as live

HEADER = ",".join(dims.MANIFEST_COLUMNS)


def frame_pixels(sensor, seed):
    """Each pixel tells its band, place and frame."""
    h, w = dims.NATIVE_SIZE[sensor]
    band, y, x = np.ogrid[:16, :h, :w]
    return ((7 * band + 3 * y + 5 * x + 11 * seed + band * y * (seed % 5 + 1)) % 253).astype(np.uint8)


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    """Samples of all sensors in turn that name 3, 1, 0, 2 ... frames, one with a gap in its middle slot."""
    root = tmp_path_factory.mktemp("workspace")
    rows, pixels, targets = [], {}, {}
    plan = [(dims.SENSORS[i % 3], i, (3, 1, 0, 2, 3)[i % 5]) for i in range(11)]
    for seed, (sensor, i, n) in enumerate(plan):
        names = []
        for t in range(n):
            name = f"{sensor}_{i}_{t}.tif"
            pixels[name] = frame_pixels(sensor, seed * 10 + t)
            (root / sensor).mkdir(exist_ok=True)
            (root / sensor / name).write_bytes(tiff.write_raster(pixels[name]))
            names.append(name)
        target = f"{sensor}_{i}_target.tif"
        y, x = np.mgrid[: dims.TARGET_SIZE[0], : dims.TARGET_SIZE[1]]
        targets[target] = np.maximum(0, 9 * np.sin(0.3 * x + seed) * np.cos(0.2 * y) - 4).astype(np.float32)
        (root / dims.TARGET_SUBDIR).mkdir(exist_ok=True)
        (root / dims.TARGET_SUBDIR / target).write_bytes(tiff.write_raster(targets[target][None]))
        rows.append(f'u{seed},site_{sensor}_{i % 2},{sensor.upper()},2024-01-0{1 + seed % 9} 12:30:00,"{names}",{target}')
    (root / "train.csv").write_text(HEADER + "\n" + "\n".join(rows) + "\n")
    return {"root": str(root), "csv": str(root / "train.csv"), "pixels": pixels, "targets": targets, "n": len(plan)}


@pytest.fixture(scope="module")
def manifest(spark, workspace):
    return mf.parse_manifest(mf.read_manifest(spark, workspace["csv"]))


@pytest.fixture(scope="module")
def built(spark, workspace, manifest, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "train")
    assert store.build_from_folders(manifest, workspace["root"], path)
    return path


# ---- TIFF -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "float32", "float64"])
@pytest.mark.parametrize("bands", [1, 3])
def test_tiff_round_trip(dtype, bands):
    block = (np.arange(bands * 5 * 7) % 100).reshape(bands, 5, 7).astype(dtype)
    back, head = tiff.read_raster(tiff.write_raster(block, (2.0, 0.0, 10.0, 0.0, -2.0, 20.0)))
    np.testing.assert_array_equal(back, block)
    assert (head.height, head.width, head.count, head.dtype) == (5, 7, bands, dtype)
    assert head.transform == (2.0, 0.0, 10.0, 0.0, -2.0, 20.0) and head.crs is None
    assert tiff.read_header(tiff.write_raster(block)).transform == (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def chunky(block, order, rows_per_strip):
    """The layout other writers use: interleaved samples in several strips, either byte order."""
    n, h, w = block.shape
    body = [np.ascontiguousarray(block[:, r : r + rows_per_strip].transpose(1, 2, 0)).astype(block.dtype.newbyteorder(order)).tobytes() for r in range(0, h, rows_per_strip)]
    offsets, at = [], 8
    for part in body:
        offsets.append(at)
        at += len(part)
    at += at % 2
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [block.dtype.itemsize * 8] * n), (259, 3, [1]), (273, 4, offsets), (277, 3, [n]),
            (278, 3, [rows_per_strip]), (279, 4, [len(p) for p in body]), (284, 3, [1]), (34735, 3, [1, 1, 0, 1, 2048, 0, 1, 4326])]
    codes = {3: "H", 4: "I"}
    table, extra, start = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{codes[kind]}", *values)
        cell = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", start + len(extra))
        extra += b"" if len(raw) <= 4 else raw
        table += struct.pack(order + "HHI", tag, kind, len(values)) + cell
    mark = b"II" if order == "<" else b"MM"
    data = mark + struct.pack(order + "HI", 42, at) + b"".join(body)
    return data.ljust(at, b"\0") + struct.pack(order + "H", len(tags)) + table + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_chunky_strips(order):
    block = np.random.default_rng(0).integers(0, 60000, size=(3, 7, 5)).astype("uint16")
    back, head = tiff.read_raster(chunky(block, order, 3))
    np.testing.assert_array_equal(back, block)
    assert head.crs == "EPSG:4326"


def test_tiff_rejects():
    good = tiff.write_raster(np.zeros((1, 4, 4), np.uint8))
    for bad in (b"", b"not a tif at all", good[:20], b"II*\0\xff\xff\xff\xff"):
        with pytest.raises(tiff.RasterError):
            tiff.read_raster(bad)


# ---- readers --------------------------------------------------------------------------------------
def test_contract_faults(spark, tmp_path):
    folder = tmp_path / "himawari"
    folder.mkdir()
    nan = np.zeros((1, 41, 41), np.float32)
    nan[0, 0, 0] = np.nan
    inf = nan.copy()
    inf[0, 0, 0] = np.inf
    files = {
        "corrupt": b"not a tif at all", "int16": tiff.write_raster(np.zeros((16, 81, 81), np.int16)),
        "small": tiff.write_raster(np.zeros((16, 10, 10), np.uint8)), "bands": tiff.write_raster(np.zeros((4, 81, 81), np.uint8)),
        "all255": tiff.write_raster(np.full((16, 81, 81), 255, np.uint8)), "all0": tiff.write_raster(np.zeros((16, 81, 81), np.uint8)),
        "nan": tiff.write_raster(nan), "inf": tiff.write_raster(inf), "target": tiff.write_raster(np.ones((1, 41, 41), np.float32)),
    }
    for name, data in files.items():
        (folder / f"{name}.tif").write_bytes(data)
    frames = {r["filename"][:-4]: r for r in rasters.read_frames(spark, str(folder)).collect()}
    assert {n for n, r in frames.items() if r["error"] is None} == {"all255", "all0"}
    assert "dtype" in frames["int16"]["error"] and "size" in frames["small"]["error"] and "bands" in frames["bands"]["error"]
    assert bytes(frames["all255"]["pixels"]) == b"\xff" * (16 * 81 * 81)
    targets = {r["filename"][:-4]: r for r in rasters.read_targets(spark, str(folder)).collect()}
    assert {n for n, r in targets.items() if r["error"] is None} == {"target"}
    assert "non-finite" in targets["nan"]["error"] and "non-finite" in targets["inf"]["error"]
    heads = {r["filename"][:-4]: r for r in rasters.read_headers(rasters.binary_files(spark, str(folder)), dims.NATIVE_SIZE).collect()}
    assert heads["int16"]["dtype"] == "int16" and heads["int16"]["error"] is None
    assert "expected size" in heads["small"]["error"]
    wrong = rasters.read_headers(rasters.binary_files(spark, str(folder)), {"goes": (1, 1)}).first()
    assert "unknown sensor" in wrong["error"]


def test_manifest_checks(spark, tmp_path, manifest, workspace):
    assert manifest.count() == workspace["n"]
    row = manifest.where("uid = 'u0'").first()
    assert (row["sensor"], row["sensor_id"], len(row["frames"])) == ("himawari", 0, 3)
    assert [r["uid"] for r in manifest.orderBy("row_idx").collect()] == [f"u{i}" for i in range(workspace["n"])]
    assert mf.duplicate_ids(manifest).count() == 0
    bad = tmp_path / "bad.csv"
    bad.write_text("unique_id,datetime\n1,2024-01-01 00:00:00\n")
    with pytest.raises(ValueError, match="name_location"):
        mf.read_manifest(spark, str(bad))
    with pytest.raises(Exception):
        mf.read_manifest(spark, str(tmp_path / "absent.csv"))
    train, val = mf.split_by_site(manifest, ["SITE_GOES_0"])
    assert (train.count(), val.count()) == (workspace["n"] - 2, 2)  # samples 4 and 10


def test_frame_list_cells(spark):
    cells = {
        "['a', 'b']": ["a", "b"], '["x"]': ["x"], "('a', 'b')": ["a", "b"], "('a',)": ["a"], "[1, 2]": ["1", "2"], "['a',]": ["a"],
        "[]": [], "": [], "nan": [], "NaN": [], None: [], "  ['a']  ": ["a"], "()": [],
    }
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r["c"]: r["x"] for r in df.select("c", fx.frame_list(F.col("c")).alias("x")).collect()}
    assert got == cells
    for broken in ("['a'", "abc", "{'a': 1}", "('a')", "7"):
        with pytest.raises(Exception, match="could not parse"):
            spark.createDataFrame([(broken,)], "c string").select(fx.frame_list(F.col("c"))).collect()


def test_unknown_sensor_fails(spark):
    with pytest.raises(Exception, match="unknown sensor"):
        spark.createDataFrame([("noaa",)], "s string").select(fx.known_sensor(F.col("s"))).collect()
    with pytest.raises(ValueError):
        dims.band_indices("noaa", "all")
    with pytest.raises(ValueError):
        dims.band_indices("goes", "some")
    assert dims.max_channels("ir_only") == 10 and dims.max_channels("visible_only") == 8
    assert dims.stored_positions("meteosat", "all", "ir_only") == tuple(range(8, 16))
    with pytest.raises(ValueError):
        dims.stored_positions("goes", "ir_only", "all")


# ---- store ----------------------------------------------------------------------------------------
def rows_of(spark, path):
    return {r["uid"]: r for r in store.read_store(spark, path).collect()}


def test_store_contents(spark, workspace, built, manifest):
    rows = rows_of(spark, built)
    assert len(rows) == workspace["n"]
    listed = {r["uid"]: r for r in manifest.collect()}
    for uid, row in rows.items():
        bands = list(dims.band_indices(row["sensor"], "ir_only"))
        for t, frame in enumerate(row["frames"]):
            name = listed[uid]["slots"][t]
            want = workspace["pixels"][name][bands].tobytes() if name else bytes(len(frame["pixels"]))
            assert (bytes(frame["pixels"]), frame["valid"], frame["outcome"]) == (want, name is not None, "ok" if name else "missing")
        np.testing.assert_array_equal(np.float32(row["target"]), workspace["targets"][listed[uid]["target_file"]].ravel())
    counters = {r["sensor"]: r for r in store.store_counters(store.read_store(spark, built)).collect()}
    for sensor in dims.SENSORS:
        assert counters[sensor]["missing"] == sum(r["slots"].count(None) for r in listed.values() if r["sensor"] == sensor) > 0
    assert all(r["complete"] for r in store.audit_store(store.read_store(spark, built), manifest, "ir_only").collect())
    short = store.audit_store(store.read_store(spark, built).where("uid <> 'u0'"), manifest, "ir_only").collect()
    assert {r["sensor"]: r["complete"] for r in short} == {"himawari": False, "goes": True, "meteosat": True}


def test_audit_reads_no_pixels_and_finds_faults(spark, built, manifest, tmp_path):
    rows = store.read_store(spark, built)
    plan = store.store_sizes(rows)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<frames:array<struct<size:int>>,n_target:int>" in plan
    complete = lambda df: {r["sensor"]: r["complete"] for r in store.audit_store(df, manifest, "ir_only").collect()}
    first = rows.where("sensor = 'goes'").agg(F.min("uid")).first()[0]
    cut = F.transform("frames", lambda f: f.withField("pixels", F.substring(f["pixels"], 1, 100)))
    rows.withColumn("frames", F.when(F.col("uid") == first, cut).otherwise(F.col("frames"))).write.parquet(str(tmp_path / "cut"))
    assert complete(spark.read.parquet(str(tmp_path / "cut"))) == {"himawari": True, "goes": False, "meteosat": True}
    swapped = rows.withColumn("sensor", F.when(F.col("uid") == first, F.lit("himawari")).otherwise(F.col("sensor")))
    assert complete(swapped) == {"himawari": False, "goes": False, "meteosat": True}


def test_a_finished_store_of_another_kind_is_refused(spark, workspace, manifest, tmp_path):
    path = str(tmp_path / "store")
    assert store.build_from_folders(manifest, workspace["root"], path, limit=3)
    for other in ({"band_mode": "all"}, {"load_targets": False}, {"target_size": (8, 8)}, {"sizes": {**dims.NATIVE_SIZE, "goes": (4, 4)}}):
        with pytest.raises(ValueError, match="was built for"):
            store.build_from_folders(manifest, workspace["root"], path, **other)
    with pytest.raises(ValueError, match="more than once"):
        store.build_from_folders(manifest.union(manifest), workspace["root"], str(tmp_path / "twice"))


def test_archives_stay_open(tmp_path):
    places = {}
    for name in "abc":
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("x/1", name * 9)
            m = z.infolist()[0]
            places[str(tmp_path / name)] = (m.header_offset, m.compress_size, m.compress_type, m.CRC)
    for most, opened in ((16, 3), (2, 12)):
        reader = files.MemberReader(most)
        for _ in range(4):
            assert [reader.read(path, *place) for path, place in places.items()] == [n.encode() * 9 for n in "abc"]
        assert reader.opened == opened
        reader.close()


def test_store_is_built_once_and_repairs_partial_output(spark, workspace, manifest, tmp_path):
    path = tmp_path / "store"
    (path / "sensor=goes").mkdir(parents=True)
    (path / "sensor=goes" / "left-over.parquet").write_bytes(b"half a file")
    assert store.build_from_folders(manifest, workspace["root"], str(path), limit=4)
    assert store.read_store(spark, str(path)).count() == 4
    assert not store.build_from_folders(manifest, workspace["root"], str(path))
    assert store.read_store(spark, str(path)).count() == 4


def test_archive_equals_folder(spark, workspace, manifest, built, tmp_path):
    with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
        z.writestr("train.csv", "top level")
        z.writestr("top/", b"")
        for name, block in workspace["pixels"].items():
            z.writestr(f"top/old/{name}", b"superseded")
            z.writestr(f"top/{name.split('_')[0]}/{name}", tiff.write_raster(block), zipfile.ZIP_DEFLATED if "_0" in name else zipfile.ZIP_STORED)
        for name, rate in workspace["targets"].items():
            z.writestr(f"top/gpm_imerg/{name}", tiff.write_raster(rate[None]))
    index = archive.archive_index(spark, str(tmp_path))
    assert index.count() == len(workspace["pixels"]) + len(workspace["targets"])
    path = str(tmp_path / "from_zip")
    assert store.build_from_archives(manifest, index, path)
    plain = lambda rows: {u: (r["target"], r["frames"]) for u, r in rows.items()}
    assert plain(rows_of(spark, path)) == plain(rows_of(spark, built))
    frames = rasters.decode_frames(archive.read_members(index.where(~F.col("filename").contains("target"))))
    assert frames.where("error is not null").count() == 0


def test_norm_stats(spark, workspace, tmp_path):
    folders = [f"{workspace['root']}/{s}" for s in dims.SENSORS[:2]]
    for stride in (1, 2):
        got = stats.frame_stats(rasters.read_frames(spark, folders), stride).collect()
        assert len(got) == 48
        for sensor in dims.SENSORS:
            blocks = [b for n, b in workspace["pixels"].items() if n.startswith(sensor)] if sensor != "meteosat" else []
            for r in (r for r in got if r["sensor"] == sensor):
                values = np.concatenate([b[r["band"], ::stride, ::stride].ravel() for b in blocks]) if blocks else np.zeros(0)
                want = (values.mean(), values.std(), values.size) if blocks else (0.0, 1.0, 0)
                assert (r["mean"], r["std"], r["n_pixels"]) == pytest.approx(want, rel=1e-12)
    path = str(tmp_path / "norm")
    table = stats.frame_stats(rasters.read_frames(spark, folders))
    norm_stats.write_norm_stats(table, path)
    assert sorted(map(tuple, norm_stats.read_norm_stats(spark, path).select(*table.columns).collect())) == sorted(map(tuple, table.collect()))
    (tmp_path / "given.json").write_text('{"goes": {"mean": [1.5, 2.5], "std": [1, 2], "n_pixels": 9}}')
    given = norm_stats.read_norm_stats(spark, str(tmp_path / "given.json")).orderBy("band").collect()
    assert [(r["sensor"], r["band"], r["mean"], r["std"], r["n_pixels"]) for r in given] == [("goes", 0, 1.5, 1.0, 9), ("goes", 1, 2.5, 2.0, 9)]


def test_flat_band_gets_unit_std(spark, tmp_path):
    (tmp_path / "himawari").mkdir()
    (tmp_path / "himawari" / "a.tif").write_bytes(tiff.write_raster(np.full((16, 81, 81), 7, np.uint8)))
    got = stats.frame_stats(rasters.read_frames(spark, str(tmp_path / "himawari"))).where("sensor = 'himawari'").collect()
    assert {(r["mean"], r["std"]) for r in got} == {(7.0, 1.0)}


# ---- features -------------------------------------------------------------------------------------
def brute_features(frames, valid, mean, std, size, differences, width):
    """Nearest-neighbour version of the whole chain in plain loops over slots."""
    filled, last = [None] * 3, None
    for t in range(3):
        last = frames[t] if valid[t] else last
        filled[t] = last
    first = next((f for f, v in zip(frames, valid) if v), None)
    filled = [f if f is not None else (first if first is not None else frames[t]) for t, f in enumerate(filled)]
    z = [(f.astype(np.float32) - mean[:, None, None]) / std[:, None, None] for f in filled]
    pick = np.arange(size) * frames[0].shape[-1] // size
    z = [f[:, pick][:, :, pick] for f in z]
    if differences:
        z += [z[1] - z[0], z[2] - z[1]]
    out = np.concatenate(z)
    return np.concatenate([out, np.zeros((width - len(out), size, size), np.float32)])


@pytest.mark.parametrize("size,differences", [(16, True), (48, False)])
def test_feature_records(spark, workspace, built, size, differences):
    table = stats.frame_stats(rasters.read_frames(spark, [f"{workspace['root']}/{s}" for s in dims.SENSORS]))
    known = ft.collect_stats(table)
    config = ft.FeatureConfig(image_size=size, interpolation="nearest", include_differences=differences)
    width = 10 * (5 if differences else 3)
    assert config.channels == width
    site_ids = mf.site_ids(store.read_store(spark, built))
    records = {r["uid"]: r for r in ft.feature_records(store.read_store(spark, built), table, config, site_ids).collect()}
    for uid, row in rows_of(spark, built).items():
        sensor, (h, w) = row["sensor"], dims.NATIVE_SIZE[row["sensor"]]
        bands = dims.band_indices(sensor, "ir_only")
        mean, std = (np.float32([known[(sensor, b)][i] for b in bands]) for i in (0, 1))
        frames = [np.frombuffer(f["pixels"], np.uint8).reshape(len(bands), h, w) for f in row["frames"]]
        valid = [f["valid"] for f in row["frames"]]
        got = records[uid]
        want = brute_features(frames, valid, mean, std, size, differences, width)
        np.testing.assert_allclose(np.float32(got["features"]).reshape(width, size, size), want, atol=1e-5)
        assert got["channels"] == width and got["has_data"] == float(any(valid)) and got["valid_mask"] == [float(v) for v in valid]
        target = np.float32(row["target"])
        np.testing.assert_allclose(got["target_log"], np.log1p(target), rtol=1e-6)
        np.testing.assert_array_equal(got["rain_mask"], (target > np.float32(0.1)).astype(float))
        hour = 12.5
        np.testing.assert_allclose(got["aux"][3:], [np.cos(2 * np.pi * 0.5 / 24), np.sin(2 * np.pi * hour / 24), np.cos(2 * np.pi * hour / 24)], rtol=1e-5)
        assert got["aux"][:3] == [float(i == dims.SENSOR_ID[sensor]) for i in range(3)]
    assert sorted({r["site_id"] for r in records.values()}) == list(range(6))


def test_fill_forms_agree(spark):
    for mask in range(8):
        valid = [bool(mask >> t & 1) for t in range(3)]
        values = [10 * (t + 1) if valid[t] else 0 for t in range(3)]
        df = spark.createDataFrame([(values, valid)], "v array<int>, g array<boolean>")
        got = df.select(fx.fill_slots(F.col("v"), F.col("g"))).first()[0]
        assert got == [values[s] for s in ft.fill_order(valid)]
        assert df.select(fx.fill_slots(F.col("v"), F.col("g"), "zero")).first()[0] == values
    with pytest.raises(ValueError):
        fx.fill_slots(F.col("v"), F.col("g"), "mean")


def test_bad_options(spark, built, workspace):
    rows = store.read_store(spark, built)
    table = stats.frame_stats(rasters.read_frames(spark, f"{workspace['root']}/goes"))
    for config in (ft.FeatureConfig(missing_frames="mean"), ft.FeatureConfig(interpolation="area"), ft.FeatureConfig(bands="all")):
        with pytest.raises(ValueError):
            ft.feature_records(rows, table, config)


# ---- joins on decoded frames ----------------------------------------------------------------------
def test_joined_slots_equal_the_store(spark, workspace, manifest, built):
    frames = samples.cut_bands(rasters.read_frames(spark, [f"{workspace['root']}/{s}" for s in dims.SENSORS]), "ir_only")
    stacked = samples.stack_slots(samples.match_slots(mf.explode_slots(manifest), frames, ["pixels"]), "ir_only")
    got = {r["uid"]: [(f["t"], f["valid"], bytes(f["pixels"])) for f in r["frames"]] for r in stacked.collect()}
    assert got == {u: [(f["t"], f["valid"], bytes(f["pixels"])) for f in r["frames"]] for u, r in rows_of(spark, built).items()}


def test_hot_names_and_unnamed_slots(spark):
    """One frame is listed by most samples, and many slots have no name."""
    slots = spark.range(3000).select(
        F.col("id").cast("string").alias("uid"), F.lit("goes").alias("sensor"), F.lit(0).alias("t"),
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot.tif").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("filename"),
    )
    frames = spark.createDataFrame([("goes", "hot.tif", None, 1), ("goes", "f2", None, 2), ("goes", "f5", "bad", 3), ("himawari", "f8", None, 4)], "sensor string, filename string, error string, level int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = samples.outcome_counts(samples.match_slots(slots, frames, ["level"])).first()
        total = samples.match_slots(slots, frames, ["level"]).agg(F.sum("level")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (got["missing"], got["corrupt"], got["ok"], total) == (1000, 999, 1001, 1002)


def test_damaged_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/goes/x.tif", tiff.write_raster(np.zeros((16, 141, 141), np.uint8)))
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[5000] ^= 255
    (tmp_path / "a.zip").write_bytes(bytes(data))
    row = rasters.decode_frames(archive.read_members(archive.archive_index(spark, str(tmp_path)))).first()
    assert row["sensor"] == "goes" and row["error"] is not None


# ---- writing --------------------------------------------------------------------------------------
def test_predictions(spark, tmp_path):
    rate = np.random.default_rng(0).random(1681).astype(np.float32) * 5
    preds = spark.createDataFrame([("a", rate.tolist()), ("b", [0.0] * 1681)], "uid string, rate array<float>")
    names = spark.createDataFrame([("a", "one.tif"), ("b", "two.tif")], "uid string, target_file string")
    assert rasters.write_predictions(preds, names, str(tmp_path / "out")).count() == 2
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.tif", "two.tif"]
    back = {r["filename"]: r["rate"] for r in rasters.read_targets(spark, str(tmp_path / "out")).collect()}
    np.testing.assert_array_equal(np.float32(back["one.tif"]), rate)
    for broken in (preds.where("uid = 'a'"), preds.union(preds), preds.withColumn("rate", F.slice("rate", 1, 5))):
        with pytest.raises(ValueError, match="do not match"):
            rasters.write_predictions(broken, names, str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()


def test_headers_read_a_few_pages(tmp_path):
    """The directory lies behind 300 KB of pixels; none of them is read."""
    data = tiff.write_raster(np.zeros((16, 141, 141), np.uint8), (2.0, 0.0, 10.0, 0.0, -2.0, 20.0))
    path = tmp_path / "a.tif"
    path.write_bytes(data)
    with files.open_input(str(path)) as stream:
        ranges = tiff.Ranges(stream)
        assert tiff.read_stream_header(ranges) == tiff.read_header(data)
        assert len(data) > 300_000 and ranges.fetched <= 3 * 4096
    for broken in (b"", data[:9], data[:-200], b"II*\0" + b"\xff" * 40):
        path.write_bytes(broken)
        with files.open_input(str(path)) as stream, pytest.raises(tiff.RasterError):
            tiff.read_stream_header(tiff.Ranges(stream))


def test_short_transform_is_a_raster_error():
    entry = lambda tag, kind, count, cell: struct.pack("<HHI", tag, kind, count) + cell
    rows = [entry(256, 4, 1, struct.pack("<I", 1)), entry(257, 4, 1, struct.pack("<I", 1)), entry(34264, 3, 2, b"\0" * 4)]
    data = b"II*\0" + struct.pack("<IH", 8, len(rows)) + b"".join(rows) + b"\0" * 4
    with pytest.raises(tiff.RasterError, match="damaged"):
        tiff.read_header(data)


def test_broken_decoder_fails_the_task(spark, tmp_path):
    """A decoder's own KeyError is no fault of the file."""
    (tmp_path / "himawari").mkdir()
    (tmp_path / "himawari" / "a.tif").write_bytes(b"x")

    def decoder(data):
        return {}["pixels"]

    with pytest.raises(PySparkException, match="pixels"):
        rasters.read_frames(spark, str(tmp_path), decoder=decoder).collect()


# ---- streams --------------------------------------------------------------------------------------
def test_ingest_continues(spark, tmp_path):
    folder = tmp_path / "in" / "himawari"
    folder.mkdir(parents=True)
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    count = lambda: spark.read.parquet(str(tmp_path / "out")).count()
    for name in ("a", "b"):
        (folder / f"{name}.tif").write_bytes(tiff.write_raster(frame_pixels("himawari", 1)))
    ingest.start_ingest(*args).awaitTermination()
    assert count() == 2
    (folder / "c.tif").write_bytes(b"broken")
    ingest.start_ingest(*args).awaitTermination()
    ingest.start_ingest(*args).awaitTermination()
    assert count() == 3
    assert spark.read.parquet(str(tmp_path / "out")).where("error is not null").count() == 1


def test_report_from_the_state_store(spark, tmp_path):
    """Stopped and started again, the report is that of all pairs, and nothing is kept beside the checkpoint."""
    rng = np.random.default_rng(3)
    cells = [(int(s), int(k) if k else None, float(p), float(t)) for s, k, p, t in zip(rng.integers(0, 3, 600), rng.integers(0, 4, 600), rng.gamma(1, 3, 600), rng.gamma(1, 3, 600))]
    schema = "sensor_id int, site_id int, pred double, target double"
    seen = []
    for k in range(6):
        spark.createDataFrame(cells[100 * k : 100 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen += cells[100 * k : 100 * (k + 1)]
        if k in (0, 3, 5):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            live.start_cells(stream, str(tmp_path / "state")).awaitTermination()
            key = lambda r: (r["scope"], r["sensor_id"] is None, r["sensor_id"] or 0, r["site_id"] is None, r["site_id"] or 0)
            got = sorted(live.current_report(spark, str(tmp_path / "state")).collect(), key=key)
            want = sorted(verify.report(spark.createDataFrame(seen, schema)).collect(), key=key)
            assert len(got) == len(want)
            for a, b in zip(got, want):
                assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    assert {p.name for p in tmp_path.iterdir()} == {"in", "state"}


def test_other_state_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    counts = stream.groupBy("id").count().writeStream.outputMode("update").format("noop")
    counts.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(ValueError, match="another layout"):
        live.stored_cells(spark, str(tmp_path / "state"))
