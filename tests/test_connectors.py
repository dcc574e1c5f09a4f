"""Archive data source, committed sink, ensemble from folders."""
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from gridcast.operators import ensemble
from gridcast.sources import archive_source, raster_writer, rasters, tiff
from gridcast.sources.files import MemberReader
from gridcast.streaming import ingest


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    """Two archives of 30 members each in three folders; one name twice, one member damaged."""
    root = tmp_path_factory.mktemp("archives")
    rnd = np.random.default_rng(1)
    for a in range(2):
        with zipfile.ZipFile(root / f"a{a}.zip", "w") as z:
            z.writestr("top.csv", "at the top")
            z.writestr("data/goes/f_0_0.tif", b"an earlier member")
            for i in range(30):
                sensor = ("goes", "himawari", "meteosat")[i % 3]
                z.writestr(f"data/{sensor}/f_{a}_{i}.tif", bytes([i]) * 50 + rnd.bytes(20_000), zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
            z.writestr("data/goes/", b"")
    return str(root)


def test_members_by_range(spark, archives):
    for range_bytes in (1 << 30, 50_000):
        rows = archive_source.read_archives(spark, archives, range_bytes).collect()
        assert len(rows) == 61 and len({(r.archive, r.filename) for r in rows}) == 61
        assert all(r.content[:50] == bytes([int(r.filename[4:-4])]) * 50 for r in rows if (r.archive[-6:], r.filename) != ("a1.zip", "f_0_0.tif"))
        assert all(r.size == len(r.content) and r.path == f"{r.archive}!data/{r.sensor}/{r.filename}" for r in rows)


def test_filters_are_pushed(spark, archives, capsys):
    rows = archive_source.read_archives(spark, archives).where((F.col("sensor") == "goes") & F.col("filename").startswith("f_1") & (F.col("size") > 10))
    assert {r.filename for r in rows.collect()} == {f"f_1_{i}.tif" for i in range(0, 30, 3)}
    rows.explain("formatted")
    plan = capsys.readouterr().out
    kept = plan.split("Condition")[-1].split("\n")[0]
    assert "BatchScan raster_archive" in plan and "size" in kept and "sensor" not in kept and "filename" not in kept


def test_only_wanted_bytes_are_read(archives, monkeypatch):
    reader = archive_source.ArchiveReader({"path": archives, "rangebytes": "100000"})
    left = list(reader.pushFilters([In(("sensor",), ("goes", "himawari")), StringStartsWith(("filename",), "f_0"), EqualTo(("filename",), "f_0_4.tif"), GreaterThan(("size",), 3), EqualTo(("size",), "x")]))
    assert [type(f) for f in left] == [GreaterThan, EqualTo]
    counted = []
    plain = MemberReader.read
    monkeypatch.setattr(MemberReader, "read", lambda self, path, offset, size, *more: (counted.append(size), plain(self, path, offset, size, *more))[1])
    parts = reader.partitions()
    assert len(parts) > 4
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert [r["filename"] for r in rows] == ["f_0_4.tif"] and len(counted) == 1 and counted[0] < 21_000


def test_no_archives(spark, tmp_path):
    assert archive_source.read_archives(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="rangeBytes"):
        archive_source.read_archives(spark, str(tmp_path), 0).count()


def test_a_damaged_member_is_an_empty_content(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/goes/good.tif", b"g" * 100)
        z.writestr("d/goes/bad.tif", b"b" * 100)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[data.index(b"bbbb") + 5] ^= 1
    (tmp_path / "a.zip").write_bytes(data)
    got = {r.filename: bytes(r.content) for r in archive_source.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"good.tif": b"g" * 100, "bad.tif": b""}


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_a_failing_job_leaves_the_folder_as_it_was(spark, tmp_path):
    root = tmp_path / "out"
    files = lambda ids, text: spark.createDataFrame([(f"d/{i}.bin", f"{text}{i}".encode()) for i in ids], "filename string, content binary").repartition(6)
    raster_writer.save_files(files(range(20), "one"), str(root))
    before = tree(root)
    assert len(before) == 20 and before["d/3.bin"] == b"one3"
    bad = files(range(10, 40), "two").withColumn("content", F.when(F.col("filename") == "d/39.bin", F.raise_error(F.lit("half-way")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="half-way"):
        raster_writer.save_files(bad, str(root))
    for wrong in (files([1, 2, 2], "two"), files([1], "two").withColumn("filename", F.lit("../up")), files([1], "two").withColumn("content", F.lit(None).cast("binary"))):
        with pytest.raises(Exception, match="given twice|no file can be written"):
            raster_writer.save_files(wrong, str(root))
    assert tree(root) == before and [p.name for p in tmp_path.iterdir()] == ["out"]
    raster_writer.save_files(files(range(15, 25), "two"), str(root))
    assert len(tree(root)) == 25 and tree(root)["d/15.bin"] == b"two15" and tree(root)["d/14.bin"] == b"one14"
    raster_writer.save_files(files([7], "three"), f"file:{root}", "overwrite")
    assert tree(root) == {"d/7.bin": b"three7"}


def test_predictions_all_or_none(spark, tmp_path):
    preds = spark.createDataFrame([("a", [1.0] * 4), ("b", [2.0] * 4)], "uid string, rate array<float>")
    names = spark.createDataFrame([("a", "x.tif"), ("b", "y.tif")], "uid string, target_file string")
    with pytest.raises(ValueError, match="no prediction"):
        raster_writer.save_predictions(preds.limit(1), names, str(tmp_path / "p"), (2, 2))
    assert not (tmp_path / "p").exists()
    raster_writer.save_predictions(preds, names, str(tmp_path / "p"), (2, 2))
    assert {r.filename: list(r.rate) for r in rasters.read_targets(spark, str(tmp_path / "p"), (2, 2)).collect()} == {"x.tif": [1.0] * 4, "y.tif": [2.0] * 4}


def runs_at(tmp_path, grids):
    for run, files in grids.items():
        (tmp_path / run).mkdir()
        for name, grid in files.items():
            (tmp_path / run / name).write_bytes(tiff.write_raster(np.array(grid, np.float32).reshape(1, 2, 2)))
    return {run: str(tmp_path / run) for run in grids}


def test_runs_are_combined_from_folders(spark, tmp_path):
    grids = {"r1": {f"{i}.tif": [i, 0.1, 100, 2] for i in range(9)}, "r2": {f"{i}.tif": [1, 0.1, 100, 4] for i in range(9)}}
    ensemble.combine_runs(spark, runs_at(tmp_path, grids), str(tmp_path / "out"), {"r1": 3.0}, (2, 2))
    got = {r.filename: list(r.rate) for r in rasters.read_targets(spark, str(tmp_path / "out"), (2, 2)).collect()}
    assert got == {f"{i}.tif": [np.float32(0.75 * i + 0.25), 0.0, 60.0, 2.5] for i in range(9)}


@pytest.mark.parametrize("fault", ["gap", "damaged", "one run"])
def test_nothing_is_written_for_runs_that_do_not_fit(spark, tmp_path, fault):
    grids = {"r1": {"a.tif": [1] * 4, "b.tif": [1] * 4}, "r2": {"a.tif": [2] * 4, "b.tif": [2] * 4}}
    if fault == "gap":
        del grids["r2"]["b.tif"]
    if fault == "one run":
        del grids["r2"]
    runs = runs_at(tmp_path, grids)
    if fault == "damaged":
        (tmp_path / "r2" / "b.tif").write_bytes(b"no raster")
    with pytest.raises(Exception, match={"gap": "same files", "damaged": "b.tif", "one run": "at least 2"}[fault]):
        ensemble.combine_runs(spark, runs, str(tmp_path / "out"), size=(2, 2))
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(grids)


def small_files(folder, n):
    folder.mkdir(parents=True)
    raster = tiff.write_raster(np.ones((16, 2, 2), np.uint8))
    for i in range(n):
        (folder / f"f_{i}.tif").write_bytes(raster)


def test_small_files_share_tasks(spark, tmp_path):
    small_files(tmp_path / "goes", 400)  # 13 scan partitions of 32 files
    files = rasters.binary_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism == 4
    assert rasters.decode_frames(files, {"goes": (2, 2)}).where("error IS NULL").select("path").distinct().count() == 400


def test_files_of_runs_share_tasks(spark, tmp_path):
    for run in ("a", "b"):
        small_files(tmp_path / run, 200)
    files = ensemble.run_files(spark, {r: str(tmp_path / r) for r in ("a", "b")})
    assert files.rdd.getNumPartitions() == 8 and files.select("run", "filename").distinct().count() == 400


def test_local_files_are_moved_one_by_one(tmp_path, monkeypatch):
    workers = []
    pool = raster_writer.ThreadPoolExecutor
    monkeypatch.setattr(raster_writer, "ThreadPoolExecutor", lambda n: workers.append(n) or pool(n))
    for path, text in ((str(tmp_path / "out"), b"1"), (f"file:{tmp_path}/out", b"2")):
        writer = raster_writer.FilesWriter(path, False)
        batch = pa.RecordBatch.from_pydict({"filename": ["d/a.tif", "b.tif"], "content": [text, text]})
        writer.commit([writer.write(iter([batch]))])
        assert tree(tmp_path) == {"out/d/a.tif": text, "out/b.tif": text}
    assert workers == [1, 1]


def test_a_batch_of_small_files_is_listed_and_decoded_by_few_tasks(spark, tmp_path):
    small_files(tmp_path / "in" / "goes", 300)
    ingest.start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), {"goes": (2, 2)}, max_files=1000).awaitTermination()
    assert int(spark.conf.get(ingest.LIST_TASKS)) <= 16
    assert len(list((tmp_path / "out" / "sensor=goes").glob("*.parquet"))) <= 4
    assert spark.read.parquet(str(tmp_path / "out")).where("error IS NULL").select("filename").distinct().count() == 300
