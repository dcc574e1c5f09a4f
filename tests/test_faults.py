"""Cases that must not pass in silence: each fails or is reported."""
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridcast import scratch
from gridcast.functions import columns as fx
from gridcast.operators import ensemble, manifest as mf, ordered, sampling, verify
from gridcast.sources import files, rasters

CELLS = "uid int, sensor_id int, site_id int, pred array<float>, target array<float>"


def test_unmatched_samples_fail(spark):
    pred = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0]), (3, [3.0])], "uid int, pred array<double>")
    truth = spark.createDataFrame([(1, [1.0]), (3, [2.0]), (4, [2.0]), (5, None)], "uid int, target array<double>")
    assert {tuple(r) for r in verify.pair_faults(pred, truth).collect()} == {(2, "no truth"), (3, "repeated"), (4, "no forecast"), (5, "no forecast")}
    with pytest.raises(PySparkException, match="no partner for"):
        verify.pair_pixels(pred, truth).collect()
    assert verify.pair_pixels(pred.where("uid = 1"), truth.where("uid = 1")).count() == 1


def test_float_grids_are_compared_as_floats(spark):
    """0.1 stored as FLOAT does not exceed 0.1."""
    df = spark.createDataFrame([(0, 0, 0, [0.1, 0.5], [0.1, 0.1])], CELLS)
    pairs = verify.pair_pixels(df.select("uid", "pred"), df.select("uid", "sensor_id", "site_id", "target"))
    row = verify.report(pairs).where("scope = 'all'").first()
    assert (row["csi"], row["far"]) == (0.0, 1.0)


def test_null_pairs_count_nowhere(spark):
    rows = [(0, 0, 1.0, 2.0), (0, 0, None, 2.0), (0, 0, 3.0, None)]
    row = verify.report(spark.createDataFrame(rows, "sensor_id int, site_id int, pred double, target double")).first()
    assert (row["n"], row["mae"]) == (1, 1.0)


def test_incomplete_runs_fail(spark):
    rows = [("a", 1, 10.0), ("b", 1, 10.0), ("a", 2, 10.0)]
    df = spark.createDataFrame(rows, "run string, px int, rate double")
    weights = ensemble.run_weights(["a", "b"])
    for bad in (df, df.where("px = 1").union(df.where("px = 1 AND run = 'a'")), df.where("px = 1").withColumn("run", F.lit("c")), df.where("px = 1").withColumn("rate", F.when(F.col("run") == "a", F.col("rate")))):
        with pytest.raises(PySparkException):
            ensemble.combine_pixels(bad, ["px"], weights).collect()
    assert ensemble.combine_pixels(df.where("px = 1"), ["px"], weights).first()["rate"] == 10.0
    grids = df.where("px = 1").select("run", F.lit("f").alias("filename"), F.array("rate").alias("rate"))
    with pytest.raises(PySparkException):
        ensemble.combine_grids(grids.union(grids.where("run = 'a'").withColumn("run", F.lit("c"))), weights).collect()


def test_rows_without_site_stay(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "uid int, site string")
    assert {(r.uid, r.site_id) for r in mf.with_site_ids(df).collect()} == {(1, 1), (2, None), (3, 0)}


def test_frame_lists(spark):
    one = lambda cell: spark.createDataFrame([(cell,)], "c string").select(fx.frame_list(F.col("c")).alias("x")).first()["x"]
    assert one("( )") == [] and one("[ ]") == [] and one("['a', 'b']") == ["a", "b"] and one("('a',)") == ["a"]
    for bad in ("['a'] junk", "['a'", "'a'"):
        with pytest.raises(PySparkException):
            one(bad)


def test_manifest_headers_and_cells(spark, tmp_path):
    names = "unique_id,name_location,satellite_target,datetime,last_30_minutes_observation_filename,gpm_imerg_filename"
    row = "u1,s1,GOES,2024-01-01 00:00:00,[],t.tif"
    for i, (head, body) in enumerate([("name_location,unique_id," + names.split(",", 2)[2], row), (names, row.replace("2024-01-01", "soon"))]):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "a.csv").write_text(f"{names}\n{row}\n")
        (folder / "b.csv").write_text(f"{head}\n{body}\n")
        with pytest.raises(Exception, match="(?i)header|malformed|pars"):
            mf.read_manifest(spark, str(folder)).collect()


def test_predictions_need_a_file_name_each(spark, tmp_path):
    preds = spark.createDataFrame([(i, [0.0]) for i in range(4)], "uid int, rate array<double>")
    manifest = spark.createDataFrame([(0, "a.tif"), (1, None), (2, "b.tif"), (3, "b.tif")], "uid int, target_file string")
    assert {tuple(r) for r in rasters.prediction_faults(preds, manifest, (1, 1)).collect()} == {(1, "no file name"), (2, "repeated file name")}
    with pytest.raises(ValueError):
        rasters.write_predictions(preds, manifest, str(tmp_path), (1, 1))


def test_broken_connections_are_not_data(spark, tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        files.read_bytes(str(tmp_path / "nothing"))
    assert not issubclass(ConnectionError, files.DATA_FAULTS) and not issubclass(TimeoutError, files.DATA_FAULTS)
    assert not issubclass(PermissionError, files.DATA_FAULTS)


def test_draws_depend_on_rows_alone(spark):
    df = spark.range(500).select(F.col("id").alias("uid"), (1 + F.col("id") % 7).cast("double").alias("weight"))
    seen = set()
    batch, parts = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for p, b in ((2, 50), (4, 2000), (9, 77)):
            spark.conf.set("spark.sql.shuffle.partitions", str(p))
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(b))
            out = sampling.weighted_draws(df.repartition(p), 1000, seed=3).collect()
            assert sum(r.draws for r in out) == 1000
            seen.add(tuple(sorted(map(tuple, out))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(seen) == 1


def test_previous_row_keeps_nulls(spark):
    rows = [(0, i, None if i % 3 == 0 else float(i)) for i in range(60)] + [(1, 0, 5.0), (None, 1, 2.5), (None, 2, None)]
    df = spark.createDataFrame(rows, "k int, i int, x double").repartition(4)
    got = {(r.k, r.i): r.previous for r in ordered.previous_row(df, ["k"], ["i"], "x").collect()}
    want = {}
    for k in (0, 1, None):
        part = sorted(r for r in rows if r[0] == k)
        want |= {(k, r[1]): (part[n - 1][2] if n else None) for n, r in enumerate(part)}
    assert got == want


def test_ordered_blocks_are_not_sorted_again(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), F.col("id").alias("x"))
    for out in (ordered.running_sums(df, ["k"], ["i"], ["x"]), ordered.previous_row(df, ["k"], ["i"], "x")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "_slot" in x and ("Sort [" in x or "Exchange" in x or "Window" in x)]


def test_scratch_is_forgotten_when_dropped(spark):
    class Context:
        master = "yarn"

        def getConf(self):
            return spark.sparkContext.getConf()

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    if not spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.scratch_root(Session())
    scratch.BUILT[("here", "x")] = f"{scratch.scratch_root(spark)}/x"
    scratch.BUILT[("there", "x")] = "/elsewhere/x"
    before = dict(scratch.BUILT)
    mine = {k for k, v in before.items() if v.startswith(scratch.scratch_root(spark))}
    scratch.forget(spark)
    assert ("there", "x") in scratch.BUILT and not mine & set(scratch.BUILT)
    scratch.BUILT.update({k: v for k, v in before.items() if k[0] not in ("here", "there")})
    scratch.BUILT.pop(("there", "x"))


def test_broadcasts_are_bounded_in_bytes(spark):
    df = spark.range(100).select(F.col("id"), F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda out: "ResolvedHint" in out._jdf.queryExecution().analyzed().toString()
    assert hinted(scratch.broadcast_if_small(df)) and not hinted(scratch.broadcast_if_small(df, max_bytes=50_000))
    assert not hinted(scratch.broadcast_if_small(df, max_rows=99))
