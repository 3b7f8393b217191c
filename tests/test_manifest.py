"""Manifests, file sources and sinks, and the streaming forms."""

import datetime as dt

import pytest
import yaml

from waymark.plans import checks, manifest
from waymark.sources import files
from waymark.streaming import delay_windows, running_delay


def write(tmp_path, **more):
    (tmp_path / "raw.csv").write_text("ID;Name ;Geo;n;when\n1; brussels ;50.5, 4.25;3;2024-01-01 10:00:00\n2;ghent;51.0,3.7, x;2.5;bad\n", encoding="utf-8")
    m = {
        "id": "nodes", "sources": [{"name": "raw", "path": str(tmp_path / "{file}.csv"), "format": "csv", "options": {"sep": ";"}}],
        "rename": {"ID": "op_id", "Name ": "op_name", "absent": "x"}, "drop": ["zzz*"],
        "normalise": [{"column": "op_id", "type": "int"}, {"column": "op_name", "strip": True, "upper": True}, {"column": "n", "type": "int"}, {"column": "when", "type": "datetime"}, {"column": "Geo", "split": {"delimiter": ",", "into": {"lat": "float", "lon": "float"}}}],
        "checks": [{"unique": ["op_id"]}, {"not_null": ["op_id", "absent"]}, {"range": {"column": "lat", "min": 51, "max": 90}}], "output": {"path": str(tmp_path / "out")}, "lineage": str(tmp_path / "meta" / "lineage.yaml"),
    } | more
    p = tmp_path / "nodes.yaml"
    p.write_bytes(b"\xef\xbb\xbf" + yaml.safe_dump(m).encode())
    return p


def test_manifest(spark, tmp_path, caplog):
    done = manifest.execute(spark, str(write(tmp_path)), {"file": "raw"})
    assert done["rows"] == 2 and yaml.safe_load((tmp_path / "meta" / "lineage.yaml").read_text())["dataset"] == "nodes"
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("op_id").collect()
    assert [(r.op_id, r.op_name, r.n, r.lat, r.lon) for r in out] == [(1, "BRUSSELS", 3, 50.5, 4.25), (2, "GHENT", None, 51.0, None)]
    assert out[0].when == dt.datetime(2024, 1, 1, 10) and out[1].when is None
    assert "outside" in caplog.text


@pytest.mark.parametrize("more,error", [({"sources": []}, "source"), ({"transform": "unheard"}, "no transform"), ({"output": None}, "output"), ({"sources": [{"name": "a", "path": "x.csv"}, {"name": "b", "path": "x.csv"}]}, "several")])
def test_manifest_errors(tmp_path, more, error):
    with pytest.raises(ValueError, match=error):
        manifest.validate(manifest.load(str(write(tmp_path, **more))))


def test_transform_gets_what_it_asks_for(spark, tmp_path):
    @manifest.transform("twice")
    def twice(sources, params):
        return sources["raw"].unionAll(sources["raw"]).limit(params["n"])

    m = manifest.load(str(write(tmp_path, transform="twice", params={"n": 3}, checks=[])))
    assert manifest.build(spark, m, {"file": "raw"}).count() == 3
    manifest.TRANSFORMS["bad"] = lambda sources: 1
    with pytest.raises(TypeError):
        manifest.build(spark, m | {"transform": "bad"}, {"file": "raw"})


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="not unique"):
        checks.assert_unique(df, ["a"])
    with pytest.raises(ValueError, match="NULLs"):
        checks.assert_not_null(df, ["a", "b"])
    with pytest.raises(ValueError, match="not unique"):
        checks.join_many_to_one(df, df, ["a"])


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        files.read_table(spark, "x.xls")
    assert files.months("202311", "202402") == ["202311", "202312", "202401", "202402"]
    with pytest.raises(ValueError, match="not a month"):
        files.month("202413")
    assert files.read_table(spark, str(tmp_path / "none*.csv"), fields=["a"]).count() == 0
    df = spark.createDataFrame([("202401", 1), ("202402", 2)], "month string, x int")
    files.write_table(df, str(tmp_path / "t"), "parquet", "month")
    files.write_table(df.where("x = 2").withColumn("x", df.x + 7), str(tmp_path / "t"), "parquet", "month")
    assert sorted((str(r.month), r.x) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("202401", 1), ("202402", 9)]
    (tmp_path / "l.csv").write_bytes("a\né\n".encode("latin-1"))
    one = files.read_table(spark, str(tmp_path / "l.csv"), options={"encoding": "latin1"}, order=True).first()
    assert one.a == "é" and one.file_name == "l.csv" and one.seq == 0
    files.write_arrays(df, str(tmp_path / "x"), ["x"], 1)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 2


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [("a", "d", t + dt.timedelta(minutes=m), 1, 10 * m) for m in (0, 5, 70)]
    df = spark.createDataFrame(rows, "train_id string, service_date string, observed_ts timestamp, op_id long, delay_sec long")
    df.write.parquet(str(tmp_path / "in"))
    for name, build, mode, want in (("win", delay_windows, "complete", 2), ("run", running_delay, "update", 1)):
        q = build(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        assert spark.table(name).count() == want
    assert spark.table("run").first().delay_sec == 700


def test_order_of_a_file_read_in_parts(spark, tmp_path):
    """seq follows the rows of a file, however many tasks read it."""
    rows = 700_000
    (tmp_path / "a.csv").write_text("k\n" + "\n".join(f"{k:07d}" for k in range(rows)))
    (tmp_path / "b.csv").write_text("k\n" + "\n".join(f"{k:07d}" for k in range(9)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        got = files.read_table(spark, str(tmp_path), "csv", order=True)
        assert got.rdd.getNumPartitions() > 1
        for name, n in (("a.csv", rows), ("b.csv", 9)):
            one = got.where(f"file_name = '{name}'").toPandas().sort_values("seq")
            assert one.seq.is_unique and one.k.astype(int).tolist() == list(range(n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
