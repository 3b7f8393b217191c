"""Statistics, normalisation, weather, evaluation."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import scalars as S
from waymark.operators import evaluate, features, weather


def test_normalisation_learns_from_train_only(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 2.0), ("train", 3.0), ("test", 10.0), ("train", float("nan")), ("train", None)], "split string, x double").withColumn("y", F.col("x"))
    s = features.moments(df, ["x", "y"])
    r = s.where("column = 'x'").first()
    assert (r.n, r["mean"], r["std"], r.low, r.high) == (3, 2.0, 1.0, 1.0, 3.0)
    out = features.normalise(df, s, z=["x"], scaled=["y"]).where("split = 'test'").first()
    assert (out.x, out.y) == (8.0, 1.0)


def test_constant_and_single_values(spark):
    one = features.moments(spark.createDataFrame([("train", 5.0)], "split string, x double"), ["x"]).first()
    assert (one["mean"], one["std"]) == (5.0, 0.0)
    df = spark.createDataFrame([(3.0,)], "x double")
    assert df.select(S.z_score(F.col("x"), F.lit(1.0), F.lit(0.0)), S.min_max(F.col("x"), F.lit(2.0), F.lit(2.0))).first()[:] == (2.0, 0.0)


def test_bins(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (5.0,), (45.0,), (None,)], "x double")
    labels = evaluate.bin_label(evaluate.HORIZON_MIN, "m")
    got = [r[0] for r in df.select(S.right_bin(F.col("x"), evaluate.HORIZON_MIN)).collect()]
    assert [None if g is None else labels[g] for g in got] == ["[0,5)m", "[0,5)m", "[5,10)m", "[45,inf)m", None]


def tables(spark, pred):
    t = dt.datetime(2024, 1, 1)
    truth = spark.createDataFrame([(t, "a", "d", 10.0, t + dt.timedelta(minutes=7), 20.0), (t, "b", "d", 0.0, t + dt.timedelta(minutes=50), 4.0)], "ts timestamp_ntz, train_id string, service_date string, last_known_delay double, future_obs_ts_1 timestamp_ntz, future_delay_1 double")
    return truth, spark.createDataFrame([(t, k, "d", v) for k, v in pred], "ts timestamp_ntz, train_id string, service_date string, future_delay_1 double")


def test_metrics(spark):
    r = evaluate.evaluate(*tables(spark, [("a", 23.0), ("b", 0.0)]))
    assert r["mae"] == 3.5 and r["rmse"] == pytest.approx(math.sqrt(12.5)) and r["n_values"] == 2
    assert set(r["horizon"]) == {"[5,10)m", "[45,inf)m"} and r["change"]["[0,30)s"]["n_values"] == 2


@pytest.mark.parametrize("pred", [[("a", 1.0)], [("a", 1.0), ("b", 1.0), ("c", 1.0)], [("a", 1.0), ("b", None)]])
def test_alignment_errors(spark, pred):
    with pytest.raises(ValueError):
        evaluate.evaluate(*tables(spark, pred))


def test_column_errors(spark):
    truth, pred = tables(spark, [("a", 1.0)])
    with pytest.raises(KeyError):
        evaluate.check_columns(truth, pred.drop("train_id"))
    with pytest.raises(KeyError):
        evaluate.check_columns(truth, pred.withColumnRenamed("future_delay_1", "future_delay_2"))


def test_seeds():
    s = evaluate.summarise_seeds([{"mae": 1.0, "n_values": 5, "horizon": {"x": {"mae": 2.0}}}, {"mae": 3.0, "n_values": 5, "horizon": {"x": {"mae": 2.0}}}])
    assert s == {"mae": {"mean": 2.0, "std": 1.0}, "horizon/x/mae": {"mean": 2.0, "std": 0.0}}


def test_hourly_grid(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, 1.0, 0), (1, t, 2.0, 1), (1, t + dt.timedelta(hours=3), 5.0, 2)], "op_id long, time timestamp_ntz, rain double, seq int")
    out = weather.hourly(df, ("rain",)).orderBy("time").collect()
    assert [r.rain for r in out] == [2.0, 2.0, 2.0, 5.0]


def test_blend(spark):
    df = spark.createDataFrame([(-1, 2, None, 4.0), (1, -1, 6.0, None), (1, 2, 2.0, 4.0)], "a long, b long, prev_rain double, next_rain double")
    assert [r.rain for r in weather.blend(df, "a", "b", variables=("rain",)).collect()] == [4.0, 6.0, 3.0]


def test_holdout_and_splits(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in range(1, 6)], "snapshot_ts timestamp_ntz")
    assert [r.snapshot_ts.day for r in features.temporal_holdout(df, 0.01).where("fold = 'valid'").collect()] == [5]
    assert features.temporal_holdout(df, 0.5).where("fold = 'valid'").count() == 2  # round half to even
    with pytest.raises(ValueError, match="no split"):
        features.split_rows(df, df.limit(2).withColumn("split", F.lit("train")))


def test_columns(spark):
    assert features.slot_columns(["f_10", "f_2", "f_x", "g_1"], "f_") == ["f_2", "f_10"]
    with pytest.raises(ValueError, match="no family"):
        features.families(["unheard_of"])
    df = spark.createDataFrame([(1, 2)], "uv_a int, vu_a int")
    assert features.swap_directions(df).first()[:] == (2, 1)
    with pytest.raises(KeyError):
        features.ordered_columns(df, ["nope"])


def test_relation_types(spark):
    df = spark.createDataFrame([("IC 01",), ("S51",), ("s 3",), ("unheard",), (None,), (" nan ",)], "r string")
    assert [r[0] for r in df.select(S.relation_type(F.col("r"))).collect()] == ["IC", "S", "S", None, "nan", "nan"]


def test_boosted_trees_mask_rows_without_a_target(spark):
    from waymark.operators import boosted

    rows = [(float(k % 7), float(k % 3), None if k % 5 == 0 else float(10 * (k % 7))) for k in range(140)]
    df = spark.createDataFrame(rows, "past_delay_sec_1 double, weather_rain double, y double").coalesce(1)
    names = ["past_delay_sec_1", "weather_rain"]
    masked, known = boosted.fit(df, names, "y"), boosted.fit(df.where("y is not null"), names, "y")
    got, want = boosted.errors(masked, df, "y").first(), boosted.errors(known, df, "y").first()
    assert got.n == want.n == 112 and abs(got.mae - want.mae) < 1e-9 and got.mae < 5
    out = {f: (n, change) for f, n, _, change in boosted.ablation(df, df, names, "y")}
    assert out["all"] == (0, 0.0) and set(out) == {"all", "past_delay_features", "weather_features"}
    assert out["past_delay_features"][1] > 5 and abs(out["weather_features"][1]) < 2


def test_the_pairs_of_an_evaluation_are_joined_once(spark):
    """However many tables are made of them: each value of the truth is read once."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    truth, pred = tables(spark, [("a", 23.0), ("b", 0.0)])
    truth = truth.withColumn("last_known_delay", F.udf(look, "double")(F.col("last_known_delay").cast("double")))
    assert evaluate.evaluate(truth, pred)["n_values"] > 0
    assert seen.value == truth.count()
