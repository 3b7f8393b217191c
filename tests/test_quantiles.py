"""Exact quantiles and merged intervals against NumPy and plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import intervals, quantiles


def test_quantiles_are_those_of_numpy(spark):
    r = random.Random(4)
    rows = [("hot", float(r.choice((1, 2, 2, 2, 7, 9)))) for _ in range(900)] + [(f"g{k % 40}" if k % 5 else None, r.gauss(0, 9)) for k in range(700)] + [("one", 3.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    names = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {x.g: x for x in quantiles.exact(df, "x", names, ("g",)).collect()}
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert [got[g][n] for n in names] == pytest.approx(np.quantile(v, list(names.values())).tolist(), abs=1e-9)
    whole = quantiles.exact(df, "x", names).collect()
    assert len(whole) == 1 and [whole[0][n] for n in names] == pytest.approx(np.quantile([x for v in groups.values() for x in v], list(names.values())).tolist(), abs=1e-9)
    assert quantiles.exact(df.limit(0), "x", names, ("g",)).count() == 0


def test_no_task_holds_a_group(spark):
    plan = quantiles.exact(spark.range(1000).select(F.lit("one").alias("g"), F.col("id").cast("double").alias("x")), "x", {"m": 0.5}, ("g",))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan


def test_intervals_merged_by_day(spark):
    r, day0 = random.Random(5), dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(150):
        a = day0 + dt.timedelta(minutes=r.randrange(0, 20 * 1440, 5))
        rows.append((a, a + dt.timedelta(minutes=r.choice((0, 5, 30, 200, 1600)))))
    rows += [(day0 + dt.timedelta(days=30), day0 + dt.timedelta(days=31)), (day0 + dt.timedelta(days=31), day0 + dt.timedelta(days=31, minutes=5)), (day0 + dt.timedelta(days=40), day0 + dt.timedelta(days=44))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, z timestamp_ntz")
    want = []
    for a, z in sorted(x for x in rows if x[0] < x[1]):
        if want and a <= want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], z), want[-1][2] + 1)
        else:
            want.append((a, z, 1))
    assert sorted(map(tuple, intervals.merge_by_day(df, "a", "z").collect())) == want
    assert sorted(map(tuple, intervals.merge_intervals(df, "a", "z").collect())) == want
