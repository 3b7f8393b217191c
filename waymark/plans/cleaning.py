"""Queries of the cleaning chain over stop records, each rule on its own and all together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import micros, seconds_between
from ..operators import clean
from . import adapter as A
from .registry import query

KEY = ["train_id", "service_date"]
_P = "epoch_us(planned_arr_ts) - epoch_us(planned_dep_ts)"
_O = "epoch_us(obs_arr_ts) - epoch_us(obs_dep_ts)"
FIXED = f"""bad AS (SELECT *, {_P} > 0 AS b, {_P} > 0 AND ({_P} > 120000000 OR {_O} > 120000000) AS large FROM stops),
fixed AS (SELECT train_id, service_date, seq, op_id, arr_line_id, dep_line_id, CASE WHEN b THEN planned_dep_ts ELSE planned_arr_ts END AS planned_arr_ts, planned_dep_ts,
  CASE WHEN b THEN obs_dep_ts ELSE obs_arr_ts END AS obs_arr_ts, obs_dep_ts FROM (SELECT *, bool_or(large) OVER (PARTITION BY train_id, service_date) AS gone FROM bad) WHERE NOT gone)"""
EVENTS = """three AS (
  SELECT train_id, service_date, seq * 3 AS seq, op_id, 'P' AS event_type, planned_arr_ts AS planned_ts, obs_arr_ts AS observed_ts, arr_line_id, dep_line_id FROM fixed WHERE planned_arr_ts = planned_dep_ts
  UNION ALL SELECT train_id, service_date, seq * 3 + 1, op_id, 'A', planned_arr_ts, obs_arr_ts, arr_line_id, NULL FROM fixed WHERE planned_arr_ts <> planned_dep_ts
  UNION ALL SELECT train_id, service_date, seq * 3 + 2, op_id, 'D', planned_dep_ts, obs_dep_ts, NULL, dep_line_id FROM fixed WHERE planned_arr_ts <> planned_dep_ts)"""


def clamp_sql(source: str, out: str, column: str, limit: int = 120) -> str:
    us = f"epoch_us({column})"
    return f"""{out}_1 AS (SELECT *, {us} - lag({us}) OVER (PARTITION BY train_id, service_date ORDER BY seq) AS d FROM {source}),
{out}_2 AS (SELECT *, sum(CASE WHEN d >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY train_id, service_date ORDER BY seq) AS g FROM {out}_1),
{out}_3 AS (SELECT *, sum(least(coalesce(d, 0), 0)) OVER (PARTITION BY train_id, service_date, g ORDER BY seq) AS s FROM {out}_2),
{out}_4 AS (SELECT *, min(s) OVER (PARTITION BY train_id, service_date) AS worst FROM {out}_3),
{out} AS (SELECT * EXCLUDE (d, g, s, worst) REPLACE (max({column}) OVER (PARTITION BY train_id, service_date ORDER BY seq) AS {column}) FROM {out}_4 WHERE worst >= -{limit} * 1000000)"""


COLS = "train_id, service_date, seq, op_id, event_type, planned_ts, observed_ts"
BUILT = ",\n".join([A.STOPS, FIXED, EVENTS, clamp_sql("three", "c1", "planned_ts"), clamp_sql("c1", "c2", "observed_ts")]) + """,
late AS (SELECT *, (epoch_us(observed_ts) - epoch_us(planned_ts)) / 1e6 AS delay_sec FROM c2),
bounded AS (SELECT * FROM (SELECT *, max(delay_sec) OVER (PARTITION BY train_id, service_date) AS hi, min(delay_sec) OVER (PARTITION BY train_id, service_date) AS lo FROM late) WHERE hi <= 14400 AND lo >= -3600),
built AS (SELECT * FROM bounded QUALIFY row_number() OVER (PARTITION BY train_id, service_date, event_type, op_id ORDER BY seq) = 1)"""


@query("p04_conflict_flags", A.with_ctes(A.STOPS, tail=f"SELECT train_id, service_date, seq, {_P} > 0 AS conflict, {_P} > 0 AND ({_P} > 120000000 OR {_O} > 120000000) AS large FROM stops"))
def conflict_flags(spark, sf):
    p, o = seconds_between(F.col("planned_arr_ts"), F.col("planned_dep_ts")), seconds_between(F.col("obs_arr_ts"), F.col("obs_dep_ts"))
    return A.stops(spark, sf).select(*KEY, "seq", (p > 0).alias("conflict"), ((p > 0) & ((p > 120) | (o > 120))).alias("large"))


@query("p05_resolve_conflicts", A.with_ctes(A.STOPS, FIXED, tail="SELECT train_id, service_date, seq, planned_arr_ts, planned_dep_ts, obs_arr_ts, obs_dep_ts FROM fixed"))
def resolve(spark, sf):
    return clean.resolve_conflicts(A.stops(spark, sf, by_journey=True)).select(*KEY, "seq", "planned_arr_ts", "planned_dep_ts", "obs_arr_ts", "obs_dep_ts")


@query("j05_bad_journeys_dropped", A.with_ctes(A.STOPS, f"badkeys AS (SELECT DISTINCT train_id, service_date FROM stops WHERE {_P} > 120000000)", tail="SELECT train_id, service_date, count(*) AS n_stops FROM stops ANTI JOIN badkeys USING (train_id, service_date) GROUP BY ALL"))
def bad_journeys(spark, sf):
    s = A.stops(spark, sf, by_journey=True)
    bad = s.where(seconds_between(F.col("planned_arr_ts"), F.col("planned_dep_ts")) > 120).select(*KEY).distinct()
    return s.join(bad, KEY, "left_anti").groupBy(*KEY).agg(F.count("*").alias("n_stops"))


@query("o02_stops_to_events", A.with_ctes(A.STOPS, FIXED, EVENTS, tail=f"SELECT {COLS}, arr_line_id, dep_line_id FROM three"))
def explode_stops(spark, sf):
    return clean.stops_to_events(clean.resolve_conflicts(A.stops(spark, sf, by_journey=True))).select(*COLS.split(", "), "arr_line_id", "dep_line_id")


@query("w02_clamp_planned", A.with_ctes(A.EV, clamp_sql("ev", "c", "planned_ts"), tail=f"SELECT {COLS} FROM c"))
def clamp_planned(spark, sf):
    return clean.clamp_backward(A.events(spark, sf), "planned_ts").select(*COLS.split(", "))


@query("w03_clamp_shift", A.with_ctes(A.EV, clamp_sql("ev", "c", "planned_ts"), tail="SELECT count(*) AS n_rows, count(*) FILTER (WHERE epoch_us(c.planned_ts) > epoch_us(ev.planned_ts)) AS n_clamped, sum(epoch_us(c.planned_ts) - epoch_us(ev.planned_ts))::BIGINT AS shift_us FROM c JOIN ev USING (seq)"))
def clamp_shift(spark, sf):
    e = A.events(spark, sf)
    c = clean.clamp_backward(e.withColumn("before", F.col("planned_ts")), "planned_ts")
    d = micros(F.col("planned_ts")) - micros(F.col("before"))
    return c.agg(F.count("*").alias("n_rows"), F.count_if(d > 0).alias("n_clamped"), F.sum(d).alias("shift_us"))


@query("w01_previous_step", A.with_ctes(A.EV, tail="SELECT seq, epoch_us(planned_ts) - lag(epoch_us(planned_ts)) OVER (PARTITION BY train_id, service_date ORDER BY seq) AS step_us FROM ev"))
def previous_step(spark, sf):
    t = micros(F.col("planned_ts"))
    return A.events(spark, sf).select("seq", (t - F.lag(t).over(clean.ordered())).alias("step_us"))


@query("w04_streak_ids", A.with_ctes(A.EV, tail="SELECT seq, (sum(CASE WHEN d >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY train_id, service_date ORDER BY seq))::BIGINT AS streak FROM (SELECT *, epoch_us(planned_ts) - lag(epoch_us(planned_ts)) OVER (PARTITION BY train_id, service_date ORDER BY seq) AS d FROM ev)"))
def streak_ids(spark, sf):
    t = micros(F.col("planned_ts"))
    e = A.events(spark, sf).withColumn("d", t - F.lag(t).over(clean.ordered()))
    return e.select("seq", F.sum(F.when(F.col("d") >= 0, 1).otherwise(0)).over(clean.ordered()).cast("bigint").alias("streak"))


@query("p03_delay_seconds", A.with_ctes(A.EV, tail="SELECT seq, (epoch_us(observed_ts) - epoch_us(planned_ts)) / 1e6 AS delay_sec FROM ev"))
def delay_seconds(spark, sf):
    return clean.add_delay(A.events(spark, sf).drop("delay_sec")).select("seq", "delay_sec")


@query("a02_delay_bounds", A.with_ctes(A.EV, tail="SELECT train_id, service_date, seq FROM (SELECT *, max(delay_sec) OVER (PARTITION BY train_id, service_date) AS hi, min(delay_sec) OVER (PARTITION BY train_id, service_date) AS lo FROM ev) WHERE hi <= 1200 AND lo >= -450"))
def delay_bounds(spark, sf):
    return clean.bound_delays(A.events(spark, sf), 1200, 450).select(*KEY, "seq")


@query("a03_any_flag", A.with_ctes(A.EV, tail="SELECT seq, bool_or(delay_sec > 2000) OVER (PARTITION BY train_id, service_date) AS any_late, count(*) OVER (PARTITION BY train_id, service_date) AS n_events FROM ev"))
def any_flag(spark, sf):
    w = clean.whole()
    return A.events(spark, sf).select("seq", F.bool_or(F.col("delay_sec") > 2000).over(w).alias("any_late"), F.count("*").over(w).alias("n_events"))


@query("a06_keep_first", A.with_ctes(A.EV, tail="SELECT seq FROM ev QUALIFY row_number() OVER (PARTITION BY train_id, event_type, op_id ORDER BY seq) = 1"))
def keep_first(spark, sf):
    return clean.keep_first(A.events(spark, sf), ["train_id", "event_type", "op_id"]).select("seq")


@query("p06_timestamps_present", A.with_ctes(A.STOPS, tail="SELECT train_id, seq FROM stops WHERE planned_arr_ts IS NOT NULL OR obs_arr_ts IS NOT NULL"))
def timestamps_present(spark, sf):
    return A.stops(spark, sf).where("planned_arr_ts is not null or obs_arr_ts is not null").select("train_id", "seq")


@query("s_build_events", "WITH " + BUILT + f" SELECT {COLS}, delay_sec FROM built")
def build_events(spark, sf):
    return clean.build_events(A.stops(spark, sf, by_journey=True)).select(*COLS.split(", "), "delay_sec")


@query("o01_stable_sort", A.with_ctes(A.EV, tail="SELECT seq, row_number() OVER (ORDER BY service_date, train_id, seq) AS place FROM ev"))
def stable_sort(spark, sf):
    """The place of every event in the order of date, train and row: numbered inside a date, dates (a row each) by a running sum."""
    from pyspark.sql import Window as W

    e = A.events(spark, sf).select("seq", "service_date", "train_id")
    before = e.groupBy("service_date").count().select("service_date", F.coalesce(F.sum("count").over(W.orderBy("service_date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("service_date").orderBy("train_id", "seq"))
    return e.withColumn("k", inside).join(before, "service_date").select("seq", (F.col("before") + F.col("k")).cast("bigint").alias("place"))
