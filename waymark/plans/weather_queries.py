"""Queries over hourly weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, weather
from . import adapter as A
from .registry import query
from .snapshot_queries import AROUND, ACT, JRN, KEY, split

VAR = ("temperature_2m",)
HOURLY = """once AS (SELECT op_id, time, temperature_2m FROM wx QUALIFY row_number() OVER (PARTITION BY op_id, time ORDER BY seq DESC) = 1),
grid AS (SELECT op_id, unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM once GROUP BY op_id),
hourly AS (SELECT g.op_id, g.time, last_value(temperature_2m IGNORE NULLS) OVER (PARTITION BY g.op_id ORDER BY g.time) AS temperature_2m FROM grid g LEFT JOIN once o ON o.op_id = g.op_id AND o.time = g.time)"""


def hourly(spark, sf):
    return weather.hourly(A.raw_weather(spark, sf), VAR)


@query("a07_keep_last", A.with_ctes(A.WX, tail="SELECT op_id, time, temperature_2m FROM wx QUALIFY row_number() OVER (PARTITION BY op_id, time ORDER BY seq DESC) = 1"))
def keep_last(spark, sf):
    return clean.keep_last(A.raw_weather(spark, sf), ["op_id", "time"]).select("op_id", "time", "temperature_2m")


@query("w10_w11_hourly_grid", A.with_ctes(A.WX, HOURLY, tail="SELECT op_id, time, temperature_2m FROM hourly"))
def hourly_grid(spark, sf):
    return hourly(spark, sf)


NOW = "w AS (SELECT l.train_id, l.service_date, l.snapshot_ts, p.op_id AS prev_op, f.op_id AS next_op FROM lkd l LEFT JOIN pst p ON p.train_id = l.train_id AND p.service_date = l.service_date AND p.snapshot_ts = l.snapshot_ts AND p.slot = 1 LEFT JOIN fut f ON f.train_id = l.train_id AND f.service_date = l.service_date AND f.snapshot_ts = l.snapshot_ts AND f.slot = 1)"
VALUES = "v AS (SELECT w.*, a.temperature_2m AS pt, b.temperature_2m AS nt FROM w LEFT JOIN hourly a ON a.op_id = prev_op % 10 AND a.time = date_trunc('hour', snapshot_ts) LEFT JOIN hourly b ON b.op_id = next_op % 10 AND b.time = date_trunc('hour', snapshot_ts))"


def around(spark, sf):
    s = split(spark, sf, 1, 1)
    station = lambda c: F.when(F.col(c)[0]["op_id"] == -1, -1).otherwise(F.col(c)[0]["op_id"] % 10)
    return s.select(*KEY, "snapshot_ts", station("past_slots").cast("bigint").alias("prev_op"), station("future_slots").cast("bigint").alias("next_op"))


@query("j12_weather_at_stop", A.with_ctes(A.EV, A.SNAP, JRN, ACT, AROUND, A.WX, HOURLY, NOW, VALUES, tail="SELECT train_id, service_date, snapshot_ts, pt AS prev_temperature_2m, nt AS next_temperature_2m FROM v"))
def weather_at_stop(spark, sf):
    h, r = hourly(spark, sf), around(spark, sf)
    r = weather.at_station(weather.at_station(r, h, "prev_op", "prev", variables=VAR), h, "next_op", "next", variables=VAR)
    return r.select(*KEY, "snapshot_ts", "prev_temperature_2m", "next_temperature_2m")


@query("j13_weather_blend", A.with_ctes(A.EV, A.SNAP, JRN, ACT, AROUND, A.WX, HOURLY, NOW, VALUES, tail="SELECT train_id, service_date, snapshot_ts, CASE WHEN prev_op IS NULL THEN nt WHEN next_op IS NULL THEN pt ELSE (pt + nt) / 2 END AS temperature_2m FROM v"))
def weather_blend(spark, sf):
    h, r = hourly(spark, sf), around(spark, sf)
    r = weather.at_station(weather.at_station(r, h, "prev_op", "prev", variables=VAR), h, "next_op", "next", variables=VAR)
    return weather.blend(r, "prev_op", "next_op", variables=VAR).select(*KEY, "snapshot_ts", "temperature_2m")


@query("j12_missing_hours", A.with_ctes(A.EV, A.SNAP, A.WX, "h AS (SELECT DISTINCT time FROM wx WHERE op_id < 3)", tail="SELECT DISTINCT date_trunc('hour', snapshot_ts)::TIMESTAMP AS time FROM snap WHERE date_trunc('hour', snapshot_ts)::TIMESTAMP NOT IN (SELECT time FROM h)"))
def missing_hours(spark, sf):
    return weather.missing_hours(A.snapshots(spark), A.raw_weather(spark, sf).where("op_id < 3"))


@query("j11_nearest_weather", A.with_ctes(A.WX, tail="SELECT op_id, time, temperature_2m FROM wx WHERE seq = 0 AND time = (SELECT time FROM wx WHERE seq = 0 ORDER BY abs(epoch_us(time) - epoch_us(TIMESTAMP '2024-01-15 12:20:00')), time LIMIT 1)"))
def nearest_weather(spark, sf):
    from ..functions.scalars import micros

    w = A.raw_weather(spark, sf).where("seq = 0")
    want = micros(F.lit("2024-01-15 12:20:00").cast("timestamp_ntz"))
    one = w.select("time").orderBy(F.abs(micros(F.col("time")) - want), "time").limit(1)
    return w.join(F.broadcast(one), "time", "left_semi").select("op_id", "time", "temperature_2m")


#: The groups of weather codes.
GROUPS = {"clear": (0, 1, 2), "cloud": (3,), "fog": (45, 48), "drizzle": (51, 53, 55, 56, 57), "rain": (61, 63, 65, 66, 67, 80, 81, 82), "snow": (71, 73, 75, 77, 85, 86), "thunder": (95, 96, 99)}


def group_of(code):
    out = F.concat(F.lit("other ("), code.cast("string"), F.lit(")"))
    for name, codes in GROUPS.items():
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


CASE = "CASE " + " ".join(f"WHEN op_id IN ({', '.join(map(str, c))}) THEN '{n}'" for n, c in GROUPS.items()) + " ELSE 'other (' || op_id || ')' END"


@query("d19_weather_groups", A.with_ctes(A.EV, tail=f"SELECT grp, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, list(DISTINCT op_id ORDER BY op_id) AS codes FROM (SELECT {CASE} AS grp, op_id FROM ev) GROUP BY grp"))
def weather_groups(spark, sf):
    from pyspark.sql import Window as W

    g = A.events(spark, sf).groupBy(group_of(F.col("op_id")).alias("grp")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("op_id")).alias("codes"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))
