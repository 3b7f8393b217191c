"""Queries over features: statistics on the train split, normalisation, encodings, travel times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features, journeys, quantiles
from . import adapter as A
from .registry import query
from .snapshot_queries import BASE, KEY, split, targets

MONTHS = "f AS (SELECT *, CASE WHEN observed_ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS split FROM ev)"


def rows(spark, sf):
    e = A.events(spark, sf)
    return e.withColumn("split", F.when(F.col("observed_ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "train").otherwise("test"))


@query("a08_train_moments", A.with_ctes(A.EV, MONTHS, tail="SELECT c AS \"column\", count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS low, max(x) AS high FROM (SELECT 'delay_sec' AS c, delay_sec::DOUBLE AS x FROM f WHERE split = 'train' UNION ALL SELECT 'op_id', op_id::DOUBLE FROM f WHERE split = 'train') GROUP BY 1"))
def train_moments(spark, sf):
    m = features.moments(rows(spark, sf), ["delay_sec", "op_id"])
    return m.select("column", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high")


@query("a10_single_value_std", A.with_ctes(A.EV, tail="SELECT 1::BIGINT AS n, delay_sec::DOUBLE AS mean, 0::DOUBLE AS std FROM ev WHERE seq = 17"))
def single_value(spark, sf):
    return features.moments(A.events(spark, sf).where("seq = 17").withColumn("split", F.lit("train")), ["delay_sec"]).select("n", "mean", "std")


@query("a11_pooled_stats", A.with_ctes(*BASE, tail="SELECT 'future' AS family, count(*) AS n, round(avg(future_delay), 6) AS mean, round(stddev_samp(future_delay), 6) AS std FROM tgt WHERE split = 'train'"))
def pooled_stats(spark, sf):
    t = targets(spark, sf).groupBy(*KEY, "snapshot_ts", "split").agg(*[F.max(F.when(F.col("slot") == k, F.col("future_delay"))).alias(f"future_{k}") for k in (1, 2, 3)])
    p = features.pooled(t, {"future": ["future_1", "future_2", "future_3"]})
    return p.select("family", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("f05_f06_normalised", A.with_ctes(A.EV, MONTHS, "s AS (SELECT avg(delay_sec) AS m, stddev_samp(delay_sec) AS d, min(op_id) AS lo, max(op_id) AS hi FROM f WHERE split = 'train')", tail="SELECT seq, round((delay_sec - m) / d, 6) AS z, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (op_id - lo) / (hi - lo)::DOUBLE)), 6) AS mm FROM f, s"))
def normalised(spark, sf):
    r = rows(spark, sf)
    out = features.normalise(r, features.moments(r, ["delay_sec", "op_id"]), z=["delay_sec"], scaled=["op_id"])
    return out.select("seq", F.round("delay_sec", 6).alias("z"), F.round("op_id", 6).alias("mm"))


@query("f04_signed_sqrt", A.with_ctes(A.EV, tail="SELECT seq, round(sign(delay_sec) * sqrt(abs(delay_sec)), 6) AS root, round(sign(delay_sec) * (sqrt(abs(delay_sec)) ** 2), 4) AS back FROM ev"))
def signed_root(spark, sf):
    x = S.signed_sqrt(F.col("delay_sec"))
    return A.events(spark, sf).select("seq", F.round(x, 6).alias("root"), F.round(S.signed_square(x), 4).alias("back"))


CYC = ", ".join(f"round({f}(a * {2 * 3.141592653589793 * k}), 6) + 0.0::DOUBLE AS day_{f}_{k}" for k in (1, 2, 4) for f in ("sin", "cos"))


@query("f03_cyclic_day", A.with_ctes(A.EV, tail=f"SELECT seq, {CYC} FROM (SELECT seq, (hour(observed_ts) + minute(observed_ts) / 60.0::DOUBLE + second(observed_ts) / 3600.0::DOUBLE) / 24.0::DOUBLE AS a FROM ev)"))
def cyclic_day(spark, sf):
    e = A.events(spark, sf).select("seq", *S.cyclic(S.day_fraction(F.col("observed_ts")), "day"))
    return e.select("seq", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in e.columns if c != "seq"])


DAYS = ", ".join(f"(dayname(observed_ts) = '{d}')::INTEGER AS weekday_{d}" for d in S.WEEKDAYS)


@query("f10_weekday_indicators", A.with_ctes(A.EV, tail=f"SELECT seq, {DAYS} FROM ev"))
def weekdays(spark, sf):
    return A.events(spark, sf).select("seq", *S.indicators(F.date_format("observed_ts", "EEEE"), S.WEEKDAYS, "weekday"))


@query("n16_relation_type", A.with_ctes(A.EV, tail="SELECT train_relation, CASE WHEN train_relation LIKE 'S%' THEN 'S' ELSE split_part(train_relation, ' ', 1) END AS relation_type, count(*) AS n FROM ev GROUP BY 1, 2"))
def relation_types(spark, sf):
    return A.events(spark, sf).groupBy("train_relation", S.relation_type(F.col("train_relation")).alias("relation_type")).agg(F.count("*").alias("n"))


QS = [k / 100 for k in range(5, 50, 5)]
PAIRS = "p AS (SELECT op_id // 10 AS a, lead(op_id) OVER w // 10 AS b, epoch_us(lead(observed_ts) OVER w) - epoch_us(observed_ts) AS us FROM ev WINDOW w AS (PARTITION BY train_id, service_date ORDER BY observed_ts, planned_ts, seq))"


@query("a12_travel_time_quantiles", A.with_ctes(A.EV, PAIRS, tail="SELECT a, b, count(*) AS n, min(us) AS low, max(us) AS high, round(median(us), 3) AS median, " + ", ".join(f"round(quantile_cont(us, {q}), 3) AS q{int(round(q * 100)):02d}" for q in QS) + " FROM p WHERE b IS NOT NULL GROUP BY a, b"))
def travel_times(spark, sf):
    t = journeys.transitions(A.events(spark, sf))
    ten = lambda c: F.floor(F.col(c) / 10).cast("bigint")
    t = t.select(ten("op_id").alias("a"), ten("to_op_id").alias("b"), (S.micros(F.col("to_observed_ts")) - S.micros(F.col("observed_ts"))).alias("us"))
    names = {"median": 0.5} | {f"q{round(x * 100):02d}": x for x in QS}
    g = t.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("us").alias("low"), F.max("us").alias("high"))
    q = quantiles.exact(t, "us", names, ("a", "b"))
    return g.join(q, ["a", "b"]).select("a", "b", "n", "low", "high", *[F.round(n, 3).alias(n) for n in names])


@query("n07_engineered_target", A.with_ctes(*BASE, tail="SELECT train_id, service_date, snapshot_ts, slot, round(sign(future_delay - last_known_delay) * sqrt(abs(future_delay - last_known_delay)), 6) AS target FROM tgt"))
def engineered_target(spark, sf):
    t = targets(spark, sf).where("future_delay is not null")
    return t.select(*KEY, "snapshot_ts", F.col("slot").cast("bigint").alias("slot"), F.round(S.signed_sqrt(F.col("future_delay") - F.col("last_known_delay")), 6).alias("target"))


AROUND_NOW = ", ".join(f"max(CASE WHEN way = 'p' AND slot = {k} THEN v END) AS p{k}, max(CASE WHEN way = 'f' AND slot = {k} THEN v END) AS f{k}" for k in (1, 2, 3))
STEP_ROWS = f"""x AS (SELECT train_id, service_date, snapshot_ts, 'p' AS way, slot, op_id || ':' || delay_sec AS v FROM pst WHERE slot <= 3 UNION ALL SELECT train_id, service_date, snapshot_ts, 'f', slot, op_id || ':' || delay_sec FROM fut WHERE slot <= 3),
y AS (SELECT train_id, service_date, snapshot_ts, {AROUND_NOW} FROM x GROUP BY ALL),
z AS (SELECT train_id, service_date, arg_max(delay_sec, seq) AS last FROM ev GROUP BY 1, 2)"""


@query("w16_sequence_steps", A.with_ctes(*BASE, STEP_ROWS, tail="SELECT train_id, service_date, snapshot_ts, " + " || ' ' || ".join([f"coalesce(p{k}, '-1:0')" for k in (3, 2, 1)] + [f"coalesce(f{k}, '-1:' || last)" for k in (1, 2, 3)]) + " AS steps FROM active LEFT JOIN y USING (train_id, service_date, snapshot_ts) JOIN z USING (train_id, service_date)"))
def sequence_steps(spark, sf):
    """Past slots from the oldest, then future slots, as station:delay."""
    step = lambda e: F.concat_ws(":", e["op_id"].cast("string"), e["delay_sec"].cast("bigint").cast("string"))
    return split(spark, sf).select(*KEY, "snapshot_ts", F.array_join(F.transform(F.concat(F.reverse("past_slots"), F.col("future_slots")), step), " ").alias("steps"))


@query("a26_slot_pivot", A.with_ctes(*BASE, tail="SELECT snapshot_ts, train_id, service_date, max(future_delay) FILTER (WHERE slot = 1) AS h1, max(future_delay) FILTER (WHERE slot = 2) AS h2, max(future_delay) FILTER (WHERE slot = 3) AS h3 FROM tgt GROUP BY ALL"))
def slot_pivot(spark, sf):
    t = targets(spark, sf).where("future_delay is not null")
    p = t.groupBy("snapshot_ts", *KEY).pivot("slot", [1, 2, 3]).agg(F.first("future_delay"))
    return p.select("snapshot_ts", *KEY, *[F.col(str(k)).alias(f"h{k}") for k in (1, 2, 3)])


@query("e10_denormalise", A.with_ctes(A.EV, tail="SELECT seq, round(sign(x) * x * x + 30.0, 4) AS seconds FROM (SELECT seq, (delay_sec / 1000.0::DOUBLE) * 2.71::DOUBLE + 0.31::DOUBLE AS x FROM ev)"))
def denormalise(spark, sf):
    from ..operators.evaluate import denormalise as back

    return A.events(spark, sf).select("seq", F.round(back(F.col("delay_sec") / 1000.0, F.lit(0.31), F.lit(2.71), F.lit(30.0)), 4).alias("seconds"))


@query("n15_train_event_semi_join", A.with_ctes(*BASE[:4], "k AS (SELECT DISTINCT train_id, service_date FROM active WHERE split = 'train')", tail="SELECT e.seq FROM ev e SEMI JOIN k USING (train_id, service_date)"))
def train_events(spark, sf):
    from .snapshot_queries import active

    k = active(spark, sf).where("split = 'train'").select(*KEY).distinct()
    return A.events(spark, sf).join(k, KEY, "left_semi").select("seq")


YEAR = ", ".join(f"round({f}(a * {2 * 3.141592653589793 * k}), 6) + 0.0::DOUBLE AS year_{f}_{k}" for k in (1, 2, 4) for f in ("sin", "cos"))


@query("f03_cyclic_year", A.with_ctes(A.EV, tail=f"SELECT seq, {YEAR} FROM (SELECT seq, dayofyear(observed_ts) / 365.0::DOUBLE AS a FROM ev)"))
def cyclic_year(spark, sf):
    e = A.events(spark, sf).select("seq", *S.cyclic(S.year_fraction(F.col("observed_ts")), "year"))
    return e.select("seq", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in e.columns if c != "seq"])


KINDS = ", ".join(f"(CASE WHEN train_relation LIKE 'S%' THEN 'S' ELSE split_part(train_relation, ' ', 1) END = '{r}')::INTEGER AS relation_{r}" for r in S.RELATION_TYPES)


@query("f10_relation_indicators", A.with_ctes(A.EV, tail=f"SELECT seq, {KINDS} FROM ev"))
def relation_indicators(spark, sf):
    return A.events(spark, sf).select("seq", *S.indicators(S.relation_type(F.col("train_relation")), S.RELATION_TYPES, "relation"))


KIND_CODES = ", ".join(f"(event_type = '{k}')::INTEGER AS kind_{k}" for k in "ADP")


@query("f10_event_indicators", A.with_ctes(A.EV, tail=f"SELECT seq, {KIND_CODES} FROM ev"))
def event_indicators(spark, sf):
    return A.events(spark, sf).select("seq", *S.indicators(F.col("event_type"), tuple("ADP"), "kind"))


@query("g15_attached_embedding", A.with_ctes(A.EV, A.NODES, "e AS (SELECT op_id AS k, lat / 100 AS x, lon / 10 AS y FROM nodes WHERE op_id < 90)", tail="SELECT seq, op_id, coalesce(x, 0.0) AS emb_1, coalesce(y, 0.0) AS emb_2 FROM (SELECT seq, CASE WHEN seq % 7 = 0 THEN -1 ELSE op_id END AS op_id FROM ev) LEFT JOIN e ON op_id = k"))
def attached_embedding(spark, sf):
    known = A.nodes(spark, sf).where("op_id < 90").select("op_id", F.array(F.col("lat") / 100, F.col("lon") / 10).alias("embedding"))
    rows = A.events(spark, sf).select("seq", F.when(F.col("seq") % 7 == 0, F.lit(-1)).otherwise(F.col("op_id")).alias("op_id"))
    return features.attach_embedding(rows, known, 2)
