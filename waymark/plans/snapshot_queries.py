"""Queries over point-in-time views: activity, range joins, padded slots, targets, the naive forecast."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import event_code, micros
from ..operators import evaluate, features, graphs, intervals, journeys, quantiles, snapshots
from . import adapter as A
from .registry import query

KEY = ["train_id", "service_date"]
SLOTS, PAST = 3, 3

JRN = """jrn AS (
  SELECT train_id, service_date, arg_min(op_id, seq) AS start_op_id, arg_max(op_id, seq) AS end_op_id, arg_min(planned_ts, seq) AS start_planned_ts, arg_max(planned_ts, seq) AS end_planned_ts,
    arg_min(observed_ts, seq) AS start_observed_ts, arg_max(observed_ts, seq) AS end_observed_ts, count(*) AS events_count, max(delay_sec) AS max_delay_sec, min(delay_sec) AS min_delay_sec
  FROM ev GROUP BY ALL), act AS (
  SELECT *, least(start_planned_ts - INTERVAL 5 MINUTE, start_observed_ts) AS appearance_start, end_observed_ts + INTERVAL 5 MINUTE AS disappearance_end FROM jrn)"""
ACT = """active AS (SELECT act.*, snapshot_ts, split FROM act JOIN snap ON appearance_start <= snapshot_ts AND snapshot_ts < disappearance_end)"""
#: Events before and after each snapshot, numbered from it; the naive way, event by event.
AROUND = """fut AS (
  SELECT a.train_id, a.service_date, snapshot_ts, split, row_number() OVER w AS slot, e.observed_ts, e.op_id, e.event_type, e.planned_ts, e.delay_sec
  FROM active a JOIN ev e USING (train_id, service_date) WHERE e.observed_ts > snapshot_ts WINDOW w AS (PARTITION BY a.train_id, a.service_date, snapshot_ts ORDER BY e.seq)
), pst AS (
  SELECT a.train_id, a.service_date, snapshot_ts, row_number() OVER w AS slot, e.observed_ts, e.op_id, e.event_type, e.planned_ts, e.delay_sec
  FROM active a JOIN ev e USING (train_id, service_date) WHERE e.observed_ts <= snapshot_ts WINDOW w AS (PARTITION BY a.train_id, a.service_date, snapshot_ts ORDER BY e.seq DESC)
), lkd AS (
  SELECT a.train_id, a.service_date, a.snapshot_ts, a.split,
    greatest(coalesce(p.delay_sec, 0)::DOUBLE, (epoch_us(a.snapshot_ts) - epoch_us(coalesce(f.planned_ts, a.end_planned_ts + INTERVAL 5 MINUTE))) / 1e6) AS last_known_delay
  FROM active a LEFT JOIN pst p ON p.train_id = a.train_id AND p.service_date = a.service_date AND p.snapshot_ts = a.snapshot_ts AND p.slot = 1
  LEFT JOIN fut f ON f.train_id = a.train_id AND f.service_date = a.service_date AND f.snapshot_ts = a.snapshot_ts AND f.slot = 1
), tgt AS (SELECT l.train_id, l.service_date, l.snapshot_ts, l.split, l.last_known_delay, f.slot, f.observed_ts AS future_obs_ts, f.op_id AS future_op_id, f.event_type AS future_event_type, f.delay_sec::DOUBLE AS future_delay
  FROM lkd l JOIN fut f USING (train_id, service_date, snapshot_ts) WHERE f.slot <= 3)"""
BASE = (A.EV, A.SNAP, JRN, ACT, AROUND)


def activity(spark, sf):
    return journeys.activity(journeys.summarise(A.events(spark, sf)), 5, 5)


def active(spark, sf, arrays=None):
    """Journeys at the snapshots they are active at. arrays: the journeys with their events, where they are there already."""
    return intervals.join_active(activity(spark, sf) if arrays is None else journeys.activity(arrays, 5, 5), A.snapshots(spark))


def split(spark, sf, past=PAST, future=SLOTS, arrays=None, keep=()):
    """Events are scanned and shuffled once: what says when a journey is active comes from its array of events. keep: other columns of arrays."""
    arrays = (graphs.journey_arrays(A.events(spark, sf)) if arrays is None else arrays).dropna(subset=KEY)
    arrays = snapshots.padded(arrays, past, future, 5, 5)
    # NULL outside of the journey: a filter on slots may be moved into the join, where times are not compared yet, and a slice there would fail
    inside = (F.col("appearance_start") <= F.col("snapshot_ts")) & (F.col("snapshot_ts") < F.col("disappearance_end"))
    pairs = active(spark, sf, arrays).select(*KEY, "snapshot_ts", "split", "events", F.when(inside, F.col("padded")).alias("padded"), *keep)
    return snapshots.with_last_delay(snapshots.split_at(pairs, past, future))


def targets(spark, sf):
    return snapshots.long_targets(split(spark, sf), [*KEY, "snapshot_ts", "split", "last_known_delay"])


def truth(spark, sf):
    """The evaluation table, keyed by ts."""
    long = targets(spark, sf).withColumnRenamed("snapshot_ts", "ts")
    return snapshots.wide_targets(long, ["ts", *KEY, "last_known_delay"], SLOTS)


def naive(spark, sf, table=None):
    """The naive forecast: the last known delay stays. table: the evaluation table, where it is there already."""
    return (truth(spark, sf) if table is None else table).select("ts", *KEY, *[F.col("last_known_delay").alias(f"future_delay_{k}") for k in range(1, SLOTS + 1)])


@query("a01_journey_summary", A.with_ctes(A.EV, JRN, tail="SELECT * FROM jrn"))
def journey_summary(spark, sf):
    return journeys.summarise(A.events(spark, sf))


@query("n01_activity_windows", A.with_ctes(A.EV, JRN, tail="SELECT train_id, service_date, appearance_start, disappearance_end FROM act"))
def activity_windows(spark, sf):
    return activity(spark, sf).select(*KEY, "appearance_start", "disappearance_end")


@query("j07_active_at_snapshot", A.with_ctes(A.EV, A.SNAP, JRN, ACT, tail="SELECT train_id, service_date, snapshot_ts, split FROM active"))
def active_pairs(spark, sf):
    return active(spark, sf).select(*KEY, "snapshot_ts", "split")


@query("j08_ever_active", A.with_ctes(A.EV, A.SNAP, JRN, ACT, tail="SELECT DISTINCT train_id, service_date FROM active"))
def ever_active(spark, sf):
    return intervals.join_active(activity(spark, sf).select(*KEY, "appearance_start", "disappearance_end"), A.snapshots(spark), how="left_semi").select(*KEY)


@query("w12_active_intervals", A.with_ctes(A.EV, JRN, "m AS (SELECT *, sum(n) OVER (ORDER BY appearance_start, disappearance_end) AS g FROM (SELECT *, CASE WHEN max(disappearance_end) OVER (ORDER BY appearance_start, disappearance_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= appearance_start THEN 0 ELSE 1 END AS n FROM act WHERE appearance_start < disappearance_end))", tail="SELECT min(appearance_start) AS appearance_start, max(disappearance_end) AS disappearance_end, count(*) AS n FROM m GROUP BY g"))
def active_intervals(spark, sf):
    return intervals.merge_by_day(activity(spark, sf).select("appearance_start", "disappearance_end"), "appearance_start", "disappearance_end")


@query("w12_active_per_day", A.with_ctes(A.EV, JRN, "m AS (SELECT *, sum(n) OVER (PARTITION BY service_date ORDER BY appearance_start, disappearance_end) AS g FROM (SELECT *, CASE WHEN max(disappearance_end) OVER (PARTITION BY service_date ORDER BY appearance_start, disappearance_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= appearance_start THEN 0 ELSE 1 END AS n FROM act WHERE appearance_start < disappearance_end))", tail="SELECT service_date, sum(epoch_us(e) - epoch_us(s))::BIGINT AS active_us FROM (SELECT service_date, g, min(appearance_start) AS s, max(disappearance_end) AS e FROM m GROUP BY ALL) GROUP BY service_date"))
def active_per_day(spark, sf):
    m = intervals.merge_intervals(activity(spark, sf).select("service_date", "appearance_start", "disappearance_end"), "appearance_start", "disappearance_end", ("service_date",))
    return m.groupBy("service_date").agg(F.sum(micros(F.col("disappearance_end")) - micros(F.col("appearance_start"))).alias("active_us"))


@query("j09_split_position", A.with_ctes(*BASE[:4], tail="SELECT a.train_id, a.service_date, snapshot_ts, count(*) FILTER (WHERE e.observed_ts <= snapshot_ts) AS n_past FROM active a JOIN ev e USING (train_id, service_date) GROUP BY ALL"))
def split_position(spark, sf):
    placeholders = F.size(F.filter("padded", lambda e: (e["op_id"] == -1) & (e["observed_ts"] <= F.col("snapshot_ts"))))
    return split(spark, sf).select(*KEY, "snapshot_ts", (F.col("split_idx") - placeholders).cast("bigint").alias("n_past"))


@query("w08_past_slots", A.with_ctes(*BASE, tail="SELECT train_id, service_date, snapshot_ts, slot, op_id, delay_sec::DOUBLE AS delay_sec, event_type FROM pst WHERE slot <= 3"))
def past_slots(spark, sf):
    s = split(spark, sf).select(*KEY, "snapshot_ts", F.posexplode("past_slots").alias("p", "e"))
    return s.where("e.op_id <> -1").select(*KEY, "snapshot_ts", (F.col("p") + 1).cast("bigint").alias("slot"), "e.op_id", "e.delay_sec", "e.event_type")


@query("w08_future_slots", A.with_ctes(*BASE, tail="SELECT train_id, service_date, snapshot_ts, slot, future_obs_ts, future_op_id, future_event_type, future_delay FROM tgt"))
def future_slots(spark, sf):
    return targets(spark, sf).where("future_delay is not null").select(*KEY, "snapshot_ts", F.col("slot").cast("bigint").alias("slot"), "future_obs_ts", "future_op_id", "future_event_type", "future_delay")


@query("w08_padding_counts", A.with_ctes(*BASE, "n AS (SELECT a.train_id, a.service_date, a.snapshot_ts, count(f.slot) AS c FROM active a LEFT JOIN fut f ON f.train_id = a.train_id AND f.service_date = a.service_date AND f.snapshot_ts = a.snapshot_ts AND f.slot <= 3 GROUP BY ALL)", tail="SELECT 3 - c AS n_padded, count(*) AS n_rows FROM n GROUP BY 1"))
def padding_counts(spark, sf):
    n = F.size(F.filter("future_slots", lambda e: e["op_id"] == -1)).cast("bigint")
    return split(spark, sf).groupBy(n.alias("n_padded")).agg(F.count("*").alias("n_rows"))


@query("f09_last_known_delay", A.with_ctes(*BASE, tail="SELECT train_id, service_date, snapshot_ts, last_known_delay FROM lkd"))
def last_delay(spark, sf):
    return split(spark, sf).select(*KEY, "snapshot_ts", "last_known_delay")


@query("p11_event_codes", A.with_ctes(*BASE, tail="SELECT slot, CASE future_event_type WHEN 'A' THEN 0 WHEN 'D' THEN 1 ELSE 2 END::TINYINT AS code, count(*) AS n FROM tgt GROUP BY ALL"))
def event_codes(spark, sf):
    t = targets(spark, sf).withColumn("code", event_code(F.col("future_event_type"), F.col("future_op_id") == -1)).where("code >= 0")
    return t.groupBy(F.col("slot").cast("bigint").alias("slot"), "code").agg(F.count("*").alias("n"))


WIDE = "wide AS (SELECT snapshot_ts AS ts, train_id, service_date, any_value(last_known_delay) AS last_known_delay, " + ", ".join(f"max(future_obs_ts) FILTER (WHERE slot = {k}) AS future_obs_ts_{k}, max(future_op_id) FILTER (WHERE slot = {k}) AS future_op_id_{k}, max(future_delay) FILTER (WHERE slot = {k}) AS future_delay_{k}" for k in (1, 2, 3)) + " FROM tgt GROUP BY ALL)"


@query("n04_evaluation_table", A.with_ctes(*BASE, WIDE, tail="SELECT * FROM wide WHERE future_delay_1 IS NOT NULL"))
def evaluation_table(spark, sf):
    t = truth(spark, sf).where("future_delay_1 is not null")
    real = lambda k: F.when(F.col(f"future_delay_{k}").isNotNull(), F.col(f"future_op_id_{k}")).alias(f"future_op_id_{k}")
    return t.select("ts", *KEY, "last_known_delay", *[c for k in (1, 2, 3) for c in (F.col(f"future_obs_ts_{k}"), real(k), F.col(f"future_delay_{k}"))])


@query("slice_translation_eval", A.with_ctes(*BASE, tail="SELECT slot, count(*) AS n_values, round(avg(abs(last_known_delay - future_delay)), 6) AS mae, round(sqrt(avg((last_known_delay - future_delay) ** 2)), 6) AS rmse FROM tgt GROUP BY slot"))
def translation(spark, sf):
    t = targets(spark, sf).where("future_delay is not null").withColumn("d", F.col("last_known_delay") - F.col("future_delay"))
    return t.groupBy(F.col("slot").cast("bigint").alias("slot")).agg(F.count("*").alias("n_values"), F.round(F.avg(F.abs("d")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 6).alias("rmse"))


@query("e06_naive_forecast", A.with_ctes(*BASE, WIDE, tail="SELECT ts, train_id, service_date, last_known_delay AS future_delay_1, last_known_delay AS future_delay_2, last_known_delay AS future_delay_3 FROM wide WHERE future_delay_1 IS NOT NULL"))
def naive_forecast(spark, sf):
    return naive(spark, sf).join(truth(spark, sf).where("future_delay_1 is not null").select("ts", *KEY), ["ts", *KEY], "left_semi")


@query("a14_global_errors", A.with_ctes(*BASE, tail="SELECT count(*) AS n_values, round(avg(abs(last_known_delay - future_delay)), 6) AS mae, round(sqrt(avg((last_known_delay - future_delay) ** 2)), 6) AS rmse FROM tgt"))
def global_errors(spark, sf):
    p = evaluate.long_pairs(truth(spark, sf), naive(spark, sf)).agg(*evaluate.errors())
    return p.select("n_values", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


def bins_sql(value: str, edges: list[float], unit: str) -> str:
    labels = evaluate.bin_label(edges, unit)
    case = " ".join(f"WHEN {value} >= {e} THEN '{lab}'" for e, lab in list(zip(edges, labels, strict=False))[:0:-1])
    return f"CASE {case} ELSE '{labels[0]}' END"


def binned(name: str, value: str, column: str, edges, unit):
    sql = A.with_ctes(*BASE, tail=f"SELECT {bins_sql(value, edges, unit)} AS bin, count(*) AS n_values, round(avg(abs(last_known_delay - future_delay)), 6) AS mae, round(sqrt(avg((last_known_delay - future_delay) ** 2)), 6) AS rmse FROM tgt GROUP BY 1")

    @query(name, sql)
    def run(spark, sf):
        p = evaluate.by_bins(evaluate.long_pairs(truth(spark, sf), naive(spark, sf)), column, edges, unit)
        return p.select("bin", "n_values", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


binned("a15_errors_by_horizon", "(epoch_us(future_obs_ts) - epoch_us(snapshot_ts)) / 1e6 / 60", "horizon_min", evaluate.HORIZON_MIN, "m")
binned("a16_errors_by_change", "(future_delay - last_known_delay)", "change_sec", evaluate.CHANGE_SEC, "s")


@query("j03_key_alignment", A.with_ctes(*BASE[:4], "p AS (SELECT train_id, service_date, snapshot_ts FROM active WHERE train_id::BIGINT % 10 <> 0 UNION ALL SELECT 'none', service_date, snapshot_ts FROM active WHERE train_id = '7')", tail="SELECT count(*) FILTER (WHERE a.train_id IS NOT NULL AND p.train_id IS NOT NULL) AS matched, count(*) FILTER (WHERE p.train_id IS NULL) AS only_truth, count(*) FILTER (WHERE a.train_id IS NULL) AS only_predicted FROM active a FULL JOIN p USING (train_id, service_date, snapshot_ts)"))
def key_alignment(spark, sf):
    a = active(spark, sf).select(F.col("snapshot_ts").alias("ts"), *KEY)
    p = a.where(F.col("train_id").cast("bigint") % 10 != 0).unionByName(a.where("train_id = '7'").withColumn("train_id", F.lit("none")))
    return evaluate.alignment(a, p)


@query("e04_coverage", A.with_ctes(*BASE, tail="SELECT count(*) FILTER (WHERE last_known_delay > 3000) AS lacking, count(*) AS n_targets FROM tgt"))
def coverage(spark, sf):
    n = naive(spark, sf)
    n = n.select("ts", *KEY, *[F.when(F.col(c) <= 3000, F.col(c)).alias(c) for c in features.slot_columns(n.columns, "future_delay_")])
    return evaluate.long_pairs(truth(spark, sf), n).agg(F.count_if(F.col("p").isNull()).alias("lacking"), F.count("*").alias("n_targets"))


@query("p15_split_rows", A.with_ctes(*BASE[:4], tail="SELECT split, count(*) AS n_rows, count(DISTINCT snapshot_ts) AS n_snapshots FROM active GROUP BY split"))
def split_rows(spark, sf):
    rows = active(spark, sf).select(*KEY, "snapshot_ts")
    return features.split_rows(rows, A.snapshots(spark)).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("snapshot_ts").alias("n_snapshots"))


@query("o07_temporal_holdout", A.with_ctes(*BASE[:4], "t AS (SELECT DISTINCT snapshot_ts FROM active), r AS (SELECT snapshot_ts, row_number() OVER (ORDER BY snapshot_ts DESC) AS k, count(*) OVER () AS n FROM t)", tail="SELECT CASE WHEN k <= greatest(1, least(n - 1, round_even(0.2 * n, 0))) THEN 'valid' ELSE 'fit' END AS fold, count(*) AS n_rows FROM active JOIN r USING (snapshot_ts) GROUP BY 1"))
def holdout(spark, sf):
    return features.temporal_holdout(active(spark, sf).select(*KEY, "snapshot_ts"), 0.2).groupBy("fold").agg(F.count("*").alias("n_rows"))


@query("w05_ordinal_in_snapshot", A.with_ctes(*BASE[:4], tail="SELECT train_id, service_date, snapshot_ts, row_number() OVER (PARTITION BY snapshot_ts ORDER BY service_date, train_id) - 1 AS train_node_id FROM active"))
def ordinal(spark, sf):
    w = W.partitionBy("snapshot_ts").orderBy("service_date", "train_id")
    return active(spark, sf).select(*KEY, "snapshot_ts", (F.row_number().over(w) - 1).cast("bigint").alias("train_node_id"))


@query("d20_targets_by_horizon", A.with_ctes(*BASE, tail=f"SELECT slot, {bins_sql('(epoch_us(future_obs_ts) - epoch_us(snapshot_ts)) / 1e6 / 60', evaluate.HORIZON_MIN, 'm')} AS bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY slot), 6) AS percent FROM tgt GROUP BY 1, 2"))
def targets_by_horizon(spark, sf):
    return _by_slot(spark, sf, "horizon_min", evaluate.HORIZON_MIN, "m")


@query("d21_targets_by_change", A.with_ctes(*BASE, tail=f"SELECT slot, {bins_sql('(future_delay - last_known_delay)', evaluate.CHANGE_SEC, 's')} AS bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY slot), 6) AS percent FROM tgt GROUP BY 1, 2"))
def targets_by_change(spark, sf):
    return _by_slot(spark, sf, "change_sec", evaluate.CHANGE_SEC, "s")


def _by_slot(spark, sf, column, edges, unit):
    from ..functions.scalars import right_bin

    p = evaluate.long_pairs(truth(spark, sf), naive(spark, sf))
    label = F.element_at(F.array(*map(F.lit, evaluate.bin_label(edges, unit))), right_bin(F.col(column), edges) + 1)
    n = p.groupBy(F.col("slot").cast("bigint").alias("slot"), label.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy("slot")), 6))


@query("d22_change_quartiles", A.with_ctes(*BASE, tail=f"SELECT {bins_sql('(epoch_us(future_obs_ts) - epoch_us(snapshot_ts)) / 1e6 / 60', evaluate.HORIZON_MIN, 'm')} AS bin, round(quantile_cont(future_delay - last_known_delay, 0.25), 6) AS q25, round(quantile_cont(future_delay - last_known_delay, 0.5), 6) AS q50, round(quantile_cont(future_delay - last_known_delay, 0.75), 6) AS q75 FROM tgt GROUP BY 1"))
def change_quartiles(spark, sf):
    from ..functions.scalars import right_bin

    p = evaluate.long_pairs(truth(spark, sf), naive(spark, sf))
    label = F.element_at(F.array(*map(F.lit, evaluate.bin_label(evaluate.HORIZON_MIN, "m"))), right_bin(F.col("horizon_min"), evaluate.HORIZON_MIN) + 1)
    q = quantiles.exact(p.withColumn("bin", label), "change_sec", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ("bin",))
    return q.select("bin", *[F.round(n, 6).alias(n) for n in ("q25", "q50", "q75")])


MONTHS = "m AS (SELECT DISTINCT strftime(snapshot_ts, '%Y%m') AS month FROM snap), jm AS (SELECT train_id, service_date, min(month) AS month FROM ev GROUP BY 1, 2)"


@query("n03_month_scoped_index", A.with_ctes(*BASE[:4], MONTHS, tail="SELECT a.train_id, a.service_date, a.snapshot_ts FROM active a JOIN jm USING (train_id, service_date) SEMI JOIN m USING (month)"))
def month_scoped(spark, sf):
    """Journeys active at a snapshot, of those that are stored in a month with snapshots: only the folders of these months are read."""
    from .graph_queries import month_scan

    return month_scan(spark, sf).drop("events_count")


@query("j24_paired_by_key", A.with_ctes(*BASE, WIDE, tail="SELECT ts, train_id, service_date, future_delay_1 - last_known_delay AS residual_1, future_delay_2 - last_known_delay AS residual_2 FROM wide WHERE train_id::BIGINT % 3 <> 0 AND future_delay_1 IS NOT NULL"))
def paired_by_key(spark, sf):
    """Predictions meet the evaluation table by key, never by position; rows without a prediction go."""
    n = naive(spark, sf).where(F.col("train_id").cast("bigint") % 3 != 0)
    n = n.select("ts", *KEY, *[F.col(f"future_delay_{k}").alias(f"p_{k}") for k in (1, 2)])
    both = truth(spark, sf).where("future_delay_1 is not null").join(n, ["ts", *KEY])
    return both.select("ts", *KEY, *[(F.col(f"future_delay_{k}") - F.col(f"p_{k}")).alias(f"residual_{k}") for k in (1, 2)])
