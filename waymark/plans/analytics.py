"""Descriptive queries: shares, histograms, means per active day, journey and table overviews."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quantiles
from . import adapter as A
from .registry import query
from .snapshot_queries import JRN, KEY

EDGES = [-600.0, -300.0, 0.0, 60.0, 300.0, 600.0, 1800.0, 3600.0, 4500.0]


def share(df, *keys):
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def hist_sql(x: str) -> str:
    last = len(EDGES) - 2
    return f"CASE WHEN {x} >= {EDGES[last]} AND {x} <= {EDGES[-1]} THEN {last} " + " ".join(f"WHEN {x} >= {a} AND {x} < {b} THEN {k}" for k, (a, b) in reversed(list(enumerate(zip(EDGES[:-2], EDGES[1:-1], strict=True))))) + " END"


@query("d14_event_type_share", A.with_ctes(A.EV, tail="SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ev GROUP BY 1"))
def event_type_share(spark, sf):
    return share(A.events(spark, sf), "event_type")


@query("d16_relation_share", A.with_ctes(A.EV, tail="SELECT train_relation, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT DISTINCT train_id, service_date, train_relation FROM ev) GROUP BY 1"))
def relation_share(spark, sf):
    return share(A.events(spark, sf).select(*KEY, "train_relation").distinct(), "train_relation")


@query("d11_delay_histogram", A.with_ctes(A.EV, tail=f"SELECT {hist_sql('delay_sec')} AS bin, count(*) AS n FROM ev GROUP BY 1"))
def delay_histogram(spark, sf):
    return A.events(spark, sf).groupBy(S.histogram_bin(F.col("delay_sec"), EDGES).alias("bin")).agg(F.count("*").alias("n"))


@query("d12_delay_histogram_by_week", A.with_ctes(A.EV, tail=f"SELECT date_trunc('week', observed_ts)::DATE AS week, {hist_sql('delay_sec')} AS bin, count(*) AS n FROM ev GROUP BY 1, 2"))
def delay_histogram_by_week(spark, sf):
    e = A.events(spark, sf)
    return e.groupBy(F.trunc(F.col("observed_ts").cast("date"), "week").alias("week"), S.histogram_bin(F.col("delay_sec"), EDGES).alias("bin")).agg(F.count("*").alias("n"))


@query("d13_mean_delay_by_month", A.with_ctes(A.EV, tail="SELECT date_trunc('month', observed_ts)::DATE AS month_start, sum(delay_sec)::BIGINT AS delay_sum, count(*) AS n, sum(delay_sec)::BIGINT / count(*)::DOUBLE AS mean_delay FROM ev GROUP BY 1"))
def delay_by_month(spark, sf):
    g = A.events(spark, sf).groupBy(F.trunc(F.col("observed_ts").cast("date"), "month").alias("month_start")).agg(F.sum("delay_sec").alias("delay_sum"), F.count("*").alias("n"))
    return g.withColumn("mean_delay", F.col("delay_sum") / F.col("n"))


@query("d05_events_per_active_day", A.with_ctes(A.EV, "d AS (SELECT op_id, service_date, count(*) AS n, sum(delay_sec)::BIGINT AS s FROM ev GROUP BY 1, 2)", tail="SELECT op_id, sum(n)::BIGINT / count(*)::DOUBLE AS events_per_day, sum(s)::BIGINT / sum(n)::DOUBLE AS mean_delay, count(*) AS active_days FROM d GROUP BY op_id"))
def events_per_active_day(spark, sf):
    d = A.events(spark, sf).groupBy("op_id", "service_date").agg(F.count("*").alias("n"), F.sum("delay_sec").alias("s"))
    return d.groupBy("op_id").agg((F.sum("n") / F.count("*")).alias("events_per_day"), (F.sum("s") / F.sum("n")).alias("mean_delay"), F.count("*").alias("active_days"))


@query("d06_clip_bounds", A.with_ctes(A.EV, tail="SELECT round(quantile_cont(delay_sec, 0.01), 6) AS low, round(quantile_cont(delay_sec, 0.99), 6) AS high FROM ev"))
def clip_bounds(spark, sf):
    q = quantiles.exact(A.events(spark, sf), "delay_sec", {"low": 0.01, "high": 0.99})
    return q.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("a27_quartiles_by_type", A.with_ctes(A.EV, tail="SELECT event_type, quantile_cont(delay_sec, 0.25) AS q25, quantile_cont(delay_sec, 0.5) AS q50, quantile_cont(delay_sec, 0.75) AS q75 FROM ev GROUP BY 1"))
def quartiles_by_type(spark, sf):
    return quantiles.exact(A.events(spark, sf), "delay_sec", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ("event_type",))


@query("d02_active_stations", A.with_ctes(A.EV, A.NODES, tail="SELECT op_id, op_name FROM nodes SEMI JOIN (SELECT DISTINCT op_id FROM ev WHERE month = '202401') USING (op_id)"))
def active_stations(spark, sf):
    seen = A.events(spark, sf).where("month = '202401'").select("op_id").distinct()
    return A.nodes(spark, sf).join(seen, "op_id", "left_semi").select("op_id", "op_name")


@query("d26_network_of_month", A.with_ctes(A.EV, A.LINKS, tail="SELECT link_id, line_id FROM links WHERE u_node_id IN (SELECT op_id FROM ev WHERE month = '202401' AND event_type = 'A') AND v_node_id IN (SELECT op_id FROM ev WHERE month = '202401' AND event_type = 'A')"))
def network_of_month(spark, sf):
    seen = A.events(spark, sf).where("month = '202401' and event_type = 'A'").select("op_id").distinct()
    li = A.links(spark, sf)
    return li.join(seen, F.col("u_node_id") == F.col("op_id"), "left_semi").join(seen, F.col("v_node_id") == F.col("op_id"), "left_semi").select("link_id", "line_id")


@query("d04_time_station_table", A.with_ctes(A.EV, A.NODES, "j AS (SELECT seq, op_id, observed_ts, delay_sec FROM ev WHERE train_id = '7' AND service_date = '2024-01-05'), o AS (SELECT op_id, row_number() OVER (ORDER BY min(seq)) - 1 AS station_no FROM j GROUP BY op_id)", tail="SELECT j.seq, j.op_id, op_name, observed_ts, delay_sec, station_no FROM j LEFT JOIN nodes USING (op_id) JOIN o USING (op_id)"))
def time_station(spark, sf):
    j = A.events(spark, sf).where("train_id = '7' and service_date = '2024-01-05'").select("seq", "op_id", "observed_ts", "delay_sec")
    o = j.groupBy("op_id").agg(F.min("seq").alias("first")).select("op_id", (F.row_number().over(W.orderBy("first")) - 1).cast("bigint").alias("station_no"))
    return j.join(A.nodes(spark, sf).select("op_id", "op_name"), "op_id", "left").join(o, "op_id")


@query("d01_as_of_positions", A.with_ctes(A.EV, "b AS (SELECT train_id, first(op_id ORDER BY observed_ts DESC, seq DESC) AS before_op, max(observed_ts) AS before_ts FROM ev WHERE observed_ts < TIMESTAMP '2024-01-10 12:00:00' AND observed_ts >= TIMESTAMP '2024-01-10 10:00:00' GROUP BY 1), a AS (SELECT train_id, first(op_id ORDER BY observed_ts, seq) AS after_op, min(observed_ts) AS after_ts FROM ev WHERE observed_ts > TIMESTAMP '2024-01-10 12:00:00' AND observed_ts <= TIMESTAMP '2024-01-10 14:00:00' GROUP BY 1)", tail="SELECT train_id, before_op, after_op, (epoch_us(TIMESTAMP '2024-01-10 12:00:00') - epoch_us(before_ts)) / (epoch_us(after_ts) - epoch_us(before_ts)) AS progress FROM b JOIN a USING (train_id) WHERE before_op <> after_op"))
def positions(spark, sf):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    e = A.events(spark, sf).where(F.col("observed_ts").between(now - F.expr("INTERVAL 2 HOURS"), now + F.expr("INTERVAL 2 HOURS")))
    before, after = F.col("observed_ts") < now, F.col("observed_ts") > now
    g = e.groupBy("train_id").agg(
        F.max_by(F.when(before, F.col("op_id")), F.when(before, F.struct("observed_ts", "seq"))).alias("before_op"), F.max(F.when(before, F.col("observed_ts"))).alias("before_ts"),
        F.min_by(F.when(after, F.col("op_id")), F.when(after, F.struct("observed_ts", "seq"))).alias("after_op"), F.min(F.when(after, F.col("observed_ts"))).alias("after_ts"),
    )
    at = (S.micros(now) - S.micros(F.col("before_ts"))) / (S.micros(F.col("after_ts")) - S.micros(F.col("before_ts")))
    return g.where("before_op <> after_op").select("train_id", "before_op", "after_op", at.alias("progress"))


@query("j10_before_and_after", A.with_ctes(A.EV, tail="SELECT train_id, max(seq) FILTER (WHERE observed_ts < TIMESTAMP '2024-01-15 00:00:00') AS last_before, min(seq) FILTER (WHERE observed_ts > TIMESTAMP '2024-01-15 00:00:00') AS first_after FROM ev GROUP BY 1"))
def before_after(spark, sf):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return A.events(spark, sf).groupBy("train_id").agg(F.max(F.when(F.col("observed_ts") < now, F.col("seq"))).alias("last_before"), F.min(F.when(F.col("observed_ts") > now, F.col("seq"))).alias("first_after"))


@query("d17_journey_totals", A.with_ctes(A.EV, JRN, "x AS (SELECT jrn.*, train_relation FROM jrn JOIN (SELECT DISTINCT train_id, train_relation FROM ev) USING (train_id))", tail="SELECT train_relation, count(*) AS n, sum(events_count)::BIGINT AS events, sum(max_delay_sec)::BIGINT AS max_delay_sum FROM x WHERE max_delay_sec BETWEEN (SELECT quantile_cont(max_delay_sec, 0.01) FROM x) AND (SELECT quantile_cont(max_delay_sec, 0.99) FROM x) GROUP BY 1"))
def journey_totals(spark, sf):
    from ..operators import journeys

    e = A.events(spark, sf)
    j = journeys.summarise(e).join(e.select("train_id", "train_relation").distinct(), "train_id")
    q = quantiles.exact(j, "max_delay_sec", {"low": 0.01, "high": 0.99})
    inside = j.crossJoin(F.broadcast(q)).where(F.col("max_delay_sec").between(F.col("low"), F.col("high")))  # one row
    return inside.groupBy("train_relation").agg(F.count("*").alias("n"), F.sum("events_count").alias("events"), F.sum("max_delay_sec").alias("max_delay_sum"))


@query("a19_mean_by_parts", A.with_ctes(A.EV, tail="SELECT op_id, sum(delay_sec)::BIGINT AS s, count(*) AS n FROM ev GROUP BY 1"))
def mean_by_parts(spark, sf):
    return A.events(spark, sf).groupBy("op_id").agg(F.sum("delay_sec").alias("s"), F.count("*").alias("n"))


@query("a20_share_of_fixed_categories", A.with_ctes(A.EV, "c AS (SELECT unnest(['A', 'D', 'P', 'X']) AS event_type)", tail="SELECT c.event_type, coalesce(n, 0) AS n FROM c LEFT JOIN (SELECT event_type, count(*) AS n FROM ev GROUP BY 1) USING (event_type)"))
def fixed_categories(spark, sf):
    c = spark.sql("SELECT explode(array('A', 'D', 'P', 'X')) AS event_type")
    n = A.events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return c.join(n, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("a22_top_station", A.with_ctes(A.EV, tail="SELECT op_id, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, op_id LIMIT 1"))
def top_station(spark, sf):
    return A.events(spark, sf).groupBy("op_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "op_id").limit(1)


@query("o04_top_shares", A.with_ctes(A.EV, tail="SELECT op_id, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, op_id LIMIT 10"))
def top_shares(spark, sf):
    return A.events(spark, sf).groupBy("op_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "op_id").limit(10)


@query("a24_distinct_sorted_set", A.with_ctes(A.EV, tail="SELECT train_id, list(DISTINCT event_type ORDER BY event_type) AS kinds, count(DISTINCT op_id) AS n_ops FROM ev GROUP BY 1"))
def sorted_set(spark, sf):
    return A.events(spark, sf).groupBy("train_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.countDistinct("op_id").alias("n_ops"))


@query("a04_group_size", A.with_ctes(A.EV, tail="SELECT seq FROM ev QUALIFY count(*) OVER (PARTITION BY train_id, service_date) > 2"))
def group_size(spark, sf):
    return A.events(spark, sf).withColumn("n", F.count("*").over(W.partitionBy(*KEY))).where("n > 2").select("seq")


@query("a05_distinct_keys", A.with_ctes(A.EV, tail="SELECT DISTINCT train_id, service_date FROM ev"))
def distinct_keys(spark, sf):
    return A.events(spark, sf).select(*KEY).distinct()


@query("a29_weighted_mean", A.with_ctes(A.EV, "h AS (SELECT op_id, count(*) AS n, max(delay_sec) AS mae FROM ev GROUP BY 1)", tail="SELECT sum(mae * n)::BIGINT / sum(n)::DOUBLE AS weighted FROM h"))
def weighted_mean(spark, sf):
    h = A.events(spark, sf).groupBy("op_id").agg(F.count("*").alias("n"), F.max("delay_sec").alias("mae"))
    return h.agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("weighted"))


@query("a30_arg_min", A.with_ctes(A.EV, tail="SELECT train_id, arg_min(seq, delay_sec * 1000000 + seq) AS seq FROM ev GROUP BY 1"))
def arg_min(spark, sf):
    return A.events(spark, sf).groupBy("train_id").agg(F.min_by("seq", F.col("delay_sec") * 1_000_000 + F.col("seq")).alias("seq"))


@query("w07_first_and_last", A.with_ctes(A.EV, tail="SELECT train_id, service_date, seq FROM ev QUALIFY row_number() OVER (PARTITION BY train_id, service_date ORDER BY seq DESC) = 1"))
def last_row(spark, sf):
    w = W.partitionBy(*KEY).orderBy(F.desc("seq"))
    return A.events(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1").select(*KEY, "seq")


@query("w17_minimum_rank_edge", A.with_ctes(A.EV, tail="SELECT train_id, arg_min(op_id, seq) AS op_id FROM ev WHERE event_type <> 'P' GROUP BY 1"))
def minimum_rank(spark, sf):
    return A.events(spark, sf).where("event_type <> 'P'").groupBy("train_id").agg(F.min_by("op_id", "seq").alias("op_id"))


@query("d15_one_journey_box", A.with_ctes(A.EV, A.NODES, "j AS (SELECT DISTINCT op_id FROM ev WHERE train_id = '7' AND service_date = '2024-01-05'), b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM nodes SEMI JOIN j USING (op_id))", tail="SELECT op_id, op_name FROM nodes, b WHERE lat BETWEEN a AND b.b AND lon BETWEEN c AND d"))
def journey_box(spark, sf):
    n = A.nodes(spark, sf)
    j = A.events(spark, sf).where("train_id = '7' and service_date = '2024-01-05'").select("op_id").distinct()
    box = n.join(j, "op_id", "left_semi").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    return n.crossJoin(F.broadcast(box)).where("lat between a and b and lon between c and d").select("op_id", "op_name")  # one row


@query("d23_enriched_events", A.with_ctes(A.EV, A.NODES, JRN, tail="SELECT e.seq, n.op_name, n.lat, j.events_count FROM ev e LEFT JOIN nodes n USING (op_id) LEFT JOIN jrn j USING (train_id, service_date) WHERE e.train_id = '9'"))
def enriched(spark, sf):
    from ..operators import journeys

    e = A.events(spark, sf)
    j = journeys.summarise(e).select(*KEY, "events_count")
    return e.where("train_id = '9'").join(A.nodes(spark, sf), "op_id", "left").join(j, KEY, "left").select("seq", "op_name", "lat", "events_count")


@query("d24_table_overview", "SELECT 'events' AS name, (SELECT count(*) FROM events) AS n_rows, 6 AS n_columns UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 6 UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 11")
def overview(spark, sf):
    from ..session import table

    one = lambda n: (t := table(spark, sf, n)).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows", F.lit(len(t.columns)).alias("n_columns"))
    return one("events").unionByName(one("orders")).unionByName(one("lineitem"))
