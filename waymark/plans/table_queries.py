"""Queries of plain table operators: projections, filters, joins, set operations, checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import journeys
from ..session import table
from . import adapter as A
from .registry import query
from .snapshot_queries import KEY


@query("s03_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def pruned(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")


@query("s04_filtered_scan", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey IN (3, 5, 8)")
def filtered(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_suppkey").isin(3, 5, 8)).select("l_orderkey", "l_partkey")


@query("s24_row_counts", "SELECT count(*) AS n FROM lineitem")
def row_counts(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("s06_partition_filter", A.with_ctes(A.EV, tail="SELECT service_date, count(*) AS n FROM ev WHERE month = '202401' GROUP BY 1"))
def partition_filter(spark, sf):
    """A filter on the month of a table by month: it opens one folder."""
    from .graph_queries import month_folders

    return month_folders(spark, sf)


@query("p01_parse_wall_clock", "SELECT event_id, (date_trunc('second', ts))::TIMESTAMP AS parsed FROM events")
def parse_clock(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    day, time = F.upper(F.date_format("ts", "ddMMMyyyy")), F.date_format("ts", "HH:mm:ss")
    return e.select("event_id", S.wall_clock(day, time).alias("parsed"))


@query("p01_bad_clock_is_null", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts::DATE END AS parsed FROM events")
def bad_clock(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    day = F.when(F.col("event_id") % 3 == 0, "31FEB-bad").otherwise(F.upper(F.date_format("ts", "ddMMMyyyy")))
    return e.select("event_id", S.service_day(day).alias("parsed"))


@query("p02_service_day", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def service_day(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.service_day(F.upper(F.date_format("o_orderdate", "ddMMMyyyy"))).alias("day"))


@query("p07_literal_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def literal_list(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("p08_closed_range", A.with_ctes(A.NODES, tail="SELECT op_id FROM nodes WHERE lat BETWEEN 50.2 AND 50.6 AND lon BETWEEN 4.1 AND 4.7"))
def closed_range(spark, sf):
    return A.nodes(spark, sf).where(F.col("lat").between(50.2, 50.6) & F.col("lon").between(4.1, 4.7)).select("op_id")


@query("p09_time_window", A.with_ctes(A.EV, tail="SELECT seq FROM ev WHERE observed_ts BETWEEN TIMESTAMP '2024-01-10 10:00:00' AND TIMESTAMP '2024-01-10 14:00:00'"))
def time_window(spark, sf):
    now, two = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"), F.expr("INTERVAL 2 HOURS")
    return A.events(spark, sf).where(F.col("observed_ts").between(now - two, now + two)).select("seq")


@query("p10_text_filter", A.with_ctes(A.EV, tail="SELECT seq FROM ev WHERE train_id = '5' AND delay_sec > 100"))
def text_filter(spark, sf):
    return A.events(spark, sf).where("train_id = '5' and delay_sec > 100").select("seq")


@query("p12_null_defaults", "SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END, 0) AS price FROM orders")
def null_defaults(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")), F.lit(0.0)).alias("price"))


@query("p13_ordered_projection", "SELECT p_size, p_partkey, p_name FROM part")
def ordered_projection(spark, sf):
    from ..operators.features import ordered_columns

    return ordered_columns(table(spark, sf, "part"), ["p_size", "p_partkey", "p_name"])


@query("p14_pattern_columns", "SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem")
def pattern_columns(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", *[c for c in li.columns if c.startswith("l_line")])


@query("j01_inner_join", A.with_ctes(A.EV, tail="SELECT a.seq AS a, b.seq AS b FROM ev a JOIN ev b USING (train_id, service_date) WHERE a.event_type = 'A' AND b.event_type = 'D'"))
def inner_join(spark, sf):
    e = A.events(spark, sf)
    a = e.where("event_type = 'A'").select(*KEY, F.col("seq").alias("a"))
    return a.join(e.where("event_type = 'D'").select(*KEY, F.col("seq").alias("b")), KEY).select("a", "b")


@query("j02_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def left_join(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j04_outer_join_of_sums", "SELECT k, a, b FROM (SELECT l_suppkey AS k, count(*) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) FULL JOIN (SELECT s_suppkey AS k, count(*) AS b FROM supplier WHERE s_nationkey < 12 GROUP BY 1) USING (k)")
def outer_join(spark, sf):
    a = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("a"))
    b = table(spark, sf, "supplier").where("s_nationkey < 12").groupBy(F.col("s_suppkey").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full_outer")


@query("j06_semi_join", "SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_nationkey = 7) USING (o_custkey)")
def semi_join(spark, sf):
    c = table(spark, sf, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("j15_checked_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def checked_lookup(spark, sf):
    from .checks import join_many_to_one

    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return join_many_to_one(table(spark, sf, "supplier"), n, ["s_nationkey"]).select("s_suppkey", "n_name")


@query("j16_small_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def small_lookup(spark, sf):
    r = table(spark, sf, "region")
    return table(spark, sf, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("j23_list_positions", A.with_ctes(A.EV, tail="SELECT train_id, l[1] AS p1, l[3] AS p3, l[40] AS p40 FROM (SELECT train_id, list(op_id ORDER BY seq) AS l FROM ev GROUP BY 1)"))
def list_positions(spark, sf):
    ops = A.events(spark, sf).groupBy("train_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "op_id"))), lambda x: x["op_id"]).alias("l"))
    return ops.select("train_id", *[F.get("l", F.lit(k - 1)).alias(f"p{k}") for k in (1, 3, 40)])


@query("u01_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def union_all(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).unionByName(table(spark, sf, "region").select(F.col("r_regionkey").alias("k")))


@query("u02_first_source_wins", "SELECT k, arg_min(name, prio) AS name FROM (SELECT n_nationkey AS k, n_name AS name, 2 AS prio FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region) GROUP BY k")
def first_source(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(2).alias("prio"))
    u = a.unionByName(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit(1).alias("prio")))
    return u.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("prio"))).where("r = 1").select("k", "name")


@query("u03_except", A.with_ctes(A.EV, A.NODES, tail="SELECT op_id FROM nodes EXCEPT SELECT op_id FROM ev WHERE event_type = 'A' AND delay_sec > 1000"))
def except_(spark, sf):
    return A.nodes(spark, sf).select("op_id").subtract(A.events(spark, sf).where("event_type = 'A' and delay_sec > 1000").select("op_id"))


@query("u04_intersect", A.with_ctes(A.EV, A.NODES, tail="SELECT op_id FROM nodes INTERSECT SELECT op_id FROM ev WHERE delay_sec > 3000"))
def intersect(spark, sf):
    return A.nodes(spark, sf).select("op_id").intersect(A.events(spark, sf).where("delay_sec > 3000").select("op_id"))


@query("m07_unique_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_check(spark, sf):
    from .checks import duplicates

    return duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("m08_null_counts", "SELECT count(*) FILTER (WHERE l_orderkey IS NULL) AS l_orderkey, count(*) FILTER (WHERE l_shipdate IS NULL) AS l_shipdate FROM lineitem")
def null_counts(spark, sf):
    from .checks import null_counts as nulls

    return nulls(table(spark, sf, "lineitem"), ["l_orderkey", "l_shipdate"])


@query("m09_range_check", "SELECT count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS outside FROM lineitem")
def range_check(spark, sf):
    from .checks import outside_range

    return outside_range(table(spark, sf, "lineitem"), "l_quantity", 5, 45)


@query("m03_split_column", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1)::BIGINT AS level, substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS label FROM orders")
def split_column(spark, sf):
    from .manifest import split_column as split

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split(o, "o_orderpriority", "-", {"level": "int", "label": "str"})


@query("m04_m05_text", "SELECT c_custkey, upper(trim('  ' || c_mktsegment || ' ')) AS segment FROM customer")
def text(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.upper(S.clean_text(F.concat(F.lit("  "), "c_mktsegment", F.lit("\t ")))).alias("segment"))


@query("f07_clipped_bins", "SELECT CASE WHEN l_quantity >= 30 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def clipped_bins(spark, sf):
    return table(spark, sf, "lineitem").groupBy(S.right_bin(F.col("l_quantity"), [5.0, 10.0, 30.0, 40.0]).alias("bin")).agg(F.count("*").alias("n"))


@query("f08_open_bins", "SELECT CASE WHEN l_quantity < 5 OR l_quantity >= 40 THEN NULL WHEN l_quantity >= 30 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def open_bins(spark, sf):
    return table(spark, sf, "lineitem").groupBy(S.right_bin(F.col("l_quantity"), [5.0, 10.0, 30.0, 40.0], clip=False).alias("bin")).agg(F.count("*").alias("n"))


@query("f13_json_field", "SELECT event_id, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("f12_array_sums", A.with_ctes(A.EV, tail="SELECT train_id, sum(op_id)::BIGINT AS total, count(*) FILTER (WHERE delay_sec > 0) AS late FROM ev GROUP BY 1"))
def array_sums(spark, sf):
    a = A.events(spark, sf).groupBy("train_id").agg(F.collect_list(F.struct("op_id", "delay_sec")).alias("l"))
    return a.select("train_id", F.aggregate("l", F.lit(0).cast("bigint"), lambda s, x: s + x["op_id"]).alias("total"), F.size(F.filter("l", lambda x: x["delay_sec"] > 0)).cast("bigint").alias("late"))


TEXT_DATES = """d AS (SELECT DISTINCT upper(strftime(observed_ts, '%d%b%Y')) AS service_text FROM ev)"""


@query("o03_text_sorted_dates", A.with_ctes(A.EV, TEXT_DATES, tail="SELECT service_text, row_number() OVER (ORDER BY service_text) AS place FROM d"))
def text_sorted_dates(spark, sf):
    """Service dates in the order of their text: 01FEB2024 before 02JAN2024. A row is a day."""
    d = A.events(spark, sf).select(F.upper(F.date_format("observed_ts", "ddMMMyyyy")).alias("service_text")).distinct()
    return d.select("service_text", F.row_number().over(W.orderBy("service_text")).cast("bigint").alias("place"))


@query("o05_snapshot_union", A.with_ctes(A.EV, A.SNAP, "full_days AS (SELECT service_date FROM ev GROUP BY 1 HAVING max(delay_sec) > 2000), s AS (SELECT * FROM snap WHERE strftime(snapshot_ts, '%Y-%m-%d') IN (SELECT service_date FROM full_days))", tail="SELECT snapshot_ts, row_number() OVER (ORDER BY snapshot_ts) AS place FROM (SELECT snapshot_ts FROM s WHERE split = 'train' UNION SELECT snapshot_ts FROM s WHERE split = 'test' OR snapshot_ts < TIMESTAMP '2024-01-05 00:00:00')"))
def snapshot_union(spark, sf):
    """Train and test snapshots of days with very late trains, once each, in order of time."""
    days = A.events(spark, sf).groupBy("service_date").agg(F.max("delay_sec").alias("d")).where("d > 2000").select(F.col("service_date").alias("day"))
    s = A.snapshots(spark).join(days, F.date_format("snapshot_ts", "yyyy-MM-dd") == F.col("day"), "left_semi")
    both = s.where("split = 'train'").select("snapshot_ts").union(s.where("split = 'test' or snapshot_ts < timestamp_ntz '2024-01-05 00:00:00'").select("snapshot_ts")).distinct()
    return both.select("snapshot_ts", F.row_number().over(W.orderBy("snapshot_ts")).cast("bigint").alias("place"))


RUNS = """r AS (SELECT *, lag(service_date) OVER w IS DISTINCT FROM service_date AS begins, row_number() OVER w - 1 AS pos FROM ev WINDOW w AS (PARTITION BY train_id ORDER BY seq)),
g AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY train_id ORDER BY seq) AS run FROM r)"""


@query("w15_key_runs", A.with_ctes(A.EV, RUNS, tail="SELECT train_id, any_value(service_date) AS service_date, min(pos) AS start, count(*) AS length FROM g GROUP BY train_id, run"))
def key_runs(spark, sf):
    return journeys.key_runs(A.events(spark, sf), ["train_id"], "service_date", "seq").drop("run")
