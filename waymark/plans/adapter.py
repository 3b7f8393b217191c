"""The driver's star-schema tables read as a timetabled network, in Spark and, formula by formula, in DuckDB SQL.

events -> journeys of a user and day; lineitem and orders -> stop records; a ring with chords -> the network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table

N_OPS = 100
#: Snapshots every six hours of these days.
FIRST_SNAPSHOT, LAST_SNAPSHOT = "2024-01-02 00:00:00", "2024-01-29 00:00:00"
SPLIT_AT = "2024-01-20 00:00:00"
RELATIONS = ("IC 01", "L 02", "S51", "P", "EXTRA 9")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = F.round((F.col("value") - 50) * 10).cast("bigint")
    kind = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "D").otherwise("P")
    e = e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", kind.alias("kind"), F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("op_id"), d.alias("d"))
    relation = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("user_id") % len(RELATIONS) + 1).cast("int"))
    return e.select(
        F.date_format("ts", "yyyyMM").alias("month"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("train_id"), F.date_format("ts", "yyyy-MM-dd").alias("service_date"),
        "op_id", F.col("kind").alias("event_type"), F.col("ts").alias("observed_ts"), F.expr("timestampadd(SECOND, -d, ts)").cast("timestamp_ntz").alias("planned_ts"), F.col("d").alias("delay_sec"), relation.alias("train_relation"),
    )


EV = """ev AS (
  SELECT strftime(ts, '%Y%m') AS month, event_id AS seq, user_id::VARCHAR AS train_id, strftime(ts, '%Y-%m-%d') AS service_date,
    regexp_extract(props, '[0-9]+')::BIGINT AS op_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'D' ELSE 'P' END AS event_type,
    ts AS observed_ts, ts - to_microseconds(d * 1000000) AS planned_ts, d AS delay_sec,
    CASE user_id % 5 WHEN 0 THEN 'IC 01' WHEN 1 THEN 'L 02' WHEN 2 THEN 'S51' WHEN 3 THEN 'P' ELSE 'EXTRA 9' END AS train_relation
  FROM (SELECT *, round((value - 50) * 10)::BIGINT AS d FROM events))"""


def snapshots(spark: SparkSession) -> DataFrame:
    s = spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '{FIRST_SNAPSHOT}', TIMESTAMP_NTZ '{LAST_SNAPSHOT}', INTERVAL 6 HOURS)) AS snapshot_ts")
    return s.withColumn("split", F.when(F.col("snapshot_ts") < F.lit(SPLIT_AT).cast("timestamp_ntz"), "train").otherwise("test"))


SNAP = f"""snap AS (
  SELECT snapshot_ts, CASE WHEN snapshot_ts < TIMESTAMP '{SPLIT_AT}' THEN 'train' ELSE 'test' END AS split
  FROM (SELECT unnest(generate_series(TIMESTAMP '{FIRST_SNAPSHOT}', TIMESTAMP '{LAST_SNAPSHOT}', INTERVAL 6 HOUR)) AS snapshot_ts))"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(op_id, nation, cents): what the customers of each operational point say about it."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % N_OPS).cast("bigint").alias("op_id"), "c_custkey", "c_nationkey", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"))
    return c.groupBy("op_id").agg(F.min_by("c_nationkey", "c_custkey").alias("nation"), F.abs(F.sum("cents")).alias("cents"))


PLACES = """places AS (
  SELECT (c_custkey % 100)::BIGINT AS op_id, arg_min(c_nationkey, c_custkey) AS nation, abs(sum(round(c_acctbal * 100)::BIGINT))::BIGINT AS cents FROM customer GROUP BY 1)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring through the operational points and chords across it, as far as both ends have customers; their accounts set the lengths."""
    p = places(spark, sf_dir)
    kinds = F.array(F.struct(F.lit(1).alias("step"), F.lit(0).alias("first"), F.lit("L1").alias("line_id"), F.lit(500).alias("least"), F.lit(400).alias("span")), F.struct(F.lit(10).alias("step"), F.lit(N_OPS).alias("first"), F.lit("L2").alias("line_id"), F.lit(3000).alias("least"), F.lit(900).alias("span")))
    both = p.select("op_id", "cents", F.explode(kinds).alias("x")).withColumn("v_node_id", (F.col("op_id") + F.col("x.step")) % N_OPS)
    both = both.join(p.select(F.col("op_id").alias("v_node_id")), "v_node_id", "left_semi")
    return both.select((F.col("op_id") + F.col("x.first") + 1).alias("link_id"), F.col("op_id").alias("u_node_id"), "v_node_id", "x.line_id", (F.col("x.least") + F.col("cents") % F.col("x.span")).cast("double").alias("distance_m"))


LINKS = PLACES + """, links AS (
  SELECT u.op_id + first + 1 AS link_id, u.op_id AS u_node_id, v.op_id AS v_node_id, line_id, (least + u.cents % span)::DOUBLE AS distance_m
  FROM places u CROSS JOIN (SELECT unnest([1, 10]) AS step, unnest([0, 100]) AS first, unnest(['L1', 'L2']) AS line_id, unnest([500, 3000]) AS least, unnest([400, 900]) AS span)
  JOIN places v ON v.op_id = (u.op_id + step) % 100)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operational points that have customers: named after a customer's nation, placed by their accounts."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("op_name"))
    p = places(spark, sf_dir).join(n, "nation", "left")
    kind = F.when(F.col("op_id") % 3 == 0, "Station").otherwise("Halt")
    return p.select("op_id", "op_name", kind.alias("op_type"), (50 + F.col("op_id") * 7 % 100 / 100.0).alias("lat"), (4 + F.col("cents") % 100 / 100.0).alias("lon"))


NODES = """sites AS (
  SELECT (c_custkey % 100)::BIGINT AS op_id, arg_min(c_nationkey, c_custkey) AS nation, abs(sum(round(c_acctbal * 100)::BIGINT))::BIGINT AS cents FROM customer GROUP BY 1),
nodes AS (
  SELECT op_id, n_name AS op_name, CASE WHEN op_id % 3 = 0 THEN 'Station' ELSE 'Halt' END AS op_type, 50 + (op_id * 7 % 100) / 100.0::DOUBLE AS lat, 4 + (cents % 100) / 100.0::DOUBLE AS lon
  FROM sites LEFT JOIN nation ON n_nationkey = nation)"""


def raw_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(op_id 0..9, time, temperature_2m, seq): two rows for an hour where its station has many events."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), (F.regexp_extract("props", "[0-9]+", 0).cast("bigint") % 10).alias("op_id"), F.round(F.col("value") * 100).cast("bigint").alias("c"), (F.col("event_id") % 2).alias("seq"))
    g = e.groupBy("op_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("time"), "seq")
    return g.agg((F.sum("c") / F.count("*") / 100).alias("temperature_2m"))


WX = """wx AS (
  SELECT regexp_extract(props, '[0-9]+')::BIGINT % 10 AS op_id, date_trunc('hour', ts)::TIMESTAMP AS time, event_id % 2 AS seq, sum(round(value * 100)::BIGINT)::BIGINT / count(*)::DOUBLE / 100 AS temperature_2m
  FROM events GROUP BY 1, 2, 3)"""


#: Stop records of one task: with the sorts of the join and of the numbering about 130 MB.
STOPS_A_TASK = 500_000


def stops(spark: SparkSession, sf_dir: str, by_journey: bool = False) -> DataFrame:
    """Stop records: journey = order, a share of them with the departure planned before the arrival.

    Large tables are dealt to so many tasks that a task's share stays the same; with ``by_journey``, the result again by journey, for windows over it."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("day"))
    n = -(-li.count() // STOPS_A_TASK)
    dealt = (lambda rows, *by: rows.repartition(n, *by)) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else (lambda rows, *by: rows)
    li, o = dealt(li, "l_orderkey"), dealt(o, "o_orderkey")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    s = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("k", F.row_number().over(w).cast("bigint"))
    at = lambda sec: F.expr(f"timestampadd(SECOND, {sec}, day)").cast("timestamp_ntz")
    out = s.select(
        F.col("l_orderkey").cast("string").alias("train_id"), F.date_format("day", "yyyy-MM-dd").alias("service_date"), F.col("k").alias("seq"), (F.col("l_suppkey") % 50).alias("op_id"), F.concat(F.lit("P"), F.col("l_partkey") % 7).alias("arr_line_id"), F.concat(F.lit("P"), F.col("l_partkey") % 5).alias("dep_line_id"),
        at("k * 600 + (q - 45) * 30").alias("planned_arr_ts"), at("k * 600").alias("planned_dep_ts"), at("k * 600 + (q - 45) * 30 + tax * 40").alias("obs_arr_ts"), at("k * 600 + tax * 45").alias("obs_dep_ts"),
    )
    return dealt(out, "train_id", "service_date") if by_journey else out


STOPS = """stops AS (
  SELECT l_orderkey::VARCHAR AS train_id, strftime(o_orderdate, '%Y-%m-%d') AS service_date, k AS seq, l_suppkey % 50 AS op_id, 'P' || (l_partkey % 7) AS arr_line_id, 'P' || (l_partkey % 5) AS dep_line_id,
    o_orderdate + to_seconds(k * 600 + (q - 45) * 30) AS planned_arr_ts, o_orderdate + to_seconds(k * 600) AS planned_dep_ts,
    o_orderdate + to_seconds(k * 600 + (q - 45) * 30 + tax * 40) AS obs_arr_ts, o_orderdate + to_seconds(k * 600 + tax * 45) AS obs_dep_ts
  FROM (SELECT *, l_quantity::BIGINT AS q, round(l_tax * 100)::BIGINT AS tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def with_ctes(*ctes: str, tail: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + tail
