"""Exact quantiles without a group in one task: values are counted, range-sorted, and found by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored


def exact(rows: DataFrame, value: str, names: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, names): for each name the quantile of the values that are not null, between two values by linear interpolation.

    Equal values of a group are one row with a count, so a common value costs nothing. These rows are range-sorted by group and value;
    counts by range and group, summed up over the ranges, say which ranks a range holds, and a running sum inside it finds the
    values at them. A group of any size fills as many ranges as it needs."""
    by = list(by)
    spark = rows.sparkSession
    key = [f"_g{k}" for k in range(len(by))]
    counts = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, key, strict=True)], F.col(value).cast("double").alias("_v"))
    counts = counts.groupBy(*key, "_v").agg(F.count("*").alias("_n"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = stored(counts.repartitionByRange(parts, *key, "_v").withColumn("_range", F.spark_partition_id()), "ranks")
    totals = ranged.groupBy(*key, "_range").agg(F.sum("_n").alias("_t"))  # a row for each range and group in it
    group = W.partitionBy(*key)
    ahead = F.coalesce(F.sum("_t").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*[F.col(k).alias(f"{k}t") for k in key], F.col("_range").alias("_r"), ahead.alias("_ahead"), F.sum("_t").over(group).alias("_all"))
    on = F.col("_range") == F.col("_r")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}t"))
    inside = W.partitionBy("_range", *key).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = ranged.join(totals, on).withColumn("_end", F.col("_ahead") + F.sum("_n").over(inside))
    place = {n: F.lit(float(q)) * (F.col("_all") - 1) for n, q in names.items()}
    holds = lambda at: (F.col("_end") - F.col("_n") <= at) & (at < F.col("_end"))
    cells = [x for n, p in place.items() for x in (F.max(F.when(holds(F.floor(p)), F.col("_v"))).alias(f"_lo_{n}"), F.max(F.when(holds(F.ceil(p)), F.col("_v"))).alias(f"_hi_{n}"), F.max(p - F.floor(p)).alias(f"_w_{n}"))]
    found = ranks.groupBy(*key).agg(*cells)
    between = lambda n: F.col(f"_lo_{n}") + F.col(f"_w_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
    return found.select(*[F.col(k).alias(c) for k, c in zip(key, by, strict=True)], *[between(n).alias(n) for n in names])
