"""Snapshots as padded batches of bounded size, and inference on them.

A snapshot is padded to the next power of two of its trains. Snapshots of one width fill batches of at most ``limit``
places (a single snapshot may have more), so none is split and no place is padded to more than twice its trains.
"""

from __future__ import annotations

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 512


def planned(sizes: DataFrame, limit: int = LIMIT, snapshot: str = "snapshot_ts") -> DataFrame:
    """sizes(snapshot, n) with ``width`` and ``batch``, a number inside the width. A row for each snapshot, not for each train."""
    width = F.when(F.col("n") <= 1, 1).otherwise(F.expr("shiftleft(1, length(bin(n - 1)))")).cast("int")
    rows = sizes.withColumn("width", width)
    place = F.row_number().over(W.partitionBy("width").orderBy(snapshot)) - 1
    return rows.withColumn("batch", F.floor(place / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("width")))).cast("int"))


def padded(rows: DataFrame, values: list[str], order: str, limit: int = LIMIT, snapshot: str = "snapshot_ts") -> DataFrame:
    """One row for each snapshot: width, batch, ``x`` (width lists of values, zeros where padded), ``mask`` (1 where a train is) and ``ids``, what ``order`` holds."""
    trains = F.array_sort(F.collect_list(F.struct(F.col(order).alias("id"), F.array(*[F.col(c).cast("double") for c in values]).alias("x"))))
    one = rows.groupBy(snapshot).agg(trains.alias("t")).withColumn("n", F.size("t"))
    plan = planned(one.select(snapshot, "n"), limit, snapshot).drop("n")
    out = one.join(plan, snapshot)
    empty = F.array(*[F.lit(0.0) for _ in values])
    fill = lambda have, with_: F.concat(have, F.array_repeat(with_, F.col("width") - F.col("n")))
    return out.select(snapshot, "n", "width", "batch", F.transform("t", lambda t: t["id"]).alias("ids"), fill(F.transform("t", lambda t: t["x"]), empty).alias("x"), fill(F.array_repeat(F.lit(1), F.col("n")), F.lit(0)).alias("mask"))


def batches(snapshots: DataFrame, snapshot: str = "snapshot_ts") -> DataFrame:
    """padded(..) by batch: its snapshots in order, trains, places and the share of these that is padding."""
    b = snapshots.groupBy("width", "batch").agg(F.sort_array(F.collect_list(snapshot)).alias("snapshots"), F.sum("n").cast("bigint").alias("n_trains"), F.sum("width").cast("bigint").alias("n_places"))
    return b.withColumn("padding", 1 - F.col("n_trains") / F.col("n_places"))


def predicted(snapshots: DataFrame, make, n_values: int, batch_size: int = 64, snapshot: str = "snapshot_ts") -> DataFrame:
    """(snapshot, id, prediction) of padded(..): ``make()`` gives fn(x [b, width, values], mask [b, width]) -> [b, width], made once in each Python worker.

    One vectorised function for each width (powers of two, so a few); padding is dropped on the way back to rows."""
    widths = sorted(r.width for r in snapshots.select("width").distinct().collect())
    kind = T.ArrayType(T.DoubleType())
    out = None
    for w in widths:
        run = predict_batch_udf(make, return_type=kind, batch_size=batch_size, input_tensor_shapes=[[w, n_values], [w]])
        own = snapshots.where(F.col("width") == w)
        got = own.select(snapshot, "ids", run(F.flatten("x"), F.transform("mask", lambda m: m.cast("double"))).alias("y"))
        got = got.select(snapshot, F.explode(F.arrays_zip("ids", F.slice("y", 1, F.size("ids")).alias("y"))).alias("z")).select(snapshot, F.col("z.ids").alias("id"), F.col("z.y").alias("prediction"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        return snapshots.select(snapshot, F.explode("ids").alias("id"), F.lit(None).cast("double").alias("prediction"))
    return out
