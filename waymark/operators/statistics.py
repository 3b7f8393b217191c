"""Statistics that can be stored by period, merged, and finished later.

A partial row holds, for one group, period and column: the number of finite values, their mean, the sum of
squared deviations from it, both ends, and a quantile sketch. Partials of two periods merge into
those of both, so a period can be replaced without reading the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

PARTIAL = ("n", "mean", "m2", "low", "high", "sketch")
#: Size of the quantile sketches: a rank error of about 1.3 % for one sketch and of its merges.
SKETCH_K = 200


def partials(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, column, n, mean, m2, low, high, sketch): one aggregate over rows for all columns; values that are null or not finite count nothing."""
    value = {c: S.finite(F.col(c).cast("double")) for c in columns}
    parts = {"n": F.count, "mean": F.avg, "var": F.var_pop, "low": F.min, "high": F.max, "sketch": lambda x: F.kll_sketch_agg_double(x, SKETCH_K)}
    one = rows.groupBy(*by).agg(*[f(x).alias(f"{c}|{n}") for c, x in value.items() for n, f in parts.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{n}`").alias(n) for n in parts]) for c in columns])
    out = one.select(*by, F.explode(cells).alias("s")).select(*by, "s.*")
    return out.select(*by, "column", "n", "mean", (F.col("var") * F.col("n")).alias("m2"), "low", "high", "sketch")


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Partials of fewer keys. Deviations are taken from the common mean, not by difference of squares."""
    key = [*by, "column"]
    w = W.partitionBy(*key)
    whole = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    rows = parts.where("n > 0").withColumn("_mean", whole)
    moved = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    out = rows.groupBy(*key).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(moved).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))
    none = parts.groupBy(*key).agg(F.sum("n").alias("n")).where("n = 0")
    return out.unionByName(none, allowMissingColumns=True)


def finished(parts: DataFrame, quantiles: tuple[float, ...] = ()) -> DataFrame:
    """parts with std (of a sample; 0 for a single value), and q_<percent> from the sketch for each of ``quantiles``."""
    std = F.when(F.col("n") == 1, 0.0).when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    ask = {f"q_{round(100 * q)}": F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))) for q in quantiles}
    return parts.withColumns({"std": std, **ask}).drop("m2", "sketch")


def store(parts: DataFrame, path: str, period: str) -> None:
    """Writes partials by period; periods that ``parts`` holds are replaced, the others are neither read nor written."""
    parts.write.mode("overwrite").partitionBy(period).option("partitionOverwriteMode", "dynamic").parquet(path)
