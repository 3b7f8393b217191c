"""Scoring of predictions: strict key alignment, coverage, global and binned errors, seed summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_label, right_bin, seconds_between
from ..sources.scratch import stored
from .features import slot_columns

KEYS = ("ts", "train_id", "service_date")
INF = float("inf")
#: Bins of the horizon in minutes and of the change of delay in seconds.
HORIZON_MIN = [0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, INF]
CHANGE_SEC = [-INF, -300.0, -120.0, -60.0, -30.0, 0.0, 30.0, 60.0, 120.0, 300.0, 600.0, INF]


def check_columns(truth: DataFrame, predictions: DataFrame, keys=KEYS) -> list[str]:
    for name, df in (("truth", truth), ("predictions", predictions)):
        if missing := [k for k in keys if k not in df.columns]:
            raise KeyError(f"{name} lacks key columns {missing}")
    a, b = slot_columns(truth.columns, "future_delay_"), slot_columns(predictions.columns, "future_delay_")
    if a != b:
        raise KeyError(f"target columns {a}, predicted columns {b}")
    return a


def alignment(truth: DataFrame, predictions: DataFrame, keys=KEYS) -> DataFrame:
    """One row: matched, only_truth, only_predicted."""
    a, b = truth.select(*keys).withColumn("_t", F.lit(1)), predictions.select(*keys).withColumn("_p", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("matched"), F.count_if(F.col("_p").isNull()).alias("only_truth"), F.count_if(F.col("_t").isNull()).alias("only_predicted"))


def long_pairs(truth: DataFrame, predictions: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, slot, y, p, horizon_min, change_sec), one row for each real target."""
    cols = check_columns(truth, predictions, keys)
    p = predictions.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in cols])
    obs = lambda c: "future_obs_ts_" + c.rsplit("_", 1)[1]
    minutes = lambda c: seconds_between(F.col(obs(c)), F.col("ts")) / 60.0 if obs(c) in truth.columns else F.lit(None).cast("double")
    cells = F.array(*[F.struct(F.lit(int(c.rsplit("_", 1)[1])).alias("slot"), F.col(c).cast("double").alias("y"), F.col(f"_p_{c}").cast("double").alias("p"), minutes(c).alias("horizon_min")) for c in cols])
    last = [F.col("last_known_delay").cast("double").alias("last_known_delay")] if "last_known_delay" in truth.columns else []
    out = truth.join(p, list(keys)).select(*keys, *last, F.explode(cells).alias("s")).select(*keys, *(["last_known_delay"] if last else []), "s.*")
    return out.where("y is not null").withColumn("change_sec", F.col("y") - F.col("last_known_delay") if last else F.lit(None).cast("double"))


def errors() -> list:
    d = F.col("p") - F.col("y")
    return [F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count(d).alias("n_values")]


def by_bins(pairs: DataFrame, column: str, edges: list[float], unit: str) -> DataFrame:
    """(bin, mae, rmse, n_values) of the bins that hold values; outside values count in the first or last."""
    labels = bin_label(edges, unit)
    k = right_bin(F.col(column), edges)
    name = F.element_at(F.array(*map(F.lit, labels)), F.col("_k") + 1)
    return pairs.where(F.col(column).isNotNull() & F.col("p").isNotNull()).groupBy(k.alias("_k")).agg(*errors()).select(name.alias("bin"), "mae", "rmse", "n_values")


def evaluate(truth: DataFrame, predictions: DataFrame, keys=KEYS) -> dict:
    """All metrics as a dict. Keys must match exactly and every real target needs a prediction."""
    a = alignment(truth, predictions, keys).first()
    if a.only_truth or a.only_predicted:
        raise ValueError(f"keys do not match: {a.asDict()}")
    pairs = stored(long_pairs(truth, predictions, keys), "pairs")
    one = pairs.agg(F.count_if(F.col("p").isNull()).alias("lacking"), *errors()).first()
    if one.lacking:
        raise ValueError(f"{one.lacking} real targets without a prediction")
    if not one.n_values:
        raise ValueError("no target to score")
    table = lambda df: {r["bin"]: {"mae": r.mae, "rmse": r.rmse, "n_values": r.n_values} for r in df.collect()}  # noqa: E731  a row a bin
    return {"mae": one.mae, "rmse": one.rmse, "n_values": one.n_values, "matched": a.matched, "horizon": table(by_bins(pairs, "horizon_min", HORIZON_MIN, "m")), "change": table(by_bins(pairs, "change_sec", CHANGE_SEC, "s"))}


def summarise_seeds(results: list[dict]) -> dict:
    """Mean and population deviation of every numeric leaf over seeds; counts (n_values, matched) are left out."""
    import numpy as np

    def leaves(x, path=()):
        for k, v in x.items():
            if isinstance(v, dict):
                yield from leaves(v, (*path, k))
            elif k not in ("n_values", "matched"):
                yield (*path, k), float(v)

    by: dict[tuple, list[float]] = {}
    for r in results:
        for path, v in leaves(r):
            by.setdefault(path, []).append(v)
    return {"/".join(p): {"mean": float(np.mean(v)), "std": float(np.std(v))} for p, v in by.items()}


def denormalise(prediction, mean, std, last_known):
    """Back to seconds: scale, square with its sign, add the last known delay."""
    x = prediction * std + mean
    return F.signum(x) * x * x + last_known
