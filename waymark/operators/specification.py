"""Feature specifications: which columns a table has, in which order, and how they were scaled, kept beside the data."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import statistics

FOLDER = "_feature_spec"  # readers of the table skip names that begin with an underscore


def learned(rows: DataFrame, z: list[str] = (), scaled: list[str] = (), split: str = "split", train: str = "train") -> dict:
    """The specification of rows: columns with their types in order, and the numbers of the train rows for each scaled column."""
    names = [*z, *scaled]
    stats = statistics.finished(statistics.partials(rows.where(F.col(split) == train), names, [])).collect() if names else []  # a row for each column
    norm = {r["column"]: {"norm": "z" if r["column"] in z else "range", "n": r["n"], **{k: r[k] for k in ("mean", "std", "low", "high")}} for r in stats}
    return {"columns": [[n, t] for n, t in rows.dtypes], "normalised": {c: norm[c] for c in names}}


def write(rows: DataFrame, spec: dict, path: str) -> None:
    """The table, and beside it its specification, by Spark's own writers, so both are where the session's stores are."""
    rows.write.mode("overwrite").parquet(path)
    rows.sparkSession.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{FOLDER}")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(table, specification), checked against each other."""
    spec = json.loads("".join(r.value for r in spark.read.text(f"{path}/{FOLDER}").collect()))
    return checked(spark.read.parquet(path), spec), spec


def checked(rows: DataFrame, spec: dict) -> DataFrame:
    """rows, if its columns are those of the specification in its order and of its types; otherwise an error that says which differ."""
    want, have = [tuple(c) for c in spec["columns"]], rows.dtypes
    if want != have:
        at = next((k for k, (a, b) in enumerate(zip(want, have, strict=False)) if a != b), min(len(want), len(have)))
        show = lambda cs: " ".join(cs[at]) if at < len(cs) else "nothing"
        raise ValueError(f"column {at + 1} is {show(have)}; the specification has {show(want)}")
    return rows


def applied(rows: DataFrame, spec: dict) -> DataFrame:
    """rows (of any split) scaled by the numbers of the specification."""
    new = {}
    for c, s in spec["normalised"].items():
        x = F.col(c).cast("double")
        low, high = (F.lit(s[k]).cast("double") for k in ("low", "high"))
        value = S.z_score(x, F.lit(s["mean"]).cast("double"), F.lit(s["std"]).cast("double")) if s["norm"] == "z" else S.min_max(x, low, high)
        new[c] = F.when(x.isNotNull(), value)
    return checked(rows, spec).withColumns(new)


def undone(rows: DataFrame, spec: dict) -> DataFrame:
    """What ``applied`` was given (ranges: but for values that were clipped)."""
    new = {}
    for c, s in spec["normalised"].items():
        x, std = F.col(c), F.lit(s["std"]).cast("double")
        mean, low, high = (F.lit(s[k]).cast("double") for k in ("mean", "low", "high"))
        new[c] = F.when(std > 0, x * std + mean).otherwise(x + mean) if s["norm"] == "z" else F.when(x.isNotNull(), S.un_min_max(x, low, high))
    return rows.withColumns(new)
