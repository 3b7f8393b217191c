"""Feature tables: statistics learned on the train split only, normalisation, engineered columns, hold-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def moments(rows: DataFrame, columns: list[str], split: str = "split", train: str = "train") -> DataFrame:
    """(column, n, mean, std, low, high) over finite values of train rows: one aggregate for all columns.

    std is the sample deviation, 0 for a single value.
    """
    finite = {c: F.when(F.col(split) == train, S.finite(F.col(c).cast("double"))) for c in columns}
    one = rows.agg(*[f(x).alias(f"{c}|{n}") for c, x in finite.items() for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("low", F.min), ("high", F.max))])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{n}`").alias(n) for n in ("n", "mean", "std", "low", "high")]) for c in columns])
    return one.select(F.explode(cells).alias("s")).select("s.column", "s.n", "s.mean", F.when(F.col("s.n") == 1, 0.0).otherwise(F.col("s.std")).alias("std"), "s.low", "s.high")


def pooled(rows: DataFrame, families: dict[str, list[str]], split: str = "split", train: str = "train") -> DataFrame:
    """(family, n, mean, std): the columns of a family share one set of statistics."""
    cells = F.array(*[F.struct(F.lit(f).alias("family"), F.col(c).cast("double").alias("x")) for f, cs in families.items() for c in cs])
    long = rows.where(F.col(split) == train).select(F.explode(cells).alias("s")).select("s.family", S.finite(F.col("s.x")).alias("x"))
    out = long.groupBy("family").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return out.withColumn("std", F.when(F.col("n") == 1, 0.0).otherwise(F.col("std")))


def normalise(rows: DataFrame, stats: DataFrame, z: list[str] = (), scaled: list[str] = ()) -> DataFrame:
    """rows with z-scores and min-max values. stats has a row a column, so it is one broadcast row when turned."""
    names = [*z, *scaled]
    flat = stats.where(F.col("column").isin(names)).agg(*[F.max(F.when(F.col("column") == c, F.struct("mean", "std", "low", "high"))).alias(f"_{c}") for c in names])
    out = rows.crossJoin(F.broadcast(flat))  # one row
    new = {c: S.z_score(F.col(c), F.col(f"_{c}.mean"), F.col(f"_{c}.std")) for c in z} | {c: S.min_max(F.col(c), F.col(f"_{c}.low"), F.col(f"_{c}.high")) for c in scaled}
    return out.withColumns(new).drop(*[f"_{c}" for c in names])


def temporal_holdout(rows: DataFrame, share: float, snapshot: str = "snapshot_ts") -> DataFrame:
    """rows with ``fold``: the last round(share * n) different snapshots (1 to n - 1) are ``valid``, the others ``fit``."""
    times = rows.select(snapshot).distinct()
    n = times.agg(F.count("*").alias("n"))
    w = W.orderBy(F.desc(snapshot))
    k = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.lit(share) * F.col("n")).cast("bigint")))
    ranked = times.withColumn("r", F.row_number().over(w)).crossJoin(F.broadcast(n)).select(snapshot, F.when(F.col("r") <= k, "valid").otherwise("fit").alias("fold"))
    return rows.join(ranked, snapshot)


def split_rows(rows: DataFrame, snapshots: DataFrame, snapshot: str = "snapshot_ts") -> DataFrame:
    """rows with the split of their snapshot; a snapshot of two splits, or of none, is an error at once."""
    twice = snapshots.groupBy(snapshot).agg(F.countDistinct("split").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError("a snapshot belongs to both splits")
    if rows.select(snapshot).distinct().join(snapshots, snapshot, "left_anti").limit(1).count():
        raise ValueError("rows of a snapshot that belongs to no split")
    return rows.join(snapshots.select(snapshot, "split").distinct(), snapshot)


def ordered_columns(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The columns in the order asked for; a missing one is an error."""
    missing = [c for c in wanted if c not in rows.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return rows.select(*wanted)


def slot_columns(names: list[str], prefix: str) -> list[str]:
    """prefix_1, prefix_2, .. in numeric order."""
    return sorted((c for c in names if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))


#: The feature families in reporting order; for each the beginnings of a column's name, and a part it must hold.
FAMILIES = {
    "train_information": (("operator_", "train_relation_"), ""),
    "snapshot_time_features": (("snapshot_",), ""),
    "event_planned_timing": (("past_", "future_"), "planned_delta"),
    "past_delay_features": (("past_delay_sec_",), ""),
    "event_type_features": (("past_", "future_"), "event_type"),
    "event_node_embeddings": (("past_", "future_"), "_emb_"),
    "local_network_context": (("link", "prev_", "next_"), ""),
    "weather_features": (("weather_",), ""),
}


def families(names: list[str]) -> dict[str, list[str]]:
    """Columns by family; a name that fits none is an error."""
    out: dict[str, list[str]] = {f: [] for f in FAMILIES}
    for c in names:
        f = next((f for f, (begins, part) in FAMILIES.items() if c.startswith(begins) and part in c), None)
        if f is None:
            raise ValueError(f"no family for column {c}")
        out[f].append(c)
    return out


def attach_embedding(rows, embedding, dim: int, key: str = "op_id", prefix: str = "emb"):
    """rows with ``prefix_1`` .. ``prefix_dim`` of embedding(key, embedding); an id without one, or none, gets zeros."""
    known = embedding.select(F.col(key).alias("_k"), F.col("embedding").alias("_e"))
    out = rows.join(known, F.col(key) == F.col("_k"), "left")
    return out.select(*rows.columns, *[F.coalesce(F.get("_e", F.lit(k)), F.lit(0.0)).alias(f"{prefix}_{k + 1}") for k in range(dim)])


def without_family(rows: DataFrame, family: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ablation: rows without the columns of one family."""
    return rows.drop(*families([c for c in rows.columns if c not in keep])[family])


def swap_directions(rows: DataFrame) -> DataFrame:
    """uv_* and vu_* columns exchanged."""
    other = lambda c: "vu_" + c[3:] if c.startswith("uv_") else "uv_" + c[3:] if c.startswith("vu_") else c
    return rows.select(*[F.col(other(c)).alias(c) for c in rows.columns])
