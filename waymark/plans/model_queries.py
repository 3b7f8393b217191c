"""Queries around models: cached paths, padded batches and inference, feature specifications, chunked sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import batches, boosted, features, network, search, specification
from ..sources import chunked, scratch
from . import adapter as A
from .gold_queries import NODE
from .network_queries import TO_PATHS, requests
from .registry import query
from .snapshot_queries import BASE, KEY, split


@query("s20_path_cache", A.with_ctes(*TO_PATHS, tail="SELECT src, dst, dep_line, path, CASE WHEN src % 2 = 0 THEN 1 ELSE 2 END::INT AS batch FROM found"))
def path_cache(spark, sf):
    """Paths through a stored table: half of the requests first, then all of them, of which only the others are searched, then all again, of which none is."""
    asked, links, store = requests(spark, sf), A.links(spark, sf), scratch.new_path(spark, "paths")
    network.cached_paths(asked.where("src % 2 = 0"), links, store, 1)
    network.cached_paths(asked, links, store, 2)
    return network.reachable(network.cached_paths(asked, links, store, 3)).select("src", "dst", "dep_line", "path", "batch")


def _trains(spark, sf):
    from .gold_queries import _nodes

    hour = S.day_fraction(F.col("snapshot_ts"))
    return _nodes(spark, sf).select("snapshot_ts", "node", *KEY, S.signed_sqrt(F.col("last_known_delay")).alias("root"), hour.alias("hour"))


PLAN = """size AS (SELECT snapshot_ts, count(*) AS n FROM w GROUP BY 1),
wide AS (SELECT *, CASE WHEN n <= 1 THEN 1 ELSE 1 << length(bin(n - 1)) END AS width FROM size),
plan AS (SELECT *, (row_number() OVER (PARTITION BY width ORDER BY snapshot_ts) - 1) // greatest(1, 64 // width) AS batch FROM wide)"""


@query("e14_snapshot_batches", A.with_ctes(*BASE, NODE, PLAN, tail="SELECT width::INT AS width, batch::INT AS batch, list(snapshot_ts ORDER BY snapshot_ts) AS snapshots, sum(n)::BIGINT AS n_trains, sum(width)::BIGINT AS n_places, round(1 - sum(n) / sum(width), 8) AS padding FROM plan GROUP BY 1, 2"))
def snapshot_batches(spark, sf):
    """Snapshots of similar size together, 64 places a batch, none of them split; how much of each batch is padding."""
    p = batches.padded(_trains(spark, sf), ["root", "hour"], "node", limit=64)
    return batches.batches(p).withColumn("padding", F.round("padding", 8))


@query("e14_masks", A.with_ctes(*BASE, NODE, PLAN, tail="SELECT snapshot_ts, list_resize(list_transform(range(n), lambda k: 1::INT), width::INT, 0) AS mask, list_resize(list_transform(range(n), lambda k: 1.0::DOUBLE), width::INT, 0) AS places FROM plan"))
def masks(spark, sf):
    """The mask of each snapshot, and as many places of values."""
    p = batches.padded(_trains(spark, sf).withColumn("one", F.lit(1.0)), ["one"], "node", limit=64)
    return p.select("snapshot_ts", "mask", F.transform("x", lambda v: v[0]).alias("places"))


def crowd_model():
    """A model over whole snapshots: a train's own delay, the mean of its snapshot's real trains, and the hour."""
    import numpy as np

    def run(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        own = x[:, :, 0] * mask
        mean = own.sum(1) / np.maximum(mask.sum(1), 1)
        return 0.5 * own + 0.25 * mean[:, None] * mask + 0.125 * x[:, :, 1]

    return run


_HOUR = "(extract(hour FROM snapshot_ts) + extract(minute FROM snapshot_ts) / 60.0 + extract(second FROM snapshot_ts) / 3600.0) / 24.0"


@query("e21_batch_inference", A.with_ctes(*BASE, NODE, f"r AS (SELECT *, sign(last_known_delay) * sqrt(abs(last_known_delay)) AS root FROM w)", tail=f"SELECT snapshot_ts, train_id, service_date, round(0.5 * root + 0.25 * avg(root) OVER (PARTITION BY snapshot_ts) + 0.125 * {_HOUR}, 6) + 0.0::DOUBLE AS prediction FROM r"))
def batch_inference(spark, sf):
    """Predictions of a model that sees padded snapshots, back at the trains they belong to."""
    rows = scratch.stored(_trains(spark, sf), "trains")
    p = batches.padded(rows, ["root", "hour"], "node", limit=64)
    out = batches.predicted(p, crowd_model, 2).withColumnRenamed("id", "node")
    return rows.join(out, ["snapshot_ts", "node"]).select("snapshot_ts", *KEY, (F.round("prediction", 6) + F.lit(0.0)).alias("prediction"))


_SPEC = "learned AS (SELECT avg(last_known_delay) AS m, stddev_samp(last_known_delay) AS d, min(n_seen) AS l, max(n_seen) AS h FROM seen WHERE split = 'train')"
_SEEN = "seen AS (SELECT k.train_id, k.service_date, k.snapshot_ts, k.split, last_known_delay, count(p.slot)::DOUBLE AS n_seen FROM lkd k LEFT JOIN pst p ON p.train_id = k.train_id AND p.service_date = k.service_date AND p.snapshot_ts = k.snapshot_ts GROUP BY ALL)"


@query("s23_applied_specification", A.with_ctes(*BASE, _SEEN, _SPEC, tail="SELECT train_id, service_date, snapshot_ts, round((last_known_delay - m) / d, 6) + 0.0::DOUBLE AS last_known_delay, round(greatest(0, least(1, (n_seen - l) / (h - l))), 6) AS n_seen, round(last_known_delay, 6) AS undone FROM seen, learned WHERE split = 'test'"))
def applied_specification(spark, sf):
    """What the train rows taught is written beside them, read back, checked, and applied to the test rows; the delay is undone as well."""
    real = F.size(F.filter("padded", lambda e: (e["op_id"] != -1) & (e["observed_ts"] <= F.col("snapshot_ts")))).cast("double")
    rows = scratch.stored(split(spark, sf, 1, 1).select(*KEY, "snapshot_ts", "split", "last_known_delay", real.alias("n_seen")), "seen")
    to = scratch.new_path(spark, "spec")
    specification.write(rows.where("split = 'train'"), specification.learned(rows, z=["last_known_delay"], scaled=["n_seen"]), to)
    _, spec = specification.read(spark, to)
    out = specification.applied(rows.where("split = 'test'"), spec)
    undone = specification.undone(out, spec).select(*KEY, "snapshot_ts", F.round("last_known_delay", 6).alias("undone"))
    return out.join(undone, [*KEY, "snapshot_ts"]).select(*KEY, "snapshot_ts", (F.round("last_known_delay", 6) + F.lit(0.0)).alias("last_known_delay"), F.round("n_seen", 6).alias("n_seen"), "undone")


@query("s15_chunked_source", A.with_ctes(A.WX, tail="SELECT op_id, time, temperature_2m AS value FROM wx WHERE seq = 0 AND op_id < 8 AND time >= TIMESTAMP '2024-01-09' AND time < TIMESTAMP '2024-01-21'"))
def chunked_source(spark, sf):
    """Hourly values of eight stations by requests of three stations each; the service stands on a folder that Spark made of the events."""
    w = A.raw_weather(spark, sf).where("seq = 0").select(F.col("op_id").alias("station"), "time", F.col("temperature_2m").alias("value"))
    to = scratch.new_path(spark, "service")
    w.write.partitionBy("station").parquet(to)
    return chunked.read_chunks(spark, list(range(8)), dt.date(2024, 1, 9), dt.date(2024, 1, 20), "waymark.sources.chunked:from_folder", folder=to, chunk=3)


def _fold(spark, sf):
    """Train rows of the tabular table with ``held``, the last fifth of the snapshots, and test rows; feature names."""
    from .gold_queries import HORIZONS, tabular

    t = scratch.stored(tabular(spark, sf), "tabular")
    names = [c for c in t.columns if c not in (*KEY, "snapshot_ts", "split", *HORIZONS)]
    train = features.temporal_holdout(t.where("split = 'train'"), 0.2).withColumn("held", F.col("fold") == "valid")
    return scratch.stored(train, "fold"), t.where("split = 'test'"), names


@query("s25_reloaded_models")
def reloaded_models(spark, sf):
    """A model for each horizon, ended early by its error on held-out snapshots, saved, loaded again; how many predictions of both agree, and the error."""
    from .gold_queries import HORIZONS, SEED

    train, test, names = _fold(spark, sf)
    models = boosted.fit_all(train, names, HORIZONS, rounds=8, depth=3, seed=SEED, valid="held")
    to = scratch.new_path(spark, "models")
    boosted.save(models, to)
    again = boosted.load(to, list(HORIZONS))
    a, b = (boosted.predictions(m, test) for m in (models, again))
    key = [*KEY, "snapshot_ts"]
    both = a.join(b.select(*key, *[F.col(f"predicted_{y}").alias(f"again_{y}") for y in HORIZONS]), key)
    miss = lambda y: F.abs(S.signed_square(F.col(f"predicted_{y}")) - S.signed_square(F.col(y)))
    cells = [F.struct(F.lit(k + 1).alias("horizon"), F.count("*").alias("n"), F.count_if(F.col(f"predicted_{y}") == F.col(f"again_{y}")).alias("same"), F.round(F.avg(miss(y)), 3).alias("mae"), F.lit(models[y][0].getNumTrees).alias("trees")) for k, y in enumerate(HORIZONS)]
    return both.agg(*[c.alias(f"h{k}") for k, c in enumerate(cells)]).select(F.explode(F.array(*[f"h{k}" for k in range(len(cells))])).alias("h")).select("h.*")


@query("e18_parameter_search")
def parameter_search(spark, sf):
    """Four drawn trials of boosted trees, the better half with more rounds, scored on held-out snapshots."""
    from .gold_queries import SEED

    train, _, names = _fold(spark, sf)
    fit_rows, held = train.where("not held"), train.where("held")
    space = {"depth": {"int": (1, 3)}, "few": {"choice": (True, False)}, "columns": {"int": (2, len(names) - 1), "when": lambda p: p["few"]}, "leaves": {"derived": lambda p: 2 ** p["depth"]}}

    def score(params: dict, budget: int) -> float:
        own = names[: params.get("columns", len(names))]
        model = boosted.fit(fit_rows, own, "y_1", rounds=budget, depth=params["depth"], seed=SEED)
        return boosted.errors(model, held, "y_1", S.signed_square).first().mae

    out = search.table(spark, search.search(spark, space, score, 4, (1, 2)))
    return out.withColumn("score", F.round("score", 4))


@query("e17_seed_sweep")
def seed_sweep(spark, sf):
    """The first horizon trained with three seeds on the train rows, each scored on the test rows; mean and deviation over the seeds, and the best seed."""
    from .gold_queries import tabular

    t = scratch.stored(tabular(spark, sf), "tabular")
    names = [c for c in t.columns if c not in (*KEY, "snapshot_ts", "split", "y_1", "y_2", "y_3")]
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    runs = [(seed, boosted.errors(boosted.fit(train, names, "y_1", rounds=3, depth=3, seed=seed), test, "y_1", S.signed_square).first().mae) for seed in (1, 2, 3)]
    out = spark.createDataFrame(runs, "seed int, mae double")
    summary = out.agg(F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"), F.min("mae").alias("least"))
    return out.crossJoin(F.broadcast(summary)).select("seed", F.round("mae", 4).alias("mae"), F.round("mean_mae", 4).alias("mean_mae"), F.round("std_mae", 4).alias("std_mae"), (F.col("mae") == F.col("least")).alias("best"))  # one row
