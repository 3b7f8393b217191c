"""Gradient-boosted trees on absolute error, one model for each horizon, and ablation of feature families."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import folder
from . import features

ROUNDS, DEPTH = 5, 3
#: Rounds between two checkpoints while trees are added: the lineage of the residuals stays short, and a lost executor costs no more than these.
CHECKPOINT = 10
#: Fits that run at once set one checkpoint folder.
_checkpoints = Lock()


def fit(rows: DataFrame, names: list[str], target: str, rounds: int = ROUNDS, depth: int = DEPTH, seed: int = 42, valid: str | None = None, tolerance: float = 0.01):
    """(model, assembler); rows without a target are masked: they weigh nothing.

    valid: a boolean column; rows where it is true are not learned from, and rounds end when the error on them gains less than ``tolerance``."""
    context = rows.sparkSession.sparkContext
    with _checkpoints:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder(rows.sparkSession))
    assembler = VectorAssembler(inputCols=names, outputCol="x")
    known = F.col(target).isNotNull() & ~F.isnan(target)
    held = [F.col(valid).alias("held")] if valid else []
    masked = assembler.transform(rows if not valid else rows.where(known | ~F.col(valid))).select("x", F.when(known, F.col(target)).otherwise(0.0).alias("y"), known.cast("double").alias("weight"), *held)
    trees = GBTRegressor(featuresCol="x", labelCol="y", weightCol="weight", lossType="absolute", maxIter=rounds, maxDepth=depth, seed=seed, cacheNodeIds=True, checkpointInterval=CHECKPOINT)
    if valid:
        trees = trees.setParams(validationIndicatorCol="held", validationTol=tolerance)
    return trees.fit(masked), assembler


def fit_all(rows: DataFrame, names: list[str], targets: list[str], at_once: int = 3, **how) -> dict[str, tuple]:
    """``fit`` for each target, several at once: a round is many short jobs, and the others' tasks fill the places that one leaves free."""
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        jobs = {y: pool.submit(inheritable_thread_target(rows.sparkSession)(fit), rows, names, y, **how) for y in targets}
        return {y: j.result() for y, j in jobs.items()}


def save(models: dict[str, tuple], path: str) -> None:
    """One folder for each target, in any store that Spark writes."""
    for target, (trees, assembler) in models.items():
        PipelineModel([assembler, trees]).write().overwrite().save(f"{path}/{target}")


def load(path: str, targets: list[str]) -> dict[str, tuple]:
    """What ``save`` wrote: (model, assembler) by target."""
    stages = {t: PipelineModel.load(f"{path}/{t}").stages for t in targets}
    return {t: (trees, assembler) for t, (assembler, trees) in stages.items()}


def predictions(models: dict[str, tuple], rows: DataFrame) -> DataFrame:
    """rows with ``predicted_<target>`` for each model."""
    out = rows
    for target, (trees, assembler) in models.items():
        out = trees.transform(assembler.transform(out)).withColumnRenamed("prediction", f"predicted_{target}").drop(assembler.getOutputCol())
    return out


def errors(model, rows: DataFrame, target: str, seconds=lambda c: c) -> DataFrame:
    """One row: n and mae over the rows with a target, after ``seconds`` turns target and prediction into seconds."""
    trees, assembler = model
    out = trees.transform(assembler.transform(rows.where(F.col(target).isNotNull() & ~F.isnan(target))))
    miss: Column = F.abs(seconds(F.col("prediction")) - seconds(F.col(target)))
    return out.agg(F.count("*").alias("n"), F.avg(miss).alias("mae"))


def ablation(train: DataFrame, test: DataFrame, names: list[str], target: str, always: tuple[str, ...] = (), seconds=lambda c: c, **how) -> list[tuple]:
    """(family, columns, mae without them, change against all columns) of each family that has columns; first ('all', ...).

    Each family's columns are left out and a model is trained anew; the columns in ``always`` belong to no family."""
    by = {f: c for f, c in features.families([c for c in names if c not in always]).items() if c}
    out, base = [], None
    for family, gone in [("all", []), *by.items()]:
        model = fit(train, [c for c in names if c not in gone], target, **how)
        mae = errors(model, test, target, seconds).first().mae
        base = mae if family == "all" else base
        out.append((family, len(gone), mae, None if mae is None or base is None else mae - base))
    return out
