"""Parameter search: drawn trials, weak ones stopped early, several fits at once in pools of the scheduler."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

TRIALS = "trial int, rung int, budget int, score double, state string, params map<string,string>"


def drawn(space: dict[str, dict], rng: np.random.Generator) -> dict:
    """One set of parameters, in the order of the space. A parameter is

    {"choice": [..]}, {"int": (low, high)}, {"float": (low, high)} with "log": True where it spans magnitudes, {"fixed": value} or
    {"derived": fn(params)}; with "when": fn(params) it exists only where that is true of those before it. Every parameter
    takes its draw whether it exists or not, so conditions don't shift the draws of others."""
    out = {}
    for name, spec in space.items():
        u = rng.random()
        if "when" in spec and not spec["when"](out):
            continue
        if "choice" in spec:
            value = spec["choice"][min(int(u * len(spec["choice"])), len(spec["choice"]) - 1)]
        elif "int" in spec:
            low, high = spec["int"]
            value = min(low + int(u * (high - low + 1)), high)
        elif "float" in spec:
            low, high = spec["float"]
            value = low * (high / low) ** u if spec.get("log") else low + u * (high - low)
        elif "fixed" in spec:
            value = spec["fixed"]
        elif "derived" in spec:
            value = spec["derived"](out)
        else:
            raise ValueError(f"parameter {name}: none of choice, int, float, fixed, derived")
        out[name] = value
    return out


def search(spark: SparkSession, space: dict[str, dict], score: Callable[[dict, int], float], trials: int, budgets: tuple[int, ...], keep: float = 0.5, seed: int = 42, at_once: int = 3) -> list[dict]:
    """Rows of ``TRIALS``. score(params, budget) is to be small; it fits a model with so many rounds.

    All trials run with the first budget, the best ``keep`` of them (at least one) with the next, and so on; the others are ``stopped``.
    Trials are drawn before any runs and ranked by score and number, so a rerun makes the same table, however the fits overlap.
    Each runs in a scheduler pool of its own slot; a fit that fails is ``failed`` and ranks last."""
    rng = np.random.default_rng(seed)
    params = [drawn(space, rng) for _ in range(trials)]
    alive, rows = list(range(trials)), []

    def run(slot: int, trial: int, budget: int) -> float:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trials-{slot}")
        try:
            value = float(score(params[trial], budget))
        except Exception:  # noqa: BLE001  parameters may be out of a model's bounds
            return math.inf
        return value if math.isfinite(value) else math.inf

    for rung, budget in enumerate(budgets):
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            jobs = [pool.submit(inheritable_thread_target(spark)(run), k % max(1, at_once), t, budget) for k, t in enumerate(alive)]
            scores = {t: j.result() for t, j in zip(alive, jobs, strict=True)}
        order = sorted(alive, key=lambda t: (scores[t], t))
        last = rung + 1 == len(budgets)
        left = [t for t in order[: max(1, math.ceil(keep * len(order)))] if scores[t] < math.inf] if not last else []
        for t in alive:
            state = "failed" if scores[t] == math.inf else "done" if last else "kept" if t in left else "stopped"
            rows.append({"trial": t, "rung": rung, "budget": budget, "score": None if state == "failed" else scores[t], "state": state, "params": {k: str(v) for k, v in params[t].items()}})
        alive = sorted(left)
        if not alive:
            break
    return rows


def table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The trials as a table, to be written beside the model."""
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in TRIALS.split(", ")) for r in rows], TRIALS)


def best(rows: list[dict]) -> dict:
    """The best row of the last rung that was run."""
    done = [r for r in rows if r["score"] is not None]
    last = max(r["rung"] for r in done)
    return min((r for r in done if r["rung"] == last), key=lambda r: (r["score"], r["trial"]))
