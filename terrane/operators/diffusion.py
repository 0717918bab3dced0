"""Adoption spreading over the interaction graph, and what can be read off it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.operators.gravity import effective_km

#: Regimes of spread: exponents alpha and gamma, and the pull of prestige (fixed values).
REGIMES = {"wave": (0.0, 2.0, 0.0), "contagion": (0.0, 3.5, 0.0), "hierarchical": (0.5, 2.0, 0.6), "contra": (0.5, 2.0, -0.6)}
#: Defaults: steps, rate, contact, resistance, identity (fixed values).
STEPS, RATE, CONTACT, RESISTANCE, IDENTITY = 24, 0.55, 3.2, 0.9, 0.0
START, ORIGIN, CLIP = 1e-4, 0.97, 30.0


def spread_weights(edges: DataFrame, regime: str) -> DataFrame:
    """(x, y, w): row-normalised influence of y on x, both ways of each edge (a, b, ap, bp, km, resistance, corridor)."""
    alpha, gamma, _ = REGIMES[regime]
    km = F.greatest(effective_km(F.col("km"), F.col("resistance"), F.col("corridor")), F.lit(5.0))
    pull = F.pow(F.col("ap"), F.lit(alpha)) * F.pow(F.col("bp"), F.lit(alpha)) / F.pow(km, F.lit(gamma))
    both = edges.withColumn("pull", pull).select(F.inline(F.array(
        F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "pull"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "pull"))))
    return both.select("x", "y", (F.col("pull") / F.sum("pull").over(Window.partitionBy("x"))).alias("w"))


def step(x, z, theta, w, prestige, rate, contact, identity):
    """One step of (adoption, logit, threshold)."""
    met = w @ x
    z = z + rate * (contact * met + prestige - theta)
    new = 1 / (1 + np.exp(-np.clip(z, -CLIP, CLIP)))
    return new, z, theta + identity * np.maximum(met - new, 0.0)


def simulate(nodes: DataFrame, weights: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, t, id, adoption): every run's panel, a task per run.

    ``nodes`` (id, population); ``weights`` (regime, x, y, w); ``runs`` (run, regime, origin, steps, rate, contact,
    resistance, identity). A run is sequential in t and as wide as the graph, so runs are what is distributed.
    """
    graph = weights.groupBy("regime").agg(F.collect_list(F.struct("x", "y", "w")).alias("edges"))
    people = nodes.agg(F.array_sort(F.collect_list(F.struct("id", F.col("population").cast("double").alias("population")))).alias("nodes"))
    jobs = runs.join(graph, "regime").join(F.broadcast(people), F.lit(True))

    def go(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = [n["id"] for n in r["nodes"]]
                at = {k: i for i, k in enumerate(ids)}
                if r["origin"] not in at:
                    raise ValueError(f"origin {r['origin']} isn't in the graph")
                w = np.zeros((len(ids), len(ids)))
                for e in r["edges"]:
                    if e["x"] in at and e["y"] in at:
                        w[at[e["x"]], at[e["y"]]] = e["w"]
                size = np.log(np.array([n["population"] for n in r["nodes"]]))
                prestige = REGIMES[r["regime"]][2] * (size - size.mean()) / max(size.std(), 1e-9)
                x = np.full(len(ids), START)
                x[at[r["origin"]]] = ORIGIN
                z, theta = np.log(x / (1 - x)), np.full(len(ids), r["resistance"])
                panel = [x]
                for _ in range(r["steps"]):
                    x, z, theta = step(x, z, theta, w, prestige, r["rate"], r["contact"], r["identity"])
                    panel.append(x)
                n = len(panel) * len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["run"]] * n), pa.array(np.repeat(np.arange(len(panel)), len(ids)), pa.int32()), pa.array(ids * len(panel)), pa.array(np.concatenate(panel))],
                    ["run", "t", "id", "adoption"])

    return jobs.repartition("run").mapInArrow(go, "run string, t int, id string, adoption double")


def adoption_order(panel: DataFrame, nodes: DataFrame, level: float = 0.5) -> DataFrame:
    """(run, id, first_t, rank): when each node first reaches the level; never comes last, then larger places first."""
    first = panel.groupBy("run", "id").agg(F.min(F.when(F.col("adoption") >= level, F.col("t"))).alias("first_t"))
    w = Window.partitionBy("run").orderBy(F.col("first_t").asc_nulls_last(), F.desc("population"), "id")
    return first.join(nodes.select("id", "population"), "id").withColumn("rank", F.row_number().over(w)).select("run", "id", "first_t", "rank")


def shares(panel: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run, t, share): population-weighted mean adoption."""
    p = panel.join(nodes.select("id", "population"), "id")
    return p.groupBy("run", "t").agg((F.sum(F.col("adoption") * F.col("population")) / F.nullif(F.sum("population"), F.lit(0))).alias("share"))


def signature(order: DataFrame, nodes: DataFrame, distances: DataFrame) -> DataFrame:
    """(run, n, by_distance, by_size): correlation of first adoption with distance from the origin and log population.

    Null under five adopters or without variation. ``distances`` (run, id, km).
    """
    j = order.filter("first_t IS NOT NULL").join(nodes.select("id", "population"), "id").join(distances, ["run", "id"])
    t, size = F.col("first_t").cast("double"), F.log(F.col("population").cast("double"))

    def guarded(x):
        return F.when((F.count("*") >= 5) & (F.stddev_pop(t) >= 1e-9) & (F.stddev_pop(x) >= 1e-9), F.corr(t, x))

    return j.groupBy("run").agg(F.count("*").alias("n"), guarded(F.col("km")).alias("by_distance"), guarded(size).alias("by_size"))
