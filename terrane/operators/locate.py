"""Posterior over a grid of places for a feature vector: grid, attachment weights, kernel prediction, prior, credible sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.geo import RADIUS_KM, haversine_km
from terrane.session import small, written

#: Fixed values of the model.
CELLS, LEAST_STEP, ATTACH_FLOOR_KM = 5000, 0.08, 8.0
SIGMA2, TAU2, LEAST_VARIANCE = 0.8, 0.05, 1e-4
PRIOR_WEIGHT, PRIOR_KM, PRIOR_PEOPLE = 0.30, 90.0, 1000.0
LEVELS = (0.5, 0.8, 0.95)
#: Nodes of one dense kernel at most.
NODES = 4096


def boxes(areas: DataFrame) -> DataFrame:
    """(area, x0, x1, y0, y1): bounding box of each area's rings."""
    p = F.flatten("land")
    side = lambda f, axis: f(F.transform(p, lambda q: q[axis]))
    return areas.select(F.col("id").alias("area"), side(F.array_min, "x").alias("x0"), side(F.array_max, "x").alias("x1"),
                        side(F.array_min, "y").alias("y0"), side(F.array_max, "y").alias("y1"))


def grid(areas: DataFrame, cells: int = CELLS) -> DataFrame:
    """(area, i, j, lon, lat): cell corners over the areas' boxes with one shared step, about ``cells`` in all."""
    b = boxes(areas)
    span = b.agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("span"))
    step = F.greatest(F.sqrt(F.col("span") / cells), F.lit(LEAST_STEP)).alias("step")
    g = b.join(F.broadcast(span.select(step)), F.lit(True))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("x1") - F.col("x0")) / F.col("step")).cast("int"))))
    g = g.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("y1") - F.col("y0")) / F.col("step")).cast("int"))))
    return g.select("area", "i", "j", (F.col("x0") + F.col("i") * F.col("step")).alias("lon"), (F.col("y0") + F.col("j") * F.col("step")).alias("lat"))


def attach(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """(area, i, j, id, w): each cell's weights on all nodes (id, nlon, nlat, population), summing to one.

    The grid is a stated set of a bounded number of cells, met by every node.
    """
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("nlon"), F.col("nlat"))
    pull = F.sqrt(F.col("population").cast("double")) / F.pow(F.greatest(km, F.lit(ATTACH_FLOOR_KM)), 2)
    met = cells.join(small(nodes, 64), F.lit(True)).withColumn("km", km).withColumn("pull", pull)
    return met.withColumn("w", F.col("pull") / F.sum("pull").over(Window.partitionBy("area", "i", "j"))).drop("pull")


def prior(attached: DataFrame) -> DataFrame:
    """(area, i, j, prior): log of people around each cell, by a Gaussian of PRIOR_KM."""
    near = F.col("population") * F.exp(-0.5 * F.pow(F.col("km") / PRIOR_KM, 2))
    return attached.groupBy("area", "i", "j").agg(F.log(PRIOR_PEOPLE + F.sum(near)).alias("prior"))


def cell_statistics(attached: DataFrame, values: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """((area, i, j, key, mu), (area, i, j, prior)) from one pass over the attachments: weighted means of the nodes' present
    values (id, key, value), and the population prior."""
    wide = values.groupBy("id").pivot("key", keys).agg(F.first("value"))
    near = F.col("population") * F.exp(-0.5 * F.pow(F.col("km") / PRIOR_KM, 2))
    sums = attached.join(small(wide, 16 + 8 * len(keys)), "id", "left").groupBy("area", "i", "j").agg(
        *[(F.sum(F.col("w") * F.col(k)) / F.sum(F.when(F.col(k).isNotNull(), F.col("w")))).alias(k) for k in keys],
        F.log(PRIOR_PEOPLE + F.sum(near)).alias("prior"))
    sums = written(sums, "cells")
    means = sums.unpivot(["area", "i", "j"], keys, "key", "mu").filter("mu IS NOT NULL")
    return means, sums.select("area", "i", "j", "prior")


def log_likelihood(means: DataFrame, probe: DataFrame, variance: Column) -> DataFrame:
    """(area, i, j, loglik) of a probe (key, x, reliability, nugget); x is clamped to -0.5..1.5."""
    v = variance + F.col("nugget")
    x = F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("x")))
    term = F.col("reliability") * (-0.5 * F.pow(x - F.col("mu"), 2) / v - 0.5 * F.log(v))
    used = means.join(small(probe.filter("reliability > 0.02"), 64), "key")
    return used.groupBy("area", "i", "j").agg(F.sum(F.coalesce(term, F.lit(0.0))).alias("loglik"))


def posterior(cells: DataFrame, loglik: DataFrame, priors: DataFrame) -> DataFrame:
    """(area, i, j, lon, lat, p): softmax of log likelihood, weighted prior and cell size, without a global sort."""
    z = F.col("loglik") + PRIOR_WEIGHT * F.col("prior") + F.log(F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)))
    all_ = cells.join(loglik, ["area", "i", "j"]).join(priors, ["area", "i", "j"]).withColumn("z", z)
    top = all_.agg(F.max("z").alias("top"))
    e = all_.join(F.broadcast(top), F.lit(True)).withColumn("e", F.exp(F.col("z") - F.col("top")))
    total = e.agg(F.sum("e").alias("total"))
    return e.join(F.broadcast(total), F.lit(True)).select("area", "i", "j", "lon", "lat", (F.col("e") / F.col("total")).alias("p"))


def credible_sets(post: DataFrame) -> DataFrame:
    """The posterior with ``level``: the smallest credible set that holds each cell, null outside the largest.

    A set takes cells by falling p until its level is reached, the cell that reaches it included. Cells are cumulated
    within bands of like p, which are cumulated among each other, so no task sorts all cells.
    """
    band = F.when(F.col("p") > 0, F.floor(-F.log("p") * 8)).otherwise(F.lit(1 << 20)).cast("int")
    banded = post.withColumn("band", band)
    sums = banded.groupBy("band").agg(F.sum("p").alias("sum"))  # at most 8 * 745 bands
    lower = sums.withColumn("base", F.coalesce(F.sum("sum").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("band", "base")
    w = Window.partitionBy("band").orderBy(F.desc("p"), "area", "i", "j").rowsBetween(Window.unboundedPreceding, -1)
    post = banded.join(F.broadcast(lower), "band")
    before = F.col("base") + F.coalesce(F.sum("p").over(w), F.lit(0.0))
    level = F.lit(None).cast("double")
    for x in reversed(LEVELS):
        level = F.when(F.col("before") < x, x).otherwise(level)
    return post.withColumn("before", F.round(before, 12)).withColumn("level", level).drop("before", "base", "band")


def estimate(post: DataFrame) -> DataFrame:
    """(map_lon, map_lat, mean_lon, mean_lat, spread_km): mode, mean and root mean square distance from the mode."""
    best = post.agg(F.max_by(F.struct("lon", "lat"), F.struct(F.col("p"), -F.col("lon"), -F.col("lat"))).alias("m"),
                    F.sum(F.col("p") * F.col("lon")).alias("mean_lon"), F.sum(F.col("p") * F.col("lat")).alias("mean_lat"))
    off = post.join(F.broadcast(best), F.lit(True)).withColumn("km", haversine_km(F.col("lon"), F.col("lat"), F.col("m.lon"), F.col("m.lat")))
    return off.groupBy(F.col("m.lon").alias("map_lon"), F.col("m.lat").alias("map_lat"), "mean_lon", "mean_lat").agg(
        F.sqrt(F.sum(F.col("p") * F.col("km") ** 2)).alias("spread_km"))


def laplacian_kernel(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(K, A) of symmetric weights: K = (I + s2 L)^-1 of the graph Laplacian of W / max(W), A = (K + t2 I)^-1."""
    w = weights / weights.max() if weights.size and weights.max() > 0 else weights
    k = np.linalg.inv(np.eye(len(w)) + SIGMA2 * (np.diag(w.sum(1)) - w))
    return k, np.linalg.inv(k + TAU2 * np.eye(len(w)))


def _pairwise_km(lon: np.ndarray, lat: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat)[:, None], np.radians(lat2)[None]
    h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon[:, None] - lon2[None]) / 2) ** 2
    return 2 * RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1, h)))


def predict_group(nodes: pa.Table, cells: pa.Table, keys: list[str]) -> dict:
    """Kernel mean per cell and key and one variance per cell for the nodes of one group.

    The mean is the ratio of smoothed values to smoothed presence, undefined where the latter nearly vanishes.
    """
    lon, lat, pop = (nodes.column(c).to_numpy().astype(float) for c in ("nlon", "nlat", "population"))
    if len(lon) > NODES:
        raise ValueError(f"a kernel has at most {NODES} nodes")
    km = np.maximum(_pairwise_km(lon, lat, lon, lat), 5.0)
    w = np.sqrt(pop[:, None] * pop[None]) / km**2
    np.fill_diagonal(w, 0.0)
    k, a = laplacian_kernel(w)
    clon, clat = cells.column("lon").to_numpy(), cells.column("lat").to_numpy()
    q = np.sqrt(pop)[None] / np.maximum(_pairwise_km(clon, clat, lon, lat), ATTACH_FLOOR_KM) ** 2
    kq = q / q.sum(1, keepdims=True) @ k
    v = np.stack([nodes.column(c).to_numpy(zero_copy_only=False).astype(float) for c in keys], 1)
    there = ~np.isnan(v)
    top, bottom = kq @ a @ np.where(there, v, 0.0), kq @ a @ there.astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        mu = np.where(np.abs(bottom) < 1e-6, np.nan, top / bottom)
    var = np.maximum(1 - ((kq @ a) * kq).sum(1), LEAST_VARIANCE)
    return {"mu": mu, "var": var, "kernel": k, "weights": q / q.sum(1, keepdims=True)}


def kernel_means(nodes: DataFrame, cells: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(group, area, i, j, key, mu, variance): kernel prediction of every group's nodes at every cell, a task per group.

    ``nodes``: group, id, nlon, nlat, population and one nullable column per key. The grid goes to each group.
    """
    wide = nodes.select(F.col(group).alias("grp"), "id", "nlon", "nlat", F.col("population").cast("double").alias("population"), *keys)
    asked = cells.join(F.broadcast(wide.select(F.col("grp").alias("asked")).distinct()), F.lit(True))

    def run(left, right):
        left = left.sort_by("id")
        got = predict_group(left, right, keys)
        n = right.num_rows
        at = {c: right.column(c).to_numpy(zero_copy_only=False).repeat(len(keys)) for c in ("asked", "area", "i", "j")}
        at["grp"] = at.pop("asked")
        return pa.table({**at, "key": np.tile(np.array(keys, object), n), "mu": pa.array(got["mu"].ravel(), from_pandas=True), "variance": got["var"].repeat(len(keys))},
                        schema=pa.schema([("grp", pa.string()), ("area", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("key", pa.string()), ("mu", pa.float64()), ("variance", pa.float64())]))

    out = wide.groupBy("grp").cogroup(asked.groupBy("asked")).applyInArrow(run, "grp string, area string, i int, j int, key string, mu double, variance double")
    return out.withColumnRenamed("grp", group)


def medoids(distance: np.ndarray, k: int, rounds: int = 40) -> np.ndarray:
    """Cluster of each record: k medoids seeded far apart, reassigned until they stand still. An empty cluster keeps its
    medoid; with at most k records each is its own."""
    n = len(distance)
    if n <= k:
        return np.arange(n)
    seeds = [int(distance.sum(1).argmax())]
    while len(seeds) < k:
        seeds.append(int(distance[:, seeds].min(1).argmax()))
    centre = np.array(seeds)
    for _ in range(rounds):
        label = distance[:, centre].argmin(1)
        new = centre.copy()
        for c in range(k):
            own = np.nonzero(label == c)[0]
            if len(own):
                new[c] = own[distance[np.ix_(own, own)].sum(1).argmin()]
        if (new == centre).all():
            break
        centre = new
    return distance[:, centre].argmin(1)


def cluster_groups(vectors: DataFrame, group: str, keys: list[str], k: int) -> DataFrame:
    """(group, id, cluster): k-medoids within each group by RMS difference over shared features, a task per group."""
    def run(t):
        t = t.sort_by("id")
        if t.num_rows > NODES:
            raise ValueError(f"a clustered group has at most {NODES} records")
        v = np.stack([t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in keys], 1)
        d = v[:, None] - v[None]
        both = ~np.isnan(d)
        rms = np.sqrt(np.where(both, d, 0.0).__pow__(2).sum(-1) / np.maximum(both.sum(-1), 1))
        return pa.table({"grp": t.column("grp"), "id": t.column("id"), "cluster": pa.array(medoids(rms, k), pa.int32())})

    wide = vectors.select(F.col(group).cast("string").alias("grp"), F.col("id").cast("string").alias("id"), *[F.col(c).cast("double").alias(c) for c in keys])
    return wide.groupBy("grp").applyInArrow(run, "grp string, id string, cluster int").withColumnRenamed("grp", group)


MAX_KM = math.pi * RADIUS_KM
