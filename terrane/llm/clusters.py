"""Similarity clusters by reciprocal-nearest-neighbour average linkage on a sparse graph.

Records are points of scaled fields; two are alike if the root mean square of their differences is at most a threshold.
All records in one grid cell of side CELL are alike, so cells (with their count, sum and sum of squares) are the first
clusters and no pair inside a dense group is ever formed. Edges join cells that can hold alike records. Each round merges
every mutual best pair at once. Linkage is the mean of squared differences over all pairs of two clusters, which follows
exactly from their sums; as it is reducible, merging all mutual pairs gives what merging one by one would.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.session import discard, small, written

ALIKE = 0.10
CELL = 0.05
#: Points of a cell compared at once in the closing check.
CHUNK = 1024
#: Edges up to which the remaining rounds run in one task (about 100 MB there); above it each round is distributed.
FINISH = 1_000_000
#: Linkages are compared as multiples of this, so that rounding can't decide between equal ones.
GRAIN = 1e-12


def _add(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def records(df: DataFrame, id_column: str, fields: dict[str, tuple[float, float]]) -> DataFrame:
    """Distinct (id, x0..) of the rows with an id and all fields present and within lo..hi, scaled to 0..1."""
    keep = F.col(id_column).isNotNull()
    for f, (lo, hi) in fields.items():
        x = F.col(f).cast("double")
        keep = keep & x.isNotNull() & ~F.isnan(x) & (x >= lo) & (x <= hi)
    scaled = [((F.col(f).cast("double") - lo) / (hi - lo)).alias(f"x{i}") for i, (f, (lo, hi)) in enumerate(fields.items())]
    return df.filter(keep).select(F.col(id_column).alias("id"), *scaled).distinct()


def _packed(columns: list[Column], base: int) -> Column:
    """Small whole numbers as one long."""
    out = columns[0].cast("long")
    for c in columns[1:]:
        out = out * base + c
    return out


def _cells(points: DataFrame, d: int) -> DataFrame:
    """Points with the coordinates of their cell and one number that names it."""
    base = int(1 / CELL) + 2
    if base**d >= 1 << 62:
        raise ValueError(f"{d} fields are too many for cells of side {CELL}")
    at = [F.floor(F.col(f"x{i}") / CELL).cast("int").alias(f"c{i}") for i in range(d)]
    return points.select("*", *at).withColumn("cell", _packed([F.col(f"c{i}") for i in range(d)], base))


def _edges(cells: DataFrame, d: int, alike: float) -> DataFrame:
    """(a, b), a < b: cells whose bounding boxes come within reach. A cell goes to the 2**d coarse cells around it."""
    reach = int(np.ceil(alike * np.sqrt(d) / CELL)) + 1  # a single field may differ by alike * sqrt(d)
    wide = 2 * reach
    coarse = [F.floor(F.col(f"c{i}") / wide) for i in range(d)]
    near = [F.when(F.pmod(F.col(f"c{i}"), F.lit(wide)) < reach, coarse[i] - 1).otherwise(coarse[i] + 1) for i in range(d)]
    keys = F.array(*[_packed([c + 1 for c in pick], int(1 / CELL) + 4) for pick in itertools.product(*zip(coarse, near))])
    box = [f"{side}{i}" for i in range(d) for side in ("lo", "hi")]
    a = cells.select(F.col("cell").alias("a"), *[F.col(c).alias(f"a_{c}") for c in box], F.explode(keys).alias("key"))
    b = cells.select(F.col("cell").alias("b"), *[F.col(c).alias(f"b_{c}") for c in box], _packed([c + 1 for c in coarse], int(1 / CELL) + 4).alias("key"))
    gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")) for i in range(d)]
    near_enough = _add([g * g for g in gaps]) / d <= alike * alike * (1 + 1e-9)
    pairs = a.join(b, "key").filter((F.col("a") != F.col("b")) & near_enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linkage(d: int) -> Column:
    """Mean over all pairs of two clusters, and over the fields, of the squared difference."""
    def mean(side: str, i: int) -> Column:
        return F.col(f"{side}_s{i}") / F.col(f"{side}_n")

    def spread(side: str) -> Column:
        return F.col(f"{side}_q") / F.col(f"{side}_n") - _add([mean(side, i) * mean(side, i) for i in range(d)])

    apart = _add([(mean("a", i) - mean("b", i)) * (mean("a", i) - mean("b", i)) for i in range(d)])
    return (apart + spread("a") + spread("b")) / d


def _round(n, sums, q, a, b, limit: int):
    """One round on arrays: linkages of the edges within the limit, and those that are the best of both their ends."""
    mean = sums / n[:, None]
    spread = q / n - (mean * mean).sum(1)
    apart = ((mean[a] - mean[b]) ** 2).sum(1) + spread[a] + spread[b]
    d = np.floor(apart / sums.shape[1] / GRAIN).astype(np.int64)
    near = d <= limit
    a, b, d = a[near], b[near], d[near]
    rank = np.empty(len(d), np.int64)
    rank[np.lexsort((b, a, d))] = np.arange(len(d))
    best = np.full(len(n), len(d))
    np.minimum.at(best, a, rank)
    np.minimum.at(best, b, rank)
    return a, b, (best[a] == rank) & (best[b] == rank)


def merge_all(ids, n, sums, q, a, b, limit: int) -> np.ndarray:
    """Cluster (an id) of each node after all rounds; ``a``, ``b`` index the nodes, which are in the order of their ids."""
    n, sums, q = n.copy(), sums.copy(), q.copy()
    label = np.arange(len(ids))
    while len(a):
        a, b, mutual = _round(n, sums, q, a, b, limit)
        if not mutual.any():
            break
        keep, gone = a[mutual], b[mutual]
        to = np.arange(len(ids))
        to[gone] = keep
        for x in (n, sums, q):
            x[keep] += x[gone]  # no node is in two mutual pairs
        label = to[label]
        ends = np.sort(np.stack([to[a], to[b]], 1), 1)
        ends = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
        a, b = ends[:, 0], ends[:, 1]
    return ids[label]


def _finish(d: int, limit: int):
    def run(state: pa.Table, edges: pa.Table) -> pa.Table:
        state = state.sort_by("cluster")
        ids = state.column("cluster").to_numpy()
        sums = np.stack([state.column(f"s{i}").to_numpy() for i in range(d)], 1)
        a, b = (np.searchsorted(ids, edges.column(c).to_numpy()) for c in ("a", "b"))
        return pa.table({"cluster": ids, "to": merge_all(ids, state.column("n").to_numpy(), sums, state.column("q").to_numpy(), a, b, limit)})

    return run


def _merged(state: DataFrame, edges: DataFrame, labels: DataFrame, d: int, alike: float) -> DataFrame:
    """Labels (cell, cluster) after rounds of merging mutual best pairs until no linkage is within the threshold.

    Rounds end: each merges at least the nearest pair of all. An edge beyond the threshold can go: the linkage of merged
    clusters is a mean of their parts' linkages, so it gets within the threshold only over a part that is.
    """
    stats = ["n", *[f"s{i}" for i in range(d)], "q"]
    limit = int(alike * alike * (1 + 1e-9) / GRAIN)
    grains = F.floor(_linkage(d) / GRAIN)
    while True:
        if edges.count() <= FINISH:
            touched = edges.select(F.explode(F.array("a", "b")).alias("cluster")).distinct()
            nodes = state.join(touched, "cluster", "left_semi").withColumn("one", F.lit(1))
            to = nodes.groupBy("one").cogroup(edges.withColumn("one", F.lit(1)).groupBy("one")).applyInArrow(_finish(d, limit), "cluster long, to long")
            to = written(to.filter("cluster <> to"), "to")
            return written(labels.join(small(to, 16), "cluster", "left").select("cell", F.coalesce("to", "cluster").alias("cluster")), "labels")
        linked = edges.join(state.select(F.col("cluster").alias("a"), *[F.col(c).alias(f"a_{c}") for c in stats]), "a").join(
            state.select(F.col("cluster").alias("b"), *[F.col(c).alias(f"b_{c}") for c in stats]), "b"
        ).select("a", "b", grains.alias("d")).filter(F.col("d") <= limit)
        linked = written(linked, "linked")
        best = linked.select(F.explode(F.array("a", "b")).alias("node"), F.struct("d", "a", "b").alias("e")).groupBy("node").agg(F.min("e").alias("e"))
        mutual = best.groupBy("e.a", "e.b").count().filter("count = 2").select(F.col("b").alias("cluster"), F.col("a").alias("to"))
        mutual = written(mutual, "mutual")
        n = mutual.count()
        if not n:
            return labels
        to = small(mutual, 16, n)
        state = written(state.join(to, "cluster", "left").groupBy(F.coalesce("to", "cluster").alias("cluster")).agg(
            *[F.sum(c).alias(c) for c in stats]), "state")
        a = small(mutual.select(F.col("cluster").alias("a"), F.col("to").alias("to_a")), 16, n)
        b = small(mutual.select(F.col("cluster").alias("b"), F.col("to").alias("to_b")), 16, n)
        ends = linked.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        edges = written(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        labels = written(labels.join(to, "cluster", "left").select("cell", F.coalesce("to", "cluster").alias("cluster")), "labels")
        discard(linked)


def _alike_blocks(d: int, alike: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for k in range(batch.num_rows):
                x, y = (np.asarray(batch.column(c)[k].values.flatten(), float).reshape(-1, d) for c in (2, 3))
                if any((((x[s : s + 64, None] - y[None]) ** 2).mean(-1) <= alike * alike).any() for s in range(0, len(x), 64)):
                    hits.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _closed(labels: DataFrame, edges: DataFrame, points: DataFrame, d: int, alike: float) -> DataFrame:
    """Labels in which clusters that hold a pair of alike records across them are one: the exact groups of alikeness."""
    la = labels.select(F.col("cell").alias("a"), F.col("cluster").alias("ca"))
    lb = labels.select(F.col("cell").alias("b"), F.col("cluster").alias("cb"))
    open_ = written(edges.join(la, "a").join(lb, "b").filter("ca <> cb"), "open")
    if open_.isEmpty():
        return labels
    wanted = open_.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
    x = F.array(*[f"x{i}" for i in range(d)])
    near = points.join(wanted, "cell", "left_semi").select("cell", x.alias("x")).distinct()
    sizes = near.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    chunks = written(near.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("x"), F.col("parts")).alias("chunk")).agg(
        F.collect_list("x").alias("xs")), "chunks")
    both = open_.join(chunks.select(F.col("cell").alias("a"), F.col("xs").alias("xa")), "a").join(
        chunks.select(F.col("cell").alias("b"), F.col("xs").alias("xb")), "b").select("ca", "cb", "xa", "xb")
    links = written(both.mapInArrow(_alike_blocks(d, alike), "a long, b long").distinct(), "links")
    if links.isEmpty():
        return labels
    found = _joined_up(links)
    return written(labels.join(small(found, 16), "cluster", "left").select("cell", F.coalesce("least", "cluster").alias("cluster")), "labels")


def _components(links: pa.Table) -> pa.Table:
    """(cluster, least): the least node of each node's component."""
    a, b = (links.column(c).to_numpy() for c in ("a", "b"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == least).all():
            return pa.table({"cluster": ids, "least": ids[least]})
        least = new


def _joined_up(links: DataFrame) -> DataFrame:
    """(cluster, least) of every cluster in a link; in one task up to FINISH links, above it by passing the least label on."""
    if links.count() <= FINISH:
        return written(links.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(lambda t: _components(t), "cluster long, least long"), "least")
    both_ways = links.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))
    least = written(both_ways.select(F.col("x").alias("node"), F.col("x").alias("least")).distinct(), "least")
    while True:  # labels only fall, and halve their distance to the least one each round
        heard = both_ways.join(least.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("least").alias("heard"))
        step = least.join(heard, least["node"] == heard["x"]).select("node", F.least("least", "heard").alias("near"))
        hop = least.select(F.col("node").alias("near"), F.col("least").alias("far"))
        new = written(step.join(hop, "near").select("node", F.least("near", "far").alias("least")), "least")
        if new.join(least.withColumnRenamed("least", "old"), "node").filter("least <> old").isEmpty():
            return new.select(F.col("node").alias("cluster"), "least")
        discard(least)
        least = new


def grouped(df: DataFrame, id_column: str, fields: dict[str, tuple[float, float]], alike: float = ALIKE, closed: bool = True) -> DataFrame:
    """(id, x0.., cluster) of each record: its group by average linkage of the grid cells.

    ``closed``: groups that hold a pair of alike records across them are then joined, which makes them the connected
    groups of alikeness that problem 4 defines; without it the linkage alone decides.
    Rows without an id or with a field that is null, NaN or off its scale have no group; repeated rows count once.
    """
    if CELL > alike:
        raise ValueError("records of a cell must be alike")
    d = len(fields)
    points = written(_cells(records(df, id_column, fields), d), "points")
    xs = [f"x{i}" for i in range(d)]
    cells = written(points.groupBy("cell", *[f"c{i}" for i in range(d)]).agg(
        F.count("*").cast("double").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)],
        F.sum(_add([F.col(x) * F.col(x) for x in xs])).alias("q"),
        *[f(x).alias(f"{side}{i}") for i, x in enumerate(xs) for side, f in (("lo", F.min), ("hi", F.max))],
    ), "cells")
    edges = written(_edges(cells, d, alike), "edges")
    state = cells.select(F.col("cell").alias("cluster"), "n", *[f"s{i}" for i in range(d)], "q")
    labels = _merged(state, edges, cells.select("cell", F.col("cell").alias("cluster")), d, alike)
    labels = _closed(labels, edges, points, d, alike) if closed else labels
    return points.join(small(labels, 16), "cell").select("id", *xs, "cluster")


def members(groups: DataFrame) -> DataFrame:
    """(id, first_id) of each record in a group of two or more ids; first_id is the group's least id."""
    first = groups.groupBy("cluster").agg(F.min("id").alias("first_id"), F.max("id").alias("last")).filter("first_id < last")
    return groups.join(small(written(first, "first"), 96), "cluster").select("id", "first_id").distinct()


def described(groups: DataFrame, typical: int = 3) -> DataFrame:
    """(first_id, n_ids, typical): each group's size and the ids nearest to its mean (ties by id)."""
    xs = [c for c in groups.columns if c.startswith("x")]
    centre = groups.groupBy("cluster").agg(
        F.min("id").alias("first_id"), F.countDistinct("id").alias("n_ids"), *[F.avg(x).alias(f"m_{x}") for x in xs]
    )
    centre = written(centre, "centres")
    off = _add([(F.col(x) - F.col(f"m_{x}")) * (F.col(x) - F.col(f"m_{x}")) for x in xs])
    near = groups.join(small(centre, 160), "cluster").groupBy("cluster", "first_id", "n_ids", "id").agg(F.round(F.min(off), 12).alias("off"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("off", "id"))).filter(F.col("rank") <= typical)
    return ranked.groupBy("cluster", "first_id", "n_ids").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("typical")
    ).drop("cluster")
