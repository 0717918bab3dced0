"""Boundary, region and wavefront layers from one table of Voronoi edges.

An edge lies between the cells of two places on land (or a place and the coast). A boundary of any two-way split of the
places is then the edges whose sides differ: a join and a filter, without union or intersection of polygons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions import geometry
from terrane.functions.geo import haversine_km, in_rings
from terrane.operators.locate import boxes

#: Margin of an area's box in degrees, reach of a bundle in km.
MARGIN, BUNDLE_KM = 0.5, 35.0
_EDGE = "area string, lhs string, rhs string, x1 double, y1 double, x2 double, y2 double"


def _rings(column) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in r], float) for r in column]


def voronoi_edges(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Edges (area, lhs, rhs, x1..y2) of the cells of the places (id, lon, lat) in each area's box, cut to its land.

    lhs < rhs; rhs is null on the coast. A place in several boxes belongs
    to the area whose land holds it, else to the first by id; one in no box has no cell. One task per area,
    with the places of that area.
    """
    box = boxes(areas)
    inside = F.col("lon").between(F.col("x0") - MARGIN, F.col("x1") + MARGIN) & F.col("lat").between(F.col("y0") - MARGIN, F.col("y1") + MARGIN)
    lands = areas.select(F.col("id").alias("area"), "land")
    met = points.select("id", "lon", "lat").join(F.broadcast(box.join(lands, "area")), inside)
    off = F.when(in_rings(F.col("lon"), F.col("lat"), F.col("land")), 0).otherwise(1)
    owned = met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(off, "area"))).filter("rank = 1").select("area", "id", "lon", "lat")

    def run(left, right):
        out = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            ids = left.column("id").to_pylist()
            p = np.stack([left.column(c).to_numpy() for c in ("lon", "lat")], 1)
            rings = _rings(right.column("land")[0].as_py())
            every = np.vstack([*rings, p])
            (x0, y0), (x1, y1) = every.min(0) - 1, every.max(0) + 1
            area = right.column("area")[0].as_py()
            for i, (poly, labels) in enumerate(geometry.voronoi(p, (x0, x1, y0, y1))):
                for k, other in enumerate(labels):
                    if other > i:
                        for a, b in geometry.clip_to_rings(poly[k], poly[(k + 1) % len(poly)], rings):
                            out.append((area, ids[i], ids[other], *a, *b))
                if len(poly):
                    for r in rings:
                        for a, b in zip(r[:-1], r[1:]):
                            if part := geometry.clip_to_convex(a, b, poly):
                                out.append((area, ids[i], None, *part[0], *part[1]))
        cols = list(zip(*out)) if out else [[]] * 7
        return pa.Table.from_arrays([pa.array(list(map(str, c)) if k == 0 else list(c), pa.string() if k < 3 else pa.float64()) for k, c in enumerate(cols)],
                                    ["area", "lhs", "rhs", "x1", "y1", "x2", "y2"])

    return owned.groupBy("area").cogroup(lands.groupBy("area")).applyInArrow(run, _EDGE)


def edge_km() -> Column:
    return haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))


def boundaries(edges: DataFrame, sides: DataFrame, keys: list[str]) -> DataFrame:
    """The inner edges whose two places differ in ``side``, per key. ``sides``: (*keys, id, side)."""
    a = sides.select(*keys, F.col("id").alias("lhs"), F.col("side").alias("lside"))
    b = sides.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("id").alias("rhs"), F.col("side").alias("rside"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    inner = edges.filter("rhs IS NOT NULL").join(a, "lhs")
    joined = inner.join(b, (inner["rhs"] == b["rhs"]) & same).drop(b["rhs"]).drop(*[f"__{k}" for k in keys])
    return joined.filter("lside <> rside")


def feature_lines(edges: DataFrame, values: DataFrame, scale: DataFrame) -> DataFrame:
    """(area, key, lhs, rhs, x1..y2): edges between places on either side of the middle of a feature's scale."""
    sides = values.join(F.broadcast(scale.select("key", ((F.col("lo") + F.col("hi")) / 2).alias("middle"))), "key").select(
        "key", "id", (F.col("value") >= F.col("middle")).alias("side"))
    return boundaries(edges, sides, ["key"]).select("area", "key", "lhs", "rhs", "x1", "y1", "x2", "y2")


def bundles(lines: DataFrame, reach: float = BUNDLE_KM, least: int = 2) -> DataFrame:
    """(area, lhs, rhs, n): edges whose middle has boundary lines of at least ``least`` features within reach.

    Middles meet segments through latitude bands, an equi-join.
    """
    height = reach / 111.0
    part = lines.select("area", "key", "lhs", "rhs", "x1", "y1", "x2", "y2", ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"))
    mids = part.select("area", "lhs", "rhs", "mx", "my").distinct().withColumn("band", F.floor(F.col("my") / height))
    other = part.select("area", F.col("key").alias("other"), "x1", "y1", "x2", "y2").withColumn("band", F.explode(F.sequence(
        F.floor(F.least("y1", "y2") / height) - 1, F.floor(F.greatest("y1", "y2") / height) + 1)))
    kx = F.cos(F.radians("my")) * 111.195
    dx, dy = (F.col("x2") - F.col("x1")) * kx, (F.col("y2") - F.col("y1")) * 111.195
    px, py = (F.col("mx") - F.col("x1")) * kx, (F.col("my") - F.col("y1")) * 111.195
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0))))
    near = F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2) <= reach * reach
    met = mids.join(other, ["area", "band"]).filter(near)
    return met.groupBy("area", "lhs", "rhs", "mx", "my").agg(F.countDistinct("other").alias("n")).filter(F.col("n") >= least)


def fronts(edges: DataFrame, panel: DataFrame, level: float = 0.5) -> DataFrame:
    """(run, t, area, n_edges, km): the wavefront of each step, the edges between adopters and others."""
    sides = panel.select("run", "t", "id", (F.col("adoption") >= level).alias("side"))
    b = boundaries(edges, sides, ["run", "t"])
    return b.groupBy("run", "t", "area").agg(F.count("*").alias("n_edges"), F.sum(edge_km()).alias("km"))


def outline(edges: DataFrame, keys: list[str], tolerance: float, rounds: int) -> DataFrame:
    """(*keys, rings): rings from a group's edges, simplified and smoothed, as arrays of struct<x, y>."""
    names = list(keys)

    def run(t):
        pts = np.stack([t.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], 1).reshape(-1, 2, 2)
        rings = [geometry.chaikin(geometry.simplify(r, tolerance), rounds) for r in geometry.assemble(pts)]
        value = [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
        cols = {k: t.column(k).slice(0, 1) for k in names}
        return pa.table({**cols, "rings": pa.array([value], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))})

    kinds = dict(edges.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", rings array<array<struct<x: double, y: double>>>"
    return edges.select(*keys, "x1", "y1", "x2", "y2").groupBy(*keys).applyInArrow(run, schema)


def dialect_regions(edges: DataFrame, clusters: DataFrame, places: DataFrame) -> DataFrame:
    """(area, cluster, n, ids, label, border_km): places of each cluster, its largest as label, and its inner border.

    ``clusters`` (id, cluster), ``places`` (id, name, population).
    """
    inner = boundaries(edges, clusters.select("id", F.col("cluster").alias("side")), [])
    km = inner.select("area", F.explode(F.array("lside", "rside")).alias("cluster"), edge_km().alias("km")).groupBy("area", "cluster").agg(F.sum("km").alias("border_km"))
    own = edges.select("area", F.explode(F.array_compact(F.array("lhs", "rhs"))).alias("id")).distinct().join(clusters, "id").join(places, "id")
    sized = own.groupBy("area", "cluster").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"),
        F.max_by("name", F.struct(F.coalesce("population", F.lit(0)), "id")).alias("label"))
    return sized.join(km, ["area", "cluster"], "left").withColumn("border_km", F.coalesce("border_km", F.lit(0.0)))


def cell_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, x1, y1, x2, y2) in grid units: edges of the cells (i, j) that belong to one cell of their group only."""
    i, j = F.col("i"), F.col("j")
    def edge(a, b, c, d):
        return F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    four = F.array(edge(i, j, i + 1, j), edge(i, j + 1, i + 1, j + 1), edge(i, j, i, j + 1), edge(i + 1, j, i + 1, j + 1))
    return cells.select(*keys, F.inline(four)).groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
