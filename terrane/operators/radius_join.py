"""All pairs of points within a great-circle distance.

Distinct locations are spread over the Voronoi cells of pivots. A location also goes, as a candidate, to every cell that
may own a point within the radius: by the triangle inequality those whose pivot is at most twice the radius farther than
its own. Cells with many locations are cut into blocks that meet block by block. Each task builds a vantage-point tree of
its candidates and searches it for its own points with the exact great-circle metric.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.geo import RADIUS_KM
from terrane.session import small, without_name_clash, written

#: Pivots at most (their table is sent to every task: 24 bytes each), and locations wanted per cell.
PIVOTS, PER_CELL = 16_384, 2000
#: Locations of a cell, candidates included, beyond which it is cut into blocks of about this size.
BLOCK = 20_000
#: Points in a leaf of the tree.
LEAF = 48


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lo, la = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], -1)


def arc_km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distances of unit vectors, exact for near and far points alike."""
    chord = np.sqrt(((a - b) ** 2).sum(-1))
    return 2 * RADIUS_KM * np.arcsin(np.minimum(1.0, chord / 2))


class VantageTree:
    """Points split by the median distance to a vantage point, down to leaves; searched for many queries at once."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._build(np.arange(len(points)))

    def _build(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids
        vantage = ids[len(ids) // 2]
        d = arc_km(self.points[ids], self.points[vantage])
        middle = np.median(d)
        inner = d <= middle
        if inner.all():  # many points at one distance
            return ids if d.max() == d.min() and len(ids) <= 4 * LEAF else self._halved(ids, vantage, d)
        return vantage, d[inner].max(), d[~inner].min(), self._build(ids[inner]), self._build(ids[~inner])

    def _halved(self, ids, vantage, d):
        h = len(ids) // 2
        order = np.argsort(d, kind="stable")
        a, b = order[:h], order[h:]
        return vantage, d[a].max(), d[b].min(), self._build(ids[a]), self._build(ids[b])

    def within(self, queries: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, km) of all pairs within the radius."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stack = [(self.root, np.arange(len(queries)))]
        slack = 1e-9
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if isinstance(node, np.ndarray):
                for s in range(0, len(q), 4096):
                    part = q[s : s + 4096]
                    d = arc_km(queries[part][:, None], self.points[node][None])
                    i, k = np.nonzero(d <= radius)
                    found.append((part[i], node[k], d[i, k]))
                continue
            vantage, inner, outer, near, far = node
            d = arc_km(queries[q], self.points[vantage])
            stack.append((near, q[d <= inner + radius + slack]))
            stack.append((far, q[d >= outer - radius - slack]))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*found))


def valid_location(lon: Column, lat: Column) -> Column:
    """Coordinates that name a place: both present, on the globe (longitudes may run to 360) and not exactly (0, 0)."""
    there = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    return there & lat.between(-90, 90) & lon.between(-180, 360) & ~((lon == 0) & (lat == 0))


def locations(df: DataFrame, id_column: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Distinct (id, lon, lat) of rows with an id and a valid location, longitudes brought to -180..180."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    turned = F.when(x > 180, x - 360).when(x == -180, F.lit(180.0)).otherwise(x)
    return df.filter(F.col(id_column).isNotNull() & valid_location(x, y)).select(
        F.col(id_column).alias("id"), (turned + 0.0).alias("lon"), (y + 0.0).alias("lat")
    ).distinct()


def pivots(places: DataFrame, n: int, radius: float) -> np.ndarray:
    """Unit vectors of pivots: the locations of least hash, thinned to four radii apart; at most PIVOTS come here."""
    k = min(PIVOTS, max(1, math.ceil(n / PER_CELL)))
    rows = places.select("lon", "lat").orderBy(F.xxhash64("lon", "lat"), "lon", "lat").limit(k).collect()
    u = unit_vectors(np.array([r.lon for r in rows]), np.array([r.lat for r in rows])).reshape(-1, 3)
    kept: list[int] = []
    for i in range(len(u)):
        if not kept or arc_km(u[kept], u[i]).min() >= 4 * radius:
            kept.append(i)
    return u[kept]


def _assign(u: np.ndarray, radius: float):
    """Cells of each location: its own, and those that may own a point within the radius of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = unit_vectors(b.column(1).to_numpy(), b.column(2).to_numpy())
            rows, cells, own = [], [], []
            step = max(64, (1 << 20) // len(u))
            for s in range(0, len(p), step):
                d = 2 * RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(np.maximum(0.0, 2 - 2 * p[s : s + step] @ u.T)) / 2))
                home = d.argmin(1)
                near = d <= d.min(1)[:, None] + 2 * radius + 0.2  # 0.2 km above the rounding of the product near 0
                i, c = np.nonzero(near)
                rows.append(i + s), cells.append(c), own.append(c == home[i])
            rows = np.concatenate(rows) if rows else np.zeros(0, int)
            t = b.take(pa.array(rows))
            cells = np.concatenate(cells) if cells else rows
            own = np.concatenate(own) if own else rows.astype(bool)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cells, pa.int32()), pa.array(own)], ["place", "lon", "lat", "cell", "own"])

    return run


def _search(radius: float):
    """Pairs of one (cell, block) task: own points against all candidates, each pair where its lesser place is at home."""
    def run(table: pa.Table) -> pa.Table:
        place, own = table.column("place").to_numpy(), table.column("side").to_numpy(zero_copy_only=False)
        p = unit_vectors(table.column("lon").to_numpy(), table.column("lat").to_numpy())
        q, c = np.nonzero(own == 0)[0], np.nonzero(own == 1)[0]
        i, k, d = VantageTree(p[c]).within(p[q], radius) if len(c) and len(q) else (np.zeros(0, int),) * 2 + (np.zeros(0),)
        a, b = place[q[i]], place[c[k]]
        less = a < b
        return pa.table({"a": a[less], "b": b[less], "km": d[less]})

    return run


def radius_pairs(places: DataFrame, radius: float) -> DataFrame:
    """(a, b, km), a < b: all pairs of distinct places (place long, lon, lat) within the radius."""
    n = places.count()
    if n == 0:
        return places.select(F.col("place").alias("a"), F.col("place").alias("b"), F.lit(0.0).alias("km"))
    u = pivots(places, n, radius)
    spread = written(places.select("place", "lon", "lat").mapInArrow(_assign(u, radius), "place long, lon double, lat double, cell int, own boolean"), "cells")
    parts = spread.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # a row per pivot
    cut = spread.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int"))
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    # a block of own points meets every block of candidates: (own part, candidate part) names the task
    asked = cut.filter("own").select("place", "lon", "lat", "cell", F.col("part").alias("p"), F.explode(all_parts).alias("c"), F.lit(0).alias("side"))
    offered = cut.select("place", "lon", "lat", "cell", F.explode(all_parts).alias("p"), F.col("part").alias("c"), F.lit(1).alias("side"))
    return asked.union(offered).groupBy("cell", "p", "c").applyInArrow(_search(radius), "a long, b long, km double")


def near_pairs(df: DataFrame, id_column: str, radius: float = 1.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(id_a, id_b, km), id_a < id_b: all pairs of different ids with locations at most ``radius`` km apart.

    Rows without an id or a valid location take no part; repeated rows count once; of several locations of an id the
    nearest counts. Ids at one place form pairs at distance 0.
    """
    at = written(locations(df, id_column, lon, lat).withColumn("place", F.xxhash64("lon", "lat")), "locations")
    places = at.select("place", "lon", "lat").distinct()
    pairs = radius_pairs(written(places, "places"), radius)
    a = at.select(F.col("id").alias("ia"), F.col("place").alias("a"))
    b = at.select(F.col("id").alias("ib"), F.col("place").alias("b"))
    apart = pairs.join(a, "a").join(b, "b").filter("ia <> ib").select("ia", "ib", "km")
    together = a.join(b, F.col("a") == F.col("b")).filter("ia < ib").select("ia", "ib", F.lit(0.0).alias("km"))
    both = apart.union(together)
    return both.groupBy(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).agg(F.min("km").alias("km"))


def neighbour_sums(df: DataFrame, id_column: str, values: DataFrame, radius: float = 1.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(id, n, total): number of each located id's neighbours within ``radius`` km and the sum of their value.

    ``values``: (id, value), one row per id; null where no neighbour has one. Ids at one place are counted by place, so a
    crowded place costs no pairs of ids; only ids with several locations are paired one by one, each neighbour once.
    """
    at = written(locations(df, id_column, lon, lat).withColumn("place", F.xxhash64("lon", "lat")), "locations")
    several = written(at.groupBy("id").count().filter("count > 1").select("id"), "several")
    one = written(at.join(several, "id", "left_anti").join(values.select("id", F.col("value").cast("double").alias("value")), "id", "left").select("id", "place", "value"), "single")
    pairs = written(radius_pairs(written(at.select("place", "lon", "lat").distinct(), "places"), radius).select("a", "b"), "near")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stats = one.groupBy("place").agg(F.count("*").alias("n"), F.count("value").alias("k"), F.sum("value").alias("s"))
    near = both.join(stats, F.col("b") == F.col("place")).groupBy("a").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    there = near.unionByName(stats.withColumnRenamed("place", "a")).groupBy("a").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    own = F.col("value").isNotNull().cast("int")
    alone = one.join(there, F.col("place") == F.col("a")).select(
        "id", (F.col("n") - 1).alias("n"), (F.col("k") - own).alias("k"), (F.coalesce("s", F.lit(0.0)) - F.coalesce("value", F.lit(0.0))).alias("s"))
    # ids with several locations, paired with all others in both directions
    spots = at.join(several, "id").select(F.col("id").alias("x"), "place").withColumn("near", F.col("place"))
    reach = spots.select("x", "near").union(spots.join(both, F.col("place") == F.col("a")).select("x", F.col("b").alias("near"))).distinct()
    met = reach.join(at.select(F.col("id").alias("y"), F.col("place").alias("near")), "near").filter("x <> y").select("x", "y")
    mixed = met.union(met.select("y", "x")).distinct().join(values.select(F.col("id").alias("y"), F.col("value").cast("double").alias("value")), "y", "left")
    loose = mixed.groupBy(F.col("x").alias("id")).agg(F.count("*").alias("n"), F.count("value").alias("k"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"))
    sums = alone.unionByName(loose).groupBy("id").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    ids = at.select("id").distinct().join(sums, "id", "left")
    return ids.select("id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("k") > 0, F.col("s")).alias("total"))


def containing_region(df: DataFrame, id_column: str, regions: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(id, region): the least id of the regions (id, land) that hold each id's location, null where none does.

    Region rows are few and bounded by the counted size of their rings before they are broadcast.
    """
    from terrane.functions.geo import in_rings

    at = locations(df, id_column, lon, lat)
    lands = without_name_clash(regions, "id", "land").filter("id IS NOT NULL AND land IS NOT NULL").select(F.col("id").alias("region"), "land")
    edge = lambda side, axis: getattr(F, f"array_{side}")(F.transform(F.flatten("land"), lambda p: p[axis])).alias(f"{axis}_{side}")
    boxed = written(lands.select("*", *[edge(s, a) for s in ("min", "max") for a in ("x", "y")]), "boxes")
    vertices = boxed.agg(F.coalesce(F.sum(F.size(F.flatten("land"))), F.lit(0))).first()[0]
    inside = (F.col("lon").between(F.col("x_min"), F.col("x_max")) & F.col("lat").between(F.col("y_min"), F.col("y_max"))
              & in_rings(F.col("lon"), F.col("lat"), F.col("land")))
    return at.join(small(boxed, 24, vertices), inside, "left").groupBy("id").agg(F.min("region").alias("region"))
