"""The interaction graph: pairs of places within reach, weighted by population, effective distance and ancestry."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.geo import crosses, haversine_km
from terrane.functions.geometry import corridor_fraction
from terrane.session import small

#: Kilometres in a degree of latitude on the sphere.
KM_PER_DEGREE = math.pi * 6371.0088 / 180
#: Fixed values of the model: exponents, floor of the distance, reach, and the share a corridor takes off.
ALPHA, GAMMA, FLOOR_KM, MAX_KM, CORRIDOR_SHARE = 0.5, 2.0, 5.0, 2500.0, 0.45
#: Points of all corridors at most.
CORRIDOR_POINTS = 10_000


def gravity(people_a: Column, people_b: Column, km: Column, alpha: float = ALPHA, gamma: float = GAMMA, floor: float = FLOOR_KM) -> Column:
    """(Pa Pb)**alpha / max(km, floor)**gamma."""
    return F.pow(people_a, F.lit(alpha)) * F.pow(people_b, F.lit(alpha)) / F.pow(F.greatest(km, F.lit(floor)), F.lit(gamma))


def effective_km(km: Column, resistance: Column, corridor: Column) -> Column:
    """Distance lengthened by barriers and shortened where a corridor runs along."""
    return km * (1 + resistance) * (1 - CORRIDOR_SHARE * F.least(F.lit(1.0), corridor))


def pairs_within(points: DataFrame, max_km: float = MAX_KM) -> DataFrame:
    """(a, b, alon, alat, blon, blat, ap, bp, km), a < b: pairs of points (id, lon, lat, population) at most max_km apart.

    Points meet by latitude bands one reach high, an equi-join; a point is compared with its own and the next band only.
    """
    height = max_km / KM_PER_DEGREE
    p = points.select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("population").cast("double").alias("population"))
    p = p.dropna(subset=["id", "lon", "lat"]).withColumn("band", F.floor(F.col("lat") / height).cast("int"))
    left = p.select(F.col("id").alias("x"), F.col("lon").alias("xlon"), F.col("lat").alias("xlat"), F.col("population").alias("xp"), F.col("band").alias("own"),
                    F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = p.select(F.col("id").alias("y"), F.col("lon").alias("ylon"), F.col("lat").alias("ylat"), F.col("population").alias("yp"), "band")
    met = left.join(right, "band").filter((F.col("band") != F.col("own")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")) & (F.col("band") == F.col("own")))
    km = haversine_km(F.col("xlon"), F.col("xlat"), F.col("ylon"), F.col("ylat"))
    near = met.withColumn("km", km).filter(F.col("km") <= max_km)
    swap = F.col("x") > F.col("y")
    return near.select(*[F.when(swap, F.col(f"y{s}")).otherwise(F.col(f"x{s}")).alias(f"a{t}") for s, t in (("", ""), ("lon", "lon"), ("lat", "lat"), ("p", "p"))],
                       *[F.when(swap, F.col(f"x{s}")).otherwise(F.col(f"y{s}")).alias(f"b{t}") for s, t in (("", ""), ("lon", "lon"), ("lat", "lat"), ("p", "p"))], "km")


def segments(areas: DataFrame, id_column: str = "id", rings: str = "land") -> DataFrame:
    """(barrier, segment, x1, y1, x2, y2): the edges of each area's rings."""
    ring = areas.select(F.col(id_column).alias("barrier"), F.posexplode(rings).alias("ring", "r"))
    edges = ring.select("barrier", "ring", F.posexplode(F.arrays_zip(
        F.expr("slice(r, 1, size(r) - 1)").alias("p"), F.expr("slice(r, 2, size(r) - 1)").alias("q"))).alias("segment", "e"))
    return edges.select("barrier", "ring", "segment", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def resistance(pairs: DataFrame, barriers: DataFrame, per_segment: bool = False) -> DataFrame:
    """``pairs`` with ``resistance`` and ``crossed``: barriers that the straight line crosses, each once or per segment.

    ``barriers`` has (barrier, x1, y1, x2, y2, resistance); its segments are counted before they are broadcast.
    """
    line = tuple(F.col(c) for c in ("alon", "alat", "blon", "blat"))
    wall = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    boxes = (
        (F.greatest("x1", "x2") >= F.least("alon", "blon")) & (F.least("x1", "x2") <= F.greatest("alon", "blon"))
        & (F.greatest("y1", "y2") >= F.least("alat", "blat")) & (F.least("y1", "y2") <= F.greatest("alat", "blat"))
    )
    hits = pairs.select("a", "b", *("alon", "alat", "blon", "blat")).join(small(barriers, 80), boxes & crosses(line, wall))
    each = hits.select("a", "b", "barrier", F.col("resistance").alias("r"))
    each = each if per_segment else each.groupBy("a", "b", "barrier").agg(F.max("r").alias("r"))
    total = each.groupBy("a", "b").agg(F.sum("r").alias("resistance"), F.count("*").alias("crossed"))
    return pairs.join(total, ["a", "b"], "left").withColumn("resistance", F.coalesce("resistance", F.lit(0.0))).withColumn(
        "crossed", F.coalesce("crossed", F.lit(0)).cast("long"))


def corridor_share(pairs: DataFrame, corridors: DataFrame) -> DataFrame:
    """``pairs`` with ``corridor``: the share of the straight line within any corridor's width, at most 1.

    ``corridors`` (line array<struct<x, y>>, width in degrees) is a dimension table: its points are counted, and beyond
    CORRIDOR_POINTS it is refused, for every pair meets every corridor.
    """
    lines = [(np.array([(p["x"], p["y"]) for p in r["line"]], float), float(r["width"])) for r in corridors.filter("size(line) > 1").limit(CORRIDOR_POINTS + 1).collect()]
    if sum(len(line) for line, _ in lines) > CORRIDOR_POINTS:
        raise ValueError(f"corridors have more than {CORRIDOR_POINTS} points")

    def run(batches):
        for b in batches:
            a = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in ("alon", "alat")], 1)
            z = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in ("blon", "blat")], 1)
            total = np.zeros(b.num_rows)
            for line, width in lines:
                total += corridor_fraction(a, z, line, width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.minimum(1.0, total))], [*b.schema.names, "corridor"])

    schema = T.StructType([*pairs.schema.fields, T.StructField("corridor", T.DoubleType())])
    return pairs.mapInArrow(run, schema)


def ancestry_pairs(links: DataFrame) -> DataFrame:
    """(a, b, ancestry): links (parent_id, child_id, weight) whichever way they point, the greatest weight per pair."""
    return links.groupBy(F.least("parent_id", "child_id").alias("a"), F.greatest("parent_id", "child_id").alias("b")).agg(F.max("weight").alias("ancestry"))


def interaction_edges(points: DataFrame, barriers: DataFrame, links: DataFrame, max_km: float = MAX_KM, corridors: DataFrame | None = None) -> DataFrame:
    """(a, b, km, effective, crossed, corridor, ancestry, weight): edges within reach or joined by ancestry.

    Without ``corridors`` (see corridor_share) no line runs along one.
    """
    kin = ancestry_pairs(links)
    near = pairs_within(points, max_km)
    p = points.select("id", *[F.col(c).cast("double").alias(c) for c in ("lon", "lat", "population")]).dropna(subset=["id", "lon", "lat"])
    ends = [p.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}{t}") for c, t in (("lon", "lon"), ("lat", "lat"), ("population", "p"))]) for s in "ab"]
    far = kin.select("a", "b").join(ends[0], "a").join(ends[1], "b").withColumn("km", haversine_km(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat")))
    pairs = near.unionByName(far.filter(F.col("km") > max_km).select(*near.columns))
    pairs = pairs.withColumn("corridor", F.lit(0.0)) if corridors is None else corridor_share(pairs, corridors)
    edges = resistance(pairs, barriers).join(kin, ["a", "b"], "left")
    edges = edges.withColumn("effective", effective_km(F.col("km"), F.col("resistance"), F.col("corridor")))
    return edges.select("a", "b", "km", "effective", "crossed", "corridor", "ancestry",
                        (gravity(F.col("ap"), F.col("bp"), F.col("effective")) * F.coalesce("ancestry", F.lit(1.0))).alias("weight"))
