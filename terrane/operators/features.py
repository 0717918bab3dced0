"""Long and wide feature tables, scaling, neighbourhood means and nearest records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.functions.geo import haversine_km
from terrane.session import small


def finite(c: Column) -> Column:
    """A double, null where it is NaN or infinite."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def to_long(df: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
    """(id, key, value): one row per present feature of each record."""
    values = df.select(F.col(id_column).alias("id"), *[finite(F.col(k)).alias(k) for k in keys])
    return values.unpivot("id", keys, "key", "value").filter("value IS NOT NULL")


def to_wide(long: DataFrame, keys: list[str]) -> DataFrame:
    """One row per id with a column per key, the mean of repeats."""
    return long.groupBy("id").pivot("key", keys).agg(F.avg("value"))


def scaled(value: Column, lo: Column, hi: Column) -> Column:
    """A value on its scale as 0..1."""
    return (value - lo) / (hi - lo)


def unscaled(x: Column, lo: Column, hi: Column) -> Column:
    return lo + x * (hi - lo)


def neighbourhood_mean(queries: DataFrame, sites: DataFrame, k: int = 24, bandwidth: float = 180.0) -> DataFrame:
    """(q, n, value): mean of the k nearest sites' values, weighted by exp(-(km / bandwidth)**2).

    ``queries`` (q, qlon, qlat) is a stated set met by every site (id, lon, lat, value); nearest is by planar degrees, as
    an index on the coordinates would have it, ties by id. Weights are shifted by the nearest site, so far ones can't
    all vanish.
    """
    near = sites.join(small(queries, 64), F.lit(True)).withColumn(
        "off", F.pow(F.col("lon") - F.col("qlon"), 2) + F.pow(F.col("lat") - F.col("qlat"), 2))
    w = Window.partitionBy("q").orderBy("off", "id")
    top = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    top = top.withColumn("z", F.pow(haversine_km(F.col("lon"), F.col("lat"), F.col("qlon"), F.col("qlat")) / bandwidth, 2))
    shifted = top.withColumn("weight", F.exp(F.min("z").over(Window.partitionBy("q")) - F.col("z")))
    return shifted.groupBy("q").agg(F.count("*").alias("n"), (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def nearest(points: DataFrame, places: DataFrame) -> DataFrame:
    """(id, place, km): the place (place, plon, plat) nearest each point (id, lon, lat) on the sphere, ties by name."""
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    near = points.join(small(places, 64), F.lit(True)).withColumn("km", km)
    return near.groupBy("id").agg(F.min(F.struct("km", "place")).alias("best")).select("id", F.col("best.place").alias("place"), F.col("best.km").alias("km"))


def weighted_distance(long: DataFrame, probe: DataFrame) -> DataFrame:
    """(id, distance, similarity): reliability-weighted RMS distance of each record to a probe (key, x, reliability)."""
    d = long.join(small(probe, 64), "key").groupBy("id").agg(
        F.sqrt(F.sum(F.col("reliability") * F.pow(F.col("value") - F.col("x"), 2)) / F.sum("reliability")).alias("distance"))
    return d.withColumn("similarity", F.exp(-3 * F.col("distance")))


def pair_distances(long: DataFrame) -> DataFrame:
    """(a, b, n, distance), a < b: RMS difference over the keys that two records share."""
    x, y = (long.select(F.col("id").alias(i), "key", F.col("value").alias(v)) for i, v in (("a", "va"), ("b", "vb")))
    return x.join(y, "key").filter("a < b").groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sqrt(F.sum(F.pow(F.col("va") - F.col("vb"), 2)) / F.count("*")).alias("distance"))


def summary(long: DataFrame) -> DataFrame:
    """Per key: count, mean, population deviation, median and outer percentiles, exact."""
    return long.groupBy("key").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.05)).alias("p05"), F.percentile("value", F.lit(0.95)).alias("p95"))
