"""Queries of the derived layers: cells, boundary lines, bundles, regions, fronts, credible outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import locate, regions
from terrane.plans import network, places
from terrane.session import load, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(spark, d) -> DataFrame:
    return written(regions.voronoi_edges(load(spark, d, "settlement"), load(spark, d, "study_area")), "edges")


def _scale(spark, d) -> DataFrame:
    return load(spark, d, "accent_feature").select("key", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))  # vectors are scaled


@query()
def voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the settlements' cells, cut to land."""
    return _edges(spark, sf_dir).select("area", "lhs", "rhs", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query()
def boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every feature's boundary line in each area."""
    lines = regions.feature_lines(_edges(spark, sf_dir), network.settlement_vectors(spark, sf_dir), _scale(spark, sf_dir))
    return lines.groupBy("area", "key").agg(F.count("*").alias("n"), F.round(F.sum(regions.edge_km()), 3).alias("km"))


@query()
def boundary_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges where the boundary lines of two or more features run within 35 km."""
    lines = written(regions.feature_lines(_edges(spark, sf_dir), network.settlement_vectors(spark, sf_dir), _scale(spark, sf_dir)), "lines")
    return regions.bundles(lines).select("area", "lhs", "rhs", "n")


def _clusters(spark, d) -> DataFrame:
    c = locate.cluster_groups(places._vectors(spark, d), "country", list(network.FEATURES), 3)
    return written(c.select("id", F.concat_ws("-", "country", "cluster").alias("cluster")), "clusters")


@query()
def dialect_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of like settlements with their label, members and border."""
    r = regions.dialect_regions(_edges(spark, sf_dir), _clusters(spark, sf_dir), load(spark, sf_dir, "settlement").select("id", "name", "population"))
    return r.withColumn("border_km", F.round("border_km", 3))


@query()
def wave_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each run's wavefront at each step."""
    return regions.fronts(_edges(spark, sf_dir), written(places._panel(spark, sf_dir), "panel")).withColumn("km", F.round("km", 3))


@query(places._POST + """, b AS (SELECT *, round(coalesce(sum(p) OVER (ORDER BY p DESC, area, i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 12) AS before FROM post),
c AS (SELECT area, i, j, unnest([0.5, 0.8, 0.95])::DOUBLE AS level, before FROM b), m AS (SELECT area, level, i, j FROM c WHERE before < level),
ce AS (SELECT area, level, i AS x1, j AS y1, i + 1 AS x2, j AS y2 FROM m UNION ALL SELECT area, level, i, j + 1, i + 1, j + 1 FROM m
  UNION ALL SELECT area, level, i, j, i, j + 1 FROM m UNION ALL SELECT area, level, i + 1, j, i + 1, j + 1 FROM m)
SELECT area, level, x1, y1, x2, y2 FROM ce GROUP BY ALL HAVING count(*) = 1""")
def credible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer cell edges of the 50, 80 and 95 percent sets."""
    return regions.cell_edges(_credible(spark, sf_dir), ["area", "level"])


def _credible(spark, d) -> DataFrame:
    sets = locate.credible_sets(places._posterior(spark, d)).filter("level IS NOT NULL")
    nested = F.filter(F.array(*[F.lit(x) for x in locate.LEVELS]), lambda x: x >= F.col("own"))
    return sets.withColumnRenamed("level", "own").withColumn("level", F.explode(nested)).select("area", "level", "i", "j")


@query()
def credible_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed outlines of the credible sets, in grid units."""
    return regions.outline(credible_edges(spark, sf_dir), ["area", "level"], 1 / 3, 2)


@query()
def derived_layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every derived layer, in the order they are built."""
    steps = [("edges", network.interaction_edges), ("cells", voronoi_cells), ("lines", boundary_lines), ("bundles", boundary_bundles)]
    out = None
    for step, f in steps:
        n = f(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "n")
        out = n if out is None else out.unionByName(n)
    return out
