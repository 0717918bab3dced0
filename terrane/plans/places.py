"""Queries on the posterior over places, clustering, and the spread of adoption."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.geo import haversine_km, haversine_sql
from terrane.operators import diffusion, gravity, locate
from terrane.plans import network
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


_GRID = """, box AS (SELECT id AS area, list_min(list_transform(flatten(land), lambda p: p.x)) AS x0, list_max(list_transform(flatten(land), lambda p: p.x)) AS x1,
  list_min(list_transform(flatten(land), lambda p: p.y)) AS y0, list_max(list_transform(flatten(land), lambda p: p.y)) AS y1 FROM study_area),
st AS (SELECT greatest(sqrt(sum((x1 - x0) * (y1 - y0)) / 5000), 0.08) AS step FROM box),
g AS (SELECT area, CAST(i AS INT) AS i, CAST(j AS INT) AS j, x0 + i * step AS lon, y0 + j * step AS lat FROM box, st, range(1000) a(i), range(1000) b(j)
  WHERE i <= floor((x1 - x0) / step) AND j <= floor((y1 - y0) / step))"""
_ATTACH = f""", n AS (SELECT id, lon AS nlon, lat AS nlat, CAST(population AS DOUBLE) AS population FROM settlement),
met AS (SELECT area, i, j, lon, lat, id, population, {haversine_sql('lon', 'lat', 'nlon', 'nlat')} AS km FROM g, n),
pull AS (SELECT *, sqrt(population) / pow(greatest(km, 8), 2) AS pull FROM met),
att AS (SELECT *, pull / sum(pull) OVER (PARTITION BY area, i, j) AS w FROM pull)"""
_BASE = network._CENTRES + _GRID + _ATTACH


def _grid(spark, d):
    return locate.grid(load(spark, d, "study_area"))


def _nodes(spark, d):
    return load(spark, d, "settlement").select("id", F.col("lon").alias("nlon"), F.col("lat").alias("nlat"), "population")


def _attached(spark, d):
    return locate.attach(_grid(spark, d), _nodes(spark, d))


@query("WITH one AS (SELECT 1)" + _GRID + " SELECT area, i, j, round(lon, 6) AS lon, round(lat, 6) AS lat FROM g")
def location_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid over all study areas."""
    return _grid(spark, sf_dir).select("area", "i", "j", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(_BASE + " SELECT area, i, j, count(*) AS n, round(max(w), 6) AS most, round(sum(w * w), 6) AS focus FROM att GROUP BY ALL")
def kernel_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each grid cell hangs on the settlements."""
    return _attached(spark, sf_dir).groupBy("area", "i", "j").agg(
        F.count("*").alias("n"), F.round(F.max("w"), 6).alias("most"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("focus"))


@query(_BASE + " SELECT area, i, j, round(ln(1000 + sum(population * exp(-0.5 * pow(km / 90, 2)))), 6) AS prior FROM att GROUP BY ALL")
def population_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of the people around each cell."""
    return locate.prior(_attached(spark, sf_dir)).withColumn("prior", F.round("prior", 6))


_POST = _BASE + """, mu AS (SELECT area, i, j, key, sum(w * value) / sum(w) AS mu FROM att JOIN scaled USING (id) GROUP BY ALL),
probe AS (SELECT key, 0.4 + 0.01 * length(key) AS x, 0.5 + 0.02 * length(key) AS reliability, CAST(nugget AS DOUBLE) AS nugget FROM accent_feature),
ll AS (SELECT area, i, j, sum(reliability * (-0.5 * pow(x - mu, 2) / (0.05 + nugget) - 0.5 * ln(0.05 + nugget))) AS loglik FROM mu JOIN probe USING (key) GROUP BY ALL),
pr AS (SELECT area, i, j, ln(1000 + sum(population * exp(-0.5 * pow(km / 90, 2)))) AS prior FROM att GROUP BY ALL),
z AS (SELECT area, i, j, lon, lat, loglik + 0.30 * prior + ln(greatest(cos(radians(lat)), 1e-6)) AS z FROM g JOIN ll USING (area, i, j) JOIN pr USING (area, i, j)),
e AS (SELECT *, exp(z - max(z) OVER ()) AS e FROM z), post AS (SELECT area, i, j, lon, lat, e / sum(e) OVER () AS p FROM e)"""


def _posterior(spark, d) -> DataFrame:
    attached = _attached(spark, d)
    means, prior = locate.cell_statistics(attached, network.settlement_vectors(spark, d), list(network.FEATURES))
    probe = load(spark, d, "accent_feature").select("key", (0.4 + 0.01 * F.length("key")).alias("x"), (0.5 + 0.02 * F.length("key")).alias("reliability"),
                                                    F.col("nugget").cast("double").alias("nugget"))
    loglik = locate.log_likelihood(means, probe, F.lit(0.05))
    return locate.posterior(_grid(spark, d), loglik, prior)


@query(_POST + " SELECT area, i, j, round(p, 9) AS p FROM post")
def posterior_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of a probe vector over the grid."""
    return _posterior(spark, sf_dir).select("area", "i", "j", F.round("p", 9).alias("p"))


@query(_POST + """, b AS (SELECT *, round(coalesce(sum(p) OVER (ORDER BY p DESC, area, i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 12) AS before FROM post)
SELECT area, i, j, CASE WHEN before < 0.5 THEN 0.5 WHEN before < 0.8 THEN 0.8 WHEN before < 0.95 THEN 0.95 END::DOUBLE AS level FROM b""")
def credible_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest credible set that holds each cell."""
    return locate.credible_sets(_posterior(spark, sf_dir)).select("area", "i", "j", "level")


@query(_POST + f""", b AS (SELECT arg_max(lon, p) AS map_lon, arg_max(lat, p) AS map_lat, sum(p * lon) AS mean_lon, sum(p * lat) AS mean_lat FROM post)
SELECT round(map_lon, 6) AS map_lon, round(map_lat, 6) AS map_lat, round(mean_lon, 6) AS mean_lon, round(mean_lat, 6) AS mean_lat,
round(sqrt(sum(p * pow({haversine_sql('lon', 'lat', 'map_lon', 'map_lat')}, 2))), 4) AS spread_km FROM post, b GROUP BY map_lon, map_lat, mean_lon, mean_lat""")
def location_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode, mean and spread of the posterior."""
    e = locate.estimate(_posterior(spark, sf_dir))
    return e.select(*[F.round(c, 6).alias(c) for c in ("map_lon", "map_lat", "mean_lon", "mean_lat")], F.round("spread_km", 4).alias("spread_km"))


def _vectors(spark, d) -> DataFrame:
    wide = network.settlement_vectors(spark, d).groupBy("id").pivot("key", list(network.FEATURES)).agg(F.first("value"))
    return load(spark, d, "settlement").select("id", "country", F.col("lon").alias("nlon"), F.col("lat").alias("nlat"), "population").join(wide, "id")


@query()
def kernel_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel prediction of every feature at every cell, per country's settlements."""
    p = locate.kernel_means(_vectors(spark, sf_dir), _grid(spark, sf_dir), "country", list(network.FEATURES))
    return p.withColumn("mu", F.round("mu", 6)).withColumn("variance", F.round("variance", 6))


@query()
def kmedoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clusters of settlements in each country by their features."""
    return locate.cluster_groups(_vectors(spark, sf_dir), "country", list(network.FEATURES), 3)


_EDGES = network._PAIRS + """, ed AS (SELECT p.*, coalesce(resistance, 0) AS resistance FROM p LEFT JOIN res ON p.a = res.a AND p.b = res.b WHERE km <= 2500)"""
_W = _EDGES + """, bw AS (SELECT a AS x, b AS y, {pull} AS pull FROM ed UNION ALL SELECT b, a, {pull} FROM ed),
w AS (SELECT x, y, pull / sum(pull) OVER (PARTITION BY x) AS w FROM bw)"""
_PULL = "pow(ap, 0.5) * pow(bp, 0.5) / pow(greatest(km * (1 + resistance), 5), 2)"


def _edges(spark, d, corridors: bool) -> DataFrame:
    pairs = gravity.pairs_within(load(spark, d, "settlement"))
    pairs = gravity.corridor_share(pairs, network._corridors(spark, d)) if corridors else pairs.withColumn("corridor", F.lit(0.0))
    return gravity.resistance(pairs, network._barriers(spark, d))


def _weights(spark, d, regimes=tuple(diffusion.REGIMES), corridors: bool = False) -> DataFrame:
    e, out = written(_edges(spark, d, corridors), "edges"), None
    for r in regimes:
        w = diffusion.spread_weights(e, r).select(F.lit(r).alias("regime"), "x", "y", "w")
        out = w if out is None else out.unionByName(w)
    return out


@query(_W.format(pull=_PULL) + " SELECT x, y, round(w, 9) AS w FROM w")
def diffusion_graph(spark: SparkSession, sf_dir: str, corridors: bool = False) -> DataFrame:
    """Row-normalised influence between settlements in the hierarchical regime."""
    return _weights(spark, sf_dir, ("hierarchical",), corridors).select("x", "y", F.round("w", 9).alias("w"))


def _origins(spark, d, regimes=tuple(diffusion.REGIMES)) -> DataFrame:
    """A run per regime from the largest settlement."""
    top = load(spark, d, "settlement").agg(F.max_by("id", F.struct("population", "id")).alias("origin"))
    regimes = spark.createDataFrame([(r, r) for r in regimes], "run string, regime string")
    return regimes.join(F.broadcast(top), F.lit(True)).select(
        "run", "regime", "origin", F.lit(diffusion.STEPS).alias("steps"), F.lit(diffusion.RATE).alias("rate"), F.lit(diffusion.CONTACT).alias("contact"),
        F.lit(diffusion.RESISTANCE).alias("resistance"), F.lit(diffusion.IDENTITY).alias("identity"))


def _panel(spark, d, corridors: bool = False, regimes=tuple(diffusion.REGIMES)) -> DataFrame:
    return diffusion.simulate(load(spark, d, "settlement").select("id", "population"), _weights(spark, d, regimes, corridors), _origins(spark, d, regimes))


_SIM = "WITH RECURSIVE" + _W.format(pull=_PULL).strip()[4:] + """, ids AS (SELECT id, ln(population) AS lp, id = (SELECT arg_max(id, (population, id)) FROM settlement) AS o FROM settlement),
mat AS (SELECT list(r ORDER BY x) AS m FROM (SELECT a.id AS x, list(coalesce(w.w, 0) ORDER BY b.id) AS r FROM ids a JOIN ids b ON true LEFT JOIN w ON w.x = a.id AND w.y = b.id GROUP BY a.id)),
init AS (SELECT list(CASE WHEN o THEN 0.97 ELSE 1e-4 END::DOUBLE ORDER BY id) AS x,
  list(0.6 * (lp - (SELECT avg(lp) FROM ids)) / (SELECT stddev_pop(lp) FROM ids) ORDER BY id) AS pi FROM ids),
sim AS (SELECT 0 AS t, x, list_transform(x, lambda v: ln(v / (1 - v))) AS z FROM init
  UNION ALL SELECT t + 1, list_transform(z2, lambda q: 1 / (1 + exp(-greatest(-30, least(30, q))))), z2 FROM (
    SELECT t, list_transform(range(1, len(x) + 1), lambda k: z[k] + 0.55 * (3.2 * list_dot_product(m[k], x) + pi[k] - 0.9)) AS z2 FROM sim, mat, (SELECT pi FROM init) WHERE t < 24)),
panel AS (SELECT t, unnest((SELECT list(id ORDER BY id) FROM ids)) AS id, unnest(x) AS adoption FROM sim)"""


@query(_SIM + " SELECT CAST(t AS INT) AS t, id, round(adoption, 6) AS adoption FROM panel")
def diffusion_simulate(spark: SparkSession, sf_dir: str, corridors: bool = False) -> DataFrame:
    """Adoption panel of the hierarchical regime."""
    return _panel(spark, sf_dir, corridors, ("hierarchical",)).filter("run = 'hierarchical'").select("t", "id", F.round("adoption", 6).alias("adoption"))


@query()
def diffusion_regimes(spark: SparkSession, sf_dir: str, corridors: bool = False) -> DataFrame:
    """Population share of adoption over time in every regime."""
    return diffusion.shares(_panel(spark, sf_dir, corridors), load(spark, sf_dir, "settlement")).withColumn("share", F.round("share", 6))


def _simulated(regime: str) -> str:
    """The simulation's SQL with another regime's exponents and pull of prestige."""
    alpha, gamma, prestige = diffusion.REGIMES[regime]
    pull = f"pow(ap, {alpha}) * pow(bp, {alpha}) / pow(greatest(km * (1 + resistance), 5), {gamma})"
    return _SIM.replace(_PULL, pull).replace("list(0.6 * (lp", f"list({prestige} * (lp")


SQL["diffusion_regimes"] = " UNION ALL ".join(
    f"SELECT '{r}' AS run, * FROM ({_simulated(r)} SELECT CAST(t AS INT) AS t, round(sum(adoption * population) / sum(population), 6) AS share "
    "FROM panel JOIN settlement USING (id) GROUP BY t)" for r in diffusion.REGIMES)
_FIRST = _SIM + ", fi AS (SELECT id, min(CASE WHEN adoption >= 0.5 THEN t END) AS first_t FROM panel GROUP BY id)"


@query(_FIRST + """ SELECT id, CAST(first_t AS INT) AS first_t, CAST(row_number() OVER (ORDER BY first_t ASC NULLS LAST, population DESC, id) AS INT) AS rank
FROM fi JOIN settlement USING (id)""")
def adoption_order(spark: SparkSession, sf_dir: str, corridors: bool = False) -> DataFrame:
    """When each settlement adopts, in order."""
    o = diffusion.adoption_order(_panel(spark, sf_dir, corridors, ("hierarchical",)), load(spark, sf_dir, "settlement"))
    return o.filter("run = 'hierarchical'").select("id", "first_t", "rank")


@query(_SIM + " SELECT CAST(t AS INT) AS t, round(sum(adoption * population) / sum(population), 6) AS share FROM panel JOIN settlement USING (id) GROUP BY t")
def adoption_share(spark: SparkSession, sf_dir: str, corridors: bool = False) -> DataFrame:
    """Population-weighted adoption of the hierarchical regime."""
    s = diffusion.shares(_panel(spark, sf_dir, corridors, ("hierarchical",)), load(spark, sf_dir, "settlement"))
    return s.filter("run = 'hierarchical'").select("t", F.round("share", 6).alias("share"))


@query(_FIRST + f""", ori AS (SELECT arg_max(lon, (population, id)) AS olon, arg_max(lat, (population, id)) AS olat FROM settlement)
SELECT count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(first_t) >= 1e-9 THEN round(corr(first_t, {haversine_sql('lon', 'lat', 'olon', 'olat')}), 6) END AS by_distance,
CASE WHEN count(*) >= 5 AND stddev_pop(first_t) >= 1e-9 THEN round(corr(first_t, ln(population)), 6) END AS by_size
FROM fi JOIN settlement USING (id), ori WHERE first_t IS NOT NULL""")
def diffusion_signature(spark: SparkSession, sf_dir: str, corridors: bool = False) -> DataFrame:
    """Correlation of adoption time with distance and size."""
    s = load(spark, sf_dir, "settlement")
    order = diffusion.adoption_order(_panel(spark, sf_dir, corridors, ("hierarchical",)), s)
    runs = _origins(spark, sf_dir, ("hierarchical",)).select("run", F.col("origin").alias("oid")).join(s.select(F.col("id").alias("oid"), F.col("lon").alias("olon"), F.col("lat").alias("olat")), "oid")
    km = s.join(F.broadcast(runs), F.lit(True)).select("run", "id", haversine_km(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat")).alias("km"))
    g = diffusion.signature(order, s, km).filter("run = 'hierarchical'")
    return g.select("n", F.round("by_distance", 6).alias("by_distance"), F.round("by_size", 6).alias("by_size"))


#: The same over the graph that interaction_edges_corridors lists; their SQL leaves corridors out.
for _f in (diffusion_graph, diffusion_simulate, diffusion_regimes, adoption_order, adoption_share, diffusion_signature):
    QUERIES[f"{_f.__name__}_corridors"] = partial(_f, corridors=True)
