"""Queries over the interaction graph, feature tables, interpolation and ranking."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.geo import haversine_sql
from terrane.operators import features, gravity
from terrane.operators.radius_join import valid_location
from terrane.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}

FEATURES = (
    "delta_c", "diph_index", "f0_span", "final_rise", "goose_f2", "low_back_merge", "npvi_v", "pct_v", "rhoticity",
    "t_glottal", "th_shift", "trap_bath", "vot_ms", "vowel_area",
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KM = haversine_sql("a.lon", "a.lat", "b.lon", "b.lat")
_CROSS = """((({e}.x2 - {e}.x1) * ({p}.alat - {e}.y1) - ({e}.y2 - {e}.y1) * ({p}.alon - {e}.x1) > 0)
   <> (({e}.x2 - {e}.x1) * ({p}.blat - {e}.y1) - ({e}.y2 - {e}.y1) * ({p}.blon - {e}.x1) > 0)
   AND (({p}.blon - {p}.alon) * ({e}.y1 - {p}.alat) - ({p}.blat - {p}.alat) * ({e}.x1 - {p}.alon) > 0)
   <> (({p}.blon - {p}.alon) * ({e}.y2 - {p}.alat) - ({p}.blat - {p}.alat) * ({e}.x2 - {p}.alon) > 0))""".format(e="e", p="p")
_PAIRS = f"""
WITH p AS (
  SELECT a.id AS a, b.id AS b, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat,
         CAST(a.population AS DOUBLE) AS ap, CAST(b.population AS DOUBLE) AS bp, {_KM} AS km
  FROM settlement a JOIN settlement b ON a.id < b.id
), ring AS (
  SELECT id AS barrier, generate_subscripts(land, 1) - 1 AS ring, unnest(land) AS r FROM study_area
), e AS (
  SELECT barrier, ring, unnest(r[1:-2]).x AS x1, unnest(r[1:-2]).y AS y1, unnest(r[2:]).x AS x2, unnest(r[2:]).y AS y2,
         CAST(0.1 + 0.05 * length(barrier) AS DOUBLE) AS resistance FROM ring
), hit AS (SELECT p.a, p.b, e.barrier, e.resistance FROM p JOIN e ON {_CROSS}),
once AS (SELECT a, b, barrier, max(resistance) AS r FROM hit GROUP BY ALL),
res AS (SELECT a, b, sum(r) AS resistance, count(*) AS crossed FROM once GROUP BY ALL),
kin AS (
  SELECT least(lo, hi) AS a, greatest(lo, hi) AS b, CAST(2.5 AS DOUBLE) AS ancestry FROM
    (SELECT min(id) AS lo, max(id) AS hi FROM settlement GROUP BY country HAVING count(*) > 1)
)"""


def _points(spark, d):
    return load(spark, d, "settlement")


def _barriers(spark, d):
    return gravity.segments(load(spark, d, "study_area")).withColumn("resistance", 0.1 + 0.05 * F.length("barrier"))


def _corridors(spark, d):
    """A corridor per country, from its largest place to the next two."""
    from pyspark.sql.window import Window

    s = load(spark, d, "settlement")
    top = s.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("population"), "id"))).filter("rank <= 3")
    lines = top.groupBy("country").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("line"))
    return lines.filter("size(line) >= 2").select("line", F.lit(0.3).alias("width"))


def _links(spark, d):
    """An ancestry link per country, from its first to its last settlement by id."""
    return load(spark, d, "settlement").groupBy("country").agg(F.min("id").alias("parent_id"), F.max("id").alias("child_id"), F.count("*").alias("n")).filter(
        "n > 1").select("parent_id", "child_id", F.lit(2.5).alias("weight"))


@query(_PAIRS + """
SELECT a, b, round(km, 6) AS km, round(sqrt(ap) * sqrt(bp) / pow(greatest(km, 5), 2), 6) AS weight FROM p WHERE km <= 2500
ORDER BY weight DESC, a, b LIMIT 220""")
def gravity_edges_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 220 strongest gravity edges between settlements."""
    p = gravity.pairs_within(_points(spark, sf_dir))
    w = p.select("a", "b", F.round("km", 6).alias("km"), F.round(gravity.gravity(F.col("ap"), F.col("bp"), F.col("km")), 6).alias("weight"))
    return w.orderBy(F.desc("weight"), "a", "b").limit(220)


@query(_PAIRS + """
SELECT p.a, p.b, coalesce(round(resistance, 6), 0) AS resistance, coalesce(crossed, 0) AS crossed
FROM p LEFT JOIN res ON p.a = res.a AND p.b = res.b WHERE km <= 2500""")
def barrier_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed resistance of the barriers each straight line crosses, each barrier once."""
    r = gravity.resistance(gravity.pairs_within(_points(spark, sf_dir)), _barriers(spark, sf_dir))
    return r.select("a", "b", F.round("resistance", 6).alias("resistance"), "crossed")


@query(_PAIRS + """
SELECT p.a, p.b, coalesce(sum(round(h.resistance, 6)), 0) AS resistance, count(h.a) AS crossed
FROM p LEFT JOIN hit h ON p.a = h.a AND p.b = h.b WHERE km <= 2500 GROUP BY p.a, p.b""")
def barrier_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each crossed segment counted."""
    r = gravity.resistance(gravity.pairs_within(_points(spark, sf_dir)), _barriers(spark, sf_dir), per_segment=True)
    return r.select("a", "b", F.round("resistance", 6).alias("resistance"), "crossed")


@query(_PAIRS + """
SELECT p.a, p.b, round(km, 6) AS km, round(km * (1 + coalesce(resistance, 0)), 6) AS effective, coalesce(crossed, 0) AS crossed, ancestry,
       round(sqrt(ap) * sqrt(bp) / pow(greatest(km * (1 + coalesce(resistance, 0)), 5), 2) * coalesce(ancestry, 1), 6) AS weight
FROM p LEFT JOIN res ON p.a = res.a AND p.b = res.b LEFT JOIN kin ON p.a = kin.a AND p.b = kin.b WHERE km <= 2500 OR ancestry IS NOT NULL""")
def interaction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interaction graph with effective distances and ancestry."""
    e = gravity.interaction_edges(_points(spark, sf_dir), _barriers(spark, sf_dir), _links(spark, sf_dir))
    return e.select("a", "b", *[F.round(c, 6).alias(c) for c in ("km", "effective", "weight")], "crossed", "ancestry")


@query("""
SELECT country, count(*) AS n, CAST(sum(population) AS BIGINT) AS people, max_by(name, (population, id)) AS largest, list_sort(list(id)) AS ids
FROM settlement GROUP BY country HAVING count(*) >= 2""")
def country_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements of each country with the largest as its label."""
    return load(spark, sf_dir, "settlement").groupBy("country").agg(
        F.count("*").alias("n"), F.sum("population").alias("people"),
        F.max_by("name", F.struct("population", "id")).alias("largest"), F.sort_array(F.collect_list("id")).alias("ids")).filter("n >= 2")


_VALID = "NOT isnan({t}.lon) AND NOT isnan({t}.lat) AND {t}.lat BETWEEN -90 AND 90 AND {t}.lon BETWEEN -180 AND 180"


def _located(df: DataFrame, turned: bool = False) -> DataFrame:
    """Rows on the globe; ``turned`` also takes longitudes up to 360, brought to -180..180, and leaves out (0, 0)."""
    if turned:
        x = F.col("lon").cast("double")
        return df.filter(valid_location(x, F.col("lat").cast("double"))).withColumn("lon", F.when(x > 180, x - 360).otherwise(x))
    return df.filter(~F.isnan("lon") & ~F.isnan("lat") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


@query(f"""
SELECT s.id, arg_min(b.id, (km, b.id)) AS place, round(min(km), 6) AS km FROM (SELECT a.id, b.id AS bid, {_KM} AS km FROM site a, settlement b
WHERE {_VALID.format(t='a')}) s JOIN settlement b ON b.id = s.bid GROUP BY s.id""")
def nearest_place(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """The settlement nearest each site."""
    places = load(spark, sf_dir, "settlement").select(F.col("id").alias("place"), F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    near = features.nearest(_located(load(spark, sf_dir, "site"), turned).select("id", "lon", "lat"), places)
    return near.select("id", "place", F.round("km", 6).alias("km"))


_ONCE = "(SELECT DISTINCT id, lang, country, settlement, lon, lat, " + ", ".join(
    f"CASE WHEN isfinite({k}) THEN CAST({k} AS DOUBLE) END AS {k}" for k in FEATURES) + " FROM seed_site)"


def _seeds(spark, d):
    """Survey records, repeats once, features that aren't finite null."""
    s = load(spark, d, "seed_site")
    return s.select("id", "lang", "country", "settlement", "lon", "lat", *[features.finite(F.col(k)).alias(k) for k in FEATURES]).distinct()


@query(f"""
WITH v AS (SELECT q.id AS q, s.id, s.lon, s.lat, q.lon AS qlon, q.lat AS qlat, goose_f2 AS value,
  row_number() OVER (PARTITION BY q.id ORDER BY (s.lon - q.lon) ** 2 + (s.lat - q.lat) ** 2, s.id) AS rank
  FROM {_ONCE} s, settlement q WHERE goose_f2 BETWEEN 0 AND 1 AND {_VALID.format(t='s')}),
z AS (SELECT q, value, pow({haversine_sql('lon', 'lat', 'qlon', 'qlat')} / 180, 2) AS z FROM v WHERE rank <= 24),
w AS (SELECT q, value, exp(min(z) OVER (PARTITION BY q) - z) AS w FROM z)
SELECT q, count(*) AS n, round(sum(value * w) / sum(w), 6) AS value FROM w GROUP BY q""")
def knn_surface(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """The goose_f2 surface at every settlement, from the 24 nearest sites."""
    queries = load(spark, sf_dir, "settlement").select(F.col("id").alias("q"), F.col("lon").alias("qlon"), F.col("lat").alias("qlat"))
    sites = _located(_seeds(spark, sf_dir), turned).filter(F.col("goose_f2").between(0, 1)).select("id", "lon", "lat", F.col("goose_f2").alias("value"))
    return features.neighbourhood_mean(queries, sites).select("q", "n", F.round("value", 6).alias("value"))


_LONG = "WITH long AS (SELECT id, key, value FROM (SELECT id, " + ", ".join(FEATURES) + f" FROM {_ONCE}) UNPIVOT (value FOR key IN ({', '.join(FEATURES)})))"


@query(_LONG + " SELECT id, key, round(value, 6) AS value FROM long")
def unpivot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey sheet as long rows."""
    return features.to_long(_seeds(spark, sf_dir), "id", list(FEATURES)).withColumn("value", F.round("value", 6))


@query(_LONG + " SELECT id, " + ", ".join(f"round(avg(value) FILTER (WHERE key = '{k}'), 6) AS {k}" for k in FEATURES) + " FROM long GROUP BY id")
def pivot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows back to one row per site."""
    w = features.to_wide(features.to_long(_seeds(spark, sf_dir), "id", list(FEATURES)), list(FEATURES))
    return w.select("id", *[F.round(k, 6).alias(k) for k in FEATURES])


@query(_LONG + """ SELECT id, key, round((value - lo) / (hi - lo), 6) AS x, round(lo + greatest(0, least(1, (value - lo) / (hi - lo))) * (hi - lo), 6) AS clamped
FROM long JOIN (SELECT key, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM accent_feature) USING (key)""")
def normalise_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features on their scales, and clamped back."""
    scale = load(spark, sf_dir, "accent_feature").select("key", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    x = features.to_long(_seeds(spark, sf_dir), "id", list(FEATURES)).join(scale, "key").withColumn("x", features.scaled(F.col("value"), F.col("lo"), F.col("hi")))
    clamped = features.unscaled(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x"))), F.col("lo"), F.col("hi"))
    return x.select("id", "key", F.round("x", 6).alias("x"), F.round(clamped, 6).alias("clamped"))


@query(_LONG + """ SELECT key, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS median,
round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM long GROUP BY key""")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, deviation and exact percentiles of every feature."""
    s = features.summary(features.to_long(_seeds(spark, sf_dir), "id", list(FEATURES)))
    return s.select("key", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median", "p05", "p95")])


_CENTRES = _LONG + """, scaled AS (
  SELECT settlement AS id, key, avg((value - lo) / (hi - lo)) AS value FROM long JOIN (SELECT DISTINCT id, settlement FROM seed_site) USING (id)
  JOIN (SELECT key, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM accent_feature) USING (key)
  WHERE value BETWEEN lo AND hi AND settlement IS NOT NULL GROUP BY settlement, key)"""


def settlement_vectors(spark, d) -> DataFrame:
    """(id, key, value): mean scaled feature of each settlement, from values on their scale."""
    scale = load(spark, d, "accent_feature").select("key", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    s = _seeds(spark, d)
    long = features.to_long(s, "id", list(FEATURES)).join(s.select("id", "settlement").distinct(), "id").join(scale, "key")
    return long.filter("value BETWEEN lo AND hi AND settlement IS NOT NULL").groupBy(F.col("settlement").alias("id"), "key").agg(
        F.avg(features.scaled(F.col("value"), F.col("lo"), F.col("hi"))).alias("value"))


@query(_CENTRES + """ SELECT x.id AS a, y.id AS b, count(*) AS n, round(sqrt(sum(pow(x.value - y.value, 2)) / count(*)), 6) AS distance
FROM scaled x JOIN scaled y ON x.key = y.key AND x.id < y.id GROUP BY ALL""")
def pairwise_feature_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMS feature distance of every two settlements over the features both have."""
    return features.pair_distances(settlement_vectors(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query(_CENTRES + """, probe AS (SELECT key, 0.4 + 0.01 * length(key) AS x, 0.5 + 0.02 * length(key) AS reliability FROM accent_feature),
d AS (SELECT id, round(sqrt(sum(reliability * pow(value - x, 2)) / sum(reliability)), 9) AS distance FROM scaled JOIN probe USING (key) GROUP BY id)
SELECT id, round(distance, 6) AS distance, round(exp(-3 * distance), 6) AS similarity FROM d ORDER BY d.distance, id LIMIT 6""")
def nearest_varieties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six settlements most like a probe vector."""
    probe = load(spark, sf_dir, "accent_feature").select("key", (0.4 + 0.01 * F.length("key")).alias("x"), (0.5 + 0.02 * F.length("key")).alias("reliability"))
    d = features.weighted_distance(settlement_vectors(spark, sf_dir), probe).withColumn("distance", F.round("distance", 9))
    top = d.orderBy("distance", "id").limit(6)
    return top.select("id", F.round("distance", 6).alias("distance"), F.round(F.exp(-3 * F.col("distance")), 6).alias("similarity"))


@query(f"""
SELECT lang, count(*) AS n, round(corr(f0_span, final_rise), 6) AS r, round(regr_slope(f0_span, final_rise), 6) AS slope
FROM {_ONCE} WHERE lang IS NOT NULL AND f0_span IS NOT NULL AND final_rise IS NOT NULL GROUP BY lang HAVING count(*) >= 3""")
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and slope of two features in each language, from three records on."""
    s = _seeds(spark, sf_dir).filter("lang IS NOT NULL AND f0_span IS NOT NULL AND final_rise IS NOT NULL")
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.corr("f0_span", "final_rise"), 6).alias("r"),
                                 F.round(F.regr_slope("f0_span", "final_rise"), 6).alias("slope")).filter("n >= 3")


@query("""
SELECT a.id, count(s.id) AS n_sites, coalesce(sum(CASE WHEN s.id IS NOT NULL THEN coalesce(s.population, 50000) END), 0) AS people FROM settlement a LEFT JOIN site s ON s.settlement_id = a.id GROUP BY a.id""")
def settlement_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites per settlement and their population, 50,000 where unknown."""
    site = load(spark, sf_dir, "site").select("settlement_id", F.coalesce("population", F.lit(50000.0)).alias("p"))
    per = site.groupBy("settlement_id").agg(F.count("*").alias("n_sites"), F.sum("p").alias("people"))
    s = load(spark, sf_dir, "settlement").select("id")
    return s.join(per, s["id"] == per["settlement_id"], "left").select(
        "id", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.coalesce("people", F.lit(0.0)).alias("people"))


@query("""
SELECT DISTINCT ON (code) code, source FROM (
  SELECT lower(trim(lang)) AS code, 1 AS rank, 'documents' AS source FROM documents UNION ALL SELECT lower(trim(language)), 2, 'site' FROM site
  UNION ALL SELECT lower(trim(lang)), 3, 'seed_site' FROM seed_site) WHERE length(code) = 2 AND code IN (SELECT lang FROM seed_site) ORDER BY code, rank""")
def inventory_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known language codes by the first table that names them."""
    from pyspark.sql.window import Window

    parts = [(1, "documents", "lang"), (2, "site", "language"), (3, "seed_site", "lang")]
    union = None
    for rank, table, column in parts:
        p = load(spark, sf_dir, table).select(F.lower(F.trim(column)).alias("code"), F.lit(rank).alias("rank"), F.lit(table).alias("source")).distinct()
        union = p if union is None else union.unionByName(p)
    known = load(spark, sf_dir, "seed_site").select(F.col("lang").alias("code")).distinct()
    w = Window.partitionBy("code").orderBy("rank")
    return union.filter(F.length("code") == 2).join(known, "code", "left_semi").withColumn("n", F.row_number().over(w)).filter("n = 1").select("code", "source")


@query(" UNION ALL ".join(f"SELECT '{t}' AS layer, count(*) AS n FROM {t}" for t in ("settlement", "study_area", "site", "site_feature", "frames", "documents")))
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each layer."""
    union = None
    for t in ("settlement", "study_area", "site", "site_feature", "frames", "documents"):
        p = load(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("layer"), "n")
        union = p if union is None else union.unionByName(p)
    return union


@query("""
SELECT c_custkey, round((CAST('0x' || sha256('7:' || c_name)[1:8] AS BIGINT)) / 4294967295.0, 9) AS roll FROM customer""")
def token_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed roll in 0..1 per token: the leading four bytes of its digest."""
    roll = F.conv(F.substring(F.sha2(F.concat(F.lit("7:"), "c_name"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return load(spark, sf_dir, "customer").select("c_custkey", F.round(roll, 9).alias("roll"))


@query("""
SELECT n_name, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS yes, count(*) FILTER (WHERE o_orderstatus <> 'F') AS no,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / nullif(sum(o_totalprice), 0), 6) AS share
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional aggregates over a three-way join."""
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    yes = F.col("o_orderstatus") == "F"
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(
        F.count("*").alias("n"), F.count_if(yes).alias("yes"), F.count_if(~yes).alias("no"),
        F.round(F.try_divide(F.sum(F.when(yes, F.col("o_totalprice"))), F.sum("o_totalprice")), 6).alias("share"))


@query()
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study areas as one GeoJSON feature each."""
    from terrane.sources import geojson

    return geojson.features(load(spark, sf_dir, "study_area"), "land", ["id", "name"])


@query()
def corridor_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective distance where the straight line runs along a corridor."""
    c = gravity.corridor_share(gravity.pairs_within(_points(spark, sf_dir)), _corridors(spark, sf_dir))
    return c.filter("corridor > 0").select("a", "b", F.round("corridor", 6).alias("corridor"),
                                           F.round(gravity.effective_km(F.col("km"), F.lit(0.0), F.col("corridor")), 6).alias("effective"))


@query()
def interaction_edges_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interaction graph with the share of each line that runs along a corridor taken into its effective distance."""
    e = gravity.interaction_edges(_points(spark, sf_dir), _barriers(spark, sf_dir), _links(spark, sf_dir), corridors=_corridors(spark, sf_dir))
    return e.select("a", "b", *[F.round(c, 6).alias(c) for c in ("km", "effective", "corridor", "weight")], "crossed", "ancestry")


def _turned_sql(table: str) -> str:
    return f"(SELECT * REPLACE (CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon) FROM {table} WHERE lon BETWEEN -180 AND 360 AND NOT (lon = 0 AND lat = 0))"


#: The same with sites delivered as 0..360 degrees east, which the plain ones and their SQL leave out above 180.
for _f, _table, _alias in ((nearest_place, "site", "a"), (knn_surface, _ONCE, "s")):
    QUERIES[f"{_f.__name__}_turned"] = partial(_f, turned=True)
    SQL[f"{_f.__name__}_turned"] = SQL[_f.__name__].replace(f"FROM {_table} {_alias},", f"FROM {_turned_sql(_table)} {_alias},")
