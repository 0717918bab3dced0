"""Queries of the general training-data problems (p1, p2, p3, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.geo import haversine_sql
from terrane.operators import impute, radius_join, wide_table
from terrane.operators import spikes as _spikes
from terrane.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings that can't be speech of their source."""
    return _spikes.spikes(load(spark, sf_dir, "frames")).select("utt_id", "frame_no", "field")


@query
def p3_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings of each source and field are implausible."""
    return _spikes.spikes(load(spark, sf_dir, "frames")).groupBy("source_id", "field").agg(F.count("*").alias("n"))


@query
def p3_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the normal values of each source by hour of the day as well."""
    return _spikes.spikes(load(spark, sf_dir, "frames"), ["speech", "hour"]).select("utt_id", "frame_no", "field")


@query
def p3_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that changed implausibly since the frame before."""
    return _spikes.jumps(load(spark, sf_dir, "frames")).select("utt_id", "frame_no", "field")


_P3 = """
WITH f AS (
  SELECT DISTINCT ON (utt_id, frame_no) utt_id, frame_no, source_id, speech, energy, f0, fmt FROM frames
  WHERE utt_id IS NOT NULL AND frame_no IS NOT NULL
), long AS (
  SELECT utt_id, frame_no, source_id, speech, unnest(['f0','f1','f2','f3','f4','energy']) AS pos,
         unnest([f0, fmt[1], fmt[2], fmt[3], fmt[4], energy]) AS raw FROM f
), r AS (
  SELECT * EXCLUDE raw, CASE WHEN pos[1:1] = 'f' AND pos <> 'f0' THEN 'fmt' ELSE pos END AS field,
         CASE WHEN isnan(raw) THEN NULL ELSE raw END AS x FROM long
), prior AS (
  SELECT *, max(CASE WHEN field = 'fmt' THEN x END) OVER (PARTITION BY utt_id, frame_no, field ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below,
         CASE WHEN x = lag(x) OVER w AND frame_no = lag(frame_no) OVER w + 1 THEN 0 ELSE 1 END AS starts FROM r
  WINDOW w AS (PARTITION BY utt_id, pos ORDER BY frame_no)
), runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY utt_id, pos ORDER BY frame_no) AS run FROM prior
), sized AS (
  SELECT *, count(x) OVER (PARTITION BY utt_id, pos, run) AS length FROM runs
), q AS (
  SELECT source_id, speech, pos, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi
  FROM r WHERE isfinite(x) GROUP BY ALL
), flagged AS (
  SELECT s.utt_id, s.frame_no, s.source_id, s.field FROM sized s LEFT JOIN q
    ON q.source_id IS NOT DISTINCT FROM s.source_id AND q.speech IS NOT DISTINCT FROM s.speech AND q.pos = s.pos
  WHERE x IS NOT NULL AND (isinf(x) OR length >= 12 OR x < lo - (hi - lo) OR x > hi + (hi - lo)
    OR (field = 'f0' AND (x < 30 OR x > 1000)) OR (field = 'energy' AND (x < -120 OR x > 0))
    OR (field = 'fmt' AND (x < 50 OR x > 8000 OR x <= below)))
)
"""
SQL["p3_hourly"] = _P3.replace("speech, energy, f0, fmt FROM", "speech, hour(ts) AS hour, energy, f0, fmt FROM").replace(
    "source_id, speech, ", "source_id, speech, hour, ").replace("source_id, speech, hour, hour(ts) AS hour", "source_id, speech, hour(ts) AS hour").replace(
    "AND q.pos = s.pos", "AND q.hour IS NOT DISTINCT FROM s.hour AND q.pos = s.pos") + "SELECT DISTINCT utt_id, frame_no, field FROM flagged"
SQL["p3_jumps"] = _P3.split(", prior AS")[0] + """, c AS (
  SELECT *, CASE WHEN frame_no = lag(frame_no) OVER w + 1 THEN abs(x - lag(x) OVER w) END AS d FROM r WINDOW w AS (PARTITION BY utt_id, pos ORDER BY frame_no)
), q AS (SELECT source_id, speech, pos, quantile_cont(d, 0.05) AS lo, quantile_cont(d, 0.95) AS hi FROM c WHERE isfinite(d) GROUP BY ALL)
SELECT DISTINCT utt_id, frame_no, field FROM c JOIN q ON q.source_id IS NOT DISTINCT FROM c.source_id AND q.speech IS NOT DISTINCT FROM c.speech AND q.pos = c.pos
WHERE d > hi + (hi - lo)"""
SQL["p3_found"] = _P3 + "SELECT DISTINCT utt_id, frame_no, field FROM flagged"
SQL["p3_source_report"] = _P3 + """
SELECT source_id, field, count(DISTINCT (utt_id, frame_no)) AS n FROM flagged GROUP BY ALL"""


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sites at most 1 km apart."""
    return radius_join.near_pairs(load(spark, sf_dir, "seed_site"), "id").select("id_a", "id_b")


@query
def p1_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each located site with its study area, its number of neighbours within 1 km and their population."""
    seeds = load(spark, sf_dir, "seed_site")
    people = load(spark, sf_dir, "site").groupBy("id").agg(F.max("population").alias("value"))
    near = radius_join.neighbour_sums(seeds, "id", people)
    held = radius_join.containing_region(seeds, "id", load(spark, sf_dir, "study_area"))
    return held.join(near, "id", "left").select("id", "region", "n", F.col("total").alias("neighbour_population")).withColumnRenamed("n", "n_neighbours")


_P1 = f"""
WITH loc AS (
  SELECT DISTINCT id, CASE WHEN lon > 180 THEN lon - 360 WHEN lon = -180 THEN 180 ELSE lon END AS lon, lat FROM seed_site
  WHERE id IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 360
    AND NOT (lon = 0 AND lat = 0)
), pairs AS (
  SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM loc a JOIN loc b ON a.id < b.id AND abs(a.lat - b.lat) < 0.01
    AND {haversine_sql("a.lon", "a.lat", "b.lon", "b.lat")} <= 1.0
)"""
SQL["p1_found"] = _P1 + " SELECT id_a, id_b FROM pairs"
SQL["p1_shown"] = _P1 + """, ends AS (
  SELECT id_a AS id, id_b AS other FROM pairs UNION ALL SELECT id_b, id_a FROM pairs
), near AS (
  SELECT e.id, count(*) AS n, sum(s.population) AS neighbour_population FROM ends e LEFT JOIN site s ON s.id = e.other GROUP BY e.id
), edges AS (
  SELECT id AS region, ring, unnest(ring[1:-2]) AS p, unnest(ring[2:]) AS q FROM (SELECT id, unnest(land) AS ring FROM study_area)
), inside AS (
  SELECT loc.id, region FROM loc, edges WHERE (p.y > lat) <> (q.y > lat) AND lon < (q.x - p.x) * (lat - p.y) / (q.y - p.y) + p.x
  GROUP BY loc.id, loc.lon, loc.lat, region HAVING count(*) % 2 = 1
)
SELECT i.id, min(region) AS region, coalesce(max(n), 0) AS n_neighbours, max(neighbour_population) AS neighbour_population
FROM (SELECT DISTINCT id FROM loc) i LEFT JOIN inside USING (id) LEFT JOIN near USING (id) GROUP BY i.id
"""


#: Attributes that the wide table shows even where nobody has them.
_RARE = ("breath_rate", "creak_share", "hum_level_db", "lateral_index", "nasal_leak", "tap_rate", "tempo_syl_s", "yod_share")
_DOUBLES = (
    "delta_c", "diph_index", "f0_span", "final_rise", "goose_f2", "low_back_merge", "npvi_v", "pct_v", "rhoticity",
    "t_glottal", "th_shift", "trap_bath", "vot_ms", "vowel_area", *_RARE,
)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_table.wide(load(spark, sf_dir, "site_feature"), load(spark, sf_dir, "site"), always=(*_DOUBLES, *wide_table.TYPES))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled cells of the wide table."""
    return wide_table.filled_cells(_wide(spark, sf_dir))


@query
def p2_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed row per registered site."""
    return _wide(spark, sf_dir)


_P2 = r"""
WITH named AS (
  SELECT site_id, nullif(regexp_replace(lower(regexp_replace(regexp_replace(trim(key), '([\p{Ll}0-9])(\p{Lu})', '\1_\2', 'g'),
         '[^\p{L}0-9]+', '_', 'g')), '^_+|_+$', '', 'g'), '') AS attr, trim(value) AS v, loaded_at FROM site_feature
), r AS (
  SELECT n.site_id, attr, loaded_at, v, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?\s*(ms|st|%|index|units)?')
         THEN TRY_CAST(replace(regexp_replace(v, '\s*(ms|st|%|index|units)$', ''), ',', '.') AS DOUBLE) END AS x,
         CASE WHEN lower(v) IN ('true','yes','y','t','1') THEN true WHEN lower(v) IN ('false','no','n','f','0') THEN false END AS b,
         TRY_CAST(CASE WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN v
              WHEN regexp_full_match(v, '[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}') THEN replace(v, '/', '-')
              WHEN regexp_full_match(v, '[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}') THEN regexp_replace(v, '(.*)[.](.*)[.](.*)', '\3-\2-\1')
              WHEN regexp_full_match(v, '[0-9]{8}') THEN v[1:4] || '-' || v[5:6] || '-' || v[7:8] END AS DATE) AS d,
         CASE WHEN regexp_full_match(upper(v), '[A-Z][0-9]{3}') THEN upper(v) END AS c
  FROM named n SEMI JOIN site s ON s.id = n.site_id
), k AS (
  SELECT *, CASE WHEN attr IN ('survey_year', 'speaker_count') THEN CASE WHEN x = floor(x) THEN x END
              WHEN attr IN ('is_urban', 'transcribed') THEN CAST(CAST(b AS INT) AS DOUBLE)
              WHEN attr = 'first_visit' THEN CAST(d - DATE '1970-01-01' AS DOUBLE)
              WHEN attr = 'recordist' THEN NULL ELSE x END AS num, CASE WHEN attr = 'recordist' THEN c END AS txt FROM r
), cell AS (
  SELECT site_id, attr, arg_max(num, (coalesce(loaded_at, TIMESTAMP '1000-01-01'), num)) AS num, arg_max(txt, (coalesce(loaded_at, TIMESTAMP '1000-01-01'), txt)) AS txt
  FROM k WHERE attr IS NOT NULL AND (num IS NOT NULL OR txt IS NOT NULL) GROUP BY ALL
)"""
SQL["p2_found"] = _P2 + " SELECT site_id, attr FROM cell"
_MAX = "max(num) FILTER (WHERE attr = '{0}')"
SQL["p2_wide"] = _P2 + " SELECT site_id, " + ", ".join(
    [_MAX.format(a) + f" AS {a}" for a in _DOUBLES]
    + [f"CAST({_MAX.format(a)} AS BIGINT) AS {a}" for a in ("survey_year", "speaker_count")]
    + [f"CAST({_MAX.format(a)} AS BOOLEAN) AS {a}" for a in ("is_urban", "transcribed")]
    + [f"DATE '1970-01-01' + CAST({_MAX.format('first_visit')} AS INT) AS first_visit", "max(txt) AS recordist"]
) + " FROM cell GROUP BY site_id"


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.fill_sites(*[load(spark, sf_dir, t) for t in ("site", "seed_site", "spatial_model", "accent_feature")])


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The missing cells that were filled."""
    return _filled(spark, sf_dir).select("tab", "id", "field")


@query
def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filled cell with its value."""
    return _filled(spark, sf_dir)


@query
def p5_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites with languages filled and marked."""
    return impute.with_flags(load(spark, sf_dir, "site"), "id", "language", _filled(spark, sf_dir), "site", "text").select(
        "id", "language", "language_filled")


@query
def p5_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the fills on known cells that were hidden, beside that of the group's mean or commonest value."""
    return impute.held_out(*[load(spark, sf_dir, t) for t in ("site", "seed_site", "spatial_model", "accent_feature")])


SQL["p5_found"] = r"""
WITH s AS (
  SELECT id, country, settlement_id, CASE WHEN regexp_full_match(lower(trim(language)), '[a-z]{2}') AND lower(trim(language)) <> 'xx'
         THEN lower(trim(language)) END AS l FROM site
), d AS (
  SELECT id, country, CASE WHEN regexp_full_match(lower(trim(lang)), '[a-z]{2}') AND lower(trim(lang)) <> 'xx' THEN lower(trim(lang)) END AS l,
         CASE WHEN NOT isnan(low_back_merge) AND low_back_merge BETWEEN 0 AND 1 THEN low_back_merge END AS x FROM seed_site
), k AS (
  SELECT key, row_number() OVER (ORDER BY key) AS i FROM accent_feature
), m AS (
  SELECT site_id AS id, country, l, key, CASE WHEN NOT isnan(norm_values[i]) AND norm_values[i] BETWEEN 0 AND 1 THEN norm_values[i] END AS x
  FROM spatial_model JOIN k ON true JOIN s ON s.id = site_id
)
SELECT 'site' AS tab, id, 'language' AS field FROM s WHERE l IS NULL AND settlement_id IN (SELECT settlement_id FROM s WHERE l IS NOT NULL)
UNION SELECT 'seed_site', id, 'low_back_merge' FROM d WHERE x IS NULL AND (country, l) IN (SELECT (country, l) FROM d WHERE x IS NOT NULL AND l IS NOT NULL)
UNION SELECT 'spatial_model', id, m.key FROM m WHERE x IS NULL AND (country, l, key) IN (SELECT (country, l, key) FROM m WHERE x IS NOT NULL AND l IS NOT NULL)
"""
