"""Queries over frame time series and symbol sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import language, sequences
from terrane.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_F = """
WITH f AS (SELECT DISTINCT ON (utt_id, frame_no) utt_id, frame_no, source_id, speech, CAST(voicing AS DOUBLE) AS voicing,
  CASE WHEN isfinite(energy) THEN energy END AS energy, CASE WHEN isfinite(f0) THEN f0 END AS f0, fmt FROM frames ORDER BY ALL)"""


def _finite(name: str):
    return F.when(~F.isnan(name) & (F.abs(name) < float("inf")), F.col(name)).alias(name)


def _frames(spark, d) -> DataFrame:
    f = load(spark, d, "frames").select("utt_id", "frame_no", "source_id", "speech", F.col("voicing").cast("double").alias("voicing"), _finite("energy"), _finite("f0"))
    return sequences.unique_frames(f)


@query(_F + """, c AS (SELECT *, CASE WHEN speech = lag(speech) OVER w THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY utt_id ORDER BY frame_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY utt_id ORDER BY frame_no) AS run FROM c)
SELECT utt_id, CAST(run AS BIGINT) AS run, any_value(speech) AS state, min(frame_no) AS start, max(frame_no) AS "end", count(*) AS length FROM r GROUP BY utt_id, run""")
def speech_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of speech and silence in each utterance."""
    return sequences.runs(_frames(spark, sf_dir), "utt_id", "frame_no", F.col("speech"))


_VAD = _F + """, l AS (SELECT utt_id, quantile_cont(energy, 0.1) AS lo, quantile_cont(energy, 0.95) AS hi FROM f GROUP BY utt_id),
v AS (SELECT f.*, coalesce(energy > lo + 0.25 * greatest(hi - lo, 6), false) OR coalesce(voicing > 0.55, false) AS active FROM f JOIN l USING (utt_id)),
closed AS (SELECT * EXCLUDE active, active OR (coalesce(lag(active) OVER w, false) AND coalesce(lead(active) OVER w, false)) AS active FROM v
  WINDOW w AS (PARTITION BY utt_id ORDER BY frame_no))"""


@query(_VAD + """, c AS (SELECT *, CASE WHEN active = lag(active) OVER w THEN 0 ELSE 1 END AS new FROM closed WINDOW w AS (PARTITION BY utt_id ORDER BY frame_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY utt_id ORDER BY frame_no) AS run FROM c)
SELECT utt_id, min(frame_no) AS start, max(frame_no) AS "end", count(*) AS length FROM r WHERE active GROUP BY utt_id, run HAVING count(*) >= 4""")
def vad_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice activity: gaps of one frame closed, runs under four frames dropped."""
    active = sequences.voice_activity(_frames(spark, sf_dir))
    return sequences.long_runs(sequences.close_gaps(active, "utt_id", "frame_no", "active"), "utt_id", "frame_no", "active")


@query(_F + """, s AS (SELECT utt_id, frame_no, f0, median(f0) OVER w AS m, count(f0) OVER w AS n FROM f
  WINDOW w AS (PARTITION BY utt_id ORDER BY frame_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT utt_id, frame_no, round(CASE WHEN f0 IS NOT NULL AND n >= 3 THEN m END, 6) AS smooth FROM s""")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch track through a five-frame median."""
    return sequences.median_filter(_frames(spark, sf_dir), "utt_id", "frame_no", "f0").select("utt_id", "frame_no", F.round("smooth", 6).alias("smooth"))


@query("""
SELECT vec_id, "at", round(x - 0.97 * coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY "at"), 0), 6) AS sharp FROM
(SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS "at" FROM embeddings)""")
def preemphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-emphasis of sample vectors."""
    x = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    return sequences.pre_emphasis(x, "vec_id", "at", "x").select("vec_id", F.col("at").cast("long").alias("at"), F.round("sharp", 6).alias("sharp"))


@query("""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)
SELECT vec_id, CAST(k AS BIGINT) AS frame, round(list_sum(list_transform(e[k*8+1:k*8+16], lambda v: v * v)), 6) AS power FROM x, range(7) t(k)""")
def framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of 16-sample frames every 8 samples."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    starts = F.sequence(F.lit(0), F.floor((F.size("e") - 16) / 8))
    power = F.aggregate(F.slice("e", (F.col("frame") * 8 + 1).cast("int"), 16), F.lit(0.0), lambda a, v: a + v * v)
    return e.filter(F.size("e") >= 16).select("vec_id", "e", F.explode(starts).alias("frame")).select("vec_id", "frame", F.round(power, 6).alias("power"))


@query("""
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings),
b AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * n / 64)) AS re, sum(x * sin(2 * pi() * k * n / 64)) AS im FROM x, range(33) t(k) GROUP BY ALL)
SELECT vec_id, CAST(k AS BIGINT) AS bin, round((re * re + im * im) / 64, 6) AS power FROM b""")
def power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of the 33 non-negative frequencies of 64-sample vectors."""
    x = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("n", "x"))
    t = x.select("vec_id", "n", F.col("x").cast("double").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k"))
    turn = 2 * F.pi() * F.col("k") * F.col("n") / 64
    b = t.groupBy("vec_id", "k").agg(F.sum(F.col("x") * F.cos(turn)).alias("re"), F.sum(F.col("x") * F.sin(turn)).alias("im"))
    return b.select("vec_id", F.col("k").cast("long").alias("bin"), F.round((F.col("re") ** 2 + F.col("im") ** 2) / 64, 6).alias("power"))


_RUN = _F + """, c AS (SELECT *, CASE WHEN speech = lag(speech) OVER w THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY utt_id ORDER BY frame_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY utt_id ORDER BY frame_no) AS run FROM c),
runs AS (SELECT utt_id, run, any_value(speech) AS state, min(frame_no) AS start, count(*) * 10.0 AS ms FROM r GROUP BY utt_id, run)"""


@query(_RUN + """, d AS (SELECT utt_id, ms, lag(ms) OVER (PARTITION BY utt_id ORDER BY start) AS before FROM runs WHERE state)
SELECT utt_id, count(*) AS n, round(avg(100 * abs(ms - before) / ((ms + before) / 2)), 6) AS npvi FROM d WHERE before IS NOT NULL GROUP BY utt_id""")
def npvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise variability of the voiced stretches of each utterance."""
    r = sequences.runs(_frames(spark, sf_dir), "utt_id", "frame_no", F.col("speech")).filter("state").withColumn("ms", F.col("length") * 10.0)
    return sequences.pairwise_variability(r, "utt_id", "start", "ms").withColumn("npvi", F.round("npvi", 6))


@query(_RUN + """ SELECT utt_id, count(*) AS n, round(stddev_pop(ms), 6) AS spread, round(100 * sum(CASE WHEN state THEN ms END) / sum(ms), 6) AS share
FROM runs GROUP BY utt_id""")
def interval_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population deviation of the interval lengths and the share of speech."""
    r = sequences.runs(_frames(spark, sf_dir), "utt_id", "frame_no", F.col("speech")).withColumn("ms", F.col("length") * 10.0)
    return r.groupBy("utt_id").agg(F.count("*").alias("n"), F.round(F.stddev_pop("ms"), 6).alias("spread"),
                                   F.round(100 * F.sum(F.when(F.col("state"), F.col("ms"))) / F.sum("ms"), 6).alias("share"))


@query(_RUN + """, ends AS (SELECT utt_id, start AS "at" FROM runs WHERE NOT state)
SELECT e.utt_id, "at", min(CASE WHEN voicing > 0.6 THEN frame_no END) AS first FROM ends e JOIN f ON f.utt_id = e.utt_id AND frame_no BETWEEN "at" AND "at" + 13 GROUP BY ALL""")
def vot_forward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first voiced frame within 14 frames from each onset of silence."""
    f = _frames(spark, sf_dir)
    onsets = sequences.runs(f, "utt_id", "frame_no", F.col("speech")).filter(~F.col("state")).select("utt_id", F.col("start").alias("frame_no"))
    return sequences.forward_asof(onsets, f, "utt_id")


@query(_F + """, t AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY frame_no DESC) AS rank FROM f WHERE f0 IS NOT NULL)
SELECT utt_id, count(*) AS n, round(regr_slope(f0, frame_no), 6) AS slope FROM t WHERE rank <= 30 GROUP BY utt_id""")
def final_rise_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the last 30 resolved pitch frames."""
    return sequences.final_slope(_frames(spark, sf_dir), "utt_id", "frame_no", "f0").withColumn("slope", F.round("slope", 6))


@query(_F + """, s AS (SELECT source_id, avg(energy) AS m, stddev_pop(energy) AS d FROM f GROUP BY source_id)
SELECT utt_id, frame_no, round((energy - m) / greatest(d, 1e-6), 5) AS z FROM f JOIN s USING (source_id)""")
def lobanov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each frame normalised by its source."""
    return sequences.lobanov(_frames(spark, sf_dir), "source_id", "energy").select("utt_id", "frame_no", F.round("z", 5).alias("z"))


@query(_F + """ SELECT source_id, count(f0) AS n, round(quantile_cont(f0, 0.1), 6) AS p10, round(quantile_cont(f0, 0.5), 6) AS p50, round(quantile_cont(f0, 0.9), 6) AS p90,
round(12 * log2(quantile_cont(f0, 0.9) / quantile_cont(f0, 0.1)), 6) AS span_st FROM f WHERE f0 > 0 AND voicing > 0.6 GROUP BY source_id""")
def pitch_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch percentiles of each source and their span in semitones."""
    f = _frames(spark, sf_dir).filter("f0 > 0 AND voicing > 0.6").groupBy("source_id").agg(
        F.count("f0").alias("n"), F.percentile("f0", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    p = [F.col("p")[i] for i in range(3)]
    return f.select("source_id", "n", *[F.round(x, 6).alias(f"p{q}") for x, q in zip(p, (10, 50, 90))], F.round(12 * F.log2(p[2] / p[0]), 6).alias("span_st"))


@query(_F + """ SELECT utt_id, count(*) AS n, round(greatest(0.78, least(1.30, CASE WHEN count(*) < 8 THEN 1.0 ELSE 2500 / median(fmt[3]) END)), 6) AS warp
FROM f WHERE speech AND voicing > 0.6 AND isfinite(fmt[3]) AND fmt[3] > 0 GROUP BY utt_id""")
def vocal_tract_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tract-length factor of each utterance from its median third formant, 1 under eight good frames."""
    f = load(spark, sf_dir, "frames").select("utt_id", "frame_no", "speech", "voicing", F.try_element_at("fmt", F.lit(3)).alias("f3"))
    f = sequences.unique_frames(f).filter("speech AND voicing > 0.6 AND f3 > 0 AND f3 < double('inf')")
    warp = F.when(F.count("*") < 8, 1.0).otherwise(2500 / F.percentile("f3", F.lit(0.5)))
    return f.groupBy("utt_id").agg(F.count("*").alias("n"), F.round(F.greatest(F.lit(0.78), F.least(F.lit(1.30), warp)), 6).alias("warp"))


_GRAMS = """
WITH t AS (SELECT doc_id, lang, '^' || trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) || '$' AS m FROM documents WHERE text IS NOT NULL),
own AS (SELECT doc_id, lang, pair[1] AS prev, pair[2] AS next, count(*) AS n FROM (
  SELECT doc_id, lang, unnest(list_transform(range(1, length(m)), lambda i: m[i:i+1])) AS pair FROM t) GROUP BY ALL),
big AS (SELECT lang, prev, next, sum(n) AS n, ln(sum(n) / sum(sum(n)) OVER (PARTITION BY lang, prev)) AS logp FROM own WHERE lang IS NOT NULL GROUP BY lang, prev, next),
uni AS (SELECT lang, next, ln(sum(n) / sum(sum(n)) OVER (PARTITION BY lang)) AS ulogp FROM big GROUP BY lang, next)"""


@query(_GRAMS + " SELECT lang, prev, next, CAST(n AS BIGINT) AS n, round(logp, 6) AS logp FROM big")
def bigram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter-pair model of each language."""
    return language.bigram_model(load(spark, sf_dir, "documents"), "lang", "text").withColumn("logp", F.round("logp", 6))


@query(_GRAMS + """, l AS (SELECT lang, count(*) AS docs FROM documents WHERE lang IS NOT NULL GROUP BY lang),
s AS (SELECT o.doc_id, l.lang, 6 * sum(o.n * coalesce(ulogp, ln(1e-4))) / sum(o.n) + 4 * sum(o.n * coalesce(logp, ln(1e-4))) / sum(o.n) + 0.25 * ln(greatest(max(docs), 1)) AS score
  FROM own o JOIN l ON true LEFT JOIN big ON big.lang = l.lang AND big.prev = o.prev AND big.next = o.next LEFT JOIN uni ON uni.lang = l.lang AND uni.next = o.next GROUP BY ALL),
e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY doc_id)) / 4) AS e FROM s)
SELECT doc_id, lang, round(score, 5) AS score, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS p FROM e""")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each document with their posterior."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    s = language.identify(d.select("doc_id", "text"), "doc_id", "text", "lang", d)
    return s.select("doc_id", "lang", F.round("score", 5).alias("score"), F.round("p", 6).alias("p"))
