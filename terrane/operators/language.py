"""Language identification from symbol sequences: unigrams, bigrams with boundary signs, and a weighted score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.session import small, spread, written

#: Log probability of a pair or symbol a language was never seen with.
FLOOR = 1e-4
#: Weights of the unigram, bigram and size terms, and the temperature of the softmax (fixed values).
WEIGHTS, TEMPERATURE = (6.0, 4.0, 0.25), 4.0


def symbols(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, symbol): the letters of lower-cased text, other runs as one boundary sign, ^ first and $ last."""
    plain = F.regexp_replace(F.lower(F.col(text)), r"[^a-z]+", " ")
    marked = F.concat(F.lit("^"), F.trim(plain), F.lit("$"))
    return df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(marked, "")).alias("at", "symbol")).filter("symbol <> ''")


def bigrams(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, prev, next, n): counted pairs of neighbouring symbols, in one pass of each text."""
    plain = F.regexp_replace(F.lower(F.col(text)), r"[^a-z]+", " ")
    marked = F.concat(F.lit("^"), F.trim(plain), F.lit("$"))
    pairs = F.regexp_extract_all("m", F.lit("(?=(..))"), F.lit(1))
    return spread(df.select(key, text)).filter(F.col(text).isNotNull()).select(key, marked.alias("m")).select(key, F.explode(pairs).alias("pair")).groupBy(
        key, F.substring("pair", 1, 1).alias("prev"), F.substring("pair", 2, 1).alias("next")).agg(F.count("*").alias("n"))


def _with_logp(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.withColumn("logp", F.log(F.col("n") / F.sum("n").over(Window.partitionBy(*keys))))


def bigram_model(df: DataFrame, language: str, text: str) -> DataFrame:
    """(language, prev, next, n, logp): maximum-likelihood transition log probabilities of each language."""
    return _with_logp(bigrams(df.filter(F.col(language).isNotNull()), language, text), [language, "prev"])


def unigram_model(df: DataFrame, language: str, text: str) -> DataFrame:
    """(language, symbol, n, logp)."""
    counts = bigrams(df.filter(F.col(language).isNotNull()), language, text)
    return _with_logp(counts.groupBy(language, F.col("next").alias("symbol")).agg(F.sum("n").alias("n")), [language])


def identify(df: DataFrame, key: str, text: str, language: str, train: DataFrame) -> DataFrame:
    """(key, language, score, p): each text's languages by the weighted mean log probabilities, softmax over languages.

    The models have one row per language and pair of 28 symbols, so joining them multiplies a text's distinct pairs by
    the languages only.
    """
    own = written(bigrams(df, key, text), "bigrams")
    languages = train.filter(F.col(language).isNotNull()).groupBy(language).agg(F.count("*").alias("docs"))
    counts = written(bigrams(train.filter(F.col(language).isNotNull()), language, text), "counts")
    pair = _with_logp(counts, [language, "prev"]).select(language, "prev", "next", "logp")
    single = _with_logp(counts.groupBy(language, "next").agg(F.sum("n").alias("n")), [language]).select(language, "next", F.col("logp").alias("ulogp"))
    floor = F.log(F.lit(FLOOR))
    each = own.join(small(languages, 32), F.lit(True)).join(small(pair, 64), [language, "prev", "next"], "left").join(small(single, 48), [language, "next"], "left")
    score = each.groupBy(key, language).agg(
        (F.sum(F.col("n") * F.coalesce("ulogp", floor)) / F.sum("n")).alias("u"), (F.sum(F.col("n") * F.coalesce("logp", floor)) / F.sum("n")).alias("b"),
        F.max("docs").alias("docs"))
    score = score.withColumn("score", WEIGHTS[0] * F.col("u") + WEIGHTS[1] * F.col("b") + WEIGHTS[2] * F.log(F.greatest("docs", F.lit(1))))
    w = Window.partitionBy(key)
    e = F.exp((F.col("score") - F.max("score").over(w)) / TEMPERATURE)
    return score.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).select(key, language, "score", "p")
