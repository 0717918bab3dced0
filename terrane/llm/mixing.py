"""Mixing sources to target shares of tokens.

Entropy balancing with capped copies: among all rates between 0 and a source's cap that meet its token constraint, those
of greatest entropy around one copy each are min(cap, exp(lam * tokens)). The dual is convex with one multiplier per
source; a Newton step needs two sums per source, added up over a size histogram that is small at any scale.
Rates become whole copies by a fixed hash of the record, with a per-source threshold chosen so that rounding keeps the
token constraint.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.session import written

#: Vocabulary file of a public byte-level BPE and the pattern that splits text before it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Newton steps at most, and the relative error of the token constraint at which they end.
STEPS, ERROR = 60, 1e-9
#: Grid of the rounding threshold.
LEVELS = 4096
#: Rows of the size histogram (source, tokens, n) up to which the dual is solved where the driver runs (5 MB).
SIZES = 200_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = VOCABULARY, piece: int = 1 << 16) -> DataFrame:
    """``doc_id``, ``source`` and the tokens of whole texts; a null text has none.

    Texts longer than ``piece`` characters are cut before a word where there is a blank, for the tokenizer's memory.
    """
    def count(text: str, enc) -> int:
        if len(text) <= piece:
            return len(enc.encode_ordinary(text))
        n = at = 0
        while at < len(text):
            end = min(len(text), at + piece)
            if end < len(text) and (space := text.rfind(" ", at + 1, end)) > 0:
                end = space
            n += len(enc.encode_ordinary(text[at:end]))
            at = end
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for b in batches:
            n = [0 if t is None else count(t, enc) for t in (x.as_py() for x in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(
        run, "doc_id long, source string, tokens long"
    )


def source_key(c: Column) -> Column:
    """A source name without case and padding; space, hyphen and underscore are alike."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[ \-_]", "_")


def _targets(targets: DataFrame) -> list[dict]:
    """The target table, one row per source (it is the configuration of a mix; 100,000 sources at most)."""
    rows = targets.select(
        "source", source_key(F.col("source")).alias("key"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")
    ).filter("key IS NOT NULL AND target_share IS NOT NULL").groupBy("key").agg(
        F.min("source").alias("source"), F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")
    ).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("a mix has at most 100,000 target sources")
    return [r.asDict() for r in rows]


def _rate(cap: str, lam: str, scale: str) -> Column:
    """Copies of a document of ``tokens`` tokens."""
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col(lam) * F.col("tokens") / F.col(scale)))
    return F.when(F.col("tokens") <= 0, 0.0).otherwise(F.least(F.col(cap), F.exp(z)))


def _sums(histogram: DataFrame):
    """Function from multipliers to, per source, tokens reached and their derivative, in one distributed pass."""
    def at(wanted: dict[str, dict], lam: dict[str, float]) -> dict[str, tuple[float, float]]:
        tilt = histogram.sparkSession.createDataFrame(
            [(k, float(w["cap"]), lam[k], w["scale"]) for k, w in wanted.items()], "key string, cap double, lam double, scale double")
        t, rate = F.col("tokens") * F.col("n"), _rate("cap", "lam", "scale")
        slope = F.when(rate < F.col("cap"), t * rate * F.col("tokens") / F.col("scale")).otherwise(0.0)
        rows = histogram.join(F.broadcast(tilt), "key").groupBy("key").agg(F.sum(t * rate).alias("reached"), F.sum(slope).alias("slope")).collect()
        return {r["key"]: (r["reached"], r["slope"]) for r in rows}

    return at


def _sums_here(table: pa.Table):
    """The same over a small histogram."""
    key = np.array(table.column("key").to_pylist(), object)
    size, n = (table.column(c).to_numpy().astype(float) for c in ("tokens", "n"))
    parts = {k: (size[key == k], n[key == k]) for k in set(key.tolist())}

    def at(wanted, lam):
        out = {}
        for k, w in wanted.items():
            t, m = parts[k]
            rate = np.minimum(w["cap"], np.exp(np.clip(lam[k] * t / w["scale"], -700, 700)))
            out[k] = float((t * m * rate).sum()), float(np.where(rate < w["cap"], t * m * rate * t / w["scale"], 0.0).sum())
        return out

    return at


def solve(sums, wanted: dict[str, dict]) -> dict[str, float]:
    """Multiplier per source by safeguarded Newton steps on the dual, all open sources in one pass of ``sums`` per step.

    ``wanted``: key -> {goal, cap, scale}; a goal lies strictly between 0 and what the cap allows.
    """
    lam = dict.fromkeys(wanted, 0.0)
    low, high = dict.fromkeys(wanted, -1e7), dict.fromkeys(wanted, 1e7)
    left = set(wanted)
    for _ in range(STEPS):
        at = sums({k: wanted[k] for k in left}, lam)
        for k in list(left):
            reached, slope = at[k]
            miss = reached - wanted[k]["goal"]
            if abs(miss) <= ERROR * wanted[k]["goal"]:
                left.discard(k)
                continue
            (high if miss > 0 else low)[k] = lam[k]
            step = lam[k] - miss / slope if slope > 0 else math.nan
            lam[k] = step if low[k] < step < high[k] else (low[k] + high[k]) / 2
        if not left:
            break
    return lam


def mixture(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, reachable: bool = False) -> tuple[DataFrame, DataFrame]:
    """(copies, report) of a mix of the size of the whole corpus or, if ``reachable``, of the largest size up to that at
    which every source can have its share.

    copies: (doc_id, source, tokens, copies) of every document, 0 copies for those of no target source. report: per
    target source its tokens, goal, most reachable tokens, tokens reached, share, ``short`` where even max_repeats
    copies of each document fall short (such a source is used in full), and ``largest_total``, the size of mix up to which
    no source falls short. Rows that repeat a document count as delivered.
    """
    spark = documents.sparkSession
    counted = written(token_counts(documents, path).withColumn("key", source_key(F.col("source"))), "tokens")
    goals = {r["key"]: r for r in _targets(targets)}
    keys = spark.createDataFrame([(k,) for k in goals], "key string")
    sizes = counted.groupBy("key", "tokens").agg(F.count("*").alias("n"))
    histogram = written(sizes, "sizes")
    total = histogram.agg(F.coalesce(F.sum(F.col("tokens") * F.col("n")), F.lit(0))).first()[0]
    histogram = histogram.filter("tokens > 0").join(F.broadcast(keys), "key")
    small_ = histogram.count() <= SIZES
    have = {r["key"]: (r["t"], r["d"]) for r in histogram.groupBy("key").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("d")).collect()}
    wanted, rows = {}, []
    largest = min((g["cap"] * have.get(k, (0, 0))[0] / g["share"] for k, g in goals.items() if g["share"] > 0), default=0.0)
    total = min(total, largest) if reachable else total
    for k, g in goals.items():
        tokens, docs = have.get(k, (0, 0))
        goal, most = g["share"] * total, g["cap"] * tokens
        g |= {"tokens": tokens, "goal": goal, "most": most, "short": most < goal * (1 - 1e-12)}
        if 0 < goal < most:
            wanted[k] = {"goal": goal, "cap": g["cap"], "scale": tokens / docs}
    lam = solve(_sums_here(histogram.toArrow()) if small_ else _sums(histogram), wanted) if wanted else {}
    for k, g in goals.items():  # a source that falls short is used in full, one without a goal not at all
        full = 1e9 if g["goal"] >= g["most"] else -1e9
        rows.append((k, g["source"], float(g["cap"]) if g["goal"] > 0 else 0.0, lam.get(k, full), wanted[k]["scale"] if k in wanted else 1.0, float(g["goal"])))
    tilt = spark.createDataFrame(rows, "key string, target string, cap double, lam double, scale double, goal double")
    rate = F.coalesce(_rate("cap", "lam", "scale"), F.lit(0.0))
    u = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(LEVELS * 1024)) / F.lit(float(LEVELS * 1024))
    rated = counted.join(F.broadcast(tilt), "key", "left").withColumn("rate", F.when(F.col("target").isNull(), 0.0).otherwise(rate)).withColumn(
        "whole", F.floor("rate")).withColumn("gain", F.col("rate") - F.col("whole") - u)
    # a document gets one copy more where its remainder passes the hash by the source's threshold, 0 on average
    part = (F.col("rate") > F.col("whole")) & F.col("target").isNotNull()
    level = F.when(part, F.floor((F.col("gain") + 1) * (LEVELS / 2)).cast("int"))
    rated = rated.withColumn("level", level)
    steps = rated.filter("target IS NOT NULL").groupBy("key", "goal", "level").agg(
        F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("whole")).alias("base"))
    falling = Window.partitionBy("key").orderBy(F.desc_nulls_first("level"))  # at most LEVELS + 1 rows per source
    reached = steps.withColumn("reached", F.sum("base").over(Window.partitionBy("key")) + F.sum(
        F.when(F.col("level").isNull(), 0).otherwise(F.col("t"))).over(falling)).withColumn("level", F.coalesce("level", F.lit(LEVELS * 2)))
    none = steps.groupBy("key", "goal").agg(F.sum("base").alias("reached")).withColumn("level", F.lit(LEVELS * 2))
    every = reached.select("key", "goal", "level", "reached").unionByName(none.select("key", "goal", "level", "reached"))
    cuts = written(every.groupBy("key").agg(F.min_by(F.struct(F.col("level").alias("cut"), "reached", "goal"), F.struct(
        F.abs(F.col("reached") - F.col("goal")), -F.col("level"))).alias("c")).select("key", "c.*"), "cuts")
    # the one document whose change of mind brings the source nearest to its goal
    taken = F.col("level") >= F.col("cut")
    cut_rows = rated.filter(part).select("key", "doc_id", "tokens", "level").join(F.broadcast(cuts), "key")
    delta = F.when(taken, -F.col("tokens")).otherwise(F.col("tokens"))
    miss = F.abs(F.col("reached") + F.col("delta") - F.col("goal"))
    turn = cut_rows.withColumn("delta", delta).filter(miss < F.abs(F.col("reached") - F.col("goal"))).groupBy("key").agg(
        F.min_by(F.struct(F.col("doc_id").alias("turned"), "delta"), F.struct(miss, F.col("doc_id"))).alias("t")).select("key", "t.*")
    cuts = written(cuts.join(turn, "key", "left"), "turns")  # a row per target source
    more = F.when(part & (taken != (F.col("doc_id") == F.col("turned")).eqNullSafe(True)), 1).otherwise(0)
    copies = rated.join(F.broadcast(cuts.drop("goal")), "key", "left").select(
        "doc_id", F.col("target").alias("source"), "tokens", (F.col("whole") + more).cast("int").alias("copies"))
    key_of = {g["source"]: k for k, g in goals.items()}
    sums = copies.filter("source IS NOT NULL").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()  # a row per target source
    got = dict.fromkeys(goals, 0) | {key_of[r["source"]]: r["t"] or 0 for r in sums}
    size = sum(got.values())
    report = spark.createDataFrame(
        [(g["source"], g["share"], g["cap"], int(g["tokens"]), float(g["goal"]), int(g["most"]), int(got[k]), got[k] / size if size else 0.0, bool(g["short"]), float(largest))
         for k, g in goals.items()],
        "source string, target_share double, max_repeats int, tokens long, goal double, most long, reached long, share double, short boolean, largest_total double",
    )
    return copies, report
