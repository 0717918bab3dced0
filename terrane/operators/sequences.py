"""Sequence operators over frames: runs, filters, gaps, forward as-of and contours, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unique_frames(frames: DataFrame) -> DataFrame:
    """Each frame of an utterance once."""
    return frames.dropDuplicates(["utt_id", "frame_no"])


def runs(df: DataFrame, key: str, order: str, state: Column) -> DataFrame:
    """(key, run, state, start, end, length): maximal runs of equal state over consecutive rows."""
    w = Window.partitionBy(key).orderBy(order)
    s = df.withColumn("state", state)
    s = s.withColumn("new", F.when(F.col("state").eqNullSafe(F.lag("state").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    s = s.withColumn("run", F.sum("new").over(w))
    return s.groupBy(key, "run").agg(F.first("state").alias("state"), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"))


def voice_activity(frames: DataFrame) -> DataFrame:
    """Frames with ``active``: energy above p10 + max(p95 - p10, 6)/4 of the utterance, or voicing above 0.55."""
    level = frames.groupBy("utt_id").agg(F.percentile("energy", F.array(F.lit(0.1), F.lit(0.95))).alias("p"))
    low, high = F.col("p")[0], F.col("p")[1]
    joined = frames.join(level, "utt_id")
    loud = F.col("energy") > low + 0.25 * F.greatest(high - low, F.lit(6.0))
    return joined.withColumn("active", F.coalesce(loud, F.lit(False)) | F.coalesce(F.col("voicing") > 0.55, F.lit(False))).drop("p")


def close_gaps(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Fill single-row gaps: a row counts if both neighbours do. Longer gaps stay open however often it runs."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn(flag, F.col(flag) | (F.coalesce(F.lag(flag).over(w), F.lit(False)) & F.coalesce(F.lead(flag).over(w), F.lit(False))))


def long_runs(df: DataFrame, key: str, order: str, flag: str, least: int = 4) -> DataFrame:
    """(key, start, end, length) of the runs of true flags of at least ``least`` rows."""
    return runs(df, key, order, F.col(flag)).filter(F.col("state") & (F.col("length") >= least)).select(key, "start", "end", "length")


def median_filter(df: DataFrame, key: str, order: str, column: str, half: int = 2, least: int = 3) -> DataFrame:
    """Rows with ``smooth``: the median of the values within ``half`` rows, null with fewer than ``least`` of them.

    The few neighbours are gathered in an array and sorted there, which stays in generated code.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    near = F.array_sort(F.collect_list(column).over(w))
    n = F.size("near")
    middle = (F.element_at("near", F.floor((n + 1) / 2).cast("int")) + F.element_at("near", F.floor(n / 2 + 1).cast("int"))) / 2
    return df.withColumn("near", near).withColumn("smooth", F.when(F.col(column).isNotNull() & (n >= least), middle)).drop("near")


def pre_emphasis(df: DataFrame, key: str, order: str, column: str, a: float = 0.97) -> DataFrame:
    """Rows with ``sharp`` = x[t] - a x[t-1], x before the start being 0."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("sharp", F.col(column) - a * F.coalesce(F.lag(column).over(w), F.lit(0.0)))


def pairwise_variability(df: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    """(key, n, npvi): mean of 100 |a - b| / ((a + b)/2) over successive durations."""
    w = Window.partitionBy(key).orderBy(order)
    pairs = df.withColumn("before", F.lag(duration).over(w)).filter("before IS NOT NULL")
    step = 100 * F.abs(F.col(duration) - F.col("before")) / ((F.col(duration) + F.col("before")) / 2)
    return pairs.groupBy(key).agg(F.count("*").alias("n"), F.avg(step).alias("npvi"))


def forward_asof(events: DataFrame, frames: DataFrame, key: str, within: int = 14) -> DataFrame:
    """(key, at, first): the first voiced frame (voicing > 0.6) within ``within`` frames from each event frame ``at``.

    One look-ahead window over the union of both, so no range join is needed.
    """
    voiced = F.when(F.col("voicing") > 0.6, F.col("frame_no"))
    w = Window.partitionBy(key).orderBy("frame_no").rangeBetween(0, within - 1)
    marked = frames.join(events.withColumn("event", F.lit(True)), [key, "frame_no"], "left")
    return marked.withColumn("first", F.min(voiced).over(w)).filter("event").select(key, F.col("frame_no").alias("at"), "first")


def final_slope(frames: DataFrame, key: str, order: str, column: str, last: int = 30) -> DataFrame:
    """(key, n, slope): linear slope of the last ``last`` present values of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    tail = frames.filter(F.col(column).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= last)
    return tail.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope(F.col(column), F.col(order).cast("double")).alias("slope"))


def lobanov(df: DataFrame, group: str, column: str) -> DataFrame:
    """Rows with ``z``: the value less its group's mean, over the group's population deviation (1e-6 at least)."""
    stats = df.groupBy(group).agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return df.join(stats, group).withColumn("z", (F.col(column) - F.col("__m")) / F.greatest("__s", F.lit(1e-6))).drop("__m", "__s")
