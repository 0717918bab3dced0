"""Implausible readings in per-source time series of frames.

Three tests per reading: impossible (outside hard limits, infinite, formants out of order), frozen (the same value in a
long run of consecutive frames, zero variance), outlying (beyond fences set by the source's own 5 to 95 percent range).
The fences come from per-source log-bucket quantile sketches that merge by addition; the few values in the buckets that
hold the wanted ranks are then read exactly, so the fences equal those of exact percentiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.session import small, written

FIELDS = ("f0", "f1", "f2", "f3", "f4", "energy")
#: Name under which a reading is reported, and its bit.
REPORTED = {"f0": ("f0", 1), "f1": ("fmt", 2), "f2": ("fmt", 2), "f3": ("fmt", 2), "f4": ("fmt", 2), "energy": ("energy", 4)}
F0_LIMITS, FORMANT_LIMITS, ENERGY_LIMITS = (30.0, 1000.0), (50.0, 8000.0), (-120.0, 0.0)
FROZEN_RUN = 12
#: Frames of an utterance in one sorted chunk; chunks overlap by a run less one, so no utterance is one task's burden.
CHUNK = 4096
#: Relative width of a sketch bucket, the parts into which a bucket is cut at each finer level, and the finer levels.
BUCKET_WIDTH, FINER, LEVELS = 0.01, 1000, 2
#: Readings of a bucket up to which it is read exactly; a fuller one is cut at the next level first.
EXACT = 1_000_000
#: Columns of the change since the frame before, for rates.
RATES = tuple(f"d_{f}" for f in FIELDS)
LOW, HIGH, EXPAND = 0.05, 0.95, 1.0

_CHECKED = (
    "utt_id string, frame_no int, source_id string, speech byte, hour byte, "
    "f0 double, f1 double, f2 double, f3 double, f4 double, energy double, bits byte"
)
_WITH_RATES = _CHECKED + "".join(f", {r} double" for r in RATES)


def _readings(frames: DataFrame) -> DataFrame:
    """Keys and the six readings as doubles, NaN turned into null, in chunks that overlap at their borders."""
    def reading(c: Column) -> Column:
        c = c.cast("double")
        return F.when(~F.isnan(c), c)

    halo = FROZEN_RUN - 1
    n = F.col("frame_no").cast("int")
    return frames.filter(F.col("utt_id").isNotNull() & F.col("frame_no").isNotNull()).select(
        F.col("utt_id").cast("string").alias("utt_id"), n.alias("frame_no"),
        F.col("source_id").cast("string").alias("source_id"),
        F.when(F.col("speech").isNull(), 2).otherwise(F.col("speech").cast("int")).cast("byte").alias("speech"),
        F.coalesce(F.hour("ts"), F.lit(24)).cast("byte").alias("hour"),
        reading(F.col("f0")).alias("f0"),
        *[reading(F.try_element_at("fmt", F.lit(k))).alias(f"f{k}") for k in (1, 2, 3, 4)],
        reading(F.col("energy")).alias("energy"),
        F.explode(F.array_distinct(F.array(*[F.floor((n + d) / CHUNK).cast("int") for d in (0, -halo, halo)]))).alias("chunk"),
    )


def _equal_next(v: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Whether each value equals the next one (nulls never do)."""
    return joined & (v[1:] == v[:-1])


def _check_block(t: pa.Table, size: int, rates: bool) -> pa.RecordBatch:
    """Drop repeats of a frame, mark impossible and frozen readings, keep the chunk's own frames. Rows sorted by key."""
    utt = t.column("utt_id").combine_chunks().dictionary_encode()
    u = utt.indices.to_numpy(zero_copy_only=False)
    chunk, frame = t.column("chunk").to_numpy(), t.column("frame_no").to_numpy()
    same = (u[1:] == u[:-1]) & (chunk[1:] == chunk[:-1])
    first = np.r_[True, ~(same & (frame[1:] == frame[:-1]))]
    keep = np.nonzero(first)[0]
    t, u, chunk, frame = t.take(pa.array(keep)), u[keep], chunk[keep], frame[keep].astype(np.int64)
    n = len(keep)
    v = {f: t.column(f).to_numpy(zero_copy_only=False).astype(float) for f in FIELDS}
    joined = (u[1:] == u[:-1]) & (chunk[1:] == chunk[:-1]) & (frame[1:] == frame[:-1] + 1)
    bits = np.zeros(n, np.int8)
    highest = np.full(n, -np.inf)
    changes = []
    for f in FIELDS:
        with np.errstate(invalid="ignore"):
            changes.append(np.r_[np.nan, np.where(joined, np.abs(np.diff(v[f])), np.nan)])
        x, bit = v[f], REPORTED[f][1]
        lo, hi = {"f0": F0_LIMITS, "energy": ENERGY_LIMITS}.get(f, FORMANT_LIMITS)
        there = ~np.isnan(x)
        bad = there & ((x < lo) | (x > hi))
        if bit == 2:
            bad |= there & (x <= highest)
            highest = np.where(there, np.maximum(highest, x), highest)
        runs = np.r_[False, _equal_next(x, joined), False]
        starts = np.nonzero(~runs[:-1])[0]  # a frame that isn't equal to the one before starts a run
        length = np.diff(np.r_[starts, n])
        bad |= there & np.repeat(length >= FROZEN_RUN, length)
        bits |= np.where(bad, bit, 0).astype(np.int8)
    own = np.nonzero(frame // size == chunk)[0]
    t = t.take(pa.array(own)).drop_columns(["chunk"]).append_column("bits", pa.array(bits[own], pa.int8()))
    for name, d in zip(RATES, changes) if rates else ():
        t = t.append_column(name, pa.array(d[own], pa.float64(), from_pandas=True))
    return t.combine_chunks().to_batches()[0] if len(own) else None


def _check(size: int, rates: bool):
    """Runs :func:`_check_block` on whole (utterance, chunk) groups of a sorted partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 60_000:
                continue
            t = pa.Table.from_batches(held)
            utt, chunk = t.column("utt_id"), t.column("chunk").to_numpy()
            last = t.num_rows - 1
            u = utt.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            other = np.nonzero((u != u[last]) | (chunk != chunk[last]))[0]
            if not len(other):
                continue
            cut = int(other[-1]) + 1
            if (out := _check_block(t.slice(0, cut), size, rates)) is not None:
                yield out
            held = t.slice(cut).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in held)
        if rows and (out := _check_block(pa.Table.from_batches(held), size, rates)) is not None:
            yield out

    return run


def checked_frames(frames: DataFrame, rates: bool = False) -> DataFrame:
    """Each frame once, with its readings and the bits of impossible or frozen fields (1 f0, 2 fmt, 4 energy).

    Frames without utt_id or frame_no can't be addressed and are left out. Repeats of a frame count once; if they
    differ, the one with the smallest readings (null first) stands for it. Formants after the fourth aren't read.
    ``rates`` adds the absolute change of each reading since the frame before, null where that is missing.
    """
    keyed = _readings(frames)
    keys = ["utt_id", "chunk", "frame_no"]
    ordered = keyed.repartition("utt_id", "chunk").sortWithinPartitions(*keys, *FIELDS)
    return ordered.mapInArrow(_check(CHUNK, rates), _WITH_RATES if rates else _CHECKED)


def bucket(x: Column, level: int = 0, width: float = BUCKET_WIDTH) -> Column:
    """Sketch bucket of a finite value: monotone in the value, of constant relative width, 0 around zero.

    Each level cuts the buckets of the one before into FINER parts; all are taken from the finest, so they nest.
    """
    fine = FINER**LEVELS
    size = F.floor(F.log(F.abs(x)) / math.log1p(width) * fine) + 4000 * fine  # |x| above 5e-18
    size = F.floor(size / FINER ** (LEVELS - level))
    return F.when(F.abs(x) < 1e-15, 0).otherwise(F.when(x < 0, -size).otherwise(size)).cast("long")


def _long(checked: DataFrame, context: list[str], fields: tuple[str, ...]) -> DataFrame:
    """One row per finite reading."""
    values = F.array(*[F.col(f) for f in fields])
    return checked.select("source_id", *context, F.posexplode(values).alias("field", "x")).filter(
        F.col("x").isNotNull() & (F.abs("x") < float("inf"))
    )


def quantile_sketch(checked: DataFrame, context: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Mergeable sketch per source, context and field: counts by bucket, added on the map side before the shuffle."""
    return _long(checked, context, fields).groupBy("source_id", *context, "field", bucket(F.col("x")).alias("bucket")).agg(
        F.count("*").alias("n")
    )


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match."""
    r = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(r[f"r_{k}"]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(r, cond, how).drop(*[f"r_{k}" for k in keys])


def _hit(counted: DataFrame, group: list[str], before: Column) -> DataFrame:
    """The buckets (column bucket, n) of each group that hold a wanted rank, with the readings ``before`` them."""
    w = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("before", before + F.coalesce(F.sum("n").over(w), F.lit(0)))
    inside = F.lit(False)
    for q in (LOW, HIGH):
        for d in (0, 1):
            rank = F.floor((F.col("total") - 1) * q).cast("long") + d
            inside = inside | ((rank >= F.col("before")) & (rank < F.col("before") + F.col("n")))
    return ranked.filter(inside)


def fences(checked: DataFrame, context: list[str] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per source, context and field: n, the LOW and HIGH percentiles (linear between ranks) and the expanded fences.

    The readings of the buckets that hold the wanted ranks are read exactly. A bucket of more than EXACT readings is cut
    into finer ones first, so no group of a large source is one task's to sort.
    """
    context = ["speech"] if context is None else context
    keys = ["source_id", *context, "field"]
    sketch = written(quantile_sketch(checked, context, fields), "sketch")
    total = sketch.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    targets = written(_hit(total, keys, F.lit(0)).select(*keys, "bucket", "before", "total", "n", F.lit(0).alias("level")), "ranks")
    done, depth = [], 0
    for level in range(1, LEVELS + 1):
        if targets.filter(F.col("n") > EXACT).isEmpty():
            break
        done.append((level - 1, targets.filter(F.col("n") <= EXACT)))
        inside = _joined(_long(checked, context, fields).withColumn("bucket", bucket(F.col("x"), level - 1)), small(targets.filter(F.col("n") > EXACT).drop("n", "level"), 96), [*keys, "bucket"])
        finer = inside.withColumnRenamed("bucket", "coarse").groupBy(*keys, "coarse", "total", F.col("before").alias("base"), bucket(F.col("x"), level).alias("bucket")).agg(F.count("*").alias("n"))
        targets = written(_hit(finer, [*keys, "coarse"], F.col("base")).select(*keys, "bucket", "before", "total", "n", F.lit(level).alias("level")), "ranks")
        depth = level
    done.append((depth, targets))
    exact = None
    for at, part in done:
        read = _joined(_long(checked, context, fields).withColumn("bucket", bucket(F.col("x"), at)), small(part.drop("n", "level"), 96), [*keys, "bucket"])
        read = read.groupBy(*keys, F.lit(at).alias("level"), "bucket", "before", "total", "x").agg(F.count("*").alias("m"))
        exact = read if exact is None else exact.unionByName(read)
    part = Window.partitionBy(*keys, "level", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    at = exact.withColumn("from", F.col("before") + F.coalesce(F.sum("m").over(part), F.lit(0)))

    def rank_value(q: float, d: int) -> Column:
        w = F.floor((F.col("total") - 1) * q).cast("long") + d
        return F.max(F.when((w >= F.col("from")) & (w < F.col("from") + F.col("m")), F.col("x")))

    q = at.groupBy(*keys).agg(
        F.max("total").alias("n"),
        *[rank_value(p, d).alias(f"v{i}{d}") for i, p in enumerate((LOW, HIGH)) for d in (0, 1)],
    )
    for i, p in enumerate((LOW, HIGH)):
        frac = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
        q = q.withColumn(f"q{i}", F.col(f"v{i}0") + F.coalesce(F.col(f"v{i}1") - F.col(f"v{i}0"), F.lit(0.0)) * frac)
    width = (F.col("q1") - F.col("q0")) * EXPAND
    return q.select(*keys, "n", F.col("q0").alias("low"), F.col("q1").alias("high"),
                    (F.col("q0") - width).alias("floor"), (F.col("q1") + width).alias("ceiling"))


def _beyond(joined: DataFrame, fields: tuple[str, ...], sides: dict[str, str]) -> Column:
    """Bits of the readings beyond their fences, which are columns <field>_floor and <field>_ceiling."""
    flags = F.lit(0)
    for f in fields:
        out = F.lit(False)
        for side, sign in sides.items():
            out = out | (F.col(f) > F.col(f"{f}_{side}") if sign == ">" else F.col(f) < F.col(f"{f}_{side}"))
        flags = flags.bitwiseOR(F.when(out, REPORTED[f.removeprefix("d_")][1]).otherwise(0))
    return flags


def _flagged(checked: DataFrame, context: list[str], fields: tuple[str, ...], sides: dict[str, str], bits: Column) -> DataFrame:
    limits = written(fences(checked, context, fields), "fences")
    wide = limits.groupBy("source_id", *context).agg(*[
        F.max(F.when(F.col("field") == i, F.col(side))).alias(f"{f}_{side}")
        for i, f in enumerate(fields) for side in sides
    ])
    wide = written(wide, "limits")
    joined = _joined(checked, small(wide, 160), ["source_id", *context], "left")
    flags = bits.bitwiseOR(_beyond(joined, fields, sides))
    marked = joined.select("utt_id", "frame_no", "source_id", flags.alias("flags")).filter("flags <> 0")
    names = F.array(*[F.when(F.col("flags").bitwiseAND(bit) != 0, F.lit(name)) for name, bit in (("f0", 1), ("fmt", 2), ("energy", 4))])
    return marked.select("utt_id", "frame_no", "source_id", F.explode(F.array_compact(names)).alias("field"))


def spikes(frames: DataFrame, context: list[str] | None = None) -> DataFrame:
    """(utt_id, frame_no, source_id, field) of every implausible reading, a frame once per field.

    Null and NaN are unresolved and never flagged. A null source_id or speech flag is a source or context of its own.
    ``context`` names what splits a source's normal behaviour: ``speech``, ``hour`` or both.
    """
    context = ["speech"] if context is None else context
    checked = written(checked_frames(frames), "checked")
    return _flagged(checked, context, FIELDS, {"floor": "<", "ceiling": ">"}, F.col("bits").cast("int"))


def jumps(frames: DataFrame, context: list[str] | None = None) -> DataFrame:
    """(utt_id, frame_no, source_id, field) of every reading that changed implausibly since the frame before.

    The absolute changes of a source and context have a 5 to 95 percent range of their own; a change beyond it by more
    than its width is a jump. Readings without one in the frame before are none.
    """
    context = ["speech"] if context is None else context
    checked = written(checked_frames(frames, rates=True), "checked")
    return _flagged(checked, context, RATES, {"ceiling": ">"}, F.lit(0))
