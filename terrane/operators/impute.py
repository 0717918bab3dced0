"""Filling missing cells from similar records by low-rank alternating least squares.

A record is a row of encoded cells: features scaled to 0..1, whichever table holds them, and one cell per language. Each
cell is taken relative to what the other records of its place, or of its country and language, lead to expect; the
low-rank product explains what is left. The matrix is tall and narrow, so the column factors (a few hundred numbers) live
on the driver: each round solves all records' factors where they lie and adds up, per column, the small normal equations
of the column factors. No record is shuffled. Missing cells are decoded to values that their group really has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.session import small, written

RANK, ROUNDS, RIDGE = 3, 12, 1.0
#: Rounds end when one lowers the squared error by less than this share.
GAIN = 0.005


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column to rows of ``width`` doubles, NaN where null."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float) if n else np.zeros(0)
    return flat.reshape(n, width)


def record_factors(x: np.ndarray, mean: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(factors, mask, centred values) of records given the column factors."""
    m = (~np.isnan(x)).astype(float)
    y = np.where(m > 0, x - mean, 0.0)
    r = v.shape[1]
    gram = (m @ (v[:, :, None] * v[:, None]).reshape(len(v), -1)).reshape(-1, r, r) + RIDGE * np.eye(r)
    return np.linalg.solve(gram, (y @ v)[..., None])[..., 0], m, y


def _sums(width: int, mean: np.ndarray | None, v: np.ndarray | None):
    """Per partition: counts and sums of the columns, or the normal equations of their factors, as (at, x) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = matrix(b.column(0), width)
            if v is None:
                part = np.stack([(~np.isnan(x)).sum(0), np.nansum(x, 0)], -1)
            else:
                u, m, y = record_factors(x, mean, v)
                missed = ((y - m * (u @ v.T)) ** 2).sum(0)[:, None]
                part = np.concatenate([m.T @ (u[:, :, None] * u[:, None]).reshape(len(u), -1), y.T @ u, missed], 1)
            total = part if total is None else total + part
        if total is not None:
            flat = total.ravel().astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int64)), pa.array(flat)], ["at", "x"])

    return run


def _gathered(records: DataFrame, width: int, per: int, mean=None, v=None) -> np.ndarray:
    rows = records.select("x").mapInArrow(_sums(width, mean, v), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * per)  # width * per numbers, whatever the number of records
    for r in rows:
        out[r["at"]] = r["x"]
    return out.reshape(width, per)


def column_factors(records: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, factors) of the columns of ``records.x`` by alternating least squares."""
    n, s = _gathered(records, width, 2).T
    mean = s / np.maximum(n, 1)
    v = np.random.default_rng(11).normal(0, 0.3, (width, RANK))
    before = np.inf
    for _ in range(ROUNDS):
        g = _gathered(records, width, RANK * RANK + RANK + 1, mean, v)
        gram = g[:, : RANK * RANK].reshape(width, RANK, RANK) + RIDGE * np.eye(RANK)
        v = np.linalg.solve(gram, g[:, RANK * RANK : -1, None])[..., 0]
        missed = g[:, -1].sum()
        if before < np.inf and before - missed <= GAIN * before:
            break
        before = missed
    return mean, v


def code(c: Column) -> Column:
    """A two-letter language code in lower case; null for anything else and for ``xx``."""
    v = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    return F.when(v.rlike("^[a-z]{2}$") & (v != "xx"), v)


def unit(c: Column) -> Column:
    """A number within 0..1, else null."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (x >= 0) & (x <= 1), x)


def _donors(df: DataFrame, keys: list[str], k: int, label: str) -> DataFrame:
    """Per group: least and greatest of each of the values v0.., as arrays (null where the group has none)."""
    per = df.dropna(subset=keys).groupBy(*keys).agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("min", F.min), ("max", F.max))])
    return written(per.select(*keys, *[F.array(*[F.col(f"{n}{i}") for i in range(k)]).alias(f"{label}_{n}") for n in ("min", "max")]), label)


_FILLED = "tab string, id string, field string, number double, text string"


def fill_sites(site: DataFrame, seed_site: DataFrame, spatial_model: DataFrame, accent_feature: DataFrame) -> DataFrame:
    """(tab, id, field, number, text): a value for each missing cell that its group can fill.

    Groups: sites of the same settlement_id for site.language; records of the same country and language for
    seed_site.low_back_merge and for the elements of spatial_model.norm_values. A missing own language, country or
    settlement is no group. Cells are missing when null, NaN, outside 0..1, or no two-letter code. Rows without an id are
    left out; of rows that repeat an id, a cell is missing if it is in any of them.
    """
    spark = site.sparkSession
    scale = accent_feature.filter("key IS NOT NULL").select("key", F.col("lo").cast("double"), F.col("hi").cast("double")).orderBy("key").collect()
    keys = [r.key for r in scale]
    k = len(keys)
    seed_names = [r for r in scale if r.key in seed_site.columns]
    if not k:
        return spark.createDataFrame([], _FILLED)
    s = site.filter("id IS NOT NULL").groupBy(F.col("id").cast("string").alias("rid")).agg(
        F.max(code(F.col("language"))).alias("language"), F.min("country").alias("country"), F.min("settlement_id").alias("place"))
    merge, nothing = unit(F.col("low_back_merge")), F.lit(None).cast("double")
    reading = {r.key: F.max(unit((F.col(r.key).cast("double") - r.lo) / (r.hi - r.lo))) for r in scale if r.key in seed_site.columns}
    d = seed_site.filter("id IS NOT NULL").groupBy(F.col("id").cast("string").alias("rid")).agg(
        *[reading.get(key, F.max(nothing)).alias(f"d{i}") for i, key in enumerate(keys)],
        F.max(merge.isNull()).alias("d_missing"), F.max(merge).alias("v0"),
        F.min("country").alias("d_country"), F.max(code(F.col("lang"))).alias("d_lang"))
    element = [unit(F.try_element_at("norm_values", F.lit(i + 1))) for i in range(k)]
    m = spatial_model.filter("site_id IS NOT NULL").groupBy(F.col("site_id").cast("string").alias("rid")).agg(
        *[f(e).alias(f"{n}{i}") for i, e in enumerate(element) for n, f in (("m", F.max), ("g", lambda c: F.max(c.isNull())))])
    m = m.withColumn("in_model", F.lit(True))
    both = s.withColumn("in_site", F.lit(True)).join(d, "rid", "full").join(m, "rid", "full")
    joined = written(both.select(
        "rid", "language", "country", "place", "in_site", "in_model", "d_missing", "v0", "d_country", "d_lang",
        F.array(*[F.col(f"m{i}") for i in range(k)]).alias("m"), F.array(*[F.col(f"g{i}") for i in range(k)]).alias("gap"),
        *[F.coalesce(f"m{i}", f"d{i}").alias(f"c{i}") for i in range(k)]), "records")

    languages = [r.language for r in joined.select("language").dropna().distinct().orderBy("language").limit(676).collect()]  # 675 codes at most
    known = F.array(*[F.lit(c) for c in languages]).cast("array<string>")
    n_lang = len(languages)

    def sums(keys_: list[str], label: str) -> DataFrame:
        """Per group: sum and count of each feature, as arrays."""
        per = joined.dropna(subset=keys_).groupBy(*keys_).agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("s", F.sum), ("n", F.count))])
        return per.select(*keys_, *[F.array(*[F.col(f"{n}{i}") for i in range(k)]).alias(f"{label}_{n}") for n in ("s", "n")])

    per_code = joined.filter("place IS NOT NULL AND language IS NOT NULL").groupBy("place", "language").agg(F.count("*").alias("n"))
    here = per_code.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("n"), F.sum("n").alias("here_n"))
    here = here.select(F.col("place").alias("__place"), "here_n", F.transform(known, lambda c: F.coalesce(F.try_element_at("n", c), F.lit(0))).alias("here"))
    places = sums(["place"], "p")
    places = written(places.join(here, places["place"] == here["__place"], "left").drop("__place"), "places")
    groups = written(sums(["country", "language"], "q"), "groups")
    merges = _donors(joined.select("d_country", "d_lang", "v0"), ["d_country", "d_lang"], 1, "merge")
    models = _donors(joined.filter("in_model").select("country", "language", *[F.col("m")[i].alias(f"v{i}") for i in range(k)]), ["country", "language"], k, "model")
    full = joined.join(small(places, 64 + 16 * k + 8 * n_lang), "place", "left").join(small(merges, 48), ["d_country", "d_lang"], "left").join(
        small(groups, 32 + 16 * k), ["country", "language"], "left").join(small(models, 32 + 16 * k), ["country", "language"], "left")

    def expected(i: int) -> Column:
        """Mean of the others of the place, else of the others of the country and language."""
        def others(side: str) -> Column:
            there = F.col(f"c{i}").isNotNull().cast("int")
            n = F.col(f"{side}_n")[i] - there
            return F.when(n > 0, (F.col(f"{side}_s")[i] - F.coalesce(f"c{i}", F.lit(0.0))) / n)
        return F.coalesce(others("p"), others("q"))

    own = lambda c: (F.col("language") == c).cast("double")
    mine = F.col("language").isNotNull().cast("int")
    share = F.zip_with("here", known, lambda n, c: F.when(F.col("here_n") > mine, (n - F.coalesce(own(c), F.lit(0.0))) / (F.col("here_n") - mine)))
    empty = F.array_repeat(nothing, n_lang)
    gap = F.when(F.col("in_model"), F.col("gap"))
    limit = lambda side: F.coalesce(F.zip_with(gap, f"model_{side}", lambda g, x: F.when(g, x)), F.array_repeat(nothing, k))
    based = full.select(
        "rid", F.concat(F.array(*[F.col(f"c{i}") for i in range(k)]), F.transform(known, own)).alias("cells"),
        F.concat(F.array(*[expected(i) for i in range(k)]), F.coalesce(share, empty)).alias("base"),
        (F.col("in_site") & F.col("language").isNull() & F.col("here").isNotNull() & (F.col("here_n") > 0)).alias("want_language"),
        F.when(F.col("d_missing"), F.col("merge_min")[0]).alias("w_lo"), F.when(F.col("d_missing"), F.col("merge_max")[0]).alias("w_hi"),
        limit("min").alias("lo"), limit("max").alias("hi"),
    )
    records = written(based.withColumn("x", F.zip_with("cells", "base", lambda c, b: c - b)), "matrix")
    if records.isEmpty():
        return spark.createDataFrame([], _FILLED)
    width = k + n_lang
    mean, v = column_factors(records, width)
    merge_at, language_at = keys.index("low_back_merge"), k

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(rid, tab, field, number=None, text=None):
            n = len(rid)
            cols = [pa.array([tab] * n, pa.string()), rid, pa.array([field] * n if isinstance(field, str) else field, pa.string()),
                    pa.nulls(n, pa.float64()) if number is None else pa.array(number, pa.float64()), pa.nulls(n, pa.string()) if text is None else pa.array(text, pa.string())]
            return pa.RecordBatch.from_arrays(cols, ["tab", "id", "field", "number", "text"])

        for b in batches:
            if not b.num_rows:
                continue
            rid, x, base, cells = b.column(0), *(matrix(b.column(c), width) for c in (1, 7, 8))
            u, _, _ = record_factors(x, mean, v)
            p = np.nan_to_num(base) + u @ v.T + mean
            p = np.where(np.isnan(cells), p, cells)  # the same reading in the other table stands
            ask = np.nonzero(np.nan_to_num(b.column(2).to_numpy(zero_copy_only=False).astype(float)))[0]
            if len(ask) and n_lang:
                share = base[ask, language_at:]
                best = np.where(share > 0, p[ask, language_at:], -np.inf).argmax(1)  # ties: the first by name
                yield part(rid.take(pa.array(ask)), "site", "language", text=[languages[i] for i in best])
            lo, hi = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (3, 4))
            ask = np.nonzero(~np.isnan(lo))[0]
            yield part(rid.take(pa.array(ask)), "seed_site", "low_back_merge", number=np.clip(p[ask, merge_at], lo[ask], hi[ask]))
            lo, hi = matrix(b.column(5), k), matrix(b.column(6), k)
            i, j = np.nonzero(~np.isnan(lo))
            yield part(rid.take(pa.array(i)), "spatial_model", [keys[c] for c in j], number=np.clip(p[i, j], lo[i, j], hi[i, j]))

    wanted = F.exists("lo", lambda e: e.isNotNull()) | F.col("w_lo").isNotNull() | F.coalesce("want_language", F.lit(False))
    order = ("rid", "x", "want_language", "w_lo", "w_hi", "lo", "hi", "base", "cells")
    return records.filter(wanted).select(*order).mapInArrow(decode, _FILLED)


def hidden(df: DataFrame, id_column: str, column: str, seed: int, array: bool = False, one_in: int = 8) -> DataFrame:
    """``df`` with one in ``one_in`` cells of ``column`` made null by a hash of the id (and, in an array, of the place)."""
    def out(i: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(id_column), i, F.lit(seed)), F.lit(one_in)) == 0
    c = F.col(column)
    gone = F.transform(c, lambda x, i: F.when(~out(i), x)) if array else F.when(~out(F.lit(0)), c)
    return df.withColumn(column, gone)


def held_out(site: DataFrame, seed_site: DataFrame, spatial_model: DataFrame, accent_feature: DataFrame) -> DataFrame:
    """(tab, n, error, group_error): how far fills are from known cells that were hidden, and how far the group's mean is.

    Numbers: mean absolute error; languages: share of wrong ones, against the group's commonest. Repeated ids are hidden
    alike.
    """
    shown = hidden(site, "id", "language", 1), hidden(seed_site, "id", "low_back_merge", 2), hidden(spatial_model, "site_id", "norm_values", 3, True)
    filled = written(fill_sites(*shown, accent_feature), "filled")
    keys = accent_feature.filter("key IS NOT NULL").select("key", (F.row_number().over(Window.orderBy("key")) - 1).alias("i"))  # a row per feature
    own = site.groupBy(F.col("id").cast("string").alias("id")).agg(
        F.max(code(F.col("language"))).alias("language"), F.min("country").alias("country"), F.min("settlement_id").alias("place"))
    truth_l = own.select("id", F.lit("site").alias("tab"), F.lit("language").alias("field"), F.lit(None).cast("double").alias("x"), F.col("language").alias("t"), F.col("place").alias("grp"))
    truth_d = seed_site.groupBy(F.col("id").cast("string").alias("id")).agg(
        F.max(unit(F.col("low_back_merge"))).alias("x"), F.concat_ws("|", F.min("country"), F.max(code(F.col("lang")))).alias("grp")).select(
        "id", F.lit("seed_site").alias("tab"), F.lit("low_back_merge").alias("field"), "x", F.lit(None).cast("string").alias("t"), "grp")
    cell = spatial_model.select(F.col("site_id").cast("string").alias("id"), F.posexplode("norm_values").alias("i", "v")).join(F.broadcast(keys), "i")
    truth_m = cell.groupBy("id", F.col("key").alias("field")).agg(F.max(unit(F.col("v"))).alias("x")).join(own, "id").select(
        "id", F.lit("spatial_model").alias("tab"), "field", "x", F.lit(None).cast("string").alias("t"), F.concat_ws("|", "country", "language").alias("grp"))
    truth = truth_l.unionByName(truth_d).unionByName(truth_m)
    asked = truth.filter("x IS NOT NULL OR t IS NOT NULL").join(filled, ["tab", "id", "field"], "left")
    seen = asked.filter("number IS NULL AND text IS NULL AND grp IS NOT NULL").groupBy("tab", "field", "grp").agg(F.avg("x").alias("mean"), F.mode("t", True).alias("mode"))
    test = asked.filter("number IS NOT NULL OR text IS NOT NULL").join(seen, ["tab", "field", "grp"])
    off = lambda got, text: F.when(F.col("x").isNotNull(), F.abs(F.col("x") - F.col(got))).otherwise((F.col("t") != F.col(text)).cast("double"))
    return test.groupBy("tab").agg(F.count("*").alias("n"), F.avg(off("number", "text")).alias("error"), F.avg(off("mean", "mode")).alias("group_error"))


def with_flags(table: DataFrame, id_column: str, column: str, filled: DataFrame, tab: str, value: str) -> DataFrame:
    """``table`` with missing cells of ``column`` filled and a boolean ``<column>_filled``."""
    own = filled.filter((F.col("tab") == tab) & (F.col("field") == column)).select(F.col("id").alias("__id"), F.col(value).alias("__value"))
    joined = table.join(own, table[id_column] == F.col("__id"), "left")
    return joined.withColumn(column, F.coalesce(F.col("__value"), F.col(column))).withColumn(
        f"{column}_filled", F.col("__value").isNotNull()).drop("__id", "__value")
