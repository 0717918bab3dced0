"""Small readers and writers around the tables: WKT text, optional filters, JSON presets, append logs, refreshed layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def wkt_lines(text: Column) -> Column:
    """Arrays of struct<x, y>, one per bracketed list of a WKT text (LINESTRING, POLYGON, their multi forms, POINT); an SRID
    prefix is passed over. Null or empty geometry has none."""
    lists = F.regexp_extract_all(F.regexp_replace(text, r"^SRID=\d+;", ""), F.lit(r"\(([^()]+)\)"), F.lit(1))
    pairs = F.transform(lists, lambda t: F.regexp_extract_all(t, F.lit(rf"{_NUMBER}\s+{_NUMBER}"), F.lit(0)))
    return F.transform(pairs, lambda line: F.transform(line, lambda p: F.struct(
        F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y"))))


def wkt(line: Column) -> Column:
    """LINESTRING text of an array of struct<x, y>."""
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")"))


def where(df: DataFrame, **values) -> DataFrame:
    """Rows that equal every given value; a value of None doesn't restrict, a list means any of its members."""
    for column, v in values.items():
        if v is not None:
            df = df.filter(F.col(column).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(column) == v)
    return df


def bounded(name: str, value: int, low: int, high: int) -> int:
    """A parameter within its limits, or ValueError."""
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}, not {value}")
    return value


def write_presets(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Records with a value for every key as one sorted JSON-lines file; for dimension tables."""
    df.dropna(subset=keys).orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows with the time of writing to a log table."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def refresh(df: DataFrame, path: str) -> int:
    """Replace a derived layer and say how many rows it has."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def inventory(arrays: DataFrame, known: DataFrame, frequencies: dict[str, float]) -> DataFrame:
    """(language, ipa, freq): phones of array columns (one per frequency class), known ones only, the most frequent class first."""
    classes = F.array(*[F.struct(F.lit(freq).alias("freq"), F.col(c).alias("phones")) for c, freq in frequencies.items()])
    each = arrays.select("language", F.inline(classes)).select("language", "freq", F.explode("phones").alias("ipa"))
    return each.join(known.select("ipa").distinct(), "ipa", "left_semi").groupBy("language", "ipa").agg(F.max("freq").alias("freq"))
