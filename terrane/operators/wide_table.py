"""Attribute-value rows to one typed row per entity.

Keys and values are read by column expressions; RDD combineByKey then fills a register of slots per entity, one slot per
attribute. Merging two cells of a slot keeps the later one, which is associative, so repeats resolve on the map side and
what is shuffled is at most one register per entity and partition, however many rows an entity has.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import written

#: Attributes that aren't plain numbers (fixed types of the project); all others are double.
TYPES = {
    "survey_year": "integer", "speaker_count": "integer", "is_urban": "boolean", "transcribed": "boolean",
    "first_visit": "date", "recordist": "code",
}
#: Attributes at most; a table wider than this should stay in rows.
ATTRIBUTES = 5000
_SPARK = {"integer": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "code": T.StringType(), "double": T.DoubleType()}
_NUMBER = r"^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?\s*(ms|st|%|index|units)?$"


def snake(key: Column) -> Column:
    """A key in lower snake case; null where nothing is left."""
    split = F.regexp_replace(F.trim(key), r"([\p{Ll}0-9])(\p{Lu})", "$1_$2")
    name = F.regexp_replace(F.lower(F.regexp_replace(split, r"[^\p{L}0-9]+", "_")), r"^_+|_+$", "")
    return F.when(name != "", name)


def with_number(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds a double read from trimmed text with sign, decimal point or comma, exponent and unit; null if it isn't one."""
    digits = F.regexp_replace(F.regexp_replace(F.col(value), r"\s*(ms|st|%|index|units)$", ""), ",", ".")
    read = df.withColumn(out, F.when(F.col(value).rlike(_NUMBER), digits).try_cast("double"))
    return read.withColumn(out, F.when(F.abs(out) < float("inf"), F.col(out)))


def as_boolean(v: Column) -> Column:
    """A boolean from trimmed text."""
    v = F.lower(v)
    return F.when(v.isin("true", "yes", "y", "t", "1"), True).when(v.isin("false", "no", "n", "f", "0"), False)


def as_date(v: Column) -> Column:
    """A date from trimmed text: Y-M-D, Y/M/D, D.M.Y or YYYYMMDD."""
    ymd = F.when(v.rlike(r"^[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}$"), F.regexp_replace(v, "/", "-"))
    dmy = F.when(v.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), F.regexp_replace(v, r"^(\d+)\.(\d+)\.(\d+)$", "$3-$2-$1"))
    solid = F.when(v.rlike(r"^[0-9]{8}$"), F.regexp_replace(v, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3"))
    return F.coalesce(ymd, dmy, solid).try_cast("date")


def as_code(v: Column) -> Column:
    """A letter and three digits from trimmed text, in upper case."""
    return F.when(v.rlike(r"^[A-Za-z][0-9]{3}$"), F.upper(v))


def _of(kind: str) -> list[str]:
    return [name for name, k in TYPES.items() if k == kind]


def cells(rows: DataFrame, entities: DataFrame, entity: str, key: str, value: str, order: str, entity_id: str) -> DataFrame:
    """Readable cells (entity, attr, at, number, text) of known entities; number or text holds the value."""
    at = F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-(1 << 62)))
    known = entities.select(F.col(entity_id).cast("string").alias("entity")).filter("entity IS NOT NULL").distinct()
    raw = rows.select(F.col(entity).cast("string").alias("entity"), F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"), at.alias("at"))
    raw = raw.filter("k IS NOT NULL AND v IS NOT NULL").join(known, "entity", "left_semi").select(
        "entity", "at", snake(F.col("k")).alias("attr"), F.regexp_replace("v", r"^\s+|\s+$", "").alias("v"))
    read = with_number(raw, "v", "x")
    attr, x, v = F.col("attr"), F.col("x"), F.col("v")
    whole = (x == F.floor(x)) & (F.abs(x) < 9e15)
    number = (
        F.when(attr.isin(*_of("integer")), F.when(whole, x))
        .when(attr.isin(*_of("boolean")), as_boolean(v).cast("double"))
        .when(attr.isin(*_of("date")), F.unix_date(as_date(v)).cast("double"))
        .when(~attr.isin(*_of("code")), x)
    )
    text = F.when(attr.isin(*_of("code")), as_code(v))
    # written before it is filtered: a filter on read values would run every pattern again for each of its references
    typed = written(read.select("entity", "attr", "at", number.alias("number"), text.alias("text")), "typed")
    return typed.filter("attr IS NOT NULL AND (number IS NOT NULL OR text IS NOT NULL)")


def _latest(a: tuple, b: tuple) -> tuple:
    """The later of two cells (at, value); of equally late ones the greater value."""
    return a if a >= b else b


def wide(
    rows: DataFrame, entities: DataFrame, entity: str = "site_id", key: str = "key", value: str = "value",
    order: str = "loaded_at", entity_id: str = "id", always: tuple[str, ...] = (),
) -> DataFrame:
    """One row per entity with a readable value: the entity column and one typed column per attribute, by name.

    Keys and values that are null or unreadable make no cell; of several readable values of a cell the last by ``order``
    (null first, then the greater value) stands. Rows of entities that aren't in ``entities`` are left out. An attribute
    whose name equals the entity column's gets a trailing underscore. Attributes in ``always`` get a column in any case.
    """
    spark = rows.sparkSession
    read = cells(rows, entities, entity, key, value, order, entity_id)
    names = [r.attr for r in read.select("attr").distinct().orderBy("attr").limit(ATTRIBUTES + 1).collect()]
    names = sorted({*names, *always})
    if len(names) > ATTRIBUTES:
        raise ValueError(f"more than {ATTRIBUTES} attributes")
    kinds = [TYPES.get(n, "double") for n in names]
    slot = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])[F.col("attr")] if names else F.lit(0)
    typed = read.select("entity", slot.alias("slot"), "at", "number", "text")

    def create(cell):
        return {cell[0]: cell[1:]}

    def add(register, cell):
        old = register.get(cell[0])
        register[cell[0]] = cell[1:] if old is None else _latest(old, cell[1:])
        return register

    def merge(a, b):
        for s, cell in b.items():
            old = a.get(s)
            a[s] = cell if old is None else _latest(old, cell)
        return a

    epoch = dt.date(1970, 1, 1)
    encode = {
        "integer": int, "boolean": bool, "double": float, "code": str, "date": lambda x: epoch + dt.timedelta(days=int(x)),
    }
    encoders = [encode[k] for k in kinds]

    def row(item):
        out = [None] * len(encoders)
        for s, (_, x) in item[1].items():
            out[s] = encoders[s](x)
        return (item[0], *out)

    pairs = typed.rdd.map(lambda r: (r[0], (r[1], r[2], r[3] if r[4] is None else r[4])))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.getNumPartitions())
    registers = pairs.combineByKey(create, add, merge, numPartitions=parts)
    columns = [n + "_" * (n == entity) for n in names]
    schema = T.StructType([T.StructField(entity, T.StringType()), *[T.StructField(c, _SPARK[k]) for c, k in zip(columns, kinds)]])
    return spark.createDataFrame(registers.map(row), schema, verifySchema=False)


def filled_cells(table: DataFrame, entity: str = "site_id") -> DataFrame:
    """(entity, attr) of the non-null cells of a wide table."""
    attrs = [c for c in table.columns if c != entity]
    present = F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in attrs]) if attrs else F.array().cast("array<string>")
    return table.select(entity, F.explode(F.array_compact(present)).alias("attr"))
