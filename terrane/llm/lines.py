"""Line and paragraph hashing: exact removal of repeated units, the earliest kept, original offsets retained."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import without_name_clash, written

#: What ends a unit.
BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*")}
_BLANK = re.compile(r"[ \t\n\v\f\r]+")
#: Normalised characters of the shortest unit that is looked at.
SHORTEST = 30
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())])


def normal(unit: str) -> str:
    """A unit in lower case, with single blanks and none at its ends (blanks of ASCII)."""
    return _BLANK.sub(" ", unit).strip(" ").lower()


def _units(by: str):
    breaks = BREAKS[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text, start = text.as_py(), 0
                for end, after in [*((m.start(), m.end()) for m in breaks.finditer(text)), (len(text), len(text))]:
                    n = normal(text[start:end])
                    if len(n) >= SHORTEST:
                        out.append((i, start, end, hashlib.blake2b(n.encode("utf-8", "surrogatepass"), digest_size=16).digest()))
                    start = after
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return run


def repeated_units(documents: DataFrame, by: str = "line") -> DataFrame:
    """(doc_id, start, end, first_id, removed): every unit whose normal form occurs again, with its offsets in the text as
    delivered (end excluded), the record of its earliest occurrence, and whether it is a later one, to be removed.

    The earliest is that of the smallest doc_id, within a record that of the smallest offset. Units shorter than SHORTEST
    normalised characters stay out; null texts and rows without doc_id have no units; rows that repeat a doc_id with one
    text count once.
    """
    docs = without_name_clash(documents, "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    units = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _units(by), "doc_id long, start int, end int, digest binary").distinct(), "units")
    first = F.min(F.struct("doc_id", "start"))
    repeated = units.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    return units.join(repeated, "digest").select(
        "doc_id", "start", "end", F.col("first.doc_id").alias("first_id"),
        ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).alias("removed"))
