"""Long exact spans shared between records.

Each text is cut into content-chosen lines: UNIT characters that start where the hash of those characters is the least of
WINDOW neighbours. Two texts that share LEAST = UNIT + WINDOW - 1 characters anywhere choose at least one line in common,
which lines at line breaks or paragraphs can't promise. Line digests are grouped globally; each occurrence of a digest
found in two or more records gets its surrounding characters, and the characters themselves decide what is shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.llm.hashing import mix, sliding_min, window_hashes
from terrane.session import small, without_name_clash, written

LEAST = 300
UNIT = 200
WINDOW = LEAST - UNIT + 1
CONTEXT = LEAST - UNIT
#: Occurrences of a digest that are compared pair by pair in one row; larger groups go by the digests of all their spans.
GROUP = 48
#: Characters hashed at once.
_SEGMENT = 1 << 20
_MASK = np.uint64((1 << 21) - 1)


def _chosen(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and digests of the chosen lines of texts laid end to end."""
    h = window_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), UNIT)
    n = len(h)
    keys = (h & ~_MASK) | (_MASK - np.arange(n, dtype=np.uint64))  # of equal hashes the rightmost is least
    least = sliding_min(keys, WINDOW)
    valid = np.zeros(len(least) + 1, np.int32)
    reach = ends - LEAST + 1  # windows that start before this lie inside the text
    some = reach > starts
    np.add.at(valid, np.minimum(starts[some], len(least)), 1)
    np.add.at(valid, np.minimum(reach[some], len(least)), -1)
    at = (_MASK - (np.unique(least[np.cumsum(valid)[:-1] > 0]) & _MASK)).astype(np.int64)
    at.sort()
    return at, h[at]


def _thinned(at: np.ndarray, h: np.ndarray, which: np.ndarray) -> np.ndarray:
    """In periodic text one line repeats at once. Those less than CONTEXT characters from either end of such a run are all
    kept. The others see the same characters around them, so one for every CONTEXT characters and the last stand for all."""
    if not len(at):
        return np.zeros(0, bool)
    new = np.r_[True, (h[1:] != h[:-1]) | (which[1:] != which[:-1])]
    starts = np.nonzero(new)[0]
    sizes = np.diff(np.r_[starts, len(at)])
    ahead, behind = at - np.repeat(at[starts], sizes), np.repeat(at[starts + sizes - 1], sizes) - at
    edge, part = (ahead < CONTEXT) | (behind < CONTEXT), ahead // CONTEXT
    return edge | np.r_[True, edge[:-1] | (part[1:] != part[:-1])] | np.r_[edge[1:], True]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, doc_id, pos) of the chosen lines of whole texts."""
    def done(ids, parts, offsets):
        codes = np.concatenate(parts)
        starts = np.cumsum([0, *map(len, parts)])
        at, h = _chosen(codes, starts[:-1], starts[1:])
        which = np.searchsorted(starts, at, "right") - 1
        kept = _thinned(at, h, which)
        at, h, which = at[kept], h[kept], which[kept]
        pos = at - starts[which] + np.array(offsets, np.int64)[which]
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(np.array(ids, np.int64)[which]), pa.array(pos.astype(np.int32))],
            ["digest", "doc_id", "pos"],
        )

    for batch in batches:
        ids, parts, offsets, size = [], [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if len(text) < LEAST:
                continue
            for s in range(0, max(1, len(text) - LEAST + 1), _SEGMENT - LEAST):  # parts overlap by a window
                piece = _codes(text[s : s + _SEGMENT])
                if size + len(piece) > _SEGMENT and parts:
                    yield done(ids, parts, offsets)
                    ids, parts, offsets, size = [], [], [], 0
                ids.append(i), parts.append(piece), offsets.append(s)
                size += len(piece)
        if parts:
            yield done(ids, parts, offsets)


def _with_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chosen line with the characters before it and from it on."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("digest", "n", "doc_id", "pos", "before", "onward")}
        size = 0
        for i, text, marks in zip(*(batch.column(k) for k in range(3))):
            text, i = text.as_py(), i.as_py()
            for m in marks.as_py():
                p = m["pos"]
                for k, v in zip(out, (m["digest"], m["n"], i, p, text[max(0, p - CONTEXT) : p], text[p : p + LEAST])):
                    out[k].append(v)
                size += 1
                if size >= 20_000:
                    yield pa.RecordBatch.from_pydict(out, _CONTEXT_SCHEMA)
                    out, size = {k: [] for k in out}, 0
        yield pa.RecordBatch.from_pydict(out, _CONTEXT_SCHEMA)


_CONTEXT_SCHEMA = pa.schema([
    ("digest", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("before", pa.string()), ("onward", pa.string()),
])


def _common(a: str, b: str) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


_SHARED_SCHEMA = pa.schema([
    ("doc_a", pa.int64()), ("doc_b", pa.int64()), ("start_a", pa.int32()), ("start_b", pa.int32()), ("length", pa.int32()),
])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one digest's occurrences that really share LEAST characters, with the part seen around the line."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in _SHARED_SCHEMA.names}
        for group in batch.column(0):
            members = [(m["doc_id"], m["pos"], m["before"][::-1], m["onward"]) for m in group.as_py()]
            for j in range(1, len(members)):
                db, pb, lb, rb = members[j]
                for da, pa_, la, ra in members[:j]:
                    if da == db:
                        continue
                    right = _common(ra, rb)
                    if right < UNIT or right + CONTEXT < LEAST:
                        continue
                    left = _common(la, lb)
                    if left + right < LEAST:
                        continue
                    row = (da, db, pa_ - left, pb - left, left + right) if da < db else (db, da, pb - left, pa_ - left, left + right)
                    for k, v in zip(out, row):
                        out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, _SHARED_SCHEMA)


def _occurrences(documents: DataFrame) -> DataFrame:
    """Every line found in two or more records, with its context: (digest, n, doc_id, pos, before, onward)."""
    docs = without_name_clash(documents, "doc_id", "text").filter(
        F.col("doc_id").isNotNull() & (F.length("text") >= LEAST)
    ).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = written(docs.mapInArrow(_lines, "digest long, doc_id long, pos int"), "lines")
    repeated = lines.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").cast("int").alias("n")
    ).filter("first < last").select("digest", "n")
    kept = lines.join(repeated, "digest")
    marks = written(kept.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "digest", "n")).alias("marks")), "marks")
    found = docs.join(small(marks.select("doc_id"), 16), "doc_id", "left_semi")
    return written(found.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(
        _with_context, "digest long, n int, doc_id long, pos int, before string, onward string"
    ), "context")


def _compared(occurrences: DataFrame) -> DataFrame:
    """Verified pairs of the digests with at most GROUP occurrences."""
    members = F.collect_list(F.struct("doc_id", "pos", "before", "onward")).alias("members")
    return occurrences.filter(F.col("n") <= GROUP).groupBy("digest").agg(members).select("members").mapInArrow(
        _compare, "doc_a long, doc_b long, start_a int, start_b int, length int"
    )


#: Digest of the span that begins ``a`` characters before the line, null where the text is too short for it.
_KEY = (
    f"CASE WHEN length(before) >= a AND length(onward) >= {LEAST} - a "
    f"THEN sha2(concat(right(before, a), left(onward, {LEAST} - a)), 256) END"
)


def _hot_spans(occurrences: DataFrame) -> DataFrame:
    """For digests with more occurrences, each span of LEAST characters around the line that two or more records hold:
    (doc_id, start, span, first). Spans are named by their SHA-256, so what is left pairs up without false candidates.

    A span has half of CONTEXT more on one side of the line at least, so an occurrence spells out only those spans whose
    half side, checked first by one hash, is found in another record too. A footer shorter than a span costs two hashes.
    """
    half = CONTEXT // 2
    left = F.when(F.length("before") >= half, F.xxhash64("digest", F.lit(0), F.expr(f"right(before, {half})")))
    right = F.when(F.length("onward") >= UNIT + half, F.xxhash64("digest", F.lit(1), F.expr(f"substring(onward, {UNIT + 1}, {half})")))
    hot = occurrences.filter(F.col("n") > GROUP).withColumn("left", left).withColumn("right", right)
    sides = hot.select("doc_id", F.explode(F.array_compact(F.array("left", "right"))).alias("side")).groupBy("side").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    sides = written(sides.select("side"), "sides")
    n = sides.count()
    for side in ("left", "right"):
        there = small(sides.select(F.col("side").alias(side), F.lit(True).alias(f"{side}_there")), 16, n)
        hot = hot.join(there, side, "left")
    offsets = F.array_distinct(F.concat(
        F.when(F.col("right_there"), F.sequence(F.lit(0), F.lit(half))).otherwise(F.array().cast("array<int>")),
        F.when(F.col("left_there"), F.sequence(F.lit(half), F.lit(CONTEXT))).otherwise(F.array().cast("array<int>"))))
    spans = hot.withColumn("a", F.explode(offsets)).select(
        "doc_id", (F.col("pos") - F.col("a")).alias("start"), F.expr(_KEY).alias("span")).filter("span IS NOT NULL")
    groups = spans.groupBy("span").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return spans.join(groups.select("span", "first"), "span")


def span_classes(hot: DataFrame) -> DataFrame:
    """(class, doc_id): records by the spans they share, one class for all spans that the same records hold.

    A long shared text has many shifted spans with one set of holders; sets are told apart by their size and two sums of
    64-bit hashes of the holders, which add up on the map side.
    """
    held = hot.select("span", "doc_id").distinct()
    sums = [F.sum(F.xxhash64("doc_id", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2)]
    sets = held.groupBy("span").agg(F.count("*").alias("size"), *sums).groupBy("size", "h1", "h2").agg(F.min("span").alias("span"))
    return held.join(sets.select("span"), "span").select(F.col("span").alias("class"), "doc_id")


def sharing_pairs(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every two records that share a stretch of at least LEAST characters.

    Characters are code points, compared exactly. Null or shorter texts share nothing; rows that repeat a doc_id with the
    same text count once; rows without doc_id are left out.
    """
    occurrences = _occurrences(documents)
    classes = written(span_classes(_hot_spans(occurrences)), "classes")
    other = classes.select("class", F.col("doc_id").alias("doc_b"))
    by_class = classes.withColumnRenamed("doc_id", "doc_a").join(other, "class").filter("doc_a < doc_b")
    return _compared(occurrences).select("doc_a", "doc_b").union(by_class.select("doc_a", "doc_b")).distinct()


def shared_parts(documents: DataFrame) -> DataFrame:
    """Merged intervals (doc_id, later, start, end) of each text that occur in another record.

    ``later`` is true for the parts that also occur in a record of smaller doc_id, which is the one to keep.
    """
    occurrences = _occurrences(documents)
    pairs, hot = _compared(occurrences), _hot_spans(occurrences)
    parts = pairs.select(F.inline(F.array(
        F.struct(F.col("doc_a").alias("doc_id"), F.lit(False).alias("later"), F.col("start_a").alias("start"), "length"),
        F.struct(F.col("doc_b").alias("doc_id"), F.lit(True).alias("later"), F.col("start_b").alias("start"), "length"),
    ))).union(hot.select("doc_id", F.col("doc_id") > F.col("first"), "start", F.lit(LEAST)))
    ends = parts.groupBy("doc_id", "later", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    ends = ends.union(ends.filter("later").withColumn("later", F.lit(False)))  # what an earlier record holds is shared too
    w = Window.partitionBy("doc_id", "later").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ends.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "later", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def shared_report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share, removable_chars) of every record; a null text has no characters."""
    parts = shared_parts(documents).groupBy("doc_id").agg(
        F.sum(F.when(~F.col("later"), F.col("end") - F.col("start"))).alias("shared"),
        F.sum(F.when(F.col("later"), F.col("end") - F.col("start"))).alias("removable"),
    )
    docs = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).dropDuplicates(["doc_id"])
    shared = F.coalesce("shared", F.lit(0)).cast("long")
    return docs.join(parts, "doc_id", "left").select(
        "doc_id", "n_chars", shared.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("share"),
        F.coalesce("removable", F.lit(0)).cast("long").alias("removable_chars"),
    )


def removals(documents: DataFrame) -> DataFrame:
    """(doc_id, start, end): the parts to remove so that the earliest record keeps each shared stretch; offsets are those
    of the original text, counted in characters from 0, end excluded."""
    return shared_parts(documents).filter("later").select("doc_id", "start", "end")
