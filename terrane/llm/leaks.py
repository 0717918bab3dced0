"""Evaluation passages inside a corpus, word for word or with other numbers and names.

Words are runs of letters and digits of the NFKD form without case, accents and format characters. Each word is either
literal or a slot: a number, a code, a unit or a name. The template of a window has typed placeholders for its slots.
Windows of WORDS words of documents whose template occurs among the items (a bitmap rules out nearly all others) are
hash-joined to the items' windows; equal slots make a leak, other but consistent slots a re-parameterised item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.llm.hashing import mix, window_hashes
from terrane.session import small, without_name_clash, written

WORDS = 12
#: Bits of the item bitmap: 32 per window of an item between these bounds (128 KB and 16 MB). Beyond, it lets more through.
LEAST_BITS, MOST_BITS = 20, 27
#: Bits of each vocabulary filter (4 MB) and hashes per word. A filter is right for the items' own words at any size.
FILTER_BITS, FILTER_HASHES = 25, 4
#: Units of measurement (fixed values).
UNITS = frozenset("ms s hz khz db st km m percent points months semitones".split())
#: Placeholders by kind of word.
LITERAL, NUMBER, CODE, UNIT, NAME = range(5)

_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"[-\u2010][^\S\n]*\r?\n\s*")
_SOFT = re.compile("\u00ad(?=[^\\S\\n]*\\r?\\n)")
_SENTENCE = re.compile(r"[.!?:]\W*$")


@lru_cache(maxsize=None)
def _dropped(c: str) -> bool:
    """Whether a character is a mark or a format character."""
    return unicodedata.category(c) in ("Cf", "Mn", "Me")


def _joined(m: re.Match) -> str:
    """Nothing for a hyphen at a line end between word characters."""
    a, b = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
    return "" if a.isalnum() and b.isalnum() else m[0]


def plain(text: str) -> str:
    """NFKD text without accents and format characters, words broken at a line end joined; case is kept."""
    if not text.isascii():
        if "\u00ad" in text:
            text = _SOFT.sub("-", text)
        text = unicodedata.normalize("NFKD", text)
        for c in set(text):
            if c > "\x7f" and _dropped(c):
                text = text.replace(c, "")
    return _BROKEN.sub(_joined, text) if "\n" in text else text


def words(text: str) -> list[str]:
    """The words of a text, folded."""
    return [w.casefold() for w in _WORD.findall(plain(text))]


def word_hashes(words_: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return pd.util.hash_array(np.array(words_, object), categorize=False) if words_ else np.zeros(0, np.uint64)


def _at(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether each bit is set in an array of 64-bit words."""
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


def _bits(bits: np.ndarray) -> int:
    """Binary logarithm of the bits in such an array."""
    return len(bits).bit_length() + 5


class Templates:
    """Word kinds and hashes. The kind of a word of the items depends on the folded word alone, so windows with equal words
    have equal templates whatever their case; only words that no item has are names by their capital."""

    def __init__(self, names: np.ndarray, literals: np.ndarray):
        self.names, self.literals, self.seen = names, literals, {}
        self.bits = _bits(names)

    def kind(self, cased: str, w: str, name: bool, literal: bool) -> int:
        if not w.isalpha() and any(c.isdigit() for c in w):
            return NUMBER if w.isdigit() else CODE
        if w in UNITS:
            return UNIT
        return NAME if name or not literal and cased[:1].isupper() else LITERAL

    def learn(self, tokens: list[str]) -> None:
        """Hashes and kinds of tokens not seen before."""
        new = [t for t in tokens if t not in self.seen]
        if len(self.seen) + len(new) > 500_000:
            self.seen.clear()
            new = tokens
        folded = [t.casefold() for t in new]
        h = word_hashes(folded)
        at = filter_slots(h, self.bits)
        known = zip(_at(self.names, at).all(1).tolist(), _at(self.literals, at).all(1).tolist())
        kinds = np.array([self.kind(t, w, *k) for t, w, k in zip(new, folded, known)], np.uint64)
        template = mix(np.where(kinds == LITERAL, h, kinds))
        for t, x, y, kind in zip(new, template.tolist(), h.tolist(), kinds.tolist()):
            self.seen[t] = (x, y, kind == LITERAL)

    def hashes(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(template, word) hashes of a sequence; each different token is looked at once."""
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        different = coded.dictionary.to_pylist()
        self.learn(different)
        pairs = np.array([self.seen[t][:2] for t in different], np.uint64).reshape(-1, 2)
        at = coded.indices.to_numpy()
        return pairs[at, 0], pairs[at, 1]

    def shown(self, tokens: list[str], by: str) -> list[str]:
        """The folded words, or only those of slots (nothing for a literal, which is the same wherever its template is).
        Tokens have been through ``hashes``."""
        return [w.casefold() if by == EXACT or not self.seen[w][2] else "" for w in tokens]


#: How slots are compared: equal, or consistent.
EXACT, PART = "exact", "part"


def filter_slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Bits of a word's hash in a vocabulary filter of 2**bits bits, a row per word."""
    k = np.arange(FILTER_HASHES, dtype=np.uint64)
    return (mix(h[:, None] + k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _gathered(positions: DataFrame, bits: int) -> np.ndarray:
    """An array of 2**bits bits with those of column ``bit`` (long) set. At most 2**(bits - 6) rows come to the driver."""
    words = positions.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return out


def vocabulary(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Filters (names, literals) of the items' words: names are those always written with a capital inside sentences.

    Words are classed where they lie; what comes to the driver are two filters of a fixed size.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, bool, bool], None] = {}
            for text in b.column(0).to_pylist():
                text = plain(text or "")
                end = 0
                for m in _WORD.finditer(text):
                    opens = not end or bool(_SENTENCE.search(text[end : m.start()]))
                    end = m.end()
                    seen[m[0].casefold(), m[0][:1].isupper(), opens] = None
            yield pa.RecordBatch.from_pylist(
                [{"word": w, "upper": u, "opens": o} for w, u, o in seen],
                pa.schema([("word", pa.string()), ("upper", pa.bool_()), ("opens", pa.bool_())]),
            )

    bits = FILTER_BITS

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = filter_slots(word_hashes(b.column(0).to_pylist()), bits)
            name = np.repeat(b.column(1).to_numpy(zero_copy_only=False), FILTER_HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(name)], ["bit", "name"])

    word = items.select("text").mapInArrow(split, "word string, upper boolean, opens boolean").groupBy("word").agg(
        (F.max((F.col("upper") & ~F.col("opens")).cast("int")) > F.max((~F.col("upper")).cast("int"))).alias("name"))
    found = written(word.mapInArrow(slots, "bit long, name boolean").distinct(), "vocabulary")
    return _gathered(found.filter("name"), bits), _gathered(found.filter("NOT name"), bits)


_WINDOWS = "id long, key long, word_key long, pos int, text string"
_SCHEMA = pa.schema([
    ("id", pa.int64()), ("key", pa.int64()), ("word_key", pa.int64()), ("pos", pa.int32()), ("text", pa.string()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _SCHEMA)], schema=_SCHEMA)


def _item_windows(t: Templates, by: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(*(b.column(k).to_pylist() for k in (0, 1))):
                tokens = _WORD.findall(plain(text or ""))
                if len(tokens) < WORDS:
                    continue
                keys = [window_hashes(h, WORDS).view(np.int64).tolist() for h in t.hashes(tokens)]
                shown = t.shown(tokens, by)
                for p, (key, word_key) in enumerate(zip(*keys)):
                    if by == EXACT or not all(shown[p : p + WORDS]):  # placeholders alone say nothing
                        out.append((i, key, word_key, p, " ".join(shown[p : p + WORDS])))
            yield _batch(out)

    return run


def _document_windows(t: Templates, template_bits: np.ndarray, word_bits: np.ndarray | None, by: str):
    """Windows of documents that the bitmaps let through: by template, and where slots must be equal also by words."""
    def passed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return _at(bits, (keys >> np.uint64(64 - _bits(bits))).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids, docs):
            tokens = [w for d in docs for w in d]
            bounds = np.cumsum([0, *map(len, docs)])
            template, word = t.hashes(tokens)
            keys = window_hashes(template, WORDS)
            at = np.nonzero(passed(template_bits, keys))[0]
            words = window_hashes(word, WORDS)
            if word_bits is not None:
                at = at[passed(word_bits, words[at])]
            which = np.searchsorted(bounds, at, "right") - 1
            inside = at + WORDS <= bounds[which + 1]
            at, which = at[inside], which[inside]
            texts = [" ".join(t.shown(tokens[p : p + WORDS], by)) for p in at.tolist()]
            return pa.RecordBatch.from_arrays([
                pa.array(np.array(ids, np.int64)[which]), pa.array(keys[at].view(np.int64)), pa.array(words[at].view(np.int64)),
                pa.array((at - bounds[which]).astype(np.int32)), pa.array(texts, pa.string())], schema=_SCHEMA)

        for b in batches:
            ids, docs, size = [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = _WORD.findall(plain(text.as_py() or ""))
                if len(tokens) < WORDS:
                    continue
                ids.append(i), docs.append(tokens)
                size += len(tokens)
                if size > 200_000:
                    yield done(ids, docs)
                    ids, docs, size = [], [], 0
            if docs:
                yield done(ids, docs)

    return run


def candidates(documents: DataFrame, items: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(windows of documents, windows of items) to be joined by the key of their templates."""
    items = without_name_clash(items, "item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    documents = without_name_clash(documents, "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    t = Templates(*vocabulary(items))
    wanted = written(items.mapInArrow(_item_windows(t, by), _WINDOWS), "items")
    bits = min(MOST_BITS, max(LEAST_BITS, wanted.count().bit_length() + 5))
    maps = [_gathered(wanted.select(F.shiftrightunsigned(k, 64 - bits).alias("bit")), bits) for k in ("key", "word_key")]
    found = documents.mapInArrow(_document_windows(t, maps[0], maps[1] if by == EXACT else None, by), _WINDOWS)
    return found, wanted


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, doc_word): documents that hold WORDS or more consecutive words of an item.

    ``n_windows`` counts the item's windows found, ``doc_word`` is the first such word's number in the document. Null
    texts hold nothing; items shorter than WORDS can't be found; repeated rows count once.
    """
    found, wanted = candidates(documents, items, EXACT)
    d = found.select(F.col("id").alias("doc_id"), "key", "pos", "text")
    i = wanted.select(F.col("id").alias("item_id"), "key", "text", F.col("pos").alias("item_word")).distinct()
    # one template, and all slots (with the literals, against a clash of hashes) equal
    return d.join(small(i, 160), ["key", "text"]).groupBy("doc_id", "item_id").agg(
        F.countDistinct("item_word").alias("n_windows"), F.min("pos").alias("doc_word")
    )


def reparameterised(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, changed, words): documents that hold WORDS or more consecutive words of an item with other numbers
    or names, used consistently.

    Windows of one template that follow one another in both texts are one passage. Every word of the item's passage stands
    for one word of the document throughout. ``changed`` counts the words that differ, in the passage with the fewest;
    ``words`` is the length of the longest such passage. Windows of placeholders only say nothing.
    """
    found, wanted = candidates(documents, items, PART)
    d = found.select(F.col("id").alias("doc_id"), "key", "pos", F.split("text", " ").alias("here"))
    i = wanted.select(F.col("id").alias("item_id"), "key", F.col("pos").alias("item_word"), F.split("text", " ").alias("there")).distinct()
    shift = F.col("pos") - F.col("item_word")
    parts = d.join(small(i, 300), "key").select(
        "doc_id", "item_id", "pos", shift.alias("shift"), F.array_distinct(F.arrays_zip("there", "here")).alias("pairs")).distinct()
    at = Window.partitionBy("doc_id", "item_id", "shift").orderBy("pos")
    runs = parts.withColumn("run", F.col("pos") - F.row_number().over(at)).groupBy("doc_id", "item_id", "shift", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), (F.count("*") + WORDS - 1).alias("words"))
    pairs = F.col("pairs")
    consistent = F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["there"])))
    changed = F.size(F.filter(pairs, lambda p: p["there"] != p["here"]))
    return runs.filter(consistent).withColumn("changed", changed).filter("changed > 0").groupBy("doc_id", "item_id").agg(
        F.min("changed").alias("changed"), F.max("words").alias("words")
    )
