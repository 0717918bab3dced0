"""Queries of the problems on texts and records for language-model training (p4, p6, p7, p8)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import clusters, leaks, lines, mixing, spans
from terrane.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share at least 300 characters."""
    return spans.sharing_pairs(load(spark, sf_dir, "documents"))


@query
def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document occurs elsewhere."""
    return spans.shared_report(load(spark, sf_dir, "documents"))


@query
def p8_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared parts that all but their earliest document can lose."""
    return spans.removals(load(spark, sf_dir, "documents"))


@query
def p8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur again, with the document that keeps them and the offsets to remove elsewhere."""
    return lines.repeated_units(load(spark, sf_dir, "documents"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evaluation items leaked into which document."""
    return leaks.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


@query
def p6_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an evaluation item with other numbers or names."""
    return leaks.reparameterised(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_item"))


@query
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: how many documents hold it and how much of it at most."""
    found = leaks.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_item"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_windows").alias("most_windows"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target sources that fall short even when used max_repeats times."""
    _, report = mixing.mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target"))
    return report.filter("short").select("source")


@query
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal, tokens reached and share of each source of the mix."""
    return mixing.mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target"))[1]


@query
def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mix."""
    return mixing.mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target"))[0]


@query
def p7_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the largest mix in which every source has its target share."""
    return mixing.mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target"), reachable=True)[1]


_P4_FIELDS = ("rhoticity", "goose_f2", "trap_bath", "vot_ms")


def _p4(spark: SparkSession, sf_dir: str, closed: bool = True) -> DataFrame:
    scale = load(spark, sf_dir, "accent_feature").filter(F.col("key").isin(*_P4_FIELDS)).select(
        "key", F.col("lo").cast("double"), F.col("hi").cast("double")).collect()
    limits = {r.key: (r.lo, r.hi) for r in scale}
    return clusters.grouped(load(spark, sf_dir, "seed_site"), "id", {f: limits[f] for f in _P4_FIELDS}, closed=closed)


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each grouped record with the least id of its group."""
    return clusters.members(_p4(spark, sf_dir))


@query
def p4_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by average linkage alone: groups whose records are alike on average, chains cut."""
    return clusters.members(_p4(spark, sf_dir, closed=False))


@query
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical sites of each group."""
    return clusters.described(_p4(spark, sf_dir))


SQL["p4_found"] = """
WITH RECURSIVE lim AS (SELECT key, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM accent_feature), r AS (
  SELECT DISTINCT s.id, (s.rhoticity - a.lo) / (a.hi - a.lo) AS x, (s.goose_f2 - b.lo) / (b.hi - b.lo) AS y,
         (s.trap_bath - c.lo) / (c.hi - c.lo) AS z, (s.vot_ms - d.lo) / (d.hi - d.lo) AS w
  FROM seed_site s, lim a, lim b, lim c, lim d
  WHERE a.key = 'rhoticity' AND b.key = 'goose_f2' AND c.key = 'trap_bath' AND d.key = 'vot_ms'
    AND s.rhoticity BETWEEN a.lo AND a.hi AND s.goose_f2 BETWEEN b.lo AND b.hi
    AND s.trap_bath BETWEEN c.lo AND c.hi AND s.vot_ms BETWEEN d.lo AND d.hi
), e AS (
  SELECT DISTINCT p.id AS a, q.id AS b FROM r p JOIN r q
    ON sqrt(((p.x-q.x)**2 + (p.y-q.y)**2 + (p.z-q.z)**2 + (p.w-q.w)**2) / 4) <= 0.10
), g AS (
  SELECT id, id AS first_id FROM r UNION SELECT e.b, g.first_id FROM g JOIN e ON e.a = g.id WHERE g.first_id < e.b
)
SELECT id, min(first_id) AS first_id FROM g GROUP BY id
HAVING count(*) > 1 OR id IN (SELECT first_id FROM g WHERE id <> first_id)
"""


_WINDOWS = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
w AS (SELECT doc_id, p, md5(text[p:p + 299]) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS p FROM d)),
g AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT DISTINCT doc_id, p, first FROM w JOIN g USING (h))"""
SQL["p8_found"] = _WINDOWS + """, m AS (SELECT DISTINCT h, doc_id FROM w SEMI JOIN g USING (h))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM m a JOIN m b USING (h) WHERE a.doc_id < b.doc_id"""
SQL["p8_shared"] = _WINDOWS + """,
c AS (SELECT doc_id, sum(least(300, coalesce(next - p, 300))) AS shared FROM (
  SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next FROM (SELECT DISTINCT doc_id, p FROM s)) GROUP BY doc_id),
r AS (SELECT doc_id, sum(least(300, coalesce(next - p, 300))) AS removable FROM (
  SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next FROM (SELECT DISTINCT doc_id, p FROM s WHERE doc_id > first)) GROUP BY doc_id)
SELECT doc_id, CAST(n AS INT) AS n_chars, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars, CASE WHEN n > 0 THEN coalesce(shared, 0) / n ELSE 0 END AS share,
  CAST(coalesce(removable, 0) AS BIGINT) AS removable_chars
FROM (SELECT doc_id, coalesce(max(length(text)), 0) AS n FROM documents GROUP BY doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)"""
SQL["p8_removals"] = _WINDOWS + """,
l AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 300 THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT doc_id, p FROM s WHERE doc_id > first) WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM l)
SELECT doc_id, CAST(min(p) - 1 AS INT) AS start, CAST(max(p) + 299 AS INT) AS "end" FROM i GROUP BY doc_id, run"""
SQL["p8_lines"] = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, generate_subscripts(parts, 1) AS k, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d)),
o AS (SELECT doc_id, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start,
  length(line) AS n, lower(trim(regexp_replace(line, '[ \t\n\v\f\r]+', ' ', 'g'))) AS unit FROM l),
u AS (SELECT DISTINCT doc_id, start, n, unit FROM o WHERE length(unit) >= 30),
f AS (SELECT unit, min((doc_id, start)) AS first FROM u GROUP BY unit HAVING count(*) > 1)
SELECT doc_id, start, CAST(start + n AS INT) AS "end", first[1] AS first_id, (doc_id, start) <> first AS removed FROM u JOIN f USING (unit)"""


def _folds() -> str:
    """SQL rows (c, r): what becomes of Latin, Greek, Cyrillic, full-width and compatibility characters, by rule."""
    out = []
    for cp in [*range(0x80, 0x2500), *range(0xFB00, 0xFB07), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xFF01, 0xFF5F)]:
        c = chr(cp)
        r = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) not in ("Cf", "Mn", "Me")).casefold()
        if r != c and unicodedata.category(c) != "Cn":
            out.append("({}, '{}')".format(cp, r.replace("'", "''")))
    return ", ".join(out)


_P6 = r"""
WITH fold(cp, r) AS (VALUES """ + _folds() + r"""),
raw AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION SELECT 'i', item_id, text FROM eval_item WHERE item_id IS NOT NULL),
c AS (SELECT kind, id, row_number() OVER () AS n, regexp_extract_all(regexp_replace(lower(text), chr(173) || '([ \t\f\v\r]*\n)', '-\1', 'g'), '(?s).') AS cs FROM raw WHERE text IS NOT NULL),
u AS (SELECT kind, id, n, generate_subscripts(cs, 1) AS k, unnest(cs) AS c FROM c),
t AS (SELECT kind, id, n, string_agg(coalesce(r, c), '' ORDER BY k) AS text FROM u LEFT JOIN fold ON cp = unicode(c) GROUP BY kind, id, n),
j AS (SELECT kind, id, regexp_replace(regexp_replace(text, '([\pL\pN])[-' || chr(8208) || '][ \t\f\v\r]*\n\s*([\pL\pN])', '\1\2', 'g'),
  '([\pL\pN])[-' || chr(8208) || '][ \t\f\v\r]*\n\s*([\pL\pN])', '\1\2', 'g') AS text FROM t),
w AS (SELECT kind, id, regexp_extract_all(text, '[\pL\pN]+') AS ws FROM j),
p AS (SELECT DISTINCT kind, id, p, array_to_string(ws[p:p + 11], ' ') AS words FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 10)) AS p FROM w WHERE len(ws) >= 12)),
hit AS (SELECT d.id AS doc_id, i.id AS item_id, i.p AS item_word FROM p d JOIN p i ON d.words = i.words AND d.kind = 'd' AND i.kind = 'i')"""
SQL["p6_found"] = _P6 + " SELECT DISTINCT doc_id, item_id FROM hit"
SQL["p6_report"] = _P6 + """ SELECT item_id, count(*) AS n_docs, max(n) AS most_windows FROM (
  SELECT doc_id, item_id, count(DISTINCT item_word) AS n FROM hit GROUP BY ALL) GROUP BY item_id"""
SQL["p7_found"] = """
WITH d AS (SELECT replace(replace(lower(trim(source)), ' ', '_'), '-', '_') AS key, length(text) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT key, sum(n) AS n FROM d GROUP BY key), t AS (SELECT sum(n) AS n FROM d)
SELECT source FROM mix_target LEFT JOIN s ON key = replace(replace(lower(trim(source)), ' ', '_'), '-', '_'), t
WHERE max_repeats * coalesce(s.n, 0) < target_share * t.n"""
SQL["p4_groups"] = SQL["p4_found"].replace("SELECT id, min(first_id) AS first_id FROM g GROUP BY id", """, l AS (SELECT id, min(first_id) AS first_id FROM g GROUP BY id),
m AS (SELECT *, avg(x) OVER o AS mx, avg(y) OVER o AS my, avg(z) OVER o AS mz, avg(w) OVER o AS mw FROM r JOIN l USING (id) WINDOW o AS (PARTITION BY first_id)),
k AS (SELECT first_id, id, round(min((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2 + (w - mw) ** 2), 12) AS off FROM m GROUP BY first_id, id),
n AS (SELECT *, row_number() OVER (PARTITION BY first_id ORDER BY off, id) AS rank FROM k)
SELECT first_id, count(*) AS n_ids, list(id ORDER BY rank) FILTER (WHERE rank <= 3) AS typical FROM n GROUP BY first_id""").split("HAVING")[0]
