"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every item is cut into windows of 13 words, every window into shingles of three words (fewer where the window is shorter).
Shingles are ordered by rarity in the corpus. A window that is wholly contained shares all its shingles, so its necessary
prefix is its one rarest shingle: only documents that hold it are candidates. Length and position bound where the window
may lie, and all its shingles are then verified at their places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WINDOW, SHINGLE = 13, 3
#: Characters between words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark shingles are broadcast up to so many rows (24 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: str) -> Column:
    """Words of a text column; null has none. Only A-Z change case, so ``lower`` serves texts of ASCII alone."""
    t = F.col(text)
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, BETWEEN), ""), F.array().cast("array<string>"))


def shingles(w: Column, k: int) -> Column:
    """Array of structs of k neighbouring words."""
    n = F.greatest(F.size(w) - (k - 1), F.lit(0))
    return F.arrays_zip(*(F.slice(w, i + 1, n).alias(f"w{i}") for i in range(k)))


def placed(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """``keys``, pos and h of each shingle of ``df.w``. The generator's fields keep the order in which they were zipped."""
    zipped = df.select(*keys, F.posexplode(shingles(F.col("w"), k)).alias("pos", "s"))
    fields = zipped.schema["s"].dataType.names
    return zipped.select(*keys, "pos", F.xxhash64(F.lit(k), *(F.col(f"s.`{f}`") for f in fields)).alias("h"))


def windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, win, len, w): each window of each item; equal windows have equal ``win``. Items without words have none."""
    w = items.select(F.col(item).cast("string").alias("item"), words(text).alias("w")).where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(WINDOW)))
    cut_ = w.select("item", "len", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("at"))
    cut_ = cut_.select("item", "len", F.slice("w", F.col("at") + 1, F.col("len")).alias("w"))
    return cut_.select("item", F.xxhash64("len", "w").alias("win"), "len", "w").distinct()


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is known to have few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def occurrences(docs: DataFrame, wins: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, win, start, len): every place where a window occurs in a document.

    ``wins`` has win, len and w. Documents that share an id count as one; a null id is an id like any other.
    """
    wins = cut(wins.select("win", "len", "w").distinct())
    corpus = docs.select(F.col(doc).alias("doc"), words(text).alias("w")).where(F.size("w") > 0)
    parts, needs = [], []
    for k in [r.k for r in wins.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().collect()]:
        need = cut(placed(wins.where(F.least("len", F.lit(SHINGLE)) == k), k, "win", "len").withColumnRenamed("pos", "off"))
        distinct = need.select(F.col("h").alias("bh")).distinct()
        found = placed(corpus, k, "doc")
        parts.append(found.join(small(distinct, need.count()), found.h == F.col("bh"), "left_semi"))
        needs.append(need)
    if not parts:
        return docs.select(F.col(doc).alias("doc"), F.lit(0).cast("long").alias("win"), F.lit(0).alias("start"), F.lit(0).alias("len")).where("false")
    need = reduce(DataFrame.unionByName, needs)
    held = cut(reduce(DataFrame.unionByName, parts))
    rows = need.count()
    rarity = held.groupBy("h").agg(F.count("*").alias("n"))
    ranked = need.join(rarity, "h", "left").select("win", "len", "off", "h", F.coalesce("n", F.lit(0)).alias("n"))
    # the prefix: of a window's shingles the rarest, first one on ties; one that no document holds ends the window
    prefix = ranked.groupBy("win", "len").agg(F.min(F.struct("n", "h", "off")).alias("p")).where("p.n > 0").select("win", "len", F.col("p.h").alias("ph"), F.col("p.off").alias("poff"))
    bounds = held.groupBy("doc").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    near = held.join(small(prefix, rows), F.col("h") == F.col("ph")).select("doc", "win", "len", (F.col("pos") - F.col("poff")).alias("start")).where("start >= 0")
    bounds = bounds.withColumnRenamed("doc", "d2")
    near = near.join(bounds, near.doc.eqNullSafe(bounds.d2)).where((F.col("start") >= F.col("lo")) & (F.col("start") + F.col("len") - F.least("len", F.lit(SHINGLE)) <= F.col("hi"))).select("doc", "win", "len", "start").distinct()
    steps = need.groupBy("win").agg(F.sort_array(F.collect_list(F.struct("off", "h"))).alias("steps")).withColumnRenamed("win", "w2")
    asked = near.join(small(steps, rows), near.win == F.col("w2")).select("doc", "win", "len", "start", F.explode("steps").alias("s"), F.size("steps").alias("n")).select("doc", "win", "len", "start", "n", (F.col("start") + F.col("s.off")).alias("pos"), F.col("s.h").alias("h"))
    there = held.select(F.col("doc").alias("d2"), F.col("pos").alias("p2"), F.col("h").alias("h2")).distinct()
    met = asked.join(there, asked.doc.eqNullSafe(there.d2) & (asked.pos == there.p2) & (asked.h == there.h2))
    return met.groupBy("doc", "win", "len", "start").agg(F.count("*").alias("met"), F.first("n").alias("n")).where("met = n").select("doc", "win", "start", "len")


def decontaminate(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``.

    A word is hit inside any occurrence of a window; contaminated: some word is hit, and a twentieth of all words or more.
    Null or empty texts have no words; repeated items share windows and each counts; an empty benchmark hits nothing.
    Rows that share an id are pooled, as the SQL has it; rows without an id are judged each by itself.
    """
    wins = cut(windows(items, item, item_text))
    nameless = docs.where(F.col(doc).isNull())
    if nameless.isEmpty():
        return judged(docs, wins, doc, text)
    apart = cut(nameless.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("t")))
    alone = judged(apart, wins, "row", "t").withColumn("row", F.lit(None).cast(docs.schema[doc].dataType)).withColumnRenamed("row", doc)
    return judged(docs.where(F.col(doc).isNotNull()), wins, doc, text).unionByName(alone)


def judged(docs: DataFrame, wins: DataFrame, doc: str, text: str) -> DataFrame:
    """``decontaminate`` by the windows of ``windows``; rows that share an id are pooled."""
    at = cut(occurrences(docs, wins, doc, text))
    places = at.select("doc", "start", "len").distinct().withColumn("end", F.col("start") + F.col("len"))
    before = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = places.select("doc", (F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))).alias("k"))
    hit = fresh.groupBy("doc").agg(F.sum(F.greatest("k", F.lit(0))).cast("long").alias("n_hit"))
    of = wins.select(F.col("win").alias("w2"), "item").distinct()
    pairs = at.select("doc", "win").distinct()
    names = pairs.join(small(of, wins.count()), F.col("win") == F.col("w2")).groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumnRenamed("doc", "d3")
    facts = hit.join(names, hit.doc.eqNullSafe(names.d3)).select(F.col("doc").alias("d4"), "n_hit", "items")
    rows = docs.select(F.col(doc).alias("doc"), F.size(words(text)).cast("long").alias("n_words"))
    out = rows.join(facts, rows.doc.eqNullSafe(facts.d4), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("doc").alias(doc), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: contamination of every document by the benchmark."""
    from .common import table

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[g:g + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS g FROM n)),
p AS (SELECT doc_id, k, g, array_to_string(w[g:g + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS g FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
m AS (SELECT p.doc_id, p.g, p.k, win.item_id FROM p JOIN win ON p.k = win.k AND p.s = win.s),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(g, g + k)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
