"""Benchmark decontamination by a prefix-filtered set join.

A window (item-sized: ten consecutive words of a benchmark item, or a shorter item whole) occurs in
a document only if all its shingles do, so it is enough to look for one of them: the prefix of
length 1 when shingles are ordered by rarity in the documents. A first walk over the documents counts
the shingles of the windows and keeps nothing else; a second one joins the rarest of each window.
Position and length bounds drop the candidates that do not fit, and the words themselves are compared
in the end.

Defined cases: a null text has no words; rows that repeat an id and a text get equal results, rows
that share an id with other texts are kept apart by the hash of the text; a window that occurs in
several items counts for each; ties in rarity go to the least hash; texts of any length are walked
whole, and no word carries its text through a shuffle; an empty benchmark or document table gives zero
hits or no rows; columns other than doc_id, item_id and text are not read (or pass through, in
``clean_documents``), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_lower, small_or_shuffled, stored

#: Fixed value: what separates words, once A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(words, at + k) for k in range(size)))


def windows_of(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(Distinct windows: window_id, words, n; which items have them: window_id, item_id)."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    each = words.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, F.lit(width)).alias("words"))
    each = stored(each.withColumn("window_id", F.sha2(F.array_join("words", " "), 256)), "leak-windows")
    return each.select("window_id", "words", F.size("words").alias("n")).distinct(), each.select("window_id", "item_id").distinct()


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def _walked(keyed: DataFrame, g: int, keep: list[str]) -> DataFrame:
    """Each place of the documents at which a shingle of g words begins, and its hash."""
    return (
        keyed.where(F.size("w") >= g).select("doc_id", "text_key", "w", F.explode(F.sequence(F.lit(0), F.size("w") - g)).alias("at"))
        .select(*keep, "at", F.size("w").alias("n_words"), _shingle(F.col("w"), F.col("at"), g).alias("shingle"))
    )


def leaks(docs: DataFrame, items: DataFrame, width: int = 10, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The documents with a hit: doc_id, text_key, n_hit, n_items, items_sha256."""
    windows, members = windows_of(items, width)
    windows = stored(windows.withColumn("g", F.least("n", F.lit(SHINGLE))), "leak-distinct")
    by_size = F.lit(None).cast("long")
    for g in range(1, SHINGLE + 1):
        by_size = F.when(F.col("g") == g, _shingle(F.col("words"), F.col("offset"), g)).otherwise(by_size)
    inside = stored(
        windows.select("window_id", "n", "g", "words", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("g"))).alias("offset"))
        .select("window_id", "n", "g", "offset", by_size.alias("shingle")),
        "leak-shingles",
    )
    n_shingles = inside.count()
    # Shingles of 1 and 2 words are walked only if the benchmark has items as short.
    sizes = sorted(r.g for r in inside.select("g").distinct().collect())
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, n_hit long, n_items long, items_sha256 string")
    keyed = docs.select("doc_id", _text_key(), words_of(F.col("text")).alias("w"))
    seen = None
    for g in sizes:
        wanted = small_or_shuffled(inside.where(F.col("g") == g).select("shingle").distinct(), n_shingles, broadcast_rows)
        found = _walked(keyed, g, []).join(wanted, "shingle", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("seen")).withColumn("g", F.lit(g))
        seen = found if seen is None else seen.unionByName(found)
    # The rarest shingle of each window; a window with a shingle that no document has cannot occur.
    rarity = inside.join(stored(seen, "leak-seen"), ["g", "shingle"], "left")
    rarest = rarity.groupBy("window_id", "n", "g").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "offset")).alias("first")).where(F.col("first.seen") > 0)
    prefix = stored(rarest.select("window_id", "n", "g", F.col("first.shingle").alias("shingle"), F.col("first.offset").alias("offset")).join(windows.select("window_id", "words"), "window_id"), "leak-prefix")
    n_prefix, occurs = prefix.count(), None
    for g in sizes:
        mine = prefix.where(F.col("g") == g).drop("g")
        begin = F.col("at") - F.col("offset")
        fits = (begin >= 0) & (begin + F.col("n") <= F.col("n_words"))
        if n_prefix <= broadcast_rows:
            found = _walked(keyed, g, ["doc_id", "text_key", "w"]).join(F.broadcast(mine), "shingle").where(fits).where(F.slice("w", begin + 1, F.col("n")) == F.col("words"))
        else:  # places without their texts are shuffled; the texts meet the places that fit, once each
            places = _walked(keyed, g, ["doc_id", "text_key"]).join(mine.hint("merge"), "shingle").where(fits).select("doc_id", "text_key", "at", "offset", "n", "window_id", "words").distinct()
            places = stored(places.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), "leak-places")
            texts = keyed.dropDuplicates(["doc_id", "text_key"])
            found = texts.join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).where(F.slice("w", begin + 1, F.col("n")) == F.col("words"))
        found = found.select("doc_id", "text_key", begin.alias("begin"), (begin + F.col("n")).alias("end"), "window_id")
        occurs = found if occurs is None else occurs.unionByName(found)
    # Copies of a row have the same occurrences.
    return _counted(stored(occurs, "leak-occurrences").distinct(), members, broadcast_rows)


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 10, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = leaks(docs, items, width, broadcast_rows).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    counted = docs.select("doc_id", _text_key(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id", "text_key", "n_words",
        F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, width: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """The documents without a hit; their keys are broadcast only if few documents have one."""
    keys = stored(leaks(docs, items, width).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "leak-keys")
    keys = small_or_shuffled(keys, keys.count(), broadcast_rows)
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", _text_key())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return rows.join(keys, same, "left_anti").select("doc.*")


def _counted(occurs: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Words hit and items found, by document; the words that occurrences cover are a union of intervals."""
    before = F.max("end").over(W.partitionBy("doc_id", "text_key").orderBy("begin", "end").rowsBetween(W.unboundedPreceding, -1))
    covered = F.greatest(F.col("end") - F.greatest("begin", F.coalesce("before", F.lit(0))), F.lit(0))
    per = occurs.withColumn("before", before).groupBy("doc_id", "text_key").agg(F.sum(covered).cast("long").alias("n_hit"), F.collect_set("window_id").alias("ids"))
    members = stored(members, "leak-members")
    items = (
        per.select("doc_id", "text_key", "n_hit", F.explode("ids").alias("window_id")).join(small_or_shuffled(members, members.count(), most), "window_id")
        .groupBy("doc_id", "text_key").agg(F.first("n_hit").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return items.select("doc_id", "text_key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


ORACLE = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), grams AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM dw, sizes WHERE len(w) >= n)
), occ AS (
  SELECT doc_id, s, win.n AS n, item_id FROM grams JOIN win USING (n, t)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
