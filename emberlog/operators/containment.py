"""Which texts contain which patterns: an inverted index of q-grams, joined by equality and verified.

A pattern stands in the index by as many neighbouring grams as a gram has letters, and a text looks up only
every q-th gram of its own: wherever the pattern lies in the text, one of its grams falls on such a
place. Of a pattern's stretches the one whose grams are rarest among all patterns is taken, so that
what many patterns share, like folders and extensions, brings no candidates. Short patterns have short grams.
Case does not count. No text meets a pattern but through a gram that both have. A small index is
broadcast; of a large one a signature is, one bit for each hashed gram, and grams that pass it are shuffled.
Any number of patterns is looked up in one pass over the grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Lengths of grams; one of q letters needs a pattern of 2q - 1.
GRAMS = (16, 8, 6, 4, 3, 2, 1)
#: Rows of the index that are broadcast at most; beyond, a signature is, and what passes it is shuffled by gram.
BROADCAST_ROWS = 500_000
#: Longs of the signature at least and at most; 4 an index row keep one gram in 250 by chance.
SIGNATURE = (1 << 12, 1 << 21)


def pattern_grams(patterns: DataFrame) -> DataFrame:
    """(pattern, gram): the grams of the distinct lower-case ``patterns`` (pattern) that they are looked up by."""
    size = F.char_length("pattern")
    q = F.lit(1)
    for g in reversed(GRAMS):
        q = F.when(size >= 2 * g - 1, g).otherwise(q)
    p = patterns.where(size > 0).select("pattern", q.alias("q"), size.alias("size"))
    at = p.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("q") + 1)).alias("at")).withColumn("gram", F.substring("pattern", F.col("at"), F.col("q")))
    often = at.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    whole = at.join(often, "gram").groupBy("pattern", "q", "size").agg(F.array_sort(F.collect_list(F.struct("at", "n", "gram"))).alias("grams"))
    cost = lambda i: F.aggregate(F.slice("grams", i, F.col("q")), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    starts = F.transform(F.sequence(F.lit(1), F.col("size") - 2 * F.col("q") + 2), lambda i: F.struct(cost(i).alias("cost"), i.alias("at")))
    return whole.select("pattern", F.explode(F.array_distinct(F.transform(F.slice("grams", F.array_min(starts)["at"], F.col("q")), lambda x: x["gram"]))).alias("gram"))


def signature(index: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(One row with ``_bits``, an array of longs with a bit for each gram of the index; its bits). Bounded, whatever the index."""
    longs = min(max(SIGNATURE[0], 1 << (4 * rows - 1).bit_length()), SIGNATURE[1])
    h = index.select(_place(F.col("gram"), longs).alias("h")).select(F.shiftright("h", 6).alias("word"), F.expr("shiftleft(1L, int(h % 64))").alias("bit"))
    words = h.groupBy("word").agg(F.bit_or("bit").alias("bits")).unionByName(index.sparkSession.range(longs).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("_bits")), longs


def _place(gram: Column, longs: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(64 * longs))


def containing(texts: DataFrame, text_id: str, text: str, patterns: DataFrame) -> DataFrame:
    """Distinct (``text_id``, pattern) where the text contains the pattern, whatever the case of either.

    ``patterns`` has a column pattern; null and empty ones are in no text. A text of any length is read
    whole. ``texts`` must be a table that is read alike twice (written, or a source).
    """
    known = patterns.select(F.lower("pattern").alias("pattern")).where("pattern <> ''").distinct()
    index = stored(pattern_grams(known), "gram-index")
    rows, sizes = index.agg(F.count(F.lit(1)), F.collect_set(F.char_length("gram"))).first()
    t = texts.select(F.col(text_id), F.lower(text).alias("_text")).where("_text <> ''")
    if not rows:
        return t.select(text_id, F.lit("").alias("pattern")).limit(0)
    grams = F.array_distinct(F.concat(*(F.regexp_extract_all("_text", F.lit(f"(?s).{{{q}}}"), F.lit(0)) for q in sorted(sizes))))  # every q-th gram
    if rows <= BROADCAST_ROWS:
        found = t.select("*", F.explode(grams).alias("_gram")).join(F.broadcast(index), F.col("_gram") == F.col("gram"))
        return found.where(F.contains("_text", "pattern")).select(text_id, "pattern").distinct()
    bits, longs = signature(index, rows)
    known_gram = lambda g: F.getbit(F.element_at("_bits", (F.shiftright(_place(g, longs), 6) + 1).cast("int")), (_place(g, longs) % 64).cast("int")) == 1
    asked = t.crossJoin(F.broadcast(stored(bits, "gram-signature"))).select(text_id, F.explode(F.filter(grams, known_gram)).alias("gram"))  # one row, a bounded array
    pairs = asked.join(index.hint("merge"), "gram").select(F.col(text_id).alias("_id"), "pattern").distinct()
    return t.join(pairs, F.col(text_id) == F.col("_id")).where(F.contains("_text", "pattern")).select(text_id, "pattern")
