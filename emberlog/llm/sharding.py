"""Sharding by a Hilbert curve over quantised metadata.

Several metadata dimensions are quantised to a few bits, the curve index orders the documents and
the order is cut into runs of equal row counts, so that each shard spans a small box in every
dimension and readers can skip shards by their min and max.

Defined cases: a null text has no bytes; a null dimension falls in bin 0; documents of one cell
stand in an order fixed by md5 of their ids, so rows that are equal in id, text and metadata are
interchangeable; texts of any length count whole; an empty table gives an empty result; fewer rows than
shards leave shards empty; columns other than doc_id, text and the dimensions are not read (or pass
through, in ``sharded_documents``, where a column ``shard`` that is there already is replaced).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_order, small_or_shuffled, stored


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For each (state, corner): the corner's rank on the curve, and the state inside it.

    A state is the entry corner and the direction of the curve through a cell; ranks follow the
    Gray code, turned and mirrored by the state.
    """
    full = (1 << dims) - 1
    turn = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & full if k % dims else x
    gray = [i ^ (i >> 1) for i in range(1 << dims)]
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # trailing set bits
    rank, inner = [], []
    for state in range(dims << dims):
        entry, way = state % (1 << dims), state >> dims
        for corner in range(1 << dims):
            w = gray.index(turn(corner ^ entry, dims - (way + 1) % dims))
            first = gray[2 * ((w - 1) // 2)] if w else 0
            step = 0 if w == 0 else ones(w - 1) if w % 2 == 0 else ones(w)
            rank.append(w)
            inner.append((way + step % dims + 1) % dims << dims | (entry ^ turn(first, (way + 1) % dims)))
    return rank, inner


def hilbert_index(bins: list[Column], bits: int) -> Column:
    """The curve index of a cell: one walk from the highest bit down that carries index and state."""
    dims = len(bins)
    rank, inner = (F.array(*map(F.lit, t)) for t in curve_tables(dims))

    def step(acc: Column, bit: Column) -> Column:
        corner = reduce(lambda a, b: a + b, (F.getbit(x, bit).cast("int") * (1 << k) for k, x in enumerate(bins)))
        at = (acc["state"] * (1 << dims) + corner + 1).cast("int")
        return F.struct((acc["index"] * (1 << dims) + F.element_at(rank, at)).cast("long").alias("index"), F.element_at(inner, at).cast("int").alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("int").alias("state"))
    return F.aggregate(F.array(*(F.lit(b) for b in reversed(range(bits)))), start, step)["index"]


def value_bins(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """(Value, bin of 0..2^bits-1) of each distinct value: its rank, scaled to the bins.

    Values are range-partitioned; a rank is the place in a partition and the rows of those before it,
    so that odd values weigh no more than others and no task sorts all of them.
    """
    values = docs.select(F.col(column).alias("value")).where("value is not null").distinct()
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = stored(values.repartitionByRange(width, "value").select("value", F.spark_partition_id().alias("part")), "shard-values")
    total = values.count()
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = values.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))  # a row for each partition
    rank = F.col("start") + F.row_number().over(W.partitionBy("part").orderBy("value")) - 1
    scaled = F.floor(rank * (1 << bits) / F.lit(max(total, 1))).cast("int")
    bins = stored(values.join(F.broadcast(starts), "part").select("value", scaled.alias("bin")), "shard-bins")
    return small_or_shuffled(bins, total, 100_000)


def with_curve(rows: DataFrame, bins: dict[str, DataFrame], bits: int) -> DataFrame:
    """Adds ``curve``; ``rows`` has the columns of ``bins`` and size, whose bin is its bit length."""
    cells = []
    for k, (column, table) in enumerate(bins.items()):
        rows = rows.join(table.withColumnsRenamed({"value": f"_value{k}", "bin": f"_bin{k}"}), F.col(column) == F.col(f"_value{k}"), "left")
        cells.append(F.coalesce(f"_bin{k}", F.lit(0)))
    cells.append(F.least(F.length(F.bin("size")), F.lit((1 << bits) - 1)).cast("int"))
    return rows.withColumn("curve", hilbert_index(cells, bits)).drop(*(f"{c}{k}" for k in range(len(bins)) for c in ("_value", "_bin")))


def _rows(docs: DataFrame, strings: tuple[str, ...]) -> DataFrame:
    """The columns that the order needs, and the whole row as a struct, so that no name clashes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return docs.select(F.struct("*").alias("doc"), "doc_id", *strings, size.alias("size"), crc.alias("text_crc32"), id_order(F.col("doc_id")).alias("u"))


def hilbert_ranks(docs: DataFrame, strings: tuple[str, ...] = ("lang", "source"), bits: int = 5) -> tuple[DataFrame, int, dict[str, DataFrame]]:
    """(One row per document with doc_id, size, text_crc32, u, curve, rank; how many; the strings' bins).

    Ranks come from counts of the cells (at most 2^(bits * dims) rows, which bounds the broadcast),
    then of slices of each cell by md5 of the id (the square root of its rows), then inside a
    slice, so that no cell, however full, is one task.
    """
    bins = {c: value_bins(docs, c, bits) for c in strings}
    rows = with_curve(_rows(docs, strings).drop("doc"), bins, bits)
    rows = stored(rows.select("doc_id", "size", "text_crc32", "u", "curve"), "shard-rows")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    cells = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.shiftright("curve", bits * (len(bins) + 1) // 2))
    blocks = cells.groupBy("block").agg(F.sum("n").alias("n")).select(
        "block", F.coalesce(F.sum("n").over(before(W.orderBy("block"))), F.lit(0)).alias("block_start")
    )
    cells = (
        cells.withColumn("cell_start", F.coalesce(F.sum("n").over(before(W.partitionBy("block").orderBy("curve"))), F.lit(0)))
        .join(F.broadcast(blocks), "block")
        .select("curve", (F.col("cell_start") + F.col("block_start")).alias("cell_start"), F.ceil(F.sqrt(F.col("n").cast("double"))).alias("slices"))
    )
    rows = rows.join(F.broadcast(cells), "curve").withColumn("slice", F.shiftright(F.shiftright("u", 30) * F.col("slices"), 30))
    starts = rows.groupBy("curve", "slice").agg(F.count(F.lit(1)).alias("n")).select(
        "curve", "slice", F.coalesce(F.sum("n").over(before(W.partitionBy("curve").orderBy("slice"))), F.lit(0)).alias("slice_start")
    )
    place = F.row_number().over(W.partitionBy("curve", "slice").orderBy("u", "doc_id", "text_crc32")) - 1
    ranked = rows.withColumn("place", place).join(starts, ["curve", "slice"])
    rank = (F.col("cell_start") + F.col("slice_start") + F.col("place")).alias("rank")
    return ranked.select("doc_id", "size", "text_crc32", "u", "curve", rank), rows.count(), bins


def hilbert_shards(docs: DataFrame, shards: int = 40, strings: tuple[str, ...] = ("lang", "source"), bits: int = 5) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, curve, law, shard, slot, grown_shard.

    The law is ``rows``: a run of the order is a shard, and counts are at most one apart.
    """
    ranked, total, _ = hilbert_ranks(docs, strings, bits)
    total = F.lit(max(total, 1)).cast("long")
    exact = F.expr(f"rank * {shards}") - F.pmod(F.expr(f"rank * {shards}"), total)
    shard = (exact / total).cast("int")
    first = F.ceil((F.col("shard") * total) / F.lit(shards))
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard",
        (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_documents(docs: DataFrame, shards: int = 40, strings: tuple[str, ...] = ("lang", "source"), bits: int = 5) -> DataFrame:
    """The documents with their ``shard``, range-partitioned by shard and sorted along the curve.

    The key of each shard's first row is a cut (one row per shard reaches the driver); a document's
    shard is the number of cuts up to its own key, so texts move once. Rows that are equal in
    id, text and metadata share a shard.
    """
    docs = docs.drop("shard")
    ranked, total, bins = hilbert_ranks(docs, strings, bits)
    if not total:
        return docs.withColumn("shard", F.lit(0))
    key = F.struct("curve", "u", "doc_id", "text_crc32")
    firsts = [-(-k * total // shards) for k in range(1, shards)]
    cuts = ranked.where(F.col("rank").isin(firsts)).select(key.alias("key")).distinct().collect()
    literal = [F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(c.key, (("curve", "long"), ("u", "long"), ("doc_id", "long"), ("text_crc32", "long"))))) for c in cuts]
    rows = with_curve(_rows(docs, strings), bins, bits)
    passed = F.size(F.filter(F.array(*literal), lambda c: c <= key)) if literal else F.lit(0)
    # As many ranges as the session's shuffles have, so a shard may be several files, never a task too large.
    ordered = rows.withColumn("shard", passed).repartitionByRange("shard", "curve", "u").sortWithinPartitions("shard", "curve", "u", "doc_id")
    return ordered.select("doc.*", "shard")
