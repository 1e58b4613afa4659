"""Near-duplicates by similarity: SimHash finds candidates, exact Jaccard similarity confirms them.

Texts count as near-duplicates from a Jaccard similarity of their word shingles up. Fingerprints find
most of them cheaply; what they miss is found by an exact join, so no link between groups is lost.

A fingerprint of 128 bits differs in about acos(2s / (1 + s)) / pi of its bits for two sets of similarity s. Binary
tries are rooted at several samples of bits; the self-join below a root walks node pairs together,
adds up the bits that differ and drops a pair beyond the budget. So a pair is found if it agrees on one
of the samples, whose number is set by ``recall`` for pairs at the threshold; closer ones are found
more often. Every link that stands has been confirmed on the shingles themselves.

The exact join is by prefixes: in one order of all shingles two sets as similar share one of the first
n - ceil(s n) + 1 of either. Units meet in the cell of each such shingle, but only those of different
groups are paired, so a group that fingerprints have found costs no pairs. The order puts shingles that a
sample has often last, which changes the size of cells and no result. A large cell is cut into tiles.

Defined cases: a null text is an empty one; texts without words are alike, texts with fewer words than
a shingle have the whole sequence as their one shingle; texts with equal shingles are one unit, so
copies cost nothing; of a group the row with the least id stays (null ids only where there is no
other), of equal ids the least hash of the text, of rows equal in both one; texts of any length are
read whole; an empty table gives an empty result; columns other than doc_id and text pass through,
whatever their names.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, stored
from .components import connected
from .simhash import BITS, keep_first, labels_of, shingle_hashes, text_key, trie_pairs, whole_cells

#: Bits of a wide fingerprint: two longs.
WIDE = 2 * BITS


def bit_share(similarity: float) -> float:
    """The share of bits in which fingerprints of sets of a Jaccard similarity agree, as expected."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_fingerprint(h: np.ndarray) -> tuple[int, int, int]:
    """(High and low half of the fingerprint, a hash of the set of shingles), as signed longs.

    A bit is the majority over the distinct shingles, whose sorted hashes are given.
    """
    if not len(h):
        return 0, 0, 0
    halves = []
    for part in (h, mixed(h)):
        ones = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(part), 8192):
            ones += np.unpackbits(part[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        halves.append(np.packbits(2 * ones > len(part), bitorder="little").view(np.int64)[0])
    return int(halves[0]), int(halves[1]), int(np.add.reduce(mixed(h ^ np.uint64(len(h)))).view(np.int64))


#: Similarities are compared as whole numbers of so many parts.
SCALE = 10_000


def often_seen(docs: DataFrame, shingle: int, part: int = 16, least: int = 3, most: int = 500_000) -> np.ndarray:
    """Sorted hashes of the shingles that ``least`` different texts of one ``part`` th of the corpus have,
    at most the ``most`` frequent ones. They only make an order, in which any set would do."""

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts])

    sample = docs.select(text_key(), "text").where(F.pmod("text_key", F.lit(part)) == 0).dropDuplicates(["text_key"])
    counts = sample.select(F.explode(sets("text")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = counts.orderBy(F.col("n").desc(), "h").limit(most).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(dtype=np.int64).view(np.uint64))


def prefix(h: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """Of a set's sorted hashes the first in the common order: any set as similar shares one of its own."""
    if len(often):
        last = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
        h = np.concatenate([h[~last], h[last]])
    return h[: len(h) + (-round(similarity * SCALE) * len(h) // SCALE) + 1] if len(h) else h


#: Ranges of hashes by which the shingles of a set are counted.
RANGES = 256


def spread(h: np.ndarray) -> bytes:
    """How many of the hashes are in each range, 255 at most. Two sets differ in at least as many shingles as
    these counts do in all, so they tell pairs apart without the sets."""
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()


def units(docs: DataFrame, shingle: int, similarity: float = 0.8, often: np.ndarray = np.zeros(0, dtype=np.uint64)) -> DataFrame:
    """doc_id, text_key, hi, lo, unit (a hash of the text's set of shingles), n (how many it has), counts (their
    spread), first_ones (its prefix)."""

    def described(text: str | None) -> tuple:
        h = np.unique(shingle_hashes(text, shingle))
        return *wide_fingerprint(h), len(h), spread(h), prefix(h, often, similarity).view(np.int64)

    @F.pandas_udf("struct<hi:long,lo:long,unit:long,n:long,counts:binary,first_ones:array<long>>")
    def prints(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([described(t) for t in texts], columns=["hi", "lo", "unit", "n", "counts", "first_ones"])

    return docs.select("doc_id", text_key(), prints("text").alias("p")).select("doc_id", "text_key", "p.*")


def _forest_of_nearest(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the pairs make the forest of least distances that connects what the pairs connect."""
    label, chosen = np.arange(n), []
    at = np.arange(len(i))
    while True:
        at = at[label[i[at]] != label[j[at]]]
        if not len(at):
            return np.concatenate([np.zeros(0, dtype=np.int64), *chosen])
        order = at[np.argsort(apart[at], kind="stable")]
        best = np.full(n, -1, dtype=np.int64)
        for side in (i, j):  # the nearest pair of each tree, ties to the first
            trees, first = np.unique(label[side[order]], return_index=True)
            rank = np.where(best[trees] < 0, len(order), best[trees])
            best[trees] = np.minimum(rank, first)
        picked = order[np.unique(best[best >= 0])]
        chosen.append(picked)
        label = labels_of(n, label[i[picked]], label[j[picked]])[label]


def _nearest(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs are among the ``most`` nearest of either side."""
    node, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((np.tile(apart, 2), node))
    node, pair = node[order], pair[order]
    first = np.searchsorted(node, np.arange(n))
    return np.unique(pair[np.arange(len(node)) - first[node] < most])


def _cell_links(budget: int, nearest: int = 4):
    """For each cell the forest of nearest pairs within the budget, and the ``nearest`` pairs of each
    unit: where a near pair turns out to be less similar than it seems, others can stand for it."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["cell", "unit"])
        hi, lo = (pdf[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        order = np.lexsort((hi, pdf["cell"].to_numpy()))
        hi, lo, cell, unit = hi[order], lo[order], pdf["cell"].to_numpy()[order], pdf["unit"].to_numpy()[order]
        runs = np.concatenate([[0], np.cumsum(cell[1:] != cell[:-1])])
        i, j = trie_pairs(hi, runs, budget, lo, leaf=64)
        apart = np.bitwise_count(hi[i] ^ hi[j]).astype(np.int64) + np.bitwise_count(lo[i] ^ lo[j])
        at = np.union1d(_forest_of_nearest(len(hi), i, j, apart), _nearest(len(hi), i, j, apart, nearest))
        return pd.DataFrame({"a": unit[i[at]], "b": unit[j[at]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_cells(frames, ["cell"]):
            yield links(pdf)

    return run


def _sampled(bits: list[int]) -> Column:
    """A hash of the bits of (hi, lo) at the given places, and of the places."""
    masks = [sum(1 << (b % BITS) for b in bits if b // BITS == half) for half in (0, 1)]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return F.xxhash64(F.col("hi").bitwiseAND(F.lit(signed(masks[0]))), F.col("lo").bitwiseAND(F.lit(signed(masks[1]))), F.lit(str(sorted(bits))))


def candidates(prints: DataFrame, similarity: float = 0.8, recall: float = 0.95, cell_rows: int = 256, most: int = 1024, seed: int = 7) -> DataFrame:
    """Pairs of units (a, b) that may be as similar: enough to connect what is.

    ``prints``: hi, lo, unit, one row for each unit. Samples have so many bits that a cell holds about
    ``cell_rows``. Of a cell with over ``most``, which near copies of one text fill, all within half the
    expected distance of its least unit are linked to that and leave; what stays is rooted again by four
    bits more, until cells are small.
    """
    rnd, agree = random.Random(seed), bit_share(similarity)
    mean = WIDE * (1 - agree)
    budget = math.ceil(mean + 2.5 * math.sqrt(mean * agree))
    n = prints.count()
    roots_for = lambda k: math.ceil(math.log(1 - recall) / math.log(1 - agree**k))
    width = max(8, math.ceil(math.log2(max(n, 1) / cell_rows)))
    samples = [rnd.sample(range(WIDE), width) for _ in range(roots_for(width))]
    rows = prints.withColumn("cell", F.explode(F.array(*map(_sampled, samples))))
    found, used = None, width
    while True:
        rows = stored(rows, "similar-cells")
        heavy = stored(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("unit", "hi", "lo")).alias("hub")).where(F.col("n") > most).withColumnRenamed("cell", "h_cell"), "similar-heavy")
        crowded = heavy.count()
        light = rows.join(heavy, F.col("cell") == F.col("h_cell"), "left_anti") if crowded else rows
        pairs = light.repartition("cell").sortWithinPartitions("cell").mapInPandas(_cell_links(budget), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        if not crowded:
            return stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "similar-pairs")
        full = rows.join(heavy, F.col("cell") == F.col("h_cell"))
        apart = F.bit_count(F.col("hi").bitwiseXOR(F.col("hub.hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("hub.lo")))
        full = stored(full.select("hi", "lo", "unit", "cell", F.col("hub.unit").alias("hub"), (apart <= F.lit(int(mean / 2))).alias("near"), apart.alias("apart")), "similar-full")
        found = found.unionByName(full.where("near and unit <> hub").select(F.col("hub").alias("a"), F.col("unit").alias("b")))
        left = full.where("not near or unit = hub")
        used += 4
        if used > WIDE:  # nothing is left to tell them apart: link to the hub what is within the budget
            return stored(found.unionByName(left.where((F.col("apart") <= budget) & (F.col("unit") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("unit").alias("b"))).distinct(), "similar-pairs")
        more = [rnd.sample(range(WIDE), 4) for _ in range(roots_for(4))]
        rows = left.select("hi", "lo", "unit", F.explode(F.array(*(F.xxhash64("cell", _sampled(m)) for m in more))).alias("cell"))


MET = "a long, b long, cell long, place long, root long"


def _fits(place: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the rows i and j differ in root and, by their sizes and by where the shared shingle stands in
    both, can be as similar. ``place`` has size and place in one number.

    The bound holds at the first shingle that two sets share; at a later one it may drop the pair, which
    the first one's cell has then found.
    """
    part, size = round(similarity * SCALE), place >> 32
    rest, (a, b) = size - (place & 0xFFFFFFFF), (size[i], size[j])
    return (root[i] != root[j]) & (np.minimum(rest[i], rest[j]) * (SCALE + part) >= part * (a + b)) & (np.minimum(a, b) * SCALE >= part * np.maximum(a, b))


def _pairs(unit: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    i, j = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*found) if found else ((), ())))
    return pd.DataFrame({"a": np.minimum(unit[i], unit[j]), "b": np.maximum(unit[i], unit[j])}).drop_duplicates()


def _crossing(place: np.ndarray, root: np.ndarray, similarity: float, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``left`` with ``right`` that fit, some rows at a time."""
    for begin in range(0, len(left), step := max(1, (1 << 20) // max(len(right), 1))):
        i = left[begin : begin + step, None]
        x, y = np.nonzero(_fits(place, root, i, right[None, :], similarity))
        yield i[x, 0], right[y]


def _not_of_main_root(root: np.ndarray) -> np.ndarray:
    """Rows but those of the most frequent root: every pair of different roots has one of them."""
    _, which, count = np.unique(root, return_inverse=True, return_counts=True)
    return np.flatnonzero(which != np.argmax(count)) if len(count) > 1 else np.zeros(0, dtype=np.int64)


def _cells_met(similarity: float, most: int):
    """Pairs of each cell's units that may be linked. Cells of over ``most`` rows come back as they are (b is null)."""

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        cell, unit, place, root = (rows[c].to_numpy() for c in ("cell", "unit", "place", "root"))
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        begin, end, found = edge[:-1], edge[1:], []
        differ = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
        small = end - begin <= 64
        for a, b in zip(begin[differ & ~small], end[differ & ~small]):
            found += [(a + i, a + j) for i, j in _crossing(place[a:b], root[a:b], similarity, _not_of_main_root(root[a:b]), np.arange(b - a))]
        begin, size = begin[differ & small], (end - begin)[differ & small]
        at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        stop = np.repeat(begin + size, size)
        for ahead in range(1, int(size.max(initial=0))):  # of all small cells each row with the one so far behind it
            at, stop = at[inside := at + ahead < stop], stop[inside]
            fit = at[_fits(place, root, at, at + ahead, similarity)]
            found.append((fit, fit + ahead))
        return _pairs(unit, found)

    def told(pairs: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": pairs["a"], "b": pairs["b"].astype("Int64"), "cell": 0, "place": 0, "root": 0})

    def large(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": rows["unit"], "b": pd.array([None] * len(rows), dtype="Int64"), "cell": rows["cell"], "place": rows["place"], "root": rows["root"]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, passing = None, None
        for pdf in frames:
            if passing is not None:  # the cell before was large and goes on
                go_on = pdf["cell"].to_numpy() == passing
                if go_on.any():
                    yield large(pdf[go_on])
                    pdf = pdf[~go_on]
            if not len(pdf):
                continue
            passing = None
            pdf = pdf if held is None else pd.concat([held, pdf])
            cell = pdf["cell"].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            size = np.repeat(np.diff(edge), np.diff(edge))
            last = cell == cell[-1]
            over, held = size > most, pdf[last]
            if over.any():
                yield large(pdf[over])
                if over[-1]:
                    held, passing = None, cell[-1]
            if len(few := pdf[~over & ~last]):
                yield told(whole(few))
        if held is not None:
            yield told(whole(held))

    return run


def _tiles_met(similarity: float):
    """Pairs of one tile of a large cell: of block i with block j."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, place, root, block, i, j = (pdf[c].to_numpy() for c in ("unit", "place", "root", "block", "i", "j"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        return _pairs(unit, list(_crossing(place, root, similarity, left, right)))

    return run


def missed_candidates(prefixes: DataFrame, similarity: float = 0.8, most: int = 4096) -> DataFrame:
    """Pairs of units (a, b) of different roots that may be as similar: all that there are.

    ``prefixes``: unit, root, n, first_ones, one row for each unit. A cell of over ``most`` units is cut into
    blocks; each two of these are a tile, so no task holds more than two blocks.
    """
    rows = prefixes.select("unit", "root", "n", F.posexplode("first_ones").alias("at", "cell"))
    rows = rows.select("cell", "unit", (F.shiftleft("n", 32) + F.col("at")).alias("place"), "root")
    met = stored(rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(_cells_met(similarity, most), MET), "similar-met")
    found = met.where("b is not null").select("a", "b")
    large = met.where("b is null").select("cell", F.col("a").alias("unit"), "place", "root")
    mixed_cells = large.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    mixed_cells = stored(mixed_cells.select(F.col("cell").alias("l_cell"), F.ceil(F.col("size") / most).alias("blocks")), "similar-large")
    if mixed_cells.limit(1).count():
        large = large.join(mixed_cells, F.col("cell") == F.col("l_cell")).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")))
        others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        tiles = large.withColumn("other", F.explode(others)).select("cell", "unit", "place", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        found = found.unionByName(tiles.groupBy("cell", "i", "j").applyInPandas(_tiles_met(similarity), "a long, b long"))
    return stored(found.distinct(), "similar-missed")


def not_apart(pairs: DataFrame, sizes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The pairs that the spreads of their sets (``sizes``: unit, n, counts) allow to be as similar."""
    part = round(similarity * SCALE)

    @F.pandas_udf("long")
    def differ(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), dtype=np.uint8).reshape(-1, RANGES).astype(np.int16) for c in (a, b))
        return pd.Series(np.abs(x - y).sum(axis=1, dtype=np.int64))

    side = lambda c: sizes.select(F.col("unit").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("differ", differ("counts_a", "counts_b"))
    size = F.col("n_a") + F.col("n_b")
    return stored(both.where((size - F.col("differ")) * (SCALE + part) >= 2 * part * size).select("a", "b"), "similar-likely")


def confirmed(pairs: DataFrame, docs: DataFrame, prints: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose units are as similar, by their shingles."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-nodes")
    chosen = prints.join(nodes, F.col("unit") == F.col("node"), "left_semi").groupBy("unit").agg(F.min("text_key").alias("key"))
    texts = docs.select(text_key(), "text").join(chosen, F.col("text_key") == F.col("key"))

    @F.pandas_udf("array<long>")
    def sets(column: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in column])

    texts = texts.groupBy("unit").agg(F.min("text").alias("text"))
    held = stored(texts.select("unit", sets("text").alias("s")), "similar-sets")
    both = pairs.join(held.select(F.col("unit").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("unit").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    # Similarity at least s, in whole numbers as far as s has so many decimals.
    union = F.size("sa") + F.size("sb") - common
    return stored(both.where((common * 10_000 >= F.lit(round(similarity * 10_000)) * union) & (union > 0)).select("a", "b"), "similar-links")


def _named(each: DataFrame, links: DataFrame) -> DataFrame:
    """``each`` (unit, least) with the root of its group."""
    return stored(each.join(connected(links), F.col("unit") == F.col("node"), "left").select("unit", "least", F.coalesce("root", "unit").alias("root")), "similar-roots")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """One row per document: doc_id, text_key, unit, first (the least doc_id and text_key of its group)."""
    prints = stored(units(docs, shingle, similarity, often_seen(docs, shingle)), "similar-units")
    each = stored(prints.groupBy("unit").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("least"), F.min("hi").alias("hi"), F.min("lo").alias("lo")), "similar-distinct")
    links = confirmed(candidates(each.select("hi", "lo", "unit"), similarity, recall), docs, prints, shingle, similarity)
    named = _named(each.select("unit", "least"), links)
    prefixes = prints.groupBy("unit").agg(F.first("n").alias("n"), F.first("first_ones").alias("first_ones")).join(named.select(F.col("unit").alias("k"), "root"), F.col("unit") == F.col("k"))
    missed = missed_candidates(prefixes.select("unit", "root", "n", "first_ones"), similarity)
    asked = missed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sizes = prints.join(asked, F.col("unit") == F.col("node"), "left_semi").groupBy("unit").agg(F.min("n").alias("n"), F.min("counts").alias("counts"))
    more = confirmed(not_apart(missed, stored(sizes, "similar-sizes"), similarity), docs, prints, shingle, similarity)
    if more.limit(1).count():
        named = _named(each.select("unit", "least"), links.unionByName(more))
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    named = stored(named.join(first, "root").select(F.col("unit").alias("k"), "first"), "similar-named")
    return prints.join(named, F.col("unit") == F.col("k")).select("doc_id", "text_key", "unit", "first")


def distinct_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """The documents that stay: one of each group of near copies."""
    return keep_first(docs, near_copies(docs, shingle, similarity, recall))
