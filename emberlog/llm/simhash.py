"""SimHash near-duplicates: fingerprints, and a binary-trie self-join within a Hamming distance.

Defined cases: a null text is an empty one and has fingerprint zero, which links like any other;
rows with equal fingerprints are one trie leaf, so copies cost nothing; a component is named by its
least doc_id (null ids count only where there is no other); a text of any length is read whole; an
empty table gives an empty result; columns other than doc_id and text pass through or are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected

BITS = 64
SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle of the text, repeats included; none where it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    n = len(words) - k + 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())), dtype=np.uint64, count=n)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit-wise majority over the XXH64 of all shingles of the text."""
    h = shingle_hashes(text, shingle)
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 8192):
        total += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(sum(1 << b for b in np.flatnonzero(2 * total > len(h)).tolist()))


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(values.view(np.int64))

    return docs.select("doc_id", text_key(), simhash("text").alias("fp"))


def _masks(fixed: int, parts: int) -> list[int]:
    """The bits that ``fixed`` leaves, in ``parts`` runs, each joined to ``fixed``."""
    free = [b for b in range(BITS - 1, -1, -1) if not fixed >> b & 1]
    return [fixed | sum(1 << int(b) for b in run) for run in np.array_split(free, parts) if len(run)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def trie_pairs(values: np.ndarray, cells: np.ndarray, budget: int, low: np.ndarray | None = None, leaf: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``values`` (uint64, sorted inside each run of ``cells``) within ``budget`` bits;
    ``low``, if given, has 64 more bits of each that the trie does not branch on.

    All cells are walked at once, one trie level a step. A node is a range of sorted values with a
    common prefix; a pair of nodes carries the bits that their prefixes differ in. Children are
    paired with children, a differing bit uses up the budget, and a pair beyond it is dropped with
    everything below. Nodes with at most ``leaf`` pairs of values are compared value by value.
    """
    edge = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
    lo, hi = edge[:-1], edge[1:]
    keep = hi - lo > 1
    a0, a1 = lo[keep], hi[keep]
    b0, b1, spent = a0, a1, np.zeros(len(a0), dtype=np.int64)
    left, right = [], []
    for bit in range(BITS - 1, -2, -1):
        na, nb = a1 - a0, b1 - b0
        small = (na * nb <= leaf) | (bit < 0)
        if small.any():
            i, j = _across(a0[small], na[small], b0[small], nb[small])
            apart = np.bitwise_count(values[i] ^ values[j])
            if low is not None:
                apart = apart + np.bitwise_count(low[i] ^ low[j])
            near = (i < j) & (apart <= budget)
            left.append(i[near])
            right.append(j[near])
            a0, a1, b0, b1, spent = (x[~small] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the ones begin
        self_pair = a0 == b0
        children = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1)]
        cross = tuple(x[~self_pair] for x in (am, a1, b0, bm, spent + 1))  # of a node with itself it is the third again
        a0, a1, b0, b1, spent = (np.concatenate(x) for x in zip(*children, cross))
        keep = (a1 > a0) & (b1 > b0) & (spent <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, spent = (x[keep] for x in (a0, a1, b0, b1, spent))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _across(a0: np.ndarray, na: np.ndarray, b0: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of each pair of ranges."""
    n = na * nb
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a0[row] + k // nb[row], b0[row] + k % nb[row]


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of the components of n nodes: the least index in each."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def whole_cells(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of frames that are sorted by ``keys``, with no cell cut in two (cells are bounded)."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        # The last cell may go on in the next batch; it is held back.
        last = np.logical_and.reduce([pdf[k].to_numpy() == pdf[k].iloc[-1] for k in keys])
        if held and not last.all() or held and any(held[-1][k].iloc[-1] != pdf[k].iloc[-1] for k in keys):
            yield pd.concat([*held, pdf[~last]])
            held = []
        elif not last.all():
            yield pdf[~last]
        held.append(pdf[last])
    if held:
        yield pd.concat(held)


def _join_cells(budget: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_cells(frames, ["mask", "cell"]):
            yield _links(pdf, budget)

    return run


def _links(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """A star per component of each cell: enough to connect what is linked."""
    fp = pdf["fp"].to_numpy()
    values, mask, cell = fp.view(np.uint64), pdf["mask"].to_numpy(), pdf["cell"].to_numpy()
    order = np.lexsort((values, cell, mask))
    fp, values, mask, cell = fp[order], values[order], mask[order], cell[order]
    runs = np.concatenate([[0], np.cumsum((mask[1:] != mask[:-1]) | (cell[1:] != cell[:-1]))])
    i, j = trie_pairs(values, runs, budget)
    label = labels_of(len(fp), i, j)
    child = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"a": fp[child], "b": fp[label[child]]})


def links(prints: DataFrame, budget: int = 3, most: int = 2048) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of ``prints`` (fp) within ``budget`` bits.

    Of budget + 1 runs of bits, two such fingerprints agree in one at least. So the trie is rooted
    budget + 1 times, each time with another run first, and a cell is the node below that run: the
    budget is not spent there. A cell with over ``most`` fingerprints is rooted again by the bits
    that are left, until cells are small; with at most ``budget`` bits left all are linked.
    Cells are joined in ranges of rows, each cell whole in one task.
    """
    edges = None
    rows, level = prints.select("fp", F.lit(0).cast("long").alias("mask")), [0]
    while level:
        wider = {m: _masks(m, budget + 1) for m in level}
        options = F.lit(None).cast("array<long>")
        for m, more in wider.items():
            options = F.when(F.col("mask") == _signed(m), F.array(*(F.lit(_signed(x)) for x in more))).otherwise(options)
        cells = rows.select("fp", F.explode(options).alias("mask")).withColumn("cell", F.col("fp").bitwiseAND(F.col("mask")))
        counts = stored(cells.groupBy("mask", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "heavy-cells")
        heavy = {r["mask"] % (1 << BITS) for r in counts.select("mask").distinct().collect()}  # at most 4 per level's mask
        light = cells
        if heavy:
            light = cells.join(counts, ["mask", "cell"], "left_anti")
        found = light.repartition("mask", "cell").sortWithinPartitions("mask", "cell").mapInPandas(_join_cells(budget), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if not heavy:
            break
        crowded = cells.join(counts, ["mask", "cell"])
        done = [m for m in heavy if BITS - m.bit_count() <= budget]
        if done:  # what is left to differ is within the budget: a star suffices
            star = crowded.where(F.col("mask").isin([_signed(m) for m in done]))
            least = star.groupBy("mask", "cell").agg(F.min("fp").alias("b"))
            edges = edges.unionByName(star.join(least, ["mask", "cell"]).select(F.col("fp").alias("a"), "b"))
        level = sorted(heavy - set(done))
        rows = stored(crowded.where(F.col("mask").isin([_signed(m) for m in level])).select("fp", "mask").distinct(), "heavy-rows") if level else None
    return edges


def near_duplicates(docs: DataFrame, budget: int = 3, most: int = 2048) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id that links reach)."""
    return _grouped(stored(fingerprints(docs), "simhash"), budget, most).select("doc_id", "fp", "component_id")


def _grouped(prints: DataFrame, budget: int, most: int) -> DataFrame:
    """Adds component_id and first, the component's least (doc_id, text_key).

    Plain joins on the fingerprint: one that a third of all rows share is split by the adaptive
    skew join, as both of its sides are shuffled for the join alone.
    """
    distinct = stored(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("least")), "simhash-distinct")
    roots = connected(links(distinct.select("fp"), budget, most))
    named = stored(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = stored(named.groupBy("root").agg(F.min("least").alias("first")), "simhash-ids")
    named = stored(named.join(ids, "root").select(F.col("fp").alias("k"), "first"), "simhash-named")
    return prints.join(named, F.col("fp") == F.col("k")).withColumn("component_id", F.col("first.doc_id")).drop("k")


def one_of_each(docs: DataFrame, budget: int = 3, most: int = 2048) -> DataFrame:
    """The documents that stay: of each component the row with the least id, then the least hash of
    its text; of rows equal in both, one."""
    return keep_first(docs, _grouped(stored(fingerprints(docs), "simhash"), budget, most))


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their group (``grouped``: doc_id, text_key, first)."""
    stay = grouped.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    stay = stored(stay.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies")).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), "simhash-stay")
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", text_key())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    kept = rows.join(stay.where("copies = 1"), same, "left_semi")
    if stay.where("copies > 1").limit(1).count():
        kept = kept.unionByName(rows.join(stay.where("copies > 1"), same, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return kept.select("doc.*")
