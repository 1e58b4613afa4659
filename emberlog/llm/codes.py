"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, in exact integers.

Parts are sorted along a Hilbert curve and cut into flat blocks, which are written with the box that
holds their vectors (least and greatest of each component) and their sums. A round ships the codebook to the
blocks: distances to the box leave a short list of entries that can be nearest to anything in
it. A block with one such entry gives its stored sums; others are held against the short list by
integer products. Blocks are only read, and a task returns as many rows a round as the codebooks have entries.
How much the boxes save depends on the vectors: noise in many dimensions leaves nearly all entries, however
exact the bound, and clusters leave few.

Defined cases: a vector that is null or holds null or non-finite components is dropped; components saturate
at 2^62; shorter vectors are filled up with zeros to the longest one's length, and all to a multiple of the
parts; a null id comes last in the first codebook, rows that repeat an id stand in the order of their components,
and each is a row of the result; fewer vectors than entries give fewer entries; distances beyond a
long saturate; ties go to the entry with the lower index; null labels are one label; an empty table gives an
empty result; columns other than vec_id, embedding and label are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_or_shuffled, stored

#: Dimensions that the curve runs through, at most, and bits of each.
CURVE_DIMS, CURVE_BITS = 16, 4
LONG = 2**63 - 1
#: Components of a block are kept in the smallest of these.
KINDS = ("i2", "i4", "i8")


def quantised(rows: DataFrame, scale: float = 1024.0) -> DataFrame:
    """row, vec_id, label and v, floor(scale * x) as longs, of the vectors that are whole. Once it is written, ``row`` is fixed."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.lit(float(2**62))
    v = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(F.lit(scale) * x.cast("double"), -top), top)).cast("long"))
    return rows.where(whole).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", v.alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of small integers (bits * columns is 64 at most).

    Coordinates are turned, from the highest bit down, into the frame of the curve's cell: where a bit is
    set the first coordinate's lower bits are mirrored, else they change places; the Gray code of what
    results, read bit by bit across coordinates, is the place.
    """
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(n):
            hit = (x[i] >> np.uint64(b)) & one == 1
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one == 1, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | (((x[i] ^ turn) >> np.uint64(b)) & one)
    return key


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows of ``width``, shorter ones filled up with zeros."""
    ends = np.asarray(column.offsets)
    flat = np.asarray(column.values)
    n = np.diff(ends)
    if len(n) and (n == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(n), width), dtype=np.int64)
    for i in range(len(n)):
        out[i, : n[i]] = flat[ends[i] : ends[i + 1]]
    return out


def _keyed(width: int, parts: int, middle: np.ndarray, spread: np.ndarray):
    """A row for each part of each vector: where it lies on its part's curve, and its components."""
    size = width // parts
    bits = CURVE_BITS if size * CURVE_BITS <= 64 else max(1, 64 // min(size, CURVE_DIMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["v"], width)
            for p in range(parts):
                x = v[:, p * size : (p + 1) * size]
                wide = np.argsort(-spread[p * size : (p + 1) * size], kind="stable")[: 64 // bits]
                at = wide + p * size
                z = (v[:, at] - middle[at]) / np.maximum(spread[at], 1e-9)
                cells = np.clip(np.floor((z + 2.0) * (1 << bits) / 4.0), 0, (1 << bits) - 1)
                key = hilbert_keys(cells, bits)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * size, pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))
                columns = [pa.array(np.full(len(v), p, np.int32)), pa.array((key >> np.uint64(1)).astype(np.int64)), batch["row"], flat]
                yield pa.RecordBatch.from_arrays(columns, ["part", "place", "row", "v"])

    return run


BLOCKS = "part int, n int, kind string, rows binary, flat binary, low array<long>, high array<long>, sums array<decimal(38,0)>"


def _cut(size: int, block: int):
    """Runs of at most ``block`` rows of one part, with box and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(part: int, whole: bool) -> Iterator[pa.RecordBatch]:
            rows, v = (np.concatenate(x) for x in zip(*held.pop(part)))
            cuts = list(range(0, len(rows), block))
            if not whole and len(rows) % block:
                last = cuts.pop()
                held[part] = [(rows[last:], v[last:])]
            if cuts:
                yield _blocks(part, rows, v, cuts, block)

        for batch in batches:
            parts, rows, v = np.asarray(batch["part"]), np.asarray(batch["row"]), _matrix(batch["v"], size)
            for p in np.unique(parts).tolist():
                mine = parts == p
                held.setdefault(p, []).append((rows[mine], v[mine]))
                if sum(len(r) for r, _ in held[p]) >= block:
                    yield from emit(p, False)
        for p in list(held):
            yield from emit(p, True)

    return run


def _blocks(part: int, rows: np.ndarray, v: np.ndarray, cuts: list[int], block: int) -> pa.RecordBatch:
    out: dict[str, list] = {c.split(" ")[0]: [] for c in BLOCKS.split(", ")}
    for at in cuts:
        x = v[at : at + block]
        low, high = x.min(axis=0), x.max(axis=0)
        kind = next(k for k in KINDS if k == "i8" or not x.size or (low.min() >= np.iinfo(k).min and high.max() <= np.iinfo(k).max))
        sums = x.sum(axis=0, dtype=np.int64 if kind != "i8" else object)
        values = (part, len(x), kind, rows[at : at + block].astype("i8").tobytes(), x.astype(kind).tobytes(), low.tolist(), high.tolist(), [Decimal(int(s)) for s in sums])
        for column, value in zip(out.values(), values):
            column.append(value)
    types = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.decimal128(38, 0)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types)], list(out))


def flat_blocks(vectors: DataFrame, width: int, parts: int, block: int = 64) -> DataFrame:
    """Blocks of ``vectors`` (row, v; a written table). Ranges of the curve are dealt to tasks; the row
    number ends the key, so that vectors that are equal, however many, are split as well."""
    size = width // parts
    stats = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s")).collect()
    middle, spread = np.zeros(width), np.zeros(width)
    for r in stats:
        middle[r.i], spread[r.i] = r.m, r.s
    keyed = vectors.select("row", "v").mapInArrow(_keyed(width, parts, middle, spread), "part int, place long, row long, v array<long>")
    dealt = keyed.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
    return stored(dealt.mapInArrow(_cut(size, block), BLOCKS), "code-blocks")


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries may be nearest to some vector of the box, ties included.

    The entry whose greatest distance to the box is least is the one to beat. Its distance less that of another is
    linear over the box, so its greatest value is at a corner; below zero, the other is never as near.
    """
    far = np.maximum(np.abs(book - low), np.abs(book - high))
    best = book[int((far * far).sum(axis=1).argmin())]
    apart = best - book
    corner = np.where(apart > 0, low, high)
    gain = ((best * best - book * book) - 2 * corner * apart).sum(axis=1)
    return np.flatnonzero(gain >= 0)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Index of the nearest row of ``book``, ties to the lower; squared distance) for each row of x.

    Integers throughout: as doubles where all sums stay below 2^53, else as Python's.
    """
    top = max(int(np.abs(a).max(initial=0)) for a in (x, book)) if x.dtype != object else LONG
    if 4 * x.shape[1] * top * top < 2**53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        at = d.argmin(axis=1)
        return at, (d[np.arange(len(x)), at] + (a * a).sum(axis=1)).astype(np.int64)
    a, b = x.astype(object), book.astype(object)
    d = np.array([[int(((r - e) ** 2).sum()) for e in b] for r in a], dtype=object).reshape(len(a), len(b))
    at = np.array([min(range(len(b)), key=lambda k, r=r: r[k]) for r in d], dtype=np.int64)
    return at, np.array([min(int(r[k]), LONG) for r, k in zip(d, at)], dtype=np.int64)


def _exact(book: np.ndarray) -> np.ndarray:
    """The same integers, as Python's where 64 bits would not hold the sums of a box distance."""
    return book if not book.size or 8 * book.shape[1] * int(np.abs(book).max()) ** 2 < 2**62 else book.astype(object)


def _listed(r: dict, size: int, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Short list, vectors) of one block."""
    book, low, high = books[r["part"]], np.array(r["low"], dtype=np.int64), np.array(r["high"], dtype=np.int64)
    small = 8 * size * max([abs(int(b)) for b in (*r["low"], *r["high"])] + [0]) ** 2 < 2**62
    exact = _exact(book) if small else book.astype(object)
    if exact.dtype == object:
        low, high = low.astype(object), high.astype(object)
    short = shortlist(low, high, exact)
    return short, np.frombuffer(r["flat"], dtype=r["kind"]).astype(np.int64).reshape(r["n"], size)


def _round(size: int, shared):
    """Sums and counts of what each entry is given, over all blocks of a task, and how much was compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        books = shared.value
        n = [[0] * len(b) for b in books]
        sums = [np.zeros(b.shape, dtype=object) for b in books]
        compared = [[0] * len(b) for b in books]
        for batch in batches:
            for r in batch.to_pylist():
                p = r["part"]
                short, x = _listed(r, size, books)
                if len(short) == 1:
                    n[p][short[0]] += r["n"]
                    sums[p][short[0]] += np.array([int(s) for s in r["sums"]], dtype=object)
                    continue
                at, _ = nearest(x, books[p][short])
                compared[p][0] += len(x) * len(short)
                order = np.argsort(at, kind="stable")
                got, first = np.unique(at[order], return_index=True)
                total = np.add.reduceat(x[order] if r["kind"] != "i8" else x[order].astype(object), first, axis=0)
                for k, t, c in zip(short[got].tolist(), total, np.diff(np.append(first, len(x))).tolist()):
                    n[p][k] += c
                    sums[p][k] += t
        out = [(p, k, c, compared[p][k], [Decimal(int(s)) for s in sums[p][k]]) for p in range(len(books)) for k, c in enumerate(n[p]) if c or compared[p][k]]
        parts, entries, counts, work, totals = zip(*out) if out else ((),) * 5
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((parts, entries, counts, work, totals), types)], ["part", "entry", "n", "compared", "sums"])

    return run


def _final(size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                short, x = _listed(r, size, shared.value)
                at, d = nearest(x, shared.value[r["part"]][short])
                columns = [np.frombuffer(r["rows"], dtype="i8"), np.full(len(x), r["part"], np.int32), short[at].astype(np.int32), d]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "part", "entry", "error"])

    return run


def learn(blocks: DataFrame, books: list[np.ndarray], size: int, rounds: int = 4) -> tuple[list[np.ndarray], list[int]]:
    """(Codebooks after ``rounds`` of nearest entries and floored means, comparisons of each round).

    Each round collects a row for each entry: parts times entries, whatever the size of the table.
    """
    context, work = blocks.sparkSession.sparkContext, []
    for _ in range(rounds):
        sums = blocks.mapInArrow(_round(size, context.broadcast(books)), "part int, entry int, n long, compared long, sums array<decimal(38,0)>")
        added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("compared").alias("compared"), *added).collect()
        books = [b.copy() for b in books]
        for r in found:
            if r.n:
                books[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(size)]
        work.append(sum(r.compared for r in found))
    return books, work


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, block: int = 64) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of ``vectors`` (as ``quantised`` gives them, a written table).

    The first codebooks are the parts of the ``entries`` smallest ids.
    """
    width = vectors.agg(F.greatest(F.coalesce(F.max(F.size("v")), F.lit(1)), F.lit(1))).first()[0]
    width = -(-width // parts) * parts
    size = width // parts
    firsts = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v", "row").limit(entries).select("v").collect()
    start = np.zeros((len(firsts), width), dtype=np.int64)
    for i, r in enumerate(firsts):
        start[i, : len(r.v)] = r.v
    blocks = flat_blocks(vectors, width, parts, block)
    books, _ = learn(blocks, [start[:, p * size : (p + 1) * size].copy() for p in range(parts)], size, rounds)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()
    found = blocks.mapInArrow(_final(size, vectors.sparkSession.sparkContext.broadcast(books)), "row long, part int, entry int, error long")
    digit = lambda p: F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), max(2, len(f"{entries - 1:x}")), "0")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long")
    coded = found.groupBy(F.col("row").alias("_row")).agg(F.concat(*(digit(p) for p in range(parts))).alias("code"), total.alias("error"))
    rows = vectors.select("row", "vec_id", "label").join(coded, F.col("row") == F.col("_row")).select("vec_id", "label", "code", "error")
    rows = stored(rows, "codes")
    labels = rows.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    labels = stored(labels, "code-labels")
    told = rows.join(small_or_shuffled(labels, labels.count(), 100_000), F.col("label").eqNullSafe(F.col("_label")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds written out, each a table of all parts against all entries."""
    nearest = "SELECT place, part, arg_min(struct_pack(entry := entry, d := d), struct_pack(d := d, entry := entry)) AS a FROM (SELECT p.place, p.part, b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN b{k} b USING (part)) GROUP BY 1, 2"
    steps = [f"b0 AS MATERIALIZED (SELECT part, entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM p) WHERE entry < {entries})"]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(k=k)})")
        mean = "(s - ((s % n) + n) % n) // n"
        steps.append(f"m{k} AS MATERIALIZED (SELECT part, entry, list({mean} ORDER BY i) AS x FROM (SELECT part, a.entry AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN p USING (place, part), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    steps.append(f"f AS MATERIALIZED ({nearest.format(k=rounds)})")
    return f"""
WITH e AS (
  SELECT row_number() OVER () AS place, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT place, vec_id, v, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM e, range({parts}) AS r(part)
), {", ".join(steps)}, c AS (
  SELECT place, string_agg(printf('%02x', a.entry), '' ORDER BY part) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM f GROUP BY 1
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM e JOIN c USING (place)
"""


ORACLE = _oracle()
