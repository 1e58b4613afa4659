"""Exact top-k search by inner product: norm buckets with coordinate or length pruning.

Vectors are grouped by length. For a query with a known lower bound of its k-th score, a bucket's
greatest length gives the least cosine that a vector of the bucket must have. A threshold over 1
drops the bucket; a high one prunes by coordinates (a vector that close to the query has its
components near the query's), a low one by length. Products of what is left are computed exactly.

Defined cases: vectors that are null or hold null or non-finite components take no part; a null id
takes no part; rows that repeat an id are vectors of their own, and each such query row is answered
on its own, against all rows but itself; missing components of shorter vectors count as zero; ties go
to smaller ids; scores beyond a long saturate; fewer than k candidates give fewer ranks; vectors of
any length are read whole; an empty table gives an empty result; columns other than vec_id and
embedding are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: Cosine threshold from which coordinates prune better than lengths.
COORDINATES_FROM = 0.6
#: Rounding room of the bounds; the products themselves are exact.
ROOM = 1e-6


def quantised_vectors(rows: DataFrame, scale: float = 64.0) -> DataFrame:
    """row, vec_id, v (floor(scale * x) as doubles) and norm. ``row`` tells rows apart; it is fixed once the result is written."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    d = rows.where(F.col("vec_id").isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v"))
    return d.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products: in doubles where all sums are below 2^53, else in Python integers."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), dtype=np.int64)
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1) < 2**53:
        return (q @ c.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    return np.clip(big(q) @ big(c).T, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_bucket(queries: pd.DataFrame, bucket: pd.DataFrame, k: int) -> pd.DataFrame:
    """The up to k best of one bucket block for each query of one query block.

    queries: row, vec_id, v, norm, bound (a lower bound of the k-th score, or null).
    """
    width = max((len(v) for part in (queries["v"], bucket["v"]) for v in part), default=0)
    bucket = bucket.sort_values("norm", ascending=False, kind="stable")
    c, ids, rows, norms = _matrix(bucket["v"], width), bucket["vec_id"].to_numpy(), bucket["row"].to_numpy(), bucket["norm"].to_numpy()
    q, q_ids, q_rows, q_norms = _matrix(queries["v"], width), queries["vec_id"].to_numpy(), queries["row"].to_numpy(), queries["norm"].to_numpy()
    bound = queries["bound"].to_numpy(dtype=np.float64)
    longest = norms[0] if len(norms) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(np.isnan(bound), -1.0, bound / (q_norms * longest))
    local = np.where(np.isnan(local), -1.0, local)  # a zero vector on either side: no pruning
    out: list[tuple] = []

    def keep(row: int, scores: np.ndarray, at: np.ndarray) -> None:
        other = rows[at] != q_rows[row]
        scores, at = scores[other], at[other]
        if not np.isnan(bound[row]):
            fit = scores >= bound[row]
            scores, at = scores[fit], at[fit]
        best = _best(scores, ids[at], k)
        out.append((np.full(len(best), q_rows[row]), np.full(len(best), q_ids[row]), ids[at][best], scores[best]))

    coordinate = (local >= COORDINATES_FROM) & (local <= 1 + ROOM)
    if coordinate.any():
        unit = c / np.maximum(norms, 1e-300)[:, None]
        order = np.argsort(unit, axis=0, kind="stable")
        ranked = np.take_along_axis(unit, order, axis=0)
        for row in np.flatnonzero(coordinate):
            t = min(local[row], 1.0)
            direction = q[row] / q_norms[row]
            spread = np.sqrt((1 - t * t) * np.maximum(1 - direction**2, 0)) + ROOM
            # Above the threshold's own angle a component may reach 1 (or -1).
            low = np.where(direction <= -t, -1.0, direction * t - spread) - ROOM
            high = np.where(direction >= t, 1.0, direction * t + spread) + ROOM
            focus = np.argsort(-np.abs(direction))[:4]
            best = None
            for f in focus:
                a, b = np.searchsorted(ranked[:, f], low[f], "left"), np.searchsorted(ranked[:, f], high[f], "right")
                if best is None or b - a < best[1] - best[0]:
                    best = (a, b, f)
            at = order[best[0] : best[1], best[2]] if best else np.arange(len(c))
            for f in focus:
                at = at[(unit[at, f] >= low[f]) & (unit[at, f] <= high[f])]
            keep(row, _exact(q[row : row + 1], c[at])[0], at)
    by_length = np.flatnonzero(local < COORDINATES_FROM)
    for block in np.array_split(by_length, -(-len(by_length) // 256)) if len(by_length) else []:
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((bound[block] > 0) & (q_norms[block] > 0), bound[block] / q_norms[block] * (1 - ROOM), 0.0)
        need = np.where(np.isnan(need), 0.0, need)
        ends = np.searchsorted(-norms, -need, "right")
        scores = _exact(q[block], c[: ends.max(initial=0)])
        for n, row in enumerate(block):
            keep(row, scores[n, : ends[n]], np.arange(ends[n]))
    if not out:
        return _no_finds()
    return pd.DataFrame(dict(zip(FOUND, map(np.concatenate, zip(*out)))))


#: What a search of a block gives.
FOUND = ("query_row", "query_id", "vec_id", "score")


def _no_finds() -> pd.DataFrame:
    return pd.DataFrame({c: np.zeros(0, np.int64) for c in FOUND})


def _eighths(x) -> Column:
    """Which eighth of a power of two a positive number falls in; some 16 000 for all doubles."""
    return F.when(x > 0, F.floor(F.log2(x) * 8)).otherwise(-100_000).cast("int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, seeds: int = 1024, bucket_rows: int = 4096, query_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` and ``queries`` have row, vec_id, v, norm, and are written tables.

    Buckets are ranges of the norm, cut into blocks of about ``bucket_rows`` by hash where many vectors
    are as long. A first search over the ``seeds`` longest vectors (a bounded broadcast) gives each query
    the lower bound that prunes: its bound over its own norm is the length that a vector must have.
    Queries are grouped by ranges of that length, cut into blocks likewise; vectors and queries meet only
    where the bucket's longest vector has the least length that the queries' range asks for. The pairs of
    blocks that are left are searched, and the k best of each query are merged.
    """
    spark = vectors.sparkSession
    vectors = vectors.withColumn("bucket", _eighths(F.col("norm")))
    counts = vectors.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()  # bounded by the range of a double
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = vectors.orderBy(F.col("norm").desc(), "vec_id").limit(seeds).select("row", "vec_id", "v", "norm").toPandas()
    shared = spark.sparkContext.broadcast(longest)

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = search_bucket(pdf.assign(bound=np.nan), shared.value, k)
            kth = found.groupby("query_row")["score"].agg(["size", "min"])
            kth = kth[kth["size"] >= k]["min"]
            yield pdf.assign(bound=pdf["row"].map(kth).astype("float64"))

    queries = stored(queries.select("row", "vec_id", "v", "norm").mapInPandas(bounds, "row long, vec_id long, v array<double>, norm double, bound double"), "topk-queries")
    # A negative bound, or none, asks for no length: a product as low may come from any.
    need = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm")).otherwise(0.0)
    queries = queries.withColumn("need", need).withColumn("q_bucket", _eighths(F.col("need")))
    asked = queries.groupBy("q_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).collect()
    parts = lambda rows, key, size: {r[key]: max(1, -(-r.n // size)) for r in rows}
    blocks, q_blocks = parts(counts, "bucket", bucket_rows), parts(asked, "q_bucket", query_rows)
    lookup = lambda of: F.create_map(*(F.lit(x) for b, n in of.items() for x in (b, n)))
    meets = {(r.bucket, a.q_bucket) for r in counts for a in asked if r.longest * (1 + ROOM) >= a.need}
    others = lambda own, side: F.create_map(*(x for b in own for x in (F.lit(b), F.array(*(F.struct(F.lit(o).alias("bucket"), F.lit(n).alias("blocks")) for o, n in sorted(side(b).items())) or [F.struct(F.lit(0).alias("bucket"), F.lit(0).alias("blocks"))]))))
    of_query = others(q_blocks, lambda a: {b: n for b, n in blocks.items() if (b, a) in meets})
    of_vector = others(blocks, lambda b: {a: n for a, n in q_blocks.items() if (b, a) in meets})
    every = lambda name, block: F.explode(F.when(F.col(f"{name}.blocks") > 0, F.sequence(F.lit(0), F.col(f"{name}.blocks") - 1))).alias(block)
    keys = ["bucket", "block", "q_bucket", "q_block"]
    work = queries.withColumn("q_block", F.pmod(F.xxhash64("row"), lookup(q_blocks)[F.col("q_bucket")]).cast("int")).withColumn("o", F.explode(of_query[F.col("q_bucket")]))
    work = work.select("row", "vec_id", "v", "norm", "bound", "q_bucket", "q_block", F.col("o.bucket").alias("bucket"), every("o", "block"))
    cut = vectors.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), lookup(blocks)[F.col("bucket")]).cast("int")).withColumn("o", F.explode(of_vector[F.col("bucket")]))
    cut = cut.select("row", "vec_id", "v", "norm", "bucket", "block", F.col("o.bucket").alias("q_bucket"), every("o", "q_block"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return search_bucket(q, c, k) if len(q) and len(c) else _no_finds()

    found = work.groupBy(*keys).cogroup(cut.groupBy(*keys)).applyInPandas(search, "query_row long, query_id long, vec_id long, score long")
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH e AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.place <> c.place
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
