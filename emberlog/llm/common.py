"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, shared_dir, stored

__all__ = ["Bucketed", "ascii_lower", "id_order", "id_remainder", "mixed", "new_path", "read", "shared_dir", "small_or_shuffled", "stored"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A word is a run of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


class Bucketed:
    """A written table in buckets of ``column``, so that grouping by it shuffles nothing.

    Rows can be added. Buckets need a table in the catalog; ``release`` takes its name off again and
    leaves the files, for plans that still read them.
    """

    def __init__(self, spark: SparkSession, name: str, column: str, buckets: int):
        self.spark, self.column, self.buckets = spark, column, buckets
        self.table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"

    def add(self, df: DataFrame, moved: bool = False) -> DataFrame:
        """The table with the rows of ``df``; ``moved`` if these are to be shuffled to one file a bucket first."""
        df = df.repartition(self.buckets, self.column) if moved else df
        df.write.mode("append").bucketBy(self.buckets, self.column).option("path", f"{shared_dir(self.spark)}/{self.table}").saveAsTable(self.table)
        return self.spark.table(self.table)

    def release(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def small_or_shuffled(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Marks ``df`` for a broadcast if its counted ``rows`` are at most ``most``; else the join shuffles."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers well mixed, one to one (the finaliser of MurmurHash3)."""
    x = x.astype(np.uint64)
    for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(times)
    return x ^ (x >> np.uint64(33))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; texts without other letters take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % mod


def id_order(doc_id: Column) -> Column:
    """60 bits of md5 of the id as text: an order that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), 1, 15), 16, 10).cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
