"""Bounded training samples for the text classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_order, id_remainder, stored

FOLDS = 5


def held_out(column: str = "doc_id"):
    return id_remainder(F.col(column), FOLDS) == 0


def training_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text and label of at most ``per_class`` labelled rows of each class, rows of each class in all).

    Rows of the held-out fold are never drawn; the draw is by md5 of the id. The ids drawn, at most
    2 * per_class, are broadcast. Labels that contradict each other for one id count as the greater.
    """
    told = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    told = stored(told.groupBy("doc_id").agg(F.max(target).cast("int").alias("label")), "labelled")
    sizes = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    drawn = None
    for label in (0, 1):
        part = told.where(F.col("label") == label).orderBy(id_order(F.col("doc_id")), "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = stored(drawn.withColumnRenamed("doc_id", "_id"), "drawn")
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    # Rows that repeat an id would exceed the bound: one text for each id.
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return stored(rows, "training-rows"), sizes


def prior(sizes: dict[int, int]) -> float:
    n = sum(sizes.values())
    return sizes.get(1, 0) / n if n else 0.5
