"""A bounded sample of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.llm.common import stored


def is_held_out():
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most_each: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, y) of at most most_each documents of each label that aren't held out, and the weight of a row of each label.

    The sample has the smallest hashes of doc_id, so it is the same on every run and at most 2 * most_each ids are broadcast. A label's weight is how many
    labelled ids one of its rows stands for. Null labels and ids are left out; an id with several labels counts as the largest.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    marked = marked.where(~is_held_out())
    sizes = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}  # one row a label
    ids = None
    for y in (0, 1):
        some = marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_each)
        ids = some if ids is None else ids.unionByName(some)
    ids = stored(ids, "sample-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    return stored(rows, "sample"), {y: max(1.0, n / most_each) for y, n in sizes.items()}
