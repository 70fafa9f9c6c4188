"""Joins in which one key may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most: each of them holds more than this share of all rows.
HOT_KEYS = 4096


def join_hot(rows: DataFrame, few: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """The inner join of rows with few, which has one row a key and in `weight` how many rows the key has at most.

    Keys of more than total / HOT_KEYS rows are fewer than HOT_KEYS; they are broadcast and their rows stay where they are, the others are shuffled. Keys must not be null.
    """
    keys, least = list(keys), total // HOT_KEYS + 1
    hot = F.broadcast(few.where(F.col(weight) > least).drop(weight))
    rest = rows.join(F.broadcast(few.where(F.col(weight) > least).select(*keys)), keys, "left_anti").join(few.where(F.col(weight) <= least).drop(weight), keys)
    return rows.join(hot, keys).unionByName(rest)
