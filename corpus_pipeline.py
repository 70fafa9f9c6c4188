"""From raw documents to packed training sequences: five operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vahi.llm import toxicity
from vahi.llm.common import BROADCAST_IDS, clean_text, documents, stored, table, text_key
from vahi.llm.decontamination import without_contaminated
from vahi.llm.exact_dedup import exact_dedup, normalised
from vahi.llm.minhash import near_duplicates
from vahi.llm.queries import packed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that a classifier trained on `labels` calls toxic; each row is judged by its own text."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, key, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose id and key (a column made of the text) are among dropped (doc_id, key): rows go, not ids. Null ids are compared as values."""
    an_id, a_key = _free(docs, "_id"), _free(docs, "_key")
    dropped = stored(dropped.toDF(an_id, a_key).distinct(), "dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, F.col("doc_id").cast("long").eqNullSafe(F.col(an_id)) & (key == F.col(a_key)), "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the smallest doc_id; if rows repeat an id with a text that stays, one of them stays. Rows without an id stay only where no row has one."""
    found = stored(exact_dedup(docs), "copies")
    sha = F.sha2(normalised(clean_text()), 256)
    rest = _without(docs, sha, found.where("NOT kept").select("doc_id", "text_sha256"))
    kept = found.where("kept").select("doc_id", "text_sha256")
    if kept.count() == kept.distinct().count():
        return rest
    name = _free(docs, "_sha")
    return rest.withColumn(name, sha).dropDuplicates(["doc_id", name]).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.85) the rows of the smallest doc_id. Rows without an id link to nothing and stay."""
    return _without(docs, text_key(), near_duplicates(docs).where("NOT kept").select("doc_id", "text_key"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a window of a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of 1024 ids."""
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before kept, written in between."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and the packing order are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
