"""Bank transactions: what kind of voucher they are, and which ledger their narration recalls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.functions import values as V
from vahi.operators.matching import contains_join
from vahi.sources import files

# What marks a transfer between own accounts.
CONTRA_WORDS = (
    "self", "transfer", "neft own", "own a/c", "own account", "cash dep", "cash deposit", "atm wdl", "atm withdrawal", "to cash", "from cash", "imps self",
)
LEAST_RATIO = 0.6


def classify(txns: DataFrame) -> DataFrame:
    """V9: add voucher_type and confidence from description, withdrawal and deposit; one projection, also on a stream."""
    said = F.lower(F.coalesce("description", F.lit("")))
    out, into = F.coalesce("withdrawal", F.lit(0.0)), F.coalesce("deposit", F.lit(0.0))
    contra = F.lit(False)
    for word in CONTRA_WORDS:
        contra |= F.contains(said, F.lit(word))
    kind = F.when(contra, "CONTRA").when((out > 0) & (into == 0), "PAYMENT").when((into > 0) & (out == 0), "RECEIPT").when(into > out, "RECEIPT").otherwise("PAYMENT")
    sure = F.when(contra, 0.85).when(((out > 0) & (into == 0)) | ((into > 0) & (out == 0)), 0.9).otherwise(0.55)
    return txns.withColumns({"voucher_type": kind, "confidence": sure})


def recall(txns: DataFrame, memory: DataFrame) -> DataFrame:
    """Add ledger_id and memory_confidence from narration memory (client_id, match_key, ledger_id, hit_count).

    An equal key wins; else the key that contains the narration or lies in it with the best ratio of lengths, from LEAST_RATIO. Distinct keys are compared, within the client.
    """
    keyed = txns.withColumn("key", T.narration_key(F.col("description")))
    keys = keyed.select("client_id", "key").distinct().where("key <> ''")
    known = memory.where("match_key <> ''").select("client_id", "match_key", "ledger_id", "hit_count")
    ratio = V.length_ratio(F.col("key"), F.col("match_key"))
    inside = contains_join(keys, known, "key", "match_key", ["client_id"]).unionByName(contains_join(known, keys, "match_key", "key", ["client_id"])).distinct()
    met = inside.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).join(known, ["client_id", "match_key"])
    order = Window.partitionBy("client_id", "key").orderBy(F.desc(F.col("key") == F.col("match_key")), F.desc("ratio"), F.desc("hit_count"), F.asc("match_key"), F.asc("ledger_id"))
    best = met.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    sure = F.when(F.col("key") == F.col("match_key"), F.least(F.lit(0.95), F.lit(0.7) + F.lit(0.02) * F.col("hit_count"))).otherwise(F.lit(0.55) + F.lit(0.2) * F.col("ratio"))
    return keyed.join(best.select("client_id", "key", F.col("ledger_id").alias("memory_ledger"), sure.alias("memory_confidence")), ["client_id", "key"], "left")


def statement_tables(payloads: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K7: header (client_id, statement_id, status) and transactions of statements (client_id, statement_id, payload): classified, with the ledger that memory recalls.

    The recalled ledger's confidence goes before that of the classification; the classification stays.
    """
    txns = recall(classify(files.bank_rows(payloads)), memory)
    txns = txns.withColumn("confidence", F.coalesce("memory_confidence", "confidence")).withColumnRenamed("memory_ledger", "ledger_id").drop("memory_confidence", "key")
    return payloads.select("client_id", "statement_id", F.lit("DRAFT").alias("status")), txns


def rollup(statements: DataFrame, txns: DataFrame) -> DataFrame:
    """Transactions, those without a ledger, and paise in and out of each statement; statements without any have zeros."""
    sums = txns.groupBy("statement_id").agg(
        F.count("*").alias("n_txns"), F.count_if(F.col("ledger_id").isNull()).alias("n_unmapped"),
        F.sum(V.to_paise(F.col("deposit"))).alias("in_p"), F.sum(V.to_paise(F.col("withdrawal"))).alias("out_p"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_txns", "n_unmapped", "in_p", "out_p")}
    return statements.join(sums, "statement_id", "left").withColumns(zero)
