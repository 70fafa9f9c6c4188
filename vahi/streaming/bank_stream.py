"""Bank transactions as a stream: the stateless classification, and narration memory kept by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vahi.functions import text as T
from vahi.operators import bank
from vahi.sources import snapshots

_DELTA = "client_id int, match_key string, ledger_id long, hits long, at long, batch long"


def classified_stream(spark: SparkSession, path: str, schema: str | StructType, files_each: int | None = None) -> DataFrame:
    """A folder of Parquet files with transactions, classified as they come; the same projection as on a table. files_each: how many files a micro-batch has at most."""
    reader = spark.readStream.schema(schema)
    return bank.classify((reader if files_each is None else reader.option("maxFilesPerTrigger", files_each)).parquet(path))


def learn_stream(txns: DataFrame, memory_path: str, checkpoint: str, as_names: bool = False) -> StreamingQuery:
    """M5: append each micro-batch's (client_id, match_key, ledger_id) counts to a log of deltas; a repeated batch overwrites its own folder, so a restart changes nothing.

    memory() folds the log, compact() shortens it. as_names: learn under the narration as a name, not under the key by which it is looked up.
    """

    key = F.coalesce(T.norm_name(F.col("description")), F.lit("")) if as_names else T.narration_key(F.col("description"))

    def add(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.where("ledger_id IS NOT NULL").select("client_id", key.alias("match_key"), "ledger_id", "txn_id").where("match_key <> ''")
        deltas = keyed.groupBy(F.col("client_id").cast("int").alias("client_id"), "match_key", F.col("ledger_id").cast("long").alias("ledger_id")).agg(F.count("*").alias("hits"), F.max("txn_id").cast("long").alias("at"))
        deltas.write.mode("overwrite").parquet(f"{memory_path}/log/batch={batch_id}")

    return txns.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _base(spark: SparkSession, memory_path: str) -> tuple[int, DataFrame | None]:
    """The last batch that the newest base holds, and the base; -1 and none before the first."""
    names = snapshots.runs(spark, f"{memory_path}/base")
    return (int(names[-1]), snapshots.read(spark, f"{memory_path}/base", names[-1], "sums")) if names else (-1, None)


def _sums(spark: SparkSession, memory_path: str, upto: int | None = None) -> DataFrame:
    """Hits and last time of each (client, key, ledger): the newest base and the deltas after it, up to a batch. Deltas that the base holds are not even listed as files to read."""
    held, base = _base(spark, memory_path)
    log = spark.read.schema(_DELTA).parquet(f"{memory_path}/log").where(F.col("batch") > held)
    if upto is not None:
        log = log.where(F.col("batch") <= upto)
    rows = log.drop("batch")
    rows = rows if base is None else rows.unionByName(base)
    return rows.groupBy("client_id", "match_key", "ledger_id").agg(F.sum("hits").alias("hits"), F.max("at").alias("at"))


def compact(spark: SparkSession, memory_path: str, upto: int) -> bool:
    """M5: fold the deltas up to a batch into a new base, whose name is that batch: the watermark. upto must be a batch that has ended.

    The base becomes readable at once (see snapshots), and from then on readers leave out the deltas that it holds, so nothing counts twice or is missed at any moment.
    A compaction that stops halfway leaves no trace that readers see; one up to a batch that a base already holds does nothing and gives False.
    """
    held, _ = _base(spark, memory_path)
    return upto > held and snapshots.commit(f"{memory_path}/base", f"{upto:012d}", {"sums": _sums(spark, memory_path, upto)})


def memory(spark: SparkSession, memory_path: str) -> DataFrame:
    """The narration memory: hits summed, the latest ledger wins."""
    return _sums(spark, memory_path).groupBy("client_id", "match_key").agg(F.max_by("ledger_id", F.struct("at", "ledger_id")).alias("ledger_id"), F.sum("hits").alias("hit_count"))
