"""Tables after creations, changes and deletions: snapshots take the place of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.functions import text as T


def applied(table: DataFrame, key: str, created: DataFrame | None = None, patches: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The table after patches (key and new values; null leaves the old one), deletions (keys) and creations; unknown keys change nothing."""
    if patches is not None:
        given = [c for c in patches.columns if c != key]
        table = table.join(patches.withColumnsRenamed({c: f"_new_{c}" for c in given}), key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in given}).select(*table.columns)
    if deleted is not None:
        table = table.join(deleted.select(key).distinct(), key, "left_anti")
    return table if created is None else table.unionByName(created)


def upsert_ledgers(ledgers: DataFrame, wanted: DataFrame) -> DataFrame:
    """M9: the ledgers with those wanted (the same columns) whose trimmed name their client does not have yet; existing ledgers stay as they are, blank names are refused.

    Of several wanted with one name the smallest id is made.
    """
    named = wanted.withColumn("name", T.trimmed(F.col("name"))).where("name <> ''")
    one = named.groupBy("client_id", "name").agg(F.min_by(F.struct(*[c for c in ledgers.columns if c not in ("client_id", "name")]), "ledger_id").alias("r")).select("client_id", "name", "r.*")
    return ledgers.unionByName(one.join(ledgers.select("client_id", "name"), ["client_id", "name"], "left_anti").select(*ledgers.columns))


def with_default_clients(users: DataFrame, clients: DataFrame) -> DataFrame:
    """The clients, and a default one (client_id: -1 less the user's id) for each user who has none."""
    new = users.select("user_id").distinct().join(clients.select("user_id"), "user_id", "left_anti")
    return clients.select("client_id", "user_id", "name", "is_default").unionByName(new.select((F.lit(-1) - F.col("user_id")).alias("client_id"), "user_id", F.lit("Default Client").alias("name"), F.lit(True).alias("is_default")))


def default_client(clients: DataFrame) -> DataFrame:
    """(user_id, default_id): a default client first, then the oldest, which is the smallest id."""
    return clients.groupBy("user_id").agg(F.min_by("client_id", F.struct(~F.col("is_default"), F.col("client_id"))).alias("default_id"))


def backfilled(rows: DataFrame, clients: DataFrame) -> DataFrame:
    """Rows (user_id, client_id, ...) with the user's default client where they have none."""
    return rows.join(default_client(clients), "user_id", "left").withColumn("client_id", F.coalesce("client_id", "default_id")).drop("default_id")
