"""From invoices to draft vouchers and their lines: resolution, building, overrides, and the tables that result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.operators import ledgers as L
from vahi.operators.vouchers import ITEM, build_vouchers, is_purchase_resolve, lines_of, voucher_type
from vahi.storage import compiled_stages, no_shuffles_left, stored

# Names of the ledgers that a client's taxes and discounts go to, for purchases and for all others.
SYSTEM = {
    "cgst_ledger": ("CGST Input", "CGST Output"), "sgst_ledger": ("SGST Input", "SGST Output"), "igst_ledger": ("IGST Input", "IGST Output"), "discount_ledger": ("Discount Received", "Discount Allowed"),
}


def system_ledgers(ledgers: DataFrame) -> DataFrame:
    """(client_id, buys, cgst_ledger, ..., round_off_ledger) of each client and side, found by fixed names and the round-off type; the first id of a name."""
    by_name = lambda names, k: F.min(F.when(F.col("name") == names[k], F.col("ledger_id")))
    found = ledgers.groupBy("client_id").agg(*[by_name(n, k).alias(f"{c}{k}") for c, n in SYSTEM.items() for k in (0, 1)], F.min(F.when(F.col("ledger_type") == "ROUND_OFF", F.col("ledger_id"))).alias("round_off_ledger"))
    side = lambda k: found.select("client_id", F.lit(k == 0).alias("buys"), *[F.col(f"{c}{k}").alias(c) for c in SYSTEM], "round_off_ledger")
    return side(0).unionByName(side(1))


def draft_vouchers(invoices: DataFrame, items: DataFrame, existing: DataFrame, rules: DataFrame, memory: DataFrame, ledgers: DataFrame, overrides: DataFrame) -> DataFrame:
    """V6, M7: a built draft for each invoice whose voucher is missing or still a draft; the others are skipped.

    overrides (invoice_id, new_type, party_ledger, force_new_party), all optional but the id: a type that goes before the document's, a party by hand (confidence 1, only a ledger of the
    client counts), or none at all. An existing draft keeps its voucher_id; a new one takes its invoice's. The rows are those of build_vouchers with voucher_id and narration.
    """
    old = existing.select("invoice_id", F.col("voucher_id").alias("_old"), F.col("status").alias("_old_status"))
    rows = invoices.drop("status").join(old, "invoice_id", "left").where("_old_status IS NULL OR _old_status = 'DRAFT'").join(overrides.withColumnRenamed("party_ledger", "_asked"), "invoice_id", "left")
    rows = rows.withColumn("voucher_type", F.coalesce("new_type", voucher_type(F.col("document_type")))).withColumn("buys", is_purchase_resolve(F.col("voucher_type")))
    rows = rows.withColumns({"gstin_key": T.norm_gstin(F.col("vendor_gstin")), "name_key": T.norm_name(F.col("vendor"))})
    with compiled_stages(rows.sparkSession):
        rows = stored(rows, "to-draft")  # three readers follow
    owners = rows.select("invoice_id", "client_id", "buys")  # lines need no party

    parties = L.resolve_parties(rows.select("client_id", "gstin_key", "name_key").distinct(), rules, memory, ledgers).select("client_id", "gstin_key", "name_key", F.col("ledger_id").alias("_party"), F.col("confidence").alias("_sure"), F.col("via").alias("_via"))
    rows = L.null_safe_left(rows, parties, ["client_id", "gstin_key", "name_key"])
    own = ledgers.select("client_id", F.col("ledger_id").alias("_asked"), F.lit(True).alias("_own"))
    rows = rows.join(own, ["client_id", "_asked"], "left")
    force, by_hand = F.coalesce("force_new_party", F.lit(False)), F.coalesce("_own", F.lit(False))
    pick = lambda hand, found: F.when(~force, F.when(by_hand, hand).otherwise(found))
    rows = rows.withColumns({"party_ledger": pick(F.col("_asked"), F.col("_party")), "party_confidence": pick(F.lit(1.0), F.col("_sure")), "party_via": pick(F.lit("MANUAL"), F.col("_via"))})

    lines = items.select("invoice_id", "sort_order", "price", "hsn_code", "gst_rate").join(owners, "invoice_id")
    lines = stored(lines, "lines-to-draft")
    keys = lines.select("client_id", "hsn_code", "gst_rate", "buys").distinct()
    side = lambda buys, kind: L.resolve_items(keys.where("buys" if buys else "NOT buys"), rules, ledgers, kind)
    resolved = side(True, "PURCHASE").unionByName(side(False, "SALE")).select("client_id", "hsn_code", "gst_rate", "buys", "item_ledger", "item_confidence", "item_via")
    lines = L.null_safe_left(lines, resolved, ["client_id", "buys", "hsn_code", "gst_rate"])
    one = F.struct("sort_order", "price", F.col("item_ledger").alias("ledger_id"), F.col("item_confidence").alias("confidence"), F.col("item_via").alias("mapped_via"), "hsn_code", "gst_rate")
    arrays = lines.groupBy("invoice_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.dropFields("sort_order")).cast(ITEM).alias("items"))
    rows = rows.join(arrays, "invoice_id", "left").join(system_ledgers(ledgers), ["client_id", "buys"], "left")
    said = F.when(F.col("invoice_number") != "", F.concat(F.lit("Inv "), F.col("invoice_number")))
    return build_vouchers(rows).withColumns({"voucher_id": F.coalesce("_old", "invoice_id"), "narration": said})


def voucher_tables(drafts: DataFrame, vouchers: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: the vouchers and lines after the drafts: those rebuilt are replaced, headers and all their lines, the others stay as they are."""
    header = drafts.select(
        "voucher_id", "invoice_id", "client_id", "voucher_type", F.lit("DRAFT").alias("status"), F.col("total_debit_p").alias("debit_p"), F.col("total_credit_p").alias("credit_p"), "avg_confidence",
        F.coalesce("invoice_date", "created_at").alias("voucher_date"), "created_at", "narration",
    )
    own = lines_of(drafts, "voucher_id").select("voucher_id", "sort_order", "role", "ledger_id", "debit_p", "credit_p", "mapped_via", "confidence")
    rest = drafts.select("voucher_id")
    kept = vouchers.join(rest, "voucher_id", "left_anti").select(*header.columns)
    return kept.unionByName(header), lines.select(*own.columns).join(rest, "voucher_id", "left_anti").unionByName(own)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """K7: a new snapshot of tables that belong together under a new path, the last one written last, so a reader that finds it finds all."""
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}")


def write_by_client(rows: DataFrame, path: str) -> None:
    """A table as a folder a client; clients that rows has are replaced, the folders of the others stay as they are. A large client is several files."""
    with no_shuffles_left(rows.sparkSession):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("client_id").parquet(path)


#: Clients that are looked up by name; more are joined.
FEW_CLIENTS = 1000


def of_clients(table: DataFrame, clients: DataFrame) -> DataFrame:
    """A table of write_by_client, for some clients: a few are named in the scan's partition filter, many are joined, by which Spark prunes while it runs."""
    named = [r[0] for r in clients.select("client_id").distinct().limit(FEW_CLIENTS + 1).collect()]
    return table.where(F.col("client_id").isin(named)) if len(named) <= FEW_CLIENTS else table.join(clients.select("client_id").distinct(), "client_id", "left_semi")


def redraft_in_place(drafts: DataFrame, vouchers_path: str, lines_path: str) -> None:
    """K5: the stored vouchers and lines (both by client, see write_by_client) after the drafts; only the folders of clients with drafts are read and written.

    Both results are stored before either table changes. Lines are written first, so a reader that sees a new header sees its lines; doing it again gives the same.
    """
    spark = drafts.sparkSession
    drafts = stored(drafts, "drafts")
    vouchers, lines = (of_clients(spark.read.parquet(p), drafts) for p in (vouchers_path, lines_path))
    after, own = voucher_tables(drafts, vouchers, lines)
    owner = after.select("voucher_id", "client_id")
    after, own = stored(after, "vouchers-after"), stored(own.join(owner, "voucher_id"), "lines-after")
    write_by_client(own, lines_path)
    write_by_client(after, vouchers_path)
