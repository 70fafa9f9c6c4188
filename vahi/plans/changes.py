"""Queries of what is written and read back: runs as transactions, tables by client, the stream's memory, approvals that teach, edits; and of amounts as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vahi.functions import values as V
from vahi.operators import documents, drafts, ledgers, reconcile, screens, tables, validate, vouchers
from vahi.plans.catalogue import _CHECKS, _FLAGGED, _GREEDY, _RECON, MONEY, NARRATION, NORM_GSTIN, NORM_NAME, P, Tables, _flagged, _recon_sides, _validated, as_of, query
from vahi.sources import files, snapshots
from vahi.storage import new_path, stored
from vahi.streaming import bank_stream


def _micro(c):
    """Millionths, for amounts below a paisa: of the decimal digits that a double stands for, since a product of doubles is not exact above some thousand millions."""
    return (c.cast("decimal(30,6)") * 1_000_000).cast("long")


# ---- amounts as JSON ----

_BIG = "(12345678 + 1000003 * (invoice_id % 900000))"


@query(f"""
SELECT invoice_id, CASE invoice_id % 5 WHEN 0 THEN {_BIG} * 1000000 + (invoice_id % 100) * 10000 WHEN 1 THEN 12345678000000 WHEN 2 THEN 500 WHEN 3 THEN 12345500000 ELSE 0 END AS as_bank,
  CASE invoice_id % 5 WHEN 0 THEN {_BIG} * 1000000 + (invoice_id % 100) * 10000 WHEN 1 THEN 12345678000000 WHEN 2 THEN 500 WHEN 3 THEN 12345500000 ELSE 0 END AS as_portal,
  CASE invoice_id % 5 WHEN 0 THEN {_BIG} * 1000000 + (invoice_id % 100) * 10000 WHEN 1 THEN 12345678000000 WHEN 2 THEN 500 WHEN 3 THEN 12345500000 ELSE 0 END AS as_flat,
  CASE invoice_id % 5 WHEN 0 THEN {_BIG} * 1000000 + (invoice_id % 100) * 10000 WHEN 1 THEN 12345678000000 WHEN 2 THEN 500 WHEN 3 THEN 12345500000 ELSE 0 END AS as_total,
  CASE invoice_id % 5 WHEN 0 THEN {_BIG} * 1000000 + (invoice_id % 100) * 10000 WHEN 1 THEN 12345678000000 WHEN 2 THEN 500 WHEN 3 THEN 12345500000 ELSE 0 END AS as_price FROM {{invoice}}
""")
def c20_json_amounts(t: Tables) -> DataFrame:
    """Amounts of an invoice written into each kind of payload, as JSON numbers plain and with exponents, tiny ones, text with signs, and null; in millionths."""
    i, k = F.col("invoice_id"), F.col("invoice_id") % 5
    big = F.concat((12345678 + 1000003 * (i % 900000)).cast("string"), F.lit("."), F.lpad((i % 100).cast("string"), 2, "0"))
    said = F.when(k == 0, big).when(k == 1, "1.2345678E7").when(k == 2, "0.0005").when(k == 3, '"₹12,345.50 only"').otherwise("null")
    rows = t.invoice.select("invoice_id", said.alias("a"))
    put = lambda before, after: rows.select("invoice_id", F.concat(F.lit(before), "a", F.lit(after)).alias("payload"))
    out = [
        files.bank_rows(put('{"transactions": [{"withdrawal": ', "}]}")).select("invoice_id", _micro(F.col("withdrawal")).alias("as_bank")),
        files.portal_rows(put('{"b2b": [{"ctin": "x", "inv": [{"inum": 7, "txval": ', "}]}]}")).select("invoice_id", _micro(F.col("taxable_value")).alias("as_portal")),
        files.flat_rows(put('[{"inum": 7, "taxableValue": ', "}]")).select("invoice_id", _micro(F.col("taxable_value")).alias("as_flat")),
        files.invoice_rows(put('{"total_amount": ', "}"), as_of()).select("invoice_id", _micro(F.col("total_amount")).alias("as_total")),
        files.invoice_rows(put('{"items": [{"amount": ', "}]}"), as_of()).select("invoice_id", _micro(F.col("items")[0]["price"]).alias("as_price")),
    ]
    met = out[0]
    for x in out[1:]:
        met = met.join(x, "invoice_id")
    return met


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE (event_id + 10000000) * 100 + 25 END AS of_double, (event_id + 10000000) * 100 + 25 AS of_decimal, event_id * 100 AS of_long FROM {events}
""")
def c20_typed_amounts(t: Tables) -> DataFrame:
    """C20: amounts that are numbers already keep all their digits; what is not finite is 0."""
    e = F.col("event_id")
    double = F.when(e % 3 == 2, F.lit(float("nan"))).otherwise((e + 10000000).cast("double") + 0.25)
    paise = lambda c: V.to_paise(V.clean_money(c))
    return t.events.select("event_id", paise(double).alias("of_double"), paise(((e + 10000000).cast("decimal(20,0)") + F.lit(0.25).cast("decimal(4,2)"))).alias("of_decimal"), paise(e).alias("of_long"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN event_type ELSE event_type || chr(160) || 'x' END AS v FROM {events}")
def c1_blank_text(t: Tables) -> DataFrame:
    """White space of every kind goes at the ends, none inside; nothing left is null."""
    from vahi.functions import text as T

    k = F.col("event_id") % 4
    raw = F.when(k == 0, "\n \t ").when(k == 1, F.concat(F.lit("\t\n"), "event_type", F.lit("  \r"))).otherwise(F.concat("event_type", F.lit(" x﻿")))
    return t.events.select("event_id", T.blank_to_null(raw).alias("v"))


# ---- validation ----

_ORDER = (
    "['VENDOR_GSTIN_MISSING', 'VENDOR_GSTIN_INVALID', 'VENDOR_STATE_UNKNOWN', 'CUSTOMER_GSTIN_INVALID', 'SAME_PARTY_GSTIN', 'VENDOR_PAN_IN_GSTIN', 'TAX_TYPE_INTERSTATE', 'CGST_SGST_ON_INTERSTATE', 'IGST_ON_INTRASTATE', 'CGST_SGST_IMBALANCE', "
    "'TAX_MATH_MISMATCH', 'TOTAL_MATH_MISMATCH', 'NEGATIVE_TOTAL', 'DISCOUNT_EXCEEDS_SUBTOTAL', 'INVOICE_NUMBER_MISSING', 'INVOICE_DATE_MISSING', 'INVOICE_DATE_INVALID', 'INVOICE_DATE_FUTURE', 'HSN_MISSING', 'HSN_PARTIAL', 'HSN_FORMAT', 'LINE_MATH', "
    "'UNUSUAL_GST_RATE', 'NO_LINE_ITEMS', 'REVERSE_CHARGE', 'EINVOICE_THRESHOLD', 'EWAY_FORMAT', 'DOC_TYPE_UNKNOWN', 'ZERO_TAX_ON_TAXABLE']"
)


@query(_CHECKS + f"SELECT j.invoice_id, coalesce(string_agg(code, ',' ORDER BY list_position({_ORDER}, code)), '') AS codes FROM j LEFT JOIN codes USING (invoice_id) GROUP BY j.invoice_id")
def v1_issues_in_order(t: Tables) -> DataFrame:
    """Each invoice's issues in the order of the checks."""
    return _validated(t).select("invoice_id", F.array_join("issues.code", ",").alias("codes"))


@query(_CHECKS + f"""
SELECT j.invoice_id, coalesce(string_agg(code, ',' ORDER BY list_position({_ORDER}, code)) FILTER (WHERE n <= 8), '') AS codes
FROM j LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY list_position({_ORDER}, code)) AS n FROM codes) USING (invoice_id) GROUP BY j.invoice_id
""".replace("j LEFT JOIN (SELECT *,", "(SELECT invoice_id FROM j) j LEFT JOIN (SELECT *,"))
def l4_shown_issues(t: Tables) -> DataFrame:
    """L4: the first eight issues of each invoice."""
    return screens.first_issues(_validated(t)).select("invoice_id", F.array_join("issues.code", ",").alias("codes"))


@query(_CHECKS.replace("FROM {invoice})", "FROM (SELECT * REPLACE (NULL::VARCHAR AS invoice_number, NULL::TIMESTAMP AS invoice_date, NULL::VARCHAR AS irn, NULL::VARCHAR AS eway_bill_no, FALSE AS reverse_charge) FROM {invoice}))") + f"SELECT j.invoice_id, coalesce(string_agg(code, ',' ORDER BY list_position({_ORDER}, code)), '') AS codes FROM j LEFT JOIN codes USING (invoice_id) GROUP BY j.invoice_id")
def v1_save_route(t: Tables) -> DataFrame:
    """V1: the issues as the route that saves invoices early has them: without number, date, electronic number, way bill and reverse charge."""
    return validate.validate(validate.with_items(t.invoice, t.invoice_item), as_of(), save_route_profile=True).select("invoice_id", F.array_join("issues.code", ",").alias("codes"))


# ---- runs ----

_UPLOADS = "(SELECT client_id, client_id * 1000 + 7 AS upload_id, '2b-' || CAST(client_id AS VARCHAR) || '.json' AS file_name, CASE WHEN client_id % 3 <> 0 THEN '2024-0' || CAST(1 + client_id % 9 AS VARCHAR) END AS period FROM {client} WHERE client_id % 4 <> 3)"


def _uploads(t: Tables) -> DataFrame:
    c = F.col("client_id")
    return t.client.where(c % 4 != 3).select("client_id", (c * 1000 + 7).alias("upload_id"), F.concat(F.lit("2b-"), c.cast("string"), F.lit(".json")).alias("file_name"), F.when(c % 3 != 0, F.concat(F.lit("2024-0"), (1 + c % 9).cast("string"))).alias("period"))


def _run(t: Tables) -> tuple[SparkSession, str]:
    """A run persisted twice, of which the second changes nothing."""
    rows, books = _recon_sides(t)
    rows = stored(rows, "portal-rows")  # matched, counted and written
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "recon-runs")
    results = reconcile.reconcile(rows, books)
    for _ in range(2):
        reconcile.persist(results, rows, _uploads(t), as_of(), path, "r1")
    return spark, path


@query(_GREEDY + f"""
SELECT u.client_id, upload_id, file_name, period, coalesce(row_count, 0) AS row_count, count(status) FILTER (WHERE status = 'MATCHED') AS n_matched, count(*) FILTER (WHERE status = 'VALUE_MISMATCH') AS n_value_mismatch, count(*) FILTER (WHERE status = 'MISSING_IN_2B') AS n_missing_in_2b, count(*) FILTER (WHERE status = 'MISSING_IN_BOOKS') AS n_missing_in_books,
  CAST(coalesce(sum({P('yy')}) FILTER (WHERE status = 'MATCHED'), 0) AS BIGINT) AS itc_eligible_p, CAST(coalesce(sum({P('dy')}) FILTER (WHERE status <> 'MATCHED'), 0) AS BIGINT) AS itc_at_risk_p
FROM {_UPLOADS} u LEFT JOIN (SELECT client_id, count(*) AS row_count FROM r GROUP BY client_id) USING (client_id) LEFT JOIN (SELECT res.*, y AS yy FROM res LEFT JOIN (SELECT row_id, y FROM r) USING (row_id)) res ON res.client_id = u.client_id GROUP BY ALL
""")
def k6_run_header(t: Tables) -> DataFrame:
    """K6: the headers of a committed run, with file names and periods."""
    spark, path = _run(t)
    return snapshots.read_all(spark, path, "header").drop("created_at")


@query(_GREEDY + f"""
SELECT upload_id, res.client_id, row_id, invoice_id, status, {P('dx')} AS taxable_p, {P('dy')} AS tax_p, CASE status WHEN 'MATCHED' THEN 'Matched' WHEN 'MISSING_IN_BOOKS' THEN 'Present in GSTR-2B but not found in purchase register' WHEN 'MISSING_IN_2B' THEN 'Present in books but missing in GSTR-2B'
  ELSE 'Taxable Δ ₹' || {MONEY(P('dx'))} || ', Tax Δ ₹' || {MONEY(P('dy'))} END AS notes FROM res JOIN {_UPLOADS} u ON u.client_id = res.client_id
""")
def k6_run_matches(t: Tables) -> DataFrame:
    """The matches of a committed run, with notes."""
    spark, path = _run(t)
    return snapshots.read_all(spark, path, "matches").select("upload_id", "client_id", "row_id", "invoice_id", "status", V.to_paise(F.col("taxable_diff")).alias("taxable_p"), V.to_paise(F.col("tax_diff")).alias("tax_p"), "notes")


@query(f"SELECT upload_id, client_id, row_id, supplier_gstin, supplier_name, invoice_number, {P('taxable_value')} AS taxable_p, {P('total_tax')} AS tax_p FROM {{gst2b_row}} JOIN {_UPLOADS.replace('{client}', '{{client}}')} u USING (client_id)".replace("{{client}}", "{client}"))
def k6_run_rows(t: Tables) -> DataFrame:
    """K6: the portal rows of a committed run, under its upload's id."""
    spark, path = _run(t)
    rows = snapshots.read_all(spark, path, "rows")
    return rows.select("upload_id", "client_id", "row_id", "supplier_gstin", "supplier_name", "invoice_number", V.to_paise(F.coalesce("taxable_value", F.lit(0.0))).alias("taxable_p"), V.to_paise(F.coalesce("total_tax", F.lit(0.0))).alias("tax_p"))


# ---- exports and approvals ----


@query("""
WITH a AS (SELECT voucher_id, client_id FROM {voucher} WHERE status IN ('APPROVED', 'EXPORTED_DEMO') AND voucher_id % 3 = 0)
SELECT voucher_id, v.client_id, n_vouchers, CASE WHEN a.voucher_id IS NOT NULL THEN 'EXPORTED_DEMO' ELSE status END AS new_status FROM {voucher} v LEFT JOIN a USING (voucher_id) LEFT JOIN (SELECT client_id, count(*) AS n_vouchers FROM a GROUP BY client_id) n ON a.voucher_id IS NOT NULL AND n.client_id = v.client_id
""".replace("SELECT voucher_id, v.client_id", "SELECT v.voucher_id, v.client_id"))
def k4_export_chosen(t: Tables) -> DataFrame:
    """Vouchers after an export of chosen ids, of which some are drafts and some are asked for twice, beside its audit; committed as one transaction and read back."""
    asked = t.voucher.where("voucher_id % 3 = 0").select("voucher_id")
    after, audit = vouchers.exported(t.voucher, asked.unionByName(asked.where("voucher_id % 2 = 0")))
    spark, path = after.sparkSession, new_path(after.sparkSession, "exports")
    snapshots.commit(path, "e1", {"audit": audit, "vouchers": after.select("voucher_id", "client_id", F.col("status").alias("new_status"))})
    return snapshots.read(spark, path, "e1", "vouchers").join(snapshots.read(spark, path, "e1", "audit"), ["client_id", "voucher_id"], "left")


@query(f"""
WITH g AS (SELECT * FROM {_FLAGGED} WHERE status = 'DRAFT' AND NOT unmapped AND abs(debit_p - credit_p) <= 1 AND avg_confidence >= 0.9),
e AS (SELECT g.client_id, g.voucher_id, l.ledger_id, {NORM_GSTIN('i.vendor_gstin')} AS k, {NORM_NAME('i.vendor')} AS m FROM g JOIN (SELECT * FROM {{voucher_line}} WHERE role = 'PARTY' AND ledger_id IS NOT NULL) l ON l.voucher_id = g.voucher_id JOIN {{invoice}} i ON i.invoice_id = g.invoice_id),
x AS (SELECT client_id, 'GSTIN' AS match_type, k AS match_key, ledger_id, 1 AS hits, voucher_id AS seq FROM e UNION ALL SELECT client_id, 'VENDOR_NAME', m, ledger_id, 1, voucher_id FROM e UNION ALL SELECT client_id, match_type, match_key, ledger_id, hit_count, -1 FROM {{memory}})
SELECT client_id, match_type, match_key, CAST(sum(hits) AS BIGINT) AS hit_count, last(ledger_id ORDER BY seq, hits, ledger_id) AS ledger_id FROM x WHERE match_key <> '' GROUP BY ALL
""")
def m2_approve_and_learn(t: Tables) -> DataFrame:
    """M2, M4: the memory after a bulk approval of sure drafts, each of which teaches its party's ledger."""
    approved = vouchers.bulk_approve(vouchers.gate(t.voucher, t.voucher_line), only_high=True)
    return ledgers.learned(t.memory, vouchers.approval_events(approved, t.voucher_line, t.invoice))


# ---- the stream's memory ----


@query("WITH k AS (SELECT CAST(statement_id % 25 AS INT) AS client_id, " + NARRATION.replace("{0}", "description") + " AS match_key, ledger_id, txn_id FROM {bank_txn} WHERE ledger_id IS NOT NULL) SELECT client_id, match_key, arg_max(ledger_id, txn_id) AS ledger_id, count(*) AS hit_count FROM k WHERE match_key <> '' GROUP BY ALL")
def m5_stream_memory(t: Tables) -> DataFrame:
    """Narration memory that a stream over four parts, each of as many files as tasks write, learns in four batches; the log is compacted after the second and third, and what is read is base and deltas."""
    spark = t.bank_txn.sparkSession
    path = new_path(spark, "bank-stream")
    rows = t.bank_txn.select((F.col("statement_id") % 25).cast("int").alias("client_id"), F.col("txn_id").cast("long").alias("txn_id"), "description", "withdrawal", "deposit", F.col("ledger_id").cast("long").alias("ledger_id"))
    schema = rows.schema
    for k in range(4):
        rows.where(F.pmod("txn_id", F.lit(4)) == k).write.mode("append").parquet(f"{path}/in")
        bank_stream.learn_stream(bank_stream.classified_stream(spark, f"{path}/in", schema), f"{path}/memory", f"{path}/checkpoint").awaitTermination()
        if k in (1, 2):
            bank_stream.compact(spark, f"{path}/memory", k)
    return bank_stream.memory(spark, f"{path}/memory")


# ---- edits ----


@query("""
WITH w AS (SELECT client_id, trim(name || CASE ledger_id % 3 WHEN 0 THEN ' (new)' ELSE ' ' END) AS name, min(1000000000 + ledger_id) AS ledger_id FROM {ledger} GROUP BY ALL)
SELECT client_id, ledger_id, name FROM {ledger} UNION ALL SELECT client_id, ledger_id, name FROM w WHERE NOT EXISTS (SELECT 1 FROM {ledger} l WHERE l.client_id = w.client_id AND l.name = w.name)
""")
def m9_ledgers_after(t: Tables) -> DataFrame:
    """M9: the ledgers themselves after those wanted are made where their client has none of that name."""
    wanted = t.ledger.withColumns({"name": F.concat("name", F.when(F.col("ledger_id") % 3 == 0, " (new)").otherwise("\n ")), "ledger_id": F.col("ledger_id") + 1_000_000_000})
    return tables.upsert_ledgers(t.ledger, wanted).select("client_id", "ledger_id", "name")


@query("SELECT rule_id, client_id, rule_type, CASE WHEN rule_id % 3 = 0 THEN FALSE ELSE enabled END AS enabled, CASE WHEN rule_id % 4 = 0 THEN 9 ELSE priority END AS priority FROM {mapping_rule} WHERE rule_id % 5 <> 0 UNION ALL SELECT -rule_id, client_id, 'VENDOR_NAME_EQUALS', TRUE, 100 FROM {mapping_rule} WHERE rule_id % 7 = 0")
def m10_rules(t: Tables) -> DataFrame:
    """Mapping rules after some are switched off, given another priority, deleted and made."""
    k, table = F.col("rule_id"), t.mapping_rule.select("rule_id", "client_id", "rule_type", "enabled", "priority")
    edits = table.where((k % 3 == 0) | (k % 4 == 0)).select("rule_id", F.when(k % 3 == 0, F.lit(False)).alias("enabled"), F.when(k % 4 == 0, F.lit(9)).alias("priority"))
    made = table.where(k % 7 == 0).select((-k).alias("rule_id"), "client_id", F.lit("VENDOR_NAME_EQUALS").alias("rule_type"), F.lit(True).alias("enabled"), F.lit(100).alias("priority"))
    return tables.applied(table, "rule_id", made, edits, table.where(k % 5 == 0))


@query("SELECT invoice_id, client_id, status, is_duplicate FROM (SELECT invoice_id, client_id, CASE WHEN invoice_id % 4 = 1 THEN 'PROCESSED' ELSE status END AS status, is_duplicate FROM {invoice} WHERE invoice_id % 6 <> 0) UNION ALL SELECT invoice_id + 5000000000, client_id, 'PENDING', FALSE FROM {invoice} WHERE invoice_id % 10 = 0")
def m10_invoices(t: Tables) -> DataFrame:
    """Invoices after intake of new ones, a change of state and deletions."""
    i, table = F.col("invoice_id"), t.invoice.select("invoice_id", "client_id", "status", "is_duplicate")
    made = table.where(i % 10 == 0).select((i + 5_000_000_000).alias("invoice_id"), "client_id", F.lit("PENDING").alias("status"), F.lit(False).alias("is_duplicate"))
    return tables.applied(table, "invoice_id", made, table.where(i % 4 == 1).select("invoice_id", F.lit("PROCESSED").alias("status")), table.where(i % 6 == 0))


@query("SELECT client_id, user_id, CASE WHEN client_id % 2 = 0 THEN name || ' & Sons' ELSE name END AS name, is_default FROM {client} WHERE client_id % 5 <> 4 UNION ALL SELECT client_id + 1000, user_id, 'new ' || name, FALSE FROM {client} WHERE client_id % 5 = 4")
def m10_clients(t: Tables) -> DataFrame:
    """Clients after renames, deletions and creations."""
    c, table = F.col("client_id"), t.client.select("client_id", "user_id", "name", "is_default")
    made = table.where(c % 5 == 4).select((c + 1000).alias("client_id"), "user_id", F.concat(F.lit("new "), "name").alias("name"), F.lit(False).alias("is_default"))
    return tables.applied(table, "client_id", made, table.where(c % 2 == 0).select("client_id", F.concat("name", F.lit(" & Sons")).alias("name")), table.where(c % 5 == 4))


@query(f"""
SELECT i.invoice_id, CASE WHEN i.invoice_id % 5 <> 0 THEN CAST(invoice_date AS DATE) WHEN i.invoice_id % 3 = 0 THEN DATE '2024-02-09' WHEN i.invoice_id % 3 = 1 THEN CAST(invoice_date AS DATE) ELSE DATE '1998-06-01' END AS day,
  CASE WHEN i.invoice_id % 5 = 0 AND i.invoice_id % 2 = 0 THEN '' ELSE 'Old street ' || CAST(client_id AS VARCHAR) END AS address, CASE WHEN i.invoice_id % 5 = 0 AND i.invoice_id % 4 = 0 THEN '+91 1' ELSE NULL END AS phone,
  CASE WHEN i.invoice_id % 5 = 0 AND i.invoice_id % 7 = 0 THEN 'edited' ELSE coalesce(names, '') END AS items, CASE WHEN i.invoice_id % 5 <> 0 THEN {P('subtotal')} WHEN i.invoice_id % 4 = 0 THEN 1234567890 ELSE {P('subtotal')} END AS subtotal_p
FROM {{invoice}} i LEFT JOIN (SELECT invoice_id, string_agg(name, '|' ORDER BY sort_order) AS names FROM {{invoice_item}} GROUP BY invoice_id) USING (invoice_id)
""")
def p11_patched_details(t: Tables) -> DataFrame:
    """Date, address, phone, items and numbers of invoices after edits, amounts as doubles."""
    i = F.col("invoice_id")
    rows = validate.with_items(t.invoice, t.invoice_item).withColumns({"vendor_address": F.concat(F.lit("Old street "), F.col("client_id").cast("string")), "vendor_phone": F.lit(None).cast("string"), "items": F.transform("items", lambda x: x["name"])})
    updates = t.invoice.where(i % 5 == 0).select(
        "invoice_id", F.when(i % 3 == 0, "09/02/2024").when(i % 3 == 1, "").otherwise("some day").alias("invoice_date"), F.when(i % 2 == 0, "").alias("vendor_address"), F.when(i % 4 == 0, "+91 1").alias("vendor_phone"),
        F.when(i % 7 == 0, F.array(F.lit("edited"))).alias("items"), F.when(i % 4 == 0, 12345678.9).alias("subtotal"),
    )
    out = screens.patched(rows, updates, as_of())
    return out.select("invoice_id", F.to_date("invoice_date").alias("day"), F.col("vendor_address").alias("address"), F.col("vendor_phone").alias("phone"), F.coalesce(F.array_join("items", "|"), F.lit("")).alias("items"), V.to_paise(F.coalesce("subtotal", F.lit(0.0))).alias("subtotal_p"))


@query(f"""
SELECT i.invoice_id, {MONEY(P('total_amount'))} AS total, CASE WHEN i.invoice_id % 2 = 0 THEN {MONEY('own.paise')} WHEN first.invoice_id IS NOT NULL THEN {MONEY('first.paise')} END AS first_price, CASE WHEN i.invoice_id % 2 = 0 THEN own.name ELSE first.name END AS first_name
FROM {{invoice}} i LEFT JOIN (SELECT invoice_id, name, CASE WHEN price < 0 THEN -1 ELSE 1 END * CAST(floor(abs(price) * 100 + 0.5) AS BIGINT) AS paise FROM {{invoice_item}} WHERE sort_order = 0) own ON own.invoice_id = i.invoice_id
LEFT JOIN (SELECT invoice_id, name, CAST(floor(qty * 100 + 0.5) AS BIGINT) AS paise FROM {{invoice_item}} WHERE sort_order = 0) first ON first.invoice_id = i.invoice_id
""")
def p14_detail_rows(t: Tables) -> DataFrame:
    """The detail view over real invoices: every second one has items of its own, the others what was extracted, here with the quantity as price."""
    rows = validate.with_items(t.invoice, t.invoice_item)
    of = lambda price: F.transform("items", lambda x: F.struct(x["name"].alias("name"), x[price].alias("price")))
    first = F.try_element_at(screens.shown_items(F.when(F.col("invoice_id") % 2 == 0, of("price")), of("qty")), F.lit(1))
    plain = lambda c: F.col(c).cast("decimal(20,2)").cast("string")
    price = first["price"].cast("decimal(20,2)").cast("string")
    return rows.select("invoice_id", screens.shown_amount(plain("total_amount")).alias("total"), F.when(first.isNotNull(), screens.shown_amount(price)).alias("first_price"), first["name"].alias("first_name"))


@query("""
WITH made AS (SELECT invoice_id, i.client_id FROM {invoice} i LEFT JOIN {voucher} v USING (invoice_id) WHERE i.client_id % 4 = 1 AND (v.status IS NULL OR v.status = 'DRAFT')),
after AS (SELECT voucher_id, client_id, status FROM {voucher} WHERE NOT (client_id % 4 = 1 AND status = 'DRAFT') UNION ALL SELECT invoice_id, client_id, 'DRAFT' FROM made)
SELECT client_id, count(*) AS n, count(*) FILTER (WHERE status = 'DRAFT') AS n_drafts, CAST(sum(voucher_id) AS BIGINT) AS ids FROM after GROUP BY client_id
""".replace("SELECT invoice_id, i.client_id FROM {invoice} i", "SELECT i.invoice_id, i.client_id FROM {invoice} i").replace("LEFT JOIN {voucher} v USING (invoice_id)", "LEFT JOIN {voucher} v ON v.invoice_id = i.invoice_id"))
def k5_in_place(t: Tables) -> DataFrame:
    """K5: vouchers stored by client, after the drafts of every fourth client are rebuilt in place."""
    from vahi.plans.screens import _ledgers_with_seed, _overrides

    spark, path = t.voucher.sparkSession, new_path(t.voucher.sparkSession, "books")
    kept = t.voucher.select("voucher_id", "invoice_id", "client_id", "voucher_type", "status", "debit_p", "credit_p", "avg_confidence", "voucher_date", "created_at", "narration")
    own = t.voucher_line.join(t.voucher.select("voucher_id", "client_id"), "voucher_id").select("voucher_id", "sort_order", "role", "ledger_id", "debit_p", "credit_p", "mapped_via", "confidence", "client_id")
    drafts.write_by_client(kept, f"{path}/vouchers")
    drafts.write_by_client(own, f"{path}/lines")
    some = t.invoice.where("client_id % 4 = 1")
    made = drafts.draft_vouchers(some, t.invoice_item.join(some.select("invoice_id"), "invoice_id", "left_semi"), t.voucher, t.mapping_rule, t.memory, _ledgers_with_seed(t), _overrides(t))
    drafts.redraft_in_place(made, f"{path}/vouchers", f"{path}/lines")
    out = spark.read.parquet(f"{path}/vouchers")
    return out.groupBy("client_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "DRAFT").alias("n_drafts"), F.sum("voucher_id").alias("ids"))
