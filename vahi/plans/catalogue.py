"""Every query of the engine over the driver's tables, with DuckDB SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.functions import values as V
from vahi.operators import bank, documents, export, ledgers, reconcile, reports, validate, vouchers
from vahi.operators.matching import contains_join, dice_join
from vahi.operators.order import positions
from vahi.sources import files
from vahi.sources.bindings import view, with_sql
from vahi.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The day that stands for now, so that runs repeat.
AS_OF = "1998-06-01"


class Tables:
    """The bindings by attribute, each made once a query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self._spark, self._dir, name, self._made)

    def keep(self, name: str, *columns: str) -> None:
        """Store these columns of a binding: what is asked for later reads them instead of making the binding again."""
        self._made[name] = stored(getattr(self, name).select(*columns), name)


def query(sql: str | None):
    """Register a function of Tables under its name; sql uses {binding} for the tables."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_sql(sql)
        return run

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# what several statements below use, in SQL
P = "CAST(floor(coalesce({0}, 0) * 100 + 0.5) AS BIGINT)".format
NORM_NAME = (
    "nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[.,&''\"/\\\\()\\-]', ' ', 'g'), "
    "'\\b(private|pvt|limited|ltd|llp|inc|incorporated|corporation|corp|co|company|enterprises|enterprise|industries|traders|trading|and|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), '')"
).format
NORM_GSTIN = "nullif(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '')".format
SQUEEZE = "coalesce(regexp_replace(upper({0}), '\\s+', '', 'g'), '')".format
STATES = "('" + "','".join(T.STATES) + "')"
VALID = (f"(regexp_full_match({{0}}, '[0-9]{{{{2}}}}[A-Z]{{{{5}}}}[0-9]{{{{4}}}}[A-Z][1-9A-Z]Z[0-9A-Z]') AND substring({{0}}, 1, 2) IN {STATES})").format
NARRATION = (
    "coalesce(" + NORM_NAME("regexp_replace(regexp_replace(coalesce({0}, ''), '\\b[0-9]{{6,}}\\b', ' ', 'g'), '(?i)\\b(upi|neft|imps|rtgs|ref|txn)\\b', ' ', 'g')").replace("{0}", "{{0}}") + ", '')"
).replace("{{0}}", "{0}").replace("{{6,}}", "{6,}")
MONEY = "CASE WHEN ({0}) < 0 THEN '-' ELSE '' END || CAST(abs({0}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0')".format


def _flagged(t: Tables) -> DataFrame:
    return reports.unmapped_flags(t.voucher, t.voucher_line)


# ---- sources, projections, filters ----


@query("SELECT client_id, user_id, invoice_id, vendor, status FROM {invoice} WHERE client_id = 7 AND user_id = 2 AND document_type = 'PURCHASE'")
def s1_tenant_scan(t: Tables) -> DataFrame:
    """One tenant's purchases, few columns."""
    return t.invoice.where("client_id = 7 AND user_id = 2 AND document_type = 'PURCHASE'").select("client_id", "user_id", "invoice_id", "vendor", "status")


@query("SELECT voucher_id, status, debit_p FROM {voucher} WHERE client_id = 7 AND voucher_id = (SELECT max(voucher_id) FROM {voucher} WHERE client_id = 7)")
def s2_point_lookup(t: Tables) -> DataFrame:
    """One voucher by id, within its tenant: here the client's last one."""
    own = t.voucher.where("client_id = 7")
    return own.join(F.broadcast(own.agg(F.max("voucher_id").alias("voucher_id"))), "voucher_id").select("voucher_id", "status", "debit_p")


@query("""
SELECT i.invoice_id, count(sort_order) AS n_items, coalesce(string_agg(name, '|' ORDER BY sort_order), '') AS names, CAST(coalesce(sum(price_p), 0) AS BIGINT) AS items_p
FROM {invoice} i LEFT JOIN {invoice_item} USING (invoice_id) GROUP BY i.invoice_id
""")
def s3_nested_load(t: Tables) -> DataFrame:
    """S3: invoices with their lines as ordered arrays."""
    out = validate.with_items(t.invoice, t.invoice_item)
    paise = F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + F.abs(V.to_paise(F.abs(x.price))))
    return out.select("invoice_id", V.rows_in(F.col("items")).cast("long").alias("n_items"), F.coalesce(F.array_join(F.transform("items", lambda x: x["name"]), "|"), F.lit("")).alias("names"), F.coalesce(paise, F.lit(0)).alias("items_p"))


@query("""
SELECT client_id * 10 + ino % 2 AS party, lpad(CAST(ino AS VARCHAR), 6, '0') AS invoice_number, ino % 30 + 1 AS day, {p} AS taxable_p, tax_p AS tax_p
FROM (SELECT client_id, invoice_id AS ino, subtotal, {c} + {s} AS tax_p FROM {invoice})
""".replace("{p}", P("subtotal")).replace("{c}", P("cgst")).replace("{s}", P("sgst")))
def s4_portal_json(t: Tables) -> DataFrame:
    """Statements in the portal's nested JSON, at most 100 invoices each, at different paths, read back as rows."""
    rows = t.invoice.withColumn("block", F.expr("invoice_id div 100"))
    inv = F.struct(
        F.lpad(F.col("invoice_id").cast("string"), 6, "0").alias("inum"), F.concat(F.lpad((F.col("invoice_id") % 30 + 1).cast("string"), 2, "0"), F.lit("/01/2024")).alias("idt"),
        F.concat(F.lit("₹"), F.col("subtotal").cast("decimal(18,2)").cast("string")).alias("txval"), F.col("cgst").alias("camt"), F.col("sgst").alias("samt"),
    )
    party = F.col("client_id") * 10 + F.col("invoice_id") % 2
    by_party = rows.groupBy("client_id", "block", party.cast("string").alias("ctin")).agg(F.collect_list(inv).alias("inv"))
    b2b = by_party.groupBy("client_id", "block").agg(F.to_json(F.collect_list(F.struct("ctin", "inv"))).alias("b"))
    path = F.when(F.col("client_id") % 3 == 0, F.concat(F.lit('/* as sent */ {"data": {"docdata": {"b2b": '), "b", F.lit("}}}"))).when(F.col("client_id") % 3 == 1, F.concat(F.lit('{"docdata": {"b2b": '), "b", F.lit("}}"))).otherwise(F.concat(F.lit('{"b2b": '), "b", F.lit("}")))
    out = files.portal_rows(b2b.select("client_id", path.alias("payload")))
    return out.select(F.col("supplier_gstin").cast("long").alias("party"), "invoice_number", F.dayofmonth("invoice_date").cast("long").alias("day"), V.to_paise(F.col("taxable_value")).alias("taxable_p"), V.to_paise(F.col("total_tax")).alias("tax_p"))


@query("SELECT invoice_id, nullif(trim(vendor), '') AS supplier_name, {p} AS taxable_p, {c} + {s} + {i} AS tax_p FROM {invoice}".replace("{p}", P("subtotal")).replace("{c}", P("cgst")).replace("{s}", P("sgst")).replace("{i}", P("igst")))
def s5_flat_json(t: Tables) -> DataFrame:
    """Flat JSON arrays under two sets of names."""
    f = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    one = F.create_map(F.lit("gstin"), F.lit("27ABCDE0001F1Z5"), F.lit("vendor"), F.col("vendor"), F.lit("invoiceNumber"), F.col("invoice_id").cast("string"), F.lit("subtotal"), f("subtotal"), F.lit("cgst"), f("cgst"), F.lit("sgst"), f("sgst"), F.lit("igst"), f("igst"))
    two = F.create_map(F.lit("ctin"), F.lit("27ABCDE0001F1Z5"), F.lit("trdnm"), F.col("vendor"), F.lit("inum"), F.col("invoice_id").cast("string"), F.lit("txval"), f("subtotal"), F.lit("camt"), f("cgst"), F.lit("samt"), f("sgst"), F.lit("iamt"), f("igst"))
    payloads = t.invoice.groupBy("client_id", F.expr("invoice_id div 100").alias("block")).agg(F.to_json(F.collect_list(F.when(F.col("invoice_id") % 2 == 0, one).otherwise(two))).alias("payload"))
    out = files.flat_rows(payloads)
    return out.select(F.col("invoice_number").cast("long").alias("invoice_id"), "supplier_name", V.to_paise(F.col("taxable_value")).alias("taxable_p"), V.to_paise(F.col("total_tax")).alias("tax_p"))


@query("SELECT statement_id, sort_order, CASE WHEN description = '' THEN 'Transaction' ELSE description END AS description, {w} AS out_p, {d} AS in_p FROM {bank_txn}".replace("{w}", P("withdrawal")).replace("{d}", P("deposit")))
def s9_bank_json(t: Tables) -> DataFrame:
    """Bank statements as JSON documents, read back as numbered transactions."""
    f = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    txn = F.struct("sort_order", F.col("description"), f("withdrawal").alias("withdrawal"), f("deposit").alias("deposit"))
    docs = t.bank_txn.groupBy("statement_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(txn)).alias("transactions"))).alias("payload"))
    return files.bank_rows(docs).select("statement_id", "sort_order", "description", V.to_paise(F.col("withdrawal")).alias("out_p"), V.to_paise(F.col("deposit")).alias("in_p"))


@query("""
SELECT i.invoice_id, nullif(vendor, '') AS vendor, {g} AS vendor_gstin, {t} AS total_p, coalesce(n, 0) AS n_items, coalesce(qty, 0) AS qty, coalesce(price_p, 0) AS price_p, coalesce(names, 0) AS n_unnamed, CAST(coalesce(invoice_date, TIMESTAMP '1998-06-01') AS DATE) AS day
FROM {invoice} i LEFT JOIN (SELECT invoice_id, count(*) AS n, CAST(sum(CASE WHEN part_key % 3 = 0 THEN 0 ELSE qty END) AS BIGINT) AS qty, CAST(sum(CASE part_key % 3 WHEN 0 THEN 0 WHEN 1 THEN {q} ELSE {p} END) AS BIGINT) AS price_p, count(*) FILTER (WHERE part_key % 5 = 0) AS names FROM {invoice_item} GROUP BY invoice_id) x ON x.invoice_id = i.invoice_id
""".replace("{g}", NORM_GSTIN("vendor_gstin")).replace("{t}", P("total_amount")).replace("{q}", "CAST(floor(qty * rate * 100 + 0.5) AS BIGINT)").replace("{p}", "CAST(floor(abs(price) * 100 + 0.5) AS BIGINT)"))
def s7_extracted_invoices(t: Tables) -> DataFrame:
    """Invoices as extracted JSON, under several names, some items without quantity, price or name; normalised."""
    f = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    k = F.col("part_key") % 3
    item = F.struct(
        "sort_order", F.when((k == 1) & (F.col("part_key") % 5 != 0), F.col("name")).alias("item_name"), F.when((k != 1) & (F.col("part_key") % 5 != 0), F.col("name")).alias("description"),
        F.when(k == 1, f("qty")).alias("qty"), F.when(k == 2, f("qty")).alias("quantity"), f("rate").alias("rate"), F.when(k == 2, F.abs("price").cast("decimal(18,2)").cast("string")).alias("total"), F.col("hsn_code").alias("hsnCode"), F.col("gst_rate").cast("string").alias("gstRate"),
    )
    items = t.invoice_item.groupBy("invoice_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    doc = F.to_json(F.struct("invoice_number", F.date_format("invoice_date", "d/M/yyyy").alias("date"), "vendor", "vendor_gstin", f("total_amount").alias("total_amount"), F.lit("1.00").alias("total"), "items"))
    out = files.invoice_rows(t.invoice.join(items, "invoice_id", "left").select("invoice_id", doc.alias("payload")), as_of())
    total = lambda g: F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + g(x))
    return out.select(
        "invoice_id", "vendor", "vendor_gstin", V.to_paise(F.col("total_amount")).alias("total_p"), F.size("items").cast("long").alias("n_items"), total(lambda x: x.qty.cast("long")).alias("qty"), total(lambda x: V.to_paise(x.price)).alias("price_p"),
        F.size(F.filter("items", lambda x: x["name"] == "Item")).cast("long").alias("n_unnamed"), F.to_date("invoice_date").alias("day"),
    )


@query("SELECT client_id, name, ledger_group, ledger_type, CAST(gst_rate AS BIGINT) AS rate, is_system FROM (SELECT client_id FROM {client} UNION SELECT client_id + 100 FROM {client}), (VALUES " + ", ".join("('" + "', '".join(r[:3]) + f"', {'NULL' if r[3] is None else r[3]}, {r[4]})" for r in files.SEED_LEDGERS) + ") seed(name, ledger_group, ledger_type, gst_rate, is_system) WHERE client_id NOT IN (SELECT client_id FROM {ledger})")
def s10_seed_ledgers(t: Tables) -> DataFrame:
    """The chart of accounts for clients without ledgers."""
    clients = t.client.select("client_id").unionByName(t.client.select((F.col("client_id") + 100).alias("client_id")))  # the second half is new
    return files.seed_ledgers(clients, t.ledger).select("client_id", "name", "ledger_group", "ledger_type", F.col("gst_rate").cast("long").alias("rate"), "is_system")


@query("SELECT voucher_id, voucher_type, status, CASE WHEN avg_confidence >= 0.9 THEN 'high' ELSE 'low' END AS side FROM {voucher} WHERE (avg_confidence < 0.7 OR avg_confidence IS NULL OR avg_confidence >= 0.9) AND status = 'DRAFT' AND voucher_type = 'PURCHASE'")
def f3_low_confidence(t: Tables) -> DataFrame:
    """drafts of low or no confidence, and those of high confidence."""
    some = t.voucher.where("status = 'DRAFT' AND voucher_type = 'PURCHASE'")
    c, columns = F.col("avg_confidence"), ["voucher_id", "voucher_type", "status"]
    return some.where((c < 0.7) | c.isNull()).select(*columns, F.lit("low").alias("side")).unionByName(some.where(c >= 0.9).select(*columns, F.lit("high").alias("side")))


@query("SELECT i.invoice_id, i.client_id FROM {invoice} i LEFT JOIN {voucher} v ON v.invoice_id = i.invoice_id WHERE i.document_type = 'PURCHASE' OR i.document_type IS NULL OR v.voucher_type = 'PURCHASE'")
def f5_purchase_books(t: Tables) -> DataFrame:
    """the purchase books, a disjunction across a join."""
    return reconcile.purchase_books(t.invoice, t.voucher).select("invoice_id", "client_id")


@query("""
SELECT voucher_id, CASE WHEN NOT unmapped AND status = 'DRAFT' THEN 'ready' ELSE 'other' END AS list, unmapped OR coalesce(avg_confidence < 0.7, FALSE) AS is_low
FROM (SELECT v.*, EXISTS (SELECT 1 FROM {voucher_line} l WHERE l.voucher_id = v.voucher_id AND ledger_id IS NULL) AS unmapped FROM {voucher} v)
""")
def f6_transaction_filters(t: Tables) -> DataFrame:
    """Ready and low transactions."""
    return _flagged(t).select("voucher_id", F.when(~F.col("unmapped") & (F.col("status") == "DRAFT"), "ready").otherwise("other").alias("list"), (F.col("unmapped") | F.coalesce(F.col("avg_confidence") < 0.7, F.lit(False))).alias("is_low"))


@query("SELECT client_id, ledger_id, name FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY name, ledger_id) AS n FROM {ledger} WHERE contains(lower(name), 'nova')) WHERE n <= 50")
def f11_ledger_search(t: Tables) -> DataFrame:
    """each client's first 50 ledgers whose name contains a text in any case."""
    from pyspark.sql import Window

    hits = t.ledger.where(F.lower("name").contains("nova"))
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("client_id").orderBy("name", "ledger_id"))).where("n <= 50").select("client_id", "ledger_id", "name")


@query("""
SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'needs_reply' ELSE 'resolved' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM {conversations}) WHERE n = 1
""")
def f13_threads(t: Tables) -> DataFrame:
    """Each conversation's last message and whether it waits for a reply."""
    from pyspark.sql import Window

    last = t.conversations.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))).where("n = 1")
    return last.select("conv_id", "turn", "role", F.when(F.col("role") == "user", "needs_reply").otherwise("resolved").alias("state"))


@query("""
SELECT file_id, CASE WHEN file_id % 7 = 0 THEN 'wrong_type' WHEN bytes > 3000 THEN 'too_large' WHEN n > 15 THEN 'too_many' ELSE 'admitted' END AS verdict
FROM (SELECT *, row_number() OVER (PARTITION BY file_id // 40, file_id % 7 <> 0 AND bytes <= 3000 ORDER BY file_id) AS n FROM {upload})
""")
def f14_upload_admission(t: Tables) -> DataFrame:
    """admitted files and why the others are not."""
    kinds = t.upload.select(F.expr("file_id div 40").alias("batch"), "file_id", "bytes", F.when(F.col("file_id") % 7 == 0, "text/plain").when(F.col("file_id") % 2 == 0, "image/png").otherwise("application/pdf").alias("mime"))
    return documents.admit(kinds, most_bytes=3000).select("file_id", "verdict")


# ---- aggregations and reports ----


@query("""
SELECT client_id, coalesce(n_invoices, 0) AS n_invoices, coalesce(n_drafts, 0) AS n_drafts, coalesce(n_approved, 0) AS n_approved, coalesce(n_exported, 0) AS n_exported, coalesce(n_pending_review, 0) AS n_pending_review, coalesce(input_p, 0) AS input_p, coalesce(output_p, 0) AS output_p,
  coalesce(n_parties_open, 0) AS n_parties_open, coalesce(n_statements, 0) AS n_statements, itc_at_risk_p, matched, mismatched, greatest(0, coalesce(output_p, 0) - coalesce(input_p, 0)) AS gst_liability_p
FROM (SELECT client_id FROM {invoice} UNION SELECT client_id FROM {voucher})
LEFT JOIN (SELECT client_id, count(*) AS n_invoices FROM {invoice} GROUP BY client_id) USING (client_id)
LEFT JOIN (SELECT client_id, count(*) FILTER (WHERE status = 'DRAFT') AS n_drafts, count(*) FILTER (WHERE status = 'APPROVED') AS n_approved, count(*) FILTER (WHERE status IN ('EXPORTED_DEMO', 'POSTED')) AS n_exported,
    count(*) FILTER (WHERE status = 'DRAFT' AND (avg_confidence < 0.7 OR EXISTS (SELECT 1 FROM {voucher_line} l WHERE l.voucher_id = v.voucher_id AND ledger_id IS NULL))) AS n_pending_review FROM {voucher} v GROUP BY client_id) USING (client_id)
LEFT JOIN (SELECT v.client_id, CAST(sum(CASE WHEN voucher_type = 'PURCHASE' THEN tax ELSE 0 END) AS BIGINT) AS input_p, CAST(sum(CASE WHEN voucher_type = 'SALE' THEN tax ELSE 0 END) AS BIGINT) AS output_p
    FROM {voucher} v JOIN (SELECT invoice_id, {x} AS tax FROM {invoice}) USING (invoice_id) GROUP BY v.client_id) USING (client_id)
LEFT JOIN (SELECT client_id, count(*) AS n_parties_open FROM {voucher_line} JOIN (SELECT voucher_id, client_id FROM {voucher} WHERE status = 'DRAFT') USING (voucher_id) WHERE role = 'PARTY' AND ledger_id IS NULL GROUP BY client_id) USING (client_id)
LEFT JOIN (SELECT client_id, count(*) AS n_statements FROM {bank_statement} GROUP BY client_id) USING (client_id)
LEFT JOIN (SELECT client_id, itc_at_risk_p, matched, mismatched FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, upload_id DESC) AS n FROM {gst2b_upload}) WHERE n = 1) USING (client_id)
""".replace("{x}", P("tax_amount")))
def a1_dashboard(t: Tables) -> DataFrame:
    """The headline of each client."""
    return reports.dashboard(_flagged(t), t.invoice, t.voucher_line, t.bank_statement, t.gst2b_upload)


@query("SELECT user_id, count(*) AS n, CAST(sum({t}) AS BIGINT) AS total_p, CAST(sum({x}) AS BIGINT) AS tax_p, count(DISTINCT CASE WHEN vendor <> '' THEN vendor END) AS n_vendors, CAST(floor(sum({t}) / count(*) + 0.5) AS BIGINT) AS mean_p FROM {invoice} GROUP BY user_id".replace("{t}", P("total_amount")).replace("{x}", P("tax_amount")))
def a3_invoice_summary(t: Tables) -> DataFrame:
    """Each user's invoices."""
    return reports.invoice_summary(t.invoice, "user_id")


@query("SELECT client_id, strftime(coalesce(invoice_date, created_at), '%Y-%m') AS month, CAST(sum({t}) AS BIGINT) AS total_p, count(*) AS n FROM {invoice} GROUP BY ALL".replace("{t}", P("total_amount")))
def a4_monthly(t: Tables) -> DataFrame:
    """The months of each client."""
    return reports.monthly(t.invoice)


@query("SELECT user_id, coalesce(nullif(vendor, ''), 'Unknown') AS vendor, count(*) AS n, CAST(sum({t}) AS BIGINT) AS total_p, CAST(sum({x}) AS BIGINT) AS tax_p, CAST(floor(sum({t}) / count(*) + 0.5) AS BIGINT) AS mean_p FROM {invoice} GROUP BY 1, 2".replace("{t}", P("total_amount")).replace("{x}", P("tax_amount")))
def a5_vendor_breakdown(t: Tables) -> DataFrame:
    """A5, O1: each user's vendors by amount."""
    return reports.vendor_breakdown(t.invoice).orderBy("user_id", F.desc("total_p"), "vendor")


@query("""
SELECT statement_id, client_id, count(txn_id) AS n_txns, count(txn_id) FILTER (WHERE ledger_id IS NULL) AS n_unmapped, CAST(coalesce(sum({d}), 0) AS BIGINT) AS in_p, CAST(coalesce(sum({w}), 0) AS BIGINT) AS out_p
FROM {bank_statement} LEFT JOIN {bank_txn} USING (statement_id) GROUP BY statement_id, client_id
""".replace("{d}", P("deposit")).replace("{w}", P("withdrawal")))
def a6_statement_rollup(t: Tables) -> DataFrame:
    """Statements with their sums."""
    return bank.rollup(t.bank_statement, t.bank_txn)


@query("""
SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY owed_p DESC, party) AS place FROM (
SELECT v.client_id, coalesce(nullif(l.ledger_name, ''), nullif(i.vendor, ''), 'Unknown') AS party, CAST(sum(coalesce(nullif(l.credit_p, 0), nullif(v.credit_p, 0), 0)) AS BIGINT) AS owed_p
FROM {voucher} v LEFT JOIN (SELECT * FROM {voucher_line} WHERE role = 'PARTY') l USING (voucher_id) LEFT JOIN {invoice} i ON i.invoice_id = v.invoice_id
WHERE voucher_type IN ('PURCHASE', 'DEBIT_NOTE') GROUP BY 1, 2) QUALIFY place <= 20
""")
def a7_party_outstanding(t: Tables) -> DataFrame:
    """Each client's 20 parties that are owed most."""
    return reports.party_outstanding(t.voucher, t.voucher_line, t.invoice)


@query("""
SELECT client_id, income_p, expense_p, tax_in_p, tax_out_p, tax_in_p AS assets_p, owed_p + tax_out_p AS liabilities_p, income_p - expense_p AS equity_p FROM (
SELECT client_id, CAST(coalesce(sum({s}) FILTER (WHERE NOT b), 0) AS BIGINT) AS income_p, CAST(coalesce(sum({s}) FILTER (WHERE b), 0) AS BIGINT) AS expense_p, CAST(coalesce(sum({x}) FILTER (WHERE b), 0) AS BIGINT) AS tax_in_p,
  CAST(coalesce(sum({x}) FILTER (WHERE NOT b), 0) AS BIGINT) AS tax_out_p, CAST(coalesce(sum(owed) FILTER (WHERE b), 0) AS BIGINT) AS owed_p
FROM (SELECT v.client_id, subtotal, tax_amount, coalesce(nullif(l.credit_p, 0), nullif(v.credit_p, 0), 0) AS owed, voucher_type IN ('PURCHASE', 'DEBIT_NOTE') AS b
  FROM {voucher} v LEFT JOIN {invoice} i ON i.invoice_id = v.invoice_id LEFT JOIN (SELECT voucher_id, credit_p FROM {voucher_line} WHERE role = 'PARTY') l ON l.voucher_id = v.voucher_id WHERE voucher_type IN ('PURCHASE', 'DEBIT_NOTE', 'SALE', 'CREDIT_NOTE')) GROUP BY client_id)
""".replace("{s}", P("subtotal")).replace("{x}", P("tax_amount")))
def a8_profit_and_loss(t: Tables) -> DataFrame:
    """The profit-and-loss and balance sketch of each client, over all vouchers."""
    return reports.profit_and_loss(t.voucher, t.voucher_line, t.invoice)


@query("""
SELECT client_id, count(*) AS n, count(*) FILTER (WHERE mapped_via NOT IN ('MANUAL', 'DEFAULT')) AS n_auto, count(*) FILTER (WHERE mapped_via IS NULL) AS n_none, count(*) FILTER (WHERE mapped_via = 'RULE') AS n_rule,
  count(*) FILTER (WHERE mapped_via = 'GSTIN_MEMORY') AS n_gstin_memory, count(*) FILTER (WHERE mapped_via = 'NAME_MEMORY') AS n_name_memory, count(*) FILTER (WHERE mapped_via = 'NARRATION_MEMORY') AS n_narration_memory,
  count(*) FILTER (WHERE mapped_via = 'FUZZY') AS n_fuzzy, count(*) FILTER (WHERE mapped_via = 'MANUAL') AS n_manual, count(*) FILTER (WHERE mapped_via = 'DEFAULT') AS n_default,
  CAST(floor(count(*) FILTER (WHERE mapped_via NOT IN ('MANUAL', 'DEFAULT')) * 100.0 / count(*) + 0.5) AS BIGINT) AS accuracy
FROM {voucher_line} JOIN {voucher} USING (voucher_id) GROUP BY client_id
""")
def a9_mapping_accuracy(t: Tables) -> DataFrame:
    """How lines were mapped."""
    return reports.mapping_accuracy(t.voucher_line, t.voucher)


@query("""
SELECT client_id, voucher_id, voucher_date, vendor AS party, vendor_gstin AS gstin, invoice_number, {s} AS subtotal_p, {c} AS cgst_p, {g} AS sgst_p, {i} AS igst_p, coalesce(nullif({t}, 0), debit_p) AS total_p
FROM (SELECT v.client_id, v.voucher_id, v.voucher_date, v.debit_p, v.voucher_type, i.vendor, i.vendor_gstin, i.invoice_number, i.subtotal, i.cgst, i.sgst, i.igst, i.total_amount FROM {voucher} v LEFT JOIN {invoice} i USING (invoice_id)) WHERE voucher_type IN ('PURCHASE', 'DEBIT_NOTE')
""".replace("{s}", P("subtotal")).replace("{c}", P("cgst")).replace("{g}", P("sgst")).replace("{i}", P("igst")).replace("{t}", P("total_amount")))
def p2_purchase_register(t: Tables) -> DataFrame:
    """The purchase register."""
    return reports.register(t.voucher, t.invoice, purchases=True)


@query("""
SELECT client_id, voucher_id, voucher_date, coalesce(nullif(customer_name, ''), vendor) AS party, coalesce(nullif(customer_gstin, ''), vendor_gstin) AS gstin, invoice_number, {s} AS subtotal_p, {c} AS cgst_p, {g} AS sgst_p, {i} AS igst_p, coalesce(nullif({t}, 0), debit_p) AS total_p
FROM (SELECT v.client_id, v.voucher_id, v.voucher_date, v.debit_p, v.voucher_type, i.vendor, i.vendor_gstin, i.customer_name, i.customer_gstin, i.invoice_number, i.subtotal, i.cgst, i.sgst, i.igst, i.total_amount FROM {voucher} v LEFT JOIN {invoice} i USING (invoice_id)) WHERE voucher_type IN ('SALE', 'CREDIT_NOTE')
""".replace("{s}", P("subtotal")).replace("{c}", P("cgst")).replace("{g}", P("sgst")).replace("{i}", P("igst")).replace("{t}", P("total_amount")))
def p3_outward_register(t: Tables) -> DataFrame:
    """The outward register."""
    return reports.register(t.voucher, t.invoice, purchases=False)


_FLAGGED = "(SELECT v.*, EXISTS (SELECT 1 FROM {voucher_line} l WHERE l.voucher_id = v.voucher_id AND l.ledger_id IS NULL) AS unmapped FROM {voucher} v)"


@query(f"""
SELECT voucher_id, CASE WHEN is_duplicate THEN 'Duplicate' WHEN status = 'EXPORTED_DEMO' THEN 'Exported XML' WHEN status = 'APPROVED' THEN 'Approved' WHEN status IN ('POSTED', 'SYNCED') THEN 'Synced' WHEN unmapped THEN 'Needs ledger' WHEN avg_confidence < 0.7 THEN 'Low conf.' ELSE 'Ready' END AS chip,
  CASE WHEN unmapped THEN 'unmapped' WHEN coalesce(avg_confidence, 1) < 0.7 THEN 'low' ELSE 'ok' END AS badge
FROM {_FLAGGED} f JOIN (SELECT invoice_id, is_duplicate FROM {{invoice}}) USING (invoice_id)
""")
def p8_status_chips(t: Tables) -> DataFrame:
    """Labels of vouchers."""
    return reports.status_chip(_flagged(t).join(t.invoice.select("invoice_id", "is_duplicate"), "invoice_id")).select("voucher_id", "chip", "badge")


@query("SELECT CASE WHEN ledger_id IS NULL THEN 'Needs ledger' WHEN mapped_via = 'MANUAL' THEN 'Manual' WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.6 THEN 'Review' ELSE 'Low' END AS chip, role, count(*) AS n FROM {voucher_line} GROUP BY ALL")
def p9_line_chips(t: Tables) -> DataFrame:
    """Labels of lines, counted."""
    return reports.line_chip(t.voucher_line).groupBy("chip", "role").agg(F.count("*").alias("n"))


@query(f"""
SELECT voucher_id, client_id, priority, row_number() OVER (PARTITION BY client_id ORDER BY CASE priority WHEN 'critical' THEN 1 WHEN 'low' THEN 2 WHEN 'ready' THEN 3 ELSE 4 END, coalesce(avg_confidence, 1), avg_confidence NULLS LAST, created_at DESC, voucher_id) AS position
FROM (SELECT voucher_id, f.client_id, avg_confidence, created_at, CASE WHEN unmapped OR coalesce(avg_confidence < 0.7, FALSE) OR is_duplicate OR n_flags > 0
  THEN CASE WHEN unmapped OR coalesce(avg_confidence < 0.5, FALSE) THEN 'critical' ELSE 'low' END WHEN avg_confidence >= 0.9 THEN 'high' ELSE 'ready' END AS priority
  FROM {_FLAGGED} f JOIN (SELECT invoice_id, is_duplicate, n_flags FROM {{invoice}}) USING (invoice_id) WHERE status = 'DRAFT')
""")
def v12_review_queue(t: Tables) -> DataFrame:
    """Drafts in review order."""
    out = reports.review_queue(reports.review_priority(t.invoice, _flagged(t)))
    return out.select("voucher_id", "client_id", "priority", F.col("position").cast("long").alias("position"))


@query(f"""
SELECT client_id, stage, count(*) AS n FROM (
SELECT client_id, 'pending' AS stage FROM {{invoice}} WHERE status = 'PENDING' UNION ALL
SELECT client_id, 'processed' FROM {{invoice}} i WHERE status = 'PROCESSED' AND NOT EXISTS (SELECT 1 FROM {{voucher}} v WHERE v.invoice_id = i.invoice_id) UNION ALL
SELECT client_id, CASE WHEN status = 'DRAFT' AND unmapped THEN 'needs_ledger' WHEN status = 'DRAFT' THEN 'mapped' WHEN status = 'APPROVED' THEN 'approved' ELSE 'exported' END FROM {_FLAGGED}) GROUP BY ALL
""")
def v13_pipeline_board(t: Tables) -> DataFrame:
    """Documents by stage."""
    return reports.pipeline_board(t.invoice, _flagged(t))


@query("SELECT client_id, voucher_id, lag(voucher_id) OVER w AS previous_id, lead(voucher_id) OVER w AS next_id FROM {voucher} WHERE status = 'DRAFT' WINDOW w AS (PARTITION BY client_id ORDER BY created_at DESC, voucher_id)")
def w1_neighbours(t: Tables) -> DataFrame:
    """Drafts before and after."""
    return reports.neighbours(t.voucher)


@query("SELECT client_id, max(invoice_id) AS latest_id, count(*) AS n FROM (SELECT client_id, invoice_id, rank() OVER (PARTITION BY client_id ORDER BY created_at DESC) AS r FROM {invoice}) WHERE r = 1 GROUP BY client_id")
def w2_latest(t: Tables) -> DataFrame:
    """Each client's latest document, and how many share its time."""
    newest = t.invoice.groupBy("client_id").agg(F.max("created_at").alias("created_at"))
    return t.invoice.join(newest, ["client_id", "created_at"]).groupBy("client_id").agg(F.max("invoice_id").alias("latest_id"), F.count("*").alias("n"))


@query("SELECT user_id, client_id, name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_default DESC, client_id) AS n FROM {client}) WHERE n = 1")
def w10_default_client(t: Tables) -> DataFrame:
    """The default client of each user."""
    best = t.client.groupBy("user_id").agg(F.min_by(F.struct("client_id", "name"), F.struct(~F.col("is_default"), F.col("client_id"))).alias("c"))
    return best.select("user_id", "c.client_id", "c.name")


@query("SELECT user_id, client_id, row_number() OVER (PARTITION BY user_id ORDER BY is_default DESC, name, client_id) AS position FROM {client}")
def o6_client_order(t: Tables) -> DataFrame:
    """Each user's clients, the default ones first, then by name."""
    return positions(t.client.select("user_id", "client_id", "name", "is_default"), "user_id", [F.desc("is_default"), F.col("name"), F.col("client_id")]).select("user_id", "client_id", "position")


@query("SELECT client_id, ledger_id, row_number() OVER (PARTITION BY client_id ORDER BY CASE ledger_group WHEN 'SUNDRY_CREDITORS' THEN 1 WHEN 'SUNDRY_DEBTORS' THEN 2 WHEN 'DUTIES_AND_TAXES' THEN 3 WHEN 'PURCHASE_ACCOUNTS' THEN 4 ELSE 5 END, name, ledger_id) AS position FROM {ledger}")
def o2_ledger_order(t: Tables) -> DataFrame:
    """O2: ledgers in the order of their groups' declaration, then name."""
    place = F.array_position(F.array(*map(F.lit, export.GROUP_NAMES)), F.col("ledger_group"))
    rows = t.ledger.select("client_id", "ledger_id", "name", place.alias("place"))
    return positions(rows, "client_id", [F.col("place"), F.col("name"), F.col("ledger_id")]).select("client_id", "ledger_id", "position")


@query("SELECT voucher_id, client_id, status FROM {voucher} WHERE status = 'DRAFT' QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, voucher_id) <= 20")
def l1_top_20(t: Tables) -> DataFrame:
    """L1, L2: each client's newest 20 drafts."""
    w = Window.partitionBy("client_id").orderBy(F.desc("created_at"), "voucher_id")
    return t.voucher.where("status = 'DRAFT'").withColumn("_n", F.row_number().over(w)).where("_n <= 20").select("voucher_id", "client_id", "status")


# ---- functions ----


@query(f"SELECT DISTINCT vendor, {NORM_NAME('vendor')} AS name_key, vendor_gstin, {NORM_GSTIN('vendor_gstin')} AS gstin_key, coalesce(trim(regexp_replace(lower(vendor), '\\s+', ' ', 'g')), '') AS keyword, {SQUEEZE('invoice_number')} AS number_key FROM {{invoice}}")
def c1_name_keys(t: Tables) -> DataFrame:
    """Normalised names, registrations, keywords and numbers."""
    c = F.col
    return t.invoice.select("vendor", T.norm_name(c("vendor")).alias("name_key"), "vendor_gstin", T.norm_gstin(c("vendor_gstin")).alias("gstin_key"), T.norm_keyword(c("vendor")).alias("keyword"), T.squeeze_upper(c("invoice_number")).alias("number_key")).distinct()


@query("SELECT txn_id, " + NARRATION.replace("{0}", "description") + " AS key FROM {bank_txn}")
def c6_narration_keys(t: Tables) -> DataFrame:
    """Narration keys."""
    return t.bank_txn.select("txn_id", T.narration_key(F.col("description")).alias("key"))


_DICE = """CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0.0::DOUBLE WHEN a = b THEN 1.0 WHEN length(a) < 2 OR length(b) < 2 THEN 0.0
  ELSE 2.0::DOUBLE * (SELECT coalesce(sum(least(x.n, y.n)), 0) FROM (SELECT g, count(*) AS n FROM (SELECT unnest([a[i:i + 1] for i in range(1, length(a))]) AS g) GROUP BY g) x JOIN (SELECT g, count(*) AS n FROM (SELECT unnest([b[i:i + 1] for i in range(1, length(b))]) AS g) GROUP BY g) y USING (g))::DOUBLE / (length(a) + length(b) - 2) END"""


@query(f"SELECT a, b, CAST(floor(1000000 * ({_DICE}) + 0.5) AS BIGINT) AS millionths FROM (SELECT DISTINCT client_id, {NORM_NAME('name')} AS a FROM {{ledger}}) x JOIN (SELECT DISTINCT client_id, match_key AS b FROM {{memory}} WHERE match_type = 'VENDOR_NAME') y USING (client_id) WHERE ({_DICE}) >= 0.72")
def c7_dice(t: Tables) -> DataFrame:
    """Ledger names and remembered names of a client that are alike, with their similarity."""
    a = t.ledger.select("client_id", T.norm_name(F.col("name")).alias("a"))
    b = t.memory.where("match_type = 'VENDOR_NAME'").select("client_id", F.col("match_key").alias("b"))
    return dice_join(a, b, "a", "b", ["client_id"], 0.72).select("a", "b", F.floor(F.lit(1000000) * F.col("score") + F.lit(0.5)).cast("long").alias("millionths"))


@query(f"SELECT invoice_id, {VALID('g')} AS valid, substring(g, 1, 2) AS state, CASE WHEN length(g) = 15 THEN substring(g, 3, 10) END AS pan, s.name AS state_name FROM (SELECT invoice_id, upper(trim(coalesce(vendor_gstin, ''))) AS g FROM {{invoice}}) LEFT JOIN (VALUES {', '.join(repr(x) for x in T.STATES.items())}) s(code, name) ON s.code = substring(g, 1, 2)")
def c9_gstin(t: Tables) -> DataFrame:
    """Registrations and their states."""
    g = F.upper(F.trim(F.coalesce("vendor_gstin", F.lit(""))))
    return t.invoice.select("invoice_id", T.gstin_valid(g).alias("valid"), T.state_code(g).alias("state"), T.pan_of(g).alias("pan"), T.state_name(T.state_code(g)).alias("state_name"))


@query("""
SELECT event_id, CAST(floor(coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(raw, '[^0-9.-]+', '', 'g'), '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)'), '') AS DOUBLE), 0) * 100 + 0.5) AS BIGINT) AS paise
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Rs ' || CAST(event_id AS VARCHAR) || ',5.25' WHEN 1 THEN '-' || CAST(event_id AS VARCHAR) || '.505' WHEN 2 THEN 'abc' WHEN 3 THEN NULL ELSE '1-' || CAST(event_id AS VARCHAR) END AS raw FROM {events})
""")
def c20_money(t: Tables) -> DataFrame:
    """Dirty amounts as paise."""
    e = F.col("event_id").cast("string")
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("Rs "), e, F.lit(",5.25"))).when(k == 1, F.concat(F.lit("-"), e, F.lit(".505"))).when(k == 2, "abc").when(k == 4, F.concat(F.lit("1-"), e))
    return t.events.select("event_id", V.to_paise(V.clean_money(raw)).alias("paise"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN make_date(2024, 1 + CAST(event_id % 12 AS INT), 1 + CAST(event_id % 28 AS INT)) WHEN 1 THEN make_date(2000 + CAST(event_id % 100 AS INT), 3, 5) WHEN 2 THEN DATE '2024-02-09' ELSE NULL END AS day FROM {events}
""")
def c31_dates(t: Tables) -> DataFrame:
    """d/m/y text with two- and four-digit years, ISO text and days that do not exist."""
    e, k = F.col("event_id"), F.col("event_id") % 4
    raw = (
        F.when(k == 0, F.concat_ws("/", (1 + e % 28).cast("string"), (1 + e % 12).cast("string"), F.lit("2024")))
        .when(k == 1, F.concat(F.lit("5-3-"), F.lpad((e % 100).cast("string"), 2, "0"))).when(k == 2, "2024-02-09").otherwise("31/02/2024")
    )
    return t.events.select("event_id", V.parse_date(raw).alias("day"))


# ---- the suite of checks, duplicates, anomalies ----

_CHECKS = """
WITH b AS (SELECT *, upper(trim(coalesce(vendor_gstin, ''))) AS v, upper(trim(coalesce(customer_gstin, ''))) AS c, cgst + sgst + igst AS taxes, subtotal - discount + (cgst + sgst + igst) AS expected FROM {invoice}),
h AS (SELECT *, CASE WHEN v <> '' AND c <> '' THEN substring(v, 1, 2) <> substring(c, 1, 2) END AS inter FROM b),
items AS (SELECT invoice_id, count(*) AS n, count(*) FILTER (WHERE coalesce(trim(hsn_code), '') = '') AS bare, count(*) FILTER (WHERE coalesce(trim(hsn_code), '') <> '' AND NOT regexp_full_match(regexp_replace(hsn_code, '\\s', '', 'g'), '[0-9]{{4,8}}')) AS odd_hsn,
  count(*) FILTER (WHERE qty > 0 AND rate > 0 AND price > 0 AND abs(qty * rate - price) > greatest(2, price * 0.02::DOUBLE)) AS off, count(*) FILTER (WHERE gst_rate NOT IN (0, 0.25, 3, 5, 12, 18, 28)) AS odd_rate FROM {invoice_item} GROUP BY invoice_id),
j AS (SELECT h.*, coalesce(n, 0) AS n, coalesce(bare, 0) AS bare, coalesce(odd_hsn, 0) AS odd_hsn, coalesce(off, 0) AS off, coalesce(odd_rate, 0) AS odd_rate FROM h LEFT JOIN items USING (invoice_id)),
codes AS (SELECT invoice_id, unnest(list_filter([
  CASE WHEN v = '' THEN 'VENDOR_GSTIN_MISSING' END, CASE WHEN v <> '' AND NOT {valid_v} THEN 'VENDOR_GSTIN_INVALID' END, CASE WHEN c <> '' AND NOT {valid_c} THEN 'CUSTOMER_GSTIN_INVALID' END,
  CASE WHEN v <> '' AND v = c THEN 'SAME_PARTY_GSTIN' END, CASE WHEN length(v) = 15 AND NOT regexp_full_match(substring(v, 3, 10), '[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN 'VENDOR_PAN_IN_GSTIN' END,
  CASE WHEN inter AND igst <= 0 AND (cgst > 0 OR sgst > 0) THEN 'TAX_TYPE_INTERSTATE' END, CASE WHEN inter AND (cgst > 0 OR sgst > 0) THEN 'CGST_SGST_ON_INTERSTATE' END,
  CASE WHEN NOT inter AND igst > 0 THEN 'IGST_ON_INTRASTATE' END, CASE WHEN NOT inter AND abs(cgst - sgst) > 1 THEN 'CGST_SGST_IMBALANCE' END, CASE WHEN abs(tax_amount - taxes) > 1 THEN 'TAX_MATH_MISMATCH' END,
  CASE WHEN subtotal > 0 AND abs(total_amount - expected) > 2 THEN 'TOTAL_MATH_MISMATCH' END, CASE WHEN total_amount < 0 THEN 'NEGATIVE_TOTAL' END, CASE WHEN subtotal > 0 AND discount > subtotal THEN 'DISCOUNT_EXCEEDS_SUBTOTAL' END,
  CASE WHEN trim(coalesce(invoice_number, '')) = '' THEN 'INVOICE_NUMBER_MISSING' END, CASE WHEN invoice_date IS NULL THEN 'INVOICE_DATE_MISSING' END, CASE WHEN invoice_date > TIMESTAMP '1998-06-02 00:00:00' THEN 'INVOICE_DATE_FUTURE' END,
  CASE WHEN n > 0 AND bare = n THEN 'HSN_MISSING' END, CASE WHEN bare > 0 AND bare < n THEN 'HSN_PARTIAL' END, CASE WHEN odd_rate > 0 THEN 'UNUSUAL_GST_RATE' END, CASE WHEN n = 0 THEN 'NO_LINE_ITEMS' END, CASE WHEN reverse_charge THEN 'REVERSE_CHARGE' END,
  CASE WHEN total_amount >= 50000000 AND coalesce(irn, '') = '' THEN 'EINVOICE_THRESHOLD' END, CASE WHEN coalesce(eway_bill_no, '') <> '' AND NOT regexp_full_match(eway_bill_no, '[0-9]{{12}}') THEN 'EWAY_FORMAT' END,
  CASE WHEN coalesce(document_type, '') = '' THEN 'DOC_TYPE_UNKNOWN' END, CASE WHEN cgst = 0 AND sgst = 0 AND igst = 0 AND total_amount > 0 AND subtotal > 0 THEN 'ZERO_TAX_ON_TAXABLE' END], lambda x: x IS NOT NULL)) AS code FROM j
  UNION ALL SELECT invoice_id, 'HSN_FORMAT' FROM j, range(odd_hsn) UNION ALL SELECT invoice_id, 'LINE_MATH' FROM j, range(off))
""".replace("{{", "{").replace("}}", "}").replace("{valid_v}", VALID("v")).replace("{valid_c}", VALID("c"))  # fmt: skip


def _validated(t: Tables) -> DataFrame:
    return validate.validate(validate.with_items(t.invoice, t.invoice_item), as_of())


@query(_CHECKS + "SELECT code, count(*) AS n, count(DISTINCT invoice_id) AS n_invoices FROM codes GROUP BY code")
def v1_validation_codes(t: Tables) -> DataFrame:
    """How often each check fires."""
    return validate.codes_of(_validated(t), "invoice_id").groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("invoice_id").alias("n_invoices"))


@query(_CHECKS + "SELECT j.invoice_id, count(code) FILTER (WHERE code IN ('VENDOR_GSTIN_INVALID', 'CUSTOMER_GSTIN_INVALID', 'VENDOR_PAN_IN_GSTIN', 'TAX_TYPE_INTERSTATE', 'IGST_ON_INTRASTATE', 'NEGATIVE_TOTAL', 'DISCOUNT_EXCEEDS_SUBTOTAL')) = 0 AS is_valid, count(code) AS n_issues, any_value(inter) AS interstate, CAST(22 AS INT) AS check_count FROM j LEFT JOIN codes USING (invoice_id) GROUP BY j.invoice_id")
def v1_validation_result(t: Tables) -> DataFrame:
    """V1: each invoice's verdict."""
    return _validated(t).select("invoice_id", "is_valid", F.size("issues").cast("long").alias("n_issues"), "interstate", "check_count")


@query(f"""
WITH k AS (SELECT client_id, invoice_id, created_at, {SQUEEZE('invoice_number')} AS number, CASE WHEN {SQUEEZE('vendor_gstin')} <> '' THEN {SQUEEZE('vendor_gstin')} ELSE {SQUEEZE('vendor')} END AS who, {P('total_amount')} AS p FROM {{sent}})
SELECT client_id, invoice_id, number || '|' || who || '|' || CAST(p AS VARCHAR) AS duplicate_key, first AS duplicate_of, nth FROM (SELECT *, first_value(invoice_id) OVER w AS first, row_number() OVER w AS nth FROM k WHERE number <> '' WINDOW w AS (PARTITION BY client_id, number, who, p ORDER BY created_at, invoice_id)) WHERE nth > 1
""")
def v2_duplicates(t: Tables) -> DataFrame:
    """Invoices, some sent again with a noised number, that an earlier one duplicates."""
    c = F.col
    keyed = t.sent.withColumn("duplicate_key", validate.duplicate_key(c("invoice_number"), c("vendor_gstin"), c("vendor"), c("total_amount")))
    return reports.duplicates(keyed).select("client_id", "invoice_id", "duplicate_key", "duplicate_of", c("nth").cast("long").alias("nth"))


@query(f"""
SELECT client_id, vendor, invoice_id, n, CAST(floor(1000 * z + 0.5) AS BIGINT) AS z_thousandths, abs(z) >= 2.5 AS is_anomaly FROM (
SELECT *, CASE WHEN n * ss > s * s THEN CAST(n * p - s AS DOUBLE) / sqrt(CAST(n * ss - s * s AS DOUBLE)) ELSE CAST(n * p - s AS DOUBLE) / n / 100.0::DOUBLE END AS z FROM (
SELECT client_id, vendor, invoice_id, p, CAST(count(*) OVER w AS HUGEINT) AS n, CAST(sum(p) OVER w AS HUGEINT) AS s, CAST(sum(CAST(p AS HUGEINT) * p) OVER w AS HUGEINT) AS ss FROM (SELECT *, {P('total_amount')} AS p FROM {{invoice}} WHERE vendor <> '') WINDOW w AS (PARTITION BY client_id, vendor ORDER BY created_at, invoice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= 3)
""".replace("invoice_id, n, CAST", "invoice_id, CAST(n AS BIGINT) AS n, CAST", 1))
def v8_anomalies(t: Tables) -> DataFrame:
    """Totals far from the vendor's history."""
    return reports.anomalies(t.invoice).select("client_id", "vendor", "invoice_id", "n", F.floor(F.lit(1000) * F.col("z") + F.lit(0.5)).cast("long").alias("z_thousandths"), "is_anomaly")


# ---- ledgers ----

_MEMORY = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, match_type, match_key ORDER BY hit_count DESC, ledger_id DESC) AS n FROM {memory}) WHERE n = 1)"
_CANDIDATES = f"""(SELECT client_id, ledger_id, match_key AS norm, hit_count, 0 AS k, match_key AS m FROM {{memory}} WHERE match_type = 'VENDOR_NAME'
  UNION ALL SELECT client_id, ledger_id, {NORM_NAME('name')}, 0, 1, name FROM {{ledger}} WHERE ledger_type = 'PARTY')"""


@query(f"""
WITH p AS (SELECT DISTINCT client_id, {NORM_GSTIN('vendor_gstin')} AS g, {NORM_NAME('vendor')} AS name FROM {{invoice}}),
r AS (SELECT client_id, rule_id, rule_type, priority, ledger_id, CASE rule_type WHEN 'GSTIN_EQUALS' THEN {NORM_GSTIN('pattern')} WHEN 'VENDOR_NAME_EQUALS' THEN {NORM_NAME('pattern')} ELSE trim(regexp_replace(lower(pattern), '\\s+', ' ', 'g')) END AS norm FROM {{mapping_rule}} WHERE enabled AND rule_type <> 'HSN_EQUALS'),
ruled AS (SELECT * FROM (SELECT p.*, r.ledger_id, CASE rule_type WHEN 'GSTIN_EQUALS' THEN 1.0 WHEN 'VENDOR_NAME_EQUALS' THEN 0.98 ELSE 0.95 END AS conf, row_number() OVER (PARTITION BY p.client_id, g, name ORDER BY priority, rule_id) AS n FROM p JOIN r ON p.client_id = r.client_id AND r.norm <> ''
  AND ((rule_type = 'GSTIN_EQUALS' AND norm = g) OR (rule_type = 'VENDOR_NAME_EQUALS' AND norm = name) OR (rule_type = 'VENDOR_NAME_CONTAINS' AND contains(name, norm)))) WHERE n = 1),
f AS (SELECT p.*, ruled.ledger_id AS l1, ruled.conf, a.ledger_id AS l2, b.ledger_id AS l3 FROM p LEFT JOIN ruled ON ruled.client_id = p.client_id AND ruled.g IS NOT DISTINCT FROM p.g AND ruled.name IS NOT DISTINCT FROM p.name
  LEFT JOIN {_MEMORY} a ON a.client_id = p.client_id AND a.match_type = 'GSTIN' AND a.match_key = p.g LEFT JOIN {_MEMORY} b ON b.client_id = p.client_id AND b.match_type = 'VENDOR_NAME' AND b.match_key = p.name),
o AS (SELECT DISTINCT client_id, name FROM f WHERE l1 IS NULL AND l2 IS NULL AND l3 IS NULL AND name IS NOT NULL),
pairs AS (SELECT DISTINCT o.name AS a, c.norm AS b FROM o JOIN {_CANDIDATES} c ON c.client_id = o.client_id WHERE c.norm IS NOT NULL),
scores AS (SELECT a, b, {_DICE} AS score FROM pairs),
near AS (SELECT * FROM (SELECT o.client_id, o.name, c.ledger_id, score, row_number() OVER (PARTITION BY o.client_id, o.name ORDER BY score DESC, hit_count DESC, k, ledger_id, m) AS n FROM o JOIN {_CANDIDATES} c ON c.client_id = o.client_id JOIN scores s ON s.a = o.name AND s.b = c.norm WHERE score >= 0.72) WHERE n = 1)
SELECT f.client_id, f.g AS gstin_key, f.name AS name_key, coalesce(l1, l2, l3, near.ledger_id) AS ledger_id,
  CAST(floor(10000 * CASE WHEN l1 IS NOT NULL THEN conf::DOUBLE WHEN l2 IS NOT NULL THEN 0.92::DOUBLE WHEN l3 IS NOT NULL THEN 0.85::DOUBLE WHEN score >= 0.86 THEN 0.6::DOUBLE + 0.3::DOUBLE * score WHEN score IS NOT NULL THEN 0.4::DOUBLE + 0.2::DOUBLE * (score - 0.72::DOUBLE) / 0.14::DOUBLE END + 0.5) AS BIGINT) AS confidence,
  CASE WHEN l1 IS NOT NULL THEN 'RULE' WHEN l2 IS NOT NULL THEN 'GSTIN_MEMORY' WHEN l3 IS NOT NULL THEN 'NAME_MEMORY' WHEN score IS NOT NULL THEN 'FUZZY' END AS via
FROM f LEFT JOIN near ON near.client_id = f.client_id AND near.name = f.name
""")
def v4_party_resolution(t: Tables) -> DataFrame:
    """The ledger of each distinct party."""
    c = F.col
    out = ledgers.resolve_parties(ledgers.party_keys(t.invoice), t.mapping_rule, t.memory, t.ledger)
    return out.select("client_id", "gstin_key", "name_key", "ledger_id", F.floor(F.lit(10000) * c("confidence") + F.lit(0.5)).cast("long").alias("confidence"), "via")


@query(f"""
WITH p AS (SELECT DISTINCT client_id, {NORM_NAME('vendor')} AS name FROM {{invoice}} WHERE {NORM_NAME('vendor')} IS NOT NULL), c AS (SELECT * FROM {_CANDIDATES} WHERE norm IS NOT NULL),
pairs AS (SELECT DISTINCT name AS a, norm AS b FROM p JOIN c USING (client_id) WHERE name <> norm),
words AS (SELECT *, list_filter(string_split(a, ' '), lambda x: x <> '') AS x, list_filter(string_split(b, ' '), lambda x: x <> '') AS y FROM pairs),
scores AS (SELECT a, b, greatest({_DICE}, CASE WHEN x[1] = y[1] AND CASE WHEN len(x) <= len(y) THEN list_has_all(y, x) ELSE list_has_all(x, y) END THEN 0.75 ELSE 0 END) AS score FROM words)
SELECT client_id, name AS name_key, ledger_id, CAST(floor(10000 * score + 0.5) AS BIGINT) AS score FROM (SELECT client_id, name, ledger_id, score, row_number() OVER (PARTITION BY client_id, name ORDER BY score DESC, k, ledger_id, m) AS n FROM p JOIN c USING (client_id) JOIN scores ON a = name AND b = norm WHERE score >= 0.7) WHERE n = 1
""")
def v4b_party_suggestion(t: Tables) -> DataFrame:
    """Lenient suggestions."""
    names = stored(ledgers.party_keys(t.invoice).select("client_id", "name_key").distinct(), "names").where("name_key IS NOT NULL")
    out = ledgers.suggest_parties(names, ledgers.candidates_of(t.memory, t.ledger))
    return out.select("client_id", "name_key", "ledger_id", F.floor(F.lit(10000) * F.col("score") + F.lit(0.5)).cast("long").alias("score"))


@query("""
SELECT client_id, hsn_code, gst_rate, CASE WHEN r.ledger_id IS NOT NULL THEN 'RULE' WHEN coalesce(rate.ledger_id, d.ledger_id) IS NOT NULL THEN 'DEFAULT' END AS item_via, coalesce(r.ledger_id, rate.ledger_id, d.ledger_id) AS item_ledger,
  CASE WHEN r.ledger_id IS NOT NULL THEN 100 WHEN rate.ledger_id IS NOT NULL THEN 60 WHEN d.ledger_id IS NOT NULL THEN 50 END::BIGINT AS item_percent
FROM (SELECT DISTINCT client_id, hsn_code, gst_rate FROM {invoice_item} JOIN (SELECT invoice_id, client_id FROM {invoice}) USING (invoice_id)) i
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, pattern ORDER BY priority, rule_id) AS n FROM (SELECT client_id, rule_id, priority, ledger_id, regexp_replace(pattern, '\\s+', '', 'g') AS pattern FROM {mapping_rule} WHERE enabled AND rule_type = 'HSN_EQUALS')) WHERE n = 1) r ON r.client_id = i.client_id AND r.pattern = regexp_replace(i.hsn_code, '\\s+', '', 'g')
LEFT JOIN (SELECT client_id AS rc, gst_rate AS rr, max(ledger_id) AS ledger_id FROM {ledger} WHERE ledger_type = 'PURCHASE' AND gst_rate IS NOT NULL GROUP BY ALL) rate ON rc = i.client_id AND rr = i.gst_rate
LEFT JOIN (SELECT client_id AS dc, ledger_id FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY (gst_rate IS NULL) DESC, ledger_id) AS n FROM {ledger} WHERE ledger_type = 'PURCHASE') WHERE n = 1) d ON dc = i.client_id
""".replace("SELECT client_id, hsn_code", "SELECT i.client_id, hsn_code", 1))
def v4c_item_ledgers(t: Tables) -> DataFrame:
    """The ledger of each distinct goods code and rate."""
    items = t.invoice_item.join(t.invoice.select("invoice_id", "client_id"), "invoice_id").select("client_id", "hsn_code", "gst_rate").distinct()
    out = ledgers.resolve_items(items, t.mapping_rule, t.ledger)
    return out.select("client_id", "hsn_code", "gst_rate", "item_via", "item_ledger", F.round(F.col("item_confidence") * 100).cast("long").alias("item_percent"))


@query(f"""
WITH e AS (SELECT client_id, 'GSTIN' AS match_type, {NORM_GSTIN('vendor_gstin')} AS match_key, ledger_id, 1 AS hits, event_seq AS seq FROM {{approval}} UNION ALL SELECT client_id, 'VENDOR_NAME', {NORM_NAME('vendor')}, ledger_id, 1, event_seq FROM {{approval}}
UNION ALL SELECT client_id, match_type, match_key, ledger_id, hit_count, -1 FROM {{memory}})
SELECT client_id, match_type, match_key, CAST(sum(hits) AS BIGINT) AS hit_count, max_by(ledger_id, seq * 1000000000 + hits * 10000000 + ledger_id) AS ledger_id FROM e WHERE match_key <> '' GROUP BY ALL
""")
def m4_learned_memory(t: Tables) -> DataFrame:
    """The memory after the approvals."""
    c = F.col
    by = lambda kind, key: t.approval.select("client_id", F.lit(kind).alias("match_type"), key.alias("match_key"), "ledger_id", c("event_seq").alias("at"))
    return ledgers.learned(t.memory, by("GSTIN", T.norm_gstin(c("vendor_gstin"))).unionByName(by("VENDOR_NAME", T.norm_name(c("vendor")))))


@query(f"""
SELECT rule_id, count(invoice_id) AS n FROM (SELECT rule_id, client_id, rule_type, CASE rule_type WHEN 'GSTIN_EQUALS' THEN {NORM_GSTIN('pattern')} WHEN 'VENDOR_NAME_EQUALS' THEN {NORM_NAME('pattern')} WHEN 'VENDOR_NAME_CONTAINS' THEN trim(regexp_replace(lower(pattern), '\\s+', ' ', 'g')) ELSE regexp_replace(pattern, '\\s+', '', 'g') END AS norm FROM {{mapping_rule}}) r
LEFT JOIN (SELECT client_id AS c, invoice_id, {NORM_GSTIN('vendor_gstin')} AS g, {NORM_NAME('vendor')} AS name, (SELECT list(DISTINCT regexp_replace(hsn_code, '\\s+', '', 'g')) FROM {{invoice_item}} x WHERE x.invoice_id = i.invoice_id) AS codes FROM {{invoice}} i)
ON c = client_id AND CASE rule_type WHEN 'GSTIN_EQUALS' THEN g = norm WHEN 'VENDOR_NAME_EQUALS' THEN name = norm WHEN 'VENDOR_NAME_CONTAINS' THEN contains(name, norm) ELSE list_contains(codes, norm) END GROUP BY rule_id
""")
def v14_rule_preview(t: Tables) -> DataFrame:
    """How many invoices each rule would reach, all of them counted: equal keys join directly, names are counted once a distinct name."""
    rules = t.mapping_rule.select("rule_id", "client_id", "rule_type", T.norm_pattern(F.col("rule_type"), F.col("pattern")).alias("norm"))
    rules = stored(rules, "rules").where("norm <> ''")
    of = lambda kind: rules.where(F.col("rule_type") == kind).drop("rule_type")
    counted = lambda key: t.invoice.select("client_id", key.alias("norm")).where("norm IS NOT NULL").groupBy("client_id", "norm").agg(F.count("*").alias("n"))
    names = stored(counted(T.norm_name(F.col("vendor"))), "names")
    codes = t.invoice_item.select("invoice_id", F.regexp_replace("hsn_code", r"\s+", "").alias("norm")).where("norm <> ''").distinct().join(t.invoice.select("invoice_id", "client_id"), "invoice_id").groupBy("client_id", "norm").agg(F.count("*").alias("n"))
    contains = of("VENDOR_NAME_CONTAINS").withColumnRenamed("norm", "part")
    inside = contains_join(names, contains, "norm", "part", ["client_id"]).join(names, ["client_id", "norm"]).groupBy("client_id", "part").agg(F.sum("n").alias("n"))
    equal = [of(kind).join(x, ["client_id", "norm"]).select("rule_id", "n") for kind, x in (("GSTIN_EQUALS", counted(T.norm_gstin(F.col("vendor_gstin")))), ("VENDOR_NAME_EQUALS", names), ("HSN_EQUALS", codes))]
    met = reduce(DataFrame.unionByName, [*equal, contains.join(inside, ["client_id", "part"]).select("rule_id", "n")])
    return t.mapping_rule.select("rule_id").join(met, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"))


# ---- vouchers ----


def _built(t: Tables) -> DataFrame:
    ledger_of = F.when(F.col("part_key") % 19 != 0, F.col("part_key") % 40).cast("long")
    item = F.struct("sort_order", "price", ledger_of.alias("ledger_id"), F.when(F.col("part_key") % 19 != 0, F.lit(0.5)).alias("confidence"), F.lit("DEFAULT").alias("mapped_via"), "hsn_code", "gst_rate")
    items = t.invoice_item.groupBy("invoice_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("sort_order")).cast(vouchers.ITEM).alias("items"))
    ledger = lambda k, name: F.lit(k).cast("long").alias(name)
    mapped = F.col("invoice_id") % 12 != 0
    rows = t.invoice.join(items, "invoice_id", "left").withColumns({"party_ledger": F.when(mapped, 100 + F.col("invoice_id") % 50), "party_confidence": F.when(mapped, F.lit(0.85)), "party_via": F.when(mapped, F.lit("NAME_MEMORY"))})
    return vouchers.build_vouchers(rows.select("*", ledger(901, "cgst_ledger"), ledger(902, "sgst_ledger"), ledger(903, "igst_ledger"), ledger(904, "round_off_ledger"), ledger(905, "discount_ledger")))


@query(f"""
WITH h AS (SELECT *, CASE document_type WHEN 'SALES' THEN 'SALE' WHEN 'CREDIT_NOTE' THEN 'CREDIT_NOTE' WHEN 'DN' THEN 'DEBIT_NOTE' ELSE 'PURCHASE' END AS kind FROM {{invoice}}),
e AS (SELECT invoice_id, count(*) AS n, sum(greatest(0, {P('price')})) AS p, count(*) FILTER (WHERE {P('price')} > 0) AS lines, count(*) FILTER (WHERE {P('price')} > 0 AND part_key % 19 <> 0) AS sure, bool_or(part_key % 19 = 0) AS open FROM {{invoice_item}} GROUP BY invoice_id),
x AS (SELECT h.*, kind IN ('PURCHASE', 'CREDIT_NOTE', 'PAYMENT') AS buys, n IS NULL AS bare, CASE WHEN n IS NULL THEN greatest(0, {P('subtotal - discount')}) ELSE p END AS items_p, CASE WHEN n IS NULL THEN ({P('subtotal - discount')} > 0)::INT ELSE lines END AS item_lines,
  coalesce(open, TRUE) AS open, coalesce(sure, 0) AS sure_items, greatest(0, {P('discount')}) AS d, CASE WHEN {P('igst')} > 0 THEN {P('igst')} ELSE greatest(0, {P('cgst')}) + greatest(0, {P('sgst')}) END AS t, CASE WHEN {P('igst')} > 0 THEN 1 ELSE ({P('cgst')} > 0)::INT + ({P('sgst')} > 0)::INT END AS tax_lines, greatest(0, {P('total_amount')}) AS party FROM h LEFT JOIN e USING (invoice_id)),
y AS (SELECT *, (party > 0 AND invoice_id % 12 <> 0)::INT AS sure_party, (items_p + t - d - party) * CASE WHEN buys THEN 1 ELSE -1 END AS off FROM x)
SELECT invoice_id, kind AS voucher_type, CAST(off AS BIGINT) AS round_off_p, CAST(CASE WHEN buys THEN items_p + t ELSE d + party END + greatest(0, -off) AS BIGINT) AS total_debit_p, CAST(CASE WHEN buys THEN d + party ELSE items_p + t END + greatest(0, off) AS BIGINT) AS total_credit_p,
  CAST(item_lines + tax_lines + (d > 0)::INT + (party > 0)::INT + (off <> 0)::INT AS BIGINT) AS n_lines, invoice_id % 12 = 0 OR open AS has_unmapped, CAST((abs(off) > 100)::INT + ({P('igst')} > 0 AND ({P('cgst')} > 0 OR {P('sgst')} > 0))::INT AS BIGINT) AS n_warnings,
  CASE WHEN sure_items + sure_party > 0 THEN CAST(floor(1000 * (sure_items * 0.5::DOUBLE + sure_party * 0.85::DOUBLE) / (sure_items + sure_party) + 0.5) AS BIGINT) END AS sure FROM y
""")
def v5_voucher_builder(t: Tables) -> DataFrame:
    """Balanced vouchers from all invoices."""
    return _built(t).select("invoice_id", "voucher_type", "round_off_p", "total_debit_p", "total_credit_p", F.size("lines").cast("long").alias("n_lines"), "has_unmapped", F.size("warnings").cast("long").alias("n_warnings"), F.floor(F.lit(1000) * F.col("avg_confidence") + F.lit(0.5)).cast("long").alias("sure"))


@query(f"""
SELECT invoice_id, role, count(*) AS n, CAST(sum(p) AS BIGINT) AS p FROM (
SELECT invoice_id, 'ITEM' AS role, {P('price')} AS p FROM {{invoice_item}} UNION ALL SELECT invoice_id, 'ITEM', {P('subtotal - discount')} FROM {{invoice}} i WHERE NOT EXISTS (SELECT 1 FROM {{invoice_item}} x WHERE x.invoice_id = i.invoice_id)
UNION ALL SELECT invoice_id, 'DISCOUNT', {P('discount')} FROM {{invoice}} UNION ALL SELECT invoice_id, 'IGST', {P('igst')} FROM {{invoice}} UNION ALL SELECT invoice_id, 'CGST', {P('cgst')} FROM {{invoice}} WHERE igst <= 0
UNION ALL SELECT invoice_id, 'SGST', {P('sgst')} FROM {{invoice}} WHERE igst <= 0 UNION ALL SELECT invoice_id, 'PARTY', {P('total_amount')} FROM {{invoice}}) WHERE p > 0 GROUP BY ALL
""")
def v5_voucher_lines(t: Tables) -> DataFrame:
    """The lines of the built vouchers by role, without round-offs."""
    lines = vouchers.lines_of(_built(t), "invoice_id").where("role <> 'ROUND_OFF'")
    return lines.groupBy("invoice_id", "role").agg(F.count("*").alias("n"), F.sum(F.col("debit_p") + F.col("credit_p")).alias("p"))


@query(f"""
SELECT client_id, coalesce(reason, 'approved') AS reason, count(*) AS n FROM (SELECT client_id, CASE WHEN unmapped THEN 'unmapped' WHEN abs(debit_p - credit_p) > 1 THEN 'unbalanced' WHEN coalesce(avg_confidence, 0) < 0.9 THEN 'low_confidence' END AS reason FROM {_FLAGGED} WHERE status = 'DRAFT') GROUP BY ALL
""")
def m2_bulk_approve(t: Tables) -> DataFrame:
    """What approving all sure drafts would do."""
    return vouchers.bulk_approve(vouchers.gate(t.voucher, t.voucher_line), only_high=True).groupBy("client_id", F.coalesce("reason", F.lit("approved")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT voucher_id, CASE WHEN unmapped THEN 'unmapped' WHEN abs(debit_p - credit_p) > 1 THEN 'unbalanced' END AS reason, CASE WHEN unmapped OR abs(debit_p - credit_p) > 1 THEN 'DRAFT' ELSE 'APPROVED' END AS new_status FROM {_FLAGGED} WHERE status = 'DRAFT' AND avg_confidence >= 0.9")
def m3_auto_approve(t: Tables) -> DataFrame:
    """M3: drafts of high confidence."""
    return vouchers.auto_approve(vouchers.gate(t.voucher, t.voucher_line)).select("voucher_id", "reason", "new_status")


@query("""
WITH u AS (SELECT voucher_id, client_id, CASE WHEN voucher_id % 20 = 3 THEN NULL ELSE voucher_id % 150 END AS new FROM {voucher} WHERE voucher_id % 10 = 3),
ok AS (SELECT u.voucher_id, new, name FROM u LEFT JOIN {ledger} l ON l.client_id = u.client_id AND l.ledger_id = u.new WHERE new IS NULL OR l.ledger_id IS NOT NULL)
SELECT voucher_id, sort_order, CASE WHEN hit THEN new ELSE ledger_id END AS ledger_id, CASE WHEN hit THEN name ELSE ledger_name END AS ledger_name, CASE WHEN hit THEN CASE WHEN new IS NOT NULL THEN 'MANUAL' END ELSE mapped_via END AS mapped_via
FROM (SELECT l.*, ok.voucher_id IS NOT NULL AS hit, ok.new, ok.name FROM {voucher_line} l LEFT JOIN ok ON ok.voucher_id = l.voucher_id AND l.sort_order = 1)
""")
def m6_manual_remap(t: Tables) -> DataFrame:
    """Lines mapped by hand; updates of unknown vouchers and with other clients' ledgers fall away."""
    v = F.col("voucher_id")
    some = t.voucher.where("voucher_id % 10 = 3").select("voucher_id", F.lit(1).alias("sort_order"), F.when(v % 20 != 3, v % 150).cast("long").alias("new_ledger"))
    unknown = some.select((v + 1_000_000_000).alias("voucher_id"), "sort_order", "new_ledger")
    return vouchers.remapped(t.voucher_line, some.unionByName(unknown), t.voucher, t.ledger).select("voucher_id", "sort_order", "ledger_id", "ledger_name", "mapped_via")


@query("SELECT voucher_id, abs(d - c) < 1 AS balanced, d AS debit_p, c AS credit_p FROM (SELECT voucher_id, CAST(sum(debit_p) AS BIGINT) AS d, CAST(sum(credit_p) AS BIGINT) AS c FROM {voucher_line} GROUP BY voucher_id)")
def a22_voucher_totals(t: Tables) -> DataFrame:
    """Totals recomputed from lines."""
    sums = t.voucher_line.groupBy("voucher_id").agg(F.sum("debit_p").alias("debit_p"), F.sum("credit_p").alias("credit_p"))
    return sums.select("voucher_id", (F.abs(F.col("debit_p") - F.col("credit_p")) < 1).alias("balanced"), "debit_p", "credit_p")


@query("SELECT client_id, ledger_id FROM (SELECT DISTINCT client_id, ledger_id FROM {voucher_line} JOIN (SELECT voucher_id, client_id FROM {voucher} WHERE status IN ('APPROVED', 'EXPORTED_DEMO')) USING (voucher_id) WHERE ledger_id IS NOT NULL)")
def a20_export_ledgers(t: Tables) -> DataFrame:
    """The distinct ledgers of an export."""
    chosen = t.voucher.where(F.col("status").isin("APPROVED", "EXPORTED_DEMO")).select("voucher_id", "client_id")
    return t.voucher_line.where("ledger_id IS NOT NULL").join(chosen, "voucher_id").select("client_id", "ledger_id").distinct()


# ---- bank and uploads ----


@query("""
SELECT txn_id, CASE WHEN contra THEN 'CONTRA' WHEN withdrawal > 0 AND deposit = 0 THEN 'PAYMENT' WHEN deposit > 0 AND withdrawal = 0 THEN 'RECEIPT' WHEN deposit > withdrawal THEN 'RECEIPT' ELSE 'PAYMENT' END AS voucher_type,
  CASE WHEN contra THEN 85 WHEN (withdrawal > 0 AND deposit = 0) OR (deposit > 0 AND withdrawal = 0) THEN 90 ELSE 55 END::BIGINT AS percent
FROM (SELECT *, regexp_matches(lower(description), 'self|transfer|neft own|own a/c|own account|cash dep|cash deposit|atm wdl|atm withdrawal|to cash|from cash|imps self') AS contra FROM {bank_txn})
""")
def v9_bank_classification(t: Tables) -> DataFrame:
    """V9: what each bank transaction is."""
    return bank.classify(t.bank_txn).select("txn_id", "voucher_type", F.round(F.col("confidence") * 100).cast("long").alias("percent"))


_BANK_MEMORY = "(SELECT client_id, lower(name) AS match_key, ledger_id, CAST(ledger_id % 20 AS INT) AS hit_count FROM (SELECT client_id, ledger_id, CASE ledger_id % 4 WHEN 0 THEN 'acme nova' WHEN 1 THEN 'bharat royal' WHEN 2 THEN 'coral' ELSE 'atm wdl' END AS name FROM {ledger}))"


@query("WITH k AS (SELECT DISTINCT client_id, key FROM (SELECT statement_id % 25 AS client_id, " + NARRATION.replace("{0}", "description") + f""" AS key FROM {{bank_txn}}) WHERE key <> ''),
m AS (SELECT k.client_id, key, match_key, ledger_id, hit_count, least(length(key), length(match_key)) / greatest(length(key), length(match_key)) AS ratio FROM k JOIN {_BANK_MEMORY} b ON b.client_id = k.client_id AND (contains(key, match_key) OR contains(match_key, key))),
best AS (SELECT *, row_number() OVER (PARTITION BY client_id, key ORDER BY (key = match_key) DESC, ratio DESC, hit_count DESC, match_key, ledger_id) AS n FROM m WHERE ratio >= 0.6)
SELECT client_id, key, ledger_id AS memory_ledger, CAST(floor(1000 * CASE WHEN key = match_key THEN least(0.95::DOUBLE, 0.7::DOUBLE + 0.02::DOUBLE * hit_count) ELSE 0.55::DOUBLE + 0.2::DOUBLE * ratio END + 0.5) AS BIGINT) AS thousandths FROM best WHERE n = 1
""")
def v10_narration_memory(t: Tables) -> DataFrame:
    """The ledgers that narrations recall."""
    k = F.col("ledger_id") % 4
    memory = t.ledger.select("client_id", F.when(k == 0, "acme nova").when(k == 1, "bharat royal").when(k == 2, "coral").otherwise("atm wdl").alias("match_key"), "ledger_id", (F.col("ledger_id") % 20).cast("int").alias("hit_count"))
    out = bank.recall(t.bank_txn.withColumn("client_id", F.col("statement_id") % 25).drop("ledger_id"), memory)
    return out.where("memory_ledger IS NOT NULL").select("client_id", "key", "memory_ledger", F.floor(F.lit(1000) * F.col("memory_confidence") + F.lit(0.5)).cast("long").alias("thousandths")).distinct()


@query("""
SELECT file_id, kind, CASE kind WHEN 'bank' THEN 'BANK' WHEN 'credit_note' THEN 'CREDIT_NOTE' WHEN 'debit_note' THEN 'DEBIT_NOTE' WHEN 'receipt' THEN 'RECEIPT' ELSE 'PURCHASE' END AS stored FROM (
SELECT file_id, CASE WHEN regexp_matches(n, 'bank|statement|passbook') OR e LIKE '%"transactions": [%' THEN 'bank' WHEN contains(e, 'credit note') OR contains(n, 'credit') OR contains(n, '_cn') THEN 'credit_note'
  WHEN contains(e, 'debit note') OR contains(n, 'debit') OR contains(n, '_dn') THEN 'debit_note' WHEN contains(n, 'receipt') OR contains(e, 'cash receipt') THEN 'receipt' ELSE 'invoice' END AS kind
FROM (SELECT file_id, lower(file_name) AS n, lower(coalesce(extracted, '')) AS e FROM {upload}))
""")
def v11_document_type(t: Tables) -> DataFrame:
    """What each upload is."""
    kind = documents.detect_type(F.col("file_name"), F.col("extracted"))
    return t.upload.select("file_id", kind.alias("kind"), documents.stored_type(kind).alias("stored"))


# ---- reconciliation ----

_RECON = f"""
WITH b AS (SELECT i.client_id, coalesce({NORM_GSTIN('vendor_gstin')}, '') AS g, {SQUEEZE('invoice_number')} AS e, coalesce({NORM_NAME('invoice_number')}, '') AS s, i.invoice_id, coalesce(subtotal, coalesce(total_amount, 0) - coalesce(tax_amount, 0)) AS x, coalesce(tax_amount, cgst + sgst + igst) AS y, coalesce(subtotal, 0) AS lx, coalesce(tax_amount, 0) AS ly
  FROM {{invoice}} i LEFT JOIN {{voucher}} v ON v.invoice_id = i.invoice_id WHERE document_type = 'PURCHASE' OR document_type IS NULL OR voucher_type = 'PURCHASE'),
r AS (SELECT client_id, coalesce({NORM_GSTIN('supplier_gstin')}, '') AS g, {SQUEEZE('invoice_number')} AS e, coalesce({NORM_NAME('invoice_number')}, '') AS s, row_id, taxable_value AS x, total_tax AS y FROM {{gst2b_row}}),
m1 AS (SELECT r.client_id, r.g, row_id, invoice_id, abs(b.x - r.x) AS dx, abs(b.y - r.y) AS dy FROM (SELECT *, row_number() OVER (PARTITION BY client_id, g, e ORDER BY row_id) AS n FROM r) r JOIN (SELECT *, row_number() OVER (PARTITION BY client_id, g, e ORDER BY invoice_id) AS n FROM b) b USING (client_id, g, e, n)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY client_id, g, s ORDER BY invoice_id) AS n FROM b WHERE invoice_id NOT IN (SELECT invoice_id FROM m1)), r2 AS (SELECT *, row_number() OVER (PARTITION BY client_id, g, s ORDER BY row_id) AS n FROM r WHERE row_id NOT IN (SELECT row_id FROM m1)),
m2 AS (SELECT r2.client_id, r2.g, row_id, invoice_id, abs(b2.x - r2.x) AS dx, abs(b2.y - r2.y) AS dy FROM r2 JOIN b2 USING (client_id, g, s, n)),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),
res AS (SELECT *, CASE WHEN dx <= 1 AND dy <= 1 THEN 'MATCHED' ELSE 'VALUE_MISMATCH' END AS status FROM m
UNION ALL SELECT client_id, g, row_id, NULL, x, y, 'MISSING_IN_BOOKS' FROM r2 WHERE row_id NOT IN (SELECT row_id FROM m2) UNION ALL SELECT client_id, g, NULL, invoice_id, lx, ly, 'MISSING_IN_2B' FROM b2 WHERE invoice_id NOT IN (SELECT invoice_id FROM m2))
"""


def _recon_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.gst2b_row, reconcile.purchase_books(t.invoice, t.voucher)


@query(_RECON + f"SELECT client_id, g AS gstin, row_id, invoice_id, status, {P('dx')} AS taxable_p, {P('dy')} AS tax_p FROM res")
def j7_reconcile_windows(t: Tables) -> DataFrame:
    """J7 by ranks, U1, U4: every row and book with its status."""
    out = reconcile.reconcile_windows(*_recon_sides(t))
    return out.select("client_id", "gstin", "row_id", "invoice_id", "status", V.to_paise(F.col("taxable_diff")).alias("taxable_p"), V.to_paise(F.col("tax_diff")).alias("tax_p"))


# the same with the sequential rule, a row at a time in each registration: exact key before soft key, the first book that is not used
_GREEDY = (
    _RECON[: _RECON.index("m1 AS (")].replace("WITH b", "WITH RECURSIVE b")
    + """bl AS (SELECT client_id, g, list({'i': invoice_id, 'e': e, 's': s} ORDER BY invoice_id) AS books FROM b GROUP BY ALL),
rn AS (SELECT *, row_number() OVER (PARTITION BY client_id, g ORDER BY row_id) AS n FROM r),
walk AS (SELECT DISTINCT client_id, g, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS row_id, CAST(NULL AS BIGINT) AS invoice_id FROM rn
  UNION ALL SELECT client_id, g, n, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, row_id, p FROM (
    SELECT rn.client_id, rn.g, rn.n, walk.used, rn.row_id, coalesce(list_filter(books, lambda q: q.e = rn.e AND NOT list_contains(walk.used, q.i))[1].i, list_filter(books, lambda q: q.s = rn.s AND NOT list_contains(walk.used, q.i))[1].i) AS p
    FROM walk JOIN rn ON rn.client_id = walk.client_id AND rn.g = walk.g AND rn.n = walk.n + 1 LEFT JOIN bl ON bl.client_id = rn.client_id AND bl.g = rn.g)),
m AS (SELECT w.client_id, w.g, w.row_id, w.invoice_id, abs(b.x - r.x) AS dx, abs(b.y - r.y) AS dy FROM walk w JOIN r ON r.row_id = w.row_id JOIN b ON b.invoice_id = w.invoice_id),
res AS (SELECT *, CASE WHEN dx <= 1 AND dy <= 1 THEN 'MATCHED' ELSE 'VALUE_MISMATCH' END AS status FROM m
UNION ALL SELECT client_id, g, row_id, NULL, x, y, 'MISSING_IN_BOOKS' FROM r WHERE row_id NOT IN (SELECT row_id FROM m) UNION ALL SELECT client_id, g, NULL, invoice_id, lx, ly, 'MISSING_IN_2B' FROM b WHERE invoice_id NOT IN (SELECT invoice_id FROM m))
"""
)


@query(_GREEDY + f"SELECT client_id, g AS gstin, row_id, invoice_id, status, {P('dx')} AS taxable_p, {P('dy')} AS tax_p FROM res")
def j7_reconcile(t: Tables) -> DataFrame:
    """The order-dependent matcher, in parallel by registration."""
    out = reconcile.reconcile(*_recon_sides(t))
    return out.select("client_id", "gstin", "row_id", "invoice_id", "status", V.to_paise(F.col("taxable_diff")).alias("taxable_p"), V.to_paise(F.col("tax_diff")).alias("tax_p"))


@query(_GREEDY + f"""
SELECT client_id, count(*) FILTER (WHERE status = 'MATCHED') AS n_matched, count(*) FILTER (WHERE status = 'VALUE_MISMATCH') AS n_value_mismatch, count(*) FILTER (WHERE status = 'MISSING_IN_2B') AS n_missing_in_2b, count(*) FILTER (WHERE status = 'MISSING_IN_BOOKS') AS n_missing_in_books,
  CAST(coalesce(sum({P('y')}) FILTER (WHERE status = 'MATCHED'), 0) AS BIGINT) AS itc_eligible_p, CAST(coalesce(sum({P('dy')}) FILTER (WHERE status <> 'MATCHED'), 0) AS BIGINT) AS itc_at_risk_p
FROM res LEFT JOIN (SELECT row_id, y FROM r) USING (row_id) GROUP BY client_id
""")
def a10_recon_summary(t: Tables) -> DataFrame:
    """A10: the flagship: reconciliation summary of each client."""
    return reconcile.summary(reconcile.reconcile(*_recon_sides(t)))


@query(_GREEDY + "SELECT res.client_id, coalesce(res.status, '') AS status, CASE res.status WHEN 'MATCHED' THEN 1 WHEN 'VALUE_MISMATCH' THEN 2 WHEN 'MISSING_IN_2B' THEN 3 ELSE 4 END AS status_order, res.row_id, res.invoice_id, q.supplier_name, i.vendor FROM res LEFT JOIN {gst2b_row} q ON q.row_id = res.row_id AND q.client_id = res.client_id LEFT JOIN {invoice} i ON i.invoice_id = res.invoice_id AND i.client_id = res.client_id")
def j12_recon_detail(t: Tables) -> DataFrame:
    """Results with what they refer to, in the order of their status."""
    rows, books = _recon_sides(t)
    rows = stored(rows, "portal-rows")  # matched and then joined
    out = reconcile.reconcile(rows, books).select("client_id", "status", "row_id", "invoice_id")
    out = out.join(rows.select("client_id", "row_id", "supplier_name"), ["client_id", "row_id"], "left").join(t.invoice.select("client_id", "invoice_id", "vendor"), ["client_id", "invoice_id"], "left")
    return reconcile.by_status(out).select("client_id", "status", "status_order", "row_id", "invoice_id", "supplier_name", "vendor")


# ---- exports ----

_XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')".format


@query(f"""
SELECT client_id, invoice_id, coalesce(invoice_number, '') AS "Invoice #", coalesce(vendor, '') AS "Vendor", coalesce(vendor_gstin, '') AS "Vendor GSTIN", coalesce(strftime(invoice_date, '%-d/%-m/%Y'), '') AS "Date", {MONEY(P('subtotal'))} AS "Subtotal", {MONEY(P('cgst'))} AS "CGST",
  {MONEY(P('sgst'))} AS "SGST", {MONEY(P('igst'))} AS "IGST", {MONEY(P('tax_amount'))} AS "Tax", {MONEY(P('total_amount'))} AS "Total Amount", CASE WHEN gst_valid THEN 'Valid' WHEN NOT gst_valid THEN 'Invalid' ELSE '' END AS "GST Valid", status AS "Status", coalesce(document_type, '') AS "Doc Type" FROM {{invoice}}
""")
def k1_invoice_csv(t: Tables) -> DataFrame:
    """K1: the rows of the invoice list as the CSV export writes them, all 13 columns."""
    return export.invoice_list(t.invoice).select("client_id", "invoice_id", *export.CSV_COLUMNS)


@query(f"SELECT client_id, 1 AS part, invoice_id, nullif(vendor, '') AS vendor, {P('total_amount')} AS total_p, CAST(NULL AS BIGINT) AS total FROM {{invoice}} UNION ALL SELECT client_id, 0, NULL, NULL, NULL, count(*) FROM {{invoice}} GROUP BY client_id")
def k2_invoice_json(t: Tables) -> DataFrame:
    """K2: the lines of the JSON export read back: each invoice, and the total that each client's envelope states."""
    at = lambda k: F.get_json_object("line", f"$.{k}")
    return export.invoice_json(t.invoice, as_of()).select("client_id", "part", "invoice_id", F.nullif(at("vendor"), F.lit("")).alias("vendor"), V.to_paise(at("total_amount").cast("double")).alias("total_p"), F.when(F.col("part") == 0, at("total").cast("long")).alias("total"))


_LEDGER_XML = f"""SELECT client_id, place, name, '<TALLYMESSAGE xmlns:UDF="TallyUDF"><LEDGER NAME="' || {_XML('name')} || '" ACTION="Create"><NAME.LIST><NAME>' || {_XML('name')} || '</NAME></NAME.LIST><PARENT>' || CASE ledger_group WHEN 'SUNDRY_CREDITORS' THEN 'Sundry Creditors' WHEN 'SUNDRY_DEBTORS' THEN 'Sundry Debtors' WHEN 'DUTIES_AND_TAXES' THEN 'Duties &amp; Taxes' ELSE 'Purchase Accounts' END || '</PARENT>' ||
  CASE WHEN gstin <> '' THEN '<PARTYGSTIN>' || gstin || '</PARTYGSTIN>' ELSE '' END || '<ISBILLWISEON>No</ISBILLWISEON></LEDGER></TALLYMESSAGE>' AS xml
FROM (SELECT *, min(ledger_id) OVER (PARTITION BY client_id, name) AS place, row_number() OVER (PARTITION BY client_id, name ORDER BY ledger_id DESC) AS n FROM {{chosen}} WHERE name <> '') WHERE n = 1"""
_VOUCHER_XML = f"""SELECT client_id, nth, voucher_id, '<TALLYMESSAGE xmlns:UDF="TallyUDF"><VOUCHER REMOTEID="V-' || CAST(nth - 1 AS VARCHAR) || '-' || strftime(voucher_date, '%Y%m%d') || '" VCHTYPE="' || k || '" ACTION="Create"><DATE>' || strftime(voucher_date, '%Y%m%d') || '</DATE><NARRATION>' || {_XML("coalesce(nullif(narration, ''), nullif(concat_ws(' / ', nullif(vendor, ''), 'Inv ' || nullif(invoice_number, '')), ''), 'Imported')")}
  || '</NARRATION><VOUCHERTYPENAME>' || k || '</VOUCHERTYPENAME><VOUCHERNUMBER>' || {_XML("coalesce(nullif(invoice_number, ''), 'V-' || CAST(nth AS VARCHAR))")} || '</VOUCHERNUMBER>' || coalesce(entries, '') || '</VOUCHER></TALLYMESSAGE>' AS xml
FROM (SELECT *, CASE voucher_type WHEN 'SALE' THEN 'Sales' WHEN 'CREDIT_NOTE' THEN 'Credit Note' WHEN 'DEBIT_NOTE' THEN 'Debit Note' ELSE 'Purchase' END AS k FROM (SELECT v.*, i.vendor, i.invoice_number, row_number() OVER (PARTITION BY v.client_id ORDER BY voucher_date, v.voucher_id) AS nth FROM {{voucher}} v LEFT JOIN {{invoice}} i USING (invoice_id) WHERE v.status IN ('APPROVED', 'EXPORTED_DEMO')))
LEFT JOIN (SELECT voucher_id, string_agg('<ALLLEDGERENTRIES.LIST><LEDGERNAME>' || {_XML("coalesce(nullif(ledger_name, ''), 'Unknown')")} || '</LEDGERNAME><ISDEEMEDPOSITIVE>' || CASE WHEN debit_p > 0 THEN 'Yes' ELSE 'No' END || '</ISDEEMEDPOSITIVE><AMOUNT>' || CASE WHEN debit_p > 0 THEN '-' || ({MONEY('debit_p')}) ELSE {MONEY('credit_p')} END || '</AMOUNT></ALLLEDGERENTRIES.LIST>', '' ORDER BY sort_order) AS entries
  FROM {{voucher_line}} WHERE debit_p > 0 OR credit_p > 0 GROUP BY voucher_id) USING (voucher_id)"""


@query(_LEDGER_XML.replace("{chosen}", "{ledger}"))
def k3_ledger_xml(t: Tables) -> DataFrame:
    """Ledger masters."""
    return export.ledger_xml(t.ledger)


def _keep_exported(t: Tables) -> None:
    """Invoices and voucher lines, which vouchers are made of too, are made once for an export."""
    t.keep("invoice", "invoice_id", "client_id", "document_type", "created_at", "invoice_number", "vendor", "total_amount")
    t.keep("voucher_line", "voucher_id", "sort_order", "ledger_id", "ledger_name", "debit_p", "credit_p")


@query(_VOUCHER_XML)
def k3_voucher_xml(t: Tables) -> DataFrame:
    """Voucher entries."""
    _keep_exported(t)
    return export.voucher_xml(t.voucher, t.voucher_line, t.invoice)


_USED = "SELECT l.* FROM {ledger} l SEMI JOIN (SELECT client_id, ledger_id FROM {voucher_line} JOIN (SELECT voucher_id, client_id FROM {voucher} WHERE status IN ('APPROVED', 'EXPORTED_DEMO')) USING (voucher_id)) u ON u.client_id = l.client_id AND u.ledger_id = l.ledger_id"


@query(f"""
WITH used AS ({_USED}), masters AS ({_LEDGER_XML.replace("{chosen}", "used")}), entries AS ({_VOUCHER_XML}), chosen AS (SELECT DISTINCT client_id FROM entries)
SELECT client_id, 0 AS part, CAST(0 AS BIGINT) AS at, '<?xml version="1.0" encoding="UTF-8"?><ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY><IMPORTDATA><REQUESTDESC><REPORTNAME>All Masters</REPORTNAME><STATICVARIABLES><SVCURRENTCOMPANY>' || {_XML("coalesce(nullif(name, ''), 'Import')")} || '</SVCURRENTCOMPANY></STATICVARIABLES></REQUESTDESC><REQUESTDATA>' AS xml FROM {{client}} JOIN chosen USING (client_id)
UNION ALL SELECT client_id, 1, place, xml FROM masters JOIN chosen USING (client_id) UNION ALL SELECT client_id, 2, nth, xml FROM entries UNION ALL SELECT client_id, 3, 0, '</REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>' FROM {{client}} JOIN chosen USING (client_id)
""")
def k3_import_document(t: Tables) -> DataFrame:
    """Each client's whole import document as lines: the ledgers that its vouchers use, then the vouchers."""
    _keep_exported(t)
    chosen = t.voucher.where(F.col("status").isin("APPROVED", "EXPORTED_DEMO")).select("voucher_id", "client_id")
    used = t.voucher_line.where("ledger_id IS NOT NULL").join(chosen, "voucher_id").select("client_id", "ledger_id").distinct()
    masters = export.ledger_xml(t.ledger.join(used, ["client_id", "ledger_id"], "left_semi"))
    entries = stored(export.voucher_xml(t.voucher, t.voucher_line, t.invoice), "entries")  # written, and asked for their clients
    return export.import_document(masters, entries, t.client)


@query("SELECT voucher_id, v.client_id, n_vouchers, CASE WHEN status IN ('APPROVED', 'EXPORTED_DEMO') THEN 'EXPORTED_DEMO' ELSE status END AS new_status FROM {voucher} v LEFT JOIN (SELECT client_id, count(*) AS n_vouchers FROM {voucher} WHERE status IN ('APPROVED', 'EXPORTED_DEMO') GROUP BY client_id) a ON a.client_id = v.client_id AND v.status IN ('APPROVED', 'EXPORTED_DEMO')")
def k4_export_audit(t: Tables) -> DataFrame:
    """K4, M8: the audit rows of an export beside the vouchers as they are afterwards."""
    after, audit = vouchers.exported(t.voucher)
    return after.select("voucher_id", "client_id", F.col("status").alias("new_status")).join(audit, ["client_id", "voucher_id"], "left")


@query(f"SELECT invoice_id, nullif({P('subtotal')}, 0) AS subtotal_p, nullif({P('discount')}, 0) AS discount_p, nullif({P('igst')}, 0) AS igst_p, {P('tax_amount')} AS tax_p FROM {{invoice}}")
def k8_stored_invoices(t: Tables) -> DataFrame:
    """K8: zeros that are kept as nulls."""
    p = lambda c, n: V.to_paise(F.col(c)).alias(n)
    return export.stored_invoices(t.invoice).select("invoice_id", p("subtotal", "subtotal_p"), p("discount", "discount_p"), p("igst", "igst_p"), p("tax_amount", "tax_p"))


FLAGSHIP = QUERIES["a10_recon_summary"]

from vahi.plans import changes as _changes  # noqa: E402, F401  registers more queries
from vahi.plans import screens as _screens  # noqa: E402, F401
