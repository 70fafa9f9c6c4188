"""The domain's tables as deterministic selections from the star-schema tables, in SQL that Spark and DuckDB read alike.

`{name}` stands for another table. view() gives a binding as a DataFrame; with_sql() puts the bindings that a statement uses before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

#: Two known words and one spelt from the key, so that names grow with the keys.
_WORDS = (
    "trim(substring('Acme   Bharat Coral  Delta  Ember  FortunaGanga  Harit  ', CAST(1 + 7 * ({k} % 8) AS INT), 7)) || ' ' || trim(substring('Nova  Prime Royal ', CAST(1 + 6 * ({k} % 3) AS INT), 6)) "
    "|| ' ' || translate(CAST(CAST(floor({k} / 7) AS BIGINT) AS VARCHAR(12)), '0123456789', 'aeioukmrst')"
)
_NAME = (
    "CASE {k} % 7 WHEN 0 THEN 'The ' || {w} || ' Traders Pvt. Ltd.' WHEN 1 THEN {w} || ' & Co' WHEN 2 THEN {w} || ' Industries (India) Limited' "
    "WHEN 3 THEN upper({w}) || ' ENTERPRISES' WHEN 4 THEN {w} || ' Steel  Works' WHEN 5 THEN {w} || '-Agro LLP' ELSE {w} || ' s Stores' END"
)
_GSTIN = (
    "CASE WHEN {k} % 13 = 0 THEN NULL WHEN {k} % 17 = 0 THEN '' WHEN {k} % 19 = 0 THEN lpad(CAST(1 + {k} % 38 AS VARCHAR(2)), 2, '0') || ' abcde' || lpad(CAST({k} % 10000 AS VARCHAR(4)), 4, '0') || 'f1z5' "
    "ELSE lpad(CAST(1 + {k} % 38 AS VARCHAR(2)), 2, '0') || 'ABCDE' || lpad(CAST({k} % 10000 AS VARCHAR(4)), 4, '0') || 'F1Z' || CAST({k} % 10 AS VARCHAR(1)) END"
)


def _name(k: str) -> str:
    w = "(" + _WORDS.replace("{k}", f"({k})") + ")"
    return _NAME.replace("{w}", w).replace("{k}", f"({k})")


def _gstin(k: str) -> str:
    return _GSTIN.replace("{k}", f"({k})")


_P = "CAST(floor({0} * 100 + 0.5) AS BIGINT)"

BINDINGS: dict[str, str] = {
    # invoice lines: item number, names, goods code, rate and amounts; some amounts disagree with quantity x rate, some are negative
    "invoice_item": """
SELECT l_orderkey AS invoice_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS INT) AS sort_order,
  l_partkey AS part_key, p_name AS name, l_quantity AS qty,
  CASE WHEN l_partkey % 17 = 0 THEN CAST(floor(l_extendedprice * 50 / l_quantity + 0.5) AS DOUBLE) / 100 ELSE CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS DOUBLE) / 100 END AS rate,
  CASE WHEN l_partkey % 41 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS price,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN 'HS' || CAST(l_partkey AS VARCHAR(9)) WHEN l_partkey % 13 = 0 THEN '72 ' || lpad(CAST(l_partkey % 40 AS VARCHAR(9)), 2, '0') ELSE lpad(CAST(7200 + l_partkey % 40 AS VARCHAR(9)), 4, '0') END AS hsn_code,
  CAST(floor(l_tax * 100 + 0.5) AS DOUBLE) AS gst_rate,
  CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS price_p, CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT) AS tax_p
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
""",
    "invoice": f"""
SELECT o_orderkey AS invoice_id, c_nationkey AS client_id, c_nationkey % 5 AS user_id,
  CASE WHEN o_orderkey % 43 = 0 THEN '' WHEN o_orderkey % 47 = 0 THEN NULL ELSE {_name("o_custkey")} END AS vendor, {_gstin("o_custkey")} AS vendor_gstin,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE c_name END AS customer_name, {_gstin("c_nationkey * 3 + 1")} AS customer_gstin,
  CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'INV ' || CAST(o_orderkey % 200 AS VARCHAR(9)) WHEN o_orderkey % 5 = 1 THEN 'inv' || CAST((o_orderkey - 1) % 200 AS VARCHAR(9)) ELSE 'B-' || CAST(o_orderkey AS VARCHAR(9)) END AS invoice_number,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderdate END AS invoice_date, o_orderdate AS created_at,
  CAST(sub_p AS DOUBLE) / 100 AS subtotal,
  CASE WHEN interstate AND o_orderkey % 29 <> 0 THEN CAST(0 AS DOUBLE) ELSE CAST(floor(CAST(t_p AS DOUBLE) / 2) AS DOUBLE) / 100 END AS cgst,
  CASE WHEN interstate AND o_orderkey % 29 <> 0 THEN CAST(0 AS DOUBLE) ELSE (t_p - floor(CAST(t_p AS DOUBLE) / 2) + CASE WHEN o_orderkey % 31 = 0 THEN 500 ELSE 0 END) / 100 END AS sgst,
  CASE WHEN interstate OR o_orderkey % 29 = 0 THEN CAST(t_p AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS igst,
  CASE WHEN o_orderkey % 4 = 0 THEN floor(CAST(sub_p AS DOUBLE) / 50) / 100 WHEN o_orderkey % 401 = 0 THEN CAST(sub_p + 100 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS discount,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(t_p AS DOUBLE) / 100 END AS tax_amount,
  CASE WHEN o_orderkey % 53 = 0 THEN o_totalprice WHEN o_orderkey % 311 = 0 THEN -o_totalprice ELSE (sub_p - CASE WHEN o_orderkey % 4 = 0 THEN floor(CAST(sub_p AS DOUBLE) / 50) ELSE CAST(0 AS DOUBLE) END + t_p + (o_orderkey % 7 - 3) * 40) / 100 END AS total_amount,
  CASE WHEN o_orderkey % 10 < 4 THEN 'PURCHASE' WHEN o_orderkey % 10 = 4 THEN NULL WHEN o_orderkey % 10 < 7 THEN 'SALES' WHEN o_orderkey % 10 = 7 THEN 'CREDIT_NOTE' WHEN o_orderkey % 10 = 8 THEN 'DN' ELSE 'RECEIPT' END AS document_type,
  o_orderkey % 67 = 0 AS reverse_charge, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'IRN' || CAST(o_orderkey AS VARCHAR(9)) END AS irn,
  CASE WHEN o_orderkey % 9 = 0 THEN '1234' WHEN o_orderkey % 9 = 1 THEN '123456789012' ELSE NULL END AS eway_bill_no,
  CASE WHEN o_orderkey % 59 = 0 THEN 'PENDING' ELSE 'PROCESSED' END AS status, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 3 <> 0 END AS gst_valid,
  o_orderkey % 71 = 0 AS is_duplicate, CAST(o_orderkey % 4 AS INT) AS n_flags
FROM (SELECT *, o_custkey % 3 = 0 AS interstate, coalesce(lines.sub, 0) AS sub_p, coalesce(lines.tax, 0) AS t_p
  FROM {{orders}} LEFT JOIN (SELECT invoice_id, CAST(sum(price_p) AS BIGINT) AS sub, CAST(sum(tax_p) AS BIGINT) AS tax FROM {{invoice_item}} GROUP BY invoice_id) lines ON lines.invoice_id = o_orderkey) o
JOIN {{customer}} ON c_custkey = o_custkey
""",
    "sent": """
SELECT client_id, invoice_id, created_at, invoice_number, vendor_gstin, vendor, total_amount FROM {invoice}
UNION ALL SELECT client_id, invoice_id + 1000000000, created_at, ' ' || lower(invoice_number), vendor_gstin, vendor, total_amount FROM {invoice} WHERE invoice_id % 7 = 0
""",
    # journal lines: one for the party, one for each item; some have no ledger
    "voucher_line": """
SELECT invoice_id AS voucher_id, sort_order + 1 AS sort_order, 'ITEM' AS role, CASE WHEN part_key % 19 = 0 THEN NULL ELSE part_key % 40 END AS ledger_id, name AS ledger_name,
  CASE WHEN price > 0 THEN price_p ELSE 0 END AS debit_p, CAST(0 AS BIGINT) AS credit_p,
  CASE part_key % 7 WHEN 0 THEN 'RULE' WHEN 1 THEN 'GSTIN_MEMORY' WHEN 2 THEN 'NAME_MEMORY' WHEN 3 THEN 'FUZZY' WHEN 4 THEN 'MANUAL' WHEN 5 THEN 'DEFAULT' ELSE NULL END AS mapped_via,
  CASE WHEN part_key % 9 = 0 THEN NULL ELSE CAST(part_key % 101 AS DOUBLE) / 100 END AS confidence
FROM {invoice_item} WHERE invoice_id % 23 <> 0
UNION ALL
SELECT invoice_id, 0, 'PARTY', CASE WHEN invoice_id % 12 = 0 THEN NULL ELSE 100 + invoice_id % 50 END, vendor, CAST(0 AS BIGINT), CAST(floor(total_amount * 100 + 0.5) AS BIGINT), 'NAME_MEMORY', CAST(0.85 AS DOUBLE)
FROM {invoice} WHERE invoice_id % 23 <> 0
""",
    "voucher": """
SELECT i.invoice_id AS voucher_id, i.invoice_id, i.client_id,
  CASE i.document_type WHEN 'SALES' THEN 'SALE' WHEN 'CREDIT_NOTE' THEN 'CREDIT_NOTE' WHEN 'DN' THEN 'DEBIT_NOTE' ELSE 'PURCHASE' END AS voucher_type,
  CASE WHEN i.invoice_id % 6 < 3 THEN 'DRAFT' WHEN i.invoice_id % 6 = 3 THEN 'APPROVED' WHEN i.invoice_id % 6 = 4 THEN 'EXPORTED_DEMO' ELSE 'POSTED' END AS status,
  t.debit_p + CASE WHEN i.invoice_id % 4 = 0 THEN t.credit_p - t.debit_p ELSE 0 END AS debit_p, t.credit_p,
  CASE WHEN i.invoice_id % 11 = 0 THEN NULL ELSE CAST(i.invoice_id % 101 AS DOUBLE) / 100 END AS avg_confidence,
  i.created_at AS voucher_date, i.created_at, CASE WHEN i.invoice_id % 3 = 0 THEN 'Inv ' || i.invoice_number ELSE NULL END AS narration
FROM {invoice} i JOIN (SELECT voucher_id, CAST(sum(debit_p) AS BIGINT) AS debit_p, CAST(sum(credit_p) AS BIGINT) AS credit_p FROM {voucher_line} GROUP BY voucher_id) t ON t.voucher_id = i.invoice_id
""",
    "client": "SELECT n_nationkey AS client_id, n_nationkey % 5 AS user_id, n_name AS name, n_nationkey % 3 = 0 AS is_default FROM {nation}",
    "bank_txn": """
SELECT user_id AS statement_id, event_id AS txn_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS sort_order, ts AS txn_date,
  CASE event_id % 8 WHEN 0 THEN 'UPI/' || CAST(1000000 + event_id AS VARCHAR(12)) || '/ACME NOVA TRADERS' WHEN 1 THEN 'ATM WDL SELF ' || CAST(event_id AS VARCHAR(12)) WHEN 2 THEN 'NEFT Bharat Royal & Co ref ' || CAST(9000000 + event_id AS VARCHAR(12))
    WHEN 3 THEN 'IMPS transfer to savings' WHEN 4 THEN 'Cash Deposit branch ' || CAST(event_id % 10 AS VARCHAR(2)) WHEN 5 THEN '' WHEN 6 THEN 'RTGS ' || event_type || ' Coral Prime Ltd' ELSE event_type || ' charge ' || CAST(event_id % 100 AS VARCHAR(3)) END AS description,
  CASE WHEN event_type IN ('purchase', 'error') OR event_id % 31 = 0 THEN value ELSE CAST(0 AS DOUBLE) END AS withdrawal,
  CASE WHEN event_type IN ('signup', 'click') OR event_id % 31 = 0 THEN value + event_id % 2 ELSE CAST(0 AS DOUBLE) END AS deposit,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 30 END AS ledger_id
FROM {events}
""",
    "bank_statement": "SELECT DISTINCT user_id AS statement_id, user_id % 25 AS client_id FROM {events} UNION ALL SELECT -1 AS statement_id, 3 AS client_id",
    # ledgers of a client, one a customer: party names that differ a little from the vendors' names
    "ledger": f"""
SELECT c_custkey AS ledger_id, c_nationkey AS client_id, CASE WHEN c_custkey % 5 = 0 THEN {_name("c_custkey")} || ' India' WHEN c_custkey % 5 = 1 THEN substring({_name("c_custkey")}, 1, 14) ELSE {_name("c_custkey")} END AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'SUNDRY_CREDITORS' WHEN 1 THEN 'SUNDRY_DEBTORS' WHEN 2 THEN 'PURCHASE_ACCOUNTS' ELSE 'DUTIES_AND_TAXES' END AS ledger_group, CASE WHEN c_custkey % 4 < 2 AND c_custkey % 3 = 0 THEN {_gstin("c_custkey")} END AS gstin,
  CASE WHEN c_custkey % 4 < 2 THEN 'PARTY' WHEN c_custkey % 4 = 2 THEN 'PURCHASE' ELSE 'TAX_INPUT' END AS ledger_type, CASE WHEN c_custkey % 4 = 2 AND c_custkey % 3 > 0 THEN CAST(c_custkey % 9 AS DOUBLE) ELSE NULL END AS gst_rate
FROM {{customer}}
""",
    # one rule a supplier, for the customer of its key
    "mapping_rule": f"""
SELECT s_suppkey AS rule_id, c_nationkey AS client_id, CASE s_suppkey % 4 WHEN 0 THEN 'GSTIN_EQUALS' WHEN 1 THEN 'VENDOR_NAME_EQUALS' WHEN 2 THEN 'VENDOR_NAME_CONTAINS' ELSE 'HSN_EQUALS' END AS rule_type,
  CASE s_suppkey % 4 WHEN 0 THEN {_gstin("s_suppkey")} WHEN 1 THEN {_name("s_suppkey")} WHEN 2 THEN CASE WHEN s_suppkey % 8 = 2 THEN 'coral' ELSE 'Ember  Royal' END ELSE '72 ' || lpad(CAST(s_suppkey % 40 AS VARCHAR(9)), 2, '0') END AS pattern,
  c_custkey AS ledger_id, CAST(s_suppkey % 5 AS INT) AS priority, s_suppkey % 6 <> 5 AS enabled
FROM {{supplier}} JOIN {{customer}} ON c_custkey = s_suppkey
""",
    # one remembered key a part, for the customer of its key; two thirds of them are not what the customer's invoices say
    "memory": f"""
SELECT c_nationkey AS client_id, CASE WHEN p_partkey % 2 = 0 THEN 'GSTIN' ELSE 'VENDOR_NAME' END AS match_type,
  CASE WHEN p_partkey % 2 = 0 THEN {_gstin("p_partkey + p_partkey % 3")} ELSE lower({_WORDS.replace("{k}", "(p_partkey)")}) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' x' END END AS match_key, c_custkey AS ledger_id, CAST(1 + p_partkey % 4 AS INT) AS hit_count
FROM {{part}} JOIN {{customer}} ON c_custkey = p_partkey
""",
    # what the tax portal says: the books with rows dropped, values shifted, numbers noised and rows doubled
    "gst2b_row": """
SELECT client_id, invoice_id * 10 + copy AS row_id, vendor_gstin AS supplier_gstin, vendor AS supplier_name,
  CASE WHEN invoice_id % 6 = 0 THEN invoice_number || '-' WHEN invoice_id % 6 = 1 THEN ' ' || upper(invoice_number) ELSE invoice_number END AS invoice_number,
  subtotal + CASE WHEN invoice_id % 8 = 0 THEN 12.5 WHEN invoice_id % 8 = 1 THEN 0.75 ELSE 0 END AS taxable_value, cgst + sgst + igst AS total_tax
FROM {invoice} JOIN (SELECT CAST(n_nationkey AS INT) AS copy FROM {nation} WHERE n_nationkey < 2) c ON copy = 0 OR invoice_id % 14 = 0
WHERE (document_type = 'PURCHASE' OR document_type IS NULL) AND invoice_id % 9 <> 0
""",
    # reconciliation runs of a client, as their headers keep them
    "gst2b_upload": """
SELECT client_id, client_id * 100 + invoice_id % 50 AS upload_id, max(created_at) AS created_at, CAST(count(*) AS BIGINT) AS row_count, CAST(count(CASE WHEN invoice_id % 3 = 0 THEN 1 END) AS BIGINT) AS matched,
  CAST(count(CASE WHEN invoice_id % 3 = 1 THEN 1 END) AS BIGINT) AS mismatched, CAST(sum(CASE WHEN invoice_id % 3 = 1 THEN CAST(floor(tax_amount * 100 + 0.5) AS BIGINT) ELSE 0 END) AS BIGINT) AS itc_at_risk_p
FROM {invoice} GROUP BY client_id, client_id * 100 + invoice_id % 50
""",
    "task": "SELECT event_id AS task_id, user_id % 25 AS client_id, event_type AS title, CASE event_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'IN_PROGRESS' ELSE 'DONE' END AS status, CAST(event_id % 4 AS INT) AS priority, ts AS created_at FROM {events}",
    "thread": """
SELECT c.conv_id, n_name AS client_name, CASE WHEN c.n % 4 = 0 THEN NULL ELSE 'INV-' || CAST(c.n AS VARCHAR(9)) END AS invoice_number, CAST(c.n % 3 AS INT) AS unread, c.n % 2 = 0 AS pinned
FROM (SELECT conv_id, CAST(count(*) AS BIGINT) AS n, max(length(text)) AS longest FROM {conversations} GROUP BY conv_id) c JOIN {nation} ON n_nationkey = c.longest % 25
""",
    "chat_member": "SELECT conv_id, role AS member, max(turn) % 2 = 0 AS online FROM {conversations} GROUP BY conv_id, role",
    "approval": """
SELECT client_id, invoice_id AS event_seq, vendor_gstin, vendor, invoice_id % 24 AS ledger_id FROM {invoice} WHERE invoice_id % 5 = 0
""",
    "upload": """
SELECT doc_id AS file_id, source || CASE WHEN doc_id % 6 = 0 THEN '_bank-statement' WHEN doc_id % 6 = 1 THEN '_Credit_Note' WHEN doc_id % 6 = 2 THEN ' debit note' WHEN doc_id % 6 = 3 THEN '_receipt' ELSE '_scan' END || '.pdf' AS file_name,
  CASE WHEN doc_id % 10 = 4 THEN '{"transactions": []}' WHEN doc_id % 10 = 5 THEN '{"title": "CREDIT NOTE", "n": ' || CAST(n_chars AS VARCHAR(12)) || '}' WHEN doc_id % 10 = 6 THEN NULL ELSE '{"title": "tax invoice"}' END AS extracted, n_chars AS bytes
FROM {documents}
""",
}
_NAMES = re.compile(r"\{(\w+)\}")


def _used(sql: str) -> set[str]:
    return {x for x in _NAMES.findall(sql) if x in BINDINGS or x in RAW}


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A binding or a raw table as a DataFrame."""
    made = {} if made is None else made
    if name not in made:
        if name in RAW:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sql = BINDINGS[name]
            inner = {x: view(spark, sf_dir, x, made) for x in _used(sql)}
            made[name] = spark.sql(_escaped(sql), **inner)
    return made[name]


def _escaped(sql: str) -> str:
    """Braces of literals doubled, so that formatting leaves them."""
    out, at = "", 0
    for m in _NAMES.finditer(sql):
        if m[1] in BINDINGS or m[1] in RAW:
            out += sql[at : m.start()].replace("{", "{{").replace("}", "}}") + m[0]
            at = m.end()
    return out + sql[at:].replace("{", "{{").replace("}", "}}")


def with_sql(statement: str) -> str:
    """The statement with a WITH list of every binding that it uses, directly or through others."""
    order: list[str] = []

    def need(sql: str) -> None:
        for x in sorted(_used(sql)):
            if x in BINDINGS and x not in order:
                need(BINDINGS[x])
                order.append(x)

    need(statement)
    plain = lambda sql: _NAMES.sub(lambda m: m[1] if m[1] in BINDINGS or m[1] in RAW else m[0], sql)
    head = ", ".join(f"{x} AS MATERIALIZED ({plain(BINDINGS[x])})" for x in order)
    body = plain(statement).strip()
    if not head:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
