"""Queries of lists, cards, edits, drafts and persisted tables; registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.functions import values as V
from vahi.operators import bank, drafts, ledgers, reconcile, reports, screens, tables
from vahi.operators.order import positions
from vahi.plans.catalogue import _CHECKS, _FLAGGED, _GREEDY, MONEY, NARRATION, NORM_GSTIN, NORM_NAME, ORACLE_SQL, P, Tables, _flagged, _recon_sides, _validated, as_of, query
from vahi.sources import files
from vahi.storage import new_path, stored


def paise(name: str, alias: str):
    return V.to_paise(F.coalesce(F.col(name), F.lit(0.0))).alias(alias)


def inner(name: str) -> str:
    """The statement of another query as a table."""
    return f"({ORACLE_SQL[name]})"


# ---- sources ----


@query("""
SELECT invoice_id, nullif(trim('M/s "A", ' || coalesce(vendor, '')), '') AS supplier_name, {p} AS taxable_p, {c} + {s} + {i} AS tax_p, CAST(invoice_id % 28 + 1 AS BIGINT) AS day, CASE WHEN invoice_id % 5 = 0 THEN 'CDNR' ELSE 'B2B' END AS invoice_type FROM {invoice}
""".replace("{p}", P("subtotal")).replace("{c}", P("cgst")).replace("{s}", P("sgst")).replace("{i}", P("igst")))
def s6_portal_csv(t: Tables) -> DataFrame:
    """Statements as CSV files with headers, quoted cells with commas and quotes in them; written, then read."""
    f = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    rows = t.invoice.select(
        F.lit("27 abcde 0001 f1z5").alias("GSTIN"), F.concat(F.lit('M/s "A", '), F.coalesce("vendor", F.lit(""))).alias("Trade/Legal Name"), F.col("invoice_id").cast("string").alias("Invoice Number"),
        F.concat((F.col("invoice_id") % 28 + 1).cast("string"), F.lit("-1-24")).alias("Invoice Date"), F.concat(F.lit("Rs "), f("subtotal")).alias("Taxable Value"), f("igst").alias("IGST Amount"), f("cgst").alias("cgst"), f("sgst").alias("SGST"),
        F.when(F.col("invoice_id") % 5 == 0, "CDNR").otherwise("").alias("Invoice Type"),
    )
    path = new_path(t.invoice.sparkSession, "portal-csv")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    out = files.read_portal_csv(t.invoice.sparkSession, path)
    return out.select(F.col("invoice_number").cast("long").alias("invoice_id"), "supplier_name", paise("taxable_value", "taxable_p"), paise("total_tax", "tax_p"), F.dayofmonth("invoice_date").cast("long").alias("day"), "invoice_type")


# ---- lists, cards and labels ----


@query("""
SELECT v.client_id, voucher_id, coalesce(vendor, 'Unknown') AS vendor, coalesce(invoice_number, '—') AS invoice_number, debit_p AS amount_p, coalesce(nullif(vendor, ''), 'Unknown') AS strict_vendor, coalesce(nullif(invoice_number, ''), '—') AS strict_number
FROM {voucher} v LEFT JOIN (SELECT invoice_id, vendor, invoice_number FROM {invoice}) USING (invoice_id)
""")
def p4_list_rows(t: Tables) -> DataFrame:
    """Voucher lists with their defaults."""
    return screens.list_rows(t.voucher, t.invoice)


@query("""
SELECT CAST(i.invoice_id AS VARCHAR) AS id, coalesce(nullif(vendor, ''), 'Unknown') AS title, coalesce(nullif(invoice_number, ''), substring(CAST(i.invoice_id AS VARCHAR), 1, 8)) AS subtitle, {t} AS amount_p,
  CASE WHEN v.voucher_id IS NULL THEN '/invoices/' || CAST(i.invoice_id AS VARCHAR) ELSE '/vouchers/' || CAST(v.voucher_id AS VARCHAR) END AS link FROM {invoice} i LEFT JOIN {voucher} v ON v.invoice_id = i.invoice_id
UNION ALL SELECT CAST(voucher_id AS VARCHAR), coalesce(nullif(vendor, ''), 'Unknown'), coalesce(nullif(invoice_number, ''), substring(CAST(voucher_id AS VARCHAR), 1, 8)), debit_p, '/vouchers/' || CAST(voucher_id AS VARCHAR) FROM {voucher} v LEFT JOIN (SELECT invoice_id, vendor, invoice_number FROM {invoice}) USING (invoice_id)
""".replace("{t}", P("total_amount")))
def p5_cards(t: Tables) -> DataFrame:
    """P5: the cards of the pipeline board, of invoices and of vouchers."""
    inv = t.invoice.select("invoice_id", "vendor", "invoice_number", paise("total_amount", "p"))
    mine = inv.join(t.voucher.select("invoice_id", "voucher_id"), "invoice_id", "left").withColumn("id", F.col("invoice_id").cast("string"))
    link = F.when(F.col("voucher_id").isNull(), F.concat(F.lit("/invoices/"), "id")).otherwise(F.concat(F.lit("/vouchers/"), F.col("voucher_id").cast("string")))
    theirs = t.voucher.select(F.col("voucher_id").cast("string").alias("id"), "invoice_id", "debit_p").join(inv.drop("p"), "invoice_id", "left")
    return screens.cards(mine, "id", "p", link).unionByName(screens.cards(theirs, "id", "debit_p", F.concat(F.lit("/vouchers/"), "id"))).withColumnRenamed("amount", "amount_p")


@query("""
SELECT invoice_id, n_items, labels, amount_p, named FROM (SELECT invoice_id, count(*) AS n_items, CAST(sum(CASE WHEN part_key % 3 = 0 THEN 0 ELSE price_p END) AS BIGINT) AS amount_p, string_agg(CASE WHEN part_key % 4 = 1 THEN 'by hand' ELSE label END, '|' ORDER BY sort_order) AS named
  FROM (SELECT *, CASE WHEN part_key % 2 = 0 THEN 'Item' ELSE name END AS label FROM {invoice_item}) GROUP BY invoice_id)
JOIN (SELECT invoice_id, string_agg(label, '|' ORDER BY first) AS labels FROM (SELECT invoice_id, label, min(sort_order) AS first FROM (SELECT invoice_id, sort_order, CASE WHEN part_key % 2 = 0 THEN 'Item' ELSE name END AS label FROM {invoice_item}) GROUP BY ALL) GROUP BY invoice_id) USING (invoice_id)
""")
def p10_item_views(t: Tables) -> DataFrame:
    """What a voucher's screen makes of an invoice's extracted items: labels, amounts, and names chosen by hand."""
    item = F.struct("sort_order", F.when(F.col("part_key") % 2 == 0, "  ").otherwise(F.col("name")).alias("item_name"), F.lit("unused").alias("description"), F.when(F.col("part_key") % 3 != 0, F.col("price_p")).alias("amount"), F.when(F.col("part_key") % 4 == 1, "by hand").otherwise("").alias("hand"))
    rows = t.invoice_item.groupBy("invoice_id").agg(F.sort_array(F.collect_list(item)).alias("extracted"))
    rows = rows.withColumn("items", F.coalesce(F.lit(None).cast(rows.schema["extracted"].dataType), "extracted"))  # no items of its own
    names = ("item_name", "description")
    chosen = screens.with_item_names(F.col("items"), F.transform("items", lambda x: x.hand), *names)
    amount = F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + screens.item_amount(x, "amount").cast("long"))
    return rows.select("invoice_id", F.size("items").cast("long").alias("n_items"), F.array_join(screens.item_labels(F.col("items"), *names), "|").alias("labels"), amount.alias("amount_p"), F.array_join(F.transform(chosen, lambda x: x.selected_item_name), "|").alias("named"))


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN {MONEY('event_id * 100')} WHEN 1 THEN '-' WHEN 2 THEN '-' ELSE {MONEY('event_id * 100 + 25')} END AS shown, CASE WHEN event_id % 3 = 0 THEN 'own' WHEN event_id % 3 = 1 THEN 'extracted' END AS first FROM {{events}}")
def p14_detail(t: Tables) -> DataFrame:
    """Amounts of the detail view, `-` where there is none, and whose items it shows."""
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, e.cast("string")).when(e % 4 == 1, "n/a").when(e % 4 == 3, F.concat(e.cast("string"), F.lit(".25 approx")))
    own = lambda k, name: F.when(e % 3 == k, F.array(F.struct(F.lit(name).alias("name"), F.lit(1.0).alias("price"))))
    return t.events.select("event_id", screens.shown_amount(raw).alias("shown"), F.try_element_at(screens.shown_items(own(0, "own"), own(1, "extracted")), F.lit(1))["name"].alias("first"))


_PATCH = "SELECT invoice_id, invoice_id % 3 = 0 AS a, invoice_id % 4 = 0 AS b FROM {invoice} WHERE invoice_id % 5 = 0"


@query(f"""
SELECT i.invoice_id, CASE WHEN u.a THEN 'new ' || CAST(i.invoice_id AS VARCHAR) ELSE invoice_number END AS invoice_number, CASE WHEN u.a THEN '' ELSE vendor END AS vendor, CASE WHEN u.b THEN 1234 ELSE {P('subtotal')} END AS subtotal_p, {P('cgst')} AS cgst_p,
  CASE WHEN u.invoice_id IS NULL THEN {P('total_amount')} WHEN u.b THEN 555 ELSE 0 END AS total_p, CASE WHEN u.invoice_id IS NULL THEN {P('tax_amount')} ELSE 0 END AS tax_p
FROM {{invoice}} i LEFT JOIN ({_PATCH.replace('{invoice}', '{{invoice}}')}) u ON u.invoice_id = i.invoice_id
""".replace("{{invoice}}", "{invoice}"))
def p11_patched(t: Tables) -> DataFrame:
    """Invoices after edits."""
    i = F.col("invoice_id")
    text = lambda v: F.when(i % 3 == 0, v)
    none = F.lit(None).cast("string")
    updates = t.invoice.where(i % 5 == 0).select(
        "invoice_id", F.when(i % 3 == 0, F.concat(F.lit("new "), i.cast("string"))).otherwise("").alias("invoice_number"), text(F.lit("")).alias("vendor"), *[none.alias(c) for c in ("vendor_gstin", "customer_name", "customer_gstin", "sgst", "igst", "discount", "tax_amount")],
        F.when(i % 4 == 0, "Rs 12.34").alias("subtotal"), F.lit("0").alias("cgst"), F.when(i % 4 == 0, "5.55").alias("total_amount"),
    )
    out = screens.patched(t.invoice, updates)
    return out.select("invoice_id", "invoice_number", "vendor", paise("subtotal", "subtotal_p"), paise("cgst", "cgst_p"), paise("total_amount", "total_p"), paise("tax_amount", "tax_p"))


@query(f"""
SELECT client_id, '[Active client: ' || name || '. Invoices: ' || CAST(coalesce(i, 0) AS VARCHAR) || '. Draft vouchers: ' || CAST(coalesce(d, 0) AS VARCHAR) || '. ITC (tax sum): ₹' || {MONEY('coalesce(tax, 0)')} || '. Latest 2B ITC at risk: ₹' || {MONEY('coalesce(risk, 0)')} || '.]' AS context
FROM {{client}} LEFT JOIN (SELECT client_id, count(*) AS i, CAST(sum({P('tax_amount')}) AS BIGINT) AS tax FROM {{invoice}} GROUP BY client_id) USING (client_id) LEFT JOIN (SELECT client_id, count(*) AS d FROM {{voucher}} WHERE status = 'DRAFT' GROUP BY client_id) USING (client_id)
LEFT JOIN (SELECT client_id, itc_at_risk_p AS risk FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY created_at DESC, upload_id DESC) AS n FROM {{gst2b_upload}}) WHERE n = 1) USING (client_id)
""")
def p13_chat_context(t: Tables) -> DataFrame:
    """The assistant's context, one line a client."""
    return screens.chat_context(t.client, t.invoice, t.voucher, t.gst2b_upload)


@query("SELECT conv_id, turn, role, CASE WHEN contains(lower(text), 'itc') THEN 'recon' WHEN contains(lower(text), 'unpaid') OR contains(lower(text), 'outstanding') THEN 'reports' END AS hint FROM {conversations}")
def v15_local_answer(t: Tables) -> DataFrame:
    """The hint that answers a message by its words."""
    return t.conversations.select("conv_id", "turn", "role", screens.local_answer(F.col("text")).alias("hint"))


@query("SELECT client_id, task_id, CASE status WHEN 'OPEN' THEN 1 WHEN 'IN_PROGRESS' THEN 2 ELSE 3 END AS state_order, row_number() OVER (PARTITION BY client_id ORDER BY CASE status WHEN 'OPEN' THEN 1 WHEN 'IN_PROGRESS' THEN 2 ELSE 3 END, priority, created_at DESC, task_id) AS position FROM {task}")
def o3_task_order(t: Tables) -> DataFrame:
    """O3: each client's tasks by state, priority and age."""
    rows = screens.task_order(t.task)
    return positions(rows, "client_id", [F.col("state_order"), F.col("priority"), F.desc("created_at"), F.col("task_id")]).select("client_id", "task_id", "state_order", "position")


@query(f"SELECT client_id, rows FROM (SELECT DISTINCT client_id FROM {{voucher}}) LEFT JOIN (SELECT client_id, CAST(to_json(list({{'id': voucher_id, 'voucher_type': voucher_type, 'total_debit_p': debit_p, 'avg_confidence': avg_confidence, 'vendor': vendor, 'invoice_number': invoice_number, 'has_unmapped': unmapped}} ORDER BY n)) AS VARCHAR) AS rows FROM (SELECT f.*, vendor, invoice_number, row_number() OVER (PARTITION BY f.client_id ORDER BY created_at DESC, voucher_id) AS n FROM {_FLAGGED} f LEFT JOIN (SELECT invoice_id, vendor, invoice_number FROM {{invoice}}) USING (invoice_id) WHERE status = 'DRAFT') WHERE n <= 20 GROUP BY client_id) USING (client_id)")
def a19_draft_list(t: Tables) -> DataFrame:
    """The newest 20 drafts of each client as JSON."""
    return reports.draft_list(_flagged(t), t.invoice)


@query(f"""
SELECT client_id, count(*) FILTER (WHERE priority = 'high' AND balanced AND NOT unmapped) AS n_high_ready, count(*) FILTER (WHERE priority IN ('critical', 'low')) AS n_needs FROM (SELECT f.client_id, unmapped, abs(debit_p - credit_p) < 1 AS balanced,
  CASE WHEN unmapped OR coalesce(avg_confidence < 0.7, FALSE) OR is_duplicate OR n_flags > 0 THEN CASE WHEN unmapped OR coalesce(avg_confidence < 0.5, FALSE) THEN 'critical' ELSE 'low' END WHEN avg_confidence >= 0.9 THEN 'high' ELSE 'ready' END AS priority
  FROM {_FLAGGED} f JOIN (SELECT invoice_id, is_duplicate, n_flags FROM {{invoice}}) USING (invoice_id) WHERE status = 'DRAFT') GROUP BY client_id
""")
def a18_high_ready(t: Tables) -> DataFrame:
    """Drafts that are sure and balanced, and those that need a look."""
    reviewed = reports.review_priority(t.invoice, _flagged(t))
    needs = reports.review_filter(reviewed, "needs").groupBy("client_id").agg(F.count("*").alias("n_needs"))
    return reports.high_ready(reviewed).join(needs, "client_id", "left").withColumn("n_needs", F.coalesce("n_needs", F.lit(0)))


@query(_CHECKS + "SELECT j.invoice_id, least(8, count(code)) AS n_shown FROM j LEFT JOIN codes USING (invoice_id) GROUP BY j.invoice_id")
def l4_first_issues(t: Tables) -> DataFrame:
    """L4: how many issues of each invoice are shown."""
    return screens.first_issues(_validated(t)).select("invoice_id", F.size("issues").cast("long").alias("n_shown"))


@query("SELECT client_id, query, EXISTS (SELECT 1 FROM {ledger} l WHERE l.client_id = q.client_id AND lower(l.name) = lower(trim(query))) AS taken FROM (SELECT c_nationkey AS client_id, ' ' || upper(name) || CASE WHEN ledger_id % 3 = 0 THEN ' new' ELSE '  ' END AS query FROM {ledger} JOIN {customer} ON c_custkey = ledger_id) q")
def f12_name_taken(t: Tables) -> DataFrame:
    """whether a ledger of just that name exists."""
    asked = t.ledger.select("client_id", F.concat(F.lit(" "), F.upper("name"), F.when(F.col("ledger_id") % 3 == 0, " new").otherwise("  ")).alias("query"))
    return screens.name_taken(asked, t.ledger)


@query(f"""
WITH s AS (SELECT conv_id, CASE WHEN role = 'user' THEN 'waiting' ELSE 'resolved' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM {{conversations}}) WHERE n = 1),
th AS (SELECT *, contains(lower(client_name), 'an') OR contains(lower(coalesce(invoice_number, '')), 'an') AS found FROM {{thread}} JOIN s USING (conv_id))
SELECT 'unread' AS list, conv_id FROM th WHERE found AND unread > 0 UNION ALL SELECT 'needs_reply', conv_id FROM th WHERE found AND status = 'waiting' UNION ALL SELECT 'resolved', conv_id FROM th WHERE found AND status = 'resolved'
UNION ALL SELECT 'pinned', conv_id FROM th WHERE contains(lower(client_name), 'a') AND pinned UNION ALL SELECT 'invite', conv_id FROM (SELECT DISTINCT conv_id FROM {{conversations}}) c WHERE NOT EXISTS (SELECT 1 FROM {{conversations}} x WHERE x.conv_id = c.conv_id AND role = 'system')
""")
def f13_thread_filters(t: Tables) -> DataFrame:
    """Thread lists by search and state, pinned groups, and who may still be invited."""
    last = t.conversations.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))).where("n = 1").select("conv_id", F.when(F.col("role") == "user", "waiting").otherwise("resolved").alias("status"))
    threads = t.thread.join(last, "conv_id")
    lists = [screens.thread_filter(threads, "AN", which).select(F.lit(name).alias("list"), "conv_id") for name, which in (("unread", "Unread"), ("needs_reply", "Needs Reply"), ("resolved", "Resolved"))]
    groups = screens.group_filter(threads.withColumnRenamed("client_name", "name"), "a", pinned_only=True).select(F.lit("pinned").alias("list"), "conv_id")
    people = t.conversations.select("conv_id", F.lit("system").alias("member")).distinct()
    invited = screens.to_invite(people, t.chat_member, "sys").select(F.lit("invite").alias("list"), "conv_id")
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(groups).unionByName(invited)


@query("SELECT conv_id, count(*) FILTER (WHERE online) AS n_online FROM {chat_member} GROUP BY conv_id")
def a21_online_members(t: Tables) -> DataFrame:
    """Members of each group who are online."""
    return screens.online_members(t.chat_member)


# ---- tables after changes ----


@query("""
SELECT client_id, count(*) AS n, count(*) FILTER (WHERE ledger_id >= 1000000000) AS n_new FROM (SELECT client_id, ledger_id FROM {ledger} UNION ALL SELECT client_id, ledger_id FROM (SELECT client_id, name, min(ledger_id) AS ledger_id FROM
  (SELECT client_id, trim(name || CASE ledger_id % 3 WHEN 0 THEN ' (new)' ELSE ' ' END) AS name, 1000000000 + ledger_id AS ledger_id FROM {ledger}) GROUP BY ALL) w WHERE NOT EXISTS (SELECT 1 FROM {ledger} l WHERE l.client_id = w.client_id AND l.name = w.name)) GROUP BY client_id
""")
def m9_ledger_upsert(t: Tables) -> DataFrame:
    """M9: ledgers made where their client has none of that name."""
    wanted = t.ledger.withColumns({"name": F.concat("name", F.when(F.col("ledger_id") % 3 == 0, " (new)").otherwise(" ")), "ledger_id": F.col("ledger_id") + 1_000_000_000})
    return tables.upsert_ledgers(t.ledger, wanted).groupBy("client_id").agg(F.count("*").alias("n"), F.count_if(F.col("ledger_id") >= 1_000_000_000).alias("n_new"))


@query("SELECT task_id, client_id, title, CASE WHEN task_id % 5 = 0 THEN 'DONE' ELSE status END AS status, priority FROM {task} WHERE task_id % 7 <> 0 UNION ALL SELECT -task_id - 1, client_id, 'call back', 'OPEN', 2 FROM {task} WHERE task_id % 11 = 0")
def m10_tasks(t: Tables) -> DataFrame:
    """Tasks after creations, changes of state and deletions."""
    k, table = F.col("task_id"), t.task.select("task_id", "client_id", "title", "status", "priority")
    made = table.where(k % 11 == 0).select((-k - 1).alias("task_id"), "client_id", F.lit("call back").alias("title"), F.lit("OPEN").alias("status"), F.lit(2).alias("priority"))
    return tables.applied(table, "task_id", made, table.where(k % 5 == 0).select("task_id", F.lit("DONE").alias("status"), F.lit(None).cast("string").alias("title")), table.where(k % 7 == 0))


@query("""
WITH c AS (SELECT client_id, user_id, name, is_default FROM {client} WHERE user_id <> 3 UNION ALL SELECT -1 - user_id, user_id, 'Default Client', TRUE FROM (SELECT DISTINCT user_id FROM {client} WHERE user_id = 3)),
d AS (SELECT user_id, client_id AS default_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_default DESC, client_id) AS n FROM c) WHERE n = 1)
SELECT invoice_id, CASE WHEN invoice_id % 2 = 0 THEN default_id ELSE client_id END AS client_id FROM {invoice} LEFT JOIN d USING (user_id)
""")
def m11_backfill(t: Tables) -> DataFrame:
    """A default client for users without any, and rows without a client given to their user's."""
    clients = tables.with_default_clients(t.client.select("user_id"), t.client.where("user_id <> 3"))
    rows = t.invoice.select("invoice_id", "user_id", F.when(F.col("invoice_id") % 2 != 0, F.col("client_id")).alias("client_id"))
    return tables.backfilled(rows, clients).select("invoice_id", "client_id")


# ---- drafts and persisted tables ----

_BASE = """base AS (SELECT i.*, CASE WHEN i.invoice_id % 17 = 0 OR document_type = 'SALES' THEN 'SALE' WHEN document_type = 'CREDIT_NOTE' THEN 'CREDIT_NOTE' WHEN document_type = 'DN' THEN 'DEBIT_NOTE' ELSE 'PURCHASE' END AS kind, coalesce(v.voucher_id, i.invoice_id) AS voucher_id
  FROM {invoice} i LEFT JOIN (SELECT voucher_id, invoice_id, status AS old FROM {voucher}) v ON v.invoice_id = i.invoice_id WHERE old IS NULL OR old = 'DRAFT')"""


def _overrides(t: Tables) -> DataFrame:
    i = F.col("invoice_id")
    return t.invoice.select("invoice_id", F.when(i % 17 == 0, "SALE").alias("new_type"), F.when(i % 23 == 1, i % 150).cast("long").alias("party_ledger"), (i % 19 == 0).alias("force_new_party")).where("new_type IS NOT NULL OR party_ledger IS NOT NULL OR force_new_party")


def _ledgers_with_seed(t: Tables) -> DataFrame:
    """The ledgers and for each client those that the fixed names find."""
    names = [("CGST Input", "TAX_INPUT"), ("SGST Input", "TAX_INPUT"), ("IGST Input", "TAX_INPUT"), ("CGST Output", "TAX_OUTPUT"), ("SGST Output", "TAX_OUTPUT"), ("IGST Output", "TAX_OUTPUT"), ("Discount Received", "INCOME"), ("Discount Allowed", "EXPENSE"), ("Round Off", "ROUND_OFF"), ("Sales Accounts", "SALE")]
    seed = F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lit(n).alias("name"), F.lit(x).alias("ledger_type")) for k, (n, x) in enumerate(names)])
    more = t.client.select("client_id", F.explode(seed).alias("s")).select((F.lit(2_000_000_000).cast("long") + F.col("client_id") * 100 + F.col("s.k")).alias("ledger_id"), "client_id", "s.name", "s.ledger_type", F.lit(None).cast("double").alias("gst_rate"))
    return t.ledger.select("ledger_id", "client_id", "name", "ledger_type", "gst_rate").unionByName(more)


def _drafts(t: Tables) -> DataFrame:
    """Drafts of the columns that drafts and vouchers have; they are stored, so the others would be made for nothing."""
    needed = ["invoice_id", "client_id", "vendor", "vendor_gstin", "invoice_number", "invoice_date", "created_at", "document_type", "subtotal", "cgst", "sgst", "igst", "discount", "total_amount", "status"]
    return drafts.draft_vouchers(t.invoice.select(*needed), t.invoice_item, t.voucher, t.mapping_rule, t.memory, _ledgers_with_seed(t), _overrides(t))


@query(f"""
WITH {_BASE}, resolved AS {inner('v4_party_resolution')}, coded AS {inner('v4c_item_ledgers')},
items AS (SELECT b.invoice_id, CAST(sum(CASE WHEN x.price > 0 THEN CASE WHEN kind = 'PURCHASE' OR item_via = 'RULE' THEN coalesce(item_percent, 0) ELSE 50 END ELSE 0 END) AS BIGINT) AS item_percent, count(*) FILTER (WHERE price > 0) AS n_items
  FROM base b JOIN {{invoice_item}} x ON x.invoice_id = b.invoice_id LEFT JOIN coded c ON c.client_id = b.client_id AND c.hsn_code IS NOT DISTINCT FROM x.hsn_code AND c.gst_rate IS NOT DISTINCT FROM x.gst_rate GROUP BY b.invoice_id)
SELECT b.invoice_id, b.voucher_id, kind AS voucher_type, CASE WHEN b.invoice_id % 19 = 0 THEN NULL ELSE coalesce(h.ledger_id, p.ledger_id) END AS party_ledger, CASE WHEN b.invoice_id % 19 = 0 THEN NULL WHEN h.ledger_id IS NOT NULL THEN 10000 ELSE p.confidence END AS party_sure,
  CASE WHEN b.invoice_id % 19 = 0 THEN NULL WHEN h.ledger_id IS NOT NULL THEN 'MANUAL' ELSE p.via END AS party_via, CASE WHEN invoice_number <> '' THEN 'Inv ' || invoice_number END AS narration, coalesce(item_percent, 0) AS item_percent, coalesce(n_items, 0) AS n_items, TRUE AS balanced
FROM base b LEFT JOIN resolved p ON p.client_id = b.client_id AND p.gstin_key IS NOT DISTINCT FROM {NORM_GSTIN('b.vendor_gstin')} AND p.name_key IS NOT DISTINCT FROM {NORM_NAME('b.vendor')}
LEFT JOIN {{ledger}} h ON b.invoice_id % 23 = 1 AND h.client_id = b.client_id AND h.ledger_id = b.invoice_id % 150 LEFT JOIN items USING (invoice_id)
""")
def v6_drafts(t: Tables) -> DataFrame:
    """V6, M7: drafts of all invoices without a final voucher: types switched, parties resolved, by hand or refused, items resolved, built."""
    item = F.filter("lines", lambda x: (x.role == "ITEM") & x.hsn_code.isNotNull() | (x.role == "ITEM") & (F.size("items") > 0))
    percent = F.aggregate(item, F.lit(0).cast("long"), lambda acc, x: acc + F.round(F.coalesce(x.confidence, F.lit(0.0)) * 100).cast("long"))
    return _drafts(t).select(
        "invoice_id", "voucher_id", "voucher_type", "party_ledger", F.floor(F.lit(10000) * F.col("party_confidence") + F.lit(0.5)).cast("long").alias("party_sure"), "party_via", "narration",
        F.coalesce(percent, F.lit(0)).alias("item_percent"), F.coalesce(F.size(item), F.lit(0)).cast("long").alias("n_items"), (F.col("total_debit_p") == F.col("total_credit_p")).alias("balanced"),
    )


@query(f"""
WITH {_BASE} SELECT voucher_id, client_id, voucher_type, status, n_kept FROM (SELECT v.voucher_id, v.client_id, v.voucher_type, v.status FROM {{voucher}} v WHERE status <> 'DRAFT' UNION ALL SELECT voucher_id, client_id, kind, 'DRAFT' FROM base)
LEFT JOIN (SELECT voucher_id, count(*) AS n_kept FROM {{voucher_line}} JOIN (SELECT voucher_id FROM {{voucher}} WHERE status <> 'DRAFT') USING (voucher_id) GROUP BY voucher_id) USING (voucher_id)
""")
def k5_voucher_tables(t: Tables) -> DataFrame:
    """K5: the vouchers after the drafts, and how many lines those keep that were not rebuilt."""
    made = _drafts(t)
    after, lines = drafts.voucher_tables(made, t.voucher, t.voucher_line)
    kept = lines.join(t.voucher.where("status <> 'DRAFT'").select("voucher_id"), "voucher_id").groupBy("voucher_id").agg(F.count("*").alias("n_kept"))
    return after.select("voucher_id", "client_id", "voucher_type", "status").join(kept, "voucher_id", "left")


@query(_GREEDY + f"""
SELECT client_id, count(row_id) AS row_count, count(*) FILTER (WHERE status = 'MATCHED') AS n_matched, count(*) FILTER (WHERE status = 'VALUE_MISMATCH') AS n_value_mismatch, count(*) FILTER (WHERE status = 'MISSING_IN_2B') AS n_missing_in_2b, count(*) FILTER (WHERE status = 'MISSING_IN_BOOKS') AS n_missing_in_books,
  CAST(coalesce(sum({P('dy')}) FILTER (WHERE status <> 'MATCHED'), 0) AS BIGINT) AS itc_at_risk_p FROM res GROUP BY client_id
""")
def k6_recon_header(t: Tables) -> DataFrame:
    """K6: the counts that a run's header has."""
    rows, books = _recon_sides(t)
    results = stored(reconcile.reconcile(rows, books), "results")
    return results.groupBy("client_id").agg(F.count("row_id").alias("row_count")).join(reconcile.summary(results).drop("itc_eligible_p"), "client_id")


_SAID = NARRATION.replace("{0}", "CASE WHEN description = '' THEN 'Transaction' ELSE description END")


@query(f"WITH v9 AS {inner('v9_bank_classification')}, v10 AS {inner('v10_narration_memory')} SELECT b.statement_id, b.sort_order, voucher_type, memory_ledger AS ledger_id, coalesce(thousandths, percent * 10) AS thousandths FROM (SELECT *, " + _SAID + " AS key FROM {bank_txn}) b JOIN v9 USING (txn_id) LEFT JOIN v10 ON v10.client_id = b.statement_id % 25 AND v10.key = b.key")
def k7_statement_txns(t: Tables) -> DataFrame:
    """K7: statements as JSON become numbered, classified transactions with the ledger that memory suggests, whose confidence then counts; written, and read back."""
    f = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    txn = F.struct("sort_order", F.col("description"), f("withdrawal").alias("withdrawal"), f("deposit").alias("deposit"))
    payloads = t.bank_txn.groupBy("statement_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(txn)).alias("transactions"))).alias("payload"))
    k = F.col("ledger_id") % 4
    memory = t.ledger.select("client_id", F.when(k == 0, "acme nova").when(k == 1, "bharat royal").when(k == 2, "coral").otherwise("atm wdl").alias("match_key"), "ledger_id", (F.col("ledger_id") % 20).cast("int").alias("hit_count"))
    header, txns = bank.statement_tables(payloads.withColumn("client_id", F.col("statement_id") % 25), memory)
    path = new_path(t.ledger.sparkSession, "statements")
    drafts.write_tables({"txns": txns, "header": header}, path)
    out = t.ledger.sparkSession.read.parquet(f"{path}/txns")
    return out.select("statement_id", "sort_order", "voucher_type", "ledger_id", F.floor(F.lit(1000) * F.col("confidence") + F.lit(0.5)).cast("long").alias("thousandths"))


@query(f"""
WITH v4 AS {inner('v4_party_resolution')}, v4b AS {inner('v4b_party_suggestion')} SELECT v4.client_id, gstin_key, v4.name_key, v4.ledger_id, CASE WHEN v4.ledger_id IS NULL THEN v4b.ledger_id END AS suggested, CASE WHEN v4.ledger_id IS NULL THEN v4b.score END AS score
FROM v4 LEFT JOIN v4b ON v4b.client_id = v4.client_id AND v4b.name_key = v4.name_key
""")
def v4b_behind_v4(t: Tables) -> DataFrame:
    """The ledger of each party, and the lenient suggestion where there is none."""
    c = F.col
    out = ledgers.suggested(ledgers.resolve_parties(ledgers.party_keys(t.invoice), t.mapping_rule, t.memory, t.ledger), ledgers.candidates_of(t.memory, t.ledger))
    return out.select("client_id", "gstin_key", "name_key", "ledger_id", c("suggested_ledger").alias("suggested"), F.floor(F.lit(10000) * c("suggested_score") + F.lit(0.5)).cast("long").alias("score"))
