"""What lists, cards and detail views show: defaults, labels and small counts, all as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.functions import values as V

NO_NUMBER = "—"
# The order of task states, and how many of an invoice's issues are shown.
TASK_STATES = ("OPEN", "IN_PROGRESS", "DONE")
MOST_ISSUES = 8


def filled(v: Column, other: str) -> Column:
    """A default for null and for empty text."""
    return F.coalesce(F.nullif(v, F.lit("")), F.lit(other))


def list_rows(vouchers: DataFrame, invoices: DataFrame) -> DataFrame:
    """The rows of voucher lists: only a missing vendor or number has a default, empty text stays; strict_* also replace empty text, as the review list does."""
    out = vouchers.join(invoices.select("invoice_id", "vendor", "invoice_number"), "invoice_id", "left")
    return out.select(
        "client_id", "voucher_id", F.coalesce("vendor", F.lit("Unknown")).alias("vendor"), F.coalesce("invoice_number", F.lit(NO_NUMBER)).alias("invoice_number"), F.col("debit_p").alias("amount_p"),
        filled(F.col("vendor"), "Unknown").alias("strict_vendor"), filled(F.col("invoice_number"), NO_NUMBER).alias("strict_number"),
    )


def cards(rows: DataFrame, key: str, amount: str, link: Column) -> DataFrame:
    """P5: the card of an invoice or voucher: title, subtitle (number, else the first 8 characters of the id), amount and link."""
    return rows.select(F.col(key).alias("id"), filled(F.col("vendor"), "Unknown").alias("title"), F.coalesce(F.nullif("invoice_number", F.lit("")), F.substring(F.col(key).cast("string"), 1, 8)).alias("subtitle"), F.col(amount).alias("amount"), link.alias("link"))


def item_amount(x: Column, *names: str) -> Column:
    """P10: the first amount that is there, of debit, price, amount, total and credit, else 0; x: a struct that has those of names."""
    return F.coalesce(*[x[n].cast("double") for n in ("debit", "price", "amount", "total", "credit") if n in names], F.lit(0.0))


def item_label(x: Column, *names: str) -> Column:
    """P10: the first name that is there, of selected_item_name, item_name, name and description, trimmed; `Item` for none or blank."""
    first = F.coalesce(*[x[n] for n in ("selected_item_name", "item_name", "name", "description") if n in names], F.lit("Item"))
    return F.coalesce(T.blank_to_null(first), F.lit("Item"))


def item_labels(items: Column, *names: str) -> Column:
    """The distinct labels of an invoice's items, in the order in which they are first seen."""
    return F.array_distinct(F.transform(items, lambda x: item_label(x, *names)))


def shown_items(items: Column, extracted: Column) -> Column:
    """An invoice's own items, else those that were extracted, else none."""
    return F.coalesce(items, extracted, F.array().cast("array<struct<name:string,price:double>>"))


def shown_amount(v: Column) -> Column:
    """An amount as text with two decimals, `-` where it is missing or no number."""
    number = F.regexp_extract(v.cast("string"), r"^\s*(-?(?:\d+\.?\d*|\.\d+))", 1)
    return F.coalesce(V.two_places(V.to_paise(F.nullif(number, F.lit("")).try_cast("double"))), F.lit("-"))


def with_item_names(items: Column, chosen: Column, *names: str) -> Column:
    """Items with selected_item_name: the name chosen for the place, else the label."""
    return F.transform(items, lambda x, i: x.withField("selected_item_name", F.coalesce(F.nullif(F.try_element_at(chosen, i + 1), F.lit("")), item_label(x, *names))))


def patched(invoices: DataFrame, updates: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Invoices after edits (invoice_id and new values, all null where not given; columns that the edits lack are as not given).

    Numbers and the invoice's number keep the old value for nothing, empty text and zero; the date for nothing and empty text, and other text that is no date becomes as_of; names,
    registrations, address and phone keep it only for nothing; items for no list at all; total and tax are always overwritten, by 0 if not given.
    """
    out = invoices.join(updates.withColumnsRenamed({c: f"_{c}" for c in updates.columns if c != "invoice_id"}).withColumn("_hit", F.lit(True)), "invoice_id", "left")
    new = lambda c: F.col(f"_{c}")
    given = lambda *names: [c for c in names if c in updates.columns and c in invoices.columns]
    merged = {c: F.coalesce(new(c), F.col(c)) for c in given("vendor", "vendor_gstin", "vendor_address", "vendor_phone", "customer_name", "customer_gstin", "items")}
    merged |= {c: F.coalesce(F.nullif(V.clean_money(new(c)), F.lit(0.0)), F.col(c)) for c in given("subtotal", "cgst", "sgst", "igst", "discount")}
    merged |= {c: F.coalesce(F.nullif(new(c), F.lit("")), F.col(c)) for c in given("invoice_number")}
    merged |= {c: F.when(new(c) != "", V.clean_date(new(c), F.current_timestamp() if as_of is None else as_of)).otherwise(F.col(c)) for c in given("invoice_date")}
    merged |= {c: F.when(F.col("_hit"), V.clean_money(new(c) if c in updates.columns else F.lit(None).cast("double"))).otherwise(F.col(c)) for c in ("total_amount", "tax_amount")}
    return out.withColumns(merged).select(*invoices.columns)


def chat_context(clients: DataFrame, invoices: DataFrame, vouchers: DataFrame, uploads: DataFrame) -> DataFrame:
    """Each client's line of context: invoices, drafts, tax and the latest run's credit at risk, in paise."""
    i = invoices.groupBy("client_id").agg(F.count("*").alias("i"), F.sum(V.to_paise(F.coalesce("tax_amount", F.lit(0.0)))).alias("tax"))
    v = vouchers.where("status = 'DRAFT'").groupBy("client_id").agg(F.count("*").alias("d"))
    u = uploads.groupBy("client_id").agg(F.max_by("itc_at_risk_p", F.struct("created_at", "upload_id")).alias("risk"))
    out = clients.join(i, "client_id", "left").join(v, "client_id", "left").join(u, "client_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    said = F.concat(
        F.lit("[Active client: "), "name", F.lit(". Invoices: "), n("i").cast("string"), F.lit(". Draft vouchers: "), n("d").cast("string"), F.lit(". ITC (tax sum): ₹"), V.two_places(n("tax")),
        F.lit(". Latest 2B ITC at risk: ₹"), V.two_places(n("risk")), F.lit(".]"),
    )
    return out.select("client_id", said.alias("context"))


def local_answer(message: Column) -> Column:
    """Which hint answers a question by its words: recon, reports or none."""
    m = F.lower(message)
    return F.when(m.contains("itc"), "recon").when(m.contains("unpaid") | m.contains("outstanding"), "reports")


def task_order(tasks: DataFrame) -> DataFrame:
    """O3: tasks by state in its declared order, then priority, then the newest."""
    return tasks.withColumn("state_order", F.array_position(F.array(*map(F.lit, TASK_STATES)), F.col("status")).cast("int")).orderBy("client_id", "state_order", "priority", F.desc("created_at"), "task_id")


def first_issues(validated: DataFrame, most: int = MOST_ISSUES) -> DataFrame:
    """L4: the first issues of each invoice, in the order of the checks."""
    return validated.withColumn("issues", F.slice("issues", 1, most))


def name_taken(asked: DataFrame, ledgers: DataFrame) -> DataFrame:
    """asked (client_id, query) with whether a ledger of the client has just that name, in any case and without white space at the ends."""
    have = ledgers.select("client_id", F.lower("name").alias("_key")).distinct().withColumn("_there", F.lit(True))
    return asked.withColumn("_key", F.lower(T.trimmed(F.col("query")))).join(have, ["client_id", "_key"], "left").withColumn("taken", F.coalesce("_there", F.lit(False))).drop("_key", "_there")


def thread_filter(threads: DataFrame, search: str, which: str) -> DataFrame:
    """threads by text in the client's name or the invoice number, and by All, Unread, Needs Reply or Resolved."""
    found = F.lower("client_name").contains(search.lower()) | F.lower(F.coalesce("invoice_number", F.lit(""))).contains(search.lower())
    kept = {"All": F.lit(True), "Unread": F.col("unread") > 0, "Needs Reply": F.col("status") == "waiting", "Resolved": F.col("status") == "resolved"}[which]
    return threads.where(found & kept)


def group_filter(groups: DataFrame, search: str, pinned_only: bool) -> DataFrame:
    """groups by text in their name, all or the pinned ones."""
    found = F.lower("name").contains(search.lower())
    return groups.where(found & F.col("pinned") if pinned_only else found)


def to_invite(people: DataFrame, members: DataFrame, search: str) -> DataFrame:
    """People (conv_id, member) whose name has the text and who are not members yet."""
    return people.where(F.lower("member").contains(search.lower())).join(members.select("conv_id", "member"), ["conv_id", "member"], "left_anti")


def online_members(members: DataFrame) -> DataFrame:
    """How many members of each group are online."""
    return members.groupBy("conv_id").agg(F.count_if("online").alias("n_online"))
