"""Dashboards, registers and boards over invoices, vouchers and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vahi.functions import values as V
from vahi.operators.order import earlier_sums, positions
from vahi.operators.vouchers import is_purchase_report


def _paise(name: str) -> Column:
    return V.to_paise(F.coalesce(F.col(name), F.lit(0.0)))


def vendor_breakdown(invoices: DataFrame, scope: str = "user_id") -> DataFrame:
    """A5: invoices, paise and mean paise (halves up) of each vendor of each user (or other scope); no name is `Unknown`."""
    out = invoices.groupBy(scope, F.coalesce(F.nullif("vendor", F.lit("")), F.lit("Unknown")).alias("vendor")).agg(F.count("*").alias("n"), F.sum(_paise("total_amount")).alias("total_p"), F.sum(_paise("tax_amount")).alias("tax_p"))
    return out.withColumn("mean_p", F.floor(F.col("total_p") / F.col("n") + F.lit(0.5)).cast("long"))


def invoice_summary(invoices: DataFrame, scope: str) -> DataFrame:
    """Count, totals and distinct vendors of each user or client."""
    return invoices.groupBy(scope).agg(
        F.count("*").alias("n"), F.sum(_paise("total_amount")).alias("total_p"), F.sum(_paise("tax_amount")).alias("tax_p"), F.countDistinct(F.when(F.col("vendor") != "", F.col("vendor"))).alias("n_vendors"),
    ).withColumn("mean_p", F.floor(F.col("total_p") / F.col("n") + F.lit(0.5)).cast("long"))


def monthly(invoices: DataFrame) -> DataFrame:
    """A4: paise of each client's months, by the invoice's date or when it came."""
    return invoices.groupBy("client_id", V.month_key(F.coalesce("invoice_date", "created_at")).alias("month")).agg(F.sum(_paise("total_amount")).alias("total_p"), F.count("*").alias("n"))


def register(vouchers: DataFrame, invoices: DataFrame, purchases: bool) -> DataFrame:
    """The purchase register, or the outward one, whose party is the customer if named and whose registration falls back to the vendor's. Vouchers without invoice stay."""
    kind = is_purchase_report(F.col("voucher_type")) if purchases else F.col("voucher_type").isin("SALE", "CREDIT_NOTE")
    party = F.col("vendor") if purchases else F.coalesce(F.nullif("customer_name", F.lit("")), F.col("vendor"))
    gstin = F.col("vendor_gstin") if purchases else F.coalesce(F.nullif("customer_gstin", F.lit("")), F.col("vendor_gstin"))
    return vouchers.where(kind).join(invoices.drop("client_id", "created_at", "status"), "invoice_id", "left").select(
        "client_id", "voucher_id", "voucher_date", party.alias("party"), gstin.alias("gstin"), "invoice_number",
        *[_paise(c).alias(f"{c}_p") for c in ("subtotal", "cgst", "sgst", "igst")], F.coalesce(F.nullif(_paise("total_amount"), F.lit(0)), F.col("debit_p")).alias("total_p"),
    )


def _with_party(vouchers: DataFrame, lines: DataFrame) -> DataFrame:
    """Vouchers with p, the name and credit of their party's line, and owed_p: that credit, else the voucher's, else 0."""
    party = lines.where("role = 'PARTY'").groupBy("voucher_id").agg(F.min_by(F.struct("ledger_name", "credit_p"), "sort_order").alias("p"))
    owed = F.coalesce(F.nullif("p.credit_p", F.lit(0)), F.nullif("credit_p", F.lit(0)), F.lit(0))
    return vouchers.join(party, "voucher_id", "left").withColumn("owed_p", owed)


def party_outstanding(vouchers: DataFrame, lines: DataFrame, invoices: DataFrame, most: int = 20) -> DataFrame:
    """Each client's parties of purchases that are owed most, with their place; the party's line, else the vendor, names one."""
    out = _with_party(vouchers.where(is_purchase_report(F.col("voucher_type"))), lines).join(invoices.select("invoice_id", "vendor"), "invoice_id", "left")
    name = F.coalesce(F.nullif("p.ledger_name", F.lit("")), F.nullif("vendor", F.lit("")), F.lit("Unknown"))
    owed = out.groupBy("client_id", name.alias("party")).agg(F.sum("owed_p").alias("owed_p"))
    return owed.withColumn("place", F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("owed_p"), "party"))).where(F.col("place") <= most)


def profit_and_loss(vouchers: DataFrame, lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Each client's sketch over all vouchers: assets are the input tax, liabilities what all parties of purchases are owed and the output tax, equity the profit."""
    kind = F.col("voucher_type")
    buys, sells = is_purchase_report(kind), kind.isin("SALE", "CREDIT_NOTE")
    rows = _with_party(vouchers.where(buys | sells), lines).join(invoices.select("invoice_id", "subtotal", "tax_amount"), "invoice_id", "left")
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0))
    out = rows.groupBy("client_id").agg(
        total(sells, _paise("subtotal")).alias("income_p"), total(buys, _paise("subtotal")).alias("expense_p"), total(buys, _paise("tax_amount")).alias("tax_in_p"),
        total(sells, _paise("tax_amount")).alias("tax_out_p"), total(buys, F.col("owed_p")).alias("owed_p"),
    )
    return out.select(
        "client_id", "income_p", "expense_p", "tax_in_p", "tax_out_p", F.col("tax_in_p").alias("assets_p"), (F.col("owed_p") + F.col("tax_out_p")).alias("liabilities_p"), (F.col("income_p") - F.col("expense_p")).alias("equity_p"),
    )


def mapping_accuracy(lines: DataFrame, vouchers: DataFrame) -> DataFrame:
    """Lines by the way they were mapped, and the whole percent mapped without a hand or a default, of each client."""
    auto = F.coalesce(~F.col("mapped_via").isin("MANUAL", "DEFAULT"), F.lit(False))
    rows = lines.join(vouchers.select("voucher_id", "client_id"), "voucher_id").groupBy("client_id")
    ways = ("RULE", "GSTIN_MEMORY", "NAME_MEMORY", "NARRATION_MEMORY", "FUZZY", "MANUAL", "DEFAULT")
    out = rows.agg(F.count("*").alias("n"), F.count_if(auto).alias("n_auto"), F.count_if(F.col("mapped_via").isNull()).alias("n_none"), *[F.count_if(F.col("mapped_via") == w).alias(f"n_{w.lower()}") for w in ways])
    return out.withColumn("accuracy", V.percent(F.col("n_auto"), F.col("n")))


def unmapped_flags(vouchers: DataFrame, lines: DataFrame) -> DataFrame:
    """Vouchers with unmapped: whether some line has no ledger."""
    some = lines.where("ledger_id IS NULL").select("voucher_id").distinct().withColumn("unmapped", F.lit(True))
    return vouchers.join(some, "voucher_id", "left").withColumn("unmapped", F.coalesce("unmapped", F.lit(False)))


def review_priority(invoices: DataFrame, flagged: DataFrame) -> DataFrame:
    """Critical, low, high or ready for each draft."""
    rows = flagged.where("status = 'DRAFT'").select("voucher_id", "invoice_id", "client_id", "avg_confidence", "unmapped", "debit_p", "credit_p", "created_at").join(invoices.select("invoice_id", "is_duplicate", "n_flags"), "invoice_id", "left")
    conf = F.col("avg_confidence")
    needs = F.col("unmapped") | F.coalesce(conf < 0.7, F.lit(False)) | F.coalesce("is_duplicate", F.lit(False)) | (F.coalesce("n_flags", F.lit(0)) > 0)
    worst = F.col("unmapped") | F.coalesce(conf < 0.5, F.lit(False))
    rank = F.when(needs, F.when(worst, "critical").otherwise("low")).otherwise(F.when(conf >= 0.9, "high").otherwise("ready"))
    return rows.withColumns({"priority": rank, "balanced": F.abs(F.col("debit_p") - F.col("credit_p")) < 1})


# The order of the review list.
PRIORITIES = ("critical", "low", "ready", "high")


def review_queue(reviewed: DataFrame) -> DataFrame:
    """Each client's drafts in review order: priority, then confidence with none as 1; of equal ones those with a confidence first, then the newest, then by id.

    Clients of any size are spread over tasks.
    """
    place = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    rows = reviewed.withColumns({"_place": place, "_conf": F.coalesce("avg_confidence", F.lit(1.0))})
    return positions(rows, "client_id", [F.col("_place"), F.col("_conf"), F.col("avg_confidence").asc_nulls_last(), F.desc("created_at"), F.col("voucher_id")]).drop("_place", "_conf")


def review_filter(reviewed: DataFrame, which: str) -> DataFrame:
    """what the list shows: needs (critical and low), high, or all."""
    return reviewed.where({"needs": "priority IN ('critical', 'low')", "high": "priority = 'high'", "all": "true"}[which])


def high_ready(reviewed: DataFrame) -> DataFrame:
    """How many drafts of each client could be approved at once: high, balanced and mapped."""
    return reviewed.groupBy("client_id").agg(F.count_if((F.col("priority") == "high") & F.col("balanced") & ~F.col("unmapped")).alias("n_high_ready"))


def pipeline_board(invoices: DataFrame, flagged: DataFrame) -> DataFrame:
    """How many invoices and vouchers stand in each stage, by client; the two tables are counted independently."""
    waiting = invoices.where("status = 'PENDING'").select("client_id", F.lit("pending").alias("stage"))
    done = invoices.where("status = 'PROCESSED'").join(flagged.select("invoice_id"), "invoice_id", "left_anti").select("client_id", F.lit("processed").alias("stage"))
    s = F.col("status")
    stage = F.when((s == "DRAFT") & ~F.col("unmapped"), "mapped").when(s == "DRAFT", "needs_ledger").when(s == "APPROVED", "approved").when(s.isin("EXPORTED_DEMO", "POSTED"), "exported")
    return waiting.unionByName(done).unionByName(flagged.select("client_id", stage.alias("stage"))).where("stage IS NOT NULL").groupBy("client_id", "stage").agg(F.count("*").alias("n"))


def status_chip(vouchers: DataFrame) -> DataFrame:
    """The label of a voucher in lists, and the badge of the dashboard."""
    conf = F.col("avg_confidence")
    chip = (
        F.when(F.col("is_duplicate"), "Duplicate").when(F.col("status") == "EXPORTED_DEMO", "Exported XML").when(F.col("status") == "APPROVED", "Approved").when(F.col("status").isin("POSTED", "SYNCED"), "Synced")
        .when(F.col("unmapped"), "Needs ledger").when(conf < 0.7, "Low conf.").otherwise("Ready")
    )
    badge = F.when(F.col("unmapped"), "unmapped").when(F.coalesce(conf, F.lit(1.0)) < 0.7, "low").otherwise("ok")
    return vouchers.withColumns({"chip": chip, "badge": badge})


def line_chip(lines: DataFrame) -> DataFrame:
    """How sure a line's ledger is."""
    conf = F.coalesce("confidence", F.lit(0.0))
    return lines.withColumn("chip", F.when(F.col("ledger_id").isNull(), "Needs ledger").when(F.col("mapped_via") == "MANUAL", "Manual").when(conf >= 0.9, "High").when(conf >= 0.6, "Review").otherwise("Low"))


def neighbours(vouchers: DataFrame) -> DataFrame:
    """The draft before and after each draft of a client, newest first. Places are made without a task a client, then rows meet their neighbours' places."""
    placed = positions(vouchers.where("status = 'DRAFT'").select("client_id", "voucher_id", "created_at"), "client_id", [F.desc("created_at"), F.col("voucher_id")])
    at = lambda shift, name: placed.select("client_id", (F.col("position") + shift).alias("position"), F.col("voucher_id").alias(name))
    out = placed.join(at(1, "previous_id"), ["client_id", "position"], "left").join(at(-1, "next_id"), ["client_id", "position"], "left")
    return out.select("client_id", "voucher_id", "previous_id", "next_id")


def dashboard(flagged: DataFrame, invoices: DataFrame, lines: DataFrame, statements: DataFrame, uploads: DataFrame) -> DataFrame:
    """A1, A2: the headline numbers of each client, one pass a table, then joins of one row a client.

    The last three columns are those of the client's latest reconciliation (null without any).
    """
    draft = F.col("status") == "DRAFT"
    v = flagged.groupBy("client_id").agg(
        F.count_if(draft).alias("n_drafts"), F.count_if(F.col("status") == "APPROVED").alias("n_approved"), F.count_if(F.col("status").isin("EXPORTED_DEMO", "POSTED")).alias("n_exported"),
        F.count_if(draft & (F.coalesce(F.col("avg_confidence") < 0.7, F.lit(False)) | F.col("unmapped"))).alias("n_pending_review"),
    )
    kinds = flagged.select("invoice_id", F.col("client_id").alias("_client"), "voucher_type")
    i = invoices.groupBy("client_id").agg(F.count("*").alias("n_invoices"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("voucher_type") == kind, _paise("tax_amount"))), F.lit(0))
    sums = invoices.select("invoice_id", "tax_amount").join(kinds, "invoice_id").groupBy(F.col("_client").alias("client_id")).agg(of("PURCHASE").alias("input_p"), of("SALE").alias("output_p"))
    party = lines.where("role = 'PARTY' AND ledger_id IS NULL").join(flagged.where(draft).select("voucher_id", "client_id"), "voucher_id").groupBy("client_id").agg(F.count("*").alias("n_parties_open"))
    banks = statements.groupBy("client_id").agg(F.count("*").alias("n_statements"))
    latest = uploads.groupBy("client_id").agg(F.max_by(F.struct("itc_at_risk_p", "matched", "mismatched"), F.struct("created_at", "upload_id")).alias("u")).select("client_id", "u.*")
    out = i.join(v, "client_id", "full")
    for x in (sums, party, banks, latest):
        out = out.join(x, "client_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_invoices", "n_drafts", "n_approved", "n_exported", "n_pending_review", "input_p", "output_p", "n_parties_open", "n_statements")}
    return out.withColumns(zero).withColumn("gst_liability_p", F.greatest(F.lit(0), F.col("output_p") - F.col("input_p")))


def draft_list(flagged: DataFrame, invoices: DataFrame, most: int = 20) -> DataFrame:
    """Each client's newest drafts as one JSON array; clients without drafts have an empty one. At most `most` rows a client are gathered."""
    w = Window.partitionBy("client_id").orderBy(F.desc("created_at"), "voucher_id")
    rows = flagged.where("status = 'DRAFT'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).join(invoices.select("invoice_id", "vendor", "invoice_number"), "invoice_id", "left")
    one = F.struct("_n", F.struct(F.col("voucher_id").alias("id"), "voucher_type", F.col("debit_p").alias("total_debit_p"), "avg_confidence", "vendor", "invoice_number", F.col("unmapped").alias("has_unmapped")).alias("row"))
    lists = rows.groupBy("client_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.row), {"ignoreNullFields": "false"}).alias("rows"))
    return flagged.select("client_id").distinct().join(lists, "client_id", "left").withColumn("rows", F.coalesce("rows", F.lit("[]")))


def anomalies(invoices: DataFrame, least: float = 2.5, history: int = 3) -> DataFrame:
    """Each invoice's z-score against the vendor's earlier totals (population deviation; none counts as 1), where there are enough.

    Counts, sums and sums of squares of whole paise are exact decimals, carried over ranges of (client, vendor, time), so equal totals have a deviation of exactly none and no
    vendor's history is one task. Products past 38 digits are made in doubles.
    """
    p = _paise("total_amount")
    rows = invoices.where("vendor <> ''").select("client_id", "vendor", "invoice_id", "created_at", p.alias("p"))
    x = F.col("p").cast("decimal(19,0)")
    out = earlier_sums(rows, ["client_id", "vendor"], [F.col("created_at"), F.col("invoice_id")], {"n": F.lit(1).cast("long"), "s": x, "ss": (x * x).cast("decimal(38,0)")})
    n, s, ss = F.col("n").cast("decimal(19,0)"), F.col("s").cast("decimal(29,0)"), F.col("ss")
    real = lambda c: c.cast("double")
    exact = F.try_subtract(F.try_multiply(n, ss), F.try_multiply(s, s))
    spread = F.coalesce(real(exact), real(n) * real(ss) - real(s) * real(s))
    off = F.coalesce(real(F.try_subtract(F.try_multiply(n, x), s)), real(n) * real(x) - real(s))
    z = F.when(spread > 0, off / F.sqrt(spread)).otherwise(off / F.col("n") / F.lit(100.0))  # a rupee, where there is no deviation
    return out.where(F.col("n") >= history).withColumn("z", z).withColumn("is_anomaly", F.abs("z") >= least).select("client_id", "vendor", "invoice_id", F.col("p").alias("total_p"), "n", "z", "is_anomaly")


def duplicates(keyed: DataFrame) -> DataFrame:
    """Invoices whose duplicate key an earlier one of the client has, with the first one's id."""
    w = Window.partitionBy("client_id", "duplicate_key").orderBy("created_at", "invoice_id")
    out = keyed.where("duplicate_key IS NOT NULL").withColumns({"duplicate_of": F.first("invoice_id").over(w), "nth": F.row_number().over(w)})
    return out.where("nth > 1")
