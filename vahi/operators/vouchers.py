"""Balanced double entry from invoices, gates and state changes of vouchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.functions import values as V

LINE = "struct<role:string,ledger_id:bigint,debit_p:bigint,credit_p:bigint,confidence:double,mapped_via:string,hsn_code:string,gst_rate:double>"


def voucher_type(document_type: Column) -> Column:
    """V3: the type of voucher that a document becomes; unknown documents become purchases."""
    d = F.upper(T.trimmed(F.coalesce(document_type, F.lit(""))))
    return F.when(d.isin("SALE", "SALES", "OUTWARD"), "SALE").when(d.isin("CREDIT_NOTE", "CREDITNOTE", "CN"), "CREDIT_NOTE").when(d.isin("DEBIT_NOTE", "DEBITNOTE", "DN"), "DEBIT_NOTE").otherwise("PURCHASE")


def is_purchase_resolve(kind: Column) -> Column:
    """The purchase side when ledgers are chosen."""
    return kind == "PURCHASE"


def is_purchase_build(kind: Column) -> Column:
    """The purchase side when lines are written."""
    return kind.isin("PURCHASE", "CREDIT_NOTE", "PAYMENT")


def is_purchase_report(kind: Column) -> Column:
    """The purchase side of reports."""
    return kind.isin("PURCHASE", "DEBIT_NOTE")


def _line(role: str, ledger: Column, paise: Column, debit: Column, confidence: Column | None = None, via: Column | None = None, hsn: Column | None = None, rate: Column | None = None) -> Column:
    """One line with the amount on its side; nothing if the amount isn't above 0."""
    zero, none = F.lit(0).cast("long"), F.lit(None)
    extra = [(none if x is None else x).alias(n) for n, x in (("confidence", confidence), ("mapped_via", via), ("hsn_code", hsn), ("gst_rate", rate))]
    return F.when(paise > 0, F.struct(F.lit(role).alias("role"), ledger.cast("long").alias("ledger_id"), F.when(debit, paise).otherwise(zero).alias("debit_p"), F.when(debit, zero).otherwise(paise).alias("credit_p"), *extra).cast(LINE))


ITEM = "array<struct<price:double,ledger_id:bigint,confidence:double,mapped_via:string,hsn_code:string,gst_rate:double>>"


def build_vouchers(invoices: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Add voucher_type, lines, total_debit_p, total_credit_p, round_off_p, has_unmapped, avg_confidence and warnings to invoices with items and ledgers.

    Needs subtotal, cgst, sgst, igst, discount, total_amount, document_type, items (ITEM), party_ledger, party_confidence, party_via and the ledgers
    cgst_ledger, sgst_ledger, igst_ledger, round_off_ledger, discount_ledger; voucher_type, where it is given and not null, goes before the document's.
    Amounts are whole paise; the round-off line makes debits equal credits. One projection.
    """
    p = lambda name: V.to_paise(F.coalesce(F.col(name), F.lit(0.0)))
    by_hand = F.col("voucher_type") if "voucher_type" in invoices.columns else F.lit(None).cast("string")
    out = invoices.withColumn("voucher_type", F.coalesce(by_hand, voucher_type(F.col("document_type"))))
    item_debit, default = is_purchase_build(F.col("voucher_type")), F.lit("DEFAULT")
    has_items = F.coalesce(F.size("items"), F.lit(0)) > 0
    each = F.transform("items", lambda x: _line("ITEM", x.ledger_id, V.to_paise(F.coalesce(x.price, F.lit(0.0))), item_debit, x.confidence, x.mapped_via, x.hsn_code, x.gst_rate))
    whole = F.array(_line("ITEM", F.lit(None), p("subtotal") - p("discount"), item_debit, via=default))  # no items, so no ledger of an item
    igst = p("igst") > 0
    rest = F.array(
        F.when(F.col("discount_ledger").isNotNull(), _line("DISCOUNT", F.col("discount_ledger"), p("discount"), ~item_debit, via=default)),
        _line("IGST", F.col("igst_ledger"), p("igst"), item_debit, via=default),
        F.when(~igst, _line("CGST", F.col("cgst_ledger"), p("cgst"), item_debit, via=default)),
        F.when(~igst, _line("SGST", F.col("sgst_ledger"), p("sgst"), item_debit, via=default)),
        _line("PARTY", F.col("party_ledger"), p("total_amount"), ~item_debit, F.col("party_confidence"), F.col("party_via")),
    )
    out = out.withColumn("lines", F.array_compact(F.concat(F.when(has_items, each).otherwise(whole), rest)))
    total = lambda side: F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + x[side])
    out = out.withColumns({"_debit": total("debit_p"), "_credit": total("credit_p")})
    out = out.withColumn("round_off_p", F.col("_debit") - F.col("_credit"))
    off = _line("ROUND_OFF", F.col("round_off_ledger"), F.abs("round_off_p"), F.col("round_off_p") < 0, via=default)
    out = out.withColumn("lines", F.array_compact(F.concat("lines", F.array(off))))
    unmapped = F.col("party_ledger").isNull() | F.when(has_items, F.exists("items", lambda x: x.ledger_id.isNull())).otherwise(F.lit(True))
    warnings = F.array_compact(F.array(
        F.when(igst & ((p("cgst") > 0) | (p("sgst") > 0)), F.lit("integrated tax beside central or state tax")),
        F.when(F.abs("round_off_p") > int(tolerance * 100), F.lit("round-off above the tolerance")),
    ))
    sure = F.filter(F.transform("lines", lambda x: x.confidence), lambda c: c.isNotNull())
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda acc, c: acc + c) / F.size(sure))
    more = lambda side: F.greatest(side, F.lit(0).cast("long"))
    debit, credit = F.col("_debit") + more(-F.col("round_off_p")), F.col("_credit") + more(F.col("round_off_p"))  # those of the round-off line too, without another walk of the lines
    return out.withColumns({"total_debit_p": debit, "total_credit_p": credit, "has_unmapped": unmapped, "avg_confidence": mean, "warnings": warnings}).drop("_debit", "_credit")


def lines_of(built: DataFrame, *keep: str) -> DataFrame:
    """One row a line of built vouchers, beside the columns to keep.

    The outer form is used since Spark puts a filter on the array below the plain one, where the whole expression of the lines takes the column's place, once for each use; a voucher without lines gives no row.
    """
    return built.select(*keep, F.posexplode_outer("lines").alias("sort_order", "line")).where("line IS NOT NULL").select(*keep, "sort_order", "line.*")


def gate(vouchers: DataFrame, lines: DataFrame) -> DataFrame:
    """Add unmapped (any line without a ledger; none without lines) and unbalanced: what approval asks. Lines are summed before the join."""
    sums = lines.groupBy("voucher_id").agg(F.max(F.col("ledger_id").isNull()).alias("unmapped"))
    out = vouchers.join(sums, "voucher_id", "left").withColumn("unmapped", F.coalesce("unmapped", F.lit(False)))
    return out.withColumn("unbalanced", F.abs(F.col("debit_p") - F.col("credit_p")) > 1)


def bulk_approve(gated: DataFrame, only_high: bool = False) -> DataFrame:
    """M1, M2: drafts with the reason why they stay (unmapped, unbalanced, low confidence, in that order) or none, and the new status."""
    low = F.lit(only_high) & (F.coalesce("avg_confidence", F.lit(0.0)) < 0.9)
    reason = F.when(F.col("unmapped"), "unmapped").when(F.col("unbalanced"), "unbalanced").when(low, "low_confidence")
    out = gated.where("status = 'DRAFT'").withColumn("reason", reason)
    return out.withColumn("new_status", F.when(F.col("reason").isNull(), "APPROVED").otherwise(F.col("status")))


def approval_events(approved: DataFrame, lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """What approvals teach (client_id, match_type, match_key, ledger_id, at): the ledger of each approved voucher's first party line, under its invoice's registration and vendor name.

    Vouchers without invoice, without party line, or whose party has no ledger teach nothing; so do blank keys. at: the voucher's id, for approvals come in that order.
    """
    party = lines.where("role = 'PARTY'").groupBy("voucher_id").agg(F.min_by(F.struct("ledger_id"), "sort_order").alias("p")).where("p.ledger_id IS NOT NULL")
    rows = approved.where("new_status = 'APPROVED'").select("voucher_id", "client_id", "invoice_id").join(party, "voucher_id").join(invoices.select("invoice_id", "vendor", "vendor_gstin"), "invoice_id")
    key = lambda kind, v: F.struct(F.lit(kind).alias("match_type"), v.alias("match_key"))
    keys = F.array(key("GSTIN", T.norm_gstin(F.col("vendor_gstin"))), key("VENDOR_NAME", T.norm_name(F.col("vendor"))))
    return rows.select("client_id", F.explode(keys).alias("k"), F.col("p.ledger_id").alias("ledger_id"), F.col("voucher_id").alias("at")).select("client_id", "k.*", "ledger_id", "at").where("match_key <> ''")


def auto_approve(gated: DataFrame, threshold: float = 0.9) -> DataFrame:
    """M3: drafts with at least this confidence, nulls left out."""
    return bulk_approve(gated.where(F.col("avg_confidence") >= threshold))


def remapped(lines: DataFrame, updates: DataFrame, vouchers: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Lines with updates (voucher_id, sort_order, new_ledger) applied: a ledger by hand has confidence 1, none clears the mapping.

    Updates of unknown lines fall away, and so do those whose ledger is not one of the voucher's client. The header's confidence is not touched.
    """
    owned = updates.join(vouchers.select("voucher_id", "client_id"), "voucher_id").join(ledgers.select("client_id", F.col("ledger_id").alias("new_ledger"), F.col("name").alias("_name"), F.lit(True).alias("_known")), ["client_id", "new_ledger"], "left")
    valid = owned.where("new_ledger IS NULL OR _known").select("voucher_id", "sort_order", "new_ledger", "_name", F.lit(True).alias("_hit"))
    out = lines.join(valid, ["voucher_id", "sort_order"], "left")
    hit, new = F.coalesce("_hit", F.lit(False)), F.col("new_ledger")
    return out.select(
        "voucher_id", "sort_order", "role", F.when(hit, new).otherwise(F.col("ledger_id")).alias("ledger_id"), F.when(hit, F.col("_name")).otherwise(F.col("ledger_name")).alias("ledger_name"), "debit_p", "credit_p",
        F.when(hit, F.when(new.isNotNull(), "MANUAL")).otherwise(F.col("mapped_via")).alias("mapped_via"), F.when(hit, F.when(new.isNotNull(), 1.0)).otherwise(F.col("confidence")).alias("confidence"),
    )


def exported(vouchers: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The vouchers with approved ones (of these ids, if given) marked exported, and the audit: one row a voucher with the client's count.

    Exporting again is allowed. The audit keeps ids as rows, so a large client's list is never gathered.
    """
    chosen = F.col("status").isin("APPROVED", "EXPORTED_DEMO")
    if ids is not None:
        vouchers = vouchers.join(ids.select("voucher_id").distinct().withColumn("_asked", F.lit(True)), "voucher_id", "left")
        chosen &= F.coalesce("_asked", F.lit(False))
    out = vouchers.withColumns({"_chosen": chosen, "status": F.when(chosen, "EXPORTED_DEMO").otherwise(F.col("status"))})
    some = out.where("_chosen")
    audit = some.select("client_id", "voucher_id").join(some.groupBy("client_id").agg(F.count("*").alias("n_vouchers")), "client_id")
    return out.drop("_chosen", "_asked"), audit
