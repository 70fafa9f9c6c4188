"""The validation suite of tax invoices: 22 checks in one projection, no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.functions import values as V

# The usual tax rates in percent, and the total from which electronic invoicing may apply.
USUAL_RATES = (0.0, 0.25, 3.0, 5.0, 12.0, 18.0, 28.0)
EINVOICE_TOTAL = 50_000_000.0
CHECKS = 22
_ISSUE = "struct<code:string,severity:string,message:string>"


def _issue(when: Column, code: str, severity: str, message: Column | str) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), said.alias("message")))


def _money(v: Column) -> Column:
    return F.concat(F.lit("₹"), V.two_places(V.to_paise(v)))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def interstate_of(vendor: Column, customer: Column) -> Column:
    """Null unless both registrations are given; whether they are valid doesn't matter."""
    return F.when((vendor != "") & (customer != ""), T.state_code(vendor) != T.state_code(customer))


def _head_issues(as_of: Column) -> list[Column]:
    v, c, inter = F.col("_v"), F.col("_c"), F.col("interstate")
    cgst, sgst, igst, discount = (_zero(x) for x in ("cgst", "sgst", "igst", "discount"))
    tax, total, subtotal = F.col("tax_amount"), F.col("total_amount"), _zero("subtotal")
    taxes = cgst + sgst + igst
    expected = subtotal - discount + taxes
    return [
        _issue(v == "", "VENDOR_GSTIN_MISSING", "warning", "The vendor has no registration number"),
        _issue((v != "") & ~T.gstin_valid(v), "VENDOR_GSTIN_INVALID", "error", "The vendor's registration number is malformed"),
        _issue((c != "") & ~T.gstin_valid(c), "CUSTOMER_GSTIN_INVALID", "error", "The customer's registration number is malformed"),
        _issue((v != "") & (v == c), "SAME_PARTY_GSTIN", "warning", "Vendor and customer have one registration number"),
        _issue((F.length(v) == 15) & ~T.pan_of(v).rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), "VENDOR_PAN_IN_GSTIN", "error", "The account number in the vendor's registration is malformed"),
        _issue(inter & (igst <= 0) & ((cgst > 0) | (sgst > 0)), "TAX_TYPE_INTERSTATE", "error", "A supply between states carries integrated tax"),
        _issue(inter & ((cgst > 0) | (sgst > 0)), "CGST_SGST_ON_INTERSTATE", "warning", "Central or state tax on a supply between states"),
        _issue(~inter & (igst > 0), "IGST_ON_INTRASTATE", "error", "Integrated tax on a supply within a state"),
        _issue(~inter & (F.abs(cgst - sgst) > 1), "CGST_SGST_IMBALANCE", "warning", "Central and state tax differ"),
        _issue(F.abs(tax - taxes) > 1, "TAX_MATH_MISMATCH", "warning", F.concat(F.lit("Tax "), _money(tax), F.lit(" is not the sum of its parts "), _money(taxes))),
        _issue((subtotal > 0) & (F.abs(total - expected) > 2), "TOTAL_MATH_MISMATCH", "warning", F.concat(F.lit("Total "), _money(total), F.lit(" where "), _money(expected), F.lit(" is expected"))),
        _issue(total < 0, "NEGATIVE_TOTAL", "error", "The total is negative"),
        _issue((subtotal > 0) & (discount > subtotal), "DISCOUNT_EXCEEDS_SUBTOTAL", "error", "The discount is above the subtotal"),
        _issue(T.trimmed(F.coalesce("invoice_number", F.lit(""))) == "", "INVOICE_NUMBER_MISSING", "warning", "No invoice number"),
        _issue(F.col("_date_given").isNull(), "INVOICE_DATE_MISSING", "warning", "No invoice date"),
        _issue(F.col("_date_given").isNotNull() & F.col("_date").isNull(), "INVOICE_DATE_INVALID", "error", "The invoice date cannot be read"),
        _issue(V.in_future(F.col("_date"), as_of), "INVOICE_DATE_FUTURE", "warning", "The invoice date lies ahead"),
    ]


def _line_issues() -> Column:
    items = F.coalesce(F.col("items"), F.array().cast("array<struct<name:string,qty:double,rate:double,price:double,hsn_code:string,gst_rate:double>>"))
    bare = F.size(F.filter(items, lambda x: F.coalesce(T.trimmed(x.hsn_code), F.lit("")) == ""))
    n = F.size(items)

    def hsn(x: Column, i: Column) -> Column:
        code = F.regexp_replace(F.coalesce(x.hsn_code, F.lit("")), r"\s", "")
        return _issue((code != "") & ~code.rlike("^[0-9]{4,8}$"), "HSN_FORMAT", "info", F.concat(F.lit("Line "), (i + 1).cast("string"), F.lit(": goods code "), code, F.lit(" is unusual")))

    def maths(x: Column, i: Column) -> Column:
        off = (x.qty > 0) & (x.rate > 0) & (x.price > 0) & (F.abs(x.qty * x.rate - x.price) > V.line_tolerance(x.price))
        return _issue(off, "LINE_MATH", "warning", F.concat(F.lit("Line "), (i + 1).cast("string"), F.lit(": quantity x rate "), _money(x.qty * x.rate), F.lit(" is not "), _money(x.price)))

    odd = F.try_element_at(F.filter(items, lambda x: x.gst_rate.isNotNull() & ~x.gst_rate.isin(*USUAL_RATES)), F.lit(1))
    whole = F.array(
        _issue((n > 0) & (bare == n), "HSN_MISSING", "warning", "No line has a goods code"),
        _issue((bare > 0) & (bare < n), "HSN_PARTIAL", "info", F.concat(bare.cast("string"), F.lit(" lines without a goods code"))),
    )
    rate = _issue(odd.isNotNull(), "UNUSUAL_GST_RATE", "info", F.concat(F.lit("Unusual rate "), odd.gst_rate.cast("string"), F.lit("% on a line")))
    none = _issue(n == 0, "NO_LINE_ITEMS", "warning", "No lines")
    return F.concat(whole, F.transform(items, hsn), F.transform(items, maths), F.array(rate, none))


def _tail_issues() -> list[Column]:
    total, subtotal = F.col("total_amount"), _zero("subtotal")
    return [
        _issue(F.col("reverse_charge"), "REVERSE_CHARGE", "info", "Reverse charge applies: check its ledgers"),
        _issue((total >= EINVOICE_TOTAL) & (F.coalesce("irn", F.lit("")) == ""), "EINVOICE_THRESHOLD", "info", "High value without an electronic invoice number"),
        _issue((F.coalesce("eway_bill_no", F.lit("")) != "") & ~F.regexp_replace("eway_bill_no", r"\s", "").rlike("^[0-9]{12}$"), "EWAY_FORMAT", "info", "A transport bill number has 12 digits"),
        _issue(F.coalesce("document_type", F.lit("")) == "", "DOC_TYPE_UNKNOWN", "info", "The document's type is not known"),
        _issue((_zero("cgst") == 0) & (_zero("sgst") == 0) & (_zero("igst") == 0) & (total > 0) & (subtotal > 0), "ZERO_TAX_ON_TAXABLE", "info", "No tax on a total above zero"),
    ]


def validate(invoices: DataFrame, as_of: Column, save_route_profile: bool = False) -> DataFrame:
    """V1: add issues (array of code, severity, message, in check order), is_valid (no error), vendor_state, customer_state, interstate and check_count.

    save_route_profile: leave out number, date, irn, way bill and reverse charge, as a caller that stores flags early does.
    """
    if save_route_profile:
        invoices = invoices.withColumns({"invoice_number": F.lit(None).cast("string"), "invoice_date": F.lit(None).cast("string"), "irn": F.lit(None).cast("string"), "eway_bill_no": F.lit(None).cast("string"), "reverse_charge": F.lit(False)})
    upper = lambda x: F.upper(T.trimmed(F.coalesce(x, F.lit(""))))
    given = T.blank_to_null(F.col("invoice_date"))
    out = invoices.withColumns({"_v": upper(F.col("vendor_gstin")), "_c": upper(F.col("customer_gstin")), "_date_given": given})
    out = out.withColumns({"interstate": interstate_of(F.col("_v"), F.col("_c")), "_date": F.coalesce(F.col("_date_given").try_cast("timestamp"), V.parse_date(F.col("_date_given")).cast("timestamp"))})
    issues = F.array_compact(F.concat(F.array(*_head_issues(as_of)), _line_issues(), F.array(*_tail_issues())))
    out = out.withColumns({
        "issues": issues.cast(f"array<{_ISSUE}>"), "vendor_state": T.state_name(T.state_code(F.col("_v"))), "customer_state": T.state_name(T.state_code(F.col("_c"))), "check_count": F.lit(CHECKS),
    })
    return out.withColumn("is_valid", ~F.exists("issues", lambda x: x.severity == "error")).drop("_v", "_c", "_date", "_date_given")


def codes_of(validated: DataFrame, *keep: str) -> DataFrame:
    """One row an issue's code, beside the columns to keep. The outer form, for below the plain one Spark filters by the array, which makes all issues once more; an invoice without issues gives no row."""
    return validated.select(*keep, F.explode_outer("issues.code").alias("code")).where("code IS NOT NULL")


def with_items(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """S3: each invoice with its lines as an ordered array; one shuffle, on the invoice's id."""
    rows = F.sort_array(F.collect_list(F.struct("sort_order", "name", "qty", "rate", "price", "hsn_code", "gst_rate")))
    arrays = items.groupBy("invoice_id").agg(F.transform(rows, lambda x: x.dropFields("sort_order")).alias("items"))
    return invoices.join(arrays, "invoice_id", "left")


def duplicate_key(number: Column, gstin: Column, vendor: Column, total: Column) -> Column:
    """V2: number, registration (or vendor's name) and whole paise; null without a number."""
    who = F.coalesce(F.nullif(T.squeeze_upper(gstin), F.lit("")), T.squeeze_upper(vendor))
    part = T.squeeze_upper(number)
    return F.when(part != "", F.concat_ws("|", part, who, V.to_paise(F.coalesce(total, F.lit(0.0))).cast("string")))
