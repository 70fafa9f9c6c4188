"""CSV, JSON and XML exports as DataFrames, and their writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.functions import values as V
from vahi.operators.order import positions

# Display names in the accounting program's import format.
GROUP_NAMES = {
    "SUNDRY_CREDITORS": "Sundry Creditors", "SUNDRY_DEBTORS": "Sundry Debtors", "DUTIES_AND_TAXES": "Duties & Taxes",
    "PURCHASE_ACCOUNTS": "Purchase Accounts", "SALES_ACCOUNTS": "Sales Accounts", "DIRECT_EXPENSES": "Direct Expenses",
    "INDIRECT_EXPENSES": "Indirect Expenses", "INDIRECT_INCOME": "Indirect Incomes", "BANK_ACCOUNTS": "Bank Accounts",
    "CASH_IN_HAND": "Cash-in-Hand", "CURRENT_ASSETS": "Current Assets", "CURRENT_LIABILITIES": "Current Liabilities", "FIXED_ASSETS": "Fixed Assets",
}
VOUCHER_NAMES = {
    "PURCHASE": "Purchase", "SALE": "Sales", "JOURNAL": "Journal", "CREDIT_NOTE": "Credit Note", "DEBIT_NOTE": "Debit Note",
    "PAYMENT": "Payment", "RECEIPT": "Receipt", "CONTRA": "Contra",
}
# The columns of the invoice list, in order.
CSV_COLUMNS = ("Invoice #", "Vendor", "Vendor GSTIN", "Date", "Subtotal", "CGST", "SGST", "IGST", "Tax", "Total Amount", "GST Valid", "Status", "Doc Type")


def _named(names: dict[str, str], key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key), other)


def group_label(group: Column) -> Column:
    """C12."""
    return _named(GROUP_NAMES, group, F.replace(group, F.lit("_"), F.lit(" ")))


def voucher_label(kind: Column) -> Column:
    """C13."""
    return _named(VOUCHER_NAMES, kind, F.lit("Journal"))


def invoice_list(invoices: DataFrame) -> DataFrame:
    """K1: the invoices as text in the export's 13 columns, with client_id and created_at to order by; dates as d/m/yyyy, amounts with two decimals."""
    money = lambda c: F.coalesce(V.two_places(V.to_paise(F.col(c))), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    values = (
        text("invoice_number"), text("vendor"), text("vendor_gstin"), F.coalesce(F.date_format("invoice_date", "d/M/yyyy"), F.lit("")), *map(money, ("subtotal", "cgst", "sgst", "igst", "tax_amount", "total_amount")),
        F.when(F.col("gst_valid"), "Valid").when(~F.col("gst_valid"), "Invalid").otherwise(""), text("status"), text("document_type"),
    )
    return invoices.select("client_id", "created_at", "invoice_id", *[v.alias(n) for v, n in zip(values, CSV_COLUMNS, strict=True)])


def _as_files(rows: DataFrame, path: str, order: list[Column], write: Callable) -> None:
    """rows in files that follow the order within each client's folder: read by name, a client's files are its export. Large clients have several files."""
    dealt = rows.repartitionByRange(F.col("client_id"), *order).sortWithinPartitions(F.col("client_id"), *order)
    write(dealt.drop("created_at", "invoice_id", "part", "at").write.partitionBy("client_id"), path)


def write_csv(invoices: DataFrame, path: str) -> None:
    """K1: newest first within each client's folder; every cell quoted, quotes inside doubled. Each file has the header."""
    _as_files(invoice_list(invoices), path, [F.desc("created_at"), F.col("invoice_id")], lambda w, to: w.option("header", True).option("quoteAll", True).option("escape", '"').csv(to))


def invoice_json(invoices: DataFrame, as_of: Column) -> DataFrame:
    """K2: one JSON line an invoice under its client's envelope line; the envelope has the export's time and the total, not the rows, so no row is unbounded."""
    body = invoices.select("client_id", F.lit(1).alias("part"), "invoice_id", F.to_json(F.struct(*[c for c in invoices.columns])).alias("line"))
    head = invoices.groupBy("client_id").agg(F.count("*").alias("total")).select("client_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("invoice_id"), F.to_json(F.struct(as_of.alias("exported_at"), F.col("client_id").alias("client"), "total")).alias("line"))
    return head.unionByName(body)


def _tag(name: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name.split(' ')[0]}>"))


def _message(inner: Column) -> Column:
    return F.concat(F.lit('<TALLYMESSAGE xmlns:UDF="TallyUDF">'), inner, F.lit("</TALLYMESSAGE>"))


def ledger_xml(ledgers: DataFrame) -> DataFrame:
    """K3: one master a (client_id, name): the last ledger of a name wins and stands where the first one stood (U3); the registration where there is one."""
    by = Window.partitionBy("client_id", "name")
    one = ledgers.where("name <> ''").withColumn("place", F.min("ledger_id").over(by)).withColumn("_n", F.row_number().over(by.orderBy(F.desc("ledger_id")))).where("_n = 1")
    name = T.xml_escape(F.col("name"))
    gstin = F.when(F.col("gstin") != "", _tag("PARTYGSTIN", T.xml_escape(F.col("gstin")))).otherwise("")
    xml = F.concat(
        F.lit('<LEDGER NAME="'), name, F.lit('" ACTION="Create">'), _tag("NAME.LIST", _tag("NAME", name)), _tag("PARENT", T.xml_escape(group_label(F.col("ledger_group")))), F.coalesce(gstin, F.lit("")), _tag("ISBILLWISEON", F.lit("No")), F.lit("</LEDGER>"),
    )
    return one.select("client_id", "place", "name", _message(xml).alias("xml"))


def voucher_xml(vouchers: DataFrame, lines: DataFrame, invoices: DataFrame, prefix: str = "V") -> DataFrame:
    """One entry a voucher; debits are negative amounts, lines of nothing are left out; the remote id, and the number where there is none, come from the place
    in the client's export (by date, id), counted without a task a client."""
    debit = F.col("debit_p") > 0
    entry = _tag(
        "ALLLEDGERENTRIES.LIST", _tag("LEDGERNAME", T.xml_escape(F.coalesce(F.nullif("ledger_name", F.lit("")), F.lit("Unknown")))), _tag("ISDEEMEDPOSITIVE", F.when(debit, "Yes").otherwise("No")),
        _tag("AMOUNT", F.when(debit, F.concat(F.lit("-"), V.two_places(F.col("debit_p")))).otherwise(V.two_places(F.col("credit_p")))),
    )
    entries = lines.where("debit_p > 0 OR credit_p > 0").withColumn("entry", entry).groupBy("voucher_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sort_order", "entry"))), lambda x: x.entry), "").alias("entries"))
    chosen = vouchers.where(F.col("status").isin("APPROVED", "EXPORTED_DEMO")).select("client_id", "voucher_id", "invoice_id", "voucher_type", "voucher_date", "narration")
    rows = positions(chosen, "client_id", [F.col("voucher_date"), F.col("voucher_id")], "nth").join(entries, "voucher_id", "left").join(invoices.select("invoice_id", "vendor", "invoice_number"), "invoice_id", "left")
    number = F.coalesce(F.nullif("invoice_number", F.lit("")), F.concat(F.lit(f"{prefix}-"), F.col("nth").cast("string")))
    said = F.coalesce(F.nullif("narration", F.lit("")), F.nullif(F.concat_ws(" / ", F.nullif("vendor", F.lit("")), F.concat(F.lit("Inv "), F.nullif("invoice_number", F.lit("")))), F.lit("")), F.lit("Imported"))
    kind, day = voucher_label(F.col("voucher_type")), V.compact_date(F.col("voucher_date"))
    xml = F.concat(
        F.lit(f'<VOUCHER REMOTEID="{prefix}-'), (F.col("nth") - 1).cast("string"), F.lit("-"), day, F.lit('" VCHTYPE="'), kind, F.lit('" ACTION="Create">'), _tag("DATE", day), _tag("NARRATION", T.xml_escape(said)),
        _tag("VOUCHERTYPENAME", kind), _tag("VOUCHERNUMBER", T.xml_escape(number)), F.coalesce("entries", F.lit("")), F.lit("</VOUCHER>"),
    )
    return rows.select("client_id", "nth", "voucher_id", _message(xml).alias("xml"))


def import_document(ledgers: DataFrame, vouchers: DataFrame, companies: DataFrame) -> DataFrame:
    """K3: the whole import document of each client as lines (client_id, part, at, xml): the head with the company's name, masters, vouchers, the foot.

    ledgers, vouchers: of ledger_xml and voucher_xml; companies: client_id and name. Lines of a client in the order of (part, at) are its document.
    """
    name = T.xml_escape(F.coalesce(F.nullif("name", F.lit("")), F.lit("Import")))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY><IMPORTDATA><REQUESTDESC><REPORTNAME>All Masters</REPORTNAME><STATICVARIABLES><SVCURRENTCOMPANY>'), name,
        F.lit("</SVCURRENTCOMPANY></STATICVARIABLES></REQUESTDESC><REQUESTDATA>"),
    )
    line = lambda df, part, at, xml: df.select("client_id", F.lit(part).alias("part"), at.cast("long").alias("at"), xml.alias("xml"))
    used = vouchers.select("client_id").distinct()  # a client without vouchers has no document
    of = lambda df: df.join(used, "client_id", "left_semi")
    ends = of(companies)
    body = line(of(ledgers), 1, F.col("place"), F.col("xml")).unionByName(line(vouchers, 2, F.col("nth"), F.col("xml")))
    return line(ends, 0, F.lit(0), head).unionByName(body).unionByName(line(ends, 3, F.lit(0), F.lit("</REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>")))


def write_xml(document: DataFrame, path: str) -> None:
    """K3: the lines of import_document as text in a folder a client; the files of a folder, read by name, are the document."""
    _as_files(document, path, [F.col("part"), F.col("at")], lambda w, to: w.text(to))


def stored_invoices(invoices: DataFrame) -> DataFrame:
    """K8: as invoices are kept: 0 becomes null for the subtotal, the parts of the tax and the discount, not for tax and total."""
    return invoices.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in ("subtotal", "cgst", "sgst", "igst", "discount")})
