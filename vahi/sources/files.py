"""Readers of extracted documents: portal statements as JSON or CSV, bank statements and invoices as JSON, and seeded ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.functions import values as V

# amounts stay JSON values, for a number and a text are read differently
_INV = "struct<inum:string,idt:string,txval:variant,camt:variant,samt:variant,iamt:variant,csamt:variant,igst:variant,cgst:variant,sgst:variant,cess:variant,inv_typ:string>"
_B2B = f"array<struct<ctin:string,trdnm:string,inv:array<{_INV}>>>"
PORTAL = f"struct<data:struct<docdata:struct<b2b:{_B2B}>>,docdata:struct<b2b:{_B2B}>,b2b:{_B2B}>"
# The names under which a flat statement may have each field.
FLAT = {
    "supplier_gstin": ("ctin", "gstin", "supplierGstin"), "supplier_name": ("trdnm", "supplierName", "vendor"), "invoice_number": ("inum", "invoiceNumber", "invoice_number"),
    "invoice_date": ("idt", "invoiceDate", "date"), "taxable_value": ("txval", "taxableValue", "subtotal"), "igst": ("igst", "iamt"), "cgst": ("cgst", "camt"), "sgst": ("sgst", "samt"), "cess": ("cess", "csamt"),
    "invoice_type": ("inv_typ", "invoiceType"),
}

# The headers under which a statement in CSV may have each field, in lower case.
CSV = {
    "supplier_gstin": ("gstin", "supplier gstin", "ctin"), "supplier_name": ("trade/legal name", "supplier", "supplier name"), "invoice_number": ("invoice number", "invoicenumber", "invoice no", "inum"),
    "invoice_date": ("invoice date", "invoicedate", "idt"), "taxable_value": ("taxable value", "taxable", "txval"), "igst": ("igst", "igst amount"), "cgst": ("cgst", "cgst amount"), "sgst": ("sgst", "sgst amount"), "cess": ("cess",),
    "invoice_type": ("invoice type", "inv_typ"),
}
_AMOUNTS = ("taxable_value", "igst", "cgst", "sgst", "cess")


def _typed(rows: DataFrame) -> DataFrame:
    taxes = {c: V.clean_money(F.col(c)) for c in _AMOUNTS}
    out = rows.withColumns({"supplier_gstin": T.norm_gstin(F.col("supplier_gstin")), "supplier_name": T.blank_to_null(F.col("supplier_name")), "invoice_number": T.blank_to_null(F.col("invoice_number")), "invoice_date": V.parse_date(F.col("invoice_date")), "invoice_type": F.coalesce(F.nullif("invoice_type", F.lit("")), F.lit("B2B")), **taxes})
    return out.withColumn("total_tax", F.col("igst") + F.col("cgst") + F.col("sgst") + F.col("cess"))


def _either(one: str, other: str) -> Column:
    """The first amount that is neither missing, empty nor zero."""
    return F.coalesce(F.nullif(V.json_money(F.col(one)), F.lit(0.0)), V.json_money(F.col(other)))


def portal_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row an invoice of the first statement that a payload holds, at data.docdata.b2b, docdata.b2b or b2b; comments are allowed."""
    doc = F.from_json(column, PORTAL, {"allowComments": "true"})
    rest = [c for c in payloads.columns if c != column]
    parties = payloads.withColumn("_d", doc).select(*rest, F.posexplode(F.coalesce("_d.data.docdata.b2b", "_d.docdata.b2b", "_d.b2b")).alias("party_no", "p"))
    rows = parties.select(*rest, "party_no", "p.ctin", "p.trdnm", F.posexplode("p.inv").alias("seq", "i"))
    return _typed(rows.select(*rest, "party_no", "seq", F.col("ctin").alias("supplier_gstin"), F.col("trdnm").alias("supplier_name"), F.col("i.inum").alias("invoice_number"), F.col("i.idt").alias("invoice_date"), V.json_money(F.col("i.txval")).alias("taxable_value"), *[_either(f"i.{a}", f"i.{b}").alias(a) for a, b in (("igst", "iamt"), ("cgst", "camt"), ("sgst", "samt"), ("cess", "csamt"))], F.col("i.inv_typ").alias("invoice_type")))


def flat_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row an object of a JSON array; the first name that has a value gives a field: an amount may be empty, a text may not."""
    rest = [c for c in payloads.columns if c != column]
    rows = payloads.select(*rest, F.posexplode(F.from_json(column, "array<map<string,variant>>")).alias("seq", "m"))
    at = lambda k: V.json_there(F.try_element_at("m", F.lit(k)))
    text = lambda k: F.nullif(F.try_variant_get(at(k), "$", "string"), F.lit(""))
    value: dict[str, Column] = {name: V.json_money(F.coalesce(*map(at, keys))) if name in _AMOUNTS else F.coalesce(*map(text, keys)) for name, keys in FLAT.items()}
    return _typed(rows.select(*rest, "seq", *[v.alias(k) for k, v in value.items()]))


def read_portal_csv(spark: SparkSession, path: str) -> DataFrame:
    """A statement as CSV with a header in any case, quoted cells, commas and doubled quotes inside them; blank lines go, no lines give no rows.

    The first header that has text gives a field.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    have = {c.strip().lower(): c for c in raw.columns}
    pick = lambda keys: F.coalesce(*[F.nullif(F.col(f"`{have[k]}`"), F.lit("")) for k in keys if k in have], F.lit(None).cast("string"))
    return _typed(raw.select(*[pick(keys).alias(name) for name, keys in CSV.items()]))


def bank_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row a transaction of data.transactions or transactions, numbered from 0."""
    txn = "array<struct<date:string,description:string,ref:string,withdrawal:variant,deposit:variant,balance:variant>>"
    doc = F.from_json(column, f"struct<data:struct<transactions:{txn}>,transactions:{txn}>")
    rest = [c for c in payloads.columns if c != column]
    rows = payloads.withColumn("_d", doc).select(*rest, F.posexplode(F.coalesce("_d.data.transactions", "_d.transactions")).alias("sort_order", "t"))
    return rows.select(*rest, "sort_order", V.parse_date(F.col("t.date")).alias("txn_date"), T.txn_description(F.col("t.description")).alias("description"), T.blank_to_null(F.col("t.ref")).alias("ref"), V.json_money(F.col("t.withdrawal")).alias("withdrawal"), V.json_money(F.col("t.deposit")).alias("deposit"))


def invoice_rows(payloads: DataFrame, as_of: Column, column: str = "payload") -> DataFrame:
    """Extracted invoices as typed rows with items.

    An item's name is the first that is not blank; the first amount that is there is its price, and without one it is quantity x rate, each 0 if missing.
    Nulls in the list go; a list that is none is empty.
    """
    names = ("selected_item_name", "item_name", "name", "description", "qty", "quantity", "rate", "price", "amount", "total", "hsn_code", "hsn", "hsnCode", "gst_rate", "gstRate", "tax_rate")
    kind = lambda x: "variant" if x in ("qty", "quantity", "rate", "price", "amount", "total", "gst_rate", "gstRate", "tax_rate") else "string"
    item = f"struct<{','.join(f'`{x}`:{kind(x)}' for x in names)}>"
    doc = F.from_json(column, f"struct<invoice_number:string,date:string,vendor:string,vendor_gstin:string,customer_name:string,customer_gstin:string,subtotal:variant,cgst:variant,sgst:variant,igst:variant,discount:variant,total_amount:variant,items:array<{item}>>", {"caseSensitive": "true"})
    d = lambda x: F.col(f"_d.{x}")

    def one(x: Column) -> Column:
        first = lambda *keys: F.coalesce(*[x[k] for k in keys])
        there = lambda *keys: F.coalesce(*[V.json_there(x[k]) for k in keys])
        amount = lambda name, *keys: V.json_money(there(*keys)).alias(name)
        rate_of = there("gst_rate", "gstRate", "tax_rate")
        return F.struct(
            F.coalesce(*[T.blank_to_null(x[k]) for k in names[:4]], F.lit("Item")).alias("name"), amount("qty", "qty", "quantity"), amount("rate", "rate"), amount("price", "price", "amount", "total"),
            T.blank_to_null(first("hsn_code", "hsn", "hsnCode")).alias("hsn_code"), F.when(rate_of.isNotNull(), V.json_money(rate_of)).alias("gst_rate"),
        )

    def priced(x: Column) -> Column:
        return F.struct(x["name"].alias("name"), x.qty.alias("qty"), x.rate.alias("rate"), F.when(x.price != 0, x.price).otherwise(x.qty * x.rate).alias("price"), x.hsn_code.alias("hsn_code"), x.gst_rate.alias("gst_rate"))

    # two steps: in a function of an array Spark evaluates an expression anew at each use, so amounts are read once and then used
    items = F.coalesce(F.transform(F.transform(F.filter(d("items"), lambda x: x.isNotNull()), one), priced), F.array())
    rest = [c for c in payloads.columns if c != column]
    return payloads.withColumn("_d", doc).select(
        *rest, T.blank_to_null(d("invoice_number")).alias("invoice_number"), V.clean_date(d("date"), as_of).alias("invoice_date"), T.blank_to_null(d("vendor")).alias("vendor"), T.norm_gstin(d("vendor_gstin")).alias("vendor_gstin"),
        T.blank_to_null(d("customer_name")).alias("customer_name"), T.norm_gstin(d("customer_gstin")).alias("customer_gstin"), *[V.json_money(d(c)).alias(c) for c in ("subtotal", "cgst", "sgst", "igst", "discount", "total_amount")], items.alias("items"),
    )


# The chart of accounts that a new client starts with: name, group, type, rate, system ledger.
SEED_LEDGERS = [
    ("Sundry Creditors", "SUNDRY_CREDITORS", "PARTY", None, False),
    ("Sundry Debtors", "SUNDRY_DEBTORS", "PARTY", None, False),
    ("CGST Input", "DUTIES_AND_TAXES", "TAX_INPUT", None, True),
    ("SGST Input", "DUTIES_AND_TAXES", "TAX_INPUT", None, True),
    ("IGST Input", "DUTIES_AND_TAXES", "TAX_INPUT", None, True),
    ("CGST Output", "DUTIES_AND_TAXES", "TAX_OUTPUT", None, True),
    ("SGST Output", "DUTIES_AND_TAXES", "TAX_OUTPUT", None, True),
    ("IGST Output", "DUTIES_AND_TAXES", "TAX_OUTPUT", None, True),
    ("Purchase Accounts", "PURCHASE_ACCOUNTS", "PURCHASE", None, False),
    ("Purchase - GST 5%", "PURCHASE_ACCOUNTS", "PURCHASE", 5.0, False),
    ("Purchase - GST 12%", "PURCHASE_ACCOUNTS", "PURCHASE", 12.0, False),
    ("Purchase - GST 18%", "PURCHASE_ACCOUNTS", "PURCHASE", 18.0, False),
    ("Purchase - GST 28%", "PURCHASE_ACCOUNTS", "PURCHASE", 28.0, False),
    ("Sales Accounts", "SALES_ACCOUNTS", "SALE", None, False),
    ("Sales - GST 5%", "SALES_ACCOUNTS", "SALE", 5.0, False),
    ("Sales - GST 12%", "SALES_ACCOUNTS", "SALE", 12.0, False),
    ("Sales - GST 18%", "SALES_ACCOUNTS", "SALE", 18.0, False),
    ("Sales - GST 28%", "SALES_ACCOUNTS", "SALE", 28.0, False),
    ("Rent", "INDIRECT_EXPENSES", "EXPENSE", None, False),
    ("Telephone & Internet", "INDIRECT_EXPENSES", "EXPENSE", None, False),
    ("Professional Fees", "INDIRECT_EXPENSES", "EXPENSE", None, False),
    ("Office Expenses", "INDIRECT_EXPENSES", "EXPENSE", None, False),
    ("Bank Charges", "INDIRECT_EXPENSES", "EXPENSE", None, False),
    ("Repairs & Maintenance", "INDIRECT_EXPENSES", "EXPENSE", None, False),
    ("Travelling & Conveyance", "INDIRECT_EXPENSES", "EXPENSE", None, False),
    ("Printing & Stationery", "INDIRECT_EXPENSES", "EXPENSE", None, False),
    ("Freight & Carriage Inward", "DIRECT_EXPENSES", "EXPENSE", None, False),
    ("Discount Received", "INDIRECT_INCOME", "INCOME", None, False),
    ("Discount Allowed", "INDIRECT_EXPENSES", "EXPENSE", None, False),
    ("Round Off", "CURRENT_LIABILITIES", "ROUND_OFF", None, True),
    ("Bank Account", "BANK_ACCOUNTS", "BANK", None, False),
    ("Cash", "CASH_IN_HAND", "CASH", None, False),
]


def seed_ledgers(clients: DataFrame, ledgers: DataFrame) -> DataFrame:
    """The chart of accounts for clients without any ledger; the seed is a fixed list of 32 rows."""
    seed = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, (("name", "string"), ("ledger_group", "string"), ("ledger_type", "string"), ("gst_rate", "double"), ("is_system", "boolean")), strict=True)]) for row in SEED_LEDGERS])
    new = clients.select("client_id").distinct().join(ledgers.select("client_id").distinct(), "client_id", "left_anti")
    return new.select("client_id", F.posexplode(seed).alias("seed_no", "s")).select("client_id", "seed_no", "s.*")
