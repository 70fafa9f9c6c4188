"""Two-sided reconciliation of the tax portal's rows with the purchase books."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vahi.functions import text as T
from vahi.functions import values as V
from vahi.operators.order import positions
from vahi.operators.skew import join_hot
from vahi.sources import snapshots
from vahi.storage import forget, stored

RESULT = "client_id int, gstin string, row_id long, invoice_id long, status string, taxable_diff double, tax_diff double, row_tax double"
_RESULT_TYPES = pa.schema([
    ("client_id", pa.int32()), ("gstin", pa.string()), ("row_id", pa.int64()), ("invoice_id", pa.int64()), ("status", pa.string()), ("taxable_diff", pa.float64()), ("tax_diff", pa.float64()), ("row_tax", pa.float64()),
])
# Results by status, in the order of their declaration.
STATUSES = ("MATCHED", "VALUE_MISMATCH", "MISSING_IN_2B", "MISSING_IN_BOOKS", "DUPLICATE")


def purchase_books(invoices: DataFrame, vouchers: DataFrame) -> DataFrame:
    """invoices that are purchases by their own type, by having none, or by their voucher."""
    kinds = vouchers.select("invoice_id", "voucher_type")
    return invoices.join(kinds, "invoice_id", "left").where("document_type = 'PURCHASE' OR document_type IS NULL OR voucher_type = 'PURCHASE'")


def _keyed(rows: DataFrame, gstin: str, number: str) -> DataFrame:
    """Adds the registration, the exact and the soft key of the number, and its digits, which are equal wherever either key is."""
    digits = F.coalesce(F.regexp_replace(number, "[^0-9]", ""), F.lit(""))
    return rows.withColumns({"gstin": F.coalesce(T.norm_gstin(F.col(gstin)), F.lit("")), "exact": T.squeeze_upper(F.col(number)), "soft": F.coalesce(T.norm_name(F.col(number)), F.lit("")), "digits": digits})


def book_side(books: DataFrame) -> DataFrame:
    """Keys and amounts of books; a missing subtotal or tax falls back to the total or to the parts."""
    part = lambda *xs: sum((F.coalesce(x, F.lit(0.0)) for x in map(F.col, xs)), F.lit(0.0))
    out = books.withColumn("taxable", F.coalesce(F.col("subtotal"), F.coalesce("total_amount", F.lit(0.0)) - F.coalesce("tax_amount", F.lit(0.0)))).withColumn("tax", F.coalesce(F.col("tax_amount"), part("cgst", "sgst", "igst")))
    out = out.withColumns({"left_taxable": F.coalesce("subtotal", F.lit(0.0)), "left_tax": F.coalesce("tax_amount", F.lit(0.0))})
    return _keyed(out, "vendor_gstin", "invoice_number").select("client_id", "gstin", "digits", "exact", "soft", "invoice_id", "taxable", "tax", "left_taxable", "left_tax")


def row_side(rows: DataFrame) -> DataFrame:
    out = rows.withColumns({"taxable": F.coalesce("taxable_value", F.lit(0.0)), "tax": F.coalesce("total_tax", F.lit(0.0))})
    return _keyed(out, "supplier_gstin", "invoice_number").select("client_id", "gstin", "digits", "exact", "soft", "row_id", "taxable", "tax")


class _OpenBooks:
    """The books of one group in columns, and for each exact and soft key the places of its books in order with the first that may be open."""

    def __init__(self):
        self.ids, self.amounts, self.used = array("q"), array("d"), bytearray()
        self.exact: dict[str, list] = {}
        self.soft: dict[str, list] = {}

    def add(self, exact: str, soft: str, book: int, amounts: tuple) -> None:
        for keys, key in ((self.exact, exact), (self.soft, soft)):
            if (queue := keys.get(key)) is None:
                queue = keys[key] = [array("q"), 0]
            queue[0].append(len(self.ids))
        self.ids.append(book)
        self.amounts.extend(amounts)
        self.used.append(0)

    def take(self, exact: str, soft: str) -> int | None:
        """The place of the first open book with the exact key, else with the soft key."""
        for keys, key in ((self.exact, exact), (self.soft, soft)):
            if (queue := keys.get(key)) is not None:
                places, k = queue
                while k < len(places) and self.used[places[k]]:
                    k += 1
                queue[1] = k
                if k < len(places):
                    self.used[places[k]] = 1
                    return places[k]
        return None


_SIDES = ("client_id", "gstin", "digits", "side", "id", "exact", "soft", "taxable", "tax", "left_taxable", "left_tax")


def _walk(tolerance: float):
    """One pass over groups that come sorted, books before rows: rows in order, a book is taken once, exact keys before soft ones, the first book wins."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, books = None, _OpenBooks()

        def left_over() -> list[tuple]:
            a = books.amounts
            return [(group[0], group[1], None, b, "MISSING_IN_2B", a[4 * k + 2], a[4 * k + 3], None) for k, b in enumerate(books.ids) if not books.used[k]]

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _RESULT_TYPES.types, strict=True)], schema=_RESULT_TYPES)

        for batch in batches:
            out: list[tuple] = []
            for client, gstin, digits, side, key, exact, soft, taxable, tax, left_taxable, left_tax in zip(*(batch.column(c).to_pylist() for c in _SIDES), strict=True):
                if (client, gstin, digits) != group:
                    if group:
                        out += left_over()
                    group, books = (client, gstin, digits), _OpenBooks()
                if side == 0:
                    books.add(exact, soft, key, (taxable, tax, left_taxable, left_tax))
                    continue
                k = books.take(exact, soft)
                if k is None:
                    out.append((client, gstin, key, None, "MISSING_IN_BOOKS", taxable, tax, tax))
                    continue
                gap, tax_gap = abs(books.amounts[4 * k] - taxable), abs(books.amounts[4 * k + 1] - tax)
                out.append((client, gstin, key, books.ids[k], "MATCHED" if gap <= tolerance and tax_gap <= tolerance else "VALUE_MISMATCH", gap, tax_gap, tax))
            if out:
                yield rows_of(out)
        if group and (out := left_over()):
            yield rows_of(out)

    return walk


#: Records of a group (client, registration, digits) up to which one task walks it as it is.
WALKED = 50_000
_KEYS = ["client_id", "gstin", "exact", "soft"]


def _mixed_components(pairs: DataFrame) -> DataFrame:
    """pairs (client_id, gstin, exact, soft, n) with `digits`, a name of the component of keys that they are in: the least pair that is linked by equal keys.

    Labels go from pair to key and back until nothing changes; each round is stored. Rounds are half as many as the longest chain of different keys.
    """
    label = F.concat_ws("\u0001", "exact", "soft")
    now = held = stored(pairs.withColumn("digits", label), "components")
    while True:
        least = lambda key: now.groupBy("client_id", "gstin", key).agg(F.min("digits").alias(f"_{key}"), F.count("*").alias("_w"))  # noqa: B023, E731
        total = now.count()
        out = join_hot(join_hot(now, least("exact"), ["client_id", "gstin", "exact"], "_w", total), least("soft"), ["client_id", "gstin", "soft"], "_w", total)
        out = stored(out.withColumn("_new", F.least("_exact", "_soft")), "components")
        forget(held)
        if out.where("_new < digits").isEmpty():
            return out.select(*_KEYS, "n", "digits")
        now, held = out.select(*_KEYS, "n", F.col("_new").alias("digits")), out


def _in_places(sides: DataFrame, tolerance: float) -> DataFrame:
    """Components of one exact and one soft key: the n-th row takes the n-th book, for whatever is open has both keys. Places come from ranges, so a component spreads over tasks."""
    placed = positions(sides.withColumn("_of", F.struct(*_KEYS, "side")), "_of", [F.col("id")], "place").drop("_of")
    book = placed.where("side = 0").select(*_KEYS, "place", F.col("id").alias("invoice_id"), F.col("taxable").alias("_taxable"), F.col("tax").alias("_tax"), F.col("left_taxable").alias("_left_taxable"), F.col("left_tax").alias("_left_tax"))
    row = placed.where("side = 1").select(*_KEYS, "place", F.col("id").alias("row_id"), "taxable", "tax")
    met = row.join(book, [*_KEYS, "place"], "full")
    gap, tax_gap = F.abs(F.col("_taxable") - F.col("taxable")), F.abs(F.col("_tax") - F.col("tax"))
    alone, missing = F.col("invoice_id").isNull(), F.col("row_id").isNull()
    return met.select(
        "client_id", "gstin", "row_id", "invoice_id", F.when(alone, "MISSING_IN_BOOKS").when(missing, "MISSING_IN_2B").when((gap <= tolerance) & (tax_gap <= tolerance), "MATCHED").otherwise("VALUE_MISMATCH").alias("status"),
        F.when(alone, F.col("taxable")).when(missing, F.col("_left_taxable")).otherwise(gap).alias("taxable_diff"), F.when(alone, F.col("tax")).when(missing, F.col("_left_tax")).otherwise(tax_gap).alias("tax_diff"), F.col("tax").alias("row_tax"),
    )


def _walked(sides: DataFrame, tolerance: float) -> DataFrame:
    ordered = sides.select(*_SIDES).repartition("client_id", "gstin", "digits").sortWithinPartitions("client_id", "gstin", "digits", "side", "id")
    return ordered.mapInArrow(_walk(tolerance), RESULT)


def reconcile(rows: DataFrame, books: DataFrame, tolerance: float = 1.0, walked: int = WALKED) -> DataFrame:
    """Match each portal row with at most one book: MATCHED, VALUE_MISMATCH, MISSING_IN_BOOKS, and MISSING_IN_2B for books left over.

    Numbers that are equal exactly or softly have the same digits in the same order, and both phases need the same registration, so the groups (client, registration,
    digits) are independent. Groups of up to `walked` records are shuffled and sorted with the books first, and a task walks them in order, one at a time.
    A larger group (numbers without digits, rows without registration) falls apart further, into the connected components of its exact and soft keys:
    a component of one exact and one soft key is settled by places, without a task of its own; only components that mix keys are walked, each by itself.
    All give what the sequential rule gives. Results carry row_tax, the portal row's tax. Ids are unique within a client only; a null client is a client of its own.
    """
    none = F.lit(None).cast("double")
    left = book_side(books).withColumn("side", F.lit(0)).withColumnRenamed("invoice_id", "id")
    right = row_side(rows).withColumns({"side": F.lit(1), "left_taxable": none, "left_tax": none}).withColumnRenamed("row_id", "id")
    typed = [F.col("client_id").cast("int").alias("client_id"), "gstin", "digits", "side", F.col("id").cast("long").alias("id"), *_SIDES[5:]]
    sides = stored(left.select(*typed).unionByName(right.select(*typed)), "sides")

    group = ["client_id", "gstin", "digits"]
    large = sides.where("client_id IS NOT NULL").groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > walked)
    large = stored(large, "large-groups")
    sizes = large.agg(F.count("*"), F.sum("n")).first()
    if not sizes[0]:
        return _walked(sides, tolerance)
    total = sides.count()
    inside = stored(join_hot(sides, large, group, "n", total), "large-sides")
    pairs = stored(inside.groupBy(*_KEYS).agg(F.count("*").alias("n")), "key-pairs")
    count = pairs.count()
    for key in ("exact", "soft"):  # how many pairs a key is in
        degree = pairs.groupBy("client_id", "gstin", key).agg(F.count("*").alias(f"of_{key}"), F.count("*").alias("_w"))
        pairs = join_hot(pairs, degree, ["client_id", "gstin", key], "_w", count)
    pairs = stored(pairs, "key-pairs")
    simple, mixed = pairs.where("of_exact = 1 AND of_soft = 1").select(*_KEYS, "n"), pairs.where("of_exact > 1 OR of_soft > 1").select(*_KEYS, "n")
    settled = _in_places(join_hot(inside, simple, _KEYS, "n", sizes[1]), tolerance)
    of_mixed = join_hot(inside.drop("digits"), _mixed_components(mixed), _KEYS, "n", sizes[1])
    return _walked(sides.join(large.drop("n"), group, "left_anti"), tolerance).unionByName(settled).unionByName(_walked(of_mixed, tolerance))


def notes(results: DataFrame) -> DataFrame:
    """Results with the note of each: the two differences with two decimals where values disagree, else what the status means."""
    amount = lambda c: V.two_places(V.to_paise(F.col(c)))
    said = {"MATCHED": "Matched", "MISSING_IN_BOOKS": "Present in GSTR-2B but not found in purchase register", "MISSING_IN_2B": "Present in books but missing in GSTR-2B"}  # fixed values
    note = F.when(F.col("status") == "VALUE_MISMATCH", F.concat(F.lit("Taxable Δ ₹"), amount("taxable_diff"), F.lit(", Tax Δ ₹"), amount("tax_diff")))
    for status, text in said.items():
        note = note.when(F.col("status") == status, text)
    return results.withColumn("notes", note)


def reconcile_windows(rows: DataFrame, books: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """J7 by ranks within keys: exact keys first, then soft keys among what is left. Joins and windows only, over sides that are stored once.

    Equal to reconcile unless an earlier row's soft match takes the book that a later row would match exactly.
    """
    books, rows = stored(book_side(books), "books"), stored(row_side(rows), "rows")  # each is read by up to six branches

    def phase(b: DataFrame, r: DataFrame, key: str) -> DataFrame:
        by = ["client_id", "gstin", key]
        b = b.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("invoice_id")))
        r = r.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("row_id")))
        return r.select(*by, "_n", "row_id", F.col("taxable").alias("r_taxable"), F.col("tax").alias("r_tax")).join(b.select(*by, "_n", "invoice_id", "taxable", "tax"), [*by, "_n"])

    pairs = ["client_id", "gstin", "row_id", "invoice_id", F.abs(F.col("taxable") - F.col("r_taxable")).alias("taxable_diff"), F.abs(F.col("tax") - F.col("r_tax")).alias("tax_diff"), F.col("r_tax").alias("row_tax")]
    first = stored(phase(books, rows, "exact").select(*pairs), "exact-pairs")
    books_left = books.join(first.select("client_id", "invoice_id"), ["client_id", "invoice_id"], "left_anti")
    rows_left = rows.join(first.select("client_id", "row_id"), ["client_id", "row_id"], "left_anti")
    second = stored(phase(books_left, rows_left, "soft").select(*pairs), "soft-pairs")
    near = V.within(F.col("taxable_diff"), F.lit(0.0), tolerance) & V.within(F.col("tax_diff"), F.lit(0.0), tolerance)
    matched = first.unionByName(second).withColumn("status", F.when(near, "MATCHED").otherwise("VALUE_MISMATCH"))
    none = F.lit(None).cast("long")
    only_rows = rows_left.join(second.select("client_id", "row_id"), ["client_id", "row_id"], "left_anti").select("client_id", "gstin", "row_id", none.alias("invoice_id"), F.col("taxable").alias("taxable_diff"), F.col("tax").alias("tax_diff"), F.col("tax").alias("row_tax"), F.lit("MISSING_IN_BOOKS").alias("status"))
    only_books = books_left.join(second.select("client_id", "invoice_id"), ["client_id", "invoice_id"], "left_anti").select("client_id", "gstin", none.alias("row_id"), "invoice_id", F.col("left_taxable").alias("taxable_diff"), F.col("left_tax").alias("tax_diff"), F.lit(None).cast("double").alias("row_tax"), F.lit("MISSING_IN_2B").alias("status"))
    return matched.unionByName(only_rows).unionByName(only_books).select("client_id", "gstin", "row_id", "invoice_id", "status", "taxable_diff", "tax_diff", "row_tax")


def summary(results: DataFrame) -> DataFrame:
    """A10: counts by status, and tax credit in paise: that of matched rows, and the difference of all others."""
    paise = lambda c: F.floor(c * 100 + F.lit(0.5)).cast("long")
    is_ = lambda s: F.col("status") == s
    return results.groupBy("client_id").agg(
        *[F.count_if(is_(s)).alias(f"n_{s.lower()}") for s in STATUSES[:4]],
        F.coalesce(F.sum(F.when(is_("MATCHED"), paise(F.col("row_tax")))), F.lit(0)).alias("itc_eligible_p"),
        F.coalesce(F.sum(F.when(~is_("MATCHED"), paise(F.col("tax_diff")))), F.lit(0)).alias("itc_at_risk_p"),
    )


def by_status(results: DataFrame) -> DataFrame:
    """Results with the place of their status in its declaration, ordered by it within the client; a range sort, so no client fills a task."""
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")).cast("int")
    return results.withColumn("status_order", place).orderBy("client_id", "status_order", F.col("row_id").asc_nulls_last(), F.col("invoice_id").asc_nulls_last())


def upload_tables(results: DataFrame, rows: DataFrame, uploads: DataFrame, created_at: Column) -> dict[str, DataFrame]:
    """K6: what a run stores: rows and matches under the upload's id, and one header a client that sent a file.

    uploads: client_id, upload_id, file_name, period. The header has how many rows came, the counts by status and the tax credit, zeros for a client without results. Matches have notes.
    Rows and results of clients without an upload belong to no run and are left out.
    """
    asked = uploads.select("client_id", "upload_id", "file_name", "period")
    count = rows.groupBy("client_id").agg(F.count("*").alias("row_count"))
    sums = summary(results)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ["row_count", *sums.columns[1:]]}
    header = asked.join(count, "client_id", "left").join(sums, "client_id", "left").withColumns(zero).withColumn("created_at", created_at)
    own = asked.select("client_id", "upload_id")
    return {"rows": rows.join(own, "client_id"), "matches": notes(results).drop("row_tax", "gstin").join(own, "client_id"), "header": header}


def persist(results: DataFrame, rows: DataFrame, uploads: DataFrame, created_at: Column, path: str, run: str) -> bool:
    """K6 as one transaction: rows, matches and header become readable together under the run's name, see snapshots; a run that is there already is left as it is."""
    if run in snapshots.runs(results.sparkSession, path):
        return False
    results = stored(results, "matches")  # once, so that header and matches agree
    return snapshots.commit(path, run, upload_tables(results, rows, uploads, created_at))
