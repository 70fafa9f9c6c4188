"""Rules that hold for any input: matching, balancing, similarity, amounts, the stream."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vahi.functions import text as T
from vahi.functions import values as V
from vahi.operators import reconcile

NUMBERS = ["INV 1", "INV1", "inv-1", "A/2", "A 2", None, "", "b3", "B-3"]
BOOK = "client_id int, invoice_id long, vendor_gstin string, invoice_number string, subtotal double, total_amount double, tax_amount double, cgst double, sgst double, igst double"
ROW = "client_id int, row_id long, supplier_gstin string, invoice_number string, taxable_value double, total_tax double"


def one_by_one(rows, books):
    """A plain model of the sequential rule."""
    squeeze = lambda x: re.sub(r"\s+", "", (x or "").upper())
    soft = lambda x: " ".join(re.sub(r"[.,&'\"/\\()-]", " ", (x or "").lower()).split())
    used, out = set(), set()
    for r in sorted(rows, key=lambda r: r[1]):
        free = [b for b in sorted(books, key=lambda b: b[1]) if b[0] == r[0] and (b[2] or "") == (r[2] or "") and b[1] not in used]
        hit = next((b for b in free if squeeze(b[3]) == squeeze(r[3])), None) or next((b for b in free if soft(b[3]) == soft(r[3])), None)
        if hit:
            used.add(hit[1])
            out.add((r[1], hit[1], "MATCHED" if abs(hit[4] - r[4]) <= 1 and abs(hit[6] - r[5]) <= 1 else "VALUE_MISMATCH"))
        else:
            out.add((r[1], None, "MISSING_IN_BOOKS"))
    return out | {(None, b[1], "MISSING_IN_2B") for b in books if b[1] not in used}


@pytest.mark.parametrize("seed", range(4))
def test_matching_is_sequential(spark, seed):
    rnd = random.Random(seed)
    gstins = ["27ABCDE0001F1Z5", None, "29ABCDE0002F1Z5"]
    books = [(rnd.randrange(3), k, rnd.choice(gstins), rnd.choice(NUMBERS), float(rnd.randrange(4)), 9.0, float(rnd.randrange(3)), 0.0, 0.0, 0.0) for k in range(80)]
    rows = [(rnd.randrange(3), k, rnd.choice(gstins), rnd.choice(NUMBERS), float(rnd.randrange(4)), float(rnd.randrange(3))) for k in range(80)]
    got = reconcile.reconcile(spark.createDataFrame(rows, ROW), spark.createDataFrame(books, BOOK)).collect()
    assert {(r.row_id, r.invoice_id, r.status) for r in got} == one_by_one(rows, books)
    assert len(got) == len({r.row_id for r in got if r.row_id is not None}) + sum(r.row_id is None for r in got)


def test_matching_of_a_large_group_is_sequential(spark):
    """One group of 30,000 rows whose numbers have no digits, with the case in which an earlier row's soft match takes the book that a later row would match exactly."""
    rnd = random.Random(1)
    numbers = ["".join(rnd.choices("ab -/", k=4)) for _ in range(300)]
    books = [(0, k, None, rnd.choice(numbers), float(rnd.randrange(4)), 9.0, float(rnd.randrange(3)), 0.0, 0.0, 0.0) for k in range(15_000)]
    rows = [(0, k, None, rnd.choice(numbers), float(rnd.randrange(4)), float(rnd.randrange(3))) for k in range(15_000)]
    books.append((0, 90_000, None, "Z Z", 1.0, 9.0, 1.0, 0.0, 0.0, 0.0))
    rows += [(0, 90_000, None, "z-z", 1.0, 1.0), (0, 90_001, None, "ZZ", 1.0, 1.0)]
    got = reconcile.reconcile(spark.createDataFrame(rows, ROW), spark.createDataFrame(books, BOOK)).collect()
    want = fast_one_by_one(rows, books)
    assert (90_000, 90_000, "MATCHED") in want and (90_001, None, "MISSING_IN_BOOKS") in want
    assert len(got) == len(want) and {(r.row_id, r.invoice_id, r.status) for r in got} == want


def fast_one_by_one(rows, books):
    """The plain model with the books of each key in lists."""
    squeeze = lambda x: re.sub(r"\s+", "", (x or "").upper())
    soft = lambda x: " ".join(re.sub(r"[.,&'\"/\\()-]", " ", (x or "").lower()).split())
    used, out, by = set(), set(), {}
    for b in sorted(books, key=lambda b: b[1]):
        for k in (("e", squeeze(b[3])), ("s", soft(b[3]))):
            by.setdefault(k, []).append(b)
    for r in sorted(rows, key=lambda r: r[1]):
        hit = None
        for k in (("e", squeeze(r[3])), ("s", soft(r[3]))):
            mine = by.get(k, [])
            while mine and mine[0][1] in used:
                mine.pop(0)
            if mine:
                hit = mine[0]
                break
        if hit:
            used.add(hit[1])
            out.add((r[1], hit[1], "MATCHED" if abs(hit[4] - r[4]) <= 1 and abs(hit[6] - r[5]) <= 1 else "VALUE_MISMATCH"))
        else:
            out.add((r[1], None, "MISSING_IN_BOOKS"))
    return out | {(None, b[1], "MISSING_IN_2B") for b in books if b[1] not in used}


def test_empty_sides(spark):
    out = reconcile.reconcile(spark.createDataFrame([], ROW), spark.createDataFrame([], BOOK))
    assert out.count() == 0


def test_vouchers_balance(spark):
    from vahi.plans import catalogue

    out = catalogue.QUERIES["v5_voucher_builder"](spark, SMALL)
    assert out.where("total_debit_p <> total_credit_p").count() == 0


def test_dice_is_symmetric(spark):
    names = spark.createDataFrame([("acme",), ("acme nova",), ("nova",), ("a",), ("",), (None,)], "a string")
    both = names.join(names.withColumnRenamed("a", "b")).select(T.dice(F.col("a"), F.col("b")).alias("x"), T.dice(F.col("b"), F.col("a")).alias("y"), (F.col("a") == F.col("b")).alias("same"), F.length("a").alias("n"))
    for r in both.collect():
        assert r.x == r.y and 0 <= r.x <= 1
        assert r.x == 1 or not (r.same and r.n)


def test_amounts(spark):
    raw = spark.createDataFrame([("₹1,234.50",), ("-3",), ("abc",), (None,), ("1-2",)], "v string")
    assert [r.p for r in raw.select(V.to_paise(V.clean_money(F.col("v"))).alias("p")).collect()] == [123450, -300, 0, 0, 100]


def test_stream_is_the_batch(spark, tmp_path):
    from vahi.operators import bank
    from vahi.streaming import bank_stream

    rows = spark.createDataFrame([(1, 5, 0, "ATM WDL SELF", 10.0, 0.0, 7), (1, 6, 1, "NEFT Acme Traders", 0.0, 5.0, None), (1, 7, 2, "NEFT Acme Traders", 0.0, 5.0, 9)], "client_id int, txn_id long, sort_order int, description string, withdrawal double, deposit double, ledger_id long")
    rows.write.parquet(str(tmp_path / "in"))
    schema = "client_id int, txn_id long, sort_order int, description string, withdrawal double, deposit double, ledger_id long"
    stream = bank_stream.classified_stream(spark, str(tmp_path / "in"), schema)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("txn_id", "voucher_type").collect())) == sorted(map(tuple, bank.classify(rows).select("txn_id", "voucher_type").collect()))
    bank_stream.learn_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "memory"), str(tmp_path / "c2")).awaitTermination()
    assert {r.ledger_id for r in bank_stream.memory(spark, str(tmp_path / "memory")).collect()} == {7, 9}


def test_exports_as_files(spark, tmp_path):
    """The files of a client's folder, read by name, are its export: CSV with header and doubled quotes, XML as one well-formed document with masters before vouchers."""
    import csv
    import xml.etree.ElementTree as ET

    from vahi.operators import export
    from vahi.sources.bindings import view

    t = lambda name: view(spark, SMALL, name)
    inv = t("invoice").withColumn("vendor", F.when(F.col("invoice_id") % 2 == 0, 'a "b", c').otherwise(F.col("vendor")))
    export.write_csv(inv, str(tmp_path / "csv"))
    files = sorted((tmp_path / "csv" / "client_id=7").glob("*.csv"))
    rows = [r for f in files for r in list(csv.reader(open(f)))[1:]]
    assert next(csv.reader(open(files[0]))) == list(export.CSV_COLUMNS)
    want = [r.invoice_number or "" for r in inv.where("client_id = 7").orderBy(F.desc("created_at"), "invoice_id").collect()]
    assert [r[0] for r in rows] == want and 'a "b", c' in {r[1] for r in rows}

    document = export.import_document(export.ledger_xml(t("ledger")), export.voucher_xml(t("voucher"), t("voucher_line"), t("invoice")), t("client"))
    export.write_xml(document, str(tmp_path / "xml"))
    files = sorted((tmp_path / "xml" / "client_id=7").glob("*.txt"))
    root = ET.fromstring("".join(open(f).read() for f in files).encode())
    messages = [m[0].tag for m in root.iter("TALLYMESSAGE")]
    assert messages == sorted(messages) and {"LEDGER", "VOUCHER"} == set(messages)
    for v in root.iter("VOUCHER"):
        assert v.get("REMOTEID").startswith("V-") and v.find("DATE").text in v.get("REMOTEID")


def test_portal_csv_with_blank_lines(spark, tmp_path):
    from vahi.sources import files

    (tmp_path / "a.csv").write_text('gstin,Supplier,Invoice No,Invoice Date,Taxable,IGST,CGST,SGST,Cess\n\n"27 abcde","A ""x"", Ltd","7",5/3/24,"1,000.50",,9,9,1\n\n')
    (tmp_path / "b.csv").write_text("gstin,supplier\n")
    (row,) = files.read_portal_csv(spark, str(tmp_path / "a.csv")).collect()
    assert (row.supplier_gstin, row.supplier_name, row.invoice_number, str(row.invoice_date), row.taxable_value, row.total_tax, row.invoice_type) == ("27ABCDE", 'A "x", Ltd', "7", "2024-03-05", 1000.5, 19.0, "B2B")
    assert files.read_portal_csv(spark, str(tmp_path / "b.csv")).count() == 0


@pytest.mark.parametrize("name,text,kind", [("x_cn.pdf", None, "credit_note"), ("my debit.pdf", None, "debit_note"), ("scan.pdf", '{"a": "Cash Receipt"}', "receipt"), ("scan.pdf", '{"a": "receipt"}', "invoice"), ("bank.pdf", None, "bank"), ("scan.pdf", '{"transactions": []}', "bank")])
def test_document_types(spark, name, text, kind):
    from vahi.operators import documents

    rows = spark.createDataFrame([(name, text)], "n string, e string")
    assert rows.select(documents.detect_type(F.col("n"), F.col("e")).alias("k")).first().k == kind


def test_equal_totals_have_no_deviation(spark):
    from vahi.operators import reports

    rows = spark.createDataFrame([(1, "v", k, k, 98_765_432.1) for k in range(6)] + [(1, "v", 9, 9, 98_765_435.1)], "client_id int, vendor string, invoice_id long, created_at long, total_amount double")
    out = {r.invoice_id: r for r in reports.anomalies(rows).collect()}
    assert all(out[k].z == 0 for k in range(3, 6)) and abs(out[9].z - 3) < 1e-6 and out[9].is_anomaly


@pytest.mark.parametrize("least", [0.5, 0.72, 0.9])
def test_similarity_join_is_that_of_all_pairs(spark, least):
    from vahi.operators.matching import contains_join, dice_join

    rnd = random.Random(3)
    names = ["".join(rnd.choices("abc ", k=rnd.randrange(1, 9))) for _ in range(60)] + ["a", "", "aaaa", "aaaaaa"]
    x, y = spark.createDataFrame([(k % 2, v) for k, v in enumerate(names)], "c int, a string"), spark.createDataFrame([(k % 2, v) for k, v in enumerate(reversed(names))], "c int, b string")
    every = x.join(y, "c").withColumn("score", T.dice(F.col("a"), F.col("b"))).distinct()
    assert set(map(tuple, dice_join(x, y, "a", "b", ["c"], least).collect())) == {(r.c, r.a, r.b, r.score) for r in every.where(F.col("score") >= least).collect()}
    assert set(map(tuple, contains_join(x, y, "a", "b", ["c"]).collect())) == {(r.c, r.a, r.b) for r in every.collect() if r.b and r.b in r.a}


@pytest.mark.parametrize("tasks", ["1", "7"])
def test_positions_of_a_hot_group(spark, tasks):
    from vahi.operators.order import positions

    rows = spark.createDataFrame([(0 if k % 4 else None, k) for k in range(500)] + [(1, 3)], "g int, k long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = {(r.g, r.k): r.position for r in positions(rows, "g", [F.desc("k")]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in (0, None, 1):
        mine = sorted((k for h, k in got if h == g), reverse=True)
        assert [got[g, k] for k in mine] == list(range(1, len(mine) + 1))


def test_small_helpers(spark):
    from vahi.operators import vouchers

    row = spark.createDataFrame([(1234, "PURCHASE")], "p long, k string").select(V.to_rupees(F.col("p")).alias("r"), V.within(F.col("p"), F.lit(1233), 1.0).alias("w"), vouchers.is_purchase_resolve(F.col("k")).alias("b")).first()
    assert (row.r, row.w, row.b) == (12.34, True, True)
    assert T.export_file_name("tally", "Acme  & Co", "2024-01-31", "xml") == "tally_Acme_&_Co_2024-01-31.xml"
