"""Hot groups, joins that meet at rare parts, sums carried over ranges, transactions, tables by client, files, the stream's base and log."""

import os
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_operators import BOOK, ROW, fast_one_by_one, one_by_one
from vahi.functions import text as T
from vahi.functions import values as V
from vahi.operators import documents, drafts, matching, order, reconcile, reports, screens
from vahi.sources import files, snapshots
from vahi.streaming import bank_stream

WORDS = ["INV 1", "INV1", "inv-1", "A/2", "A 2", "a-2", None, "", "b3", "B-3", "x y", "xy", "x-y", "X Y", "-", "z"]


@pytest.mark.parametrize("seed", range(3))
def test_split_groups_are_sequential(spark, seed):
    """Every group goes the way of large ones: components by places, mixed ones walked."""
    rnd = random.Random(seed)
    gstins = ["27ABCDE0001F1Z5", None]
    books = [(rnd.randrange(2), k, rnd.choice(gstins), rnd.choice(WORDS), float(rnd.randrange(4)), 9.0, float(rnd.randrange(3)), 0.0, 0.0, 0.0) for k in range(150)]
    rows = [(rnd.randrange(2), k, rnd.choice(gstins), rnd.choice(WORDS), float(rnd.randrange(4)), float(rnd.randrange(3))) for k in range(150)]
    got = reconcile.reconcile(spark.createDataFrame(rows, ROW), spark.createDataFrame(books, BOOK), walked=3).collect()
    assert {(r.row_id, r.invoice_id, r.status) for r in got} == one_by_one(rows, books)
    assert len(got) == len(one_by_one(rows, books))
    plain = reconcile.reconcile(spark.createDataFrame(rows, ROW), spark.createDataFrame(books, BOOK)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, plain), key=str)


def test_a_group_of_a_million_rows(spark):
    """No registration, no digits: half of the rows have one number, most others pairs of keys of their own, some mix keys."""
    n = 500_000
    number = F.when(F.col("id") % 2 == 0, "same").when(F.col("id") % 50 == 1, F.element_at(F.array(*map(F.lit, ("p q", "pq", "p-q"))), (F.col("id") % 3 + 1).cast("int"))).otherwise(F.concat(F.lit("n"), F.translate((F.col("id") % 7919).cast("string"), "0123456789", "abcdefghij")))
    books = spark.range(n).select(F.lit(1).alias("client_id"), F.col("id").alias("invoice_id"), F.lit(None).cast("string").alias("vendor_gstin"), number.alias("invoice_number"), (F.col("id") % 5).cast("double").alias("subtotal"), *[F.lit(0.0).alias(c) for c in ("total_amount", "tax_amount", "cgst", "sgst", "igst")])
    rows = spark.range(n).select(F.lit(1).alias("client_id"), F.col("id").alias("row_id"), F.lit(None).cast("string").alias("supplier_gstin"), F.when(F.col("id") % 3 == 0, F.upper(number)).otherwise(number).alias("invoice_number"), (F.col("id") % 7).cast("double").alias("taxable_value"), F.lit(0.0).alias("total_tax"))
    got = {(r[0], r[1], r[2]) for r in reconcile.reconcile(rows, books).select("row_id", "invoice_id", "status").toArrow().to_pandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False)}
    want = fast_one_by_one([tuple(r) for r in rows.collect()], [tuple(r) for r in books.collect()])
    assert {(None if a is None else int(a), None if b is None else int(b), s) for a, b, s in got} == want


def test_notes(spark):
    rows = spark.createDataFrame([("MATCHED", 0.0, 0.0), ("VALUE_MISMATCH", 12.5, 1234567.005), ("MISSING_IN_2B", 1.0, 1.0), ("MISSING_IN_BOOKS", 1.0, 1.0)], "status string, taxable_diff double, tax_diff double")
    said = {r.status: r.notes for r in reconcile.notes(rows).collect()}
    assert said["MATCHED"] == "Matched" and said["VALUE_MISMATCH"].startswith("Taxable Δ ₹12.50, Tax Δ ₹1234567.0") and all(said.values())


def test_similar_names_that_share_words(spark):
    """Half of all names begin alike; the candidates that are compared are few beside all pairs, and none is lost."""
    rnd = random.Random(4)
    stems = ["acme nova", "acme royal"]
    names = [f"{rnd.choice(stems)} {''.join(rnd.choices('aeioukmrst', k=5))}" if k % 2 else "".join(rnd.choices("abcdefghij ", k=12)) for k in range(400)]
    x = spark.createDataFrame([(1, v) for v in names[:200]], "c int, a string")
    y = spark.createDataFrame([(1, v) for v in names[200:]], "c int, b string")
    every = x.join(y, "c").distinct().withColumn("score", T.dice(F.col("a"), F.col("b")))
    want = {(r.c, r.a, r.b, r.score) for r in every.where("score >= 0.86").collect()}
    assert set(map(tuple, matching.dice_join(x, y, "a", "b", ["c"], 0.86).collect())) == want
    pairs, _ = matching.dice_candidates(matching._texts(x, "a", ["c"]), matching._texts(y, "b", ["c"]), ["c"], 0.86)
    assert pairs.count() < 0.2 * every.count() and pairs.distinct().count() == pairs.count()


def test_subset_join_is_that_of_all_pairs(spark):
    rnd = random.Random(9)
    names = [" ".join([rnd.choice(["acme", "acme", "nova"]), *rnd.choices(["ltd", "steel", "works", "agro", "acme", "x"], k=rnd.randrange(0, 4))]) for _ in range(120)] + ["", " ", "  acme  nova ", None]
    x, y = spark.createDataFrame([(k % 2, v) for k, v in enumerate(names)], "c int, a string"), spark.createDataFrame([(k % 2, v) for k, v in enumerate(reversed(names))], "c int, b string")
    want = {(r.c, r.a, r.b) for r in x.join(y, "c").distinct().where(T.token_subset(F.col("a"), F.col("b")) & (F.col("a") != F.col("b"))).collect()}
    got = [tuple(r) for r in matching.subset_join(x, y, "a", "b", ["c"]).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_many_patterns_of_one_beginning(spark):
    """10,000 patterns that begin alike meet texts at their rare parts."""
    code = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:05d}")
    hay = spark.createDataFrame([(1, f"upi payment to {code(k * 7)} branch", k) for k in range(2000)] + [(1, "", 0), (1, None, 0), (1, "x", 0)], "c int, t string, k int")
    needles = spark.createDataFrame([(1, f"payment to {code(k)}") for k in range(10_000)] + [(1, "x"), (1, "up"), (1, ""), (1, "é")], "c int, p string")
    got = matching.contains_join(hay, needles, "t", "p", ["c"]).collect()
    assert sum(r.p.startswith("payment") for r in got) == len([k for k in range(2000) if k * 7 < 10_000]) and sum(r.p == "up" for r in got) == 2000 and all(r.p in r.t for r in got)
    assert {r.t for r in got if r.p == "x"} == {"x"}


@pytest.mark.parametrize("tasks", ["1", "9"])
def test_sums_of_earlier_rows(spark, tasks):
    rows = spark.createDataFrame([(None if k % 5 == 0 else k % 2 * 0, "v", k, k * k % 31) for k in range(400)], "c int, v string, k long, x long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = order.earlier_sums(rows, ["c", "v"], [F.desc("k")], {"n": F.lit(1), "s": F.col("x")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for r in got:
        mine = [k for k in range(400) if (k % 5 == 0) == (r.c is None) and k > r.k]
        assert (r.n, r.s) == (len(mine), sum(k * k % 31 for k in mine))


def test_anomalies_of_a_hot_vendor(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("client_id"), F.lit("hot").alias("vendor"), F.col("id").alias("invoice_id"), F.col("id").alias("created_at"), F.when(F.col("id") == 19_999, 9e12).otherwise((F.col("id") % 10) * 1e9).alias("total_amount"))
    out = reports.anomalies(rows)
    assert out.count() == 19_997 and out.agg(F.max("n")).first()[0] == 19_999
    last = out.where("invoice_id = 19999").first()
    values = [(k % 10) * 1e9 for k in range(19_999)]
    mean = sum(values) / len(values)
    assert last.z == pytest.approx((9e12 - mean) / (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5, rel=1e-9) and last.is_anomaly


def test_review_order_of_ties(spark):
    rows = spark.createDataFrame([(10, 1, None, "ready", 3), (11, 1, None, "ready", 2), (12, 1, 1.0, "ready", 1), (13, 1, None, "ready", 4)], "voucher_id long, client_id int, avg_confidence double, priority string, created_at long")
    assert [r.voucher_id for r in sorted(reports.review_queue(rows).collect(), key=lambda r: r.position)] == [12, 13, 10, 11]


def test_money_of_every_type(spark):
    row = spark.range(1).select(
        F.lit(12345678.0).alias("big"), F.lit(0.0005).alias("tiny"), F.lit(1e12).alias("huge"), F.lit(float("inf")).alias("inf"), F.lit(7).alias("whole"), F.lit("1.5E7").alias("text"), F.lit(None).cast("double").alias("none"), F.lit(True).alias("flag"),
    )
    got = row.select(*[V.clean_money(F.col(c)).alias(c) for c in row.columns if c != "flag"]).first()
    assert (got.big, got.tiny, got.huge, got.inf, got.whole, got.text, got.none) == (12345678.0, 0.0005, 1e12, 0.0, 7.0, 1.57, 0.0)


@pytest.mark.parametrize(("said", "value"), [("12345678.9", 12345678.9), ("1.2345678E7", 12345678.0), ('"1.2345678E7"', 1.23456787), ("0.0005", 0.0005), ("1e12", 1e12), ("-20000000.25", -20000000.25), ('"-₹20,000.25"', -20000.25), ("true", 0.0), ("null", 0.0), ('""', 0.0), ("[1]", 0.0)])
def test_json_amounts(spark, said, value):
    one = lambda text: spark.createDataFrame([(text,)], "payload string")
    got = [
        files.bank_rows(one(f'{{"data": {{"transactions": [{{"withdrawal": {said}, "deposit": 1}}]}}}}')).first().withdrawal, files.flat_rows(one(f'[{{"txval": {said}, "inum": "7"}}]')).first().taxable_value,
        files.portal_rows(one(f'/* c */ {{"b2b": [{{"ctin": "x", "inv": [{{"inum": "7", "txval": {said}}}]}}]}}')).first().taxable_value, files.invoice_rows(one(f'{{"subtotal": {said}}}'), F.lit("2024-01-01").cast("timestamp")).first().subtotal,
    ]
    assert got == [value] * 4


def test_edits_of_all_fields(spark):
    rows = spark.createDataFrame([(1, "a", "old", "1", ["x"], 5.0, 6.0)], "invoice_id long, vendor string, vendor_address string, vendor_phone string, items array<string>, total_amount double, tax_amount double")
    updates = spark.createDataFrame([(1, "", None, ["y", "z"], 12345678.9)], "invoice_id long, vendor_address string, vendor_phone string, items array<string>, total_amount double")
    got = screens.patched(rows, updates).first()
    assert (got.vendor, got.vendor_address, got.vendor_phone, got["items"], got.total_amount, got.tax_amount) == ("a", "", "1", ["y", "z"], 12345678.9, 0.0)


def test_a_write_that_stops_halfway(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    good = {"rows": spark.range(5).toDF("a"), "header": spark.range(1).toDF("b")}


    bad = spark.range(3).toDF("b").select(F.assert_true(F.col("b") > 5).alias("b"))
    with pytest.raises(Exception):
        snapshots.commit(path, "r1", {"rows": spark.range(7).toDF("a"), "header": bad})
    assert snapshots.runs(spark, path) == [] and snapshots.read_all(spark, path, "rows") is None
    with pytest.raises(LookupError):
        snapshots.read(spark, path, "r1", "rows")
    assert snapshots.commit(path, "r1", good) and snapshots.read(spark, path, "r1", "rows").count() == 5
    assert not snapshots.commit(path, "r1", {"rows": spark.range(9).toDF("a")}) and snapshots.read(spark, path, "r1", "rows").count() == 5
    assert snapshots.commit(path, "r2", good) and snapshots.read_all(spark, path, "rows").count() == 10 and snapshots.runs(spark, path) == ["r1", "r2"]
    for name in ("", "a/b", "_x"):
        with pytest.raises(ValueError):
            snapshots.commit(path, name, good)


def test_in_place_keeps_other_folders(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 4, k) for k in range(40)], "voucher_id long, client_id int, x long")
    drafts.write_by_client(rows, str(tmp_path / "t"))
    stamp = lambda: {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "t").rglob("*.parquet"))}
    before = stamp()
    time.sleep(0.05)
    drafts.write_by_client(spark.createDataFrame([(100, 2, 7)], "voucher_id long, client_id int, x long"), str(tmp_path / "t"))
    after = stamp()
    assert {f for f in before if "client_id=2" not in f} == {f for f in after if "client_id=2" not in f} and all(after[f] == before[f] for f in before if "client_id=2" not in f)
    assert spark.read.parquet(str(tmp_path / "t")).where("client_id = 2").count() == 1
    some = drafts.of_clients(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([(2,)], "client_id int"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 1 and "PartitionFilters: [" in plan and "client_id" in plan.split("PartitionFilters")[1].split("]")[0]
    (scan,) = [x for x in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)]
    assert scan


def test_uploads_from_files(spark, tmp_path):
    batch = tmp_path / "in" / "b1"
    batch.mkdir(parents=True)
    for k in range(18):
        (batch / f"f{k:02d}.pdf").write_bytes(b"%PDF" + bytes([k]))
    (batch / "a.exe").write_bytes(b"MZ")
    (batch / "big.PNG").write_bytes(b"0" * 5000)
    (batch / "noending").write_bytes(b"1")
    found = documents.uploaded_files(spark, str(tmp_path / "in"))
    found = found.withColumn("bytes", F.when(F.col("bytes") > 4000, F.col("bytes") + documents.MOST_BYTES).otherwise(F.col("bytes")))  # as if large
    verdicts = {r.file_id: r.verdict for r in documents.admit(found.drop("verdict")).collect()}
    assert verdicts["a.exe"] == verdicts["noending"] == "wrong_type" and verdicts["big.PNG"] == "too_large"
    assert sum(v == "admitted" for v in verdicts.values()) == documents.MOST_FILES and verdicts["f17.pdf"] == "too_many"
    out = documents.admitted_contents(spark, str(tmp_path / "in"), documents.admit(found.drop("verdict")), most_bytes=4000)
    rows = {r.file_id: bytes(r.content) for r in out.collect()}
    assert len(rows) == documents.MOST_FILES and rows["f03.pdf"] == b"%PDF\x03"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4000)" in plan
    assert documents.uploaded_files(spark, str(tmp_path / "in"), "2999-01-01").count() == 0


def test_compaction_changes_nothing(spark, tmp_path):
    schema = "client_id int, txn_id long, description string, withdrawal double, deposit double, ledger_id long"
    where, memory = str(tmp_path / "in"), str(tmp_path / "memory")
    seen = []
    for k in range(4):
        rows = [(1, 10 * k + j, f"NEFT {name}", 1.0, 0.0, 5 + k) for j, name in enumerate(["acme", "nova", "acme"])]
        seen += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        bank_stream.learn_stream(bank_stream.classified_stream(spark, where, schema), memory, str(tmp_path / "cp")).awaitTermination()
        before = sorted(map(tuple, bank_stream.memory(spark, memory).collect()))
        if k in (1, 2):
            assert bank_stream.compact(spark, memory, k) and not bank_stream.compact(spark, memory, k) and not bank_stream.compact(spark, memory, k - 1)
        assert sorted(map(tuple, bank_stream.memory(spark, memory).collect())) == before
        # the batch is written again, as a restart does: its folder is below the watermark or replaced by itself
        spark.read.parquet(f"{memory}/log/batch={k}").coalesce(1).write.mode("overwrite").parquet(f"{memory}/log/batch={k}x")
        os.rename(f"{memory}/log/batch={k}x", tmp_path / f"gone{k}")
    got = {(r.client_id, r.match_key): (r.ledger_id, r.hit_count) for r in bank_stream.memory(spark, memory).collect()}
    assert got == {(1, "acme"): (8, 8), (1, "nova"): (8, 4)}
    log = spark.read.parquet(f"{memory}/log")
    plan = bank_stream.memory(spark, memory)._jdf.queryExecution().executedPlan().toString()
    assert log.count() > 0 and "PartitionFilters: [isnotnull(batch" in plan


def test_blank_text(spark):
    rows = spark.createDataFrame([("\n",), ("\tAcme\n",), (" ﻿x y ",), (None,)], "v string")
    assert [r.v for r in rows.select(T.blank_to_null(F.col("v")).alias("v")).collect()] == [None, "Acme", "x y", None]


def test_json_amounts_of_large_invoices(spark, tmp_path):
    """Amounts up to 9e11 in millionths: invoice numbers near the largest that the query's amounts are made of."""
    import duckdb

    from tests.conftest import SMALL, same_rows
    from vahi.plans import catalogue

    con = duckdb.connect()
    shift = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    for name in ("nation", "customer", "part", "orders", "lineitem"):
        key = shift.get(name)
        con.execute(f"COPY (SELECT *{f' REPLACE ({key} + 890000 AS {key})' if key else ''} FROM '{SMALL}/{name}.parquet') TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    same_rows(catalogue.QUERIES["c20_json_amounts"](spark, str(tmp_path)), con, catalogue.ORACLE_SQL["c20_json_amounts"])


def test_nearest_names_without_stored_pairs(spark, monkeypatch):
    """Small blocks: the best of each name by score and rank is that of all pairs, and similar names' pairs are neither shuffled nor stored."""
    monkeypatch.setattr(matching, "BLOCK", 16)
    rnd = random.Random(5)
    names = list({f"{rnd.choice(['acme nova', 'coral', 'a'])} {''.join(rnd.choices('aeé', k=rnd.randrange(4)))}".strip() for _ in range(200)} | {"a", "é", ""})
    x = spark.createDataFrame([(k % 2, v) for k, v in enumerate(names * 2)] + [(None, "acme nova"), (1, None)], "c int, a string")
    y = spark.createDataFrame([(k % 2, v, k % 3, k) for k, v in enumerate(names[::2])] + [(None, "acme nova", 0, 0)], "c int, b string, h int, k int")
    every = x.join(y, "c").distinct().withColumn("score", T.dice(F.col("a"), F.col("b"))).where("score >= 0.6").collect()
    for equal in (True, False):
        want = {}
        for r in sorted((r for r in every if equal or r.a != r.b), key=lambda r: (-r.score, r.h, r.k)):
            want.setdefault((r.c, r.a), (r.score, r.h, r.k))
        got = matching.nearest(x, y, "a", "b", ["c"], 0.6, ["h", "k"], equal=equal).collect()
        assert len(want) > 20 and {(r.c, r.a): (r.score, r.h, r.k) for r in got} == want and len(got) == len(want)
    joined = matching.dice_join(x, y, "a", "b", ["c"], 0.6)
    assert set(map(tuple, joined.collect())) == {(r.c, r.a, r.b, r.score) for r in every}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Aggregate" not in plan


@pytest.mark.parametrize("columns, words", [(16, 4), (100, 7), (1024, 4096)])
def test_shared_bigrams_are_counted_in_bits(monkeypatch, columns, words):
    """Two blocks' unequal texts that reach a score, and each one's best, are those of all pairs, for few and many texts, repeated bigrams, long texts and texts with nothing in common."""
    import numpy as np

    monkeypatch.setattr(matching, "COLUMNS", columns)
    monkeypatch.setattr(matching, "WORDS", words)
    rnd = random.Random(7)
    grams = lambda t: Counter(t[k : k + 2] for k in range(len(t) - 1))
    text = lambda letters: rnd.choice(["", "acme nova "]) + "".join(rnd.choices(letters, k=rnd.randrange(2, rnd.choice([6, 14, 300]))))
    for letters, more, n, least in (("ab", "ab", 40, 0.72), ("aei nu€𝄞", "aei nu€𝄞", 150, 0.7), ("aei nu", "aei nu", 1, 0.3), ("abc", "xyz", 30, 0.7), ("abcde", "abcde", 90, 1.0)):
        a = list(dict.fromkeys(text(letters) for _ in range(n)))
        b = list(dict.fromkeys([text(more) for _ in range(n + 60)] + a[::3]))
        same = np.array([b.index(t) if t in b else -1 for t in a])
        want = {(i, j): 2.0 * sum((grams(s) & grams(t)).values()) / (len(s) + len(t) - 2) for i, s in enumerate(a) for j, t in enumerate(b) if s != t}
        want = {at: score for at, score in want.items() if score >= least}
        got = list(zip(*(z.tolist() for z in matching._reaching(a, b, same, least, False)), strict=True))
        assert {(i, j): score for i, j, score in got} == want and len(got) == len(want)
        first = {}
        for (i, j), score in sorted(want.items(), key=lambda z: (-z[1], z[0])):
            first.setdefault(i, (j, score))
        assert {i: (j, score) for i, j, score in zip(*(z.tolist() for z in matching._reaching(a, b, same, least, True)), strict=True)} == first


def test_a_name_is_sent_once_for_many_neighbours(spark):
    """Names are sent once a block, and without their bigrams; a block is large."""
    rows = spark.range(6000).select(F.lit(1).alias("c"), F.concat(F.lit("acme "), F.col("id").cast("string")).alias("t"))
    blocks = matching._in_blocks(rows, ["c"])
    sent = matching._sent(blocks, blocks, ["c"], "_x", "_y")
    assert sent.count() == 6000 and set(sent.columns) == {"c", "t", "_x", "_y"}


def test_stored_tables_leave_no_shuffles(spark):
    """What a stored table was made with is deleted with its query, not some time later."""
    from vahi.storage import CLEANUP, stored

    left = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before, was = left(), spark.conf.get(CLEANUP)
    rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert rows.count() == 7 and spark.conf.get(CLEANUP) == was
    assert left() <= before + 1  # the one of count()
