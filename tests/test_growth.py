"""Expressions that a query evaluates once, however often its plan could repeat them."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_operators import BOOK, ROW
from vahi.operators import drafts, ledgers, reconcile
from vahi.plans import catalogue
from vahi.sources import files
from vahi.storage import METHOD_LIMIT


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["v5_voucher_lines", "v1_validation_codes"])
def test_arrays_are_not_made_again_for_a_filter(spark, name):
    """Spark's own filter below an explode would hold the whole expression of the array."""
    assert not re.search(r"Filter \(+size\(", _plan(catalogue.QUERIES[name](spark, SMALL)))


def test_amounts_of_items_are_read_once(spark):
    out = files.invoice_rows(spark.createDataFrame([('{"items": [{"qty": 2, "rate": "1.50"}, {"price": 0, "qty": "3", "rate": 2}, {"total": "7"}]}',)], "payload string"), F.lit("1998-06-01").cast("timestamp"))
    assert [x.price for x in out.first()["items"]] == [3.0, 6.0, 7.0]
    transform = _plan(out.select("items"))
    assert len(re.findall(r"regexp_extract\(", transform)) == 4  # quantity, rate, price, tax rate


def test_sides_are_made_once(spark, monkeypatch):
    made, keep = [], reconcile.stored
    monkeypatch.setattr(reconcile, "stored", lambda df, name: made.append(name) or keep(df, name))
    reconcile.reconcile_windows(spark.createDataFrame([], ROW), spark.createDataFrame([], BOOK))
    assert made == ["books", "rows", "exact-pairs", "soft-pairs"]


def test_a_repeated_run_is_not_matched_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, None, "A1", 1.0, 1.0)], ROW)
    uploads = spark.createDataFrame([(1, 7, "f", "2024-01")], "client_id int, upload_id int, file_name string, period string")
    results = reconcile.reconcile(rows, spark.createDataFrame([], BOOK))
    now = F.lit("1998-06-01").cast("timestamp")
    assert reconcile.persist(results, rows, uploads, now, str(tmp_path / "runs"), "r1")
    fails = results.withColumn("tax_diff", F.raise_error(F.lit("made again")).cast("double"))
    assert not reconcile.persist(fails, rows, uploads, now, str(tmp_path / "runs"), "r1")


def test_stream_files_are_not_written_by_one_task(spark, monkeypatch):
    def fail(self, n):
        raise AssertionError("all rows in one task")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", fail)
    assert catalogue.QUERIES["m5_stream_memory"](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["k3_voucher_xml", "k3_import_document"])
def test_exports_make_invoices_and_lines_once(spark, name):
    """Vouchers, lines and entries are made of stored invoices and lines: the last plan reads no line items."""
    assert "lineitem.parquet" not in catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def _parties(spark):
    names = [f"acme nova {w} works" for w in ("aeio", "oiea", "urst", "mkmk")] + ["coral", "acme coral"]
    parties = spark.createDataFrame([(1, None, n) for n in names], "client_id int, gstin_key string, name_key string")
    rules = spark.createDataFrame([(1, "VENDOR_NAME_CONTAINS", k, 9 - k % 3, 100 + k, True, "Coral") for k in range(50)] + [(1, "VENDOR_NAME_EQUALS", 60 + k, 8, 200 + k, True, "CORAL") for k in range(50)], "client_id int, rule_type string, rule_id int, priority int, ledger_id long, enabled boolean, pattern string")
    memory = spark.createDataFrame([], "client_id int, match_type string, match_key string, ledger_id long, hit_count int")
    named = spark.createDataFrame([(1, 7, "acme nova aeio work", "PARTY"), (1, 8, "acme nova", "PARTY")], "client_id int, ledger_id long, name string, ledger_type string")
    return parties, rules, memory, named


def test_a_party_does_not_meet_all_rules_of_one_pattern(spark, monkeypatch):
    met, keep = {}, ledgers._best

    def best(rows, by, *order):
        met[tuple(by)] = rows.count()
        return keep(rows, by, *order)

    monkeypatch.setattr(ledgers, "_best", best)
    out = {r.name_key: (r.ledger_id, r.via) for r in ledgers.resolve_parties(*_parties(spark)).collect()}
    assert met["client_id", "gstin_key", "name_key"] == 3  # two names hold the pattern, one is equal to the other's
    assert out["coral"] == out["acme coral"] == (102, "RULE")


def test_parties_are_resolved_once_before_suggestions(spark):
    """The last plan looks for similar names once, for the suggestion; those of the resolution are stored."""
    parties, rules, memory, named = _parties(spark)
    out = ledgers.suggested(ledgers.resolve_parties(parties, rules, memory, named), ledgers.candidates_of(memory, named))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    got = {r.name_key: (r.ledger_id, r.suggested_ledger) for r in out.collect()}
    assert got["acme nova aeio works"] == (7, None) and got["acme nova mkmk works"] == (None, 8)


def test_drafts_make_only_what_they_have(spark, monkeypatch):
    """Columns that no draft has are not made and stored, lines are joined without their invoices' parties, and debits and credits are summed once."""
    plans, columns, limits, keep, was = {}, {}, {}, drafts.stored, spark.conf.get(METHOD_LIMIT)

    def watched(df, name):
        plans[name], columns[name], limits[name] = _plan(df), df.columns, spark.conf.get(METHOD_LIMIT)
        return keep(df, name)

    monkeypatch.setattr(drafts, "stored", watched)
    out = catalogue.QUERIES["v6_drafts"](spark, SMALL)
    assert not {"customer_gstin", "irn", "eway_bill_no"} & set(columns["to-draft"])
    assert limits == {"to-draft": "8000", "lines-to-draft": was} and spark.conf.get(METHOD_LIMIT) == was  # the widest stage is not interpreted
    assert "LeftOuter" not in plans["lines-to-draft"]
    assert len(re.findall(r"aggregate\(lines", _plan(out))) == 2
