"""Queries over pages, layouts and amounts against their SQL on the smallest tables, and small cases of their operators."""

import decimal

import pytest

from tallyforge.operators import report, statement
from tallyforge.operators.lines import line_totals
from tallyforge.plans import catalog, forms
from tallyforge.sources import documents

D = "/root/testdata/sf0.001"
FAST = ("amount_round_trip", "invoice_line_totals", "hinted_dates", "unlabelled_vendors", "best_readings", "file_kinds", "page_texts", "ledger_layouts", "named_vendors", "staged_readings", "impossible_dates", "csv_records", "amounts_in_words", "page_angles", "sample_subset", "near_places", "vendor_ratios")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    cur = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    at = [names.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, (tuple(r[k] for k in at) for r in cur.fetchall())))


def test_every_query_here_has_sql():
    assert set(forms.QUERIES) == set(forms.ORACLES)


FRAGMENTS = [
    # a line is held to its first height: 697 is too far from 700, however near it is to 698.5
    ("heights", 1, 10.0, 20.0, 700.0, "a"), ("heights", 2, 30.0, 40.0, 698.5, "b"), ("heights", 3, 10.0, 20.0, 697.0, "c"),
    ("spaces", 1, 10.0, 20.0, 5.0, "a "), ("spaces", 2, 30.0, 40.0, 5.0, "b"), ("spaces", 3, 50.0, 60.0, 5.0, " c "), ("spaces", 4, 61.0, 62.0, 5.0, "d "),
    ("empty", 1, 10.0, 20.0, 5.0, ""), ("empty", 2, 10.0, 20.0, 9.0, None),
    ("drawn", 1, 10.0, 20.0, 698.0, "low"), ("drawn", 2, 30.0, 40.0, 700.0, "high"), ("drawn", 3, 5.0, 8.0, 701.0, "top"),
]


def test_page_text_by_first_heights(spark):
    rows = spark.createDataFrame(FRAGMENTS, "source_file string, ord int, x double, end double, y double, str string")
    got = {r.source_file: r.text for r in documents.page_text(rows).collect()}
    assert got == {"heights": "a b\nc", "spaces": "a b c d", "empty": "", "drawn": "top\nlow high"}


def test_line_totals(spark):
    items = spark.createDataFrame([(1, 3.0, 0.335), (1, 1.0, 1.0), (2, None, 5.0), (2, 2.0, -1.25)], "invoice long, quantity double, unit_price double")
    got = {r.invoice: (r.n_lines, r.subtotal, r.tax, r.total) for r in line_totals(items, 0.2).collect()}
    d = decimal.Decimal
    assert got == {1: (2, d("2.01"), d("0.40"), d("2.41")), 2: (2, d("-2.50"), d("-0.50"), d("-3.00"))}
    assert line_totals(items.limit(0), 0.2).count() == 0


def test_open_ages(spark):
    amounts = dict.fromkeys(statement.AGE_BUCKETS, 0.0) | {"d31_60": 5.0, "undated": 2.5}
    totals = spark.createDataFrame([("v", False, *amounts.values())], "vendor string, grand boolean, " + ", ".join(f"{b} double" for b in amounts))
    assert sorted(tuple(r) for r in statement.open_ages(totals).collect()) == [("v", False, "d31_60", "31-60 days", 5.0), ("v", False, "undated", "Undated", 2.5)]


def test_summary_of_nothing(spark):
    from tallyforge.model import INVOICE, LEDGER_ROW
    from tallyforge.operators import match

    none = match.reconcile(spark.createDataFrame([], INVOICE), spark.createDataFrame([], LEDGER_ROW))
    got = {r["item"]: r["value"] for r in report.summary_lines(none).collect()}
    assert got == {"Total items": "0", "Matched clean": "0", "Flagged": "0", "Match rate": "n/a", "Note": report.NOTE}
    assert report.one_line(none).first().line == "0 invoices, 0 ledger rows -> 0/0 matched clean, 0 flagged"
