"""One scenario for each rule of the reconciliation, all in one job: scenarios don't share numbers or amounts."""

import datetime
import difflib
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyforge.functions.sums import exact_sum
from tallyforge.model import INVOICE, LEDGER_ROW
from tallyforge.operators import assign, match, report, statement
from tallyforge.operators.ledger import UnknownLayout, detect
from tallyforge.operators.lineage import ranked

D = datetime.date


def day(n):
    return D(2025, 1, 1) + datetime.timedelta(days=n)


INVOICES = [
    # number, vendor, day, amount
    ("A-100", "Acme", 0, 100.0), ("B-100", "Acme", 0, 205.0), ("C-100", "Acme", 0, 300.0), ("D-100", "Acme", 0, None),
    ("E-100", "Acme", 0, 400.0), ("E-100", "Acme", 0, 400.0), (None, "Acme", 0, 500.0), ("F-100", "Acme", 0, 600.0), ("G-100", "Acme", 0, 700.0),
    ("H-100", "Acme", 0, 810.0), ("H-200", "Acme", 0, 20.0), ("I-100", "Acme", 0, 900.0), (None, None, None, None), ("J-100", None, None, None),
    ("K-100", "Birch Tools", 0, 1000.0), ("L-100", "Cedar", 0, 1100.0), ("M-100", "Early", 0, 1200.0), ("N-100", "Late", 3, 1200.0), ("O-100", "Acme", 0, 1300.0), ("P-100", "Acme", 0, 110.0),
]
LEDGER = [
    # day, description, reference, amount
    (1, "x", "A-100", 100.0), (1, "x", "B-100", 255.0), (1, "x", "D-100", 50.0), (1, "x", "E-100", 400.0), (2, "x", None, 500.0),
    (1, "x", "F-100", 360.0), (2, "x", "F-100", 240.0), (1, "x", "G-100", 360.0), (2, "x", "G-100", 240.0), (1, "x", "H-100 H-200", 830.0),
    (6, "x", None, 900.0), (1, "BIRCH TOOLS ltd", None, 1000.0), (1, "someone else entirely", None, 1000.0), (1, "cedar", None, 1100.0), (2, "cedar", None, 1100.0),
    (2, "x", "N-100", 1200.0), (5, "x", None, 1300.0), (1, "x", None, 110.01),
]


@pytest.fixture(scope="module")
def results(spark):
    invoices = spark.createDataFrame([(k, f"{k:03}.pdf", n, v, None if d is None else day(d), a, "text") for k, (n, v, d, a) in enumerate(INVOICES)], INVOICE)
    ledger = spark.createDataFrame([(k, day(d), t, r, a) for k, (d, t, r, a) in enumerate(LEDGER, 2)], LEDGER_ROW)
    out = match.reconcile(invoices, ledger).cache()
    match.assert_coverage(invoices, ledger, out)
    return out


@pytest.fixture(scope="module")
def rows(results):
    return results.orderBy("result_ord").collect()


def by(rows, k):
    r = rows[k]
    return r.ledger_row.row_index if r.ledger_row else None, list(r.flags), [x.row_index for x in r.extra_rows]


@pytest.mark.parametrize(
    "k, row, flags, extra",
    [
        (0, 2, [], []),
        (1, 3, ["amount_mismatch"], []),
        (2, None, ["no_ledger_entry"], []),
        (3, 4, ["unreadable_invoice"], []),
        (4, 5, ["duplicate_invoice"], []),
        (5, None, ["no_ledger_entry", "duplicate_invoice"], []),
        (6, 6, ["unreadable_invoice"], []),
        (7, 7, ["paid_in_instalments"], [8]),
        (8, 9, ["amount_mismatch"], []),
        (9, 11, ["combined_payment"], []),
        (10, 11, ["combined_payment"], []),
        (11, None, ["no_ledger_entry"], []),  # six days apart
        (12, None, ["unreadable_invoice"], []),
        (13, None, ["unreadable_invoice", "no_ledger_entry"], []),
        (14, 13, [], []),  # two candidates, one names the vendor
        (15, None, ["no_ledger_entry"], []),  # both name it
        (16, 17, [], []),  # an earlier invoice's fallback takes the row that a later one refers to
        (17, None, ["no_ledger_entry"], []),
        (18, 18, [], []),  # just five days apart
        (19, None, ["no_ledger_entry"], []),  # 0.01 apart in decimals, more in doubles
    ],
)
def test_scenarios(rows, k, row, flags, extra):
    assert by(rows, k) == (row, flags, extra)


def test_left_over_rows(rows):
    assert [r.ledger_row.row_index for r in rows[len(INVOICES) :]] == [10, 12, 14, 15, 16, 19]
    assert all(r.flags == ["no_invoice"] for r in rows[len(INVOICES) :])


def test_summary_and_statements(results):
    total = report.summary(results).first()
    assert (total.total, total.matched) == (26, 4)
    assert report.flag_counts(results).where("flag = 'no_invoice'").first().n == 6
    lines = statement.statement_lines(results)
    acme = {r.vendor: r for r in statement.statements(lines).collect()}["Acme"]
    assert acme.invoice_count == 14 and acme.unreadable_count == 1 and acme.overpaid == 50 + 20 + 810
    assert acme.outstanding == 300 + 400 + 340 + 900 + 110
    assert statement.in_order(statement.statements(lines)).collect()[-1].vendor is None
    assert statement.statement_totals(lines).where("grand").first().invoice_count == len(INVOICES)


def plain_rule(invoices, ledger):
    """The rule itself, in one loop: {inv_ord: (row, extra, kind)} of invoices (inv_ord, file, number, vendor, day, amount, method)."""
    free = {r[0]: r for r in sorted(ledger)}
    out = {}

    def names(vendor, text):
        v, t = (vendor or "").lower(), (text or "").lower()
        return bool(v) and (v in t or difflib.SequenceMatcher(None, v, t).ratio() >= 0.5)

    for k, _, number, vendor, when, amount, _ in sorted(invoices):
        if not number and (amount is None or when is None):
            continue
        own = [r for r in free.values() if number and r[3] == number]
        row, extra, kind = None, [], "none"
        if len(own) >= 2 and amount is not None and abs(sum(r[4] or 0.0 for r in own) - amount) <= 0.01:
            row, extra, kind = own[0][0], [r[0] for r in own[1:]], "instalments"
        elif own:
            row, kind = own[0][0], "match"
        elif amount is not None and when is not None:
            near = [r for r in free.values() if r[4] is not None and r[1] is not None and abs(r[4] - amount) <= 0.01 and abs((r[1] - when).days) <= 5]
            if len(near) != 1:
                near = [r for r in near if names(vendor, r[2])]
            if len(near) == 1:
                row, kind = near[0][0], "match"
        for r in [row, *extra]:
            free.pop(r, None)
        out[k] = (row, extra, kind)
    return out


def assigned(spark, invoices, ledger, few=None, monkeypatch=None):
    if few is not None:
        monkeypatch.setattr(match, "decide", lambda open_, rows: assign.decide(open_, rows, few))
    got = match.assign(spark.createDataFrame(invoices, INVOICE), spark.createDataFrame(ledger, LEDGER_ROW)).where("kind != 'skipped'").collect()
    out = {r.inv_ord: (r.row_index, list(r.extra), r.kind) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_passes_against_the_plain_rule(spark, monkeypatch, seed):
    """Passes alone, to the last invoice, over a few that contest numbers and amounts."""
    rng = random.Random(seed)
    numbers = [None, None, *(f"X-{k}" for k in range(6))]
    invoices = [(k, f"{k}.pdf", rng.choice(numbers), rng.choice(["Acme", "Birch", None]), day(rng.randrange(25)), rng.choice([10.0, 10.01, 20.0, 30.0]), "text") for k in range(16)]
    ledger = [(k, day(rng.randrange(25)), rng.choice(["acme paid", "birch", "x", "ceda"]), rng.choice(numbers), rng.choice([10.0, 10.01, 20.0])) for k in range(2, 18)]
    assert assigned(spark, invoices, ledger, 0, monkeypatch) == plain_rule(invoices, ledger)


@pytest.mark.parametrize("seed", [1, 3])
def test_against_the_plain_rule(spark, seed):
    """A pass and the loop: invoices and rows that contest few numbers and amounts."""
    rng = random.Random(seed)
    numbers = [None, *(f"X-{k}" for k in range(12 if seed < 3 else 40))]
    days, amounts = (12, [10.0, 20.0, 30.0, 50.0]) if seed < 3 else (60, [10.0, 10.01, 10.02, 20.0, 20.01, 30.0])
    invoices = [(k, f"{k}.pdf", rng.choice(numbers), rng.choice(["Acme", "Birch", "Cedar", None]), day(rng.randrange(days)), rng.choice([*amounts, None]), "text") for k in range(60)]
    ledger = [(k, day(rng.randrange(days)), rng.choice(["acme paid", "birch", "x", "ceda", "acm birc", None]), rng.choice(numbers), rng.choice(amounts)) for k in range(2, 72)]
    # One number that most carry, whose rows no other invoice is near to, and one whose rows others are near to.
    invoices += [(k, f"{k}.pdf", "HOT", "Acme", day(rng.randrange(12)), rng.choice([1.5, 3.0, 10.0]), "text") for k in range(60, 130)]
    ledger += [(k, day(40 + rng.randrange(12)), "x", "HOT", 1.5) for k in range(72, 90)]
    invoices += [(k, f"{k}.pdf", "WARM", "Acme", day(rng.randrange(12)), 10.0, "text") for k in range(130, 150)]
    ledger += [(k, day(rng.randrange(12)), "x", "WARM", 10.0) for k in range(90, 95)]
    turns = list(range(150))
    rng.shuffle(turns)
    invoices = [(turns[k], *rest) for k, *rest in invoices]
    want = plain_rule(invoices, ledger)
    assert assigned(spark, invoices, ledger) == want
    assert {"match", "none"} <= {kind for _, _, kind in want.values()}


@pytest.mark.parametrize("late", [False, True])
def test_one_hot_amount(spark, late):
    """Very many invoices and rows of one amount and day cost their sum: owners take their own, the others find several."""
    n = 5000
    named = [(k, f"{k}.pdf", f"N-{k}", "Acme", day(0), 9.99, "text") for k in range(n)]
    lone = [(n + k if late else -1 - k, f"l{k}.pdf", None, rng_vendor(k), day(0), 9.99, "text") for k in range(200)]
    rows = [(k + 2, day(1), f"payment {k % 50}", f"N-{k}", 9.99) for k in range(n)]
    rows += [(n + 2 + k, day(1), "payment", None, 9.99) for k in range(3)] + [(n + 5, day(1), "to vendor 7 gmbh", None, 9.99)]
    got = assigned(spark, named + lone, rows)
    assert all(got[k] == (k + 2, [], "match") for k in range(n))
    lone_rows = [got[k][0] for k, *_ in sorted(lone) if got[k][0] is not None]
    assert lone_rows == [n + 5] and len(got) == n + 200


def rng_vendor(k):
    return "to vendor 7 gmbh" if k == 7 else f"{k:05}" * 8


def test_one_giant_component(spark):
    """Amounts a cent apart chain all invoices and rows into one component, which no task meets whole."""
    rng = random.Random(5)
    n = 6000
    turns = list(range(n))
    rng.shuffle(turns)
    invoices = [(turns[k], f"{k}.pdf", None, f"vendor {k:04}", day(0), round(100 + k * 0.009, 3), "text") for k in range(n)]
    ledger = [(k + 2, day(1), f"to vendor {k:04}" if k % 3 else "x", None, round(100 + k * 0.009, 3)) for k in range(n)]
    near_only = {k: v for k, v in assigned(spark, invoices, ledger).items()}
    assert near_only == plain_rule_by_amount(invoices, ledger)


def plain_rule_by_amount(invoices, ledger):
    """The loop over rows of neighbouring amounts only."""
    by = {r[4]: r for r in ledger}
    free, out = set(by), {}
    for k, _, _, vendor, _, amount, _ in sorted(invoices):
        near = [by[a] for a in (round(amount + d * 0.009, 3) for d in (-1, 0, 1)) if a in free and abs(a - amount) <= 0.01]
        if len(near) != 1:
            near = [r for r in near if vendor in r[2] or difflib.SequenceMatcher(None, vendor, r[2]).ratio() >= 0.5]
        if len(near) == 1:
            free.discard(near[0][4])
        out[k] = (near[0][0], [], "match") if len(near) == 1 else (None, [], "none")
    return out


def test_sums_do_not_depend_on_order(spark):
    parts = [0.1] * 10 + [1e15, -1e15]
    sums = set()
    for seed in range(4):
        random.Random(seed).shuffle(parts)
        rows = spark.createDataFrame([(k, day(0), "x", "S", a) for k, a in enumerate(parts, 2)], LEDGER_ROW).repartition(4)
        sums.add(match.by_reference(spark.createDataFrame([(1, "f", "S", "v", day(0), 1.0, "text")], INVOICE), rows).first().total)
    assert sums == {1.0}


def test_sums_are_rounded_once(spark):
    """Groups and running sums equal correctly rounded ones, to the last bit; they decide at the tolerance."""
    rng = random.Random(2)
    make = [lambda: round(rng.uniform(-100, 100), 2), lambda: rng.choice([10.0, 10.01, 20.01]), lambda: rng.uniform(-1e9, 1e9), lambda: rng.choice([0.001, -0.003, None]), lambda: rng.uniform(-1e12, 1e12)]
    rows = [(g, k, make[g % len(make)]()) for g in range(60) for k in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "g int, k int, a double").repartition(5)
    values = {}
    for g, _, a in rows:
        values.setdefault(g, []).append(a or 0.0)
    got = df.groupBy("g").agg(exact_sum(F.col("a")).alias("s")).collect()
    assert {r.g: r.s for r in got} == {g: math.fsum(v) for g, v in values.items()}
    running = {(r.g, r.k): r.upto for r in ranked(df, "g", "k", "a").collect()}
    assert running == {(g, k): math.fsum(values[g][: k + 1]) for g, k, _ in rows}
    odd = spark.createDataFrame([(0, math.inf), (1, math.nan), (2, 1e300), (2, 1.0), (3, None)], "g int, a double").groupBy("g").agg(exact_sum(F.col("a")).alias("s"))
    assert {r.g: str(r.s) for r in odd.collect()} == {0: "inf", 1: "nan", 2: "1e+300", 3: "0.0"}


def test_white_space_of_any_kind(spark):
    refs = {"\tINV-1\u00a0INV-2 ": ["INV-1", "INV-2"], "INV-1\u2003/\u2003INV-2": ["INV-1", "INV-2"], "\u00a0INV-1\n": ["INV-1"], "A\x1fB": ["A", "B"], "A,": ["A", ""]}
    got = spark.createDataFrame([(r,) for r in refs], "r string").select("r", match.reference_tokens(F.col("r")).alias("t")).collect()
    assert {x.r: list(x.t) for x in got} == refs


def test_coverage_error(spark, results):
    invoices = spark.createDataFrame([(k, "x", None, None, None, None, "none") for k in range(3)], INVOICE)
    with pytest.raises(match.CoverageError):
        match.assert_coverage(invoices, spark.createDataFrame([], LEDGER_ROW), results.limit(0))


def test_results_are_final_only_if_covered(spark, tmp_path, monkeypatch):
    invoices = spark.createDataFrame([(k, f"{k:03}.pdf", n, v, None if d is None else day(d), a, "text") for k, (n, v, d, a) in enumerate(INVOICES)], INVOICE)
    ledger = spark.createDataFrame([(k, day(d), t, r, a) for k, (d, t, r, a) in enumerate(LEDGER, 2)], LEDGER_ROW)
    match.write_results(invoices, ledger, str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 26
    whole = match.assign
    monkeypatch.setattr(match, "assign", lambda i, r: whole(i, r).where("inv_ord != 3"))
    with pytest.raises(match.CoverageError, match="20 invoices went in, 19 came back out"):
        match.write_results(invoices, ledger, str(tmp_path / "bad"))
    monkeypatch.setattr(match, "assign", whole)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["good"]
    none = spark.createDataFrame([], INVOICE)
    match.write_results(none, ledger, str(tmp_path / "rows"))
    match.write_results(none, spark.createDataFrame([], LEDGER_ROW), str(tmp_path / "nothing"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == len(LEDGER) and spark.read.parquet(str(tmp_path / "nothing")).count() == 0


def test_empty(spark):
    out = match.reconcile(spark.createDataFrame([], INVOICE), spark.createDataFrame([], LEDGER_ROW))
    assert out.count() == 0 and report.summary(out).first().match_rate is None


@pytest.mark.parametrize(
    "headers, name",
    [
        (["Date", "Description", "Reference", "Amount"], "Generic"),
        (["Date", "Source", "Reference", "Description", "Debit", "Credit"], "Xero"),
        (["Date", "Description", "Amount", "Account"], "Wave"),
        (["Date", "Vendor", "Category", "Amount"], "FreshBooks"),
        (["Date", "Transaction Type", "Num", "Name", "Memo/Description", "Account", "Amount"], "QuickBooks"),
        (["date", "description", "reference", "amount", "debit"], "Xero"),
        (["Foo", "Bar"], None),
    ],
)
def test_layouts(headers, name):
    found = detect(headers)
    assert (found[0].name if found else None) == name


def test_csv_guard(spark):
    safe = report.csv_safe(spark.createDataFrame([Row(a="=1+1", b=2), Row(a="plain", b=3)]))
    assert [r.a for r in safe.collect()] == ["'=1+1", "plain"]


def test_unknown_layout(spark):
    from tallyforge.model import CELL
    from tallyforge.operators.ledger import ledger_rows

    grid = spark.createDataFrame([(1, [("string", "Foo", None, None)])], f"row_index long, cells array<{CELL.simpleString()}>")
    with pytest.raises(UnknownLayout, match="Foo"):
        ledger_rows(grid)
