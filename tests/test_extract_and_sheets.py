import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.functions.similarity import ratio
from tallyforge.operators.extract import extract_invoices
from tallyforge.operators.ledger import ledger_rows
from tallyforge.sources import documents, sheets

PAGES = {
    "plain": ("Harbour Goods Ltd.\nInvoice No: HG-2041\nInvoice date: 14 March 2025\nSubtotal 1,000.00\nTotal due: $1,234.56", ("HG-2041", "Harbour Goods Ltd.", "2025-03-14", 1234.56)),
    "european": ("Vendor: Adler Werke GmbH\nInvoice number AW/77-3\nDate: 03/04/2025\nGrand total 2.345,67 EUR", ("AW/77-3", "Adler Werke GmbH", "2025-04-03", 2345.67)),
    "american": ("From: Maple Supply Co\nInvoice # 99812\nInvoice date 03/04/25\nSales tax 1.00\nAmount due $-50.00", ("99812", "Maple Supply Co", "2025-03-04", -50.0)),
    "blank": ("   ", (None, None, None, None)),
    "null": (None, (None, None, None, None)),
}


def test_pages(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in PAGES.items()], "source_file string, text string")
    got = {r.source_file: (r.invoice_number, r.vendor, str(r.invoice_date) if r.invoice_date else None, r.amount) for r in extract_invoices(docs).collect()}
    assert got == {k: v for k, (_, v) in PAGES.items()}


def test_fields_of_documents(spark, tmp_path):
    """Heads in front of prose of any kind are read whole, and missing ones aren't made up."""
    duckdb = pytest.importorskip("duckdb")
    from tallyforge.plans import catalog

    rows = [(k, t) for k, t in enumerate([None, "", "plain prose. " * 3000, "two\nlines", "émigré 漢字"] * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("document_field_values", "document_fields"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        cur = con.execute(catalog.ORACLES[name])
        names = [x[0] for x in cur.description]
        at = [names.index(c) for c in got.columns]
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (tuple(r[k] for k in at) for r in cur.fetchall()))), name


def test_amounts_and_dates(spark):
    amounts = {"1,234.56": 1234.56, "1.234,56": 1234.56, "1234.56": 1234.56, "1,234": 1234.0, "12,3": None, "-5.00": -5.0, "−5.00": -5.0, "": None, "77": 77.0, "1\n234.56": None}
    rows = spark.createDataFrame([(k,) for k in amounts], "s string").select("s", X.parse_amount(F.col("s")).alias("v")).collect()
    assert {r.s: r.v for r in rows} == amounts
    dates = {"2025-02-30": None, "2025/01/02": "2025-01-02", "13/01/2025": "2025-01-13", "01/13/2025": "2025-01-13", "1.2.25": "2025-02-01", "3 Sept 2025.": "2025-09-03", "Mar 4, 2025": "2025-03-04", "4 Smarch 2025": None}
    rows = spark.createDataFrame([(k,) for k in dates], "s string").select("s", X.parse_date(F.col("s"), F.lit(False)).alias("v")).collect()
    assert {r.s: str(r.v) if r.v else None for r in rows} == dates


def test_ratio_order_matters(spark):
    row = spark.createDataFrame([("tide", "diet")], "a string, b string").select(ratio("a", "b").alias("x"), ratio("b", "a").alias("y")).first()
    assert (row.x, row.y) == (0.25, 0.5)


PAIRS = [
    ("acme co", "payment to acme co", 0.56), ("Bluefern Supplies Ltd", "Payment to Bluefern Supplies Ltd", 0.7924528301886793),
    ("nordway logistics", "wire transfer - amberlake facilities", 0.33962264150943394), ("wire transfer - amberlake facilities", "nordway logistics", 0.22641509433962265),
    ("", "", 1.0), ("abc", "", 0.0), ("abcdef", "abcdef", 1.0), ("kitten", "sitting", 0.6153846153846154), ("a", "b", 0.0), ("aaaa", "aa", 0.6666666666666666),
    ("cedar & finch consulting", "consulting retainer - march", 0.39215686274509803), ("meridian print services", "payment to meridian print services", 0.8070175438596491),
    ("acme corporation limited", "payment to acme corporation limited " + "x" * 180, 0.2),
]


def test_ratio_of_known_pairs():
    from tallyforge.functions.similarity import ratios

    assert ratios([a for a, _, _ in PAIRS], [b for _, b, _ in PAIRS]).tolist() == pytest.approx([r for _, _, r in PAIRS], abs=1e-12)


def test_ratio_against_the_standard_library():
    import random
    from difflib import SequenceMatcher

    from tallyforge.functions.similarity import ratios

    rng = random.Random(1)
    word = lambda letters, most: "".join(rng.choices(letters, k=rng.randint(0, most)))
    pairs = [(word("ab" + "cdefgh" * rng.randint(0, 2), 30), word("abcdé🙂", 40)) for _ in range(1500)]
    pairs += [(word("abcdefghijklm ", 60), word("aaaabcdefgh ", 150) + "ab" * 80) for _ in range(30)]
    assert ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_workbook_round_trip(spark, tmp_path):
    rows = [(["Date", "Description", "Reference", "Amount"], 1), (["not a date", "=SUM(A1)", "R-1", 12.5], 2), ([], 0), ([None, 0, 1001, 7], 3)]
    sheets.write_workbook(str(tmp_path / "a.xlsx"), {"Ledger": rows})
    got = ledger_rows(sheets.read_workbooks(spark, str(tmp_path / "a.xlsx"))).orderBy("row_index").collect()
    assert [tuple(r) for r in got] == [(2, None, "=SUM(A1)", "R-1", 12.5), (4, None, "", "1001", 7.0)]


def test_white_space_in_cells(spark, tmp_path):
    rows = [(["\u00a0Date", "Description\t", "Reference", "Amount"], 1), ([None, "\tpaid\n", "INV-1\u00a0", 5], 0), ([None, "\u2003", "\u3000INV-2", 6], 0)]
    sheets.write_workbook(str(tmp_path / "w.xlsx"), {"Ledger": rows})
    got = ledger_rows(sheets.read_workbooks(spark, str(tmp_path / "w.xlsx"))).orderBy("row_index").collect()
    assert [(r.description, r.reference) for r in got] == [("paid", "INV-1"), ("", "INV-2")]


def _csv_rows(texts):
    """The plain way: each file read from its begin to its end."""
    import csv
    import io

    out = set()
    for name, text in texts.items():
        for k, line in enumerate(csv.reader(io.StringIO(text, newline="")), 1):
            out.add((name, k, tuple(v.replace("\r\n", "\n").replace("\r", "\n") or None for v in line)))
    return out


def test_csv_in_splits(spark, tmp_path):
    """Records, numbers and quoted breaks don't depend on where a file is split."""
    import random

    rng = random.Random(5)
    field = lambda: rng.choice(["", "x", 'a "b" c', '"q,""r"""', '"one\ntwo"', '"\n\n"', '"a\r\nb"', '"z"tail', 'é 漢', '"long ' + "w" * 90 + '\n"'])
    texts = {f"f{k}.csv": "".join(",".join(field() for _ in range(rng.randint(1, 4))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(300)) for k in range(3)}
    wide = '"' + '""' * 60000 + '\n",' + 'x,' * 30000 + '"y"\nlast\n'
    texts |= {"wide.csv": wide, "none.csv": "", "open.csv": 'a,b\n"never\nends\n' + "x,y\n" * 200, "end.csv": "a,b\nc", "quotes.csv": '""\n"""\n"""\n""""\n' * 80}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    expected = _csv_rows(texts | {"open.csv": texts["open.csv"].rstrip("\n")})
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700b", "100m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10b")
            rows = sheets.read_csv(spark, str(tmp_path)).collect()
            got = {(r.sheet.rsplit("/", 1)[-1], r.row_index, tuple(c and c.str for c in r.cells)) for r in rows}
            assert len(got) == len(rows)
            assert got == expected
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Date,Description,Debit,Credit\n2025-01-02,"two\nlines",0,5.5\n,,,\n2025-01-03,x,8,\n')
    got = ledger_rows(sheets.read_csv(spark, str(tmp_path / "l.csv"))).orderBy("row_index").collect()
    assert [(r.row_index, r.ledger_date, r.amount) for r in got] == [(2, datetime.date(2025, 1, 2), 5.5), (4, datetime.date(2025, 1, 3), 8.0)]


def test_invoice_folder(spark, tmp_path):
    for name, data in (("b.pdf", b"scan"), ("a.PDF", b"text"), ("c.pdf", b"broken"), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(data)

    def layer(data):
        if data == b"broken":
            raise ValueError
        return "words" if data == b"text" else ""

    got = documents.read_invoices(spark, str(tmp_path), layer, lambda d: "seen" if d == b"scan" else None).orderBy("inv_ord").collect()
    assert [(r.source_file, r.text, r.method) for r in got] == [("a.PDF", "words", "text"), ("b.pdf", "seen", "ocr"), ("c.pdf", None, "none")]
    files = spark.createDataFrame([("a.pdf",), ("b.txt",)], "name string")
    with pytest.raises(documents.InputError):
        documents.check_inputs(files)


def test_page_text(spark):
    rows = [("p", 10.0, 20.0, 700.0, "Total"), ("p", 25.0, 40.0, 699.0, "due"), ("p", 40.5, 50.0, 700.0, "5"), ("p", 10.0, 20.0, 720.0, "Head")]
    got = documents.page_text(spark.createDataFrame(rows, "source_file string, x double, end double, y double, str string")).first()
    assert got.text == "Head\nTotal due5"


def test_queries_match_sql(spark):
    """The engine's queries against their SQL on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from tallyforge.plans import catalog

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("reference_matches", "near_pairs", "combined_payments", "extracted_fields", "ledger_from_grid"):
        df = catalog.QUERIES[name](spark, d)
        cur = con.execute(catalog.ORACLES[name])
        names = [x[0] for x in cur.description]
        at = [names.index(c) for c in df.columns]
        assert sorted(map(str, ([*r] for r in df.collect()))) == sorted(map(str, ([r[k] for k in at] for r in cur.fetchall()))), name


def test_staged_readers_stop_early(spark, tmp_path):
    """Each reader is asked only for files of which no reading so far had all four fields."""
    whole, part = PAGES["plain"][0], "Invoice No: HG-2041"
    for name, data in (("a.pdf", "layer"), ("b.pdf", "first"), ("c.pdf", "second"), ("d.pdf", "never"), ("e.pdf", "equal"), ("f.pdf", "broken")):
        (tmp_path / name).write_bytes(data.encode())
    asked = [spark.sparkContext.accumulator(0) for _ in range(3)]

    def reader(k, of):
        def read(data):
            asked[k].add(1)
            if data == b"broken" and k == 0:
                raise ValueError
            return of.get(data.decode())

        return read

    readers = [reader(0, {"first": whole, "second": part, "equal": part + "\n1"}), reader(1, {"second": whole, "equal": part + "\n2"}), reader(2, {"broken": part})]
    got = documents.read_invoices(spark, str(tmp_path), lambda d: "words" if d == b"layer" else None, readers).orderBy("inv_ord").collect()
    assert [(r.source_file, r.text, r.method) for r in got] == [
        ("a.pdf", "words", "text"), ("b.pdf", whole, "ocr"), ("c.pdf", whole, "ocr"), ("d.pdf", None, "none"), ("e.pdf", part + "\n1", "ocr"), ("f.pdf", part, "ocr"),
    ]
    assert [a.value for a in asked] == [5, 4, 3]


def test_damaged_workbooks_stay_apart(spark, tmp_path):
    sheets.write_workbook(str(tmp_path / "good.xlsx"), {"Ledger": [(["Date", "Description", "Amount"], 1), ([None, "x", 5], 0)]})
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    grid = sheets.read_workbooks(spark, str(tmp_path)).cache()
    assert [(r.description, r.amount) for r in ledger_rows(grid).collect()] == [("x", 5.0)]
    errors = sheets.unread(grid).collect()
    assert len(errors) == 1 and errors[0].sheet.endswith("bad.xlsx") and "BadZipFile" in errors[0].error
    old = spark.createDataFrame([("a.pdf",), ("Ledger.XLS",)], "name string")
    with pytest.raises(documents.InputError, match="Ledger.XLS"):
        documents.check_inputs(old)


def test_report_through_the_sink(spark, tmp_path):
    import zipfile

    from tallyforge.model import INVOICE, LEDGER_ROW
    from tallyforge.operators import match, report

    day = datetime.date(2025, 1, 1)
    invoices = [(k, f"{k:04}.pdf", f"N-{k}", "A & <B>", day, float(k), "text") for k in range(300)]
    ledger = [(k + 2, day, "=1+1", f"N-{k}", float(k) + (5 if k % 7 == 0 else 0)) for k in range(0, 300, 2)]
    results = match.reconcile(spark.createDataFrame(invoices, INVOICE), spark.createDataFrame(ledger, LEDGER_ROW)).cache()
    path = str(tmp_path / "report.xlsx")
    sheets.write_report(path, results)
    assert [p.name for p in tmp_path.iterdir()] == ["report.xlsx"]
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None
    rows = [[c and c[1] if c and c[0] == "string" else c and c[2] for c in cells] for _, cells in sheets.workbook_rows((tmp_path / "report.xlsx").read_bytes(), "Detail")]
    want = report.detail(results).orderBy("result_ord").select("status", "invoice_number", "vendor", "invoice_date", "invoice_amount", "ledger_row", "ledger_date", "ledger_description", "ledger_amount", "source_file", "read_via").collect()
    assert rows[0] == list(report.DETAIL_COLUMNS) and len(rows) == len(want) + 1
    for mine, other in zip(rows[1:], want, strict=True):
        assert mine + [None] * (11 - len(mine)) == list(other)
    summary = {cells[0][1]: cells[1] for _, cells in sheets.workbook_rows((tmp_path / "report.xlsx").read_bytes(), "Summary") if len(cells) == 2}
    assert summary["Total items"][2] == 300 and "Generated" in summary and summary["Note"][1] == report.NOTE


def test_failed_report_leaves_nothing(spark, tmp_path):
    from tallyforge.sources.sink import WorkbookSink

    spark.dataSource.register(WorkbookSink)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 50, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("a"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("tally_workbook").mode("overwrite").save(str(tmp_path / "r.xlsx"))
    assert list(tmp_path.iterdir()) == []
