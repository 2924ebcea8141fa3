"""Queries over pages, layouts, labels and amounts in all their forms, and the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..functions import text as X
from ..functions.similarity import vendor_contained
from ..operators import extract, match, report, statement, subset
from ..operators import ledger as sheets
from ..operators.lineage import cut, shared_folder, spread
from ..operators.lines import line_totals
from ..sources import documents
from ..sources import sheets as sheets_source
from .fixtures import OWNERS, PAGE_VENDOR, PLANTED, RESULTS, VIEWS, doc_text, invoices, ledger, owned_rows, page_invoices, planted

#: Share of tax in the query over line items.
TAX_RATE = 0.19


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.reconcile(invoices(spark, sf_dir), ledger(spark, sf_dir))


def report_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's rows with the flags' labels and how each file was read."""
    return report.detail(_results(spark, sf_dir)).select("source_file", "ledger_row", "label", "read_via")


def report_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_lines(_results(spark, sf_dir))


def console_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.one_line(_results(spark, sf_dir))


def statement_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement.open_ages(statement.statement_totals(statement.statement_lines(_results(spark, sf_dir))))


def amount_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invoice's amount, sign changing with the key, shown and in three styles, each of which is read again."""
    amount = F.when(F.col("inv_ord") % 2 == 0, F.col("amount")).otherwise(-F.col("amount"))
    inv = invoices(spark, sf_dir).select("inv_ord", amount.alias("amount"), F.explode(F.array(*map(F.lit, ("us", "eu", "plain")))).alias("style"))
    shown = inv.withColumns({"shown": report.money(F.col("amount")), "text": X.format_amount(F.col("amount"), F.col("style"))})
    return shown.select("inv_ord", "style", "shown", "text", F.round(X.parse_amount(F.col("text")) * 100).cast("long").alias("cents"))


def invoice_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices written from the line items of the orders."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("invoice"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("unit_price"))
    cents = lambda c: (F.col(c) * 100).cast("long").alias(f"{c}_cents")
    return line_totals(items, TAX_RATE).select("invoice", "n_lines", cents("subtotal"), cents("tax"), cents("total"))


def _fields(pages: DataFrame) -> DataFrame:
    out = extract.extract_invoices(pages)
    return out.select("inv_ord", "vendor", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"))


def hinted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in figures, month first on pages that have a mark of the United States and day first on others."""
    k = F.col("inv_ord")
    hint = F.when(k % 5 == 0, "Paid in USD").when(k % 5 == 1, "Net 30").when(k % 5 == 2, "Sales tax 1.00").when(k % 5 == 3, "Reno, NV 89501").otherwise("Net thirty")
    day = F.when(k % 5 == 4, F.date_format("invoice_date", "dd/MM/yyyy")).otherwise(F.date_format("invoice_date", "MM/dd/yyyy"))
    pages = invoices(spark, sf_dir).select("inv_ord", "source_file", F.concat_ws("\n", F.lit("page one"), F.concat(F.lit("Date: "), day), hint).alias("text"))
    return _fields(pages).select("inv_ord", "invoice_date")


def unlabelled_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors found by their place among the first lines, behind boilerplate and an address, cleaned of what surrounds them."""
    k = F.col("inv_ord")
    shown = F.when(k % 4 == 0, F.concat("vendor", F.lit(" - Tax Invoice"))).when(k % 4 == 1, F.concat(F.lit("| "), "vendor")).when(k % 4 == 2, F.concat("vendor", F.lit("  Invoice no 7"))).otherwise(F.col("vendor"))
    lines = F.concat_ws("\n", F.lit("INVOICE"), F.lit("12 4400 88 9"), F.lit(""), shown, F.lit("name"), F.lit("paid by card, with thanks."))
    return _fields(page_invoices(spark, sf_dir).select("inv_ord", "source_file", lines.alias("text"))).select("inv_ord", "vendor")


def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three attempts at each page, each of which misses other fields, the one of most fields."""
    attempts = invoices(spark, sf_dir).select("*", F.explode(F.array(*[F.lit(a) for a in (1, 2, 3)])).alias("attempt"))
    missed = lambda c, m: F.when((F.col("inv_ord") * F.col("attempt")) % m != 0, F.col(c)).alias(c)
    readings = attempts.select("source_file", "attempt", missed("invoice_number", 3), missed("vendor", 4), missed("invoice_date", 5), missed("amount", 2), F.concat(F.lit("ocr"), "attempt").alias("extraction_method"))
    out = extract.best_reading(readings)
    return out.select("source_file", "invoice_number", "vendor", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"), "amount", "extraction_method")


def staged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts at each page one after another, each of which misses other fields, and none after one that has all four."""
    pages = spread(page_invoices(spark, sf_dir), "inv_ord")

    def attempt(n: int):
        def read(open_: DataFrame) -> DataFrame:
            line = lambda label, m, c: F.concat(F.lit(label), F.when((F.col("inv_ord") * n) % m != 0, c))
            lines = [line("From: ", 4, F.col("vendor")), line("Invoice No: ", 3, F.col("invoice_number"))]
            lines += [line("Invoice date: ", 5, F.date_format("invoice_date", "yyyy-MM-dd")), line("Total due: ", 2, X.format_amount(F.col("amount"), F.lit("plain")))]
            return open_.select("source_file", F.concat_ws("\n", F.lit(f"page {n}"), *lines).alias("text"))

        return read

    return extract.staged_readings(pages, [attempt(n) for n in (1, 2, 3)]).select("source_file", "attempt", "fields")


def flag_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of flag with its label, its meaning and how often it was raised."""
    counts = report.flag_counts(_results(spark, sf_dir))
    return counts.select("flag", report.flag_label(F.col("flag")).alias("label"), report.flag_meaning(F.col("flag")).alias("meaning"), "n")


def impossible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days up to 31 in every month: a date that no calendar has isn't read."""
    k = F.col("inv_ord")
    day, month, year = F.lpad((k % 31 + 1).cast("string"), 2, "0"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.date_format("invoice_date", "yyyy")
    written = F.when(k % 2 == 0, F.concat_ws("-", year, month, day)).otherwise(F.concat_ws("/", day, month, year))
    lines = F.concat_ws("\n", F.lit("page one"), F.concat(F.lit("Invoice date: "), F.when(year.isNotNull(), written)))
    return _fields(invoices(spark, sf_dir).select("inv_ord", "source_file", lines.alias("text"))).select("inv_ord", "invoice_date")


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("inv_ord", F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("inv_ord") % len(_ENDS) + 1).cast("int")))
    return invoices(spark, sf_dir).groupBy(documents.file_kind(name).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_ENDS = (".pdf", ".PDF", ".Csv", ".xlsx", ".pdf.txt", "pdf", ".xls", ".XLSM")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of positioned words, drawn in no order, put together again. Every other word of a line hangs two points lower."""
    inv = page_invoices(spark, sf_dir)
    lines = F.array(F.coalesce("vendor", F.lit("Unknown")), F.concat_ws(" ", F.lit("Invoice No:"), "invoice_number"), F.concat_ws(" ", F.lit("Read by"), "extraction_method", F.lit("layer")))
    words = inv.select("source_file", F.posexplode(lines).alias("row", "line")).select("source_file", "row", F.posexplode(F.split("line", " ")).alias("k", "str"))
    drawn = (F.col("k") * 7 + F.col("row") * 3).cast("int") % 5
    height = 700.0 - F.col("row") * 12 - F.when(F.col("k") % 2 == 1, 2.0).otherwise(0.0)
    fragments = words.select("source_file", F.struct(F.col("k") % 2, drawn, "row", "k").alias("ord"), (F.col("k") * 50.0).alias("x"), (F.col("k") * 50.0 + 40).alias("end"), height.alias("y"), "str")
    return documents.page_text(fragments)


#: A sheet of each known layout: its header, and for each column the ledger's field.
_SHEETS = {
    "Xero": (("Date", "Source", "Description", "Reference", "Debit", "Credit"), ("ledger_date", None, "description", "reference", None, "amount")),
    "Wave": (("Date", "Description", "Amount", "Account"), ("ledger_date", "description", "amount", None)),
    "FreshBooks": (("Date", "Category", "Vendor", "Amount"), ("ledger_date", None, "description", "amount")),
    "QuickBooks": (("Date", "Num", "Name", "Memo/Description", "Amount"), ("ledger_date", "reference", None, "description", "amount")),
    "Generic": (("DATE", "Description ", "Reference", "Amount"), ("ledger_date", "description", "reference", "amount")),
}


def ledger_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, read from a sheet of each known layout."""
    from ..model import CELL
    from ..operators.lineage import cut

    kinds = {"ledger_date": ("date", "dt"), "description": ("string", "str"), "reference": ("string", "str"), "amount": ("float", "num")}

    def cell(field: str | None) -> Column:
        if field is None:
            return F.lit(None).cast(CELL)
        kind, slot = kinds[field]
        values = {"str": F.lit(None).cast("string"), "num": F.lit(None).cast("double"), "dt": F.lit(None).cast("date")} | {slot: F.col(field)}
        return F.when(F.col(field).isNotNull(), F.struct(F.lit(kind).alias("kind"), *[v.alias(k) for k, v in values.items()]))

    rows = cut(ledger(spark, sf_dir))
    out = []
    for name, (header, fields) in _SHEETS.items():
        body = rows.select(F.col("row_index").cast("long").alias("row_index"), F.array(*[cell(f) for f in fields]).cast(f"array<{CELL.simpleString()}>").alias("cells"))
        head = spark.createDataFrame([(1, [("string", h, None, None) for h in header])], body.schema)
        read = sheets.ledger_rows(head.unionByName(body))
        out.append(read.select(F.lit(name).alias("layout"), "row_index", F.date_format("ledger_date", "yyyy-MM-dd").alias("ledger_date"), "description", "reference", "amount"))
    return reduce(DataFrame.unionByName, out)


#: Rows of each CSV file of the query over them.
FILE_ROWS = 5000


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written as CSV files, with quotes, commas and line breaks in fields, and read again by splits."""
    rows = ledger(spark, sf_dir).withColumn("file", F.floor(F.col("row_index") / FILE_ROWS))
    break_ = F.when(F.col("row_index") % 7 == 0, "\n").when(F.col("row_index") % 11 == 0, '"",').otherwise(" ")
    note = F.concat(F.lit('"'), "description", break_, F.lit('by transfer"'))
    line = F.concat_ws(",", "row_index", F.coalesce(F.col("ledger_date").cast("string"), F.lit("")), note, F.coalesce("reference", F.lit("")), F.coalesce(F.col("amount").cast("decimal(15,2)").cast("string"), F.lit("")))
    folder = shared_folder(spark, "csv")
    written = rows.repartition("file").sortWithinPartitions("file", "row_index").select("file", line.alias("value"))
    written.write.partitionBy("file").text(folder)
    out = sheets_source.read_csv(spark, f"{folder}/file=*")
    cell = lambda k, slot: F.get("cells", F.lit(k))[slot]
    part = F.regexp_extract("sheet", r"file=(\d+)", 1).cast("long")
    return out.select(cell(0, "num").cast("long").alias("ledger_row"), part.alias("file"), "row_index", F.date_format(cell(1, "dt"), "yyyy-MM-dd").alias("ledger_date"), cell(2, "str").alias("note"), cell(3, "str").alias("reference"), F.round(cell(4, "num") * 100).cast("long").alias("cents"))


def amounts_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invoice's amount as it is and without its last three figures, in words."""
    cents = F.round(F.col("amount") * 100).cast("long")
    inv = invoices(spark, sf_dir).select("inv_ord", F.explode(F.array(cents, F.signum(cents).cast("long") * F.floor(F.abs(cents) / 1000))).alias("cents"))
    return inv.select("inv_ord", "cents", X.amount_words(F.col("cents") / 100, F.when(F.col("inv_ord") % 2 == 0, "EUR").otherwise("USD")).alias("words"))


#: Width, height, distance and thickness of lines, tones of paper and ink of the pages that are drawn.
SCAN = {"width": 260, "height": 300, "step": 10, "line": 4, "paper": 235, "ink": 40}


#: Pages that are drawn before they are handed on.
DRAWN = 64


def _draw(batches):
    """Pages of bars, one for each word, turned by their angle, with specks."""
    from bisect import bisect_left

    import numpy as np
    import pyarrow as pa

    w, h, step, margin = SCAN["width"], SCAN["height"], SCAN["step"], 14
    y, x = np.mgrid[0:h, 0:w]
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    lines = range(2, h // step - 2)
    paper, inked = np.array([SCAN["paper"]], np.uint8), np.array([SCAN["ink"]], np.uint8)
    most = len(lines) * (w // 7)  # a word has a letter at least
    chance = np.empty((h, w))

    def view(angle):
        """The place in its line that each pixel shows; paper beside the lines is the last."""
        a = np.radians(angle)
        # the pixel of the level page that each pixel shows
        up = np.rint(y * np.cos(a) - x * np.sin(a) + (h - 1) / 2).astype(int)
        over = np.rint(x * np.cos(a) + y * np.sin(a) + (w - 1) / 2).astype(int)
        on = (up >= 0) & (up < h) & (over >= 0) & (over < w) & (up % step < SCAN["line"])
        return np.where(on, up // step * w + over, (h // step + 1) * w)

    def drawn(key, text, shown, page):
        lengths = np.array([3 * len(word) for word in text.split()])
        rng = np.random.default_rng(key)
        start = rng.bit_generator.state
        sizes = lengths[rng.integers(len(lengths), size=most)]
        ends = np.cumsum(sizes + 4)
        begins, upto, used, places = ends - sizes - 4, ends.tolist(), 0, []
        for line in lines:
            # words of a line, up to the first that reaches the margin
            first, gone = used, upto[used - 1] if used else 0
            used = bisect_left(upto, gone + w - 2 * margin, first) + 1
            places.append((used - first, line * w + margin - gone, (line + 1) * w - margin))
        shift, last = np.repeat([x[1:] for x in places], [x[0] for x in places], 0).T
        # steps from paper to ink and back, which may wrap around
        steps = np.zeros((h // step + 1) * w + 1, np.uint8)
        steps[0] = paper[0]
        steps[begins[:used] + shift] = inked - paper
        steps[np.minimum(ends[:used] - 4 + shift, last)] = paper - inked
        cells = np.cumsum(steps, dtype=np.uint8)
        # specks follow on the words that were used
        rng.bit_generator.state = start
        rng.integers(len(lengths), size=used)
        np.take(cells, shown, out=page, mode="clip")
        np.multiply(page, rng.random(out=chance) >= 0.004, out=page)

    for batch in batches:
        angles, shown, at = batch["angle"].to_numpy(), None, None
        rows = np.argsort(angles, kind="stable")
        for part in (rows[k : k + DRAWN] for k in range(0, len(rows), DRAWN)):
            some = batch.take(pa.array(part))
            pages = np.empty((len(part), h, w), np.uint8)
            for page, key, angle, text in zip(pages, some["inv_ord"].to_pylist(), some["angle"].to_pylist(), some["text"].to_pylist(), strict=True):
                if angle != at:
                    shown, at = view(angle), angle
                drawn(key, text, shown, page)
            columns = [some["source_file"], pa.array([w] * len(part), pa.int32()), pa.array([h] * len(part), pa.int32()), images.page_bytes(pages)]
            yield pa.RecordBatch.from_arrays(columns, images.SCAN)


def _levelled(batches):
    """Pages as they are drawn and made ready, and the turn that is left over; their pixels stay in the task."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def named(ready):
        for batch in ready:
            yield batch.set_column(0, "source_file", pc.binary_join_element_wise(batch["source_file"], pc.cast(batch["angle"], pa.string()), "|"))

    return images.angle_batches(named(images.ready_batches(_draw(batches))))


def page_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned pages, laid askew, levelled and made black and white: the turn that was found, to half a degree, and what is left over."""
    pages = doc_text(spark, sf_dir).where("method = 'ocr'").select("inv_ord", "source_file", "text", (F.col("inv_ord") % 11 * 0.5 - 2.5).cast("double").alias("angle"))
    half = lambda c: F.round(F.col(c) * 2) / 2 + 0.0
    again = pages.mapInArrow(_levelled, "source_file string, angle double")
    name, found = (F.split("source_file", r"\|")[k] for k in (0, 1))
    return again.select(name.alias("source_file"), found.cast("double").alias("angle"), F.col("angle").alias("left_over")).select("source_file", half("angle").alias("angle"), half("left_over").alias("left_over"))


#: Share of the invoices that a sample shows.
SAMPLE_SHARE = 0.6


def sample_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample: every invoice with a planted fault, others by rank of a hash, and the rows that concern these or nobody."""
    files = planted(spark, sf_dir)
    chosen = cut(subset.choose(files, SAMPLE_SHARE))
    rows = subset.concerned(owned_rows(spark, sf_dir), chosen)
    return chosen.select(F.lit("invoice").alias("kind"), F.col("key").alias("id")).unionByName(rows.select(F.lit("row").alias("kind"), F.col("row_index").alias("id")))


def named_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices whose vendor stands in the description of the row of their number, in other letters."""
    inv = invoices(spark, sf_dir).select("inv_ord", F.upper("vendor").alias("vendor"), F.col("invoice_number").alias("reference"))
    pairs = inv.join(ledger(spark, sf_dir), "reference")
    return pairs.select("inv_ord", "row_index", F.coalesce(vendor_contained(F.col("vendor"), F.col("description")), F.lit(False)).alias("named"))


QUERIES = {
    f.__name__: f
    for f in (
        report_detail, report_summary_lines, console_line, statement_ages, amount_round_trip, invoice_line_totals, hinted_dates, unlabelled_vendors,
        best_readings, file_kinds, page_texts, ledger_layouts, named_vendors, staged_readings, flag_meanings, impossible_dates, csv_records, amounts_in_words, page_angles, sample_subset,
    )
}


def _labelled(status: str) -> str:
    for flag, label in report.FLAG_LABELS.items():
        status = f"replace({status}, '{flag}', '{label}')"
    return status


_GROUPED = "CASE WHEN amount IS NULL THEN NULL ELSE format('{:,.2f}', CASE WHEN inv_ord % 2 = 0 THEN amount ELSE -amount END) END"
_SUM = "CAST(sum(CAST(round(CASE WHEN outstanding > 0 THEN outstanding ELSE 0 END * 100) AS bigint)) AS bigint) / 100"
_COUNTS = "count(*) AS total, count(*) FILTER (status = 'matched') AS clean"
_AGE_LABEL = "CASE bucket " + " ".join(f"WHEN '{b}' THEN '{v}'" for b, v in statement.AGE_LABELS.items()) + " END"
_MEANING = "CASE flag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.FLAG_MEANINGS.items()) + " END"
_KEPT = {"invoice_number": 3, "vendor": 4, "invoice_date": 5, "amount": 2}
_READ = ", ".join(f"CASE WHEN (inv_ord * attempt) % {m} != 0 THEN {c} END AS {c}" for c, m in _KEPT.items())
_FIELDS = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in _KEPT)

def _words(n: str) -> str:
    ones, tens = list(X.ONES), list(X.TENS)
    rest = f"CASE WHEN {n} % 100 >= 20 THEN concat_ws('-', {tens}[{n} % 100 // 10 + 1], CASE WHEN {n} % 10 > 0 THEN {ones}[{n} % 10 + 1] END) WHEN {n} % 100 > 0 THEN {ones}[{n} % 100 + 1] END"
    return f"concat_ws(' ', CASE WHEN {n} >= 100 THEN concat({ones}[{n} // 100 + 1], ' hundred') END, {rest})"


ORACLES = {
    "report_detail": RESULTS + f"SELECT source_file, row_index AS ledger_row, {_labelled('''replace(status, 'matched', 'Matched')''')} AS label, CASE WHEN inv_ord % 9 = 4 THEN 'OCR (verify)' WHEN inv_ord IS NOT NULL THEN 'text layer' END AS read_via FROM results",
    "report_summary_lines": RESULTS
    + f", n AS (SELECT {_COUNTS} FROM results) SELECT 'Total items' AS item, CAST(total AS varchar) AS value FROM n UNION ALL SELECT 'Matched clean', CAST(clean AS varchar) FROM n UNION ALL SELECT 'Flagged', CAST(total - clean AS varchar) FROM n"
    + " UNION ALL SELECT 'Match rate', concat(CAST(CAST(floor(clean / total * 100 + 0.5) AS bigint) AS varchar), '%') FROM n"
    + f" UNION ALL SELECT {_labelled('flag')}, CAST(count(*) AS varchar) FROM (SELECT unnest(string_split(status, ', ')) AS flag FROM results) WHERE flag != 'matched' GROUP BY flag UNION ALL SELECT 'Note', '{report.NOTE}'",
    "console_line": RESULTS + f", n AS (SELECT {_COUNTS} FROM results) SELECT concat((SELECT count(*) FROM inv), ' invoices, ', (SELECT count(*) FROM led), ' ledger rows -> ', clean, '/', total, ' matched clean, ', total - clean, ' flagged') AS line FROM n",
    "statement_ages": RESULTS + f"SELECT vendor, grand, bucket, {_AGE_LABEL} AS label, amount FROM (SELECT vendor, grouping(vendor) = 1 AS grand, bucket, {_SUM} AS amount FROM aged GROUP BY GROUPING SETS ((vendor, bucket), (bucket))) WHERE amount != 0",
    "amount_round_trip": f"WITH {VIEWS}, styled AS (SELECT inv_ord, amount, {_GROUPED} AS us, unnest(['us', 'eu', 'plain']) AS style FROM inv) SELECT inv_ord, style, coalesce(us, '—') AS shown, CASE style WHEN 'us' THEN us WHEN 'eu' THEN translate(us, ',.', '.,') ELSE replace(us, ',', '') END AS text, "
    "CAST(round(CASE WHEN inv_ord % 2 = 0 THEN amount ELSE -amount END * 100) AS bigint) AS cents FROM styled",
    "invoice_line_totals": f"WITH s AS (SELECT l_orderkey AS invoice, count(*) AS n_lines, CAST(sum(round(CAST(l_quantity AS decimal(15,4)) * CAST(l_extendedprice AS decimal(15,4)), 2)) * 100 AS bigint) AS c FROM lineitem GROUP BY l_orderkey), "
    f"t AS (SELECT *, CAST(round(CAST(c AS decimal(18,0)) * CAST({TAX_RATE} AS decimal(9,6))) AS bigint) AS tax FROM s) SELECT invoice, n_lines, c AS subtotal_cents, tax AS tax_cents, c + tax AS total_cents FROM t",
    "hinted_dates": f"WITH {VIEWS} SELECT inv_ord, strftime(invoice_date, '%Y-%m-%d') AS invoice_date FROM inv",
    "unlabelled_vendors": f"WITH {VIEWS} SELECT inv_ord, {PAGE_VENDOR} AS vendor FROM inv",
    "best_readings": f"WITH {VIEWS}, tries AS (SELECT source_file, attempt, concat('ocr', attempt) AS extraction_method, {_READ} FROM (SELECT *, unnest([1, 2, 3]) AS attempt FROM inv)) "
    f"SELECT source_file, invoice_number, vendor, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, amount, extraction_method FROM tries QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY {_FIELDS} DESC, attempt) = 1",
    "staged_readings": f"WITH {VIEWS}, pages AS (SELECT * REPLACE ({PAGE_VENDOR} AS vendor) FROM inv), tries AS (SELECT source_file, attempt, {_FIELDS} AS fields FROM (SELECT source_file, attempt, {_READ} FROM (SELECT *, unnest([1, 2, 3]) AS attempt FROM pages))), "
    "made AS (SELECT *, coalesce(max(fields) OVER (PARTITION BY source_file ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tries) "
    "SELECT source_file, attempt, fields FROM made WHERE before < 4 QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY fields DESC, attempt) = 1",
    "flag_meanings": RESULTS + f"SELECT flag, {_labelled('flag')} AS label, {_MEANING} AS meaning, count(*) AS n FROM (SELECT unnest(string_split(status, ', ')) AS flag FROM results) WHERE flag != 'matched' GROUP BY flag",
    "impossible_dates": f"WITH {VIEWS} SELECT inv_ord, strftime(try_cast(concat(strftime(invoice_date, '%Y'), '-', lpad(CAST(inv_ord % 12 + 1 AS varchar), 2, '0'), '-', lpad(CAST(inv_ord % 31 + 1 AS varchar), 2, '0')) AS date), '%Y-%m-%d') AS invoice_date FROM inv",
    "file_kinds": f"WITH {VIEWS}, f AS (SELECT lower(concat(inv_ord, {list(_ENDS)}[inv_ord % {len(_ENDS)} + 1])) AS name FROM inv) "
    "SELECT CASE WHEN suffix(name, '.pdf') THEN 'pdf' WHEN suffix(name, '.xlsx') OR suffix(name, '.xlsm') OR suffix(name, '.xls') OR suffix(name, '.csv') THEN 'spreadsheet' ELSE 'ignored' END AS kind, count(*) AS n FROM f GROUP BY 1",
    "page_texts": f"WITH {VIEWS} SELECT source_file, concat(coalesce({PAGE_VENDOR}, 'Unknown'), chr(10), concat_ws(' ', 'Invoice No:', invoice_number), chr(10), 'Read by ', extraction_method, ' layer') AS text FROM inv",
    "ledger_layouts": f"WITH {VIEWS} SELECT layout, row_index, strftime(ledger_date, '%Y-%m-%d') AS ledger_date, description, CASE WHEN layout IN ('Wave', 'FreshBooks') THEN NULL ELSE reference END AS reference, amount FROM led, (SELECT unnest({list(_SHEETS)}) AS layout)",
    "csv_records": f"WITH {VIEWS} SELECT CAST(row_index AS bigint) AS ledger_row, CAST(row_index // {FILE_ROWS} AS bigint) AS file, CAST(row_number() OVER (PARTITION BY row_index // {FILE_ROWS} ORDER BY row_index) AS bigint) AS row_index, strftime(ledger_date, '%Y-%m-%d') AS ledger_date, "
    "concat(description, CASE WHEN row_index % 7 = 0 THEN chr(10) WHEN row_index % 11 = 0 THEN '\",' ELSE ' ' END, 'by transfer') AS note, reference, CAST(round(amount * 100) AS bigint) AS cents FROM led",
    "amounts_in_words": f"WITH {VIEWS}, c AS (SELECT inv_ord, unnest([round(amount * 100)::bigint, sign(amount)::bigint * (round(abs(amount) * 100)::bigint // 1000)]) AS cents FROM inv), "
    "w AS (SELECT *, abs(cents) // 100000 AS t, abs(cents) // 100 % 1000 AS u FROM c), "
    f"s AS (SELECT *, concat_ws(' ', CASE WHEN cents < 0 THEN 'minus' END, CASE WHEN t > 0 THEN concat({_words('t')}, ' thousand') END, CASE WHEN u > 0 THEN {_words('u')} END, CASE WHEN t + u = 0 THEN 'zero' END, CASE inv_ord % 2 WHEN 0 THEN 'eur' ELSE 'usd' END, 'and', concat(lpad(CAST(abs(cents) % 100 AS varchar), 2, '0'), '/100')) AS words FROM w) "
    "SELECT inv_ord, cents, CASE WHEN cents IS NOT NULL THEN concat(upper(words[1]), words[2:]) END AS words FROM s",
    "page_angles": f"WITH {VIEWS} SELECT source_file, CAST(inv_ord % 11 * 0.5 - 2.5 AS double) AS angle, CAST(0 AS double) AS left_over FROM inv WHERE extraction_method = 'ocr'",
    "sample_subset": f"WITH {VIEWS}, files AS ({PLANTED}), n AS (SELECT CAST(floor(count(*) * {SAMPLE_SHARE}) AS bigint) - count(*) FILTER (planted) AS fill FROM files), "
    "others AS (SELECT key, row_number() OVER (ORDER BY md5(CAST(key AS varchar)), key) AS place FROM files WHERE NOT planted), "
    "chosen AS (SELECT key FROM files WHERE planted UNION ALL SELECT key FROM others, n WHERE place <= fill), "
    f"owned AS (SELECT row_number() OVER (ORDER BY ord) + 1 AS row_index, {OWNERS.replace('array(', 'list_value(').replace('list_value()', '[]::bigint[]')} AS owners FROM raw) "
    "SELECT 'invoice' AS kind, key AS id FROM chosen UNION ALL SELECT 'row', row_index FROM owned WHERE len(owners) = 0 OR row_index IN (SELECT row_index FROM (SELECT row_index, unnest(owners) AS key FROM owned) WHERE key IN (SELECT key FROM chosen))",
    "named_vendors": f"WITH {VIEWS} SELECT inv_ord, row_index, coalesce(contains(lower(description), lower(vendor)), false) AS named FROM inv JOIN led ON invoice_number = reference",
}
