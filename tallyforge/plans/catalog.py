"""The queries of the reconciliation engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import ratio, vendor_names
from ..operators import extract, match, report, statement
from ..operators import ledger as sheets
from ..operators.lineage import spread
from . import forms
from .fixtures import PAGE_VENDOR, RESULTS, VIEWS, doc_text, invoices, ledger, ledger_grid, page_invoices


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.reconcile(invoices(spark, sf_dir), ledger(spark, sf_dir))


def reconcile_detail(spark, sf_dir):
    out = report.detail(_results(spark, sf_dir))
    return out.select("status", "invoice_number", "vendor", "invoice_date", "invoice_amount", "ledger_row", "ledger_date", "ledger_description", "ledger_amount", "source_file")


def reconcile_extra_rows(spark, sf_dir):
    results = _results(spark, sf_dir)
    return results.where(F.size("extra_rows") > 0).select(F.col("invoice.inv_ord").alias("inv_ord"), F.col("ledger_row.row_index").alias("row_index"), F.explode("extra_rows.row_index").alias("extra_row"))


def reconcile_summary(spark, sf_dir):
    return report.summary(_results(spark, sf_dir))


def flag_histogram(spark, sf_dir):
    return report.flag_counts(_results(spark, sf_dir))


def flagged_mismatches(spark, sf_dir):
    found = report.with_flag(_results(spark, sf_dir), "amount_mismatch")
    return found.select(F.col("invoice.inv_ord").alias("inv_ord"), F.round(report.amount_difference() * 100).cast("long").alias("cents"))


def unmatched_ledger(spark, sf_dir):
    return _results(spark, sf_dir).where("invoice is null").select("ledger_row.row_index", "ledger_row.description")


def coverage_counts(spark, sf_dir):
    inv, led = invoices(spark, sf_dir), ledger(spark, sf_dir)
    return match.coverage(inv, led, match.reconcile(inv, led))


def vendor_statements(spark, sf_dir):
    return statement.statements(statement.statement_lines(_results(spark, sf_dir))).drop("first_ord")


def statement_totals(spark, sf_dir):
    return statement.statement_totals(statement.statement_lines(_results(spark, sf_dir)))


def statement_lines(spark, sf_dir):
    lines = statement.statement_lines(_results(spark, sf_dir))
    return lines.select("inv_ord", "vendor", F.round(F.col("outstanding") * 100).cast("long").alias("cents"), "age_days", "bucket")


def duplicate_numbers(spark, sf_dir):
    return match.duplicate_numbers(invoices(spark, sf_dir))


def reference_matches(spark, sf_dir):
    found = match.by_reference(invoices(spark, sf_dir), ledger(spark, sf_dir))
    return found.select("inv_ord", "first_row", "n_rows", F.round(F.col("total") * 100).cast("long").alias("cents"))


def combined_payments(spark, sf_dir):
    return match.combined_payments(invoices(spark, sf_dir), ledger(spark, sf_dir))


def near_pairs(spark, sf_dir):
    return match.near_pairs(invoices(spark, sf_dir), ledger(spark, sf_dir)).select("inv_ord", "row_index")


def latest_date(spark, sf_dir):
    return statement.latest_date(_results(spark, sf_dir))


def extraction_progress(spark, sf_dir):
    return report.extraction_progress(invoices(spark, sf_dir))


def extracted_fields(spark, sf_dir):
    out = extract.extract_invoices(doc_text(spark, sf_dir))
    return out.select("inv_ord", "source_file", "invoice_number", "vendor", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"), "amount", "extraction_method")


def extraction_accuracy(spark, sf_dir):
    truth = page_invoices(spark, sf_dir).select(F.col("source_file").alias("file"), "vendor", "invoice_number", "invoice_date", "amount", F.when(F.col("extraction_method") == "ocr", "phone").otherwise("").alias("scanned"), F.concat(F.lit("t"), F.col("inv_ord") % 3).alias("template"))
    return extract.score_against_truth(extract.extract_invoices(doc_text(spark, sf_dir)), truth)


def ledger_from_grid(spark, sf_dir):
    out = sheets.ledger_rows(ledger_grid(spark, sf_dir))
    return out.select("row_index", F.date_format("ledger_date", "yyyy-MM-dd").alias("ledger_date"), "description", "reference", "amount")


def coverage_observed(spark, sf_dir):
    """The counts of the run that writes the results, from the metrics that it observes."""
    inv, led = invoices(spark, sf_dir), ledger(spark, sf_dir)
    watch = match.Coverage()
    match.reconcile(inv, led, watch).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(side, *n) for side, n in watch.counts(inv, led).items()], "side string, went_in long, came_out long")


def near_places(spark, sf_dir):
    found = match.near_places(invoices(spark, sf_dir), ledger(spark, sf_dir))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("invoice_date", "ledger_date")})


def vendor_ratios(spark, sf_dir):
    """Each vendor of a page against the descriptions of the rows that its invoices refer to: ratio of matching blocks and the test."""
    inv = page_invoices(spark, sf_dir).select("vendor", F.col("invoice_number").alias("reference"))
    pairs = inv.join(ledger(spark, sf_dir), "reference").where("vendor is not null").select("vendor", "description").distinct()
    pairs = spread(pairs, "vendor", "description").withColumn("r", ratio(F.lower("vendor"), F.lower("description")))
    return pairs.select("vendor", "description", F.round("r", 9).alias("ratio"), vendor_names(F.col("vendor"), F.col("description")).alias("names"))


#: Vendor, number, date and amount of a document's head, of which some are missing; in SQL that Spark and other engines read alike.
HEAD = (
    "concat(CASE doc_id % 3 WHEN 0 THEN 'Nordlake' WHEN 1 THEN 'Amber' ELSE 'Linden' END, ' ', CASE doc_id % 2 WHEN 0 THEN 'Traders' ELSE 'Works Ltd' END)",
    "CASE WHEN doc_id % 7 != 0 THEN concat('DOC-', CAST(doc_id AS varchar)) END",
    "CASE WHEN doc_id % 5 != 0 THEN CAST(CAST(date '2024-01-01' + CAST(doc_id % 500 AS int) AS date) AS varchar) END",
    "CASE WHEN doc_id % 6 != 0 THEN CAST(CAST((doc_id % 100000) / 100.0 + 1 AS decimal(12,2)) AS varchar) END",
)


def _document_invoices(spark, sf_dir):
    """Fields out of whole documents, each of which has been given the head of an invoice in front of its prose."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    values = zip(("From: ", "Invoice No: ", "Invoice date: ", "Total due: "), (F.expr(sql.replace("varchar", "string")) for sql in HEAD), strict=True)
    lines = F.concat_ws("\n", *[F.concat(F.lit(label), v) for label, v in values], F.coalesce("text", F.lit("")))
    return extract.extract_invoices(docs.select(F.col("doc_id").alias("inv_ord"), F.col("doc_id").cast("string").alias("source_file"), lines.alias("text")))


def document_fields(spark, sf_dir):
    """How many documents have each field, and sums of the values read."""
    names = ("invoice_number", "vendor", "invoice_date", "amount")
    sums = {
        "number_sum": F.sum(F.regexp_extract("invoice_number", r"(\d+)$", 1).cast("long")),
        "vendor_sum": F.sum(F.length("vendor").cast("long")),
        "day_sum": F.sum(F.datediff("invoice_date", F.lit("2024-01-01").cast("date")).cast("long")),
        "cent_sum": F.sum(F.round(F.col("amount") * 100).cast("long")),
    }
    return _document_invoices(spark, sf_dir).agg(F.count(F.lit(1)).alias("done"), *[F.count(c).alias(f"n_{c}") for c in names], *[v.alias(k) for k, v in sums.items()])


def document_field_values(spark, sf_dir):
    """The fields of every document."""
    out = _document_invoices(spark, sf_dir)
    return out.select(F.col("inv_ord").alias("doc_id"), "invoice_number", "vendor", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"), "amount", "extraction_method")


_SUMS = ", ".join(
    [
        "count(*) AS invoice_count", "count(*) FILTER (amount IS NULL) AS unreadable_count",
        "CAST(sum(CAST(round(coalesce(amount, 0) * 100) AS bigint)) AS bigint) / 100 AS billed",
        "CAST(sum(CAST(round(CASE WHEN amount IS NULL THEN 0 ELSE amount - outstanding END * 100) AS bigint)) AS bigint) / 100 AS settled",
        "CAST(sum(CAST(round(CASE WHEN outstanding > 0 THEN outstanding ELSE 0 END * 100) AS bigint)) AS bigint) / 100 AS outstanding",
        "CAST(sum(CAST(round(CASE WHEN outstanding < 0 THEN -outstanding ELSE 0 END * 100) AS bigint)) AS bigint) / 100 AS overpaid",
        "count(*) FILTER (outstanding < 0) AS overpaid_count",
        *[f"CAST(sum(CAST(round(CASE WHEN outstanding > 0 AND bucket = '{b}' THEN outstanding ELSE 0 END * 100) AS bigint)) AS bigint) / 100 AS {b}" for b in statement.AGE_BUCKETS],
    ]
)

_HEADS = f"SELECT doc_id, {HEAD[1]} AS invoice_number, {HEAD[0]} AS vendor, {HEAD[2]} AS invoice_date, CAST({HEAD[3]} AS double) AS amount, 'text' AS extraction_method FROM documents"
_COVERAGE = (
    RESULTS + "SELECT 'invoices' AS side, (SELECT count(*) FROM inv) AS went_in, (SELECT count(*) FROM results WHERE inv_ord IS NOT NULL) AS came_out UNION ALL "
    "SELECT 'ledger rows', (SELECT count(*) FROM led), (SELECT count(*) FROM (SELECT row_index FROM results WHERE row_index IS NOT NULL UNION SELECT row_index FROM used))"
)

QUERIES = {
    f.__name__: f
    for f in (
        reconcile_detail, reconcile_extra_rows, reconcile_summary, flag_histogram, flagged_mismatches, unmatched_ledger, coverage_counts, vendor_statements,
        statement_totals, statement_lines, duplicate_numbers, reference_matches, combined_payments, near_pairs, latest_date, extraction_progress, extracted_fields, extraction_accuracy, ledger_from_grid, document_fields, document_field_values,
        coverage_observed, near_places, vendor_ratios,
    )
} | forms.QUERIES

ORACLES = {
    "reconcile_detail": RESULTS
    + "SELECT status, invoice_number, vendor, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, amount AS invoice_amount, row_index AS ledger_row, strftime(ledger_date, '%Y-%m-%d') AS ledger_date, description AS ledger_description, row_amount AS ledger_amount, source_file FROM results",
    "reconcile_extra_rows": RESULTS + "SELECT a.inv_ord, a.row_index, f.row_index AS extra_row FROM assigned a JOIN free f ON f.reference = a.reference WHERE f.row_index != a.row_index",
    "reconcile_summary": RESULTS + "SELECT count(*) AS total, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status != 'matched') AS flagged, count(*) FILTER (status = 'matched') / count(*) AS match_rate FROM results",
    "flag_histogram": RESULTS + "SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(status, ', ')) AS flag FROM results) WHERE flag != 'matched' GROUP BY flag",
    "flagged_mismatches": RESULTS + "SELECT inv_ord, CAST(round(abs(amount - row_amount) * 100) AS bigint) AS cents FROM results WHERE contains(status, 'amount_mismatch')",
    "unmatched_ledger": RESULTS + "SELECT row_index, description FROM results WHERE inv_ord IS NULL",
    "coverage_counts": _COVERAGE,
    "coverage_observed": _COVERAGE,
    "vendor_statements": RESULTS + f"SELECT vendor, {_SUMS} FROM aged GROUP BY vendor",
    "statement_totals": RESULTS + f"SELECT vendor, grouping(vendor) = 1 AS grand, {_SUMS} FROM aged GROUP BY ROLLUP (vendor)",
    "statement_lines": RESULTS + "SELECT inv_ord, vendor, CAST(round(outstanding * 100) AS bigint) AS cents, CAST(age_days AS int) AS age_days, bucket FROM aged",
    "duplicate_numbers": f"WITH {VIEWS} SELECT invoice_number, count(*) AS copies FROM inv WHERE invoice_number IS NOT NULL GROUP BY invoice_number HAVING count(*) > 1",
    "reference_matches": f"WITH {VIEWS} SELECT inv_ord, min(row_index) AS first_row, count(*) AS n_rows, CAST(round(sum(led.amount) * 100) AS bigint) AS cents FROM inv JOIN led ON invoice_number = reference GROUP BY inv_ord",
    "combined_payments": RESULTS + "SELECT inv_ord, row_index FROM combined",
    "near_pairs": f"WITH {VIEWS} SELECT inv_ord, row_index FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS dc FROM inv) inv JOIN led ON floor(led.amount * 100) = floor(inv.amount * 100) + dc AND abs(led.amount - inv.amount) <= 0.01 AND abs(ledger_date - invoice_date) <= 5",
    "latest_date": RESULTS + "SELECT d AS as_of FROM last_day",
    "extracted_fields": f"WITH {VIEWS} SELECT inv_ord, source_file, invoice_number, {PAGE_VENDOR} AS vendor, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, abs(amount) AS amount, extraction_method FROM inv",
    "extraction_accuracy": f"WITH {VIEWS}, t AS (SELECT CASE extraction_method WHEN 'ocr' THEN 'phone' ELSE 'clean' END AS kind, concat('t', inv_ord % 3) AS template, CASE WHEN amount IS NULL THEN 0 ELSE 1 END AS known FROM inv) SELECT kind, template, count(*) AS n, 1.0::double AS number, 1.0::double AS vendor, 1.0::double AS date, avg(known) AS amount FROM t GROUP BY GROUPING SETS ((kind), (kind, template))",
    "ledger_from_grid": f"WITH {VIEWS} SELECT CAST(row_index * 2 AS int) AS row_index, strftime(ledger_date, '%Y-%m-%d') AS ledger_date, description, reference, amount FROM led",
    "document_fields": f"WITH f AS ({_HEADS}) SELECT count(*) AS done, count(invoice_number) AS n_invoice_number, count(vendor) AS n_vendor, count(invoice_date) AS n_invoice_date, count(amount) AS n_amount, "
    "CAST(sum(CASE WHEN invoice_number IS NOT NULL THEN doc_id END) AS bigint) AS number_sum, CAST(sum(length(vendor)) AS bigint) AS vendor_sum, CAST(sum(datediff('day', date '2024-01-01', CAST(invoice_date AS date))) AS bigint) AS day_sum, CAST(sum(CAST(round(amount * 100) AS bigint)) AS bigint) AS cent_sum FROM f",
    "document_field_values": _HEADS,
    "near_places": f"WITH {VIEWS}, i AS (SELECT amount, invoice_date, vendor, count(*) AS n_invoices, min(inv_ord) AS first_invoice FROM inv WHERE amount IS NOT NULL AND invoice_date IS NOT NULL GROUP BY ALL), "
    "l AS (SELECT amount AS row_amount, ledger_date, coalesce(description, '') AS text, count(*) AS n_rows, min(row_index) AS first_row FROM led WHERE amount IS NOT NULL AND ledger_date IS NOT NULL GROUP BY ALL) "
    "SELECT amount, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, vendor, n_invoices, first_invoice, row_amount, strftime(ledger_date, '%Y-%m-%d') AS ledger_date, text, n_rows, first_row FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS dc FROM i) i JOIN l ON floor(row_amount * 100) = floor(amount * 100) + dc AND abs(row_amount - amount) <= 0.01 AND abs(ledger_date - invoice_date) <= 5",
    "vendor_ratios": f"WITH RECURSIVE {VIEWS}, "
    f"p AS MATERIALIZED (SELECT DISTINCT vendor, description FROM (SELECT {PAGE_VENDOR} AS vendor, invoice_number FROM inv) i JOIN led ON invoice_number = reference WHERE vendor IS NOT NULL), "
    # Each step finds the longest run of a that b has, the first of equal ones, and goes on with what is left and right of it.
    "box AS (SELECT vendor, description, lower(vendor) AS a, lower(description) AS b, 0 AS found FROM p UNION ALL "
    "SELECT vendor, description, unnest([substr(a, 1, i - 1), substr(a, i + n)]), unnest([substr(b, 1, j - 1), substr(b, j + n)]), unnest([n, 0]) FROM ("
    "SELECT vendor, description, a, b, CAST(length(s) AS int) AS n, CAST(strpos(a, s) AS int) AS i, CAST(strpos(b, s) AS int) AS j FROM ("
    "SELECT *, list_filter(flatten([[substr(a, i, n) FOR i IN range(1, length(a) - n + 2)] FOR n IN range(length(a), 0, -1)]), lambda x: contains(b, x))[1] AS s FROM box WHERE a != '' AND b != '') WHERE s IS NOT NULL)), "
    "m AS (SELECT vendor, description, sum(found) AS matched FROM box GROUP BY ALL) "
    "SELECT vendor, description, CAST(round(2 * matched / (length(vendor) + length(description)), 9) AS double) AS ratio, contains(lower(description), lower(vendor)) OR 2 * matched / (length(vendor) + length(description)) >= 0.5 AS names FROM m",
    "extraction_progress": f"WITH {VIEWS} SELECT count(*) AS done, count(*) FILTER (invoice_number IS NULL OR amount IS NULL OR invoice_date IS NULL) AS partial FROM inv",
} | forms.ORACLES
