"""Report tables: flat detail, summary and flag counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import status

# Report columns, labels and explanations.
DETAIL_COLUMNS = ("Status", "Invoice #", "Vendor", "Invoice Date", "Invoice Amount", "Ledger Row", "Ledger Date", "Ledger Description", "Ledger Amount", "Source File", "Read Via")
READ_VIA = {"text": "text layer", "ocr": "OCR (verify)", "none": "unreadable"}
FLAG_LABELS = {
    "unreadable_invoice": "Could not read invoice",
    "no_ledger_entry": "No matching payment",
    "no_invoice": "Payment with no invoice",
    "amount_mismatch": "Amount differs",
    "duplicate_invoice": "Duplicate invoice",
    "paid_in_instalments": "Paid in instalments",
    "combined_payment": "Paid with other invoices",
}
FLAG_MEANINGS = {
    "unreadable_invoice": "Not every field could be read from this PDF, even after OCR for scans. Nothing was guessed; check the file by hand.",
    "no_ledger_entry": "The invoice exists but no matching payment appears in the ledger.",
    "no_invoice": "A payment appears in the ledger with no invoice on file to support it.",
    "amount_mismatch": "The invoice and the ledger entry were matched, but the amounts differ.",
    "duplicate_invoice": "This invoice number appears more than once, so the same invoice may be recorded twice.",
    "paid_in_instalments": "Several ledger rows carry this invoice number and together they add up to the invoice. Nothing is wrong; it was paid in parts.",
    "combined_payment": "One ledger entry settles this invoice together with others; its reference names them all and the amount is their sum.",
}

NOTE = "Flagged items are records to review, not confirmed errors."


def _lookup(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    return F.coalesce(F.try_element_at(table, key), key)


def read_via(method: Column) -> Column:
    return F.when(method.isNotNull(), _lookup(READ_VIA, method))


def flag_label(flag: Column) -> Column:
    return _lookup(FLAG_LABELS, flag)


def flag_meaning(flag: Column) -> Column:
    return _lookup(FLAG_MEANINGS, flag)


def detail(results: DataFrame) -> DataFrame:
    """(result_ord, status, label, ...): the eleven report columns under plain names, with the flags' labels besides."""
    return results.select(
        "result_ord",
        status(F.col("flags")).alias("status"),
        F.when(F.size("flags") == 0, "Matched").otherwise(F.array_join(F.transform("flags", flag_label), ", ")).alias("label"),
        F.col("invoice.invoice_number").alias("invoice_number"),
        F.col("invoice.vendor").alias("vendor"),
        F.date_format("invoice.invoice_date", "yyyy-MM-dd").alias("invoice_date"),
        F.col("invoice.amount").alias("invoice_amount"),
        F.col("ledger_row.row_index").alias("ledger_row"),
        F.date_format("ledger_row.ledger_date", "yyyy-MM-dd").alias("ledger_date"),
        F.col("ledger_row.description").alias("ledger_description"),
        F.col("ledger_row.amount").alias("ledger_amount"),
        F.col("invoice.source_file").alias("source_file"),
        read_via(F.col("invoice.extraction_method")).alias("read_via"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row: total, matched, flagged and the raw match rate, null without results."""
    clean = F.size("flags") == 0
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(clean).alias("matched"), F.count_if(~clean).alias("flagged")).withColumn(
        "match_rate", F.when(F.col("total") > 0, F.col("matched") / F.col("total"))
    )


def summary_lines(results: DataFrame) -> DataFrame:
    """(item, value): the summary as a report shows it, the flags by their labels."""
    total = summary(results)
    rate = F.when(F.col("match_rate").isNull(), "n/a").otherwise(F.concat(F.floor(F.col("match_rate") * 100 + 0.5).cast("string"), F.lit("%")))
    cells = [("Total items", F.col("total").cast("string")), ("Matched clean", F.col("matched").cast("string")), ("Flagged", F.col("flagged").cast("string")), ("Match rate", rate)]
    head = total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("value")) for k, v in cells])).alias("r")).select("r.*")
    flags = flag_counts(results).select(flag_label(F.col("flag")).alias("item"), F.col("n").cast("string").alias("value"))
    note = results.sparkSession.range(1).select(F.lit("Note").alias("item"), F.lit(NOTE).alias("value"))
    return head.unionByName(flags).unionByName(note)


def one_line(results: DataFrame) -> DataFrame:
    """(line): what went in and came out, for a console."""
    counts = results.agg(
        F.count("invoice").alias("inv"), (F.count_distinct("ledger_row.row_index") + F.coalesce(F.sum(F.size("extra_rows")), F.lit(0))).alias("led"),
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("flags") == 0).alias("clean"),
    )
    return counts.select(F.format_string("%d invoices, %d ledger rows -> %d/%d matched clean, %d flagged", "inv", "led", "clean", "total", F.col("total") - F.col("clean")).alias("line"))


def flag_counts(results: DataFrame) -> DataFrame:
    return results.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def with_flag(results: DataFrame, flag: str) -> DataFrame:
    return results.where(F.array_contains("flags", flag))


def money(amount: Column) -> Column:
    """Two decimals with grouping; a dash for a missing amount."""
    return F.coalesce(F.format_number(amount, 2), F.lit("—"))


def amount_difference() -> Column:
    """How far a mismatched pair lies apart; null for other results."""
    gap = F.abs(F.coalesce("invoice.amount", F.lit(0.0)) - F.coalesce("ledger_row.amount", F.lit(0.0)))
    return F.when(F.array_contains("flags", "amount_mismatch"), gap)


def extraction_progress(invoices: DataFrame) -> DataFrame:
    """(done, partial): invoices read, and those without number, amount or date; a missing vendor doesn't count."""
    partial = F.col("invoice_number").isNull() | F.col("amount").isNull() | F.col("invoice_date").isNull()
    return invoices.agg(F.count(F.lit(1)).alias("done"), F.count_if(partial).alias("partial"))


def csv_safe(df: DataFrame) -> DataFrame:
    """Texts that a spreadsheet would take for a formula get an apostrophe in front; for CSV sinks only."""
    guard = lambda c: F.when(F.col(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c))
    return df.select(*[guard(c).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])
