"""Statements by vendor with ageing, from reconciliation results."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

from ..model import AMOUNT_TOLERANCE

# Names and labels of the age buckets.
AGE_BUCKETS = ("d0_30", "d31_60", "d61_90", "d90_plus", "undated")
AGE_LABELS = {"d0_30": "0-30 days", "d31_60": "31-60 days", "d61_90": "61-90 days", "d90_plus": "90+ days", "undated": "Undated"}


def open_amount() -> Column:
    """What the attached rows leave of an invoice; 0 within the tolerance or for an unread amount; negative if overpaid."""
    extra = F.aggregate("extra_rows", F.lit(0.0), lambda acc, r: acc + F.coalesce(r["amount"], F.lit(0.0)))
    settled = F.coalesce("ledger_row.amount", F.lit(0.0)) + F.coalesce(extra, F.lit(0.0))
    gap = F.col("invoice.amount") - settled
    return F.when(F.col("invoice.amount").isNull() | (F.abs(gap) <= AMOUNT_TOLERANCE), F.lit(0.0)).otherwise(gap)


def age_bucket(age: Column) -> Column:
    return F.when(age.isNull(), "undated").when(age <= 30, "d0_30").when(age <= 60, "d31_60").when(age <= 90, "d61_90").otherwise("d90_plus")


def latest_date(results: DataFrame) -> DataFrame:
    """(as_of): the last date of invoices and first rows; never the clock."""
    return results.agg(F.greatest(F.max("invoice.invoice_date"), F.max("ledger_row.ledger_date")).alias("as_of"))


def statement_lines(results: DataFrame, as_of: datetime.date | None = None, combined_as_full: bool = True) -> DataFrame:
    """One line for each invoice with what is open of it, its age and its bucket.

    With `combined_as_full` every invoice of a combined payment counts the whole
    transfer as paid, which shows as an overpayment; without it the invoice
    counts as settled by its share.
    """
    if as_of is None:
        results = cut(results)  # read for the date, and again for the lines
        as_of = latest_date(results).first().as_of  # one row
    left = open_amount()
    if not combined_as_full:
        left = F.when(F.array_contains("flags", "combined_payment"), F.lit(0.0)).otherwise(left)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("invoice.invoice_date"))
    lines = results.where("invoice is not null").select("invoice.*", left.alias("outstanding"), age.alias("age_days"))
    return lines.withColumn("bucket", age_bucket(F.col("age_days")))


def statement_amounts() -> dict[str, Column]:
    known, left = F.col("amount").isNotNull(), F.col("outstanding")
    # Sums of whole cents don't depend on the order of rows or on the cluster.
    cents = lambda c: F.sum(F.round(c * 100).cast("long")) / 100
    zero = F.lit(0.0)
    out = {
        "invoice_count": F.count(F.lit(1)),
        "unreadable_count": F.count_if(~known),
        "billed": cents(F.when(known, F.col("amount")).otherwise(zero)),
        "settled": cents(F.when(known, F.col("amount") - left).otherwise(zero)),
        "outstanding": cents(F.when(known & (left > 0), left).otherwise(zero)),
        "overpaid": cents(F.when(known & (left < 0), -left).otherwise(zero)),
        "overpaid_count": F.count_if(known & (left < 0)),
    }
    return out | {b: cents(F.when(known & (left > 0) & (F.col("bucket") == b), left).otherwise(zero)) for b in AGE_BUCKETS}


def statements(lines: DataFrame, with_lines: bool = False) -> DataFrame:
    """One row for each vendor; unreadable vendors form a row of their own."""
    amounts = statement_amounts()
    if with_lines:  # as many as a vendor has invoices; leave it out for very large vendors
        amounts["lines"] = F.array_sort(F.collect_list(F.struct("inv_ord", "source_file", "invoice_number", "invoice_date", "amount", "outstanding", "age_days", "bucket")))
    return lines.groupBy("vendor").agg(F.min("inv_ord").alias("first_ord"), *[c.alias(k) for k, c in amounts.items()])


def in_order(rows: DataFrame) -> DataFrame:
    """Vendors without a name last; else by what is open and overpaid, largest first, then by first appearance."""
    return rows.orderBy(F.col("vendor").isNull(), (F.col("outstanding") + F.col("overpaid")).desc(), "first_ord")


def open_ages(totals: DataFrame) -> DataFrame:
    """(vendor, grand, bucket, label, amount) of statement totals, for the age buckets in which anything is open."""
    each = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(AGE_LABELS[b]).alias("label"), F.col(b).alias("amount")) for b in AGE_BUCKETS])
    return totals.select("vendor", "grand", F.explode(F.filter(each, lambda e: e["amount"] != 0)).alias("e")).select("vendor", "grand", "e.*")


def statement_totals(lines: DataFrame) -> DataFrame:
    """The vendors' statements and, where `grand` is true, the totals over all of them, in one pass."""
    amounts = {k: c.alias(k) for k, c in statement_amounts().items()}
    return lines.rollup("vendor").agg((F.grouping("vendor") == 1).alias("grand"), *amounts.values())
