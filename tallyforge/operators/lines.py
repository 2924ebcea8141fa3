"""Totals of invoices from their line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_totals(items: DataFrame, rate: Column | float) -> DataFrame:
    """(invoice, n_lines, subtotal, tax, total) of items (invoice, quantity, unit_price).

    Each line is rounded to cents before the sum, which is one of whole cents,
    and the tax once over the subtotal. Lines without a quantity or price add nothing.
    """
    cents = F.round(F.col("quantity").cast("decimal(18,4)") * F.col("unit_price").cast("decimal(18,4)"), 2).cast("decimal(20,2)")
    sums = items.groupBy("invoice").agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(cents), F.lit(0)).cast("decimal(20,2)").alias("subtotal"))
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    sums = sums.withColumn("tax", F.round(F.col("subtotal") * rate.cast("decimal(9,6)"), 2).cast("decimal(20,2)"))
    return sums.select("invoice", "n_lines", "subtotal", "tax", (F.col("subtotal") + F.col("tax")).cast("decimal(20,2)").alias("total"))
