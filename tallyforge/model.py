"""Record schemas, flags and constants."""

from __future__ import annotations

from pyspark.sql import types as T

# The tolerances and the flag names of the results.
DATE_WINDOW_DAYS = 5
AMOUNT_TOLERANCE = 0.01
VENDOR_SIMILARITY = 0.5

UNREADABLE, NO_LEDGER_ENTRY, NO_INVOICE = "unreadable_invoice", "no_ledger_entry", "no_invoice"
AMOUNT_MISMATCH, DUPLICATE = "amount_mismatch", "duplicate_invoice"
INSTALMENTS, COMBINED = "paid_in_instalments", "combined_payment"

INVOICE = T.StructType(
    [
        T.StructField("inv_ord", T.LongType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("invoice_number", T.StringType()),
        T.StructField("vendor", T.StringType()),
        T.StructField("invoice_date", T.DateType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("extraction_method", T.StringType()),
    ]
)
LEDGER_ROW = T.StructType(
    [
        T.StructField("row_index", T.IntegerType()),
        T.StructField("ledger_date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("amount", T.DoubleType()),
    ]
)
CELL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("str", T.StringType()), T.StructField("num", T.DoubleType()), T.StructField("dt", T.DateType())])
