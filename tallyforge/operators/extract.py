"""Invoices from document texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .lineage import cut


def extract_invoices(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(inv_ord, source_file, invoice_number, vendor, invoice_date, amount, extraction_method) of `docs`.

    `docs` has source_file, text and, where known, method and inv_ord. A blank
    text reads as nothing, by the method `none`. Each step is a projection of
    its own, so no pattern runs twice over a text; the plan has no shuffle and
    runs on streams as well. Columns to `keep` go along.
    """
    blank = F.coalesce(X.strip(F.col("text")) == "", F.lit(True))
    method = F.coalesce("method", F.lit("text")) if "method" in docs.columns else F.lit("text")
    order = F.col("inv_ord") if "inv_ord" in docs.columns else F.lit(None).cast("long")
    rows = docs.select(order.alias("inv_ord"), "source_file", X.normalise(F.coalesce("text", F.lit(""))).alias("t"), F.when(blank, "none").otherwise(method).alias("extraction_method"), *[F.col(c).alias(f"_{c}") for c in keep])
    rows = rows.withColumns({"invoice_number": X.extract_number(F.col("t")), "amount": X.extract_amount(F.col("t")), "invoice_date": X.extract_date(F.col("t")), "lines": X.vendor_lines(F.col("t"))})
    rows = rows.withColumn("cleaned", F.transform("lines", X.clean_vendor))
    rows = rows.withColumn("vendor", _vendor())
    return rows.select("inv_ord", "source_file", "invoice_number", "vendor", "invoice_date", "amount", "extraction_method", *[F.col(f"_{c}").alias(c) for c in keep])


def _vendor() -> Column:
    """A labelled name if it reads like one, else the first of the first lines that does once it is cleaned."""
    lines, cleaned = F.col("lines"), F.col("cleaned")
    labelled = [F.when((F.get(lines, F.lit(k)) != "") & X.looks_like_a_name(X.strip(F.get(lines, F.lit(k)))), F.get(cleaned, F.lit(k))) for k in (0, 1)]
    heads = F.filter(F.slice(cleaned, F.lit(3), F.lit(X.SCAN_LINES)), lambda c: (c != "") & X.looks_like_a_name(c))
    return F.coalesce(*labelled, F.get(heads, F.lit(0)))


def field_count() -> Column:
    """How many of the four fields were read."""
    return sum((F.col(c).isNotNull().cast("int") for c in ("invoice_number", "vendor", "invoice_date", "amount")), F.lit(0))


def best_reading(readings: DataFrame) -> DataFrame:
    """One reading of each source_file: the one of most fields, the earliest attempt of equal ones."""
    most = F.max_by(F.struct("invoice_number", "vendor", "invoice_date", "amount", "extraction_method"), F.struct(field_count(), -F.col("attempt")))
    return readings.groupBy("source_file").agg(most.alias("r")).select("source_file", "r.*")


def staged_readings(pages: DataFrame, attempts: list[Callable[[DataFrame], DataFrame]], key: str = "source_file") -> DataFrame:
    """(key, text, attempt, fields): the best reading of each page, of attempts that are made one after another.

    An attempt turns pages into readings (key, text). Only pages of which no
    reading has had all four fields yet go on to the next. Each stage is kept,
    so that no attempt is made twice.
    """
    readings, open_ = None, pages
    for k, attempt in enumerate(attempts, 1):
        found = extract_invoices(attempt(open_).withColumn("source_file", F.col(key)), ("text",))
        stage = cut(found.select(F.col("source_file").alias(key), "text", F.lit(k).alias("attempt"), field_count().alias("fields")))
        readings = stage if readings is None else readings.unionByName(stage)
        open_ = pages.join(stage.where(F.col("fields") < 4).select(key), key, "left_semi")
    best = F.max_by(F.struct("text", "attempt", "fields"), F.struct(F.col("fields"), -F.col("attempt")))
    return readings.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def score_against_truth(invoices: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, template, n, number, vendor, date, amount): shares of fields read rightly, by kind and by kind and template."""
    joined = truth.alias("t").join(invoices.alias("i"), F.col("t.file") == F.col("i.source_file"))
    kind = F.when(F.coalesce("t.scanned", F.lit("")) == "", "clean").otherwise(F.col("t.scanned"))
    right = {
        "number": F.col("t.invoice_number").eqNullSafe(F.col("i.invoice_number")),
        "vendor": F.lower("t.vendor").eqNullSafe(F.lower("i.vendor")),
        "date": F.col("t.invoice_date").cast("date").eqNullSafe(F.col("i.invoice_date")),
        "amount": F.coalesce(F.abs(F.col("t.amount") - F.col("i.amount")) <= 0.01, F.lit(False)),
    }
    rows = joined.select(kind.alias("kind"), F.col("t.template").alias("template"), *[c.cast("int").alias(k) for k, c in right.items()])
    sets = rows.groupingSets([[F.col("kind")], [F.col("kind"), F.col("template")]], F.col("kind"), F.col("template"))
    return sets.agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(k) for k in right])
