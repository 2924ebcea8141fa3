"""Reconciliation: links invoices to ledger rows, one row each, in invoice order.

Combined payments are settled first, as sets. Then each invoice, in order, takes
all rows of its number if they add up to it, else the first row of its number,
else the one row that is near in amount and date (`assign`).
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.sums import exact_sum
from ..functions.text import BLANK, strip
from ..model import AMOUNT_MISMATCH, COMBINED, DUPLICATE, INSTALMENTS, NO_INVOICE, NO_LEDGER_ENTRY, UNREADABLE
from .assign import CLASS, SPOT, close, dated, decide, has_number, near_classes, row_class
from .lineage import cut


class CoverageError(Exception):
    """Rows went in that didn't come back out."""


def observed(watched: Observation) -> dict:
    """The counts of an observation; none where Spark left the observed side out of the plan, whose row then has no schema."""
    try:
        return watched.get
    except Py4JJavaError as e:
        if "AssertionError" not in e.java_exception.getClass().getName():
            raise
        return {}


class Coverage:
    """Counts of what went into a reconciliation and came out of it, taken from the one run that writes the results."""

    def __init__(self):
        self.invoices, self.ledger, self.results, self.left = (Observation() for _ in range(4))

    def counts(self, invoices: DataFrame, ledger: DataFrame) -> dict[str, tuple[int, int]]:
        """{side: (went in, came out)} once results are written. A side that Spark could leave out of the plan, as the other is empty, is counted."""
        seen = lambda watched, df: n if (n := observed(watched).get("n")) is not None else df.count()
        out = observed(self.results)
        return {"invoices": (seen(self.invoices, invoices), out.get("n", 0)), "ledger rows": (seen(self.ledger, ledger), out.get("rows", 0) + observed(self.left).get("n", 0))}

    def verify(self, invoices: DataFrame, ledger: DataFrame) -> None:
        for side, (went_in, came_out) in self.counts(invoices, ledger).items():
            if went_in != came_out:
                raise CoverageError(f"{went_in} {side} went in, {came_out} came back out: {went_in - came_out} were dropped.")


def write_results(invoices: DataFrame, ledger: DataFrame, path: str) -> None:
    """Reconcile and write the results as Parquet. They get their name only if nothing was dropped; else there is an error and no result."""
    spark = invoices.sparkSession
    watch, half = Coverage(), f"{path}.{uuid.uuid4().hex}"
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = name(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        reconcile(invoices, ledger, watch).write.parquet(half)
        watch.verify(invoices, ledger)
        if store.exists(name(path)) or not store.rename(name(half), name(path)):
            raise FileExistsError(path)
    finally:
        store.delete(name(half), True)


def reference_tokens(reference: Column) -> Column:
    """Parts of a reference between white space of any kind, commas, semicolons, plus signs, slashes and ampersands."""
    return F.split(strip(reference), rf"(?U)[{BLANK},;+/&]+")


def unreadable(invoice) -> Column:
    missing = [F.col(c).isNull() for c in ("invoice_number", "vendor", "invoice_date", "amount")]
    return missing[0] | missing[1] | missing[2] | missing[3]


def searchable() -> Column:
    return has_number(F.col("invoice_number")) | (F.col("amount").isNotNull() & F.col("invoice_date").isNotNull())


def duplicate_numbers(invoices: DataFrame) -> DataFrame:
    """(invoice_number, copies) of numbers that occur more than once."""
    return invoices.where(has_number(F.col("invoice_number"))).groupBy("invoice_number").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def by_reference(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """(inv_ord, first_row, n_rows, total) of invoices whose number is the reference of ledger rows."""
    rows = ledger.where(has_number(F.col("reference"))).groupBy("reference").agg(
        F.min("row_index").alias("first_row"), F.count(F.lit(1)).alias("n_rows"), exact_sum(F.col("amount")).alias("total")
    )
    own = invoices.where(has_number(F.col("invoice_number"))).select("inv_ord", F.col("invoice_number").alias("reference"))
    return own.join(rows, "reference").select("inv_ord", "first_row", "n_rows", "total")


def combined_payments(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """(inv_ord, row_index): invoices whose first row that names them among others equals the sum of all it names."""
    tokens = reference_tokens(F.col("reference"))
    named = ledger.where(has_number(F.col("reference"))).select("row_index", F.col("amount").alias("row_amount"), tokens.alias("t")).where(F.size("t") >= 2)
    named = named.select("row_index", "row_amount", F.explode(F.array_distinct("t")).alias("invoice_number"))
    first = named.groupBy("invoice_number").agg(F.min(F.struct("row_index", "row_amount")).alias("r"))
    hits = invoices.where(has_number(F.col("invoice_number"))).select("inv_ord", "invoice_number", "amount").join(first, "invoice_number")
    hits = hits.select("inv_ord", "amount", F.col("r.row_index").alias("row_index"), F.col("r.row_amount").alias("row_amount"))
    sums = hits.groupBy("row_index", "row_amount").agg(F.count(F.lit(1)).alias("n"), F.count("amount").alias("known"), exact_sum(F.col("amount")).alias("total"))
    good = sums.where((F.col("n") >= 2) & (F.col("known") == F.col("n")) & close(F.col("total"), F.col("row_amount"))).select("row_index")
    return hits.join(good, "row_index").select("inv_ord", "row_index")


def near_places(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Near classes of invoices and rows with their counts and first members, not all pairs of members.

    (amount, invoice_date, vendor, n_invoices, first_invoice, row_amount, ledger_date, text, n_rows, first_row)
    """
    rows = row_class(ledger).where(dated(F.col("row_amount"), F.col("ledger_date"))).groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_index").alias("first_row"))
    spots = invoices.where(dated(F.col("amount"), F.col("invoice_date"))).groupBy(*SPOT, "vendor").agg(F.count(F.lit(1)).alias("n_invoices"), F.min("inv_ord").alias("first_invoice"))
    return near_classes(spots, rows).select(*SPOT, "vendor", "n_invoices", "first_invoice", *CLASS, "n_rows", "first_row")


def near_pairs(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """(inv_ord, row_index, vendor, description) of all pairs near in amount and date, one by one; `near_places` has them by class."""
    rows = row_class(ledger).where(dated(F.col("row_amount"), F.col("ledger_date"))).select("row_index", "description", *CLASS)
    spots = invoices.where(dated(F.col("amount"), F.col("invoice_date"))).select("inv_ord", "vendor", *SPOT)
    return near_classes(spots, rows).select("inv_ord", "row_index", "vendor", "description")


def assign(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """(inv_ord, row_index, extra, kind, leads): what each invoice takes; kind is combined, instalments, match, none or skipped.

    Of the invoices of a combined payment the first one `leads`, so that each row counts once.
    """
    combined = cut(combined_payments(invoices, ledger))
    rows = ledger.join(combined.select("row_index").distinct(), "row_index", "left_anti")
    open_ = cut(invoices.where(searchable()).join(combined.select("inv_ord"), "inv_ord", "left_anti").select("inv_ord", "invoice_number", "vendor", "invoice_date", "amount"))
    rows = cut(rows.select("row_index", "ledger_date", "description", "reference", "amount"))
    none = F.array().cast("array<int>")
    first = combined.groupBy("row_index").agg(F.min("inv_ord").alias("first"))
    in_sets = combined.join(first, "row_index").select("inv_ord", "row_index", none.alias("extra"), F.lit("combined").alias("kind"), (F.col("inv_ord") == F.col("first")).alias("leads"))
    skipped = invoices.where(~searchable()).join(combined.select("inv_ord"), "inv_ord", "left_anti")
    skipped = skipped.select("inv_ord", F.lit(None).cast("int").alias("row_index"), none.alias("extra"), F.lit("skipped").alias("kind"))
    return cut(decide(open_, rows).unionByName(skipped).withColumn("leads", F.lit(True)).unionByName(in_sets))


def reconcile(invoices: DataFrame, ledger: DataFrame, watch: Coverage | None = None) -> DataFrame:
    """(result_ord, invoice, ledger_row, flags, extra_rows): one result for each invoice, in order, then the rows left over.

    `watch` sees what goes in and comes out as the results are written.
    """
    taken = assign(invoices, ledger)
    row = F.struct("row_index", "ledger_date", "description", "reference", "amount")
    rows = ledger.select(F.col("row_index").alias("_row"), row.alias("ledger_row"))
    more = taken.select("inv_ord", F.explode("extra").alias("_row")).join(rows, "_row").groupBy("inv_ord").agg(F.array_sort(F.collect_list("ledger_row")).alias("extra_rows"))
    copies = duplicate_numbers(invoices)
    one = F.count(F.lit(1)).alias
    seen = invoices.observe(watch.invoices, one("n")) if watch else invoices
    full = seen.join(taken.select("inv_ord", F.col("row_index").alias("_row"), "kind", "leads"), "inv_ord").join(rows, "_row", "left").join(more, "inv_ord", "left").join(copies, "invoice_number", "left")
    if watch:
        held = F.count_if(F.col("leads") & F.col("ledger_row").isNotNull()) + F.coalesce(F.sum(F.size(F.coalesce("extra_rows", F.array()))), F.lit(0))
        full = full.observe(watch.results, one("n"), held.alias("rows"))
    mismatch = (F.col("kind") == "match") & F.col("amount").isNotNull() & ~close(F.col("amount"), F.col("ledger_row.amount"))
    about = F.when(F.col("kind") == "combined", COMBINED).when(F.col("kind") == "instalments", INSTALMENTS).when(F.col("kind") == "none", NO_LEDGER_ENTRY).when(mismatch, AMOUNT_MISMATCH)
    flags = F.array_compact(F.array(F.when(unreadable(None), UNREADABLE), about, F.when(F.col("copies").isNotNull(), DUPLICATE)))
    empty = F.array().cast(ledger_array := f"array<{ledger.select(row.alias('r')).schema['r'].dataType.simpleString()}>")
    inv = F.struct("inv_ord", "source_file", "invoice_number", "vendor", "invoice_date", "amount", "extraction_method")
    matched = full.select(F.struct(F.lit(0).alias("side"), F.col("inv_ord").alias("ord")).alias("result_ord"), inv.alias("invoice"), "ledger_row", flags.alias("flags"), F.coalesce("extra_rows", empty).alias("extra_rows"))
    used = taken.select(F.col("row_index").alias("_row")).unionByName(taken.select(F.explode("extra").alias("_row"))).where("_row is not null").distinct()
    left = (rows.observe(watch.ledger, one("n")) if watch else rows).join(used, "_row", "left_anti")
    left = left.observe(watch.left, one("n")) if watch else left
    left = left.select(
        F.struct(F.lit(1).alias("side"), F.col("_row").cast("long").alias("ord")).alias("result_ord"),
        F.lit(None).cast(matched.schema["invoice"].dataType).alias("invoice"), "ledger_row", F.array(F.lit(NO_INVOICE)).alias("flags"), F.lit(None).cast(ledger_array).alias("extra_rows"),
    ).withColumn("extra_rows", F.coalesce("extra_rows", empty))
    return matched.unionByName(left)


def status(flags: Column) -> Column:
    return F.when(F.size(flags) == 0, "matched").otherwise(F.array_join(flags, ", "))



def coverage(invoices: DataFrame, ledger: DataFrame, results: DataFrame) -> DataFrame:
    """(side, went_in, came_out) for invoices and ledger rows."""
    rows = results.select(F.explode(F.concat(F.array("ledger_row.row_index"), F.col("extra_rows.row_index"))).alias("row_index")).where("row_index is not null")
    inside = ledger.select("row_index").join(rows.distinct(), "row_index", "left_semi")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = count(invoices, "went_in").withColumn("side", F.lit("invoices")).join(count(results.where("invoice is not null"), "came_out").withColumn("side", F.lit("invoices")), "side")
    two = count(ledger, "went_in").withColumn("side", F.lit("ledger rows")).join(count(inside, "came_out").withColumn("side", F.lit("ledger rows")), "side")
    return one.unionByName(two).select("side", "went_in", "came_out")


def assert_coverage(invoices: DataFrame, ledger: DataFrame, results: DataFrame) -> None:
    for r in coverage(invoices, ledger, results).where("went_in != came_out").collect():  # two rows at most
        raise CoverageError(f"{r.went_in} {r.side} went in, {r.came_out} came back out: {r.went_in - r.came_out} were dropped.")
