"""A smaller set of invoices that keeps every one of interest, and the ledger rows that concern it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, numbered


def choose(files: DataFrame, share: float) -> DataFrame:
    """(key) of the files that are `planted`, and of as many others as make up the share of all, by rank of a hash of their keys.

    All planted ones stay, even if they are more than the share. Others with a
    null key don't take part.
    """
    counts = files.agg(F.count(F.lit(1)).alias("n"), F.count_if("planted").alias("planted")).first()
    others = files.where(~F.coalesce("planted", F.lit(False)) & F.col("key").isNotNull())
    ranked = numbered(others.select("key", F.struct(F.md5(F.col("key").cast("string")), "key").alias("rank")), "rank")
    return files.where("planted").select("key").unionByName(ranked.where(F.col("n") <= int(counts.n * share) - counts.planted).select("key"))


def concerned(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of which one of the `owners` is chosen, and those that nobody owns (null or empty owners); `row_index` names a row."""
    owned = F.size(F.coalesce("owners", F.array().cast(rows.schema["owners"].dataType))) > 0
    rows = cut(rows)
    touched = rows.where(owned).select("row_index", F.explode("owners").alias("key")).join(chosen, "key", "left_semi").select("row_index").distinct()
    return rows.where(~owned).unionByName(rows.where(owned).join(touched, "row_index", "left_semi"))
