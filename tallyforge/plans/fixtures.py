"""Invoices and ledger rows derived from the order tables, as SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import format_amount
from ..operators.lineage import numbered, spread

VIEWS = """
inv AS (
  SELECT o_orderkey AS inv_ord, concat('inv_', lpad(CAST(o_orderkey AS varchar(20)), 12, '0'), '.pdf') AS source_file,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN concat('INV-', CAST(o_orderkey - 1 AS varchar(20))) ELSE concat('INV-', CAST(o_orderkey AS varchar(20))) END AS invoice_number,
    CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE c_name END AS vendor,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_orderdate AS date) END AS invoice_date,
    CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount,
    CASE WHEN o_orderkey % 9 = 4 THEN 'ocr' ELSE 'text' END AS extraction_method
  FROM orders JOIN customer ON o_custkey = c_custkey
), bills AS (
  -- every 47th is a credit note
  SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 47 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders
), base AS (
  SELECT o.o_orderkey AS k, c_name AS name, CAST(o.o_orderdate AS date) AS day, o.o_totalprice AS total,
    CAST(floor(o.o_totalprice * 40) AS double) / 100 AS part, n.o_totalprice AS next_total,
    CASE WHEN o.o_orderkey % 19 = 0 AND n.o_orderkey IS NOT NULL THEN 'combined'
         WHEN o.o_orderkey % 19 = 1 AND o.o_orderkey > 1 THEN 'gone'
         WHEN o.o_orderkey % 17 = 0 THEN 'gone'
         WHEN o.o_orderkey % 13 = 0 THEN 'split'
         WHEN o.o_orderkey % 5 = 0 THEN 'bare'
         WHEN o.o_orderkey % 11 = 0 THEN 'typo' ELSE 'plain' END AS shape
  FROM bills o JOIN customer ON o.o_custkey = c_custkey LEFT JOIN bills n ON n.o_orderkey = o.o_orderkey + 1
), raw AS (
  SELECT k * 4 AS ord, day + CAST(2 + k % 20 AS int) AS ledger_date, concat(name, ' payment') AS description,
    concat('INV-', CAST(k AS varchar(20))) AS reference, 
    -- faults of the amount: a round sum more, ten times it, two digits changed about, another rate of exchange
    CASE WHEN shape = 'plain' THEN total WHEN k % 4 = 0 THEN total + 50 WHEN k % 4 = 1 THEN total * 10
         WHEN k % 4 = 2 THEN total + 9 * (CAST(floor(total) AS bigint) % 10 - CAST(floor(total / 10) AS bigint) % 10)
         ELSE CAST(floor(total * 101.3) AS double) / 100 END AS amount
  FROM base WHERE shape IN ('plain', 'typo')
  UNION ALL
  SELECT k * 4, day + CAST(k % 5 AS int), concat('Transfer ', name), NULL, total FROM base WHERE shape = 'bare'
  UNION ALL
  SELECT k * 4, day + CAST(3 AS int), concat(name, ' first part'), concat('INV-', CAST(k AS varchar(20))), part FROM base WHERE shape = 'split'
  UNION ALL
  SELECT k * 4 + 1, day + CAST(30 AS int), concat(name, ' second part'), concat('INV-', CAST(k AS varchar(20))), total - part FROM base WHERE shape = 'split'
  UNION ALL
  SELECT k * 4, day + CAST(9 AS int), 'Combined transfer', concat('INV-', CAST(k AS varchar(20)), ' / INV-', CAST(k + 1 AS varchar(20))), total + next_total FROM base WHERE shape = 'combined'
  UNION ALL
  SELECT k * 4 + 2, day + CAST(1 AS int), concat('Wire transfer ', CAST(k AS varchar(20))), NULL, total * 3 + 0.37 FROM base WHERE k % 23 = 0
), led AS (
  SELECT CAST(1 + row_number() OVER (ORDER BY ord) AS int) AS row_index, ledger_date, description, reference, amount FROM raw
)
"""

TABLES = ("orders", "customer")


def _views(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql(f"WITH {VIEWS} SELECT * FROM inv".replace("varchar(20)", "string"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows under their sheet numbers; numbering sorts by range, not in one task."""
    _views(spark, sf_dir)
    from pyspark.sql import functions as F

    raw = spark.sql(f"WITH {VIEWS} SELECT * FROM raw".replace("varchar(20)", "string"))
    return numbered(raw, "ord").select((F.col("n") + 1).cast("int").alias("row_index"), "ledger_date", "description", "reference", "amount")


#: Invoices by key, and whether a fault is planted: in the ledger, in their number, or their sign.
PLANTED = "SELECT k AS key, shape IN ('combined', 'gone', 'split', 'typo') OR k % 37 = 0 OR (k + 1) % 37 = 0 OR k % 47 = 0 AS planted FROM base"

#: The keys of the invoices that a row of the ledger settles.
OWNERS = "CASE WHEN ord % 4 = 2 THEN array() WHEN description = 'Combined transfer' THEN array(CAST(floor(ord / 4) AS bigint), CAST(floor(ord / 4) AS bigint) + 1) ELSE array(CAST(floor(ord / 4) AS bigint)) END"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql(f"WITH {VIEWS} {PLANTED}".replace("varchar(20)", "string"))


def owned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows by their sheet numbers, with the keys of the invoices that they settle."""
    _views(spark, sf_dir)
    raw = spark.sql(f"WITH {VIEWS} SELECT ord, {OWNERS} AS owners FROM raw".replace("varchar(20)", "string"))
    return numbered(raw, "ord").selectExpr("n + 1 AS row_index", "owners")


#: Engines that don't keep the result of a view that is read often are told to.
_ONCE = VIEWS.replace("inv AS (", "inv AS MATERIALIZED (").replace("led AS (", "led AS MATERIALIZED (")

RESULTS = f"""
WITH {_ONCE}, first_named AS MATERIALIZED (
  SELECT inv.inv_ord, inv.amount, min(led.row_index) AS row_index
  FROM inv JOIN (SELECT row_index, unnest(string_split(reference, ' / ')) AS token FROM led WHERE reference LIKE '% / %') led ON inv.invoice_number = token
  GROUP BY ALL
), good AS (
  SELECT f.row_index FROM first_named f JOIN led USING (row_index) GROUP BY f.row_index, led.amount
  HAVING count(*) >= 2 AND count(f.amount) = count(*) AND abs(sum(f.amount) - led.amount) <= 0.01
), combined AS MATERIALIZED (SELECT inv_ord, row_index FROM first_named JOIN good USING (row_index)
), free AS MATERIALIZED (SELECT * FROM led WHERE row_index NOT IN (SELECT row_index FROM combined)
), open_inv AS MATERIALIZED (
  SELECT * FROM inv WHERE (invoice_number IS NOT NULL OR (amount IS NOT NULL AND invoice_date IS NOT NULL)) AND inv_ord NOT IN (SELECT inv_ord FROM combined)
), early AS MATERIALIZED (
  -- an invoice without rows of its number takes its only near row before a later invoice that the row refers to
  SELECT i.inv_ord, min(f.row_index) AS row_index
  FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS dc FROM open_inv) i JOIN free f ON floor(f.amount * 100) = floor(i.amount * 100) + dc AND abs(f.amount - i.amount) <= 0.01 AND abs(f.ledger_date - i.invoice_date) <= 5
  WHERE coalesce(i.invoice_number, '') NOT IN (SELECT reference FROM free WHERE reference IS NOT NULL)
  GROUP BY i.inv_ord, i.invoice_number HAVING count(*) = 1 AND min(f.reference) IN (SELECT invoice_number FROM open_inv o WHERE o.invoice_number IS NOT NULL AND o.inv_ord > i.inv_ord)
), free2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY row_index) AS nth FROM free WHERE row_index NOT IN (SELECT row_index FROM early)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY invoice_number ORDER BY inv_ord) AS copy FROM open_inv
), refs AS MATERIALIZED (SELECT reference, min(row_index) AS first_row, count(*) AS n, sum(amount) AS total FROM free2 WHERE reference IS NOT NULL GROUP BY reference
), first_copy AS MATERIALIZED (
  SELECT r.inv_ord, r.amount, first_row, coalesce(n >= 2 AND abs(total - r.amount) <= 0.01, false) AS parts, n, reference
  FROM ranked r JOIN refs ON r.invoice_number = reference WHERE copy = 1
), by_ref AS MATERIALIZED (
  SELECT * FROM first_copy
  UNION ALL
  SELECT r.inv_ord, r.amount, f.row_index, false, 1, f.reference FROM ranked r JOIN first_copy c ON c.reference = r.invoice_number AND NOT c.parts
  JOIN free2 f ON f.reference = r.invoice_number AND f.nth = r.copy WHERE r.copy > 1
), taken AS MATERIALIZED (
  SELECT f.row_index FROM by_ref b JOIN free2 f ON f.reference = b.reference WHERE b.parts OR f.row_index = b.first_row
), band AS (
  SELECT i.inv_ord, min(f.row_index) AS row_index, count(*) AS n
  FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS dc FROM open_inv) i JOIN free2 f ON floor(f.amount * 100) = floor(i.amount * 100) + dc AND abs(f.amount - i.amount) <= 0.01 AND abs(f.ledger_date - i.invoice_date) <= 5
  WHERE i.inv_ord NOT IN (SELECT inv_ord FROM by_ref) AND i.inv_ord NOT IN (SELECT inv_ord FROM early) AND f.row_index NOT IN (SELECT row_index FROM taken) GROUP BY i.inv_ord HAVING count(*) = 1
), assigned AS MATERIALIZED (
  SELECT inv_ord, row_index, 'combined' AS kind, NULL AS reference FROM combined
  UNION ALL SELECT inv_ord, first_row, CASE WHEN parts THEN 'parts' ELSE 'match' END, CASE WHEN parts THEN reference END FROM by_ref
  UNION ALL SELECT inv_ord, row_index, 'match', NULL FROM band
  UNION ALL SELECT inv_ord, row_index, 'match', NULL FROM early
), copies AS (SELECT invoice_number, count(*) AS n FROM inv WHERE invoice_number IS NOT NULL GROUP BY invoice_number
), judged AS MATERIALIZED (
  SELECT inv.*, a.row_index, a.kind, a.reference AS part_reference, l.ledger_date, l.description, l.amount AS row_amount,
    (SELECT sum(f.amount) FROM free f WHERE f.reference = a.reference) AS parts_total,
    concat_ws(', ',
      CASE WHEN inv.invoice_number IS NULL OR vendor IS NULL OR invoice_date IS NULL OR inv.amount IS NULL THEN 'unreadable_invoice' END,
      CASE WHEN a.kind = 'combined' THEN 'combined_payment' WHEN a.kind = 'parts' THEN 'paid_in_instalments'
           WHEN a.inv_ord IS NULL AND (inv.invoice_number IS NOT NULL OR (inv.amount IS NOT NULL AND invoice_date IS NOT NULL)) THEN 'no_ledger_entry'
           WHEN a.kind = 'match' AND inv.amount IS NOT NULL AND NOT abs(inv.amount - l.amount) <= 0.01 THEN 'amount_mismatch' END,
      CASE WHEN c.n > 1 THEN 'duplicate_invoice' END) AS flags
  FROM inv LEFT JOIN assigned a USING (inv_ord) LEFT JOIN led l ON l.row_index = a.row_index LEFT JOIN copies c ON c.invoice_number = inv.invoice_number
), used AS (
  SELECT row_index FROM assigned UNION SELECT f.row_index FROM assigned a JOIN free f ON f.reference = a.reference
), results AS MATERIALIZED (
  SELECT inv_ord, source_file, invoice_number, vendor, invoice_date, amount, row_index, ledger_date, description, row_amount, parts_total, kind,
    CASE WHEN flags = '' THEN 'matched' ELSE flags END AS status FROM judged
  UNION ALL
  SELECT NULL, NULL, NULL, NULL, NULL, NULL, row_index, ledger_date, description, amount, NULL, NULL, 'no_invoice' FROM led WHERE row_index NOT IN (SELECT row_index FROM used)
), last_day AS (SELECT greatest(max(invoice_date), max(ledger_date)) AS d FROM results
), lines AS (
  SELECT *, CASE WHEN amount IS NULL OR abs(amount - settled) <= 0.01 THEN 0 ELSE amount - settled END AS outstanding, datediff('day', invoice_date, d) AS age_days
  FROM (SELECT *, coalesce(parts_total, row_amount, 0) AS settled FROM results WHERE inv_ord IS NOT NULL), last_day
), aged AS MATERIALIZED (
  SELECT *, CASE WHEN age_days IS NULL THEN 'undated' WHEN age_days <= 30 THEN 'd0_30' WHEN age_days <= 60 THEN 'd31_60' WHEN age_days <= 90 THEN 'd61_90' ELSE 'd90_plus' END AS bucket FROM lines
)
"""


PAGE_VENDOR = """CASE WHEN inv_ord % 31 = 0 THEN NULL ELSE concat(
  CASE inv_ord % 4 WHEN 0 THEN 'Nordlake' WHEN 1 THEN 'Amber' WHEN 2 THEN 'Stonebridge' ELSE 'Linden' END, ' ',
  CASE inv_ord % 3 WHEN 0 THEN 'Traders' WHEN 1 THEN 'Works Ltd' ELSE 'Consulting' END) END"""


def page_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices under vendor names that read like a company's; pages show amounts without a sign."""
    from pyspark.sql import functions as F

    return invoices(spark, sf_dir).withColumns({"vendor": F.expr(PAGE_VENDOR), "amount": F.abs("amount")})


def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices written out as pages: label, number format and date format vary with the key."""
    from pyspark.sql import functions as F

    inv = spread(page_invoices(spark, sf_dir), "inv_ord")  # the order table may be a single split
    k = F.col("inv_ord")
    label = F.when(k % 3 == 0, "Invoice No: ").when(k % 3 == 1, "Invoice number ").otherwise("Receipt # ")
    amount = format_amount(F.col("amount"), F.when(k % 4 == 0, "us").when(k % 4 == 1, "eu").otherwise("plain"))
    day = lambda f: F.date_format("invoice_date", f)
    date = F.when(k % 5 == 0, day("yyyy-MM-dd")).when(k % 5 == 1, day("dd/MM/yyyy")).when(k % 5 == 2, day("d MMMM yyyy")).when(k % 5 == 3, day("MMM d, yyyy")).otherwise(day("dd.MM.yyyy"))
    total = F.when(k % 2 == 0, "Total due: ").otherwise("Total payable ")
    lines = F.array_compact(F.array(F.concat(F.lit("From: "), "vendor"), F.lit("Page 1 of 1"), F.concat(label, "invoice_number"), F.concat(F.lit("Invoice date: "), date), F.lit("subtotal 1.00"), F.concat(total, amount)))
    return inv.select("inv_ord", "source_file", F.array_join(lines, "\n").alias("text"), F.col("extraction_method").alias("method"))


def ledger_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as a sheet of typed cells under the header Date, Description, Reference, Debit, Credit, with blank rows between."""
    from pyspark.sql import functions as F

    cell = lambda kind, **v: F.struct(
        F.lit(kind).alias("kind"), v.get("str", F.lit(None).cast("string")).alias("str"), v.get("num", F.lit(None).cast("double")).alias("num"), v.get("dt", F.lit(None).cast("date")).alias("dt")
    )
    text = lambda c: F.when(F.col(c).isNotNull(), cell("string", str=F.col(c)))
    money = F.when(F.col("amount").isNotNull(), cell("float", num=F.col("amount")))
    zero = cell("int", num=F.lit(0.0))
    rows = ledger(spark, sf_dir).withColumn("odd", F.col("row_index") % 2 == 1)
    cells = F.array(F.when(F.col("ledger_date").isNotNull(), cell("date", dt=F.col("ledger_date"))), text("description"), text("reference"), F.when(F.col("odd"), money).otherwise(zero), F.when(~F.col("odd"), money))
    body = rows.select((F.col("row_index") * 2).cast("long").alias("row_index"), cells.alias("cells"))
    blank = rows.where("row_index % 10 = 0").select((F.col("row_index") * 2 + 1).cast("long").alias("row_index"), F.array().cast(body.schema["cells"].dataType).alias("cells"))
    names = F.array(*[cell("string", str=F.lit(n)) for n in ("Date", " Description ", "Reference", "Debit", "Credit")])
    head = spark.range(1, 2).select(F.col("id").alias("row_index"), names.cast(body.schema["cells"].dataType).alias("cells"))
    return head.unionByName(body).unionByName(blank)
