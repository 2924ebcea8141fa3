"""Ledger sheets: workbook and CSV readers into cell grids, and a small workbook writer."""

from __future__ import annotations

import datetime
import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

GRID = "sheet string, row_index long, cells array<struct<kind:string,str:string,num:double,dt:date>>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_EPOCH = datetime.date(1899, 12, 30)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(f"{_MAIN}numFmt")}
    dated = {*range(14, 23), *range(45, 48)} | {k for k, v in custom.items() if re.search(r"[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", v), re.I)}
    formats = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dated}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(data: bytes, sheet: str | None = None) -> Iterator[tuple[int, list]]:
    """(row number, cells) of one sheet, the first by default, with the values as last computed."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        chosen = next((s for s in names if sheet is None or s.get("name") == sheet), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet}" if sheet else "no sheet")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[chosen.get(f"{_REL}id")].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dated = _date_styles(book)
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            at = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                at = int(row.get("r", at + 1))
                cells: list = []
                for c in row.iter(f"{_MAIN}c"):
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (k + 1 - len(cells))
                    cells[k] = _cell(c, shared, dated)
                row.clear()
                yield at, cells


def _cell(c, shared: list[str], dated: set[int]):
    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return ("string", "".join(t.text or "" for t in c.iter(f"{_MAIN}t")), None, None)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return ("string", shared[int(v.text)], None, None)
    if kind in ("str", "e"):
        return ("string", v.text, None, None)
    if kind == "b":
        return ("bool", None, float(v.text), None)
    if kind == "d":
        return ("date", None, None, datetime.date.fromisoformat(v.text[:10]))
    number = float(v.text)
    if int(c.get("s", 0)) in dated:
        return ("date", None, None, _EPOCH + datetime.timedelta(days=int(number)))
    return ("int" if re.fullmatch(r"-?\d+", v.text) else "float", None, number, None)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(sheet, row_index, cells, error) of one or many workbooks; `sheet` is the file, blank rows keep their number.

    A file that can't be read is one row of number 0 with its error; no file fails the job.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch.path, batch.content, strict=True):
                try:
                    rows = [(name, at, cells, None) for at, cells in workbook_rows(bytes(data), sheet)]
                except Exception as e:  # damaged, encrypted, or no workbook
                    rows = [(name, 0, None, f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(rows, columns=["sheet", "row_index", "cells", "error"])

    return files.mapInPandas(read, f"{GRID}, error string")


def unread(grid: DataFrame) -> DataFrame:
    """(sheet, error) of the files that couldn't be read."""
    return grid.where(F.col("error").isNotNull()).select("sheet", "error")


def _ends_inside(line: Column, inside: bool) -> Column:
    """Whether a quoted field is open at the end of a line, by whether one is where the line begins.

    The pieces between quotes are folded: 0 at the begin of a field, 1 in quotes, 2 behind a quote in quotes, 3 within a plain text.
    """

    def passed(state: Column, piece: Column) -> Column:
        return F.when((piece == "") | (state == 1), state).when(F.endswith(piece, F.lit(",")), 0).otherwise(3)

    def quote(state: Column) -> Column:
        return F.when(state.isin(0, 2), 1).when(state == 1, 2).otherwise(3)

    pieces = F.split(line, '"')
    start = passed(F.lit(int(inside)), F.get(pieces, F.lit(0))).cast("int")
    end = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, lambda state, piece: passed(quote(state), piece).cast("int"))
    return F.when(F.contains(line, F.lit('"')), end == 1).otherwise(inside)


def _in_quotes(lines: DataFrame) -> DataFrame:
    """Adds inside, whether a quoted field is open where a line begins, and row, the number of the record that the line belongs to.

    Each line turns either state into one of the two. What a block of a file
    does to a state is the last line that forgets it, and how often the lines
    since have swapped it, so blocks are read side by side and then chained: the
    chain has one row a block.
    """
    lines = lines.withColumns({"to_out": _ends_inside(F.col("value"), False), "to_in": _ends_inside(F.col("value"), True)})
    lines = lines.withColumn("fixed", F.when(F.col("to_out") == F.col("to_in"), F.col("to_out").cast("int")))
    lines = lines.withColumn("swap", (F.col("to_out") & ~F.col("to_in")).cast("long"))

    block = Window.partitionBy("sheet", "block").orderBy("at")
    upto, before = block.rowsBetween(Window.unboundedPreceding, Window.currentRow), block.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("swaps", F.sum("swap").over(upto))
    told = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swaps"))
    lines = lines.withColumns({"told": F.last(told, ignorenulls=True).over(before), "swaps_before": F.coalesce(F.sum("swap").over(before), F.lit(0)), "told_here": told})

    def state(told, swaps, start):
        """0 outside and 1 inside, after the last line that forgets the state, or after `start`."""
        return F.when(told.isNull(), (start + swaps) % 2).otherwise((told["fixed"] + swaps - told["swaps"]) % 2)

    # Lines that begin a record, for both states in which their block may begin.
    lines = lines.withColumns({f"s{k}": state(F.col("told"), F.col("swaps_before"), F.lit(k)) for k in (0, 1)})
    ends = F.max_by("told_here", F.when(F.col("told_here").isNotNull(), F.col("at")))
    blocks = lines.groupBy("sheet", "block").agg(ends.alias("told"), F.sum("swap").alias("swaps"), *[F.sum(1 - F.col(f"s{k}")).alias(f"n{k}") for k in (0, 1)])
    chain = F.array_sort(F.collect_list(F.struct("block", *[state(F.col("told"), F.col("swaps"), F.lit(k)).cast("int").alias(f"e{k}") for k in (0, 1)], "n0", "n1")))

    def step(acc, b):
        inside = acc["inside"] == 1
        link = F.struct(b["block"].alias("block"), acc["inside"].alias("start"), acc["rows"].alias("first"))
        return F.struct(F.when(inside, b["e1"]).otherwise(b["e0"]).alias("inside"), (acc["rows"] + F.when(inside, b["n1"]).otherwise(b["n0"])).alias("rows"), F.concat(acc["links"], F.array(link)).alias("links"))

    zero = F.struct(F.lit(0).alias("inside"), F.lit(0).cast("long").alias("rows"), F.array().cast("array<struct<block:bigint,start:int,first:bigint>>").alias("links"))
    starts = blocks.groupBy("sheet").agg(chain.alias("blocks")).select("sheet", F.inline(F.aggregate("blocks", zero, step)["links"]))
    lines = lines.join(starts, ["sheet", "block"]).withColumn("inside", F.when(F.col("start") == 1, F.col("s1")).otherwise(F.col("s0")) == 1)
    return lines.withColumn("row", F.sum((~F.col("inside")).cast("long")).over(upto) + F.col("first")).select("sheet", "block", "at", "value", "inside", "row")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, row_index, cells) of CSV files: numbers are numbers, year-first dates are dates, empty fields are blank.

    `sheet` is the file. Files are read in the splits that Spark makes of them,
    and records are put together and numbered from 1 over the splits of their
    file, blank lines included. A quote opens a field at its begin only; a line
    break in a quoted field, of any kind, becomes a newline; a quoted field that
    never ends takes the rest of its file, less its last break. An empty file has
    no row.
    """
    import csv

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("sheet"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("value", F.when(F.col("block") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    lines = cut(_in_quotes(cut(lines)))
    # Only records of several lines are grouped.
    several = lines.where("inside").select("sheet", "row").distinct()
    one = lines.join(several, ["sheet", "row"], "left_anti").select("sheet", "row", F.col("value").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    joined = lines.join(several, ["sheet", "row"], "left_semi").groupBy("sheet", "row").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("text"))

    def typed(v: str):
        if v == "":
            return None
        if re.fullmatch(r"-?\d+", v):
            return ("int", None, float(v), None)
        if re.fullmatch(r"-?\d*\.\d+", v):
            return ("float", None, float(v), None)
        try:
            return ("date", None, None, datetime.date.fromisoformat(v)) if re.fullmatch(r"\d{4}-\d\d-\d\d", v) else ("string", v, None, None)
        except ValueError:
            return ("string", v, None, None)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            cells = [[typed(v) for v in next(csv.reader(io.StringIO(text, newline="")), [])] for text in batch.text]
            yield pd.DataFrame({"sheet": batch.sheet, "row_index": batch.row, "cells": cells})

    return one.unionByName(joined).mapInPandas(read, GRID)


def _xml_cell(value, style: int) -> str:
    if value is None:
        return f'<c s="{style}"/>'
    if isinstance(value, bool):
        return f'<c s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c s="{style}"><v>{value!r}</v></c>'
    # Texts are typed as texts, so one that starts like a formula stays one.
    return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def row_xml(values: Iterable, style: int) -> str:
    return "<row>" + "".join(_xml_cell(v, style) for v in values) + "</row>"


def write_workbook(path, sheets: dict[str, Iterable[tuple[list, int] | str]]) -> None:
    """Write sheets of (values, style) rows, or of rows that are XML already: style 0 plain, 1 head, 2 clean, 3 flagged. Rows are streamed, not gathered."""
    names = list(sheets)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, types = "http://schemas.openxmlformats.org/package/2006/relationships", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in ("1F3864", "E6F4EA", "FCE4E4"))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{types}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{types}.styles+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + f'<Relationship Id="rId{len(names) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellXfs count="4"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fillId="3" applyFill="1"/><xf fillId="4" applyFill="1"/></cellXfs></styleSheet>')
        for k, n in enumerate(names, 1):
            with book.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                for row in sheets[n]:
                    f.write((row if isinstance(row, str) else row_xml(*row)).encode())
                f.write(b"</sheetData></worksheet>")


def _summary_rows(results: DataFrame) -> list[tuple[list, int]]:
    from ..operators import report

    total = report.summary(results).first()
    counts = report.flag_counts(results).orderBy("flag").collect()  # one row for each kind of flag
    rate = "n/a" if total.match_rate is None else f"{int(total.match_rate * 100 + 0.5)}%"
    head = [(["Reconciliation Summary"], 1), ([], 0), *[([k, v], 0) for k, v in (("Total items", total.total), ("Matched clean", total.matched), ("Flagged", total.flagged), ("Match rate", rate))], ([], 0)]
    flags = [([f"  {report.FLAG_LABELS.get(r.flag, r.flag)}", r.n], 0) for r in counts]
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return [*head, *flags, ([], 0), (["Generated", now], 0), (["Note", report.NOTE], 0)]


def write_report(path: str, results: DataFrame, labels: bool = False) -> None:
    """The workbook with the sheets Summary and Detail, through the sink: tasks write the rows, the driver only the summary.

    With `labels` the status column shows the flags' labels instead of their names.
    """
    from ..operators import report
    from .sink import WorkbookSink

    spark = results.sparkSession
    spark.dataSource.register(WorkbookSink)
    columns = ["status", "invoice_number", "vendor", "invoice_date", "invoice_amount", "ledger_row", "ledger_date", "ledger_description", "ledger_amount", "source_file", "read_via"]
    rows = report.detail(results).orderBy("result_ord")
    if labels:
        rows = rows.withColumn("status", F.when(F.col("status") == "matched", F.col("status")).otherwise(F.col("label")))
    out = rows.select(*columns).write.format(WorkbookSink.name()).mode("overwrite")
    out.option("status", "status").option("titles", json.dumps(report.DETAIL_COLUMNS)).option("before", json.dumps([["Summary", _summary_rows(results)]])).save(path)


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind) of the files of a JSON manifest: those under `invoices`, and the one under `ledger`."""
    found = spark.read.schema("invoices array<string>, ledger string").json(path, multiLine=True)
    return found.select(F.explode("invoices").alias("name"), F.lit("invoice").alias("kind")).unionByName(found.where("ledger is not null").select(F.col("ledger").alias("name"), F.lit("ledger").alias("kind")))
