"""Invoice documents: folder scans with an injected text reader, plain texts, and file classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..operators.extract import staged_readings
from ..operators.lineage import cut, numbered


def file_kind(name: Column) -> Column:
    """pdf, spreadsheet or ignored, by the extension in any case."""
    return F.when(name.rlike(r"(?i)\.pdf$"), "pdf").when(name.rlike(r"(?i)\.(xlsx|xlsm|xls|csv)$"), "spreadsheet").otherwise("ignored")


class InputError(ValueError):
    """The files given aren't one ledger and at least one invoice."""


def check_inputs(files: DataFrame) -> None:
    """`files` has a column `name`; raises unless there is exactly one spreadsheet and a PDF at least."""
    counts = {r.kind: r for r in files.select(file_kind(F.col("name")).alias("kind"), "name").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("one")).collect()}
    sheets, pdfs = (counts[k].n if k in counts else 0 for k in ("spreadsheet", "pdf"))
    if sheets != 1 or not pdfs:
        ignored = f"; ignored {counts['ignored'].n} files such as {counts['ignored'].one}" if "ignored" in counts else ""
        raise InputError(f"one ledger and at least one invoice are needed, not {sheets} and {pdfs}{ignored}")
    if counts["spreadsheet"].one.lower().endswith(".xls"):
        raise InputError(f"{counts['spreadsheet'].one} is a workbook of the old binary format; save it as .xlsx or .csv")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text, method, inv_ord) of text files, one document each, in the order of their paths."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return _ordered(rows.select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), "text", F.lit("text").alias("method")))


def _ordered(rows: DataFrame) -> DataFrame:
    return numbered(rows, "path").withColumnRenamed("n", "inv_ord").drop("path")


Reader = Callable[[bytes], str | None]


def _reading(files: DataFrame, reader: Reader) -> DataFrame:
    """(path, source_file, text): what one reader finds; a file that it can't read has no text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch.path, batch.content, strict=True):
                try:
                    text = reader(bytes(data))
                except Exception:  # a damaged file reads as nothing
                    text = None
                out.append((path, path.rsplit("/", 1)[-1], text if (text or "").strip() else None))
            yield pd.DataFrame(out, columns=["path", "source_file", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, source_file string, text string")


def read_invoices(spark: SparkSession, folder: str, text_layer: Reader, ocr: Reader | Sequence[Reader] | None = None) -> DataFrame:
    """(source_file, text, method, inv_ord) of the PDFs of a folder.

    `text_layer` reads a file's first page. Only files where it finds nothing go
    through `ocr`, one reader or several in the order in which they are tried: a
    file goes on to the next only as long as no reading has given all four
    fields, and keeps the reading of most fields, the earliest of equal ones. A
    file that nobody can read stays, without a text and with the method `none`;
    no file can fail the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path", "content")
    layer = cut(_reading(files, text_layer))
    readers = [ocr] if callable(ocr) else list(ocr or [])
    blank = layer.where(F.col("text").isNull()).select("path")

    def tried(reader: Reader) -> Callable[[DataFrame], DataFrame]:
        return lambda open_: _reading(files.join(open_.select("path"), "path", "left_semi"), reader).drop("source_file")

    best = staged_readings(blank, [tried(r) for r in readers], "path") if readers else None
    found = layer.select("path", "source_file", F.col("text").alias("layer"))
    found = found.join(best.select("path", F.col("text").alias("read")), "path", "left") if best is not None else found.withColumn("read", F.lit(None).cast("string"))
    method = F.when(F.col("layer").isNotNull(), "text").when(F.col("read").isNotNull(), "ocr").otherwise("none")
    return _ordered(found.select("path", "source_file", F.coalesce("layer", "read").alias("text"), method.alias("method")))


Raster = Callable[[bytes], np.ndarray]
Recogniser = Callable[[np.ndarray, str], str | None]


def scan_readers(raster: Raster, recognise: Recogniser) -> list[Reader]:
    """Readers for `read_invoices`: the page as it is, then made ready, both as a `block` of text, then in `column`s.

    `raster` gives a file's first page as a grey image, `recognise` the text of
    an image. The untouched page goes first, for thin type suffers from the
    threshold; pages that lie askew or have specks need the second.
    """

    def ready(data: bytes) -> np.ndarray:
        return images.prepared(raster(data))

    return [lambda data: recognise(raster(data), "block"), lambda data: recognise(ready(data), "block"), lambda data: recognise(ready(data), "column")]


# Points within which fragments share a line, and beyond which a gap is a space.
LINE_HEIGHT, GAP = 2, 1


def page_text(fragments: DataFrame) -> DataFrame:
    """(source_file, text) of positioned fragments (source_file, x, end, y, str) of first pages.

    In the order of drawing (`ord`; without it from top to bottom), a fragment
    joins the first line whose first fragment is within 2 points of its height,
    or begins a line. Lines go from top to bottom, fragments from left to right
    with a space at gaps over 1 point unless one is there; lines are trimmed.
    Null and empty fragments count for nothing. A page is one row: its fragments
    are bounded by what is printed on it.
    """
    order = [F.col("ord")] if "ord" in fragments.columns else [-F.col("y"), F.col("x")]
    drawn = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], "x", "end", "y", "str")
    pages = fragments.groupBy("source_file").agg(F.array_sort(F.collect_list(F.when(F.col("str") != "", drawn))).alias("f"))
    near = lambda a, b: F.abs(a - b) <= LINE_HEIGHT
    heights = F.aggregate("f", F.array().cast("array<double>"), lambda acc, p: F.when(F.exists(acc, lambda h: near(h, p["y"])), acc).otherwise(F.concat(acc, F.array(p["y"].cast("double")))))
    pages = pages.withColumn("heights", heights)
    place = lambda p, i: F.struct(F.array_position(F.transform("heights", lambda h: near(h, p["y"])), True).alias("line"), p["x"].alias("x"), i.alias("i"), p["end"].alias("end"), p["str"].alias("str"))
    pages = pages.withColumn("placed", F.array_sort(F.transform("f", place)))
    lines = F.array_sort(F.transform("heights", lambda h, i: F.struct((-h).alias("y"), (i + 1).cast("long").alias("line"))))
    texts = F.transform(lines, lambda line: _joined(F.filter("placed", lambda p: p["line"] == line["line"])))
    return pages.select("source_file", F.array_join(texts, "\n").alias("text"))


def _joined(parts: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("double").alias("end"))

    def add(acc: Column, p: Column) -> Column:
        wide = F.coalesce(p["x"] - acc["end"] > GAP, F.lit(False)) & ~F.endswith(acc["out"], F.lit(" ")) & ~F.startswith(p["str"], F.lit(" "))
        return F.struct(F.concat(acc["out"], F.when(wide, " ").otherwise(""), p["str"]).alias("out"), p["end"].cast("double").alias("end"))

    return F.aggregate(parts, start, add, lambda acc: F.regexp_replace(acc["out"], r"(?U)^\s+|\s+$", ""))
