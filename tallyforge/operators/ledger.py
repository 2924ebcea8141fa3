"""Ledger rows from a sheet's cells: column layout detection and projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


@dataclass(frozen=True)
class Profile:
    name: str
    date: tuple[str, ...]
    description: tuple[str, ...]
    amount: tuple[str, ...] = ()
    debit: tuple[str, ...] = ()
    credit: tuple[str, ...] = ()
    reference: tuple[str, ...] = ()


# The header names of known exports, in the order in which they are tried.
PROFILES = (
    Profile("Xero", ("date",), ("description",), debit=("debit",), credit=("credit",), reference=("reference",)),
    Profile("Wave", ("date",), ("description",), amount=("amount",)),
    Profile("FreshBooks", ("date",), ("vendor", "category"), amount=("amount",)),
    Profile("QuickBooks", ("date",), ("memo/description", "memo", "description", "name"), amount=("amount",), reference=("num",)),
    Profile("Generic", ("date",), ("description",), amount=("amount",), reference=("reference",)),
)
FIELDS = ("date", "description", "amount", "debit", "credit", "reference")


class UnknownLayout(ValueError):
    """No profile fits the header."""


def detect(headers: list[str], profiles: tuple[Profile, ...] = PROFILES) -> tuple[Profile, dict[str, int]] | None:
    """The profile that finds most columns, the first of equal ones, and where they are."""
    names = [(h or "").strip().lower() for h in headers]
    found = []
    for p in profiles:
        at = {f: next((names.index(a) for a in getattr(p, f) if a in names), None) for f in FIELDS}
        at = {f: k for f, k in at.items() if k is not None}
        split = bool(p.debit or p.credit)
        if {"date", "description"} <= at.keys() and (split and at.keys() & {"debit", "credit"} or not split and "amount" in at):
            found.append((p, at))
    return max(found, key=lambda x: len(x[1]), default=None)


def _falsy(cell: Column) -> Column:
    return cell.isNull() | cell["kind"].isNull() | ((cell["kind"] == "string") & (F.coalesce(cell["str"], F.lit("")) == "")) | (cell["kind"].isin("int", "float", "bool") & (cell["num"] == 0))


def _shown(cell: Column) -> Column:
    """A cell's text; whole numbers of an integer cell without a point."""
    return F.when(cell["kind"] == "string", cell["str"]).when(cell["kind"] == "int", cell["num"].cast("long").cast("string")).when(cell["kind"] == "float", cell["num"].cast("string")).when(
        cell["kind"] == "date", cell["dt"].cast("string")
    ).when(cell["kind"] == "bool", F.when(cell["num"] != 0, "True").otherwise("False"))


def _number(cell: Column) -> Column:
    """Numbers only: neither texts nor truth values nor infinities are amounts."""
    return F.when(cell["kind"].isin("int", "float") & ~F.isnan(cell["num"]) & (F.abs(cell["num"]) < float("inf")), cell["num"])


def ledger_rows(grid: DataFrame, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
    """(row_index, ledger_date, description, reference, amount) of a grid (row_index, cells), whose row 1 is the header.

    Blank rows are left out; the others keep the number they have in the sheet.
    """
    top = grid.where("row_index = 1").select(F.transform("cells", lambda c: F.when(~_falsy(c), _shown(c))).alias("h")).first()
    headers = list(top.h) if top else []
    layout = detect(headers, profiles)
    if layout is None:
        raise UnknownLayout(f"No known layout has these columns: {', '.join(h.strip() for h in headers if h)}")
    _, at = layout
    cell = lambda f: F.get("cells", F.lit(at[f]))
    value = lambda f: _number(cell(f)) if f in at else F.lit(None).cast("double")
    amount = value("amount") if "amount" in at else F.when(value("debit").isNotNull() & (value("debit") != 0), value("debit")).otherwise(value("credit"))
    reference = F.when(~_falsy(cell("reference")), strip(_shown(cell("reference")))) if "reference" in at else F.lit(None).cast("string")
    body = grid.where((F.col("row_index") > 1) & F.exists("cells", lambda c: c.isNotNull() & c["kind"].isNotNull()))
    return body.select(
        F.col("row_index").cast("int").alias("row_index"),
        F.when(cell("date")["kind"] == "date", cell("date")["dt"]).alias("ledger_date"),
        F.when(_falsy(cell("description")), F.lit("")).otherwise(strip(_shown(cell("description")))).alias("description"),
        reference.alias("reference"),
        amount.alias("amount"),
    )
