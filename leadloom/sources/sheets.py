"""Rows of a landed spreadsheet: the header found by its label, columns by their names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions import text as X


class LayoutChanged(ValueError):
    """The sheet has no header row, or lacks a column."""


def header(sheet: DataFrame, mark: str, within: int = 20) -> tuple[int, list[str | None]]:
    """Number and cells of the first row, of those numbered below ``within``, that has a cell containing ``mark``.

    Rows are told apart by ``row``, not by the order in which they are read.
    """
    found = sheet.where((F.col("row") < within) & F.exists("cells", lambda c: F.contains(c, F.lit(mark)))).agg(F.min(F.struct("row", "cells")).alias("h")).first()["h"]
    if found is None:
        raise LayoutChanged(f"no cell of the first {within} rows contains {mark!r}")
    return found["row"], list(found["cells"])


def read_sheet(sheet: DataFrame, columns: Mapping[str, str], mark: str, within: int = 20) -> DataFrame:
    """row and one text column for each of ``columns`` (name -> label in the header) of the rows below the header.

    ``sheet`` has row (from 0) and cells.  Of two columns with one label the last counts;
    cells are trimmed, missing ones are empty.
    """
    at, names = header(sheet, mark, within)
    place = {name: i for i, name in enumerate(names) if name is not None}
    missing = [label for label in columns.values() if label not in place]
    if missing:
        raise LayoutChanged(f"columns missing: {missing}")
    cell = lambda label: F.trim(F.coalesce(F.get("cells", place[label]), F.lit("")))
    return sheet.where(F.col("row") > at).select("row", *[cell(label).alias(name) for name, label in columns.items()])


#: The labels of the sheet of subsidised projects.
SUBSIDIES = {
    "ico": "IČ příjemce", "signed": "Datum podepsání právního aktu", "project": "Název projektu", "description": "Popis projektu",
    "state": "Stav projektu", "total_czk": "Celkové náklady na operaci (CZK)", "programme": "Název programu",
}


def subsidies(sheet: DataFrame) -> DataFrame:
    """Typed rows of the sheet of subsidised projects; rows without a company go."""
    rows = read_sheet(sheet, SUBSIDIES, SUBSIDIES["ico"])
    typed = rows.withColumn("ico", X.company_key("ico")).withColumn("signed", X.serial_day("signed")).withColumn("total_czk", F.col("total_czk").try_cast("double"))
    return typed.where("ico is not null").drop("row")
