"""From sheets and day rows to findings, totals and states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import rows as R
from ..operators import rules, totals
from ..session import cut
from .model import codes


@dataclass
class Validated:
    """The results of validation, all lazy: typed rows, totals, weeks, findings and states, by doc_id."""

    sheets: DataFrame
    rows: DataFrame
    totals: DataFrame
    weeks: DataFrame
    findings: DataFrame
    states: DataFrame


def validate(sheets: DataFrame, rows: DataFrame, store: bool = True) -> Validated:
    """Validates flat sheets with their day rows. A page that isn't a sheet gets E06, and its rows' findings only if something is written there.

    Sheets and typed rows are stored once (unless ``store`` is False), as rules, totals, weeks and flags read them: parsing is
    dearer than a column-pruned scan."""
    spark = sheets.sparkSession
    typed = R.typed(rows)
    if store:
        sheets, typed = cut(sheets), cut(typed)
    month = totals.month_totals(typed)
    weeks = totals.week_totals(typed, sheets)
    found = rules.row_findings(typed).unionByName(rules.sheet_findings(sheets, month, weeks))
    if "avvisi" in sheets.columns:
        found = rules.with_reader_warnings(found, sheets, codes(spark))
    empty = sheets.where("not is_foglio_firma").join(typed.where(R.has_content()).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")
    found = found.join(empty, "doc_id", "left_anti").unionByName(rules.not_a_sheet(sheets))
    return Validated(sheets, typed, month, weeks, found, totals.states(found, totals.flag_counts(typed, sheets)))
