"""Day rows: exploding sheets, typing their values, and measures of a row.

A sheet's 31 rows leave ``explode`` in one partition, so sums by sheet combine before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import day_kind, month_days, week_of_month
from ..functions.values import blank, span, with_times
from ..plans.model import DAY_FIELDS, HEADER_FIELDS, MAX_DAY_HOURS

_NO_NAMES = "array<string>"


def names(c: str) -> Column:
    """A list of field names without repeats; null is empty."""
    return F.array_distinct(F.coalesce(F.col(c), F.array().cast(_NO_NAMES)))


def flat(sheets: DataFrame) -> DataFrame:
    """One row per sheet with the header's fields as columns (its lists as h_incerti and h_illeggibili)."""
    return sheets.select(
        F.col("id").alias("doc_id"), *(c for c in sheets.columns if c not in ("id", "header", "rows")),
        *(f"header.{f}" for f in HEADER_FIELDS), F.col("header.incerti").alias("h_incerti"), F.col("header.illeggibili").alias("h_illeggibili"),
    )


def day_rows(sheets: DataFrame) -> DataFrame:
    """Days 1..31 of every sheet: the last row given for a day, an empty one where none is given; rows of other days stay."""
    days = F.array(*(F.lit(g) for g in range(1, 32)))
    given = F.coalesce(F.col("rows"), F.array().cast(sheets.schema["rows"].dataType))
    fixed = F.transform(days, lambda g: F.struct(g.alias("giorno"), F.element_at(F.concat(F.array(F.lit(None).cast(sheets.schema["rows"].dataType.elementType)), F.filter(given, lambda r: r["giorno"] == g)), -1).alias("r")))
    odd = F.transform(F.filter(given, lambda r: ~F.coalesce(r["giorno"].between(1, 31), F.lit(False))), lambda r: F.struct(r["giorno"].alias("giorno"), r.alias("r")))
    one = sheets.select(F.col("id").alias("doc_id"), "header.mese", "header.anno", F.explode(F.concat(fixed, odd)).alias("x"))
    false = lambda f: F.coalesce(F.col(f"x.r.{f}"), F.lit(False)).alias(f)
    return one.select(
        "doc_id", "mese", "anno", "x.giorno", *(f"x.r.{f}" for f in DAY_FIELDS[:5]), *(false(f) for f in DAY_FIELDS[5:8]), "x.r.note", false("trattino_effettivo"),
        F.coalesce("x.r.incerti", F.array().cast(_NO_NAMES)).alias("incerti"), F.coalesce("x.r.illeggibili", F.array().cast(_NO_NAMES)).alias("illeggibili"),
    )


def has_content() -> Column:
    """Something is written in the row."""
    written = [F.coalesce(F.col(f) != "", F.lit(False)) for f in DAY_FIELDS[:4]]
    rest = [F.col("ore_dichiarate").isNotNull(), *map(F.col, DAY_FIELDS[5:8]), F.coalesce(F.trim("note") != "", F.lit(False)), F.col("trattino_effettivo"), F.size("illeggibili") > 0]
    out = written[0]
    for w in [*written[1:], *rest]:
        out = out | w
    return out


def valid_period(mese: Column, anno: Column) -> Column:
    return F.coalesce(mese.between(1, 12) & anno.between(2000, 2100), F.lit(False))


def typed(rows: DataFrame) -> DataFrame:
    """Day rows with minutes, spans, hours and the calendar's view of the day.

    periodo_valido, n_giorni (31 without a period), esiste; min_* of the four times; min_prog and min_eff;
    dich: declared hours within 0..24; ric: recognised hours (0 if the operator is absent, else declared, else
    computed, else 0); tipo, festivita and settimana of the day.
    """
    ok = valid_period(F.col("mese"), F.col("anno"))
    out = with_times(rows.withColumn("periodo_valido", ok), {f"min_{f}": f for f in DAY_FIELDS[:4]})
    out = out.withColumns({
        "n_giorni": F.when(F.col("periodo_valido"), month_days(F.col("anno"), F.col("mese"))).otherwise(31),
        "min_prog": span(F.col("min_prog_entrata"), F.col("min_prog_uscita")), "min_eff": span(F.col("min_eff_entrata"), F.col("min_eff_uscita")),
        "dich": F.when(F.col("ore_dichiarate").between(0, MAX_DAY_HOURS), F.col("ore_dichiarate").cast("decimal(9,4)")),
    })
    kind, name = day_kind(F.col("anno"), F.col("mese"), F.col("giorno"))
    return out.withColumns({
        "esiste": F.col("giorno").between(1, F.col("n_giorni")),
        "ric": F.when(F.col("assenza_operatore"), F.lit(0)).otherwise(F.coalesce("dich", F.col("min_eff") / F.lit(60), F.lit(0))).cast("decimal(13,8)"),
        "tipo": F.when(F.col("periodo_valido"), kind), "festivita": F.when(F.col("periodo_valido"), name),
        "settimana": F.when(F.col("periodo_valido"), week_of_month(F.col("anno"), F.col("mese"), F.col("giorno"))),
    })


def pair_written(prefix: str) -> Column:
    """One of the two times is written, or illegible."""
    return pair_legible_written(prefix) | F.arrays_overlap("illeggibili", F.array(F.lit(f"{prefix}_entrata"), F.lit(f"{prefix}_uscita")))


def pair_legible_written(prefix: str) -> Column:
    return ~blank(F.col(f"{prefix}_entrata")) | ~blank(F.col(f"{prefix}_uscita"))


def spreadsheet_measures(rows: DataFrame) -> DataFrame:
    """Row measures as the workbook's formulas have them: any declared value counts, and nothing stays empty.

    x_prog, x_calc, x_dich, x_ric (0 if the operator is absent), x_diff. Differs from ``ric`` on purpose.
    """
    as_hours = lambda c: (F.col(c) / F.lit(60)).cast("decimal(13,8)")
    out = rows.withColumns({"x_prog": as_hours("min_prog"), "x_calc": as_hours("min_eff"), "x_dich": F.col("ore_dichiarate").cast("decimal(13,8)")})
    return out.withColumns({"x_ric": F.when(F.col("assenza_operatore"), F.lit(0).cast("decimal(13,8)")).otherwise(F.coalesce("x_dich", "x_calc")), "x_diff": F.col("x_dich") - F.col("x_calc")})
