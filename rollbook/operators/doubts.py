"""Why a chosen value should be looked at: reasons of single cells, and of rows that don't add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import admissible_hours, admissible_time, plausible_time
from ..plans.model import HOUR_FIELDS, TOLERANCE

# Probabilities that make a doubt, hours beyond which a day is odd, and doubts that coherence may overcome.
LEGIBLE, UNCERTAIN, RIVAL, ALTERNATIVE, LONG_DAY = 0.05, 0.7, 0.25, 0.02, 6
QUARTERS = [0, 15, 30, 45]
OVERCOME = ["dedotto", "bassa_prob", "colonna", "lettura_libera_anomala"]
# End of fixed values.
_TIMES = HOUR_FIELDS[:4]


def probability(options: Column, value: Column) -> Column:
    """What a cell's options (array of structs value, logprob) give a value; 0 if it isn't among them."""
    own = F.get(F.filter(options, lambda o: o["value"] == value), F.lit(0))["logprob"]
    return F.coalesce(F.exp(own), F.lit(0.0))


def cell_doubts(cells: DataFrame) -> DataFrame:
    """Cells with ``motivi``, the reasons for doubt in a fixed order, and ``superabile``: whether coherence may overcome all of them.

    cells: campo, value (minutes), p, options (best first), coverage, free_value, dominante (the column's usual value),
    gemello (the value of the other kind of time in the row), implicato (what effective times and hours imply) and
    minuti (the minute marks that are usual on the page; null: quarters).
    """
    value, free, twin = F.col("value"), F.col("free_value"), F.col("gemello")
    is_time = F.col("campo").isin(_TIMES)
    top = F.get("options", F.lit(0))["value"]
    other = F.get(F.filter("options", lambda o: o["value"] != value), F.lit(0))["logprob"]
    usual_minute = F.array_contains(F.coalesce("minuti", F.array(*map(F.lit, QUARTERS))), free % 60)
    usual = F.when(is_time, admissible_time(free) & usual_minute).otherwise(admissible_hours(free / F.lit(60)))
    reads_else = free != value
    reasons = [
        (F.col("coverage") < LEGIBLE, "dedotto"),
        (value != top, "alternativa"),
        (F.col("p") < UNCERTAIN, "bassa_prob"),
        (F.exp(other) >= RIVAL, "rivale"),
        ((F.col("dominante") != value) & (probability(F.col("options"), F.col("dominante")) >= ALTERNATIVE), "colonna"),
        (reads_else & usual, "lettura_libera"),
        (reads_else & ~usual, "lettura_libera_anomala"),
        (is_time & (twin != value) & (probability(F.col("options"), twin) >= ALTERNATIVE) & ~F.coalesce(F.col("implicato") == value, F.lit(False)), "gemello"),
    ]
    told = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in reasons)))
    out = cells.withColumn("motivi", told)
    return out.withColumn("superabile", F.size(F.array_except("motivi", F.array(*map(F.lit, OVERCOME)))) == 0)


def row_doubts(rows: DataFrame) -> DataFrame:
    """(doc_id, giorno, campo, motivo): cells of typed rows that don't fit their row: fuori_orario, incoerente or incompleto.

    Where hours and effective times disagree, one of the readings is wrong, and nothing says which: the whole row is told.
    """
    m = {f: F.col(f"min_{f}") for f in _TIMES}
    pe, pu, ee, eu = (m[f] for f in _TIMES)
    hours = F.col("ore_dichiarate")
    absent, away, dash = (F.coalesce(F.col(c), F.lit(False)) for c in ("assenza_alunno", "assenza_operatore", "trattino_effettivo"))
    least = F.lit(TOLERANCE).cast("decimal(9,4)")
    length = lambda a, b: F.when((b > a) & (b - a <= LONG_DAY * 60), (b - a) / F.lit(60))
    eff, prog = length(ee, eu), length(pe, pu)
    odd = lambda a, b: a.isNotNull() & b.isNotNull() & ((b <= a) | (b - a > LONG_DAY * 60))
    half = lambda a, b: a.isNull() != b.isNull()
    apart = (F.abs(eff - hours) > least) & ~(absent & (hours < eff))
    beyond_plan = eff.isNotNull() & hours.isNotNull() & ~F.coalesce(apart, F.lit(False)) & (eff > prog + least)
    off_plan = eff.isNull() & ~dash & ((hours > prog + least) | ((hours < prog - least) & ~absent & ~away))
    rules: list[tuple[Column, list[str], str]] = [(~plausible_time_bounds(m[f]), [f], "fuori_orario") for f in _TIMES]
    rules += [
        (hours > LONG_DAY, HOUR_FIELDS[4:], "fuori_orario"), (odd(ee, eu), HOUR_FIELDS[2:4], "incoerente"), (odd(pe, pu), HOUR_FIELDS[:2], "incoerente"), (apart, HOUR_FIELDS, "incoerente"),
        (beyond_plan, HOUR_FIELDS[:2], "incoerente"), (off_plan, [*HOUR_FIELDS[:2], HOUR_FIELDS[4]], "incoerente"),
        (half(ee, eu) & ~dash, HOUR_FIELDS[2:4], "incompleto"), (half(pe, pu), HOUR_FIELDS[:2], "incompleto"),
    ]
    there = m | {HOUR_FIELDS[4]: hours}
    told = [F.when(c & there[f].isNotNull(), F.struct(F.lit(f).alias("campo"), F.lit(reason).alias("motivo"))) for c, fields, reason in rules for f in fields]
    return rows.select("doc_id", "giorno", F.explode(F.array_distinct(F.array_compact(F.array(*told)))).alias("x")).select("doc_id", "giorno", "x.*")


def plausible_time_bounds(minute: Column) -> Column:
    """07:00 to 18:00, whatever the minute mark."""
    return plausible_time(minute - minute % 5) & (minute <= 1080)


def weekly_support(cells: DataFrame) -> DataFrame:
    """(doc_id, giorno, campo): programmed times that two sure cells of the same weekday share and no other contradicts.
    cells: doc_id, giorno, campo, value, sure."""
    known = cells.where(F.col("campo").startswith("prog_") & F.col("value").isNotNull()).withColumn("w", F.col("giorno") % 7)
    group = known.groupBy("doc_id", "campo", "w").agg(F.count_if("sure").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    joined = known.join(group.where("lo = hi"), ["doc_id", "campo", "w"])
    return joined.where(F.col("n") - F.col("sure").cast("int") >= 2).select("doc_id", "giorno", "campo")


def clear_but_dropped(cells: DataFrame, clear: float = 0.8) -> DataFrame:
    """(doc_id, giorno): rows in which the reconciliation dropped a clear reading; all their cells are in doubt."""
    top = F.get("options", F.lit(0))
    return cells.where((top["value"] != F.col("value")) & (F.exp(top["logprob"]) * F.col("coverage") >= clear)).select("doc_id", "giorno").distinct()

