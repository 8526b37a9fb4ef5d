"""Totals of sheets: by month, by week, and the state that follows from the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import day_kind, week_bounds, week_of_month
from ..functions.messages import week_outcome
from ..plans.model import CODE, TOLERANCE
from .rows import names, pair_legible_written, pair_written

_SUM = "decimal(9,2)"


def _hours(c: Column) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0)), 2).cast(_SUM)


def month_totals(rows: DataFrame) -> DataFrame:
    """Per sheet of typed day rows: four hour sums, days with programmed and with recognised hours, absences."""
    sixty = lambda c: (F.col(c) / F.lit(60)).cast("decimal(13,8)")
    return rows.where("esiste").groupBy("doc_id").agg(
        _hours(sixty("min_prog")).alias("ore_programmate"), _hours(sixty("min_eff")).alias("ore_calcolate"),
        _hours(F.col("dich")).alias("ore_dichiarate"), _hours(F.col("ric")).alias("ore_riconosciute"),
        F.count_if(pair_legible_written("prog")).alias("giorni_programmati"), F.count_if(~F.col("assenza_operatore") & (F.col("ric") > 0)).alias("giorni_lavorati"),
        F.count_if("assenza_alunno").alias("assenze_alunno"), F.count_if("assenza_operatore").alias("assenze_operatore"),
    )


def week_totals(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per sheet with a valid period and week (Monday to Sunday within the month): hours, the week's share of the quota,
    and their difference. The school week has six days if anything is written on a Saturday of the sheet. Weeks
    without rows are there too. ``ore_pei_doc`` is the full weekly quota."""
    active = F.max(F.col("esiste") & (F.col("tipo") == "sabato") & ((F.col("ric") > 0) | pair_written("prog") | pair_written("eff")))
    by_week = rows.where("periodo_valido and esiste").groupBy("doc_id", "settimana").agg(_hours(F.col("ric")).alias("ore"), active.alias("sabato"))
    by_sheet = by_week.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("settimana", "ore"))).alias("ore"), F.max("sabato").alias("sabato"))
    quota = F.when(F.col("ore_pei") > 0, F.col("ore_pei"))
    heads = sheets.where(F.col("mese").between(1, 12) & F.col("anno").between(2000, 2100)).select("doc_id", "mese", "anno", quota.alias("ore_pei_doc"))
    last = F.dayofmonth(F.last_day(F.make_date("anno", "mese", F.lit(1))))
    joined = heads.join(by_sheet, "doc_id", "left").withColumn("settimana", F.explode(F.sequence(F.lit(1), week_of_month(F.col("anno"), F.col("mese"), last))))
    low, high = week_bounds(F.col("anno"), F.col("mese"), F.col("settimana"))
    bounded = joined.withColumn("dal", low).withColumn("al", high).withColumn("sei", F.coalesce("sabato", F.lit(False)))
    school = F.size(F.filter(F.sequence("dal", "al"), lambda d: (k := day_kind(F.col("anno"), F.col("mese"), d)[0]).isNotNull() & ((k == "feriale") | ((k == "sabato") & F.col("sei")))))
    share = F.round(F.col("ore_pei_doc") * school / F.when(F.col("sei"), 6).otherwise(5), 2).cast(_SUM)
    hours = F.coalesce(F.try_element_at("ore", F.col("settimana")), F.lit(0)).cast(_SUM)
    out = bounded.select("doc_id", "settimana", "dal", "al", hours.alias("ore"), share.alias("ore_pei"), "ore_pei_doc")
    return out.withColumn("differenza", (F.col("ore") - F.col("ore_pei")).cast(_SUM))


def flag_counts(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per sheet: uncertain fields that aren't illegible, and illegible ones, header and existing days together."""
    counted = lambda inc, ill: (F.size(F.array_except(inc, ill)).alias("i"), F.size(ill).alias("x"))
    own = sheets.select("doc_id", *counted(names("h_incerti"), names("h_illeggibili")))
    days = rows.where("esiste").select("doc_id", *counted(names("incerti"), names("illeggibili")))
    return own.unionByName(days).groupBy("doc_id").agg(F.sum("i").alias("campi_incerti"), F.sum("x").alias("campi_illeggibili"))


def states(findings: DataFrame, flags: DataFrame) -> DataFrame:
    """Per sheet: findings by severity, missing signatures, flag counts and the state: errori, da_verificare or ok."""
    counted = findings.groupBy("doc_id").agg(*(F.count_if(F.col("gravita") == s).alias(n) for s, n in (("errore", "n_errori"), ("attenzione", "n_attenzioni"), ("info", "n_info"))), F.count_if(F.col("codice") == CODE["W01"]).alias("firme_mancanti"))
    joined = flags.join(counted, "doc_id", "left").na.fill(0)
    state = F.when(F.col("n_errori") > 0, "errori").when(F.col("n_attenzioni") + F.col("campi_incerti") + F.col("campi_illeggibili") > 0, "da_verificare").otherwise("ok")
    return joined.withColumn("stato", state)


def difference(totals: DataFrame, sheets: DataFrame) -> DataFrame:
    """Totals with the declared monthly total and its difference from the sum of declared hours."""
    joined = totals.join(sheets.select("doc_id", "totale_mensile_dichiarato"), "doc_id")
    return joined.withColumn("differenza_totale", F.round(F.col("ore_dichiarate") - F.col("totale_mensile_dichiarato"), 2).cast(_SUM)).withColumn("totale_diverso", F.abs("differenza_totale") > TOLERANCE)


def week_block(weeks: DataFrame) -> DataFrame:
    """The weekly block of a sheet's report: weeks with their outcome against the full weekly quota, and the month's row (settimana null)."""
    own = weeks.select("doc_id", "settimana", "dal", "al", "ore", "ore_pei", "ore_pei_doc", "differenza", week_outcome(F.col("ore"), F.col("ore_pei_doc")).alias("esito"))
    none = lambda c: F.lit(None).cast(own.schema[c].dataType).alias(c)
    month = weeks.groupBy("doc_id").agg(F.sum("ore").alias("o"), F.sum("ore_pei").alias("q"))
    total = month.select("doc_id", none("settimana"), none("dal"), none("al"), F.col("o").cast(_SUM).alias("ore"), F.col("q").cast(_SUM).alias("ore_pei"), none("ore_pei_doc"), (F.col("o") - F.col("q")).cast(_SUM).alias("differenza"), none("esito"))
    return own.unionByName(total)
