"""The school calendar as a dimension, and expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed holidays (month, day, name, first year).
HOLIDAYS = [
    (1, 1, "Capodanno", 0), (1, 6, "Epifania", 0), (4, 25, "Festa della Liberazione", 0), (5, 1, "Festa del Lavoro", 0),
    (6, 2, "Festa della Repubblica", 0), (8, 15, "Ferragosto", 0), (9, 19, "San Gennaro, patrono di Napoli", 0), (10, 4, "San Francesco d'Assisi, patrono d'Italia", 2026),
    (11, 1, "Ognissanti", 0), (12, 8, "Immacolata Concezione", 0), (12, 25, "Natale", 0), (12, 26, "Santo Stefano", 0),
]
EASTER, EASTER_MONDAY = "Pasqua", "Lunedì dell'Angelo (Pasquetta)"
WEEKDAYS = ["lunedì", "martedì", "mercoledì", "giovedì", "venerdì", "sabato", "domenica"]
# End of fixed values.


def easter(y: Column) -> Column:
    """The date of Easter Sunday, by Gauss's rule with the corrections of the Gregorian calendar."""
    century = F.floor(y / 100)
    # the moon's age on 1 January runs in 19 years, corrected by leap centuries and the moon's own drift
    drift = (15 + century - F.floor(century / 4) - F.floor((8 * century + 13) / 25)) % 30
    golden = y % 19
    moon = (19 * golden + drift) % 30
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    # the weekday of the full moon, and days on to the next Sunday
    sunday = (2 * (y % 4) + 4 * (y % 7) + 6 * moon + (4 + century - F.floor(century / 4)) % 7) % 7
    return F.date_add(F.to_date(F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-03-22"))), (moon + sunday).cast("int"))


def day_date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null where there is none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def month_days(y: Column, m: Column) -> Column:
    return F.dayofmonth(F.last_day(day_date(y, m, F.lit(1))))


def week_of_month(y: Column, m: Column, d: Column) -> Column:
    """1 for the days to the month's first Sunday, and so on: weeks run Monday to Sunday, clipped to the month."""
    return (F.floor((d - 1 + F.weekday(day_date(y, m, F.lit(1)))) / 7) + 1).cast("int")


def week_bounds(y: Column, m: Column, week: Column) -> tuple[Column, Column]:
    """First and last day of a week of the month."""
    lead = F.weekday(day_date(y, m, F.lit(1)))
    return F.greatest(F.lit(1), (week - 1) * 7 - lead + 1).cast("int"), F.least(month_days(y, m), week * 7 - lead).cast("int")


def days(spark: SparkSession, first: int = 2000, last: int = 2100) -> DataFrame:
    """One row for each date: data, anno, mese, giorno, weekday (0 is Monday), tipo, festivita, settimana, dal, al."""
    dates = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{first}-01-01")), F.to_date(F.lit(f"{last}-12-31")))).alias("data"))
    dates = dates.select("data", F.year("data").alias("anno"), F.month("data").alias("mese"), F.dayofmonth("data").alias("giorno"), F.weekday("data").alias("weekday"))
    name = F.when(F.col("data") == easter(F.col("anno")), EASTER).when(F.col("data") == F.date_add(easter(F.col("anno")), 1), EASTER_MONDAY)
    for m, d, title, since in HOLIDAYS:
        name = name.when((F.col("mese") == m) & (F.col("giorno") == d) & (F.col("anno") >= since), title)
    named = dates.withColumn("festivita", name)
    kind = F.when(F.col("festivita").isNotNull(), "festivo").when(F.col("weekday") == 6, "domenica").when(F.col("weekday") == 5, "sabato").otherwise("feriale")
    week = week_of_month(F.col("anno"), F.col("mese"), F.col("giorno"))
    low, high = week_bounds(F.col("anno"), F.col("mese"), F.col("settimana"))
    return named.withColumn("tipo", kind).withColumn("settimana", week).withColumn("dal", low).withColumn("al", high)


def day_kind(y: Column, m: Column, d: Column) -> tuple[Column, Column]:
    """Kind and holiday name of a day, without a join: inesistente, festivo, domenica, sabato or feriale."""
    date = day_date(y, m, d)
    spring = m.between(3, 4)  # Easter isn't looked for in other months
    name = F.when(spring & (date == easter(y)), EASTER).when(spring & (date == F.date_add(easter(y), 1)), EASTER_MONDAY)
    for mm, dd, title, since in HOLIDAYS:
        name = name.when((m == mm) & (d == dd) & (y >= since), title)
    kind = F.when(date.isNull(), "inesistente").when(name.isNotNull(), "festivo").when(F.weekday(date) == 6, "domenica").when(F.weekday(date) == 5, "sabato").otherwise("feriale")
    return kind, F.when(date.isNotNull(), name)
