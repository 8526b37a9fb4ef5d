"""Case tables of typed values and the calendar."""

import datetime

import pytest
from pyspark.sql import functions as F

from rollbook.functions import calendar, similarity
from rollbook.functions import values as V

TIMES = {
    "8:00": 480, "8.00": 480, "8,00": 480, "8;00": 480, "800": 480, "0800": 480, "8": 480, "8h": 480, "ore 8": 480, "8:00h": 480, " 8 : 00 ": 480, "o8:oo": 480, "8h30": 510, "8:3": 510,
    "l4:3O": 870, "alle 9": 540, "h 9.15": 555, "12:30:00": 750, "１２：３０": 750, "8 30": 510, "h8": 480, "8'30": 510, "24:00": None, "12:60": None, "": None, "abc": None, "99": None, "12345": None, None: None, "-": None,
    "08:00": 480, "8:0o": 480, "l1:00": 660, "I1:00": 660, "11:OO": 660, "14,30": 870, "1400": 840, "0:00": 0, "23:59": 1439, "8 00": 480, "8:00:00": 480, "8:00.": 480, "８:００": 480, "7:5": 470, "ore8": 480,
    "   ": None, "–": None, "25": None, "8:60": None, "2400": None, "8:00-11:00": None, "8 e 30": None, "x": None, "99:99": None, "8:00:0": None,
}
HOURS = {
    "1,5": 1.5, "1.5": 1.5, "3": 3, "3h": 3, "3 ore": 3, "2:30": 2.5, "2h30": 2.5, "1 e 30": 1.5, "1 e mezza": 1.5, "1½": 1.5, "½": 0.5, "mezz'ora": 0.5, "mezz’ora": 0.5, "30 min": 0.5, "1 ora e 30": 1.5, "2:30 min": 2.5,
    ",5": 0.5, "3.": 3, "l,5": 1.5, "90'": 1.5, "1 e un quarto": 1.25, "2 e tre quarti": 2.75, "24": 24, "25": None, "-1": None, "abc": None, "": None, "1 e 70": None, "2:75": None, "24,1": None, None: None,
    "3 ORE": 3, "1 ora e 30": 1.5, "1 ½": 1.5, "0,25": 0.25, "0": 0, "-": None, "1h30min": 1.5, "1 e ½": 1.5, "2 ore e mezza": 2.5, "mezza ora": 0.5, "¾": 0.75, "un quarto": 0.25, "ore 3": 3, "1 2": None, "3;": 3, "e": None, "h": None,
}


@pytest.mark.parametrize("table, parse", [(TIMES, V.minutes), (HOURS, V.hours)])
def test_case_tables(spark, table, parse):
    rows = [(k, None if v is None else float(v)) for k, v in table.items()]
    got = spark.createDataFrame(rows, "text string, want double").select("text", "want", parse(F.col("text")).cast("double").alias("got")).collect()
    assert [(r.text, r.got) for r in got if r.got != r.want] == []


def test_header_hours_and_staged_times(spark):
    d = spark.createDataFrame([("49,5", 744, 49.5), ("52", 744, 52.0), ("744", 744, 744.0), ("745", 744, None), ("61", 60, None)], "t string, most int, want double")
    assert [r.got for r in d.select(F.when(F.col("most") == 744, V.hours(F.col("t"), 744)).otherwise(V.hours(F.col("t"), 60)).cast("double").alias("got")).collect()] == [49.5, 52.0, 744.0, None, None]
    assert V.with_times(d.withColumn("x", F.lit("8:30")), {"m": "x"}).first().m == 510


def test_names(spark):
    d = spark.createDataFrame([("D'Angelo  Lucà",), ("Rossi, Mario",), ("mario ROSSI",), ("12",), (None,)], "a string")
    got = d.select(V.normal(F.col("a")).alias("n"), V.name_key(F.col("a")).alias("k"), V.enough_letters(F.col("a")).alias("e"), V.degenerate_name(F.col("a")).alias("g")).collect()
    assert [r.n for r in got] == ["D ANGELO LUCA", "ROSSI MARIO", "MARIO ROSSI", "12", ""] and got[1].k == got[2].k and [r.e for r in got] == [True, True, True, False, False]


def test_small_parsers(spark):
    one = spark.range(1).select(
        V.shown(F.lit(1.5)).alias("a"), V.shown(F.lit(10)).alias("b"), V.written_date(F.lit("Napoli, 3/2/26")).alias("c"), V.written_date(F.lit("30/2/2026")).alias("d"), V.month(F.lit("Febbraio")).alias("e"),
        V.year(F.lit("26")).alias("f"), V.year(F.lit("1999")).alias("g"), V.flag(F.lit("Sì")).alias("h"), V.flag(F.lit("forse")).alias("i"), V.school_year(F.lit(9), F.lit(2025)).alias("j"), V.clock(F.lit(485)).alias("k"),
        V.field_list(F.array(F.lit("note"), F.lit("x"), F.lit("firma"), F.lit("note")), ["firma", "note"]).alias("l"),
    ).first()
    assert (one.a, one.b, one.c, one.d, one.e, one.f, one.g) == ("1,5", "10", datetime.date(2026, 2, 3), None, 2, 2026, None)
    assert one.h.value and not one.h.error and one.i.error and (one.j, one.k, one.l) == ("2025/2026", "08:05", ["firma", "note"])


def test_admissible_windows(spark):
    d = spark.createDataFrame([(360,), (420,), (423,), (1085,), (1200,)], "m int").select(V.admissible_time(F.col("m")).alias("a"), V.plausible_time(F.col("m")).alias("p")).collect()
    assert [(r.a, r.p) for r in d] == [(True, False), (True, True), (False, False), (True, False), (True, False)]


def test_easter_and_weeks(spark):
    known = {1961: (4, 2), 2000: (4, 23), 2008: (3, 23), 2024: (3, 31), 2025: (4, 20), 2026: (4, 5), 2038: (4, 25)}
    got = {r.y: r.e for r in spark.createDataFrame([(y,) for y in known], "y int").select("y", calendar.easter(F.col("y")).alias("e")).collect()}
    assert got == {y: datetime.date(y, *md) for y, md in known.items()}
    days = calendar.days(spark, 2026, 2026).cache()
    assert [tuple(r) for r in days.where("mese = 2").select("dal", "al").distinct().orderBy("dal").collect()] == [(1, 1), (2, 8), (9, 15), (16, 22), (23, 28)]
    assert {(r.mese, r.giorno) for r in days.where("tipo = 'festivo'").collect()} == {(1, 1), (1, 6), (4, 5), (4, 6), (4, 25), (5, 1), (6, 2), (8, 15), (9, 19), (10, 4), (11, 1), (12, 8), (12, 25), (12, 26)}
    assert calendar.days(spark, 2025, 2025).where("mese = 10 and giorno = 4").first().tipo == "sabato"


def test_distances():
    assert similarity.distance("ROSSI", "R0SSI") == 0.5 and similarity.distance("ESPOSITO", "ESPOISTO") == 1 and similarity.distance("", "ABC") == 3
    assert similarity.inner_distance("ROSSI", "XXROSSIYY") == 0 and similarity.coverage(["ROSSI"], "MARIOROSSI") == 1
    assert similarity.likeness("MARIO ROSSI", "ROSSI MARIO")[:2] == (1.0, 1.0)
    assert similarity.likeness("ROSSI MARIO", "ROSSI MARIA")[2] and similarity.likeness("IC 9 VERDI", "IC 10 VERDI")[2:] == (True, False)
