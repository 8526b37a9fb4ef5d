"""Lexicons of what may be written in a field, made from rules, and the lookup of a reading in them.

A lexicon is a table (lessico, chiave, valore). Keys are without white space and in upper case. In lexicons of
numbers, letters that are read for digits are digits on both sides, so that no key is listed under all its spellings.
A reading may have two stray signs on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .values import MONTHS, narrow

# Stray signs, letters read for digits, separators, roman numbers, and the notes' phrases with their spellings.
STRAY_BEFORE, STRAY_AFTER, MOST_STRAY = ".'`\"-", ".,'`\"-:;", 2
DIGIT_LETTERS = ("ILO", "110")
TIME_SEPARATORS = [":", ".", ",", ";", "'", "H", ""]
MONTH_SEPARATORS = ["/", "-", ".", ",", "|"]
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
SPELLINGS_104 = ["104", "L104", "L.104", "LEGGE 104", "PERMESSO 104", "PERM. 104"]
PHRASES = [
    "PONTE DI CARNEVALE", "PONTE CARNEVALE", "CARNEVALE", "PONTE", "FESTIVO", "FESTA", "SCIOPERO", "ASSEMBLEA SINDACALE", "ASSEMBLEA DI ISTITUTO",
    "ASSEMBLEA", "MALATTIA", "FERIE", "PERMESSO", "PERMESSO RETRIBUITO", "CHIUSURA SCUOLA", "SCUOLA CHIUSA", "USCITA DIDATTICA", "USCITA ANTICIPATA",
    "ENTRATA POSTICIPATA", "GITA SCOLASTICA", "GITA", "ELEZIONI", "VACANZE", "VACANZE NATALIZIE", "VACANZE DI NATALE", "VACANZE PASQUALI",
    "VACANZE DI PASQUA", "ALUNNO ASSENTE", "ALUNNA ASSENTE", "ASSENTE", "RECUPERO", "SOSTITUZIONE", "FORMAZIONE", "CORSO DI FORMAZIONE", "GLO", "GLHO",
    "INCONTRO GLO", "RIUNIONE GLO", "RIUNIONE", "CERTIFICATO MEDICO", "VISITA MEDICA", "COLLEGIO DOCENTI", "CONSIGLIO DI CLASSE", "SCRUTINI",
    "DISINFESTAZIONE", "ALLERTA METEO", "LUTTO", "SOSPENSIONE ATTIVITA DIDATTICA",
]
# End of fixed values.

NUMERIC = ["orari", "ore", "totale", "ore_pei", "date"]


def lexicon_key(c: Column) -> Column:
    """A writing without white space, in upper case."""
    return F.upper(F.regexp_replace(narrow(c), r"\s+", ""))


def _digits(c: Column) -> Column:
    return F.translate(c, *DIGIT_LETTERS)


def _keyed(name: str, df: DataFrame, text: Column, value: Column) -> DataFrame:
    """Rows of a lexicon; of several values for a key the first in ``rango`` stays."""
    key = lexicon_key(text)
    key = _digits(key) if name in NUMERIC else key
    rank = F.col("rango") if "rango" in df.columns else F.lit(0)
    return df.select(key.alias("chiave"), value.cast("string").alias("valore"), rank.alias("r")).groupBy("chiave").agg(F.min_by("valore", F.struct("r", "valore")).alias("valore")).select(F.lit(name).alias("lessico"), "chiave", "valore")


def _numbers(spark: SparkSession, first: int, last: int, step: int = 1) -> DataFrame:
    return spark.range(first, last + 1, step).select(F.col("id").cast("int").alias("n"))


def _each(*texts: Column) -> Column:
    return F.explode(F.array_compact(F.array(*texts)))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def times(spark: SparkSession) -> DataFrame:
    """06:00 to 20:00 in steps of five minutes: 8:00, 08.30, 800, 8h30, 8:30h, 8."""
    t = _numbers(spark, 360, 1200, 5).select(F.floor(F.col("n") / 60).cast("string").alias("h"), (F.col("n") % 60).alias("m"))
    value = F.concat(_two(F.col("h")), F.lit(":"), _two(F.col("m")))
    whole = F.when(F.col("m") == 0, F.col("h"))
    parts = t.select("h", "m", value.alias("v"), _each(F.col("h"), _two(F.col("h"))).alias("hh")).distinct()
    joined = parts.select("*", _each(*(F.lit(s) for s in TIME_SEPARATORS)).alias("sep")).select("*", _each(_two(F.col("m")), *(F.when((F.col("m") == 0) & (F.col("sep") != ""), F.lit(z)) for z in ("000", "0"))).alias("mm"))
    texts = joined.select("v", F.concat("hh", "sep", "mm").alias("t")).unionByName(parts.where(whole.isNotNull()).select("v", F.col("hh").alias("t")))
    return _keyed("orari", texts.select("v", _each(F.col("t"), F.concat("t", F.lit("H"))).alias("t")), F.col("t"), F.col("v"))


def _decimal_writings(quarters: Column, whole: Column) -> list[Column]:
    """3; 1,5 and 1.5; ,5 below one."""
    tail = F.when(quarters == 2, "5").when(quarters == 1, "25").when(quarters == 3, "75")
    return [F.when(tail.isNull(), whole), *(F.concat(whole, F.lit(s), tail) for s in ",."), F.when(whole == "0", F.concat(F.lit(","), tail))]


def day_hours(spark: SparkSession) -> DataFrame:
    """0 to 8 hours in quarters: 3, 3h, 2,5, 2h30', 2:30, 1h15'. Quarters have no decimal writing: readers see 2,25 in 2,5."""
    q = _numbers(spark, 0, 32).select((F.col("n") / 4).cast("decimal(9,2)").alias("v"), F.floor(F.col("n") / 4).cast("string").alias("w"), (F.col("n") % 4).alias("q"))
    m, w = (F.col("q") * 15).cast("string"), F.col("w")
    full = [F.when(F.col("q") == 0, F.concat(w, F.lit(s))) for s in ("", "H", ",0", ".0", ":00", "H00", "H00'")]
    half = [F.when(F.col("q") == 2, c) for c in (*_decimal_writings(F.col("q"), w), *(F.concat(w, F.lit(s)) for s in (",50", ".50", ",30", ".30", "½", "1/2", "1⁄2")), *(F.when(w == "0", s) for s in ("½", "1/2")))]
    parts = [F.when(F.col("q") > 0, F.concat(w, F.lit(a), m, F.lit(b))) for a, b in (("H", ""), ("H", "'"), (":", ""), (":", "'"), ("H", "MIN"), ("H", "M"))]
    alone = [F.when((F.col("q") > 0) & (w == "0"), F.concat(m, F.lit(s))) for s in ("'", "MIN")]
    return _keyed("ore", q.select("v", F.col("v").alias("rango"), _each(*full, *half, *parts, *alone).alias("t")), F.col("t"), F.col("v"))


def half_hours(spark: SparkSession, name: str, first: int, last: int, unit: bool = False) -> DataFrame:
    """Hours in halves from first / 2 to last / 2, with or without an h behind them."""
    n = _numbers(spark, first, last).select((F.col("n") / 2).cast("decimal(9,2)").alias("v"), F.floor(F.col("n") / 2).cast("string").alias("w"), (F.col("n") % 2 * 2).alias("q"))
    texts = n.select("v", _each(*_decimal_writings(F.col("q"), F.col("w"))).alias("t"))
    return _keyed(name, texts.select("v", _each(F.col("t"), *([F.concat("t", F.lit("H"))] if unit else [])).alias("t")), F.col("t"), F.col("v"))


def small_numbers(spark: SparkSession, name: str, most: int, roman: bool = False) -> DataFrame:
    """1 to ``most``, also as 01, and as Roman numbers up to ten."""
    romans = F.when(F.lit(roman) & (F.col("n") <= len(ROMAN)), F.get(F.array(*map(F.lit, ROMAN)), F.col("n") - 1))
    return _keyed(name, _numbers(spark, 1, most).select("n", _each(F.col("n").cast("string"), _two(F.col("n")), romans).alias("t")), F.col("t"), F.col("n"))


def months(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Months of these years: 02/2026, 2-26, febbraio 2026; the value is 2026-02. Some separators are read as two."""
    ym = _numbers(spark, first_year, last_year).withColumnRenamed("n", "y").select("y", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"))
    value = F.concat(F.col("y").cast("string"), F.lit("-"), _two(F.col("m")))
    pairs = [a + b for a in "/.,-" for b in "/.,-" if a != b]
    written = ym.select("y", "m", value.alias("v"), _each(F.col("m").cast("string"), _two(F.col("m"))).alias("mm")).select("*", _each(F.col("y").cast("string"), _two(F.col("y") % 100)).alias("yy"))
    texts = written.select("v", "mm", "yy", _each(*map(F.lit, [*MONTH_SEPARATORS, "1", *pairs])).alias("s")).select("v", F.concat("mm", "s", "yy").alias("t"))
    named = ym.select(value.alias("v"), F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), F.col("m")), F.col("y").cast("string")).alias("t"))
    return _keyed("mese_anno", texts.unionByName(named), F.col("t"), F.col("v"))


def dates(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Days of these years: 3/2/2026, 03.02.26; the value is dd/MM/yyyy."""
    d = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))).alias("d"))
    part = lambda c: (c.cast("string"), _two(c))
    texts = d.select("d", _each(*part(F.dayofmonth("d"))).alias("g")).select("*", _each(*part(F.month("d"))).alias("m")).select("*", _each(F.year("d").cast("string"), _two(F.year("d") % 100)).alias("y")).select("d", F.explode(F.array(F.concat_ws("/", "g", "m", "y"), F.concat_ws(".", "g", "m", "y"))).alias("t"))
    return _keyed("date", texts, F.col("t"), F.date_format("d", "dd/MM/yyyy"))


def notes(spark: SparkSession) -> DataFrame:
    """The notes' phrases; all spellings of the permit are 104."""
    rows = [(t, "104") for t in SPELLINGS_104] + [(p, p) for p in PHRASES]
    return _keyed("note", spark.createDataFrame(rows, "t string, v string"), F.col("t"), F.col("v"))


def lexicons(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """All lexicons in one table."""
    parts = [
        times(spark), day_hours(spark), half_hours(spark, "totale", 0, 600), half_hours(spark, "ore_pei", 2, 80, unit=True), small_numbers(spark, "lotto", 20),
        small_numbers(spark, "municipalita", 10, roman=True), months(spark, first_year, last_year), dates(spark, first_year, last_year), notes(spark),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def look_up(readings: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Readings (lessico, testo, …) with ``valore``: the lexicon's value of the text, tried without stray signs before it, then also
    without those behind it; null if neither is in it. The lexicon is a few thousand rows."""
    key = lexicon_key(F.col("testo"))
    key = F.when(F.col("lessico").isin(NUMERIC), _digits(key)).otherwise(key)
    some = lambda signs: "[" + "".join("\\" + s for s in signs) + "]"
    front = F.regexp_replace(key, rf"^{some(STRAY_BEFORE)}{{1,{MOST_STRAY}}}(?!{some(STRAY_BEFORE)})", "")
    back = F.regexp_replace(front, rf"(?<!{some(STRAY_AFTER)}){some(STRAY_AFTER)}{{1,{MOST_STRAY}}}$", "")
    keyed = readings.withColumn("fronte", front).withColumn("corpo", back)
    known = F.broadcast(lexicon)
    found = lambda name: known.select("lessico", F.col("chiave").alias(name), F.col("valore").alias(f"v_{name}"))
    joined = keyed.join(found("fronte"), ["lessico", "fronte"], "left").join(found("corpo"), ["lessico", "corpo"], "left")
    return joined.withColumn("valore", F.coalesce("v_fronte", "v_corpo")).drop("fronte", "corpo", "v_fronte", "v_corpo")
