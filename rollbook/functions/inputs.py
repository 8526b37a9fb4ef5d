"""What people and second readers type, as structs: a value, and what is wrong with it, instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import MAX_DAY_HOURS, MAX_MONTH_HOURS
from .values import BLANK, MONTHS, clean, clock, hour_signs, hours, hours_of_signs, minutes, plausible_hours, plausible_time, shown

# Words of a replacement, of an empty reading, and letters that second readers give for digits.
REPLACEMENT_YES, REPLACEMENT_NO = ["si", "sì", "s", "true", "x", "yes"], ["no", "n", "false"]
EMPTY_READING = r"(?i)^(empty|none|vuot[ao]|null|n/?a|markdown|[-–—_/\\|.,:;~\s]*)$"
READ_AS_DIGITS = ("OoDlI|;", "000111:")
MAX_TIME_TEXT = 20
# End of fixed values.

#: Beyond any field's hours: tells values out of range from what are no hours.
_ANY_HOURS = 100_000


def _struct(value: Column, error: Column, dash: Column | None = None) -> Column:
    return F.struct(value.alias("value"), error.alias("error"), *([dash.alias("dash")] if dash is not None else []))


def _short(c: Column) -> Column:
    return F.concat(F.lit("«"), F.left(c, F.lit(40)), F.lit("»"))


def typed_text(c: Column, most: int) -> Column:
    """A struct of value and error: white space collapsed; empty is null; longer than ``most`` is an error."""
    text = clean(c)
    long = F.length(text) > most
    return _struct(F.when(~long, text), F.when(long, F.lit(f"testo troppo lungo (massimo {most} caratteri)")))


def typed_hours(c: Column, most: int = MAX_DAY_HOURS) -> Column:
    """A struct of value, error and dash: hours of 0 to ``most``; blank and dashes are null, dashes being told."""
    empty = c.isNull() | c.rlike(BLANK)
    signs = hour_signs(c)
    value, any_value = hours_of_signs(signs, most), hours_of_signs(signs, _ANY_HOURS)
    beyond = F.concat(F.lit("valore fuori intervallo ("), _short(c), F.lit("), indicare un numero di ore tra 0 e "), shown(F.lit(most)))
    wrong = F.concat(F.lit("valore delle ore non valido ("), _short(c), F.lit(")"))
    error = F.when(~empty & value.isNull(), F.when(any_value.isNotNull(), beyond).otherwise(wrong))
    return _struct(F.when(~empty, F.round(value, 4)).cast("decimal(9,4)"), error, F.coalesce(empty & (F.trim(c) != ""), F.lit(False)))


def typed_time(c: Column) -> Column:
    """A struct of value, error and dash: HH:MM, or the text as it is where it is no time (a rule reports it); dashes are null and told."""
    text = F.trim(c)
    dash = F.coalesce((text != "") & text.rlike(BLANK), F.lit(False))
    long = F.coalesce(F.length(text) > MAX_TIME_TEXT, F.lit(False))
    value = F.when(~dash & ~long, F.nullif(F.coalesce(clock(minutes(text)), text), F.lit("")))
    return _struct(value, F.when(long & ~dash, F.concat(F.lit("orario non valido ("), _short(text), F.lit(")"))), dash)


def typed_month(c: Column) -> Column:
    """A struct of value and error: 1 to 12 from a number, an Italian name or its first three letters."""
    text = F.lower(F.trim(c))
    names = F.array(*map(F.lit, MONTHS))
    named = F.nullif(F.coalesce(F.nullif(F.array_position(names, text), F.lit(0)), F.array_position(F.transform(names, lambda m: F.left(m, F.lit(3))), text)), F.lit(0))
    number = F.coalesce(named.cast("int"), text.try_cast("double").try_cast("int"))
    good = number.between(1, 12)
    return _struct(F.when(good, number), F.when((text != "") & ~F.coalesce(good, F.lit(False)), F.concat(F.lit("mese non valido ("), _short(text), F.lit("), indicare un numero da 1 a 12"))))


def typed_year(c: Column) -> Column:
    """A struct of value and error: 2000 to 2100; 0 to 99 are of this century."""
    text = F.trim(c)
    number = text.try_cast("double").try_cast("int")
    full = F.when(number.between(0, 99), number + 2000).otherwise(number)
    good = F.coalesce(full.between(2000, 2100), F.lit(False))
    return _struct(F.when(good, full), F.when((text != "") & ~good, F.concat(F.lit("anno non valido ("), _short(text), F.lit(")"))))


def typed_replacement(c: Column) -> Column:
    """A struct of value (SI or NO) and error."""
    word = F.lower(F.trim(c))
    value = F.when(word.isin(REPLACEMENT_YES), "SI").when(word.isin(REPLACEMENT_NO), "NO")
    return _struct(value, F.when((word != "") & value.isNull(), F.lit("indicare SI o NO")))


def second_reading(kind: str, c: Column) -> Column:
    """A struct of stato and valore of a second reader's transcription: valore, vuota (nothing, a dash, a stroke) or illeggibile
    (something that is no value of this kind: orario, ore, numero, else text). Hours and numbers are texts with a point."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"```[a-zA-Z]*", " "), r"[$\n]", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[\s`\"']+|[\s`\"']+$", ""), r"\s+", " "))
    digits = F.translate(text, *READ_AS_DIGITS)
    if kind == "orario":
        signs = F.regexp_replace(digits, r"[^0-9:.,h]", "")
        short = F.length(F.regexp_replace(signs, r"\D", "")).between(1, 4)
        value = F.when(~digits.rlike("[A-Za-gi-z]") & short, clock(minutes(signs)))
    elif kind in ("ore", "numero"):
        read = hours(digits, MAX_DAY_HOURS if kind == "ore" else MAX_MONTH_HOURS)
        value = F.when(~digits.rlike("[A-Za-gi-z]"), F.replace(shown(F.round(read, 4)), F.lit(","), F.lit(".")))
    else:
        enough = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= 2
        return F.struct(F.when(text.rlike(EMPTY_READING) | ~enough, "vuota").otherwise("valore").alias("stato"), F.when(~text.rlike(EMPTY_READING) & enough, F.upper(text)).alias("valore"))
    state = F.when(text.rlike(EMPTY_READING), "vuota").when(value.isNotNull(), "valore").otherwise("illeggibile")
    return F.struct(state.alias("stato"), F.when(state == "valore", value).alias("valore"))


def plausible(kind: str, value: Column) -> Column:
    """Whether a second reading's value may stand on a school's sheet."""
    if kind == "orario":
        return F.coalesce(plausible_time(minutes(value)), F.lit(False))
    if kind == "ore":
        return F.coalesce(plausible_hours(value.try_cast("decimal(9,4)")), F.lit(False))
    return value.isNotNull()


def same_reading(kind: str, a: Column, b: Column) -> Column:
    """Whether two readings are one value: times by the minute, hours within a hundredth, texts by their letters and digits."""
    if kind == "orario":
        equal = minutes(a) == minutes(b)
    elif kind in ("ore", "numero"):
        equal = F.abs(a.try_cast("decimal(12,4)") - b.try_cast("decimal(12,4)")) < F.lit("0.01").cast("decimal(9,4)")
    else:
        letters = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
        equal = letters(a) == letters(b)
    return F.coalesce(equal, F.lit(False)) | (a.isNull() & b.isNull())
