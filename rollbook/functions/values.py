"""Typed values from untidy text, as Column expressions that stay inside generated code.

Times and hours are read in two steps. A writing is first brought to a canonical form of digits and a few signs,
in which words, units, blanks and characters taken for digits are settled; then its runs of digits and the signs
between them decide. ``with_times`` puts the two steps into projections of their own, so that nothing is done twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import MAX_DAY_HOURS

# Characters that readers take for digits, and blanks.
LOOKALIKES = ("oli|!", "01111")
BLANK = r"^[\s\-–—−_/.]*$"
# End of fixed values.

_WIDE, _NARROW = "０１２３４５６７８９：．，； 　", "0123456789:.,;  "


def narrow(c: Column) -> Column:
    """Full-width digits and signs as plain ones."""
    return F.translate(c, _WIDE, _NARROW)


def blank(c: Column) -> Column:
    """Null, or only spaces and dashes."""
    return c.isNull() | c.rlike(BLANK)


def clean(c: Column, most: int | None = None) -> Column:
    """White space collapsed and trimmed; null if nothing is left; at most ``most`` characters."""
    text = F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.left(text, F.lit(most)) if most else text


def _word(*words: str) -> str:
    """A pattern of these words, not as a part of others; digits may touch them."""
    return rf"(?<!\p{{L}})(?:{'|'.join(words)})(?!\p{{L}})"


def _rewrite(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, *step), steps, c)


def time_signs(c: Column) -> Column:
    """The canonical form of a written time: its runs of digits, with a colon for whatever separates them."""
    spoken = F.regexp_replace(F.lower(narrow(c)), _word("ore", "alle"), " ")
    return _rewrite(F.translate(spoken, *LOOKALIKES), [(r"[\s.,;:'’`´h]+", ":"), (r"^:|:$", "")])


def time_of_signs(signs: Column) -> Column:
    """Minutes of the day from a canonical form: 8, 800, 0800, 8:30, 8:3 (a tens digit), 8:30:00; null if it is no time.

    Every step uses the one before it once, so that the expression stays small wherever a filter copies it.
    """
    hour, minute = r"[01]?\d|2[0-3]", r"[0-5]\d"
    even = _rewrite(signs, [(r"^(\d{1,2})$", "$1:00"), (r"^(\d{1,2})(\d\d)$", "$1:$2"), (r"^(\d{1,2}:\d)$", "$10"), (rf"^({hour}):({minute})(?::\d\d)?$", "=$1$2")])
    number = F.regexp_extract(even, r"^=(\d+)$", 1).try_cast("int")  # hhmm
    return (number - 40 * F.floor(number / 100)).cast("int")


def minutes(c: Column) -> Column:
    """A written time as minutes of the day, or null: 8:00, 8.00, 800, 0800, 8, 8h30, ore 8, with letters taken for digits."""
    return time_of_signs(time_signs(c))


def with_times(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``df`` with minutes of the day of written times: new column to written column."""
    signs = df.withColumns({name: time_signs(F.col(c)) for name, c in fields.items()})
    return signs.withColumns({name: time_of_signs(F.col(name)) for name in fields})


def clock(m: Column) -> Column:
    """Minutes of the day as HH:MM."""
    return F.when(m.isNotNull(), F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int")))


def span(start: Column, end: Column) -> Column:
    """Minutes between two times of one day; null unless positive."""
    return F.when(end > start, end - start)


_DEC = "decimal(20,8)"
#: How words and signs of hours are written in the canonical form: h for hours, m for minutes, + for "and", q for quarters.
_HOUR_SIGNS = [
    (r"[’`´]", "'"),
    (rf"{_word('mezz')}'\s*ora(?!\p{{L}})|{_word('mezzora')}|{_word('mezza')}\s+ora(?!\p{{L}})|½|{_word('mezz[ao]')}", "2q"),
    (rf"¼|{_word('un')}\s+quarto(?!\p{{L}})", "1q"),
    (rf"¾|{_word('tre')}\s+quarti(?!\p{{L}})", "3q"),
    (r"(?<=\d)\s*m$", ""),
    (rf"{_word('ore', 'ora', 'hrs', 'hr', 'hh', 'h')}", "h"),
    (rf"{_word('minuti', 'minuto', 'min')}|(?<=\d)\s*'", "m"),
    (_word("e"), "+"),
]


def hour_signs(c: Column) -> Column:
    """The canonical form of written hours: numbers with a point, and the signs h, m, + : and q (quarters of an hour before it)."""
    # a fraction sign after a digit is another number
    apart = F.regexp_replace(F.lower(F.trim(narrow(c))), "([½¼¾])", " $1")
    settled = F.translate(_rewrite(apart, _HOUR_SIGNS), *LOOKALIKES)
    return _rewrite(F.translate(settled, ",", "."), [(r"\s*([hm+:])\s*", "$1"), (r"^[\s;:h]+|[\s;:.]+$", ""), (r"(?<=\d)h?[+\s]*(?=\dq)", " ")])


def hours_of_signs(signs: Column, most: int = MAX_DAY_HOURS) -> Column:
    """Hours from a canonical form, null beyond 0..most: 1.5 or 3h; 2:30, 2h30, 1+30 or 1h+30; 30m; 2q or 1 2q."""
    number = F.nullif(F.regexp_extract(signs, r"^(\d*\.?\d*)", 1), F.lit(""))
    whole = F.coalesce(F.concat(F.lit("0"), number).try_cast(_DEC), F.lit(0).cast(_DEC))
    tail = F.regexp_extract(signs, r"(\d+)m?$", 1).try_cast("int")
    quarters = F.regexp_extract(signs, r"(\d)q", 1).try_cast("int")
    sixtieths = (tail / F.lit(60)).cast(_DEC)
    value = (
        F.when(signs.rlike(r"^(\d{1,3}(\.\d*)?|\.\d+)h?$"), whole)
        .when(signs.rlike(r"^\d{1,2}([:h]\d\d|h?\+\d{1,2})m?$") & (tail <= 59), whole + sixtieths)
        .when(signs.rlike(r"^\d{1,4}m$"), sixtieths)
        .when(signs.rlike(r"^\dq h?$|^\dqh?$"), (quarters / F.lit(4)).cast(_DEC))
        .when(signs.rlike(r"^\d{1,2} \dqh?$"), whole + (quarters / F.lit(4)).cast(_DEC))
    )
    return F.when(value <= most, value)


def hours(c: Column, most: int = MAX_DAY_HOURS) -> Column:
    """Written hours as a decimal, or null if absent or beyond 0..most: 1,5, 3h, 2:30, 2h30, 1 e 30, 1 e mezza, 1½, mezz'ora, 30 min."""
    return hours_of_signs(hour_signs(c), most)


def shown(h: Column) -> Column:
    """Hours with a decimal comma and without needless zeros."""
    text = F.regexp_replace(F.round(h, 2).cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
    return F.when(h.isNotNull(), F.replace(text, F.lit("."), F.lit(",")))


# Accented Latin letters and their plain ones: generated from the Unicode decompositions.
def _plain_letters() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(k), d[0]) for k in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(k))) >= 2 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _UNACCENTED = _plain_letters()


def normal(c: Column) -> Column:
    """Upper case without accents or punctuation, single spaces."""
    letters = F.regexp_replace(F.translate(narrow(c), _ACCENTED, _UNACCENTED), r"\p{M}", "")
    return F.coalesce(F.trim(F.regexp_replace(F.upper(F.regexp_replace(letters, r"[^\p{L}\p{N}]", " ")), r"\s+", " ")), F.lit(""))


def name_key(c: Column) -> Column:
    """The words of a name in order, so that their written order doesn't matter."""
    return F.array_join(F.array_sort(F.split(normal(c), " ")), " ")


def enough_letters(c: Column) -> Column:
    """At least two letters."""
    return F.length(F.regexp_replace(normal(c), r"[^\p{L}]", "")) >= 2


# Month names and the words for yes and no.
MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]
YES, NO = ["1", "true", "si", "sì", "yes", "x", "vero", "on"], ["0", "false", "no", "falso", "off", ""]
# End of fixed values.


def month(c: Column) -> Column:
    """1..12 from a number, an Italian month name or its first three letters."""
    text = F.lower(F.trim(c))
    named = reduce(lambda w, km: w.when(text.isin(km[1], km[1][:3], km[1][:3] + "."), km[0]), list(enumerate(MONTHS, 1))[1:], F.when(text.isin("gennaio", "gen", "gen."), 1))
    number = F.regexp_extract(text, r"^0*(\d{1,2})$", 1).try_cast("int")
    return F.coalesce(F.when(number.between(1, 12), number), named)


def year(c: Column) -> Column:
    """2000..2100; two digits are of this century."""
    number = F.trim(c).try_cast("int")
    full = F.when(F.length(F.trim(c)) <= 2, number + 2000).otherwise(number)
    return F.when(full.between(2000, 2100), full)


def flag(c: Column) -> Column:
    """A struct of value and error from words for yes and no; null is no."""
    text = F.lower(F.trim(c.cast("string")))
    return F.struct(F.coalesce(text.isin(YES), F.lit(False)).alias("value"), (~F.coalesce(text.isin(YES + NO), F.lit(True))).alias("error"))


def field_list(c: Column, allowed: list[str]) -> Column:
    """Distinct allowed names, in the order of the allowed ones."""
    return F.array_intersect(F.array(*map(F.lit, allowed)), F.coalesce(c, F.array().cast("array<string>")))


def written_date(c: Column) -> Column:
    """dd/mm/yyyy at the end of a text, within 2000..2100, else null."""
    p = r"(\d{1,2})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*(\d{4}|\d{2})\s*$"
    y = F.regexp_replace(F.regexp_extract(c, p, 3), r"^(\d{2})$", "20$1")
    date = F.try_to_date(F.concat_ws("-", y, F.lpad(F.regexp_extract(c, p, 2), 2, "0"), F.lpad(F.regexp_extract(c, p, 1), 2, "0")), "yyyy-MM-dd")
    return F.when(F.year(date).between(2000, 2100), date)


def school_year(month_: Column, year_: Column) -> Column:
    """The school year of a month; it begins in September."""
    first = F.when(month_ >= 9, year_).otherwise(year_ - 1)
    return F.concat(first.cast("string"), F.lit("/"), (first + 1).cast("string"))


def admissible_time(m: Column) -> Column:
    """06:00..20:00 in steps of five minutes: what the first reader may read."""
    return m.between(360, 1200) & (m % 5 == 0)


def admissible_hours(h: Column) -> Column:
    """0..8 in quarters."""
    return h.between(0, 8) & ((h * 4) % 1 == 0)


def plausible_time(m: Column) -> Column:
    """07:00..18:00 in steps of five minutes: what a second reader may confirm."""
    return m.between(420, 1080) & (m % 5 == 0)


def plausible_hours(h: Column) -> Column:
    """Above 0, to 10, in quarters."""
    return (h > 0) & (h <= 10) & ((h * 4) % 1 == 0)


def degenerate_name(c: Column) -> Column:
    """A reading in a loop: up to three characters four times on end, or four words or more of which most are single letters."""
    text = F.upper(F.trim(F.regexp_replace(narrow(c), r"\s+", " ")))
    words = F.split(text, " ")
    single = F.size(F.filter(words, lambda w: F.length(F.regexp_replace(w, "[^A-ZÀÈÉÌÒÙ0-9]", "")) <= 1))
    return F.coalesce(F.replace(text, F.lit(" "), F.lit("")).rlike(r"(.{1,3}?)\1{3,}") | ((F.size(words) >= 4) & (single * 2 > F.size(words))), F.lit(False))
