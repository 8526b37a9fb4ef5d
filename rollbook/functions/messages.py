"""Italian wording of hours, periods, findings and registry decisions, as Column expressions.

Texts are fixed values: a person compares them with what earlier reports said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import MONTHS, clean, shown

# Words of the report.
LAW_104 = r"(?<!\d)104(?!\d)"
REGISTRY_LABELS = {
    "operatore": "Operatore", "alunno": "Alunno", "istituto": "Istituto scolastico", "ente": "Ente", "lotto": "Lotto", "municipalita": "Municipalità", "ore_pei": "Ore da PEI",
}
NO_QUOTA, OVER_QUOTA, WITHIN_QUOTA = "Ore PEI non indicate", "Oltre il limite PEI", "Entro il limite PEI"
NOTE_CANDIDATES = 3
# End of fixed values.


def hours_label(h: Column) -> Column:
    """1 ora, 3 ore, 1,5 ore; null for null."""
    text = shown(h)
    return F.when(text == "1", "1 ora").otherwise(F.concat(text, F.lit(" ore")))


def hours_done(h: Column, stem: str) -> Column:
    """Hours with a participle that agrees: 3 ore programmate, 1 ora programmata (``stem``: programmat)."""
    return F.concat(hours_label(h), F.lit(f" {stem}"), F.when(shown(h) == "1", "a").otherwise("e"))


def percent(x: Column) -> Column:
    """A number of percent with one decimal at most: 50%, 33,3%."""
    text = F.regexp_replace(F.round(x, 1).cast("decimal(20,1)").cast("string"), r"\.0$", "")
    return F.concat(F.replace(text, F.lit("."), F.lit(",")), F.lit("%"))


def month_name(month: Column) -> Column:
    return F.when(month.between(1, 12), F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(F.lit(1), F.least(F.lit(12), month)).cast("int")))


def from_to(first: Column, last: Column, month: Column | None = None) -> Column:
    """A stretch of days with its articles: dal 2 all'8 febbraio, dall'1 al 7, 3 for one day."""
    # numbers that begin with a vowel when spoken
    with_article = lambda word, n: F.concat(F.lit(word), F.when(n.isin(1, 8, 11), "l'").otherwise(" "), n.cast("string"))
    days = F.when(first == last, first.cast("string")).otherwise(F.concat(with_article("dal", first), F.lit(" "), with_article("al", last)))
    return days if month is None else F.concat_ws(" ", days, month_name(month))


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def note_description(note: Column) -> Column:
    """A row's note in quotes; an isolated 104 is explained."""
    text = F.concat(F.lit("nota «"), note, F.lit("»"))
    return F.concat(text, F.when(note.rlike(LAW_104), " (permesso Legge 104/1992)").otherwise(""))


def outcome_wording(outcome: Column) -> Column:
    """The outcome as tables show it: a dash after its kind."""
    return F.regexp_replace(outcome, r"^(Errore|Da verificare): ", "$1 – ")


def code_title(code: Column, title: Column) -> Column:
    return F.concat(F.substring(code, 1, 3), F.lit(" · "), capital(title))


def week_caption(year: Column, month: Column, week: Column, first: Column, last: Column) -> Column:
    """A week of the sheet: 2ª · 02/02 – 08/02; without a period its days."""
    day = lambda d: F.date_format(F.make_date(year, month, d), "dd/MM")
    known = year.isNotNull() & month.between(1, 12)
    dates = F.concat(day(first), F.when(first != last, F.concat(F.lit(" – "), day(last))).otherwise(""))
    return F.concat(week.cast("string"), F.lit("ª · "), F.when(known, dates).otherwise(F.concat(F.lit("giorni "), first.cast("string"), F.lit("–"), last.cast("string"))))


def week_outcome(hours: Column, quota: Column, tolerance: str = "0.01") -> Column:
    """Whether a week's hours keep to the full weekly quota."""
    return F.when(quota.isNull(), NO_QUOTA).when(hours > quota + F.lit(tolerance).cast("decimal(9,4)"), OVER_QUOTA).otherwise(WITHIN_QUOTA)


def quoted_sheet(name: Column) -> Column:
    """A sheet's name as references want it."""
    return F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))


def literal_criterion(name: Column) -> Column:
    """A name as a criterion in which its own wildcards and operators mean themselves."""
    return F.concat(F.lit("="), F.regexp_replace(name, r"([~*?])", "~$1"))


def one_line(c: Column, most: int = 32_000) -> Column:
    """Text on one line, within a cell's length; null is empty."""
    return F.coalesce(clean(c, most), F.lit(""))


def registry_note(decision: Column) -> Column:
    """What a decision of the registry did, for the reader; null if there is nothing to say.

    decision: struct of campo, esito, letto, valore, somiglianza (0..1), incerto, associato, era_incerto and candidati,
    an array of structs valore, somiglianza, associato in order.
    """
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in REGISTRY_LABELS.items() for x in kv]), decision["campo"]), decision["campo"])
    share = lambda s: F.concat(F.round(s * 100).cast("int").cast("string"), F.lit("%"))
    named = lambda v: F.concat(F.lit("«"), v, F.lit("»"))
    told = F.transform(F.slice(decision["candidati"], 1, NOTE_CANDIDATES), lambda k: F.concat(named(k["valore"]), F.lit(" ("), share(k["somiglianza"]), F.when(k["associato"], ", associazione nota").otherwise(""), F.lit(")")))
    listed, read, value = F.array_join(told, ", "), named(decision["letto"]), named(decision["valore"])
    details = F.concat_ws(", ", F.concat(F.lit("somiglianza "), share(decision["somiglianza"])), F.when(decision["associato"], "associazione nota"), F.when(decision["incerto"], "da verificare"))
    sentence = (
        F.when((decision["esito"] == "identico") & (decision["letto"] != decision["valore"]), F.concat(F.lit(" uniformato all'anagrafica: letto "), read, F.lit(", usato "), value, F.lit(".")))
        .when((decision["esito"] == "identico") & decision["era_incerto"], F.concat(F.lit(" "), value, F.lit(" presente nell'anagrafica: lettura confermata.")))
        .when(decision["esito"] == "sostituito", F.concat(F.lit(" riconosciuto dall'anagrafica ("), details, F.lit("): letto "), read, F.when(decision["incerto"], ", proposto ").otherwise(", usato "), value, F.lit(".")))
        .when(decision["esito"] == "ambiguo", F.concat(F.lit(" letto "), read, F.lit(": più voci simili nell'anagrafica ("), listed, F.lit("), da verificare.")))
        .when(decision["esito"] == "simile", F.concat(F.lit(" letto "), read, F.lit(": possibile corrispondenza nell'anagrafica "), listed, F.lit(", da verificare.")))
        .when(decision["esito"] == "dedotto", F.concat(F.lit(" non leggibile: proposto "), value, F.lit(" dall'anagrafica (unico valore associato), da verificare.")))
    )
    return F.concat(label, sentence)
