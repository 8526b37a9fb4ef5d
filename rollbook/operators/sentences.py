"""Findings in Italian sentences, made from the finding and the row or sheet that it is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import WEEKDAYS, day_date
from ..functions.messages import capital, from_to, hours_done, hours_label, month_name, note_description, percent
from ..functions.values import clean, shown
from ..plans.model import CODE, HEADER_HOUR_FIELDS, HOUR_FIELDS, LABELS, MAX_DAY_HOURS
from .rows import pair_legible_written
from .rules import interval

# The sentences' own words, by code.
READ_AND_ENTER, CHECK = "da leggere sulla scansione e inserire a mano", "da verificare sulla scansione"
NOT_A_SHEET = "La pagina non è stata riconosciuta come foglio firma dell'Assistenza Specialistica: verificare il file oppure inserire i dati manualmente."
NO_COORDINATOR = "Manca la firma del coordinatore dell'ente accanto al totale mensile."
NO_STAMP = "Mancano il timbro e la firma del referente scolastico in calce al foglio."
GRID_PAGE = "Griglia incerta: verificare tutti i valori della pagina (la tabella non è allineata con sicurezza alle righe del modulo)."
GRID_ROW = "griglia incerta, verificare tutti i valori della riga (la riga non è allineata con sicurezza alla tabella del modulo)."
MISSING = {"operatore": "manca il nome dell'operatore", "alunno": "manca il nome dell'alunno", "mese": "manca il mese di riferimento", "anno": "manca l'anno di riferimento"}
# End of fixed values.
#: Of a row or a sheet, what sentences tell.
_ROW = ["eff", "prog", "eff_h", "prog_h", "dich", "ric", "tipo", "festivita", "nota", "eff_scritto", "mese", "anno", "esiste"]


def _text(*parts: Column | str) -> Column:
    """Parts put together; null if one of them is."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _maybe(condition: Column, *parts: Column | str) -> Column:
    return F.coalesce(F.when(condition, _text(*parts)), F.lit(""))


def row_facts(rows: DataFrame) -> DataFrame:
    """(doc_id, giorno, …) of typed rows: what sentences tell about a day."""
    hours = lambda c: (F.col(c) / F.lit(60)).cast("decimal(13,8)")
    return rows.select(
        "doc_id", "giorno", interval("eff").alias("eff"), interval("prog").alias("prog"), hours("min_eff").alias("eff_h"), hours("min_prog").alias("prog_h"), "dich", "ric", "tipo", "festivita",
        clean(F.col("note")).alias("nota"), pair_legible_written("eff").alias("eff_scritto"), "mese", "anno", "esiste",
    )


def sentences(findings: DataFrame, rows: DataFrame, weeks: DataFrame) -> DataFrame:
    """Findings with ``messaggio``. rows: typed rows; weeks: totals.week_totals(). Findings of the reader (W14, I06) come with the texts that
    follow from them; W13 is told by duplicates.

    Rows are joined by sheet and day, weeks only to the findings about the weekly quota, by sheet and hours.
    """
    facts = row_facts(rows).withColumnsRenamed({c: f"r_{c}" for c in _ROW})
    over = weeks.where(F.col("ore") > F.col("ore_pei_doc")).select("doc_id", (F.col("settimana") + 10_000).alias("ordine"), F.struct("settimana", "dal", "al", "ore", "ore_pei_doc").alias("w"))
    sheet_month = rows.groupBy("doc_id").agg(F.max("mese").alias("m_mese"))
    joined = findings.join(facts, ["doc_id", "giorno"], "left").join(over, ["doc_id", "ordine"], "left").join(sheet_month, "doc_id", "left")
    return joined.withColumn("messaggio", _message()).select(*findings.columns, "messaggio")


def _message() -> Column:
    r = {c: F.col(f"r_{c}") for c in _ROW}
    day = _text("Giorno ", F.col("giorno").cast("string"), ": ")
    read, expected, field = F.col("valore_letto"), F.col("valore_atteso"), F.col("campo")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), field)
    prefix = F.when(F.col("giorno").isNotNull(), day).otherwise("")
    side, kind = F.regexp_extract(field, r"_(.*)$", 1), F.when(field.startswith("prog_"), "programmato").otherwise("effettivo")
    other = F.when(side == "uscita", "entrata").otherwise("uscita")
    feminine = F.concat(F.regexp_replace(kind, "o$", ""), F.lit("a"))
    one_hour = lambda h: shown(h) == "1"
    worked = F.coalesce(F.col("r_dich") > F.lit("0.01").cast("decimal(9,4)"), F.lit(False))
    parts = F.concat_ws(", ", F.when(r["eff_scritto"], _text("orario ", r["eff"])), F.when(worked, hours_done(r["dich"], "dichiarat")))
    both = F.concat_ws(" e ", F.when(r["eff_scritto"], _text("l'orario effettivo ", r["eff"])), F.when(worked, hours_label(r["dich"])))
    weekday = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day_date(r["anno"], r["mese"], F.col("giorno"))) + 1)
    noted = _maybe(r["nota"].isNotNull(), " – ", note_description(F.coalesce(r["nota"], F.lit(""))))
    recognised = F.when(r["ric"] > 0, _text(F.when(one_hour(r["ric"]), "riconosciuta ").otherwise("riconosciute "), hours_label(r["ric"]), _maybe(r["prog_h"] > 0, " su ", shown(r["prog_h"]), " programmate (", percent(r["ric"] / r["prog_h"] * 100), ")"))).otherwise(
        _text("nessuna ora riconosciuta", _maybe(r["prog_h"] > 0, " (", hours_done(r["prog_h"], "programmat"), ")"))
    )
    w = lambda f: F.col(f"w.{f}")
    hour_fields = [*HOUR_FIELDS, *HEADER_HOUR_FIELDS]
    total = lambda c: hours_label(F.replace(c, F.lit(","), F.lit(".")).try_cast("decimal(12,4)"))
    apart = F.abs(F.replace(read, F.lit(","), F.lit(".")).try_cast("decimal(12,4)") - F.replace(expected, F.lit(","), F.lit(".")).try_cast("decimal(12,4)"))
    told = {
        "E01": F.when(expected.isNull(), _text(day, "ore dichiarate non plausibili (", read, f"): il valore deve essere compreso tra 0 e {MAX_DAY_HOURS}.")).otherwise(_text(day, "dichiarate ", total(read), " ma l'orario effettivo ", r["eff"], " corrisponde a ", total(expected), ".")),
        "E02": _text("Totale mensile dichiarato ", total(read), ", somma dei giorni ", total(expected), " (differenza ", shown(apart), ")."),
        "E03": F.when(expected == "HH:MM", _text(day, side, " ", feminine, " non interpretabile come orario («", read, "»).")).when(F.contains(read, F.lit("–")), _text(day, "l'uscita ", feminine, " (", F.substring_index(read, "–", -1), ") non è successiva all'entrata (", F.substring_index(read, "–", 1), ").")).otherwise(_text(day, "orario ", kind, " incompleto, manca l'", side, " (", other, " ", read, ").")),
        "E04": F.when(F.col("giorno").between(1, 31) & r["mese"].isNotNull(), _text(day, "il giorno non esiste nel mese di ", month_name(r["mese"]), " ", r["anno"].cast("string"), " ma la riga contiene dati; i valori non sono conteggiati nei totali.")).otherwise(_text(day, "giorno non valido ma la riga contiene dati; i valori non sono conteggiati.")),
        "E05": capital(_text(prefix, "campo «", label, "» illeggibile: ", F.when(field.isin(hour_fields), READ_AND_ENTER).otherwise(CHECK), ".")),
        "E06": F.lit(NOT_A_SHEET),
        "W01": _text(day, "manca la firma dell'operatore", _maybe(parts != "", " (", parts, ")"), "."),
        "W02": _text(day, "dichiarate ", total(read), " senza orario effettivo di entrata e uscita."),
        "W03": F.when(r["tipo"] == "festivo", _text("Giorno ", F.col("giorno").cast("string"), " (", weekday, ", ", r["festivita"], "): prestazione registrata in un giorno festivo.")).when(r["tipo"] == "domenica", _text("Giorno ", F.col("giorno").cast("string"), " (domenica): prestazione registrata di domenica.")).otherwise(_text("Giorno ", F.col("giorno").cast("string"), " (sabato): prestazione registrata di sabato; verificare che sia prevista dal calendario scolastico.")),
        "W04": capital(_text(prefix, "lettura incerta del campo «", label, "» (valore letto: ", read, "); verificare sulla scansione.")),
        "W05": _text(day, "segnalata l'assenza dell'operatore ma sono indicati ", both, "; le ore non vengono riconosciute."),
        "W06": _text("Settimana ", w("settimana").cast("string"), " (", from_to(w("dal"), w("al"), F.col("m_mese")), "): ", hours_label(w("ore")), ", oltre il limite settimanale del PEI (", hours_label(w("ore_pei_doc")), "; eccedenza ", hours_label(w("ore") - w("ore_pei_doc")), ")."),
        "W07": F.when(read.isNull(), _text("Intestazione incompleta: ", F.element_at(F.create_map(*[F.lit(x) for kv in MISSING.items() for x in kv]), field), ".")).otherwise(_text("Intestazione: ", F.lower(label), " non valido («", read, "»).")),
        "W08": F.lit(NO_COORDINATOR), "W09": F.lit(NO_STAMP),
        "W10": _text("Totale ore effettive mensili non indicato sul foglio (somma dei giorni: ", total(expected), ")."),
        "W11": _text(day, "crocette sia su «Assenza alunno» sia su «Assenza operatore»."),
        "W12": _text(day, "ore effettive non indicate sul foglio; riconosciute ", hours_label(r["eff_h"]), " calcolate dall'orario ", r["eff"], "."),
        "W14": F.when(F.col("giorno").isNull(), GRID_PAGE).otherwise(_text(day, GRID_ROW)),
        "I01": _text(day, "assenza dell'alunno; ", recognised, ".", _maybe(r["nota"].isNotNull(), " ", capital(note_description(F.coalesce(r["nota"], F.lit("")))), ".")),
        "I02": _text(day, "assenza dell'operatore", noted, _maybe(r["prog_h"] > 0, "; ", hours_done(r["prog_h"], "programmat"), F.when(one_hour(r["prog_h"]), " non svolta").otherwise(" non svolte")), "."),
        "I03": _text(day, "orario effettivo ", r["eff"], " diverso dal programmato ", r["prog"], "."),
        "I04": _text(day, "orario effettivo ", r["eff"], " senza orario programmato."),
        "I05": _text(day, "prestazione programmata non svolta (orario programmato ", r["prog"], ")", noted, "."),
        "I06": _text("Pagina raddrizzata automaticamente (", read, "): controllare che i valori corrispondano ai giorni giusti."),
    }
    out = None
    for short, sentence in told.items():
        out = F.when(F.col("codice") == CODE[short], sentence) if out is None else out.when(F.col("codice") == CODE[short], sentence)
    return out
