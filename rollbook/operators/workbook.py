"""The workbook's sheets as tables: typed cells with their comments, per-document sheets, names, legend and exclusions."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.messages import code_title, one_line, outcome_wording, week_caption, week_outcome
from ..functions.values import blank, clean, clock, minutes, written_date
from ..plans.model import DAY_FIELDS, HEADER_FIELDS, LABELS, TOLERANCE
from .duplicates import exclusion_reason, exportable
from .fields import field_state, worst_state
from .rows import pair_legible_written, valid_period

# Words of cells and comments.
ILLEGIBLE, YES, NO, PRESENT, ABSENT, DASH = "ILLEGGIBILE", "Sì", "No", "Presente", "Assente", "–"
UNRELIABLE = "«{}»: campo segnalato come illeggibile, il valore riportato non è affidabile. Verificare sull'originale."
TO_READ = "«{}»: campo scritto ma illeggibile. Leggere il valore sulla scansione originale e inserirlo a mano."
DOUBTFUL, RELIABILITY = "Lettura incerta: verificare sull'originale.", "Affidabilità della lettura: "
EDITED, EDITED_FROM, NOT_A_TIME = "Corretto manualmente durante la revisione.", "Corretto manualmente – valore OCR originale: ", "Orario non interpretabile: «{}» (formato atteso HH:MM)."
MOST_NAME = 31
# End of fixed values.
_TIMES, _MARKS = DAY_FIELDS[:4], DAY_FIELDS[5:8]


def italian_number(c: Column) -> Column:
    """What a spreadsheet takes for a number in a text: 3 or 1,5; null otherwise."""
    return F.when(F.trim(c).rlike(r"^-?\d{1,6}(,\d+)?$"), F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double"))


def typed_text_cell(c: Column) -> Column:
    """A text's value as a spreadsheet has it, as a struct: a number, a single time as a fraction of a day, or the text."""
    number, minute = italian_number(c), F.when(F.trim(c).rlike(r"^\d{1,2}:\d{2}$"), minutes(c))
    return F.struct(F.when(number.isNotNull(), "number").when(minute.isNotNull(), "time").otherwise("text").alias("kind"), F.coalesce(number, minute / F.lit(1440)).alias("number"), F.when(number.isNull() & minute.isNull(), one_line(c)).alias("text"))


def _original(field: str, c: Column) -> Column:
    """A reader's first value for a person."""
    text = one_line(c)
    if field in (*_MARKS, "firma_coordinatore", "timbro_referente"):
        true = F.lower(text).isin("true", "1", "sì", "si", "x", "yes", "presente")
        words = ("crocetta presente", "nessuna crocetta") if field.startswith("assenza") else ("presente", "assente")
        return F.when(text == "", "(vuoto)").when(true, words[0]).otherwise(words[1])
    value = F.coalesce(clock(minutes(text)), text) if field in _TIMES else text
    return F.when(text == "", "(vuoto)").otherwise(value)


def comment(field: str, key: str, present: Column, illegible: Column, uncertain: Column, edited: Column, originals: Column, confidence: Column | None = None) -> Column:
    """A cell's comment: what is wrong with its reading, how sure it is, and what stood there before a correction."""
    label = LABELS[field]
    bad, doubt = F.array_contains(illegible, field), F.array_contains(uncertain, field)
    share = F.when(confidence.between(0, 1), F.concat(F.lit(RELIABILITY), F.round(confidence * 100).cast("int").cast("string"), F.lit("%."))) if confidence is not None else F.lit(None)
    was = F.when(F.coalesce(F.map_contains_key(originals, key), F.lit(False)), F.concat(F.lit(EDITED_FROM), _original(field, F.element_at(originals, key)))).otherwise(EDITED)
    lines = [
        F.when(bad, F.when(present, UNRELIABLE.format(label)).otherwise(TO_READ.format(label))), F.when(~bad & doubt, DOUBTFUL), F.when(~bad & doubt, share),
        F.when(F.array_contains(edited, key), was),
    ]
    return F.nullif(F.concat_ws("\n", *lines), F.lit(""))


def _cell(field: Column | str, kind: Column, number: Column, text: Column, state: Column, note: Column) -> Column:
    return F.struct((F.lit(field) if isinstance(field, str) else field).alias("campo"), kind.alias("kind"), number.cast("double").alias("number"), text.alias("text"), state.alias("stato"), note.alias("commento"))


def day_cells(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, giorno, campo, kind, number, text, stato, commento) of typed rows; kind: time (fraction of a day), hours, mark, no, dash,
    invalid, illeggibile, text or empty. edits: (doc_id, user_edited, ocr_originali)."""
    joined = rows.join(edits, "doc_id", "left").withColumns({"user_edited": F.coalesce("user_edited", F.array().cast("array<string>"))})
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    served = pair_legible_written("eff") | F.coalesce(F.col("ore_dichiarate") > F.lit(TOLERANCE).cast("decimal(9,4)"), F.lit(False))
    cells = []
    for f in DAY_FIELDS:
        c, minute = F.col(f), F.col(f"min_{f}") if f in _TIMES else None
        if f in _TIMES:
            present = ~blank(c)
            dash = blank(c) & F.lit(f.startswith("eff_")) & F.coalesce(F.col("trattino_effettivo"), F.lit(False))
            kind = F.when(dash, "dash").when(blank(c), "empty").when(minute.isNotNull(), "time").otherwise("invalid")
            number, text = minute / F.lit(1440), F.when(dash, DASH).when(present & minute.isNull(), one_line(c))
        elif f == "ore_dichiarate":
            present, number, text = c.isNotNull(), c, no_text
            kind = F.when(present, "hours").otherwise("empty")
        elif f == "firma":
            present, number = c, no_number
            kind = F.when(c, "mark").when(served & ~F.col("assenza_operatore"), "no").otherwise("empty")
            text = F.when(c, YES).when(kind == "no", NO)
        elif f in _MARKS:
            present, number, kind, text = c, no_number, F.when(c, "mark").otherwise("empty"), F.when(c, "X")
        else:
            text = F.nullif(one_line(c), F.lit(""))
            present, number, kind = text.isNotNull(), no_number, F.when(text.isNotNull(), "text").otherwise("empty")
        lost = F.array_contains("illeggibili", f) & ~present
        key = F.concat(F.lit("rows."), F.col("giorno").cast("string"), F.lit(f".{f}"))
        state = F.when(F.array_contains("illeggibili", f), "illeggibile").when(F.array_contains("incerti", f), "incerto").when(F.array_contains(F.col("user_edited"), key), "corretto").otherwise("")
        note = comment(f, key, present, F.col("illeggibili"), F.col("incerti"), F.col("user_edited"), F.col("ocr_originali"))
        note = F.nullif(F.concat_ws("\n", F.when(~lost & (kind == "invalid"), F.concat(F.lit(NOT_A_TIME.split("{}")[0]), text, F.lit(NOT_A_TIME.split("{}")[1]))), note), F.lit(""))
        cells.append(_cell(f, F.when(lost, "illeggibile").otherwise(kind), F.when(~lost, number), F.when(lost, ILLEGIBLE).otherwise(text), state, note))
    return joined.select("doc_id", "giorno", F.explode(F.array(*cells)).alias("x")).select("doc_id", "giorno", "x.*")


def header_cells(sheets: DataFrame) -> DataFrame:
    """(doc_id, campo, kind, number, text, stato, commento) of flat sheets with user_edited and ocr_originali; mese stands for month and
    year in one cell, in the worst state of both. Codes of six digits at most are numbers (kind int)."""
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = []
    for f in [x for x in HEADER_FIELDS if x != "anno"]:
        c = F.col(f)
        state = field_state(f, f"header.{f}", "h_illeggibili", "h_incerti")
        if f in ("ore_pei", "totale_mensile_dichiarato"):
            present, number, text, kind = c.isNotNull(), c, no_text, F.when(c.isNotNull(), "hours").otherwise("empty")
        elif f in ("firma_coordinatore", "timbro_referente"):
            present, number, text, kind = F.coalesce(c, F.lit(False)), no_number, F.when(c, PRESENT).otherwise(ABSENT), F.when(c, "mark").otherwise("no")
        elif f == "mese":
            ok = valid_period(c, F.col("anno"))
            state = worst_state(state, field_state("anno", "header.anno", "h_illeggibili", "h_incerti"))
            partial = F.concat(F.coalesce(F.lpad(c.cast("string"), 2, "0"), F.lit("??")), F.lit("/"), F.coalesce(F.col("anno").cast("string"), F.lit("????")))
            present = c.isNotNull() | F.col("anno").isNotNull()
            number, kind = no_number, F.when(ok, "month").when(present, "text").otherwise("empty")
            text = F.when(ok, F.format_string("%04d-%02d", F.col("anno").cast("int"), c.cast("int"))).when(present, partial)
        elif f == "data_compilazione":
            date, text = written_date(c), F.nullif(one_line(c), F.lit(""))
            present, number = text.isNotNull(), no_number
            kind, text = F.when(date.isNotNull(), "date").when(text.isNotNull(), "text").otherwise("empty"), F.coalesce(F.date_format(date, "yyyy-MM-dd"), text)
        elif f == "sostituzione":
            text = F.when(c == "SI", YES).when(c == "NO", NO)
            present, number, kind = text.isNotNull(), no_number, F.when(text.isNotNull(), "text").otherwise("empty")
        else:
            text = F.nullif(one_line(c), F.lit(""))
            code = F.lit(f in ("lotto", "municipalita")) & F.coalesce(text.rlike(r"^\d{1,6}$"), F.lit(False))
            present, number, kind = text.isNotNull(), F.when(code, text.try_cast("double")), F.when(code, "int").when(text.isNotNull(), "text").otherwise("empty")
            text = F.when(~code, text)
        lost = (state == "illeggibile") & ~present
        notes = [comment(x, f"header.{x}", F.col(x).isNotNull() if f == "mese" else present, F.col("h_illeggibili"), F.col("h_incerti"), F.col("user_edited"), F.col("ocr_originali")) for x in ([f, "anno"] if f == "mese" else [f])]
        cells.append(_cell(f, F.when(lost, "illeggibile").otherwise(kind), F.when(~lost, number), F.when(lost, ILLEGIBLE).otherwise(text), state, F.nullif(F.concat_ws("\n", *notes), F.lit(""))))
    return sheets.select("doc_id", F.explode(F.array(*cells)).alias("x")).select("doc_id", "x.*")


def exclusions(sheets: DataFrame) -> DataFrame:
    """(doc_id, source_file, source_page, motivo) of the sheets that the export leaves out."""
    return sheets.where(~exportable()).select("doc_id", "source_file", "source_page", exclusion_reason().alias("motivo"))


def legend(codes: DataFrame, statistics: DataFrame, excluded: DataFrame) -> DataFrame:
    """(sezione, ordine, voce, testo): the rule catalogue, the readers' statistics and the excluded sheets, as one table."""
    place = lambda *order: F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))
    rules = codes.select(F.lit("codici").alias("sezione"), F.col("ordine").cast("int").alias("ordine"), code_title(F.col("codice"), F.col("titolo")).alias("voce"), F.col("gravita").alias("testo"))
    readers = statistics.select(F.lit("lettura").alias("sezione"), place("engine", "model").alias("ordine"), F.concat_ws(" ", "engine", "model").alias("voce"), F.col("documenti").cast("string").alias("testo"))
    # the sheets left out may be many: their order is by their own file and page, not by a number
    left = excluded.select(F.lit("esclusi").alias("sezione"), F.col("source_page").cast("int").alias("ordine"), F.concat(F.col("source_file"), F.lit(" – pagina "), F.col("source_page").cast("string")).alias("voce"), F.col("motivo").alias("testo"))
    return rules.unionByName(readers).unionByName(left)


def document_sheet(detail: DataFrame, weeks: DataFrame) -> DataFrame:
    """(doc_id, blocco, riga, voce, ore, quota, limite, differenza, esito): a document's own sheet: its day rows, a row for each week and
    the month's totals. detail: rows of reports.detail(); weeks: totals.week_totals() with mese and anno."""
    none = lambda kind="decimal(12,2)": F.lit(None).cast(kind)
    wide = lambda c: F.col(c).cast("decimal(12,2)")
    days = detail.select("doc_id", F.lit("giorni").alias("blocco"), F.col("giorno").cast("int").alias("riga"), F.concat_ws(" ", F.concat_ws("–", "prog_entrata", "prog_uscita"), F.concat_ws("–", "eff_entrata", "eff_uscita")).alias("voce"), wide("ric").alias("ore"), wide("prog").alias("quota"), none().alias("limite"), wide("diff").alias("differenza"), outcome_wording(F.col("esito")).alias("esito"))
    caption = week_caption(F.col("anno"), F.col("mese"), F.col("settimana"), F.col("dal"), F.col("al"))
    block = weeks.select("doc_id", F.lit("settimane").alias("blocco"), F.col("settimana").cast("int").alias("riga"), caption.alias("voce"), wide("ore").alias("ore"), wide("ore_pei").alias("quota"), wide("ore_pei_doc").alias("limite"), wide("differenza").alias("differenza"), week_outcome(F.col("ore"), F.col("ore_pei_doc")).alias("esito"))
    total = weeks.groupBy("doc_id").agg(F.sum("ore").alias("o"), F.sum("ore_pei").alias("q")).select("doc_id", F.lit("mese").alias("blocco"), F.lit(1).alias("riga"), F.lit("Totale del mese").alias("voce"), wide("o").alias("ore"), wide("q").alias("quota"), none().alias("limite"), (F.col("o") - F.col("q")).cast("decimal(12,2)").alias("differenza"), none("string").alias("esito"))
    return days.unionByName(block).unionByName(total)


def _short_forms(words: list[str], room: int) -> list[str]:
    """A name's forms: with as few initials of given names as fit (all of them, if none fits), then in full if that fits."""
    if len(words) < 2:
        return words
    with_initials = [" ".join([*words[:k], "".join(w[0] + "." for w in words[k:])]) for k in range(1, len(words))]
    fullest = max((f for f in with_initials if len(f) <= room), key=len, default=with_initials[0])
    return [fullest] + [f for f in [" ".join(words)] if len(f) <= room]


def name_sheets(entries: list[tuple[int, str, str]]) -> dict[int, str]:
    """Sheet names of 31 characters at most, unique without regard to case: entries (n, operator, period) in order.

    Another person of the same short name gets a fuller one; another sheet of the same person and month a number.
    """
    owners: dict[str, str] = {}  # names given so far
    out = {}
    for n, operator, period in sorted(entries):
        tail = f" {period}" if period else ""
        trimmed = lambda text, more="", tail=tail: text[: MOST_NAME - len(tail) - len(more)].rstrip() + tail + more
        plain = "".join("-" if ch in "[]:*?/\\'" else ch for ch in operator)
        forms = _short_forms([w for w in plain.split() if w.strip("-")], MOST_NAME - len(tail)) or [f"Foglio {n}"]
        person = operator.casefold()
        fuller = itertools.takewhile(lambda name: owners.get(name.casefold()) != person, map(trimmed, forms))
        counted = (trimmed(forms[0], f" ({k})") for k in itertools.count(2))
        out[n] = next(name for name in itertools.chain(fuller, counted) if name.casefold() not in owners)
        owners[out[n].casefold()] = person
    return out


def sheet_names(numbered: DataFrame) -> DataFrame:
    """(doc_id, n, scheda) of numbered sheets (doc_id, n, operatore, mese, anno). Names can only meet where the first word's beginning
    and the period are the same, so those are the groups; each is named in the report's order."""
    schema = pa.schema([("doc_id", pa.string()), ("n", pa.int64()), ("scheda", pa.string())])

    def run(rows: pa.Table) -> pa.Table:
        data = rows.to_pylist()
        names = name_sheets([(r["n"], r["op"], r["periodo"]) for r in data])
        return pa.table([pa.array([r["doc_id"] for r in data], pa.string()), pa.array([r["n"] for r in data], pa.int64()), pa.array([names[r["n"]] for r in data], pa.string())], schema=schema)

    ok = valid_period(F.col("mese"), F.col("anno"))
    period = F.when(ok, F.format_string("%02d-%d", F.col("mese").cast("int"), F.col("anno").cast("int"))).otherwise("")
    base = numbered.select("doc_id", F.col("n").cast("long").alias("n"), F.coalesce(clean(F.col("operatore")), F.lit("")).alias("op"), period.alias("periodo"))
    first = F.left(F.lower(F.substring_index("op", " ", 1)), F.lit(12))
    # sheets without a name are told apart by their number: each is a group of its own
    return base.withColumn("g", F.when(F.col("op") == "", F.concat(F.lit("\n"), F.col("n").cast("string"))).otherwise(first)).groupBy("g", "periodo").applyInArrow(run, "doc_id string, n long, scheda string")

