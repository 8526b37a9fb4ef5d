"""The rule engine: one wide projection for all rules of a row, one explode for their findings.

A finding is (codice, gravita, giorno, campo, valore_letto, valore_atteso, ordine); ``ordine`` is the order
of emission, which settles ties. Prose is left to the presentation. Conditions and values are SQL texts, parsed as one
expression: building them piece by piece took longer than running them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import BLANK
from ..plans.model import CODE, DAY_FIELDS, HEADER_FIELDS, HEADER_HOUR_FIELDS, HOUR_FIELDS, SEVERITY, TOLERANCE
from .rows import has_content, names, pair_written

_FINDING = "array<struct<codice:string,gravita:string,giorno:int,campo:string,valore_letto:string,valore_atteso:string>>"
_TIMES = DAY_FIELDS[:4]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def finding(code: str, day: str = "NULL", field: str | None = None, read: str = "NULL", expected: str = "NULL", severity: str | None = None) -> str:
    """A finding as SQL; ``field`` is a name or, in brackets, an expression, the others are expressions."""
    name = CODE[code]
    told = "NULL" if field is None else field if field.startswith("(") else _quoted(field)
    parts = {"codice": (_quoted(name), "STRING"), "gravita": (severity or _quoted(SEVERITY[name]), "STRING"), "giorno": (day, "INT"), "campo": (told, "STRING"), "valore_letto": (read, "STRING"), "valore_atteso": (expected, "STRING")}
    return "NAMED_STRUCT(" + ", ".join(f"'{k}', CAST({v} AS {kind})" for k, (v, kind) in parts.items()) + ")"


def some(condition: str, what: str) -> str:
    """The finding where the condition holds, as an array."""
    return f"IF(COALESCE({condition}, FALSE), ARRAY({what}), CAST(ARRAY() AS {_FINDING}))"


def _all(parts: list[str]) -> Column:
    return F.expr(f"CONCAT({', '.join(parts)})")


def _has(c: str, name: str) -> str:
    return f"ARRAY_CONTAINS({c}, {_quoted(name)})"


def _blank(c: str) -> str:
    return f"({c} IS NULL OR {c} RLIKE r'{BLANK}')"


def _clean(c: str) -> str:
    return rf"NULLIF(TRIM(REGEXP_REPLACE({c}, r'\s+', ' ')), '')"


def _clock(m: str) -> str:
    return f"IF({m} IS NULL, NULL, FORMAT_STRING('%02d:%02d', CAST(FLOOR({m} / 60) AS INT), CAST({m} % 60 AS INT)))"


def _shown(h: str) -> str:
    return rf"REPLACE(REGEXP_REPLACE(CAST(CAST(ROUND({h}, 2) AS DECIMAL(20,2)) AS STRING), r'\.?0+$', ''), '.', ',')"


def readable(field: str) -> str:
    """A field's value for a person."""
    if field in ("firma", "firma_coordinatore", "timbro_referente"):
        return f"IF({field}, 'presente', 'assente')"
    if field in ("assenza_alunno", "assenza_operatore"):
        return f"IF({field}, 'crocetta presente', 'nessuna crocetta')"
    if field in ("ore_dichiarate", "ore_pei", "totale_mensile_dichiarato"):
        return f"COALESCE({_shown(field)}, 'campo vuoto')"
    if field in _TIMES:
        return f"COALESCE({_clock('min_' + field)}, {_clean(field)}, 'campo vuoto')"
    return f"COALESCE({_clean(f'CAST({field} AS STRING)')}, 'campo vuoto')"


def flagged_fields(fields: list[str], hour_fields: list[str], uncertain: str, illegible: str, day: str = "NULL") -> list[str]:
    """E05 for illegible fields, then W04 for uncertain ones that aren't illegible, each in the fields' order."""
    out = [some(_has(illegible, f), finding("E05", day, f, severity="'errore'" if f in hour_fields else "'attenzione'")) for f in fields]
    return out + [some(f"{_has(uncertain, f)} AND NOT {_has(illegible, f)}", finding("W04", day, f, readable(f))) for f in fields]


def _time_findings(prefix: str) -> list[str]:
    """E03: not a time; not later than the entry; only one of the two."""
    a, b = f"{prefix}_entrata", f"{prefix}_uscita"
    legible = {f: f"NOT {_has('illeggibili', f)}" for f in (a, b)}
    out = [some(f"NOT {_blank(f)} AND min_{f} IS NULL AND {legible[f]}", finding("E03", "giorno", f, _clean(f), "'HH:MM'")) for f in (a, b)]
    out.append(some(f"min_{b} <= min_{a}", finding("E03", "giorno", b, f"CONCAT({_clock('min_' + a)}, '–', {_clock('min_' + b)})")))
    out += [some(f"min_{x} IS NOT NULL AND {_blank(y)} AND {legible[y]}", finding("E03", "giorno", y, _clock("min_" + x))) for x, y in ((a, b), (b, a))]
    return out


def _interval(prefix: str) -> str:
    side = lambda f: f"COALESCE({_clock('min_' + f)}, {_clean(f)}, '?')"
    return f"CONCAT({side(prefix + '_entrata')}, '–', {side(prefix + '_uscita')})"


def interval(prefix: str) -> Column:
    """Both times of a pair as they are told: read, else as written, else a question mark."""
    return F.expr(_interval(prefix))


def row_findings(rows: DataFrame) -> DataFrame:
    """Findings of typed day rows."""
    op, al, g = "assenza_operatore", "assenza_alunno", "giorno"
    worked = f"COALESCE(dich > {TOLERANCE}, FALSE)"
    prog_legible = f"(NOT {_blank('prog_entrata')} OR NOT {_blank('prog_uscita')})"
    differs = "(min_eff_entrata <> min_prog_entrata OR min_eff_uscita <> min_prog_uscita)"
    note = _clean("note")
    parts = [
        *_time_findings("prog"), *_time_findings("eff"),
        some("ore_dichiarate IS NOT NULL AND dich IS NULL", finding("E01", g, "ore_dichiarate", _shown("ore_dichiarate"))),
        some(f"ABS(dich - eff_h) > {TOLERANCE} AND NOT {op} AND NOT ({al} AND dich < eff_h)", finding("E01", g, "ore_dichiarate", _shown("dich"), _shown("eff_h"))),
        some(f"eff_h IS NOT NULL AND ore_dichiarate IS NULL AND NOT {_has('illeggibili', 'ore_dichiarate')} AND NOT {op}", finding("W12", g, "ore_dichiarate", expected=_shown("eff_h"))),
        some(f"{worked} AND NOT eff_scritto AND NOT {al} AND NOT {op}", finding("W02", g, "ore_dichiarate", _shown("dich"))),
        some(f"prestazione AND NOT firma AND NOT {op} AND NOT {_has('illeggibili', 'firma')} AND NOT {_has('incerti', 'firma')}", finding("W01", g, "firma", "'assente'")),
        some(f"periodo_valido AND prestazione AND NOT {op} AND tipo IN ('festivo', 'domenica', 'sabato')", finding("W03", g, severity="IF(tipo = 'sabato', 'info', 'attenzione')")),
        some(f"{op} AND prestazione", finding("W05", g, "assenza_operatore")),
        some(f"{al} AND {op}", finding("W11", g, "assenza_alunno")),
        some(al, finding("I01", g, "assenza_alunno", _shown("ric"), _shown("prog_h"))),
        some(op, finding("I02", g, "assenza_operatore", note)),
        some(f"eff_h IS NOT NULL AND NOT {op} AND prog_h IS NOT NULL AND {differs}", finding("I03", g, "(IF(min_eff_entrata <> min_prog_entrata, 'eff_entrata', 'eff_uscita'))", _interval("eff"), _interval("prog"))),
        some(f"eff_h IS NOT NULL AND NOT {op} AND prog_h IS NULL AND NOT prog_scritto", finding("I04", g, "prog_entrata", _interval("eff"))),
        some(f"{prog_legible} AND NOT eff_scritto AND (ore_dichiarate IS NULL OR dich <= {TOLERANCE}) AND NOT {_has('illeggibili', 'ore_dichiarate')} AND NOT {al} AND NOT {op}", finding("I05", g, "eff_entrata", note)),
        *flagged_fields(DAY_FIELDS, HOUR_FIELDS, "incerti", "illeggibili", g),
    ]
    ready = rows.withColumns({
        "eff_h": F.expr("CAST(min_eff / 60 AS DECIMAL(13,8))"), "prog_h": F.expr("CAST(min_prog / 60 AS DECIMAL(13,8))"), "eff_scritto": pair_written("eff"), "prog_scritto": pair_written("prog"), "contenuto": has_content(),
    }).withColumn("prestazione", F.expr(f"eff_scritto OR {worked}"))
    found = F.when(F.col("esiste"), _all(parts)).otherwise(F.expr(some("contenuto", finding("E04", g))))
    return ready.select("doc_id", F.posexplode(found).alias("ordine", "f")).select("doc_id", "f.*", (F.col("ordine") + 100).alias("ordine"))


def sheet_findings(sheets: DataFrame, totals: DataFrame, weeks: DataFrame) -> DataFrame:
    """Findings of flat sheets as a whole; totals and weeks as operators.totals gives them."""
    legible = lambda f: f"NOT {_has('ill', f)}"
    missing = lambda f: f"{_clean(f'CAST({f} AS STRING)')} IS NULL AND {legible(f)}"
    flagged = lambda f: f"({_has('ill', f)} OR {_has('inc', f)})"
    total, sums = "totale_mensile_dichiarato", "t_dichiarate"
    parts = [
        *(some(missing(f), finding("W07", field=f)) for f in ("operatore", "alunno")),
        *(some(f"({missing(f)}) OR ({f} IS NOT NULL AND NOT {f} BETWEEN {a} AND {b} AND {legible(f)})", finding("W07", field=f, read=f)) for f, a, b in (("mese", 1, 12), ("anno", 2000, 2100))),
        *flagged_fields(HEADER_FIELDS, HEADER_HOUR_FIELDS, "inc", "ill"),
        *(some(f"NOT {f} AND NOT {flagged(f)}", finding(code, field=f, read="'assente'")) for code, f in (("W08", "firma_coordinatore"), ("W09", "timbro_referente"))),
        some(f"ABS({sums} - {total}) > {TOLERANCE}", finding("E02", field=total, read=_shown(total), expected=_shown(sums))),
        some(f"{total} IS NULL AND {legible(total)}", finding("W10", field=total, expected=_shown(sums))),
    ]
    ready = {f: F.coalesce(F.col(f), F.lit(False)) for f in ("firma_coordinatore", "timbro_referente")} | {"ill": names("h_illeggibili"), "inc": names("h_incerti")}
    joined = sheets.withColumns(ready).join(totals.select("doc_id", F.col("ore_dichiarate").alias(sums)), "doc_id", "left").withColumn(sums, F.expr(f"COALESCE({sums}, CAST(0 AS DECIMAL(9,2)))"))
    whole = joined.select("doc_id", F.posexplode(_all(parts)).alias("ordine", "f")).select("doc_id", "f.*", "ordine")
    over = weeks.where(F.expr(f"ore > ore_pei_doc + CAST({TOLERANCE} AS DECIMAL(9,4))"))
    by_week = over.select("doc_id", F.expr(finding("W06", field="ore_pei", read=_shown("ore"), expected=_shown("ore_pei_doc"))).alias("f"), (F.col("settimana") + 10_000).alias("ordine")).select("doc_id", "f.*", "ordine")
    return whole.unionByName(by_week)


def with_reader_warnings(findings: DataFrame, sheets: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the reader's warnings of known codes once each; where the grid is doubtful (W14 on the page or the day),
    W04 on an empty field says nothing new and goes."""
    given = sheets.select("doc_id", F.posexplode("avvisi").alias("n", "f")).select("doc_id", "f.*", (F.col("n") + 20_000).alias("ordine"))
    given = given.join(F.broadcast(known.select("codice")), "codice", "left_semi").dropDuplicates(["doc_id", "codice", "giorno", "campo", "valore_letto", "valore_atteso"])
    grid = given.where(F.col("codice") == CODE["W14"]).select(F.col("doc_id").alias("w_doc"), F.col("giorno").alias("w_giorno")).distinct()
    empty = (F.col("codice") == CODE["W04"]) & F.col("valore_letto").isin("campo vuoto", "nessuna crocetta", "assente")
    kept = findings.join(grid, (F.col("doc_id") == F.col("w_doc")) & empty & (F.col("w_giorno").isNull() | (F.col("w_giorno") == F.col("giorno"))), "left_anti")
    return kept.unionByName(given.select(kept.columns))


def not_a_sheet(sheets: DataFrame) -> DataFrame:
    """E06 of pages that aren't attendance sheets."""
    return sheets.where(~F.col("is_foglio_firma")).select("doc_id", F.expr(finding("E06")).alias("f"), F.lit(-1).alias("ordine")).select("doc_id", "f.*", "ordine")


def ordered(findings: DataFrame) -> list[Column]:
    """The order of findings: the sheet's own first, then by day, then by severity, then as emitted."""
    rank = F.when(F.col("gravita") == "errore", 0).when(F.col("gravita") == "attenzione", 1).otherwise(2)
    return [F.col("giorno").asc_nulls_first(), rank, F.col("ordine")]
