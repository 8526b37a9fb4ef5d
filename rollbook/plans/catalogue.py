"""All registered queries of the attendance engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import duplicates, reports, rules
from ..operators import rows as R
from ..operators import totals as T
from ..session import cut
from . import adapter
from .model import CODES, DAY_FIELDS, LABELS, codes
from .pipeline import Validated, validate

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def on_events(sql: str) -> str:
    return adapter.SQL + sql


def _all(spark: SparkSession, sf_dir: str) -> Validated:
    return validate(adapter.sheets(spark, sf_dir), adapter.rows(spark, sf_dir))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.typed(adapter.rows(spark, sf_dir))


#: Sums of the workbook by sheet, as a further table expression.
_SUMS = """, xs AS (SELECT doc_id, round(coalesce(sum(mp / 60.0), 0), 2) AS prog, round(coalesce(sum(me / 60.0), 0), 2) AS calc, round(coalesce(sum(dich_raw), 0), 2) AS dich,
  round(coalesce(sum(CASE WHEN op THEN 0.0 ELSE coalesce(dich_raw, me / 60.0) END), 0), 2) AS ric, count(*) FILTER (CASE WHEN op THEN 0.0 ELSE coalesce(dich_raw, me / 60.0) END > 0) AS giorni,
  count(*) FILTER (al) AS ass_al, count(*) FILTER (op) AS ass_op, count(*) FILTER (firma) AS firme FROM x GROUP BY doc_id) """

_ROW_FINDINGS = """, f AS (
SELECT doc_id, giorno, 'E03_ORARIO_NON_VALIDO' AS codice, 'errore' AS gravita, 'eff_entrata' AS campo FROM x WHERE ee_w AND ee IS NULL
UNION ALL SELECT doc_id, giorno, 'E03_ORARIO_NON_VALIDO', 'errore', 'eff_uscita' FROM x WHERE eu_w AND eu IS NULL
UNION ALL SELECT doc_id, giorno, 'E03_ORARIO_NON_VALIDO', 'errore', 'eff_uscita' FROM x WHERE eu <= ee
UNION ALL SELECT doc_id, giorno, 'E03_ORARIO_NON_VALIDO', 'errore', 'eff_uscita' FROM x WHERE ee IS NOT NULL AND NOT eu_w
UNION ALL SELECT doc_id, giorno, 'E01_ORE_NON_COERENTI', 'errore', 'ore_dichiarate' FROM x WHERE dich_raw > 24
UNION ALL SELECT doc_id, giorno, 'E01_ORE_NON_COERENTI', 'errore', 'ore_dichiarate' FROM x WHERE abs(dich - me / 60.0) > 0.01 AND NOT op AND NOT (al AND dich < me / 60.0)
UNION ALL SELECT doc_id, giorno, 'W12_ORE_NON_INDICATE', 'attenzione', 'ore_dichiarate' FROM x WHERE me IS NOT NULL AND dich_raw IS NULL AND NOT x_ore AND NOT op
UNION ALL SELECT doc_id, giorno, 'W02_ORE_SENZA_ORARIO', 'attenzione', 'ore_dichiarate' FROM x WHERE dich > 0.01 AND NOT eff_w AND NOT al AND NOT op
UNION ALL SELECT doc_id, giorno, 'W01_FIRMA_MANCANTE', 'attenzione', 'firma' FROM x WHERE prest AND NOT firma AND NOT op AND NOT i_firma
UNION ALL SELECT doc_id, giorno, 'W03_GIORNO_FESTIVO', CASE WHEN tipo = 'sabato' THEN 'info' ELSE 'attenzione' END, NULL FROM x WHERE prest AND NOT op AND tipo <> 'feriale'
UNION ALL SELECT doc_id, giorno, 'W05_ASSENZA_OPERATORE_CON_ORE', 'attenzione', 'assenza_operatore' FROM x WHERE op AND prest
UNION ALL SELECT doc_id, giorno, 'W11_DOPPIA_ASSENZA', 'attenzione', 'assenza_alunno' FROM x WHERE al AND op
UNION ALL SELECT doc_id, giorno, 'I01_ASSENZA_ALUNNO', 'info', 'assenza_alunno' FROM x WHERE al
UNION ALL SELECT doc_id, giorno, 'I02_ASSENZA_OPERATORE', 'info', 'assenza_operatore' FROM x WHERE op
UNION ALL SELECT doc_id, giorno, 'I03_ORARIO_DIVERSO', 'info', CASE WHEN ee <> pe THEN 'eff_entrata' ELSE 'eff_uscita' END FROM x WHERE me IS NOT NULL AND mp IS NOT NULL AND NOT op AND (ee <> pe OR eu <> pu)
UNION ALL SELECT doc_id, giorno, 'I04_ORE_SENZA_PROGRAMMATO', 'info', 'prog_entrata' FROM x WHERE me IS NOT NULL AND NOT op AND NOT prog_w
UNION ALL SELECT doc_id, giorno, 'I05_NON_SVOLTO', 'info', 'eff_entrata' FROM x WHERE prog_w AND NOT eff_w AND (dich_raw IS NULL OR dich <= 0.01) AND NOT x_ore AND NOT al AND NOT op
UNION ALL SELECT doc_id, giorno, 'E05_CAMPO_ILLEGGIBILE', 'errore', 'ore_dichiarate' FROM x WHERE x_ore
UNION ALL SELECT doc_id, giorno, 'E05_CAMPO_ILLEGGIBILE', 'attenzione', 'note' FROM x WHERE x_note
UNION ALL SELECT doc_id, giorno, 'W04_CAMPO_INCERTO', 'attenzione', 'eff_entrata' FROM x WHERE i_ee
UNION ALL SELECT doc_id, giorno, 'W04_CAMPO_INCERTO', 'attenzione', 'firma' FROM x WHERE i_firma) """

_WEEKS = """, wk AS (SELECT doc_id, settimana, round(sum(ric), 2) AS ore, bool_or(tipo = 'sabato' AND (ric > 0 OR prog_w OR eff_w)) AS sab FROM x GROUP BY ALL),
sat AS (SELECT doc_id, bool_or(sab) AS sab FROM wk GROUP BY doc_id),
cal AS (SELECT d.doc_id, pei, coalesce(sat.sab, false) AS sab, CAST(g AS INTEGER) AS g, isodow(make_date(anno, mese, CAST(g AS INTEGER))) AS dow, CAST((g + isodow(make_date(anno, mese, 1)) - 2) // 7 + 1 AS INTEGER) AS settimana, (mese = 1 AND g IN (1, 6)) AS festa
  FROM (SELECT *, unnest(range(1, day(last_day(make_date(anno, mese, 1))) + 1)) AS g FROM d) d LEFT JOIN sat USING (doc_id)),
wb AS (SELECT doc_id, settimana, any_value(pei) AS pei, min(g) AS dal, max(g) AS al_, count(*) FILTER (NOT festa AND (dow < 6 OR (dow = 6 AND sab))) * any_value(pei) * 1.0 / any_value(CASE WHEN sab THEN 6 ELSE 5 END) AS share FROM cal GROUP BY ALL),
weeks AS (SELECT wb.doc_id, wb.settimana, dal, al_ AS "al", CAST(coalesce(ore, 0) AS DECIMAL(9,2)) AS ore, CAST(round(share, 2) AS DECIMAL(9,2)) AS ore_pei, CAST(pei AS DECIMAL(9,4)) AS ore_pei_doc FROM wb LEFT JOIN wk USING (doc_id, settimana)) """

_SHEET_FINDINGS = """, tt AS (SELECT doc_id, round(coalesce(sum(dich), 0), 2) AS tot FROM x GROUP BY doc_id),
g AS (
SELECT doc_id, 'W08_FIRMA_COORDINATORE_MANCANTE' AS codice, 'attenzione' AS gravita, 'firma_coordinatore' AS campo FROM d WHERE user_id % 3 = 0
UNION ALL SELECT doc_id, 'W09_TIMBRO_REFERENTE_MANCANTE', 'attenzione', 'timbro_referente' FROM d WHERE user_id % 4 = 0
UNION ALL SELECT doc_id, 'E05_CAMPO_ILLEGGIBILE', 'attenzione', 'operatore' FROM d WHERE user_id % 53 = 0
UNION ALL SELECT doc_id, 'W04_CAMPO_INCERTO', 'attenzione', 'operatore' FROM d WHERE user_id % 7 = 0 AND user_id % 53 <> 0
UNION ALL SELECT doc_id, 'E02_TOTALE_MENSILE_DIVERSO', 'errore', 'totale_mensile_dichiarato' FROM d JOIN tt USING (doc_id) WHERE abs(tot - totale) > 0.01
UNION ALL SELECT doc_id, 'W10_TOTALE_MENSILE_ASSENTE', 'attenzione', 'totale_mensile_dichiarato' FROM d WHERE totale IS NULL
UNION ALL SELECT doc_id, 'W06_ORE_PEI_SUPERATE', 'attenzione', 'ore_pei' FROM weeks WHERE ore > ore_pei_doc + 0.01
UNION ALL SELECT doc_id, 'E06_NON_FOGLIO_FIRMA', 'errore', NULL FROM d WHERE NOT is_sheet) """

_STATES = """, af AS (SELECT doc_id, codice, gravita FROM f UNION ALL SELECT doc_id, codice, gravita FROM g),
fl AS (SELECT doc_id, sum(i) AS campi_incerti, sum(k) AS campi_illeggibili FROM (SELECT doc_id, i_ee::INT + i_firma::INT AS i, x_ore::INT + x_note::INT AS k FROM x UNION ALL SELECT doc_id, (user_id % 7 = 0 AND user_id % 53 <> 0)::INT, (user_id % 53 = 0)::INT FROM d) GROUP BY doc_id),
st AS (SELECT doc_id, CAST(campi_incerti AS BIGINT) AS campi_incerti, CAST(campi_illeggibili AS BIGINT) AS campi_illeggibili, coalesce(e, 0) AS n_errori, coalesce(w, 0) AS n_attenzioni, coalesce(i, 0) AS n_info, coalesce(m, 0) AS firme_mancanti,
  CASE WHEN e > 0 THEN 'errori' WHEN coalesce(w, 0) + campi_incerti + campi_illeggibili > 0 THEN 'da_verificare' ELSE 'ok' END AS stato
  FROM fl LEFT JOIN (SELECT doc_id, count(*) FILTER (gravita = 'errore') AS e, count(*) FILTER (gravita = 'attenzione') AS w, count(*) FILTER (gravita = 'info') AS i, count(*) FILTER (codice = 'W01_FIRMA_MANCANTE') AS m FROM af GROUP BY doc_id) USING (doc_id)) """

_EXPORT = "status = 'completato' AND is_sheet"


@query(on_events(_SUMS + f"""SELECT coalesce(op_key, '(illeggibile)') AS operatore, anno, mese, count(*) AS fogli, CAST(sum(ric) AS DECIMAL(18,2)) AS ore_riconosciute, CAST(sum(prog) AS DECIMAL(18,2)) AS ore_programmate,
CAST(round(sum(ric) / nullif(sum(prog), 0), 4) AS DOUBLE) AS quota FROM d JOIN xs USING (doc_id) WHERE {_EXPORT} GROUP BY ALL"""))  # fmt: skip
def hours_by_operator_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised hours by operator and month, and their share of the programmed ones."""
    from ..functions.values import name_key

    sheets = adapter.sheets(spark, sf_dir).where(duplicates.exportable())
    joined = sheets.join(reports.sheet_sums(_typed(spark, sf_dir)), "doc_id").withColumn("operatore", F.coalesce(F.nullif(name_key(F.col("operatore")), F.lit("")), F.lit("(illeggibile)")))
    out = joined.groupBy("operatore", "anno", "mese").agg(F.count(F.lit(1)).alias("fogli"), F.sum("ric").cast("decimal(18,2)").alias("ore_riconosciute"), F.sum("prog").cast("decimal(18,2)").alias("ore_programmate"))
    return out.withColumn("quota", F.round(F.try_divide("ore_riconosciute", "ore_programmate").cast("double"), 4))


@query(on_events("SELECT doc_id, giorno, pe AS min_prog_entrata, pu AS min_prog_uscita, ee AS min_eff_entrata, eu AS min_eff_uscita, mp AS min_prog, me AS min_eff, CAST(dich AS DECIMAL(9,4)) AS dich, round(CAST(ric AS DOUBLE), 4) AS ric, tipo, settimana FROM x"))
def day_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written times and hours as minutes and decimals, and the calendar's view of the day."""
    r = _typed(spark, sf_dir)
    return r.select("doc_id", "giorno", *(f"min_{c}" for c in ("prog_entrata", "prog_uscita", "eff_entrata", "eff_uscita", "prog", "eff")), "dich", F.round(F.col("ric").cast("double"), 4).alias("ric"), "tipo", "settimana")


@query(on_events(_ROW_FINDINGS + "SELECT * FROM f"))
def row_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of a row, in one pass."""
    return rules.row_findings(_typed(spark, sf_dir)).select("doc_id", "giorno", "codice", "gravita", "campo")


@query(on_events(_WEEKS + _SHEET_FINDINGS + "SELECT * FROM g WHERE codice <> 'E06_NON_FOGLIO_FIRMA'"))
def sheet_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a sheet as a whole."""
    sheets, rows = adapter.sheets(spark, sf_dir), _typed(spark, sf_dir)
    return rules.sheet_findings(sheets, T.month_totals(rows), T.week_totals(rows, sheets)).select("doc_id", "codice", "gravita", "campo")


@query(on_events("""SELECT doc_id, CAST(round(coalesce(sum(mp / 60.0), 0), 2) AS DECIMAL(9,2)) AS ore_programmate, CAST(round(coalesce(sum(me / 60.0), 0), 2) AS DECIMAL(9,2)) AS ore_calcolate,
CAST(round(coalesce(sum(dich), 0), 2) AS DECIMAL(9,2)) AS ore_dichiarate, CAST(round(sum(ric), 2) AS DECIMAL(9,2)) AS ore_riconosciute, count(*) FILTER (prog_w) AS giorni_programmati,
count(*) FILTER (NOT op AND ric > 0) AS giorni_lavorati, count(*) FILTER (al) AS assenze_alunno, count(*) FILTER (op) AS assenze_operatore FROM x GROUP BY doc_id"""))  # fmt: skip
def month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour sums, days and absences of each sheet."""
    return T.month_totals(_typed(spark, sf_dir))


@query(on_events(_WEEKS + "SELECT *, CAST(ore - ore_pei AS DECIMAL(9,2)) AS differenza FROM weeks"))
def week_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each week against its share of the weekly quota."""
    return T.week_totals(_typed(spark, sf_dir), adapter.sheets(spark, sf_dir))


@query(on_events(_ROW_FINDINGS + _WEEKS + _SHEET_FINDINGS + _STATES + "SELECT * FROM st"))
def sheet_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity, flag counts, and the state of each sheet."""
    return _all(spark, sf_dir).states


_PEERS = f""", k AS (SELECT doc_id, op_key, alunno, mese, anno FROM d WHERE {_EXPORT} AND op_key IS NOT NULL),
peers AS (SELECT a.doc_id, list(b.doc_id ORDER BY b.doc_id) AS peers FROM k a JOIN k b USING (op_key, alunno, mese, anno) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id) """


@query(on_events(_PEERS + ", sized AS (SELECT k.doc_id, min(o.doc_id) AS gruppo, count(*) AS fogli FROM k JOIN k o USING (op_key, alunno, mese, anno) GROUP BY k.doc_id) SELECT doc_id, array_to_string(peers, ',') AS peers, gruppo, fogli FROM peers JOIN sized USING (doc_id)"))
def possible_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of the same operator, pupil and month: their group, its size, and the others of it."""
    return duplicates.duplicate_peers(adapter.sheets(spark, sf_dir)).withColumn("peers", F.array_join("peers", ","))


@query(on_events(_ROW_FINDINGS + _WEEKS + _SHEET_FINDINGS + _STATES + _PEERS + f""", j AS (SELECT d.*, st.*EXCLUDE (doc_id), peers IS NOT NULL AS dup, {_EXPORT} AS done, (SELECT round(sum(ric), 2) FROM x WHERE x.doc_id = d.doc_id) AS ric FROM d LEFT JOIN st USING (doc_id) LEFT JOIN peers USING (doc_id))
SELECT count(*) AS documenti, count(*) FILTER (done) AS completati, CAST(coalesce(sum(ric) FILTER (done), 0) AS DECIMAL(18,2)) AS ore_totali, CAST(coalesce(sum(n_errori) FILTER (done), 0) AS BIGINT) AS errori, CAST(coalesce(sum(n_attenzioni + dup::INT) FILTER (done), 0) AS BIGINT) AS attenzioni,
CAST(coalesce(sum(campi_illeggibili) FILTER (done), 0) AS BIGINT) AS illeggibili, CAST(coalesce(sum(campi_incerti) FILTER (done), 0) AS BIGINT) AS incerti, count(*) FILTER (done AND (stato <> 'ok' OR dup) AND NOT verified) AS da_verificare, count(*) FILTER (done AND verified) AS verificati,
count(*) FILTER (done AND dup) AS possibili_duplicati, count(*) FILTER (done AND stato = 'errori') AS documenti_con_errori, count(*) FILTER (status = 'in_coda') AS in_coda, count(*) FILTER (status = 'in_lavorazione') AS in_lavorazione, count(*) FILTER (status = 'errore') AS errori_elaborazione, count(*) FILTER (status = 'scartato') AS scartati FROM j"""))  # fmt: skip
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's figures."""
    v = _all(spark, sf_dir)
    return duplicates.kpis(v.sheets, v.states, v.totals, duplicates.duplicates(v.sheets))


@query(on_events("SELECT s.status, count(d.doc_id) AS n FROM (SELECT unnest(['in_coda', 'in_lavorazione', 'completato', 'errore', 'scartato']) AS status) s LEFT JOIN d USING (status) GROUP BY 1"))
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets by status, zero included."""
    return duplicates.status_counts(adapter.sheets(spark, sf_dir))


@query(on_events(_SUMS + _ROW_FINDINGS + _WEEKS + _SHEET_FINDINGS + _STATES + f"""SELECT CAST(row_number() OVER (ORDER BY lower(operatore) NULLS LAST, anno, mese, lower(alunno), source_file, source_page, doc_id) AS BIGINT) AS n, doc_id, coalesce(operatore, '(illeggibile)') AS operatore, alunno, istituto, mese, anno,
CAST(prog AS DECIMAL(12,2)) AS prog, CAST(calc AS DECIMAL(12,2)) AS calc, CAST(dich AS DECIMAL(12,2)) AS dich, CAST(ric AS DECIMAL(12,2)) AS ric, CAST(round(ric / nullif(prog, 0), 4) AS DOUBLE) AS quota, giorni, ass_al, ass_op, firme, CAST(totale AS DECIMAL(9,4)) AS totale_mensile_dichiarato, n_errori AS errori, n_attenzioni AS attenzioni, stato
FROM d JOIN xs USING (doc_id) JOIN st USING (doc_id) WHERE {_EXPORT}"""))  # fmt: skip
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numbered row per exportable sheet."""
    v = _all(spark, sf_dir)
    return reports.summary(v.sheets, v.rows, v.states).withColumn("quota", F.col("quota").cast("double"))


#: What a day's row says in words: errors, else warnings, in order of emission; else what is written.
_OUTCOMES = f""", told AS (SELECT doc_id, giorno, codice, CASE WHEN gravita = 'errore' THEN 0 ELSE 1 END AS w, campo,
  CASE left(codice, 3) {' '.join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(["E03", "E01", "W12", "W02", "W01", "W03", "W05", "W11", "E05", "W04"]))} END AS o,
  CASE codice {' '.join(f"WHEN '{c}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for c, _, t in CODES)} END AS titolo,
  CASE campo {' '.join(f"WHEN '{k}' THEN '{v.lower().replace(chr(39), chr(39) * 2)}'" for k, v in LABELS.items())} END AS etichetta, CASE campo {' '.join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(DAY_FIELDS))} END AS posto FROM f WHERE gravita <> 'info'),
by_code AS (SELECT doc_id, giorno, w, o, CASE WHEN codice LIKE 'E05%' THEN 'illeggibile: ' || string_agg(etichetta, ', ' ORDER BY posto) WHEN codice LIKE 'W04%' THEN 'lettura incerta: ' || string_agg(etichetta, ', ' ORDER BY posto) ELSE any_value(titolo) END AS t FROM told GROUP BY doc_id, giorno, w, codice, o),
by_day AS (SELECT doc_id, giorno, w, string_agg(t, '; ' ORDER BY o) AS t FROM by_code GROUP BY doc_id, giorno, w),
line AS (SELECT doc_id, giorno, CASE WHEN min(w) = 0 THEN 'Errore: ' ELSE 'Da verificare: ' END || arg_min(t, w) AS problemi FROM by_day GROUP BY doc_id, giorno),
o AS (SELECT x.*, pe IS NOT NULL OR eff_w OR dich_raw IS NOT NULL OR al OR op OR firma OR nota OR x_ore OR x_note AS piena,
  coalesce(problemi, CASE WHEN op THEN 'Assenza operatore' WHEN al THEN 'Assenza alunno' WHEN NOT (pe IS NOT NULL OR eff_w OR dich_raw IS NOT NULL OR firma OR nota OR x_ore OR x_note) THEN '' WHEN prog_w AND NOT eff_w AND (dich_raw IS NULL OR coalesce(dich <= 0.01, false)) AND NOT x_ore THEN 'Non svolto' WHEN ric > 0 OR eff_w THEN 'OK' ELSE 'Non svolto' END) AS esito,
  CASE WHEN mese = 1 AND giorno = 1 THEN 'Capodanno' WHEN mese = 1 AND giorno = 6 THEN 'Epifania' END AS festivita FROM x LEFT JOIN line USING (doc_id, giorno)) """
_CLOCK = "CASE WHEN {0} IS NOT NULL THEN lpad(CAST({0} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0') END AS {1}"


@query(on_events(_ROW_FINDINGS + _OUTCOMES + f"""SELECT o.doc_id, coalesce(operatore, '(illeggibile)') AS operatore, alunno, istituto, o.anno, o.mese, giorno, tipo, festivita, {_CLOCK.format("pe", "prog_entrata")}, {_CLOCK.format("pu", "prog_uscita")}, {_CLOCK.format("ee", "eff_entrata")}, {_CLOCK.format("eu", "eff_uscita")},
CAST(round(mp / 60.0, 2) AS DECIMAL(12,2)) AS prog, CAST(round(me / 60.0, 2) AS DECIMAL(12,2)) AS calc, CAST(dich_raw AS DECIMAL(12,2)) AS dich, CAST(round(CASE WHEN op THEN 0.0 ELSE coalesce(dich_raw, me / 60.0) END, 2) AS DECIMAL(12,2)) AS ric, CAST(round(dich_raw - me / 60.0, 2) AS DECIMAL(12,2)) AS diff,
al AS assenza_alunno, op AS assenza_operatore, firma, CASE WHEN nota THEN 'permesso 104' END AS note, coalesce(nullif(esito, ''), festivita, '') AS esito FROM o JOIN d USING (doc_id) WHERE piena AND {_EXPORT}"""))  # fmt: skip
def detail_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per exportable sheet and day, with its outcome in words."""
    sheets, rows = adapter.sheets(spark, sf_dir), cut(_typed(spark, sf_dir))
    # the outcome follows from the rows' findings alone: weeks, totals and states aren't needed
    return reports.detail(sheets, rows, rules.row_findings(rows), codes(spark))


@query(on_events(_ROW_FINDINGS + _WEEKS + _SHEET_FINDINGS + f"""SELECT codice, gravita, count(*) AS n, count(DISTINCT doc_id) AS fogli FROM (SELECT doc_id, codice, gravita FROM f UNION ALL SELECT doc_id, codice, gravita FROM g) JOIN d USING (doc_id) WHERE {_EXPORT} GROUP BY ALL"""))
def findings_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of exportable sheets by code and severity."""
    v = _all(spark, sf_dir)
    table = reports.findings_table(v.sheets, v.findings, codes(spark))
    return table.groupBy("codice", "gravita").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("fogli"))


def _grouped_sql(label: str, other: str) -> str:
    return on_events(_SUMS + f""", b AS (SELECT {label} AS label, {other} AS other, xs.* FROM d JOIN xs USING (doc_id) WHERE {_EXPORT}),
q AS (SELECT min(label) AS gruppo, count(*) AS fogli, sum(ric) AS ric, sum(prog) AS prog, CAST(sum(giorni) AS BIGINT) AS giorni, CAST(sum(ass_al) AS BIGINT) AS ass_al, CAST(sum(ass_op) AS BIGINT) AS ass_op, array_to_string(list_sort(list(DISTINCT other)), ', ') AS altri FROM b GROUP BY lower(label)
UNION ALL SELECT NULL, count(*), sum(ric), sum(prog), CAST(sum(giorni) AS BIGINT), CAST(sum(ass_al) AS BIGINT), CAST(sum(ass_op) AS BIGINT), NULL FROM b)
SELECT gruppo, fogli, CAST(ric AS DECIMAL(18,2)) AS ric, CAST(prog AS DECIMAL(18,2)) AS prog, CAST(round(ric / nullif(prog, 0), 4) AS DOUBLE) AS quota, giorni, ass_al, ass_op, altri, coalesce(gruppo LIKE '(%', false) AS segnaposto FROM q""")  # fmt: skip


@query(_grouped_sql("coalesce(operatore, '(illeggibile)')", "alunno"))
def totals_by_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by operator with a section total."""
    return reports.grouped_totals(adapter.sheets(spark, sf_dir), _typed(spark, sf_dir), "operatore", "alunno").withColumn("quota", F.col("quota").cast("double"))


@query(_grouped_sql("alunno", "coalesce(operatore, '(illeggibile)')"))
def totals_by_pupil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by pupil with a section total."""
    return reports.grouped_totals(adapter.sheets(spark, sf_dir), _typed(spark, sf_dir), "alunno", "operatore").withColumn("quota", F.col("quota").cast("double"))


@query(_grouped_sql("istituto", "coalesce(operatore, '(illeggibile)')"))
def totals_by_school(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by school with a section total."""
    return reports.grouped_totals(adapter.sheets(spark, sf_dir), _typed(spark, sf_dir), "istituto", "operatore").withColumn("quota", F.col("quota").cast("double"))


@query(on_events(_SUMS + f"""SELECT lower(istituto) AS gruppo, CAST(sum(ric) FILTER (anno = 2024 AND mese = 1) AS DECIMAL(18,2)) AS "2024-01", CAST(sum(ric) FILTER (anno = 2024 AND mese = 2) AS DECIMAL(18,2)) AS "2024-02" FROM d JOIN xs USING (doc_id) WHERE {_EXPORT} GROUP BY 1"""))
def hours_pivot_by_school(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised hours by school and month."""
    return reports.month_pivot(adapter.sheets(spark, sf_dir), _typed(spark, sf_dir), "istituto", ["2024-01", "2024-02"])


@query(on_events("SELECT engine, model, count(*) AS documenti, CAST(round(avg(confidence), 4) AS DOUBLE) AS confidenza FROM d GROUP BY ALL"))
def reader_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets and mean confidence by reader."""
    return reports.reader_statistics(adapter.sheets(spark, sf_dir))


@query(on_events("SELECT doc_id, source_file, source_page FROM d WHERE contains(lower(concat_ws(' ', operatore, alunno, istituto, 'Coop', source_file, mese, anno)), 'rossi') AND contains(lower(concat_ws(' ', operatore, alunno, istituto, 'Coop', replace(source_file, '.', ' '), mese, anno)), 'scan1')"))
def sheet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets that hold all words of a search."""
    return reports.search(adapter.sheets(spark, sf_dir), "róssi SCAN1").select("doc_id", "source_file", "source_page")


@query("""WITH y AS (SELECT unnest(range(2000, 2101)) AS anno), p AS (SELECT anno, anno % 19 AS a, anno // 100 AS b, anno % 100 AS c FROM y),
q AS (SELECT anno, a, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h, b, c FROM p),
w AS (SELECT anno, a, h, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM q), e AS (SELECT anno, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS z FROM w),
pasqua AS (SELECT anno, make_date(CAST(anno AS INTEGER), CAST(z // 31 AS INTEGER), CAST(z % 31 + 1 AS INTEGER)) AS pasqua FROM e),
dd AS (SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2100-12-31', INTERVAL 1 DAY)) AS DATE) AS data),
k AS (SELECT data, year(data) AS anno, month(data) AS mese, day(data) AS giorno, isodow(data) AS dow, data = pasqua OR data = pasqua + 1 OR (month(data), day(data)) IN ((1,1),(1,6),(4,25),(5,1),(6,2),(8,15),(9,19),(11,1),(12,8),(12,25),(12,26)) OR (month(data) = 10 AND day(data) = 4 AND year(data) >= 2026) AS festa FROM dd JOIN pasqua ON year(data) = pasqua.anno)
SELECT anno, mese, CASE WHEN festa THEN 'festivo' WHEN dow = 7 THEN 'domenica' WHEN dow = 6 THEN 'sabato' ELSE 'feriale' END AS tipo, CAST((giorno + isodow(make_date(anno, mese, 1)) - 2) // 7 + 1 AS INTEGER) AS settimana, count(*) AS n, CAST(min(giorno) AS INTEGER) AS primo FROM k GROUP BY ALL""")  # fmt: skip
def school_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each kind by month and week, 2000 to 2100."""
    return calendar.days(spark).groupBy("anno", "mese", "tipo", "settimana").agg(F.count(F.lit(1)).alias("n"), F.min("giorno").alias("primo"))


_CELLS = """, c AS (SELECT doc_id, giorno, 'eff_entrata' AS campo, ee // 60 AS value FROM x WHERE ee IS NOT NULL UNION ALL SELECT doc_id, giorno, 'prog_entrata', pe FROM x WHERE pe IS NOT NULL) """


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _typed(spark, sf_dir)
    one = lambda f, v: r.select("doc_id", "giorno", F.lit(f).alias("campo"), v.cast("int").alias("value"))
    return one("eff_entrata", F.floor(F.col("min_eff_entrata") / 60)).unionByName(one("prog_entrata", F.col("min_prog_entrata")))


@query(on_events(_CELLS + """, o AS (SELECT a.doc_id, a.campo, a.giorno, a.value, count(b.giorno) AS n, count(*) FILTER (b.value = a.value) AS same, min(b.value) AS minimo, max(b.value) AS massimo FROM c a LEFT JOIN c b ON a.doc_id = b.doc_id AND a.campo = b.campo AND a.giorno <> b.giorno GROUP BY ALL),
m AS (SELECT doc_id, campo, giorno, arg_max(v, (k, -v)) AS v, max(k) AS k FROM (SELECT a.doc_id, a.campo, a.giorno, b.value AS v, count(*) AS k FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.campo = b.campo AND a.giorno <> b.giorno GROUP BY ALL) GROUP BY ALL)
SELECT o.doc_id, o.campo, o.giorno, o.value, CASE WHEN n >= 3 THEN round(same * 1.0 / n, 6) END AS quota, CASE WHEN k >= 0.6 * n THEN v END AS dominante, minimo, massimo FROM o LEFT JOIN m USING (doc_id, campo, giorno)"""))  # fmt: skip
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out statistics of a sheet's columns, without a self-join."""
    from ..operators import readings

    return readings.column_statistics(_cells(spark, sf_dir)).withColumn("quota", F.col("quota").cast("double"))


@query(on_events(_CELLS + "SELECT a.doc_id, a.campo, a.giorno, a.value, count(b.giorno) >= 2 AND bool_and(coalesce(b.value = a.value, true)) AND count(b.giorno) >= 2 AS pari FROM c a LEFT JOIN c b ON a.doc_id = b.doc_id AND a.campo = b.campo AND a.giorno <> b.giorno AND (a.giorno - b.giorno) % 7 = 0 GROUP BY ALL"))
def weekday_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all cells of the same weekday agree."""
    from ..operators import readings

    return readings.weekday_peers(_cells(spark, sf_dir))


@query(on_events(_ROW_FINDINGS + _WEEKS + _SHEET_FINDINGS + """SELECT DISTINCT doc_id, giorno FROM (SELECT doc_id, giorno FROM f WHERE left(codice, 3) IN ('E01', 'E03', 'W01', 'W02', 'W05', 'W11', 'E05', 'W04')
UNION ALL SELECT doc_id, giorno FROM x WHERE i_ee OR i_firma OR x_ore OR x_note UNION ALL SELECT doc_id, giorno FROM x JOIN (SELECT DISTINCT doc_id FROM g WHERE codice LIKE 'E02%') USING (doc_id) WHERE dich_raw IS NOT NULL OR ric > 0)"""))  # fmt: skip
def rows_to_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that a second, targeted reading should look at."""
    from ..operators import readings

    v = _all(spark, sf_dir)
    return readings.rows_to_reread(v.rows, v.findings)


@query(on_events("""SELECT doc_id, anno, mese, CAST(sum(CASE WHEN tipo = 'sabato' THEN -0.5 WHEN tipo = 'feriale' THEN 0 ELSE -1.5 END) AS DOUBLE) AS penalty FROM (SELECT x.doc_id, h.anno, h.mese,
CASE WHEN x.giorno > day(last_day(make_date(h.anno, h.mese, 1))) THEN 'inesistente' ELSE CASE WHEN (h.mese = 1 AND x.giorno IN (1, 6)) THEN 'festivo' WHEN isodow(make_date(h.anno, h.mese, least(x.giorno, day(last_day(make_date(h.anno, h.mese, 1)))))) = 7 THEN 'domenica' WHEN isodow(make_date(h.anno, h.mese, least(x.giorno, day(last_day(make_date(h.anno, h.mese, 1)))))) = 6 THEN 'sabato' ELSE 'feriale' END END AS tipo
FROM x, (SELECT unnest([2023, 2024, 2025]) AS anno, 1 AS mese UNION ALL SELECT 2024, 2) h WHERE prest) GROUP BY ALL"""))  # fmt: skip
def calendar_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How badly the worked days fit a month and year."""
    from ..operators import readings
    from ..operators.rows import pair_written

    r = _typed(spark, sf_dir)
    worked = r.where(pair_written("eff") | F.coalesce(F.col("dich") > 0.01, F.lit(False))).select("doc_id", "giorno")
    hypotheses = spark.createDataFrame([(1, 2023), (1, 2024), (1, 2025), (2, 2024)], "mese int, anno int")
    return readings.calendar_penalty(worked, hypotheses).withColumn("penalty", F.col("penalty").cast("double"))


@query(on_events("SELECT doc_id, campo, chiave, valore FROM (SELECT doc_id, 'alunno' AS campo, concat(user_id % 60, ' AL') AS chiave, alunno AS valore, user_id FROM d WHERE verified AND is_sheet UNION ALL SELECT doc_id, 'istituto', concat(user_id % 10, ' IC'), istituto, user_id FROM d WHERE verified AND is_sheet UNION ALL SELECT doc_id, 'ente', 'COOP', 'Coop', user_id FROM d WHERE verified AND is_sheet UNION ALL SELECT doc_id, 'operatore', op_key, operatore, user_id FROM d WHERE verified AND is_sheet AND user_id % 7 <> 0 AND operatore IS NOT NULL)"))
def registry_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What confirmed sheets teach the registry."""
    from ..operators import registry

    sheets = adapter.sheets(spark, sf_dir).withColumns({"updated_at": F.col("doc_id"), "user_edited": F.array().cast("array<string>")})
    return registry.contributions(sheets).drop("aggiornato")


@query(on_events("SELECT campo, chiave, count(DISTINCT doc_id) AS conteggio FROM (SELECT doc_id, 'alunno' AS campo, concat(user_id % 60, ' AL') AS chiave FROM d WHERE verified AND is_sheet UNION ALL SELECT doc_id, 'istituto', concat(user_id % 10, ' IC') FROM d WHERE verified AND is_sheet UNION ALL SELECT doc_id, 'ente', 'COOP' FROM d WHERE verified AND is_sheet UNION ALL SELECT doc_id, 'operatore', op_key FROM d WHERE verified AND is_sheet AND user_id % 7 <> 0 AND operatore IS NOT NULL) GROUP BY ALL"))
def registry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries with the number of documents behind them."""
    from ..operators import registry

    sheets = adapter.sheets(spark, sf_dir).withColumns({"updated_at": F.col("doc_id"), "user_edited": F.array().cast("array<string>")})
    return registry.values(registry.contributions(sheets)).select("campo", "chiave", "conteggio")


@query()
def registry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misread part names matched back to the catalogue of names: decisions and their counts."""
    from ..operators import registry

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    from ..functions.values import name_key

    vocabulary = part.select(F.lit("istituto").alias("campo"), name_key(F.col("p_name")).alias("chiave"), F.col("p_name").alias("valore")).groupBy("campo", "chiave").agg(F.min("valore").alias("valore"))
    read = part.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit("istituto").alias("campo"), F.when(F.col("p_partkey") % 2 == 0, F.translate("p_name", "oi", "01")).otherwise(F.col("p_name")).alias("letto"))
    return registry.match(read, vocabulary).select("doc_id", "letto", "esito", "valore", "somiglianza", "incerto")


@query("SELECT o_custkey AS key, o_orderkey AS gen, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each key only the result of the latest generation."""
    from ..streaming import ingest

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("gen"), F.col("o_orderstatus").alias("status"))
    return ingest.latest(o, "key", "gen")


@query("SELECT o_custkey AS doc_id, o_orderpriority AS campo, arg_min(o_orderstatus, o_orderkey) AS originale, arg_max(chr(CAST(68 + o_orderkey % 5 AS INTEGER)), o_orderkey) AS valore, arg_min(o_orderstatus, o_orderkey) <> arg_max(chr(CAST(68 + o_orderkey % 5 AS INTEGER)), o_orderkey) AS modificato FROM orders GROUP BY ALL")
def edit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the latest value of edited fields."""
    from ..streaming import ingest

    log = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("campo"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("old"), F.char((F.col("o_orderkey") % 5 + 68).cast("int")).alias("new"))
    return ingest.edit_state(log)


@query(on_events("SELECT i.pos, d.doc_id, status FROM (SELECT generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS doc_id FROM (SELECT ['5-2024-1', '3-2024-1', '5-2024-1', '9-2024-1', 'none'] AS l)) i JOIN d USING (doc_id)"))
def selected_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets by a list of ids: its order and repeats are kept."""
    ids = spark.createDataFrame([(k, x) for k, x in enumerate(["5-2024-1", "3-2024-1", "5-2024-1", "9-2024-1", "none"])], "pos long, doc_id string")
    return ids.join(adapter.sheets(spark, sf_dir), "doc_id").select("pos", "doc_id", "status")


_CHOICES = """, g AS (SELECT * FROM (VALUES (0, 0, -0.5::DOUBLE), (1, 30, -1.2::DOUBLE), (2, -60, -2.5::DOUBLE)) t(i, s, lp)),
v AS (SELECT doc_id, giorno, al, pe, pu, ee, eu, CAST(dich * 60 AS INTEGER) AS h FROM x WHERE pe IS NOT NULL OR pu IS NOT NULL OR ee IS NOT NULL OR eu IS NOT NULL OR dich IS NOT NULL),
c AS (SELECT doc_id, giorno, al, a.i AS i0, b.i AS i1, c.i AS i2, d.i AS i3, e.i AS i4, pe + a.s AS pe, pu + b.s AS pu, ee + c.s AS ee, eu + d.s AS eu, h + e.s AS h,
  CASE WHEN v.pe IS NULL THEN 0 ELSE a.lp END + CASE WHEN v.pu IS NULL THEN 0 ELSE b.lp END + CASE WHEN v.ee IS NULL THEN 0 ELSE c.lp END + CASE WHEN v.eu IS NULL THEN 0 ELSE d.lp END + CASE WHEN v.h IS NULL THEN 0 ELSE e.lp END AS lp
  FROM v, g a, g b, g c, g d, g e WHERE (v.pe IS NOT NULL OR a.i = 0) AND (v.pu IS NOT NULL OR b.i = 0) AND (v.ee IS NOT NULL OR c.i = 0) AND (v.eu IS NOT NULL OR d.i = 0) AND (v.h IS NOT NULL OR e.i = 0)),
k AS (SELECT *, CASE WHEN eu > ee THEN eu - ee END AS de, CASE WHEN pu > pe THEN pu - pe END AS dp FROM c),
z AS (SELECT *, lp + coalesce(CASE WHEN pu <= pe THEN -8.0 WHEN pu - pe < 30 OR pu - pe > 480 THEN -3.0 ELSE 0 END, 0) + coalesce(CASE WHEN eu <= ee THEN -8.0 WHEN eu - ee < 30 OR eu - ee > 480 THEN -3.0 ELSE 0 END, 0)
  + CASE WHEN pe = ee THEN 1.0 ELSE 0 END + CASE WHEN pu = eu THEN 1.0 ELSE 0 END + CASE WHEN abs(de - h) < 0.6 THEN 2.5 WHEN de IS NOT NULL AND h IS NOT NULL AND NOT (al AND h < de) THEN -2.0 ELSE 0 END
  + CASE WHEN abs(dp - h) < 0.6 THEN 0.5 WHEN dp IS NOT NULL AND h IS NOT NULL AND (ee IS NULL OR eu IS NULL) THEN CASE WHEN h <= dp + 0.6 THEN 0.3 ELSE -1.0 END ELSE 0 END AS score FROM k)
SELECT doc_id, giorno, pe AS prog_entrata, pu AS prog_uscita, ee AS eff_entrata, eu AS eff_uscita, h AS ore_dichiarate, round(CAST(score AS DOUBLE), 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, giorno ORDER BY round(CAST(score AS DOUBLE), 9) DESC, i0, i1, i2, i3, i4) AS r FROM z) WHERE r = 1"""


@query(on_events(_CHOICES))
def reconciled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest coherent values of each row, from three alternatives of each field."""
    from ..operators import readings
    from .model import HOUR_FIELDS

    r = _typed(spark, sf_dir)
    value = {f: F.col(f"min_{f}") for f in HOUR_FIELDS[:4]} | {"ore_dichiarate": (F.col("dich") * 60).cast("int")}
    options = lambda v: F.array(*(F.struct((v + d).cast("int").alias("value"), F.lit(p).alias("logprob")) for d, p in ((0, -0.5), (30, -1.2), (-60, -2.5))))
    cells = F.array(*(F.struct(F.lit(f).alias("campo"), v.isNotNull().alias("known"), options(v).alias("candidates")) for f, v in value.items()))
    read = r.select("doc_id", "giorno", F.explode(cells).alias("c")).select("doc_id", "giorno", "c.*").where("known").drop("known")
    return readings.best_rows(read, r.select("doc_id", "giorno", F.col("assenza_alunno").alias("assente"))).withColumn("score", F.round("score", 6))


@query(on_events(""", u AS (SELECT doc_id, giorno, 'prog_entrata' AS campo, pe AS m FROM x WHERE pe IS NOT NULL UNION ALL SELECT doc_id, giorno, 'prog_uscita', pu FROM x WHERE pu IS NOT NULL UNION ALL SELECT doc_id, giorno, 'eff_entrata', ee FROM x WHERE ee IS NOT NULL AND NOT i_ee UNION ALL SELECT doc_id, giorno, 'eff_uscita', eu FROM x WHERE eu IS NOT NULL)
SELECT a.doc_id, a.giorno, a.campo FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.giorno <> b.giorno GROUP BY a.doc_id, a.giorno, a.campo, a.m HAVING count(*) >= 6 AND (a.m > max(b.m) + 90 OR a.m < min(b.m) - 90)"""))  # fmt: skip
def time_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure times far beyond those of all other days of the sheet."""
    from ..operators import evidence

    return evidence.time_outliers(_typed(spark, sf_dir))


@query(on_events(""", h AS (SELECT doc_id, (ee % 60)::INT AS minuto, count(*) AS n FROM x WHERE ee IS NOT NULL GROUP BY ALL), k AS (SELECT doc_id, mk AS minuto, CASE mk WHEN 0 THEN 3.0 WHEN 30 THEN 2.0 WHEN 15 THEN 0.5 WHEN 45 THEN 0.5 ELSE 0.02 END AS ps, mk IN (0, 15, 30, 45) AS q FROM (SELECT DISTINCT doc_id FROM x), (SELECT unnest(range(0, 60, 5)) AS mk)),
c AS (SELECT k.doc_id, k.minuto, q, CAST(ps + CASE WHEN q OR n >= 3 THEN coalesce(n, 0) ELSE 0 END AS DOUBLE) AS c FROM k LEFT JOIN h USING (doc_id, minuto))
SELECT c.doc_id, CAST(c.minuto AS INTEGER) AS minuto, round(CASE WHEN c.minuto = 0 THEN 0.0 ELSE greatest(CASE WHEN c.q OR c.c >= 3 THEN -2.5 ELSE -5.0 END, least(0.0, ln(c.c / z.c))) END, 6) AS peso FROM c JOIN c z ON c.doc_id = z.doc_id AND z.minuto = 0"""))  # fmt: skip
def minute_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preference for each minute mark on a sheet."""
    from ..operators import evidence

    return evidence.minute_prior(_typed(spark, sf_dir).select("doc_id", F.col("min_eff_entrata").alias("minuti")))


@query(on_events("SELECT doc_id, CAST(sum((pe IS NOT NULL)::INT + (pu IS NOT NULL)::INT + (ee_w OR i_ee)::INT + eu_w::INT + (dich_raw IS NOT NULL OR x_ore)::INT) AS BIGINT) AS celle, CAST(sum(i_ee::INT + x_ore::INT) AS BIGINT) AS dubbie FROM x GROUP BY doc_id"))
def doubtful_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of times and hours of each sheet, and how many are in doubt."""
    from ..plans.model import HOUR_FIELDS

    r = adapter.rows(spark, sf_dir)
    doubt = lambda f: F.array_contains("incerti", f) | F.array_contains("illeggibili", f)
    return r.groupBy("doc_id").agg(sum((F.sum((F.col(f).isNotNull() | doubt(f)).cast("int")) for f in HOUR_FIELDS[1:]), F.sum((F.col(HOUR_FIELDS[0]).isNotNull() | doubt(HOUR_FIELDS[0])).cast("int"))).alias("celle"), sum((F.sum(doubt(f).cast("int")) for f in HOUR_FIELDS[1:]), F.sum(doubt(HOUR_FIELDS[0]).cast("int"))).alias("dubbie"))


@query(on_events("SELECT strftime(make_date(min(anno), 1, 1), '%Y') || '-' || lpad(CAST(min(mese) AS VARCHAR), 2, '0') AS dal, strftime(make_date(max(anno), 1, 1), '%Y') || '-' || lpad(CAST(max(mese) AS VARCHAR), 2, '0') AS al, 'presenze_2024-01.xlsx' AS file, 'Coop' AS ente FROM d"))
def report_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's period, file name and entity."""
    from ..operators import payloads

    return payloads.caption(adapter.sheets(spark, sf_dir))


_MONTHS = "['gennaio', 'febbraio', 'marzo', 'aprile', 'maggio', 'giugno', 'luglio', 'agosto', 'settembre', 'ottobre', 'novembre', 'dicembre']"


@query(on_events(_ROW_FINDINGS + _WEEKS + _SHEET_FINDINGS + _STATES + f""", mt AS (SELECT doc_id, round(sum(ric), 2) AS ric, round(coalesce(sum(dich), 0), 2) AS dich, count(*) FILTER (NOT op AND ric > 0) AS giorni FROM x GROUP BY doc_id)
SELECT d.doc_id, d.doc_id AS id, CASE WHEN operatore IS NOT NULL THEN operatore || ' – ' || {_MONTHS}[mese] || ' ' || anno ELSE source_file || ' – pagina ' || source_page END AS display_name, status, is_sheet AS is_foglio_firma, operatore, CAST(pei AS DOUBLE) AS ore_pei, CAST(mt.ric AS DOUBLE) AS ore_riconosciute, CAST(mt.dich AS DOUBLE) AS ore_dichiarate,
mt.giorni AS giorni_lavorati, CAST(totale AS DOUBLE) AS totale, n_errori, n_attenzioni, campi_illeggibili, stato FROM d JOIN mt USING (doc_id) JOIN st USING (doc_id)"""))  # fmt: skip
def sheet_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sheet's summary: the JSON payload, read back field by field."""
    from ..operators import payloads

    v = _all(spark, sf_dir)
    told = F.from_json("payload", "id string, display_name string, status string, is_foglio_firma boolean, header struct<operatore:string,ore_pei:double>, totals struct<ore_riconosciute:double,ore_dichiarate:double,giorni_lavorati:bigint,totale_mensile_dichiarato:double,n_errori:bigint,n_attenzioni:bigint,campi_illeggibili:bigint,stato:string>")
    read = payloads.summaries(v.sheets, v.totals, v.states).select("doc_id", told.alias("p"))
    return read.select("doc_id", "p.id", "p.display_name", "p.status", "p.is_foglio_firma", "p.header.*", "p.totals.*").withColumnRenamed("totale_mensile_dichiarato", "totale")


def queries() -> dict:
    from . import fieldwork, further

    return _QUERIES | further.QUERIES | fieldwork.QUERIES


def oracle_sql() -> dict:
    from . import fieldwork, further

    return _SQL | further.SQL | fieldwork.SQL
