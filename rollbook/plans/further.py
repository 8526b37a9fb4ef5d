"""More registered queries: written values, lists, the workbook's tables, doubts, lexicons, queues and neighbours, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import inputs, lexicons, messages
from ..functions import values as V
from ..operators import doubts, duplicates, lists, neighbours, reports, workbook
from ..operators import rows as R
from ..operators import totals as T
from ..session import cut
from ..streaming import queue
from . import adapter
from .catalogue import _EXPORT, _ROW_FINDINGS, _SHEET_FINDINGS, _STATES, _WEEKS, on_events
from .model import codes
from .pipeline import validate

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _pick(n: int, *texts) -> F.Column:
    return F.element_at(F.array(*texts), (F.col("k") % n + 1).cast("int"))


_K = "WITH w AS (SELECT o_orderkey AS k, CAST(o_orderkey % 27 AS INTEGER) AS h, CAST((o_orderkey * 7) % 75 AS INTEGER) AS m FROM orders) "


@query(_K + """SELECT k, CASE WHEN h > 23 THEN NULL WHEN k % 9 = 4 THEN h * 60 WHEN k % 9 = 8 THEN NULL WHEN m > 59 THEN NULL ELSE h * 60 + m END AS minuti FROM w""")
def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in nine ways of writing them, read back as minutes of the day."""
    w = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 27).alias("h"), (F.col("o_orderkey") * 7 % 75).alias("m"))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    h, m, hh = F.col("h").cast("string"), two("m"), two("h")
    join = lambda s: F.concat(h, F.lit(s), m)
    text = _pick(9, join(":"), join("."), F.concat(F.lit(" ore "), h, F.lit(" , "), m), F.concat(hh, m), F.concat(F.lit("alle "), h), F.translate(join("h"), "01", "ol"), F.concat(join(":"), F.lit(":59")), join(" "), F.concat(join(":"), F.lit("-"), m))
    return V.with_times(w.select("k", text.alias("testo")), {"minuti": "testo"}).select("k", "minuti")


@query(_K + """SELECT k, CAST(round(CASE WHEN v BETWEEN 0 AND 24 THEN v END, 4) AS DOUBLE) AS ore FROM (SELECT k, CASE k % 10 WHEN 0 THEN CAST(h AS DOUBLE) WHEN 1 THEN h + (k % 4) / 4.0 WHEN 2 THEN CASE WHEN m <= 59 THEN h + m / 60.0 END WHEN 3 THEN CASE WHEN m <= 59 THEN h + m / 60.0 END WHEN 4 THEN h + 0.5 WHEN 5 THEN h + 0.75
WHEN 6 THEN CASE WHEN m <= 59 THEN h + m / 60.0 END WHEN 7 THEN m / 60.0 WHEN 8 THEN 0.5 ELSE NULL END AS v FROM w)""")
def written_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in ten ways of writing them, read back as decimals."""
    k = F.col("o_orderkey")
    w = _orders(spark, sf_dir).select(k.alias("k"), (k % 27).alias("h"), (k * 7 % 75).alias("m"))
    h, m, mm = F.col("h").cast("string"), F.col("m").cast("string"), F.lpad(F.col("m").cast("string"), 2, "0")
    quarter = F.element_at(F.array(*map(F.lit, ["0", "25", "5", "75"])), (F.col("k") % 4 + 1).cast("int"))
    text = _pick(10, F.concat(h, F.lit(" ore")), F.concat(h, F.lit(","), quarter), F.concat(h, F.lit(":"), mm), F.concat(h, F.lit("h"), mm, F.lit("'")), F.concat(h, F.lit(" e mezza")), F.concat(h, F.lit("¾")), F.concat(h, F.lit(" ora e "), m), F.concat(m, F.lit(" minuti")), F.lit("mezz'ora"), F.concat(F.lit("-"), h))
    return w.select("k", F.round(V.hours(text), 4).cast("double").alias("ore"))


@query(_K + """SELECT k, CASE k % 4 WHEN 0 THEN CASE WHEN h <= 24 THEN CAST(h AS DOUBLE) END END AS ore, k % 4 = 1 AS trattino, CASE WHEN k % 4 = 0 AND h > 24 THEN 'intervallo' WHEN k % 4 = 2 THEN 'valore' END AS errore,
CASE WHEN k % 3 = 0 THEN CASE WHEN h <= 23 AND m <= 59 THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') ELSE h || '.' || lpad(CAST(m AS VARCHAR), 2, '0') END WHEN k % 3 = 1 THEN 'boh' END AS orario FROM w""")
def typed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours and times as people type them: values, dashes, and kinds of errors."""
    k = F.col("o_orderkey")
    w = _orders(spark, sf_dir).select(k.alias("k"), (k % 27).alias("h"), (k * 7 % 75).alias("m"))
    hours = inputs.typed_hours(_pick(4, F.concat("h", F.lit(" h")), F.lit(" – "), F.lit("tante"), F.lit("  ")))
    time = inputs.typed_time(_pick(3, F.concat("h", F.lit("."), F.lpad(F.col("m").cast("string"), 2, "0")), F.lit("boh"), F.lit("__")))
    got = w.select("k", hours.alias("o"), time.alias("t"))
    kind = F.when(F.contains("o.error", F.lit("fuori intervallo")), "intervallo").when(F.col("o.error").isNotNull(), "valore")
    return got.select("k", F.col("o.value").cast("double").alias("ore"), F.col("o.dash").alias("trattino"), kind.alias("errore"), F.col("t.value").alias("orario"))


@query(_K + """SELECT k, CASE k % 6 WHEN 0 THEN CASE WHEN h <= 23 AND m <= 59 THEN 'valore' ELSE 'illeggibile' END WHEN 1 THEN 'vuota' WHEN 2 THEN 'illeggibile' ELSE CASE k % 6 WHEN 3 THEN CASE WHEN h <= 24 THEN 'valore' ELSE 'illeggibile' END WHEN 4 THEN 'vuota' ELSE 'valore' END END AS stato,
CASE k % 6 WHEN 0 THEN CASE WHEN h <= 23 AND m <= 59 THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') END WHEN 3 THEN CASE WHEN h <= 24 THEN CAST(h AS VARCHAR) END WHEN 5 THEN 'ROSSI ' || k END AS valore,
k % 6 = 0 AND h * 60 + m BETWEEN 420 AND 1080 AND h <= 23 AND m <= 59 AND m % 5 = 0 AS plausibile FROM w""")
def second_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reader's transcriptions of times, hours and names, interpreted."""
    k = F.col("o_orderkey")
    w = _orders(spark, sf_dir).select(k.alias("k"), (k % 27).alias("h"), (k * 7 % 75).alias("m"))
    n = F.col("k") % 6
    time = F.when(n == 0, F.concat(F.lit("`"), F.translate(F.concat("h", F.lit(":"), F.lpad(F.col("m").cast("string"), 2, "0")), "01", "Ol"), F.lit("`"))).when(n == 1, "—").otherwise("ore otto")
    read = {"orario": inputs.second_reading("orario", time), "ore": inputs.second_reading("ore", F.when(n == 3, F.concat("h", F.lit("h"))).otherwise("empty")), "testo": inputs.second_reading("testo", F.concat(F.lit("rossi  "), "k"))}
    told = F.when(n <= 2, read["orario"]).when(n <= 4, read["ore"]).otherwise(read["testo"])
    return w.select("k", told.alias("x")).select("k", "x.stato", "x.valore", F.coalesce(inputs.plausible("orario", F.when(F.col("k") % 6 == 0, F.col("x.valore"))), F.lit(False)).alias("plausibile"))


def _validated(spark: SparkSession, sf_dir: str):
    return validate(adapter.sheets(spark, sf_dir), adapter.rows(spark, sf_dir))


_LISTED = _ROW_FINDINGS + _WEEKS + _SHEET_FINDINGS + _STATES + """, l AS (SELECT d.*, stato, campi_illeggibili, campi_incerti, n_errori, n_attenzioni, n_info, CASE WHEN status <> 'completato' THEN status WHEN NOT is_sheet THEN 'scartato' ELSE stato END AS chiave FROM d JOIN st USING (doc_id)) """


@query(on_events(_LISTED + """SELECT unnest(['tutti', 'da_controllare', 'con_errori', 'illeggibili', 'ok', 'verificati', 'in_lettura', 'scartati']) AS filtro, unnest([count(*), count(*) FILTER (chiave IN ('da_verificare', 'errori') AND NOT verified), count(*) FILTER (chiave = 'errori'), count(*) FILTER (campi_illeggibili > 0), count(*) FILTER (chiave = 'ok'), count(*) FILTER (verified), count(*) FILTER (status IN ('in_coda', 'in_lavorazione')), count(*) FILTER (chiave = 'scartato')]) AS n FROM l"""))
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sheets each of the list's filters leaves."""
    v = _validated(spark, sf_dir)
    return lists.filter_counts(v.sheets.join(v.states, "doc_id"))


@query(on_events("SELECT anno || '-' || lpad(CAST(mese AS VARCHAR), 2, '0') AS periodo, count(*) AS n FROM d GROUP BY ALL"))
def list_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods that occur."""
    return lists.periods(adapter.sheets(spark, sf_dir))


@query(on_events(_LISTED + """, mt AS (SELECT doc_id, round(coalesce(sum(dich), 0), 2) AS dich, round(coalesce(sum(me / 60.0), 0), 2) AS calc, round(sum(ric), 2) AS ric, count(*) FILTER (NOT op AND ric > 0) AS giorni FROM x GROUP BY doc_id)
SELECT count(*) AS fogli, count(*) FILTER (verified) AS confermati, CAST(sum(dich) AS DECIMAL(18,2)) AS ore_dichiarate, CAST(sum(calc) AS DECIMAL(18,2)) AS ore_calcolate, CAST(sum(ric) AS DECIMAL(18,2)) AS ore_riconosciute, CAST(sum(giorni) AS BIGINT) AS giorni_lavorati,
CAST(sum(n_errori) AS BIGINT) AS n_errori, CAST(sum(n_attenzioni) AS BIGINT) AS n_attenzioni, CAST(sum(n_info) AS BIGINT) AS n_info, CAST(sum(campi_incerti) AS BIGINT) AS campi_incerti, CAST(sum(campi_illeggibili) AS BIGINT) AS campi_illeggibili FROM l JOIN mt USING (doc_id)"""))  # fmt: skip
def list_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list's footer: sheets, confirmed ones, and sums."""
    v = _validated(spark, sf_dir)
    return lists.footer(v.sheets, v.totals, v.states)


@query(on_events(f"SELECT doc_id, operatore FROM d WHERE {_EXPORT} AND verified"))
def confirmed_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exportable sheets that a person has confirmed."""
    return lists.confirmed(adapter.sheets(spark, sf_dir)).select("doc_id", "operatore")


@query(on_events(_ROW_FINDINGS + "SELECT doc_id, gravita, count(*) AS n FROM f WHERE gravita IN ('errore', 'info') GROUP BY ALL"))
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each sheet's rows by the severities that are shown."""
    from ..operators import rules

    return lists.by_severity(rules.row_findings(R.typed(adapter.rows(spark, sf_dir))), ["errore", "info"])


@query("SELECT o_custkey AS doc_id, CAST(o_orderkey % 31 AS INTEGER) AS giorno, string_agg(campo || '=' || valore, ';' ORDER BY campo) AS modifiche FROM (SELECT o_custkey, o_orderkey, o_orderkey % 31, o_orderpriority AS campo, arg_max(o_orderstatus, o_orderkey) OVER w AS valore, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 31, o_orderpriority ORDER BY o_orderkey DESC) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderkey % 31, o_orderpriority)) WHERE r = 1 GROUP BY ALL")
def pending_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edits of a day as one map; of a field the latest counts."""
    o = _orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 31).cast("int").alias("giorno"), F.col("o_orderpriority").alias("campo"), F.col("o_orderstatus").alias("valore"), F.col("o_orderkey").alias("seq"))
    pairs = F.transform(F.array_sort(F.map_entries("modifiche")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return lists.pending_edits(o).withColumn("modifiche", F.array_join(pairs, ";"))


@query(on_events(f"SELECT nome, CAST(coalesce((SELECT sum(dich_raw) FROM x JOIN d USING (doc_id) WHERE {_EXPORT} AND lower(operatore) = lower(nome)), 0) AS DECIMAL(28,4)) AS totale FROM (SELECT unnest(['ROSSI 2', 'rossi ?', 'Rossi*', '1 rossi']) AS nome)"))
def person_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared hours of persons asked by name; wildcards in a name mean themselves."""
    names = spark.createDataFrame([("ROSSI 2",), ("rossi ?",), ("Rossi*",), ("1 rossi",)], "nome string")
    sheets = adapter.sheets(spark, sf_dir).where(duplicates.exportable())
    hours = sheets.join(adapter.rows(spark, sf_dir).select("doc_id", "ore_dichiarate"), "doc_id")
    return lists.person_sums(names, hours, "operatore", "ore_dichiarate").withColumn("totale", F.col("totale").cast("decimal(28,4)"))


@query(on_events(_WEEKS + """, b AS (SELECT *, CASE WHEN ore > ore_pei_doc + 0.01 THEN 'Oltre il limite PEI' ELSE 'Entro il limite PEI' END AS esito FROM weeks)
SELECT doc_id, settimana, dal, "al", ore, ore_pei, ore_pei_doc, CAST(ore - ore_pei AS DECIMAL(9,2)) AS differenza, esito FROM b UNION ALL SELECT doc_id, NULL, NULL, NULL, CAST(sum(ore) AS DECIMAL(9,2)), CAST(sum(ore_pei) AS DECIMAL(9,2)), NULL, CAST(sum(ore) - sum(ore_pei) AS DECIMAL(9,2)), NULL FROM b GROUP BY doc_id"""))  # fmt: skip
def week_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly block of each sheet's report, with outcomes and the month's row."""
    sheets = adapter.sheets(spark, sf_dir)
    return T.week_block(cut(T.week_totals(R.typed(adapter.rows(spark, sf_dir)), sheets)))


@query(on_events(f"SELECT doc_id, source_file, source_page, CASE WHEN status = 'completato' THEN 'Non riconosciuto come foglio firma' WHEN status = 'in_coda' THEN 'In attesa di elaborazione' WHEN status = 'errore' THEN 'Elaborazione non riuscita' ELSE 'Scartato: la pagina non è un foglio firma' END AS motivo FROM d WHERE NOT ({_EXPORT})"))
def excluded_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets that the export leaves out, and why."""
    return workbook.exclusions(adapter.sheets(spark, sf_dir))


@query(on_events("SELECT sezione, count(*) AS n, min(voce) AS prima, max(testo) AS ultima FROM (SELECT 'lettura' AS sezione, engine || ' ' || model AS voce, CAST(count(*) AS VARCHAR) AS testo FROM d GROUP BY engine, model UNION ALL SELECT 'esclusi', source_file || ' – pagina ' || source_page, CASE WHEN status = 'completato' THEN 'Non riconosciuto come foglio firma' WHEN status = 'in_coda' THEN 'In attesa di elaborazione' WHEN status = 'errore' THEN 'Elaborazione non riuscita' ELSE 'Scartato: la pagina non è un foglio firma' END FROM d WHERE NOT (" + _EXPORT + ")) GROUP BY sezione UNION ALL SELECT 'codici', 26, 'E01 · Ore non coerenti con l''orario', 'info'"))
def legend_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legend's sections: codes, readers and excluded sheets."""
    sheets = adapter.sheets(spark, sf_dir)
    table = workbook.legend(codes(spark), reports.reader_statistics(sheets), workbook.exclusions(sheets))
    return table.groupBy("sezione").agg(F.count(F.lit(1)).alias("n"), F.min("voce").alias("prima"), F.max("testo").alias("ultima"))


@query(on_events(f"""SELECT x.doc_id, giorno, campo, kind, round(number, 8) AS number, text, stato FROM (
SELECT doc_id, giorno, 'eff_entrata' AS campo, CASE WHEN NOT ee_w THEN 'empty' WHEN ee IS NULL THEN 'invalid' ELSE 'time' END AS kind, CAST(ee / 1440.0 AS DOUBLE) AS number, CASE WHEN ee_w AND ee IS NULL THEN '??' END AS text, CASE WHEN i_ee THEN 'incerto' ELSE '' END AS stato FROM x
UNION ALL SELECT doc_id, giorno, 'ore_dichiarate', CASE WHEN dich_raw IS NOT NULL THEN 'hours' WHEN x_ore THEN 'illeggibile' ELSE 'empty' END, CAST(dich_raw AS DOUBLE), CASE WHEN dich_raw IS NULL AND x_ore THEN 'ILLEGGIBILE' END, CASE WHEN x_ore THEN 'illeggibile' ELSE '' END FROM x
UNION ALL SELECT doc_id, giorno, 'firma', CASE WHEN firma THEN 'mark' WHEN (eff_w OR coalesce(dich_raw > 0.01, false)) AND NOT op THEN 'no' ELSE 'empty' END, NULL, CASE WHEN firma THEN 'Sì' WHEN (eff_w OR coalesce(dich_raw > 0.01, false)) AND NOT op THEN 'No' END, CASE WHEN i_firma THEN 'incerto' ELSE '' END FROM x
UNION ALL SELECT doc_id, giorno, 'note', CASE WHEN nota THEN 'text' WHEN x_note THEN 'illeggibile' ELSE 'empty' END, NULL, CASE WHEN nota THEN 'permesso 104' WHEN x_note THEN 'ILLEGGIBILE' END, CASE WHEN x_note THEN 'illeggibile' ELSE '' END FROM x) x"""))  # fmt: skip
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells of effective entries, hours, signatures and notes, as the workbook shows them."""
    edits = adapter.sheets(spark, sf_dir).select("doc_id", F.array().cast("array<string>").alias("user_edited"), F.create_map().cast("map<string,string>").alias("ocr_originali"))
    cells = workbook.day_cells(R.typed(adapter.rows(spark, sf_dir)), edits)
    return cells.where(F.col("campo").isin("eff_entrata", "ore_dichiarate", "firma", "note")).select("doc_id", "giorno", "campo", "kind", F.round("number", 8).alias("number"), "text", "stato")


@query(on_events("""SELECT doc_id, campo, kind, number, text, stato FROM (SELECT doc_id, 'operatore' AS campo, CASE WHEN operatore IS NULL THEN 'illeggibile' ELSE 'text' END AS kind, CAST(NULL AS DOUBLE) AS number, coalesce(operatore, 'ILLEGGIBILE') AS text, CASE WHEN user_id % 53 = 0 THEN 'illeggibile' WHEN user_id % 7 = 0 THEN 'incerto' ELSE '' END AS stato FROM d
UNION ALL SELECT doc_id, 'mese', 'month', NULL, anno || '-' || lpad(CAST(mese AS VARCHAR), 2, '0'), '' FROM d UNION ALL SELECT doc_id, 'ore_pei', 'hours', CAST(pei AS DOUBLE), NULL, '' FROM d
UNION ALL SELECT doc_id, 'timbro_referente', CASE WHEN user_id % 4 <> 0 THEN 'mark' ELSE 'no' END, NULL, CASE WHEN user_id % 4 <> 0 THEN 'Presente' ELSE 'Assente' END, '' FROM d)"""))  # fmt: skip
def heading_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells of headers: operator, month, quota and stamp."""
    sheets = adapter.sheets(spark, sf_dir).withColumns({"user_edited": F.array().cast("array<string>"), "ocr_originali": F.create_map().cast("map<string,string>")})
    return workbook.header_cells(sheets).where(F.col("campo").isin("operatore", "mese", "ore_pei", "timbro_referente")).drop("commento")


@query(on_events(f"SELECT doc_id, CASE WHEN operatore IS NULL THEN 'Foglio ' || nr WHEN user_id % 2 = 0 THEN 'Rossi ' || left(CAST(user_id % 60 AS VARCHAR), 1) || '.' ELSE (user_id % 60) || ' r.' END AS inizio FROM (SELECT *, row_number() OVER (ORDER BY lower(operatore) NULLS LAST, anno, mese, lower(alunno), source_file, source_page, doc_id) AS nr FROM d WHERE {_EXPORT})"))
def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the per-document sheets: unique, 31 characters at most; here their abbreviated beginning."""
    numbered = reports.numbered(adapter.sheets(spark, sf_dir).where(duplicates.exportable()), reports.export_order())
    named = workbook.sheet_names(numbered.select("doc_id", "n", "operatore", "mese", "anno"))
    short = F.regexp_replace(F.regexp_replace("scheda", r" \(\d+\)$", ""), r" \d\d-\d{4}$", "")
    full = F.regexp_replace(short, r"^(Rossi \d)\d*$", "$1.")  # a second person of the same short name has the full one
    return named.select("doc_id", F.regexp_replace(full, r"^(\d+ r)ossi$", "$1.").alias("inizio"))


@query(on_events(f"""SELECT doc_id, count(*) FILTER (blocco = 'giorni') AS giorni, count(*) FILTER (blocco = 'settimane') AS settimane, CAST(sum(ore) FILTER (blocco = 'settimane') AS DECIMAL(18,2)) AS ore_settimane, CAST(max(ore) FILTER (blocco = 'mese') AS DECIMAL(18,2)) AS ore_mese, min(voce) FILTER (blocco = 'settimane') AS prima FROM (
SELECT doc_id, 'giorni' AS blocco, NULL AS ore, NULL AS voce FROM x JOIN d USING (doc_id) WHERE {_EXPORT} AND (prog_w OR eff_w OR dich_raw IS NOT NULL OR al OR op OR firma OR nota OR x_ore OR x_note)
UNION ALL SELECT doc_id, 'settimane', ore, settimana || 'ª · ' || lpad(CAST(dal AS VARCHAR), 2, '0') || '/' || lpad(CAST(mese AS VARCHAR), 2, '0') || CASE WHEN dal <> "al" THEN ' – ' || lpad(CAST("al" AS VARCHAR), 2, '0') || '/' || lpad(CAST(mese AS VARCHAR), 2, '0') ELSE '' END FROM weeks JOIN (SELECT doc_id, mese, status, is_sheet FROM d) d USING (doc_id) WHERE {_EXPORT}
UNION ALL SELECT doc_id, 'mese', sum(ore), NULL FROM weeks JOIN (SELECT doc_id, status, is_sheet FROM d) d USING (doc_id) WHERE {_EXPORT} GROUP BY doc_id) GROUP BY doc_id""").replace("SELECT doc_id, count(*) FILTER (blocco", _WEEKS + "SELECT doc_id, count(*) FILTER (blocco", 1))  # fmt: skip
def document_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's own sheet (days, weeks, month), condensed to its counts and sums."""
    from ..operators import rules

    sheets, rows = adapter.sheets(spark, sf_dir).where(duplicates.exportable()), cut(R.typed(adapter.rows(spark, sf_dir)))
    detail = reports.detail(sheets, rows, rules.row_findings(rows), codes(spark))
    weeks = cut(T.week_totals(rows, sheets).join(sheets.select("doc_id", "mese", "anno"), "doc_id"))
    block = lambda name: F.col("blocco") == name
    return workbook.document_sheet(detail, weeks).groupBy("doc_id").agg(
        F.count_if(block("giorni")).alias("giorni"), F.count_if(block("settimane")).alias("settimane"), F.sum(F.when(block("settimane"), F.col("ore"))).cast("decimal(18,2)").alias("ore_settimane"),
        F.max(F.when(block("mese"), F.col("ore"))).cast("decimal(18,2)").alias("ore_mese"), F.min(F.when(block("settimane"), F.col("voce"))).alias("prima"),
    )


@query(on_events("""SELECT DISTINCT doc_id, giorno, campo, motivo FROM (
SELECT doc_id, giorno, unnest(['prog_entrata', 'prog_uscita', 'eff_entrata', 'eff_uscita']) AS campo, unnest([pe, pu, ee, eu]) AS v, 'fuori_orario' AS motivo FROM x) WHERE v NOT BETWEEN 420 AND 1080
UNION SELECT doc_id, giorno, 'ore_dichiarate', 'fuori_orario' FROM x WHERE dich_raw > 6
UNION SELECT doc_id, giorno, unnest(['eff_entrata', 'eff_uscita']), 'incoerente' FROM x WHERE eu <= ee OR eu - ee > 360
UNION SELECT doc_id, giorno, unnest(['prog_entrata', 'prog_uscita']), 'incoerente' FROM x WHERE pu <= pe OR pu - pe > 360
UNION SELECT doc_id, giorno, campo, 'incoerente' FROM (SELECT doc_id, giorno, unnest(['prog_entrata', 'prog_uscita', 'eff_entrata', 'eff_uscita', 'ore_dichiarate']) AS campo, unnest([pe, pu, ee, eu, 1]) AS v FROM x WHERE eu > ee AND eu - ee <= 360 AND abs((eu - ee) / 60.0 - dich_raw) > 0.01 AND NOT (al AND dich_raw < (eu - ee) / 60.0)) WHERE v IS NOT NULL
UNION SELECT doc_id, giorno, campo, 'incoerente' FROM (SELECT doc_id, giorno, unnest(['prog_entrata', 'prog_uscita']) AS campo FROM x WHERE eu > ee AND eu - ee <= 360 AND dich_raw IS NOT NULL AND NOT (abs((eu - ee) / 60.0 - dich_raw) > 0.01 AND NOT (al AND dich_raw < (eu - ee) / 60.0)) AND pu > pe AND pu - pe <= 360 AND eu - ee > pu - pe + 0.6)
UNION SELECT doc_id, giorno, unnest(['prog_entrata', 'prog_uscita', 'ore_dichiarate']), 'incoerente' FROM x WHERE NOT coalesce(eu > ee AND eu - ee <= 360, false) AND pu > pe AND pu - pe <= 360 AND (dich_raw > (pu - pe) / 60.0 + 0.01 OR (dich_raw < (pu - pe) / 60.0 - 0.01 AND NOT al AND NOT op))
UNION SELECT doc_id, giorno, CASE WHEN ee IS NULL THEN 'eff_uscita' ELSE 'eff_entrata' END, 'incompleto' FROM x WHERE (ee IS NULL) <> (eu IS NULL)"""))  # fmt: skip
def row_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that don't fit their row."""
    return doubts.row_doubts(R.typed(adapter.rows(spark, sf_dir)))


@query(_K + """SELECT k, CASE k % 5 WHEN 0 THEN CASE WHEN h BETWEEN 6 AND 19 AND m <= 59 AND m % 5 = 0 OR (h = 20 AND m = 0) THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') END
WHEN 1 THEN CASE WHEN h <= 8 THEN CAST(h AS DECIMAL(9,2))::VARCHAR END WHEN 2 THEN CASE WHEN h BETWEEN 1 AND 12 THEN '2026-' || lpad(CAST(h AS VARCHAR), 2, '0') END WHEN 3 THEN '104' ELSE NULL END AS valore FROM w""")
def lexicon_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with stray signs, looked up in the lexicons of times, hours, months and notes."""
    k = F.col("o_orderkey")
    w = _orders(spark, sf_dir).select(k.alias("k"), (k % 27).alias("h"), (k * 7 % 75).alias("m"))
    name = _pick(5, *map(F.lit, ["orari", "ore", "mese_anno", "note", "ore"]))
    text = _pick(5, F.translate(F.concat(F.lit("."), "h", F.lit(","), F.lpad(F.col("m").cast("string"), 2, "0"), F.lit("-")), "1", "I"), F.concat("h", F.lit(" h")), F.concat(F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(" / 26")), F.lit("perm. 104.."), F.lit("...3"))
    table = lexicons.times(spark).unionByName(lexicons.day_hours(spark)).unionByName(lexicons.months(spark, 2025, 2027)).unionByName(lexicons.notes(spark))
    return lexicons.look_up(w.select("k", name.alias("lessico"), text.alias("testo")), table).select("k", "valore")


_LOG = """WITH log AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderkey % 3 AS gen, ['in_coda', 'in_lavorazione', 'completato', 'errore', 'scartato'][1 + o_orderkey % 5] AS status FROM orders),
cur AS (SELECT doc_id, max(gen) AS now FROM log WHERE status = 'in_coda' GROUP BY 1), """


@query(_LOG + """e AS (SELECT doc_id, seq, status FROM log JOIN cur USING (doc_id) WHERE gen = now),
q AS (SELECT doc_id, min(seq) AS q FROM e WHERE status = 'in_coda' GROUP BY 1), r AS (SELECT doc_id, min(seq) AS r FROM e JOIN q USING (doc_id) WHERE status = 'in_lavorazione' AND seq > q GROUP BY 1),
z AS (SELECT doc_id, arg_min(status, seq) AS last FROM e JOIN r USING (doc_id) WHERE seq > r AND status IN ('completato', 'errore', 'scartato') GROUP BY 1)
SELECT c.doc_id, c.now AS gen, coalesce(last, CASE WHEN r IS NOT NULL THEN 'in_lavorazione' ELSE 'in_coda' END) AS status, CAST(1 + (r IS NOT NULL)::INT + (last IS NOT NULL)::INT AS BIGINT) AS changes, (SELECT count(*) FROM log l WHERE l.doc_id = c.doc_id) - (1 + (r IS NOT NULL)::INT + (last IS NOT NULL)::INT) AS dropped
FROM cur c LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id)""")  # fmt: skip
def queue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each sheet after a log of changes, with generations and transitions that may not follow."""
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, [queue.QUEUED, queue.READING, queue.DONE, queue.FAILED, queue.REJECTED]))
    log = _orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), k.alias("seq"), (k % 3).alias("gen"), F.element_at(names, (k % 5 + 1).cast("int")).alias("status"))
    return queue.states(log)


@query("SELECT doc_id, gen, p AS progress, m AS message FROM (SELECT o_custkey AS doc_id, o_orderkey % 3 AS gen, max(CAST(o_orderkey % 101 AS DOUBLE) / 100) AS p, arg_max('passo ' || o_orderkey % 7, o_orderkey) AS m FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY gen DESC) = 1")
def reading_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of readings: the latest generation's, which never goes back."""
    k = F.col("o_orderkey")
    updates = _orders(spark, sf_dir).select(F.col("o_custkey").alias("doc_id"), (k % 3).alias("gen"), k.alias("seq"), ((k % 101).cast("double") / 100).alias("progress"), F.concat(F.lit("passo "), (k % 7).cast("string")).alias("message"))
    return queue.progress(updates)


@query("""WITH v AS (SELECT vec_id AS id, vec_id // 40 AS g, vec_id % 8 AS r, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.g AS gruppo, a.id, b.id AS vicino, round(list_cosine_similarity(a.e, b.e), 6) AS s FROM v a JOIN v b ON a.g = b.g AND a.r <> b.r)
SELECT gruppo, id, vicino, CAST(n AS INTEGER) AS posto, s AS somiglianza FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, vicino) AS n FROM p) WHERE n <= 3""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of other rows in each small group."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 40).alias("gruppo"), F.col("vec_id").alias("id"), (F.col("vec_id") % 8).alias("riga"), F.col("embedding").cast("array<double>").alias("vector"))
    return neighbours.nearest(v, 3, "gruppo", "riga")


@query(on_events("SELECT doc_id, CASE WHEN ore = 1 THEN '1 ora' ELSE replace(regexp_replace(CAST(CAST(ore AS DECIMAL(9,2)) AS VARCHAR), '\\.?0+$', ''), '.', ',') || ' ore' END AS ore, 'nota «permesso 104» (permesso Legge 104/1992)' AS nota, CASE WHEN giorno IN (1, 8, 11) THEN 'dall''' ELSE 'dal ' END || giorno || ' al 28 ' || CASE mese WHEN 1 THEN 'gennaio' ELSE 'febbraio' END AS periodo FROM (SELECT doc_id, giorno, mese, dich AS ore FROM x WHERE nota AND dich IS NOT NULL AND giorno < 28)"))
def wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours, notes and stretches of days in words."""
    r = R.typed(adapter.rows(spark, sf_dir)).where("note is not null and dich is not null and giorno < 28")
    return r.select("doc_id", messages.hours_label(F.col("dich")).alias("ore"), messages.note_description(F.col("note")).alias("nota"), messages.from_to(F.col("giorno"), F.lit(28), F.col("mese")).alias("periodo"))


@query()
def note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as readers give them, decided upon with the vocabulary (compared with plain Python in the tests)."""
    from ..operators import notes

    k = F.col("o_orderkey")
    texts = ["PONTE DI CARNEVAL", "permesso 1o4", "DE", "malatia", "assemblea sindacale", "", "IL", "visita medica ore 9", "zzqx yykw"]
    r = _orders(spark, sf_dir).select(k.cast("string").alias("doc_id"), (k % 31 + 1).cast("int").alias("giorno"), F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int")).alias("free_text"), ((k % 10) / 10).alias("free_confidence"), F.lit(2).alias("free_tokens"), F.when(k % 4 == 0, "104").when(k % 4 == 1, "MALATTIA").alias("phrase"), (-(k % 5)).cast("double").alias("phrase_logprob"), F.lit(2.0).alias("aspect"))
    return notes.note_fields(r).select("doc_id", "giorno", "valore", F.round("confidenza", 6).alias("confidenza"), "incerto", "illeggibile")


@query(on_events(_LISTED + """, n AS (SELECT doc_id, count(*) AS giorni, min(giorno) AS primo, CAST(round(sum(round(ric, 2)), 2) AS DOUBLE) AS ore FROM x GROUP BY 1), e AS (SELECT doc_id, count(*) AS trovate, count(*) FILTER (gravita = 'errore') AS errori FROM (SELECT doc_id, gravita FROM f UNION ALL SELECT doc_id, gravita FROM g) GROUP BY 1)
SELECT d.doc_id, operatore, giorni, primo, ore, coalesce(trovate, 0) AS trovate, coalesce(errori, 0) AS errori FROM d JOIN n USING (doc_id) LEFT JOIN e USING (doc_id)"""))
def sheet_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sheet's detail as JSON, read back: its days, hours and findings."""
    from ..operators import payloads

    v = _validated(spark, sf_dir)
    told = F.from_json("payload", "header struct<operatore:string>, rows array<struct<giorno:int,ore_riconosciute:double>>, anomalies array<struct<codice:string,gravita:string>>")
    read = payloads.details(v.sheets, v.rows, v.findings).select("doc_id", told.alias("p"))
    hours = F.aggregate("p.rows", F.lit(0.0), lambda s, r: s + r["ore_riconosciute"])
    errors = F.size(F.filter("p.anomalies", lambda a: a["gravita"] == "errore"))
    return read.select("doc_id", F.col("p.header.operatore").alias("operatore"), F.size("p.rows").cast("long").alias("giorni"), F.element_at("p.rows", 1)["giorno"].alias("primo"), F.round(hours, 2).alias("ore"), F.size("p.anomalies").cast("long").alias("trovate"), errors.cast("long").alias("errori"))
