"""Registered queries of readings, evidence, the registry, fields and ingest, with their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.similarity import distance
from ..operators import evidence, fields, readings, registry, reports, rules, sentences
from ..operators import rows as R
from ..operators import totals as T
from ..sources import store
from ..streaming import ingest
from . import adapter
from .catalogue import _EXPORT, _ROW_FINDINGS, on_events
from .model import DAY_FIELDS, codes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.typed(adapter.rows(spark, sf_dir))


_CONTENT = "(pe IS NOT NULL OR eff_w OR dich_raw IS NOT NULL OR al OR op OR firma OR nota OR x_ore OR x_note)"


@query(on_events(_ROW_FINDINGS + "SELECT doc_id, giorno, mp IS NOT NULL AND dich IS NOT NULL AND NOT op AS coerente FROM x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = x.doc_id AND f.giorno = x.giorno AND left(codice, 3) IN ('E01', 'E03', 'W01', 'W02', 'W05', 'W11'))"))
def coherent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a finding of incoherence."""
    r = _typed(spark, sf_dir)
    flag = F.col("min_prog").isNotNull() & F.col("dich").isNotNull() & ~F.col("assenza_operatore")
    return fields.coherent_rows(r, rules.row_findings(r)).select("doc_id", "giorno", flag.alias("coerente"))


_MERGE = """, a AS (SELECT doc_id, giorno, s, CASE WHEN s % 3 = 0 THEN true ELSE false END AS read, dich_raw AS a_v, x_ore AS a_ill,
  CASE WHEN s % 5 = 0 THEN NULL WHEN s % 4 = 0 THEN dich_raw ELSE coalesce(dich_raw, 0) + 1 END AS b_v, s % 15 = 5 AS b_ill, s % 6 = 0 AS b_inc FROM x),
k AS (SELECT *, CASE WHEN NOT read THEN 'keep' WHEN a_ill AND b_ill THEN 'none' WHEN b_ill THEN 'doubt' WHEN NOT a_ill AND (abs(a_v - b_v) <= 0.01 OR (a_v IS NULL AND b_v IS NULL)) THEN 'same' WHEN (b_inc AND NOT b_ill) OR (a_ill OR a_v IS NOT NULL) <> (b_v IS NOT NULL) THEN 'taken_doubt' ELSE 'taken' END AS k FROM a) """


@query(on_events(_MERGE + """SELECT doc_id, giorno, CAST(v AS DOUBLE) AS ore, k IN ('doubt', 'taken_doubt') OR (v IS NULL AND (k = 'taken' OR (k = 'same' AND b_inc AND NOT b_ill))) AS incerte, k = 'none' OR (k = 'keep' AND a_ill) AS illeggibili
FROM (SELECT *, CASE WHEN k = 'none' THEN NULL WHEN k LIKE 'taken%' THEN b_v ELSE a_v END AS v FROM k)"""))  # fmt: skip
def merged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first reading of the rows merged with a second one of every third row, field by field; here the hours."""
    r = adapter.rows(spark, sf_dir)
    e = _table(spark, sf_dir, "events")
    s = e.groupBy(F.concat_ws("-", "user_id", F.year("ts"), F.month("ts")).alias("doc_id"), F.dayofmonth("ts").alias("giorno")).agg(F.sum("event_id").alias("s"))
    none = F.array().cast("array<string>")
    # the signature keeps both readings from being empty, and hours alone are compared
    first = r.withColumns({f: F.lit(None).cast("string") for f in (*DAY_FIELDS[:4], "note")} | {f: F.lit(False) for f in DAY_FIELDS[5:7]} | {"firma": F.lit(True)})
    first = first.withColumns({"incerti": none, "illeggibili": F.array_intersect("illeggibili", F.array(F.lit("ore_dichiarate")))})
    own, n = F.col("ore_dichiarate"), F.col("s")
    value = F.when(n % 5 == 0, F.lit(None)).when(n % 4 == 0, own).otherwise(F.coalesce(own, F.lit(0)) + 1).cast("decimal(9,4)")
    ill = F.when(n % 15 == 5, F.array(F.lit("ore_dichiarate"))).otherwise(none)
    again = first.join(s, ["doc_id", "giorno"]).where("s % 3 = 0").withColumns({"ore_dichiarate": value, "illeggibili": ill, "incerti": F.when((n % 6 == 0) & (F.size(ill) == 0), F.array(F.lit("ore_dichiarate"))).otherwise(none)}).drop("s")
    merged = readings.merge_readings(first, again, F.col("ore_dichiarate").isNotNull())
    has = lambda c: F.array_contains(c, "ore_dichiarate")
    return merged.select("doc_id", "giorno", F.col("ore_dichiarate").cast("double").alias("ore"), has("incerti").alias("incerte"), has("illeggibili").alias("illeggibili"))


@query(on_events("""SELECT d.doc_id, CAST(CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 3 = 0 THEN totale WHEN user_id % 5 = 0 THEN totale ELSE tot END AS DOUBLE) AS totale,
CASE WHEN user_id % 11 = 0 THEN false WHEN user_id % 3 = 0 THEN true WHEN user_id % 5 = 0 THEN user_id % 2 = 0 AND NOT coalesce(abs(totale - tot) <= 0.01, false) WHEN coalesce(abs(totale - tot) <= 0.01, false) THEN false ELSE user_id % 2 = 0 END AS incerto,
user_id % 11 = 0 AS illeggibile FROM d JOIN (SELECT doc_id, round(coalesce(sum(dich), 0), 2) AS tot FROM x GROUP BY doc_id) USING (doc_id)"""))  # fmt: skip
def merged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each monthly total: both illegible, only the second, equal ones, or the sum of days."""
    sheets = adapter.sheets(spark, sf_dir).withColumn("u", F.substring_index("doc_id", "-", 1).cast("long"))
    sums = T.month_totals(_typed(spark, sf_dir))
    u = F.col("u")
    first = sheets.select("doc_id", F.col("totale_mensile_dichiarato").alias("totale"), F.lit(True).alias("incerto"), (u % 11 == 0).alias("illeggibile"))
    again = sheets.join(sums, "doc_id").select("doc_id", F.when((u % 11 == 0) | (u % 3 == 0), F.lit(None)).when(u % 5 == 0, F.col("totale_mensile_dichiarato")).otherwise(F.col("ore_dichiarate")).cast("decimal(9,4)").alias("totale"), (u % 2 == 0).alias("incerto"), ((u % 11 == 0) | (u % 3 == 0)).alias("illeggibile"))
    return fields.merge_total(first, again, sums).withColumn("totale", F.col("totale").cast("double"))


_EVIDENCE = """WITH c AS (SELECT o_orderkey AS k, CAST(300 + (o_orderkey * 7) % 600 AS INTEGER) AS v, -((o_orderkey % 5) / 10.0 + 0.1) AS l0, -((o_orderkey % 7) / 2.0 + 1.5) AS l1, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 30 END AS d, -((o_orderkey % 4) / 2.0) AS lf FROM orders),
z AS (SELECT *, ln(exp(l0) + exp(l1)) AS z FROM c) """


@query(_EVIDENCE + """SELECT k, v AS valore, round(CAST(exp(l0 - z) * cov AS DOUBLE), 6) AS p, exp(l0 - z) * cov < 0.7 OR coalesce(d <> 0, false) OR exp(l1 - z) >= 0.25 AS incerto, cov < 0.05 AS illeggibile, round(CAST(cov AS DOUBLE), 6) AS copertura FROM (SELECT *, CASE WHEN coalesce(d, 0) = 0 THEN 1.0 ELSE exp(z) / (exp(z) + exp(lf)) END AS cov FROM z)""")
def chosen_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of two candidates and a free reading for each cell, and the choice without context."""
    k = F.col("o_orderkey")
    v = (k * 7 % 600 + 300).cast("int")
    option = lambda value, lp: F.struct(value.cast("int").alias("value"), lp.cast("double").alias("logprob"))
    d = F.when(k % 3 == 1, 0).when(k % 3 == 2, 30)
    r = _table(spark, sf_dir, "orders").select(k.alias("k"), F.array(option(v, -(k % 5 / 10 + 0.1)), option(v + 5, -(k % 7 / 2 + 1.5))).alias("candidates"), (v + d).cast("int").alias("free_value"), F.when(d.isNotNull(), -(k % 4 / 2)).cast("double").alias("free_logprob"))
    out = fields.choose(evidence.evidence(r), rival=0.25)
    return out.select("k", "valore", F.round("p", 6).alias("p"), "incerto", "illeggibile", F.round("coverage", 6).alias("copertura"))


@query("WITH s AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 12 + 1 AS INTEGER) AS mese, CAST(2020 + o_orderkey % 3 AS INTEGER) AS anno, -(o_orderkey % 17) / 4.0 AS score FROM orders), w AS (SELECT doc_id, mese, sum(exp(score)) AS w FROM s GROUP BY 1, 2) SELECT doc_id, mese, round(w / sum(w) OVER (PARTITION BY doc_id), 6) AS p FROM w")
def month_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of months from log scores of months and years."""
    k = F.col("o_orderkey")
    s = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (k % 12 + 1).cast("int").alias("mese"), (k % 3 + 2020).cast("int").alias("anno"), (-(k % 17) / 4).cast("double").alias("score"))
    return readings.month_posterior(s).withColumn("p", F.round("p", 6))


@query("SELECT o_custkey AS doc_id, round(greatest(0, least(1, 0.85 * avg((o_orderkey % 97) / 97.0::DOUBLE) + 0.15 * coalesce(CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 11) / 10.0 END, 0))), 3) AS confidence FROM orders GROUP BY o_custkey")
def document_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of documents from cell probabilities and grid scores."""
    o = _table(spark, sf_dir, "orders")
    cells = o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 97 / 97).alias("p"))
    grid = o.where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("doc_id"), (F.col("o_custkey") % 11 / 10).alias("score")).distinct()
    return fields.document_confidence(cells, grid)


@query(on_events("SELECT doc_id, giorno, campo FROM (SELECT doc_id, giorno, unnest(['assenza_alunno', 'assenza_operatore', 'firma']) AS campo, unnest([al, op, firma]) AS c FROM x WHERE pe IS NULL AND (NOT ee_w OR i_ee) AND NOT eu_w AND (dich_raw IS NULL OR x_ore) AND (NOT nota OR x_note)) WHERE c"))
def lonely_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures and absence marks in rows without a sure time, hour or note."""
    return fields.lonely_marks(_typed(spark, sf_dir))


@query(on_events("SELECT doc_id, giorno, round(CAST(dich * 60.0 / mp AS DOUBLE), 6) AS quota FROM x WHERE al AND dich > 0 AND mp > 0 AND least(abs(dich * 60.0 / mp - 0.25), abs(dich * 60.0 / mp - 1.0 / 3), abs(dich * 60.0 / mp - 0.5), abs(dich * 60.0 / mp - 2.0 / 3), abs(dich * 60.0 / mp - 0.75), abs(dich * 60.0 / mp - 1.0)) > 0.03"))
def odd_absence_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of absent pupils that are no usual share of the programmed ones."""
    return fields.odd_absence_hours(_typed(spark, sf_dir))


@query(on_events(", q AS (SELECT doc_id, giorno, me FROM x WHERE me IS NOT NULL) SELECT a.doc_id, a.giorno FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.giorno <> b.giorno AND (a.giorno - b.giorno) % 7 = 0 GROUP BY a.doc_id, a.giorno, a.me HAVING count(*) >= 2 AND min(b.me) = max(b.me) AND abs(a.me - min(b.me)) >= 60"))
def odd_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose duration is an hour or more off the one that the weekday's others share; here of effective times."""
    return fields.odd_durations(_typed(spark, sf_dir).withColumn("min_prog", F.col("min_eff")))


_FLAGGED = """, grids AS (SELECT doc_id, CASE WHEN user_id % 9 = 0 THEN 0.5 ELSE 0.9 END AS alignment, user_id % 4 AS bad FROM d) """


@query(on_events(_FLAGGED + "SELECT x.doc_id, giorno, CASE WHEN alignment < 0.7 OR giorno % 4 = bad AND bad > 0 THEN 9 - x_note::INT ELSE i_ee::INT + i_firma::INT + x_ore::INT END AS incerti FROM x JOIN grids USING (doc_id)"))
def unreliable_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in doubt after pages and rows with an unreliable grid were flagged whole."""
    u = F.substring_index("doc_id", "-", 1).cast("long")
    quality = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda g: F.when((u % 4 > 0) & (g % 4 == u % 4), 0.3).otherwise(0.9))
    grids = adapter.sheets(spark, sf_dir).select("doc_id", F.when(u % 9 == 0, 0.5).otherwise(0.9).alias("alignment"), quality.alias("row_quality"))
    return evidence.unreliable_grid(adapter.rows(spark, sf_dir), grids).select("doc_id", "giorno", F.size("incerti").alias("incerti"))


@query(on_events(", v AS (SELECT doc_id, mese, anno, unnest([0, 1, 2]) AS j FROM d), p AS (SELECT doc_id, mese, anno + j AS anno, penalty FROM (SELECT v.doc_id, v.mese, v.anno, v.j, CAST(sum(CASE WHEN (v.mese = 1 AND giorno IN (1, 6)) THEN -1.5 WHEN isodow(make_date(v.anno + j, v.mese, least(giorno, 28))) = 7 AND giorno <= 28 THEN -1.5 WHEN giorno <= 28 AND isodow(make_date(v.anno + j, v.mese, least(giorno, 28))) = 6 THEN -0.5 WHEN giorno > day(last_day(make_date(v.anno + j, v.mese, 1))) THEN -1.5 WHEN isodow(make_date(v.anno + j, v.mese, least(giorno, day(last_day(make_date(v.anno + j, v.mese, 1)))))) = 7 THEN -1.5 WHEN isodow(make_date(v.anno + j, v.mese, least(giorno, day(last_day(make_date(v.anno + j, v.mese, 1)))))) = 6 THEN -0.5 ELSE 0 END) AS DOUBLE) AS penalty FROM v JOIN x ON x.doc_id = v.doc_id WHERE tipo = 'feriale' AND prest GROUP BY ALL)), n AS (SELECT doc_id, count(*) AS n FROM x WHERE tipo = 'feriale' AND prest GROUP BY 1) SELECT a.doc_id, a.mese, CAST(a.anno AS INTEGER) AS anno FROM p a JOIN n USING (doc_id) WHERE n >= 8 AND a.penalty >= -1.0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.mese = a.mese AND b.anno <> a.anno AND b.penalty > a.penalty - 3.0)"))
def years_by_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year that the worked weekdays leave, of three that the sheet's year begins."""
    r = _typed(spark, sf_dir).where("tipo = 'feriale'").where(R.pair_written("eff") | F.coalesce(F.col("dich") > 0.01, F.lit(False)))
    periods = adapter.sheets(spark, sf_dir).select("mese", "anno").distinct()
    three = F.explode(F.array(*((F.col("anno") + j).cast("int") for j in range(3)))).alias("anno")
    every = periods.select("mese", three).distinct()
    own = adapter.sheets(spark, sf_dir).select("doc_id", "mese", three)
    penalties = readings.calendar_penalty(r.select("doc_id", "giorno"), every).join(own, ["doc_id", "mese", "anno"], "left_semi").withColumn("penalty", F.col("penalty").cast("double"))
    return evidence.year_by_calendar(penalties, r.select("doc_id", "giorno"))


@query(on_events(", su AS (SELECT doc_id, CAST(round(coalesce(sum(dich), 0) * 60) AS INTEGER) AS somma, count(*) FILTER (x_ore) AS mancanti FROM x GROUP BY 1), o AS (SELECT d.doc_id, user_id % 4 AS k, somma, mancanti FROM d JOIN su USING (doc_id)) SELECT doc_id, CASE k WHEN 2 THEN somma + 30 WHEN 3 THEN somma + 6000 ELSE somma END AS valore, CASE k WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN NOT (mancanti > 0 AND 30 <= 480 * mancanti) ELSE NOT (mancanti > 0 AND 6000 <= 480 * mancanti) END AS incerto FROM o"))
def chosen_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly total among its readings: the one that equals the sum of days, else the best."""
    sums = _typed(spark, sf_dir).groupBy("doc_id").agg(F.round(F.coalesce(F.sum("dich"), F.lit(0)) * 60).cast("int").alias("somma"), F.count_if(F.array_contains("illeggibili", "ore_dichiarate")).alias("mancanti"))
    u, s = F.substring_index("doc_id", "-", 1).cast("long") % 4, F.col("somma")
    option = lambda v, lp: F.struct(v.cast("int").alias("value"), F.lit(lp).alias("logprob"))
    told = F.when(u == 0, F.array(option(s, -0.1))).when(u == 1, F.array(option(s + 15, -0.2), option(s, -1.8))).when(u == 2, F.array(option(s + 30, -0.1), option(s, -5.0))).otherwise(F.array(option(s + 6000, -0.1)))
    return evidence.choose_total(sums.select("doc_id", told.alias("options")), sums)


_LINKS = """, links AS (SELECT DISTINCT op_key, concat(user_id % 60, ' AL') AS al_key, operatore, alunno, CASE WHEN user_id % 13 <> 0 THEN istituto END AS istituto FROM d WHERE operatore IS NOT NULL) """


def _links(sheets: DataFrame) -> DataFrame:
    u = F.substring_index("doc_id", "-", 1).cast("long")
    return sheets.where("operatore is not null").select(V.name_key(F.col("operatore")).alias("op_key"), V.name_key(F.col("alunno")).alias("al_key"), "operatore", "alunno", F.when(u % 13 != 0, F.col("istituto")).alias("istituto")).distinct()


@query(on_events(_LINKS + "SELECT d.doc_id, any_value(l.istituto) AS valore FROM d JOIN links l ON d.op_key = l.op_key AND concat(d.user_id % 60, ' AL') = l.al_key GROUP BY d.doc_id HAVING count(DISTINCT l.istituto) = 1 AND count(l.istituto) = count(*)"))
def deduced_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only school that the associations of a sheet's operator and pupil leave."""
    sheets = adapter.sheets(spark, sf_dir)
    resolved = sheets.select("doc_id", F.nullif(V.name_key(F.col("operatore")), F.lit("")).alias("op_key"), V.name_key(F.col("alunno")).alias("al_key")).where("op_key is not null")
    return registry.deduce(resolved, _links(sheets), "istituto").select("doc_id", "valore")


@query(on_events(_LINKS + "SELECT doc_id, chiave, max(w) AS bonus FROM (SELECT d.doc_id, split_part(l.istituto, ' ', 2) || ' IC' AS chiave, CASE WHEN concat(d.user_id % 60, ' AL') = l.al_key THEN 0.15 ELSE 0.1 END AS w FROM d JOIN links l ON d.op_key = l.op_key WHERE l.istituto IS NOT NULL UNION ALL SELECT d.doc_id, split_part(l.istituto, ' ', 2) || ' IC', 0.1 FROM d JOIN links l ON concat(d.user_id % 60, ' AL') = l.al_key WHERE l.istituto IS NOT NULL) GROUP BY ALL"))
def association_bonuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the associations of operators and pupils add to schools."""
    sheets = adapter.sheets(spark, sf_dir)
    resolved = sheets.select("doc_id", F.nullif(V.name_key(F.col("operatore")), F.lit("")).alias("op_key"), V.name_key(F.col("alunno")).alias("al_key"))
    return registry.association_bonuses(resolved, _links(sheets), "istituto").select("doc_id", "chiave", "bonus")


_TAUGHT = """, c AS (SELECT doc_id, 'alunno' AS campo, concat(user_id % 60, ' AL') AS chiave FROM d WHERE verified AND is_sheet UNION ALL SELECT doc_id, 'istituto', concat(user_id % 10, ' IC') FROM d WHERE verified AND is_sheet UNION ALL SELECT doc_id, 'ente', 'COOP' FROM d WHERE verified AND is_sheet UNION ALL SELECT doc_id, 'operatore', op_key FROM d WHERE verified AND is_sheet AND user_id % 7 <> 0 AND operatore IS NOT NULL) """


@query(on_events(_TAUGHT + "SELECT doc_id, campo, chiave FROM c WHERE NOT (campo = 'alunno' AND chiave = '10 AL') AND NOT (campo = 'istituto' AND chiave = '0 IC')"))
def registry_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions that stay linked after a pupil and a school were removed from the registry."""
    sheets = adapter.sheets(spark, sf_dir).withColumns({"updated_at": F.col("doc_id"), "user_edited": F.array().cast("array<string>")})
    taught = registry.contributions(sheets)
    links = _links(sheets).withColumn("ente", F.lit("Coop"))
    gone = spark.createDataFrame([("alunno", "al 10"), ("istituto", "IC 0")], "campo string, valore string")
    return registry.remove(registry.values(taught), links, taught, gone)[2].select("doc_id", "campo", "chiave")


@query(on_events(_TAUGHT + "SELECT campo, chiave, count(*) AS n FROM c WHERE doc_id IN (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM c) ORDER BY doc_id DESC LIMIT 20) GROUP BY ALL"))
def registry_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of the latest documents, the number of which is the registry's limit (here 20)."""
    sheets = adapter.sheets(spark, sf_dir).withColumns({"updated_at": F.col("doc_id"), "user_edited": F.array().cast("array<string>")})
    return registry.evicted(registry.contributions(sheets), 20).groupBy("campo", "chiave").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS k, CASE WHEN e IN ('identico', 'sostituito', 'dedotto') THEN 'NUOVO' ELSE 'VECCHIO' END AS valore, CASE WHEN e IN ('sostituito', 'ambiguo', 'dedotto') AND o_orderkey % 2 = 0 OR e = 'ambiguo' THEN true WHEN e IN ('identico', 'sostituito') THEN false ELSE o_orderkey % 3 = 0 END AS incerto, e NOT IN ('identico', 'sostituito', 'dedotto') AND o_orderkey % 5 = 0 AS illeggibile
FROM (SELECT *, ['identico', 'sostituito', 'ambiguo', 'nuovo', 'dedotto'][1 + (o_orderkey // 5) % 5] AS e FROM orders)""")
def applied_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and flags of a field after the registry's decisions."""
    k = F.col("o_orderkey")
    outcome = F.element_at(F.array(*map(F.lit, ["identico", "sostituito", "ambiguo", "nuovo", "dedotto"])), (F.floor(k / 5) % 5 + 1).cast("int"))
    doubt = ((outcome.isin("sostituito", "dedotto")) & (k % 2 == 0)) | (outcome == "ambiguo")
    decision = F.struct(outcome.alias("esito"), F.when(~outcome.isin("ambiguo", "nuovo"), "NUOVO").alias("valore"), doubt.alias("incerto"))
    some = lambda c: F.when(c, F.array(F.lit("alunno"))).otherwise(F.array().cast("array<string>"))
    o = _table(spark, sf_dir, "orders").select(k.alias("k"), registry.apply_decision(F.lit("VECCHIO"), some(k % 3 == 0), some(k % 5 == 0), F.lit("alunno"), decision).alias("x"))
    return o.select("k", "x.valore", F.array_contains("x.incerti", "alunno").alias("incerto"), F.array_contains("x.illeggibili", "alunno").alias("illeggibile"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 BETWEEN 1 AND 12 THEN CAST(o_orderkey % 13 AS INTEGER) END AS mese, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2000 + o_orderkey % 100 WHEN 1990 + o_orderkey % 130 BETWEEN 2000 AND 2100 THEN 1990 + o_orderkey % 130 END AS INTEGER) AS anno, CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS data, CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) || '/' || (year(o_orderdate) + 1) ELSE (year(o_orderdate) - 1) || '/' || year(o_orderdate) END AS scolastico, o_orderkey % 4 = 0 AS si, o_orderkey % 4 = 3 AS errore FROM orders")
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, years, dates, school years and words for yes and no, parsed from texts."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    names = F.array(F.lit("?"), *(F.lit(m) for m in V.MONTHS))
    month = F.when(k % 2 == 0, (k % 13).cast("string")).otherwise(F.left(F.element_at(names, (k % 13 + 1).cast("int")), F.lit(3)))
    year = F.when(k % 3 == 0, (k % 100).cast("string")).otherwise((k % 130 + 1990).cast("string"))
    date = F.concat(F.lit("Napoli, "), F.date_format(F.add_months(d, 120), "d.M.yyyy"))
    flag = V.flag(F.element_at(F.array(*map(F.lit, ["Sì", "no", "", "forse"])), (k % 4 + 1).cast("int")))
    out = _table(spark, sf_dir, "orders").select(k.alias("k"), V.month(month).alias("mese"), V.year(year).cast("int").alias("anno"), V.written_date(date).alias("data"), V.school_year(F.month(d), F.year(d)).alias("scolastico"), flag.alias("f"))
    return out.select("k", "mese", "anno", "data", "scolastico", F.col("f.value").alias("si"), F.col("f.error").alias("errore"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'illeggibile' WHEN 1 THEN 'incerto' WHEN 2 THEN 'corretto' ELSE '' END AS stato, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'illeggibile' WHEN o_orderkey % 4 = 1 THEN 'incerto' WHEN o_orderkey % 4 = 2 THEN 'corretto' ELSE '' END AS peggiore FROM orders")
def field_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a field, and the worse of two in one cell."""
    k = F.col("o_orderkey")
    listed = lambda c: F.when(c, F.array(F.lit("mese"))).otherwise(F.array().cast("array<string>"))
    o = _table(spark, sf_dir, "orders").select(k.alias("k"), listed(k % 4 == 0).alias("illeggibili"), listed(k % 4 <= 1).alias("incerti"), F.when(k % 4 <= 2, F.array(F.lit("header.mese"))).otherwise(F.array().cast("array<string>")).alias("user_edited"))
    state = fields.field_state("mese", "header.mese")
    return o.select("k", state.alias("stato"), fields.worst_state(state, F.when(F.col("k") % 3 == 0, "illeggibile").otherwise("")).alias("peggiore"))


@query("""WITH u AS (SELECT o_custkey AS doc_id, ['a-1', 'a-9', 'b-7', 'zzz'][1 + o_orderkey % 4] AS model, o_orderkey % 1000 AS i, o_orderkey % 300 AS o, o_orderkey % 70 * 4 AS w, o_orderkey % 50 * 10 AS r FROM orders)
SELECT doc_id, CAST(sum(i + w + r) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(CAST(sum((i + 1.25 * w + 0.1 * r) * CASE WHEN model LIKE 'b%' THEN 3.0 ELSE 1.0 END + o * CASE WHEN model LIKE 'b%' THEN 15.0 ELSE 5.0 END) / 1e6 AS DOUBLE), 6) AS cost_usd FROM u GROUP BY doc_id""")
def reading_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and costs of reader calls, by model, family or default."""
    k = F.col("o_orderkey")
    usage = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.element_at(F.array(*map(F.lit, ["a-1", "a-9", "b-7", "zzz"])), (k % 4 + 1).cast("int")).alias("model"), (k % 1000).alias("input"), (k % 300).alias("output"), (k % 70 * 4).alias("cache_write"), (k % 50 * 10).alias("cache_read"))
    prices = spark.createDataFrame([("a-1", "a-", 1.0, 5.0), ("b-1", "b-", 3.0, 15.0)], "model string, family string, price_in double, price_out double")
    return fields.costs(usage, prices, "a-1")


@query(on_events(f"SELECT count(*) AS righe, CAST(sum(CASE WHEN op THEN 0.0 ELSE coalesce(dich_raw, me / 60.0) END) AS DECIMAL(18,2)) AS ric, CAST(sum(dich_raw) AS DECIMAL(18,2)) AS dich FROM x JOIN (SELECT doc_id, status, is_sheet FROM d) d USING (doc_id) WHERE {_EXPORT} AND {_CONTENT} AND firma AND dich_raw < 8"))
def visible_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total row of the daily detail that a filter leaves: signed days of less than eight declared hours."""
    sheets, rows = adapter.sheets(spark, sf_dir), _typed(spark, sf_dir)
    shown = reports.detail(sheets, rows, rules.row_findings(rows), codes(spark)).where("firma and dich < 8")
    out = fields.visible_totals(shown, ["ric", "dich"])
    return out.select("righe", F.col("ric").cast("decimal(18,2)").alias("ric"), F.col("dich").cast("decimal(18,2)").alias("dich"))


@query("SELECT k, CASE WHEN k % 8 = 0 THEN 'pdf' WHEN k % 8 = 1 THEN 'jpeg' WHEN k % 8 = 2 THEN 'png' WHEN k % 8 = 3 THEN 'tiff' WHEN k % 8 = 4 THEN 'bmp' WHEN k % 8 = 5 THEN 'webp' END AS tipo FROM (SELECT o_orderkey AS k FROM orders)")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files by their first bytes, else by their extension."""
    k = F.col("o_orderkey")
    heads = ["255044462D312E37", "FFD8FFE000104A46", "3F3F3F3F", "49492A0008000000", "424D3F3F3F3F3F3F", "524946463F3F3F3F", "3F3F3F", "00"]
    names = ["x.bin", "x.txt", "X.PNG", "x", "x.jpg", "x.doc", "x.docx", "x"]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % 8 + 1).cast("int"))
    return _table(spark, sf_dir, "orders").select(k.alias("k"), store.file_kind(F.unhex(at(heads)), at(names)).alias("tipo"))


@query("WITH p AS (SELECT DISTINCT o_clerkless AS sha, page FROM (SELECT o_custkey % 997 AS o_clerkless, o_orderkey % 3 AS page, o_custkey FROM orders)) SELECT CAST(sha AS VARCHAR) AS source_sha256, CAST(page AS INTEGER) AS source_page FROM p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey % 997 = sha AND o.o_orderkey % 3 = page AND o.o_orderstatus = 'F')")
def new_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by digest and number that aren't known yet, each once."""
    o = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 997).cast("string").alias("source_sha256"), (F.col("o_orderkey") % 3).cast("int").alias("source_page"), "o_orderstatus")
    return ingest.new_pages(o.drop("o_orderstatus"), o.where("o_orderstatus = 'F'"))


@query("SELECT doc_id, attempts, attempts >= 3 AS dead FROM (SELECT o_custkey AS doc_id, count(*) FILTER (o_orderkey % 9 <> 0) AS attempts, bool_or(o_orderkey % 9 = 0) AS done FROM orders GROUP BY 1) WHERE NOT done")
def failed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed pages with the number of tries; given up after three."""
    return ingest.retries(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 9 == 0).alias("ok")))


@query("SELECT o_custkey AS doc_id, CAST(g AS INTEGER) AS giorno, CAST(coalesce(lead(g) OVER w, first_value(g) OVER v) AS INTEGER) AS successiva, CAST(coalesce(lag(g) OVER w, last_value(g) OVER v) AS INTEGER) AS precedente FROM (SELECT DISTINCT o_custkey, o_orderkey % 31 + 1 AS g FROM orders WHERE o_orderkey % 2 = 0) WINDOW w AS (PARTITION BY o_custkey ORDER BY g), v AS (PARTITION BY o_custkey ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def next_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next and the previous flagged cell of a sheet, going on at its other end."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 31 + 1).cast("int").alias("giorno"), F.lit("note").alias("campo"), (F.col("o_orderkey") % 2 == 0).alias("segnalata"))
    return ingest.next_flag(o.where("segnalata").distinct()).select("doc_id", "giorno", F.col("successiva.giorno").alias("successiva"), F.col("precedente.giorno").alias("precedente"))


@query("SELECT p_partkey AS k, CAST(greatest(0, abs(l - length(p_name))) AS DOUBLE) AS distanza FROM (SELECT *, length(p_name) - CAST(p_partkey % 3 AS INTEGER) AS l FROM part)")
def name_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted distances of names to themselves without their last characters."""
    def apart(batches):
        for batch in batches:
            far = [distance(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(far, pa.float64())], names=["k", "distanza"])

    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.expr("left(p_name, length(p_name) - cast(p_partkey % 3 as int))").alias("b"))
    return p.mapInArrow(apart, "k long, distanza double")


@query(on_events("SELECT doc_id, giorno, ok AS ammesse FROM (SELECT *, (pe IS NULL OR pe BETWEEN 360 AND 1200) AND (pu IS NULL OR pu BETWEEN 360 AND 1200) AND (ee IS NULL OR (ee BETWEEN 360 AND 1200 AND ee % 5 = 0)) AND (eu IS NULL OR (eu BETWEEN 360 AND 1200 AND eu % 5 = 0)) AND coalesce(dich_raw BETWEEN 0 AND 8, true) AS ok FROM x)"))
def admissible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every written time and hour of a row is one that the form admits."""
    return evidence.admissible_cells(_typed(spark, sf_dir)).select("doc_id", "giorno", "ammesse")


_H = "CASE WHEN {0} = 1 THEN '1 ora' ELSE replace(regexp_replace(CAST(CAST(round({0}, 2) AS DECIMAL(9,2)) AS VARCHAR), '\\.?0+$', ''), '.', ',') || ' ore' END"
_I = "CASE WHEN {0} IS NOT NULL THEN lpad(CAST({0} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0') WHEN {1} THEN '??' ELSE '?' END"
_EFF = _I.format("ee", "ee_w") + " || '–' || " + _I.format("eu", "eu_w")


@query(on_events(_ROW_FINDINGS + f"""SELECT f.doc_id, f.giorno, left(codice, 3) AS codice, CASE left(codice, 3) WHEN 'W02' THEN 'Giorno ' || f.giorno || ': dichiarate ' || {_H.format("dich")} || ' senza orario effettivo di entrata e uscita.' WHEN 'W11' THEN 'Giorno ' || f.giorno || ': crocette sia su «Assenza alunno» sia su «Assenza operatore».'
WHEN 'W12' THEN 'Giorno ' || f.giorno || ': ore effettive non indicate sul foglio; riconosciute ' || {_H.format("me / 60.0")} || ' calcolate dall''orario ' || {_EFF} || '.' WHEN 'I04' THEN 'Giorno ' || f.giorno || ': orario effettivo ' || {_EFF} || ' senza orario programmato.' WHEN 'I03' THEN 'Giorno ' || f.giorno || ': orario effettivo ' || {_EFF} || ' diverso dal programmato 08:00–14:00.'
WHEN 'I05' THEN 'Giorno ' || f.giorno || ': prestazione programmata non svolta (orario programmato 08:00–14:00)' || CASE WHEN nota THEN ' – nota «permesso 104» (permesso Legge 104/1992)' ELSE '' END || '.' WHEN 'I02' THEN 'Giorno ' || f.giorno || ': assenza dell''operatore' || CASE WHEN nota THEN ' – nota «permesso 104» (permesso Legge 104/1992)' ELSE '' END || CASE WHEN mp > 0 THEN '; 6 ore programmate non svolte' ELSE '' END || '.'
WHEN 'W01' THEN 'Giorno ' || f.giorno || ': manca la firma dell''operatore (' || concat_ws(', ', CASE WHEN eff_w THEN 'orario ' || {_EFF} END, CASE WHEN dich > 0.01 THEN {_H.format("dich")} || CASE WHEN dich = 1 THEN ' dichiarata' ELSE ' dichiarate' END END) || ').' WHEN 'E01' THEN CASE WHEN dich IS NULL THEN 'Giorno ' || f.giorno || ': ore dichiarate non plausibili (25): il valore deve essere compreso tra 0 e 24.' ELSE 'Giorno ' || f.giorno || ': dichiarate ' || {_H.format("dich")} || ' ma l''orario effettivo ' || {_EFF} || ' corrisponde a ' || {_H.format("me / 60.0")} || '.' END
ELSE CASE WHEN campo = 'note' THEN 'Giorno ' || f.giorno || ': campo «Note» illeggibile: da verificare sulla scansione.' ELSE 'Giorno ' || f.giorno || ': campo «Tot. ore effettive» illeggibile: da leggere sulla scansione e inserire a mano.' END END AS messaggio
FROM f JOIN x ON x.doc_id = f.doc_id AND x.giorno = f.giorno WHERE left(codice, 3) IN ('W02', 'W11', 'W12', 'I02', 'I03', 'I04', 'I05', 'W01', 'E01', 'E05')"""))  # fmt: skip
def finding_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of rows in words; ten of the codes, whose words depend on the row."""
    rows, sheets = _typed(spark, sf_dir), adapter.sheets(spark, sf_dir)
    told = sentences.sentences(rules.row_findings(rows), rows, T.week_totals(rows, sheets))
    short = F.substring("codice", 1, 3)
    return told.where(short.isin("W02", "W11", "W12", "I02", "I03", "I04", "I05", "W01", "E01", "E05")).select("doc_id", "giorno", short.alias("codice"), "messaggio")
