"""Attendance sheets shaped from the ``events`` table, in integer arithmetic, so that SQL can say the same.

The adapter is this repository's own: events know nothing of timesheets. A sheet is a user's month, a day row
is a user's day; written values vary with sums of event ids so that every rule meets its cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRINGS = "array<string>"


def _pick(k: str, *texts) -> F.Column:
    return F.element_at(F.array(*texts), (F.expr(k) + 1).cast("int"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day rows: doc_id, mese, anno, giorno and the written fields."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = e.select("user_id", "event_id", "event_type", F.year("ts").alias("anno"), F.month("ts").alias("mese"), F.dayofmonth("ts").alias("giorno"), (F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    by_day = day.groupBy("user_id", "anno", "mese", "giorno").agg(
        F.sum("event_id").alias("s"), F.min("m").alias("lo"), F.max("m").alias("hi"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("buys")
    )
    five = by_day.withColumns({"lo": F.col("lo") - F.col("lo") % 5, "hi": F.col("hi") - F.col("hi") % 5})
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = five.withColumns({"h1": two(F.floor(F.col("lo") / 60)), "m1": two(F.col("lo") % 60), "h2": two(F.floor(F.col("hi") / 60)), "m2": two(F.col("hi") % 60)})
    written = lambda h, m: (F.concat(h, F.lit(":"), m), F.concat(h, F.lit("."), m), F.concat(h, m), F.concat(F.lit("ore "), h, F.lit(":"), m), F.concat(h, F.lit("h"), m), F.lit("??"))
    lists = lambda *pairs: F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for c, n in pairs))).cast(_STRINGS)
    return parts.select(
        F.concat_ws("-", "user_id", "anno", "mese").alias("doc_id"), "mese", "anno", "giorno",
        F.when(F.expr("s % 7 <> 0"), F.lit("08:00")).alias("prog_entrata"), F.when(F.expr("s % 7 <> 0"), _pick("s % 4", F.lit("14:00"), F.lit("14.00"), F.lit("1400"), F.lit("ore 14"))).alias("prog_uscita"),
        F.when(F.expr("s % 8 <> 0"), _pick("s % 6", *written(F.col("h1"), F.col("m1")))).alias("eff_entrata"),
        F.when(F.expr("s % 8 <> 0 and s % 11 <> 0"), _pick("s % 6", *written(F.col("h2"), F.col("m2")))).alias("eff_uscita"),
        F.when(F.expr("s % 101 = 0"), F.lit(25)).when(F.expr("s % 9 <> 0"), F.expr("s % 33") / F.lit(4)).cast("decimal(9,4)").alias("ore_dichiarate"),
        F.expr("buys = 0 and s % 13 = 0").alias("assenza_alunno"), F.expr("s % 17 = 0").alias("assenza_operatore"), F.expr("clicks > 0").alias("firma"),
        F.when(F.expr("s % 29 = 0"), F.lit("permesso 104")).alias("note"), F.lit(False).alias("trattino_effettivo"),
        lists(("s % 10 = 0", "eff_entrata"), ("s % 15 = 0", "firma"), ("s % 19 = 0", "ore_dichiarate")).alias("incerti"), lists(("s % 19 = 0", "ore_dichiarate"), ("s % 23 = 0", "note")).alias("illeggibili"),
    )


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat sheets: one for each user and month with events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    by_month = e.groupBy("user_id", F.year("ts").alias("anno"), F.month("ts").alias("mese")).agg(F.sum("event_id").alias("s"), F.count(F.lit(1)).alias("n"))
    u = "user_id"
    return by_month.select(
        F.concat_ws("-", u, "anno", "mese").alias("doc_id"), F.concat(F.lit("scan"), F.expr(f"{u} % 20"), F.lit(".pdf")).alias("source_file"),
        F.expr(f"cast({u} div 20 + 1 as int)").alias("source_page"), F.lit(8).alias("page_count"),
        F.when(F.expr(f"{u} % 41 = 0"), "scartato").when(F.expr(f"{u} % 31 = 0"), "errore").when(F.expr(f"{u} % 29 = 0"), "in_coda").otherwise("completato").alias("status"),
        F.expr(f"{u} % 37 <> 0").alias("is_foglio_firma"), F.expr(f"{u} % 5 = 0").alias("user_verified"),
        F.when(F.expr(f"{u} % 2 = 0"), "local").otherwise("cloud").alias("engine"), F.concat(F.lit("m"), F.expr(f"{u} % 3")).alias("model"), (F.expr("s % 100") / 100).cast("decimal(5,2)").alias("confidence"),
        F.when(F.expr(f"{u} % 53 <> 0"), F.when(F.expr(f"{u} % 2 = 0"), F.concat(F.lit("Rossi "), F.expr(f"{u} % 60"))).otherwise(F.concat(F.expr(f"{u} % 60"), F.lit(" rossi")))).alias("operatore"),
        F.concat(F.lit("AL "), F.expr(f"{u} % 60")).alias("alunno"), F.concat(F.lit("IC "), F.expr(f"{u} % 10")).alias("istituto"), F.lit("Coop").alias("ente"),
        "mese", "anno", F.expr(f"cast(2 + {u} % 4 as decimal(9,4))").alias("ore_pei"), F.when(F.expr(f"{u} % 6 <> 0"), (F.expr("s % 200") / 4)).cast("decimal(9,4)").alias("totale_mensile_dichiarato"),
        F.expr(f"{u} % 3 <> 0").alias("firma_coordinatore"), F.expr(f"{u} % 4 <> 0").alias("timbro_referente"),
        *(F.lit(None).cast("string").alias(f) for f in ("anno_scolastico", "lotto", "municipalita", "sostituzione", "data_compilazione")),
        F.when(F.expr(f"{u} % 7 = 0"), F.array(F.lit("operatore"))).otherwise(F.array().cast(_STRINGS)).alias("h_incerti"),
        F.when(F.expr(f"{u} % 53 = 0"), F.array(F.lit("operatore"))).otherwise(F.array().cast(_STRINGS)).alias("h_illeggibili"), "s", "n",
    )


#: The same as SQL, to be put before an oracle's own SELECT. Times are read by one pattern, as the adapter writes them.
SQL = """
WITH ev AS (SELECT user_id, event_id, event_type, year(ts) AS anno, month(ts) AS mese, day(ts) AS giorno, hour(ts) * 60 + minute(ts) AS m FROM events),
byday AS (SELECT user_id, anno, mese, giorno, CAST(sum(event_id) AS BIGINT) AS s, min(m) - min(m) % 5 AS lo, max(m) - max(m) % 5 AS hi, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS buys FROM ev GROUP BY 1, 2, 3, 4),
r AS (SELECT concat(user_id, '-', anno, '-', mese) AS doc_id, user_id, anno, mese, giorno, s,
  CASE WHEN s % 7 <> 0 THEN 480 END AS pe, CASE WHEN s % 7 <> 0 THEN 840 END AS pu,
  s % 8 <> 0 AS ee_w, s % 8 <> 0 AND s % 11 <> 0 AS eu_w,
  CASE WHEN s % 8 <> 0 AND s % 6 <> 5 THEN lo END AS ee, CASE WHEN s % 8 <> 0 AND s % 11 <> 0 AND s % 6 <> 5 THEN hi END AS eu,
  CASE WHEN s % 101 = 0 THEN 25.0 WHEN s % 9 <> 0 THEN (s % 33) / 4.0 END AS dich_raw,
  buys = 0 AND s % 13 = 0 AS al, s % 17 = 0 AS op, clicks > 0 AS firma, s % 29 = 0 AS nota, s % 10 = 0 AS i_ee, s % 15 = 0 AS i_firma, s % 19 = 0 AS x_ore, s % 23 = 0 AS x_note,
  isodow(make_date(anno, mese, giorno)) AS dow, isodow(make_date(anno, mese, 1)) AS dow1,
  (mese = 1 AND giorno IN (1, 6)) OR (mese = 4 AND giorno = 25) OR (mese = 5 AND giorno = 1) OR (mese = 6 AND giorno = 2) OR (mese = 8 AND giorno = 15) OR (mese = 9 AND giorno = 19) OR (mese = 11 AND giorno = 1) OR (mese = 12 AND giorno IN (8, 25, 26)) AS festa
  FROM byday),
t AS (SELECT *, CASE WHEN pu > pe THEN pu - pe END AS mp, CASE WHEN eu > ee THEN eu - ee END AS me, CASE WHEN dich_raw BETWEEN 0 AND 24 THEN dich_raw END AS dich,
  CASE WHEN festa THEN 'festivo' WHEN dow = 7 THEN 'domenica' WHEN dow = 6 THEN 'sabato' ELSE 'feriale' END AS tipo, CAST((giorno + dow1 - 2) // 7 + 1 AS INTEGER) AS settimana FROM r),
x AS (SELECT *, CASE WHEN op THEN 0.0 ELSE coalesce(dich, me / 60.0, 0.0) END AS ric, ee_w OR eu_w AS eff_w, pe IS NOT NULL AS prog_w, (ee_w OR eu_w) OR coalesce(dich > 0.01, false) AS prest FROM t),
sh AS (SELECT concat(user_id, '-', anno, '-', mese) AS doc_id, user_id, anno, mese, CAST(sum(event_id) AS BIGINT) AS s, count(*) AS n FROM ev GROUP BY user_id, anno, mese),
d AS (SELECT *, concat('scan', user_id % 20, '.pdf') AS source_file, CAST(user_id // 20 + 1 AS INTEGER) AS source_page,
  CASE WHEN user_id % 41 = 0 THEN 'scartato' WHEN user_id % 31 = 0 THEN 'errore' WHEN user_id % 29 = 0 THEN 'in_coda' ELSE 'completato' END AS status,
  user_id % 37 <> 0 AS is_sheet, user_id % 5 = 0 AS verified, CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'cloud' END AS engine, concat('m', user_id % 3) AS model, (s % 100) / 100.0 AS confidence,
  CASE WHEN user_id % 53 <> 0 THEN CASE WHEN user_id % 2 = 0 THEN concat('Rossi ', user_id % 60) ELSE concat(user_id % 60, ' rossi') END END AS operatore,
  CASE WHEN user_id % 53 <> 0 THEN concat(user_id % 60, ' ROSSI') END AS op_key, concat('AL ', user_id % 60) AS alunno, concat('IC ', user_id % 10) AS istituto,
  2 + user_id % 4 AS pei, CASE WHEN user_id % 6 <> 0 THEN (s % 200) / 4.0 END AS totale FROM sh)
"""
