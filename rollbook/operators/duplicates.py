"""Possible duplicates across sheets, and the dashboard's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import clean, name_key
from .rows import valid_period


def exportable() -> Column:
    return (F.col("status") == "completato") & F.col("is_foglio_firma")


# Why a sheet isn't exported.
NOT_A_SHEET = "Non riconosciuto come foglio firma"
EXCLUDED = {
    "in_coda": "In attesa di elaborazione", "in_lavorazione": "Elaborazione in corso", "errore": "Elaborazione non riuscita", "scartato": "Scartato: la pagina non è un foglio firma",
}
# End of fixed values.


def exclusion_reason(error: Column | None = None) -> Column:
    """Why a sheet isn't exported, with the reader's error if there is one; null if it is."""
    status = F.col("status")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in EXCLUDED.items() for x in kv]), status)
    reason = F.when(status == "completato", NOT_A_SHEET).otherwise(F.coalesce(known, F.concat(F.lit("Stato «"), status, F.lit("»"))))
    told = F.when((status == "errore") & clean(error).isNotNull(), F.concat(F.lit(": "), clean(error))) if error is not None else F.lit(None)
    return F.when(~exportable(), F.concat(reason, F.coalesce(told, F.lit(""))))


def _keyed(sheets: DataFrame) -> DataFrame:
    """Exportable sheets of a valid period with the names' words in order."""
    return sheets.where(exportable() & valid_period(F.col("mese"), F.col("anno"))).select("doc_id", name_key(F.col("operatore")).alias("op_key"), name_key(F.col("alunno")).alias("al_key"), "mese", "anno")


def _compared(sheets: DataFrame) -> DataFrame:
    """Of these, those with both names: others aren't compared."""
    return _keyed(sheets).where("op_key <> '' and al_key <> ''")


_GROUP = ["op_key", "al_key", "mese", "anno"]


def duplicates(sheets: DataFrame) -> DataFrame:
    """(doc_id, gruppo, fogli): sheets of the same operator, pupil and month, with the group's least id and its size. One row for
    each sheet, however large its group: counted with partial sums, and joined back only for real groups."""
    keyed = _compared(sheets)
    real = keyed.groupBy(*_GROUP).agg(F.min("doc_id").alias("gruppo"), F.count(F.lit(1)).alias("fogli")).where("fogli > 1")
    return keyed.join(real, _GROUP).select("doc_id", "gruppo", "fogli")


def duplicate_peers(sheets: DataFrame, block: int = 64) -> DataFrame:
    """(doc_id, gruppo, fogli, peers): as duplicates(), with all the other sheets of the group in order, however many they are.

    The result grows with the square of a group, so its list is gathered once and sent to one task for each ``block`` of its sheets;
    there each sheet leaves itself out. Blank names are left out inside the list, as a filter of keys would be evaluated on what
    ``sheets`` is aggregated from."""
    named = (F.col("op_key") != "") & (F.col("al_key") != "")
    gathered = _keyed(sheets).groupBy(*_GROUP).agg(F.array_sort(F.collect_list(F.when(named, F.col("doc_id")))).alias("docs")).where("size(docs) > 1")
    blocks = gathered.select(F.col("docs")[0].alias("gruppo"), "docs", F.explode(F.sequence(F.lit(0), F.size("docs") - 1, F.lit(block))).alias("first")).repartition("gruppo", "first")
    out = blocks.select("gruppo", F.size("docs").cast("long").alias("fogli"), "docs", F.explode(F.slice("docs", F.col("first") + 1, block)).alias("doc_id"))
    return out.select("doc_id", "gruppo", "fogli", F.array_remove("docs", F.col("doc_id")).alias("peers"))


def kpis(sheets: DataFrame, states: DataFrame, totals: DataFrame, peers: DataFrame) -> DataFrame:
    """The dashboard's figures in one row. sheets: flat; states, totals and peers by doc_id."""
    joined = sheets.join(states.drop("firme_mancanti"), "doc_id", "left").join(totals.select("doc_id", "ore_riconosciute"), "doc_id", "left").join(peers.select("doc_id", F.lit(True).alias("dup")), "doc_id", "left")
    done = exportable()
    attention = F.col("n_attenzioni") + F.when(F.col("dup"), 1).otherwise(0)
    state = F.when(F.col("dup") & (F.col("stato") == "ok"), "da_verificare").otherwise(F.col("stato"))
    total = lambda c: F.coalesce(F.sum(F.when(done, c)), F.lit(0)).cast("long")
    return joined.agg(
        F.count(F.lit(1)).alias("documenti"), F.count_if(done).alias("completati"), F.coalesce(F.sum(F.when(done, F.col("ore_riconosciute"))), F.lit(0)).cast("decimal(18,2)").alias("ore_totali"),
        total(F.col("n_errori")).alias("errori"), total(attention).alias("attenzioni"), total(F.col("campi_illeggibili")).alias("illeggibili"), total(F.col("campi_incerti")).alias("incerti"),
        F.count_if(done & (state != "ok") & ~F.col("user_verified")).alias("da_verificare"), F.count_if(done & F.col("user_verified")).alias("verificati"),
        F.count_if(done & F.col("dup")).alias("possibili_duplicati"), F.count_if(done & (state == "errori")).alias("documenti_con_errori"),
        *(F.count_if(F.col("status") == s).alias(n) for s, n in (("in_coda", "in_coda"), ("in_lavorazione", "in_lavorazione"), ("errore", "errori_elaborazione"), ("scartato", "scartati"))),
    )


def status_counts(sheets: DataFrame) -> DataFrame:
    """Sheets by status, with zero for those that don't occur."""
    spine = sheets.sparkSession.createDataFrame([(s,) for s in ("in_coda", "in_lavorazione", "completato", "errore", "scartato")], "status string")
    return spine.join(sheets.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").na.fill(0)
