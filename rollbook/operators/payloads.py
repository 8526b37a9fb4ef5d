"""What callers get: summaries as JSON, captions, file and sheet names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import MONTHS, clean
from ..plans.model import DAY_FIELDS, HEADER_FIELDS
from .reports import period_label
from .rows import valid_period


def display_name() -> Column:
    """Operator and period, else file and page."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.when(F.col("mese").between(1, 12), F.col("mese")).otherwise(1).cast("int"))
    return F.when(clean(F.col("operatore")).isNotNull(), F.concat_ws(" – ", clean(F.col("operatore")), F.when(valid_period(F.col("mese"), F.col("anno")), F.concat_ws(" ", month, F.col("anno"))))).otherwise(F.concat_ws(" – ", "source_file", F.when(F.col("page_count") > 1, F.concat(F.lit("pagina "), F.col("source_page")))))


def summaries(sheets: DataFrame, totals: DataFrame, states: DataFrame) -> DataFrame:
    """(doc_id, payload): each sheet's summary as JSON with nested header and totals."""
    joined = sheets.join(totals, "doc_id", "left").join(states, "doc_id", "left")
    header = F.struct("operatore", "alunno", "istituto", "ente", "mese", "anno", "ore_pei")
    total = F.struct("ore_riconosciute", "ore_dichiarate", "ore_calcolate", "totale_mensile_dichiarato", "giorni_lavorati", "n_errori", "n_attenzioni", "n_info", "campi_incerti", "campi_illeggibili", "stato")
    return joined.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), display_name().alias("display_name"), "source_file", "source_page", "status", "is_foglio_firma", "user_verified", header.alias("header"), total.alias("totals"))).alias("payload"))


def details(sheets: DataFrame, rows: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, payload): each sheet as JSON with its header, its days in order and its findings in their order. A sheet's days and
    findings are a bounded handful, gathered by sheet."""
    day = F.struct("giorno", *DAY_FIELDS, "trattino_effettivo", "tipo", "festivita", F.round("ric", 2).alias("ore_riconosciute"), "incerti", "illeggibili")
    days = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("giorno", day.alias("r")))).alias("d")).select("doc_id", F.transform("d", lambda x: x["r"]).alias("rows"))
    rank = F.when(F.col("gravita") == "errore", 0).when(F.col("gravita") == "attenzione", 1).otherwise(2)
    told = F.struct("codice", "gravita", "giorno", "campo", "valore_letto", "valore_atteso")
    place = F.struct(F.coalesce("giorno", F.lit(-1)).alias("g"), rank.alias("k"), F.col("ordine").alias("o"), told.alias("f"))
    listed = findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(place)).alias("a")).select("doc_id", F.transform("a", lambda x: x["f"]).alias("anomalies"))
    header = F.struct(*HEADER_FIELDS, F.col("h_incerti").alias("incerti"), F.col("h_illeggibili").alias("illeggibili"))
    joined = sheets.join(days, "doc_id", "left").join(listed, "doc_id", "left")
    return joined.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), display_name().alias("display_name"), "source_file", "source_page", "status", "is_foglio_firma", "user_verified", header.alias("header"), "rows", F.coalesce("anomalies", F.array()).alias("anomalies"))).alias("payload"))


def preview(documents: DataFrame, detail: DataFrame, findings: DataFrame) -> DataFrame:
    """(parte, doc_id, payload): what a preview of the report shows, a JSON object for each row of its three parts: documenti,
    dettaglio and anomalie."""
    parts = [df.select(F.lit(name).alias("parte"), "doc_id", F.to_json(F.struct(*df.columns)).alias("payload")) for name, df in (("documenti", documents), ("dettaglio", detail), ("anomalie", findings))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def caption(sheets: DataFrame) -> DataFrame:
    """One row: first and last period, the file name that follows, and the entity if there is exactly one."""
    p = period_label()
    return sheets.agg(F.min(p).alias("dal"), F.max(p).alias("al"), F.when(F.count_distinct("ente") == 1, F.max("ente")).alias("ente")).select("dal", "al", F.concat(F.lit("presenze"), F.coalesce(F.concat(F.lit("_"), "dal", F.when(F.col("dal") != F.col("al"), F.concat(F.lit("_"), F.col("al"))).otherwise("")), F.lit("")), F.lit(".xlsx")).alias("file"), "ente")


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """The report's tables as Parquet, CSV or JSON folders below one folder."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{folder.rstrip('/')}/{name}")
