"""Report tables: summary, daily detail, findings, grouped totals with a month pivot, reader statistics, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import clean, clock, normal
from ..plans.model import CODE, LABELS
from ..session import cut
from .duplicates import exportable
from .rows import has_content, pair_written, spreadsheet_measures, valid_period
from .rules import ordered


def person_label(field: str) -> Column:
    """A person's name, or why there is none."""
    return F.coalesce(clean(F.col(field)), F.when(F.array_contains("h_illeggibili", field), "(illeggibile)").otherwise("(non indicato)"))


def period_label() -> Column:
    return F.when(valid_period(F.col("mese"), F.col("anno")), F.format_string("%04d-%02d", F.col("anno").cast("int"), F.col("mese").cast("int")))


def export_order() -> list[Column]:
    """Operator (none last), year, month (no period last), pupil, file, page; the id settles ties."""
    ok = valid_period(F.col("mese"), F.col("anno"))
    return [F.lower(clean(F.col("operatore"))).asc_nulls_last(), F.when(ok, F.col("anno")).asc_nulls_last(), F.when(ok, F.col("mese")).asc_nulls_last(), F.lower(clean(F.col("alunno"))).asc_nulls_first(), F.lower("source_file"), F.col("source_page"), F.col("doc_id")]


def numbered(sheets: DataFrame, order: list[Column], name: str = "n", parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 over a total order, without gathering them: range partitions are numbered on their own and
    shifted by the sizes of those before. The sizes are one row for each partition. Placed rows are stored first, as
    ranges come from a sample that may differ from one run to the next."""
    n = parts or int(sheets.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    placed = cut(sheets.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + 1 + F.col("_before")).drop("_p", "_i", "_before")


def sheet_sums(rows: DataFrame) -> DataFrame:
    """Per sheet the workbook's sums over existing days: hours, days above zero, absences, signatures."""
    m = spreadsheet_measures(rows).where("esiste")
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)), 2).cast("decimal(12,2)")
    return m.groupBy("doc_id").agg(
        total("x_prog").alias("prog"), total("x_calc").alias("calc"), total("x_dich").alias("dich"), total("x_ric").alias("ric"), F.count_if(F.col("x_ric") > 0).alias("giorni"),
        F.count_if("assenza_alunno").alias("ass_al"), F.count_if("assenza_operatore").alias("ass_op"), F.count_if("firma").alias("firme"),
    )


def summary(sheets: DataFrame, rows: DataFrame, states: DataFrame) -> DataFrame:
    """One row per exportable sheet, in export order and numbered."""
    joined = sheets.where(exportable()).join(sheet_sums(rows), "doc_id", "left").join(states, "doc_id", "left")
    out = numbered(joined, export_order())
    ratio = F.round(F.try_divide(F.col("ric"), F.col("prog")), 4)
    return out.select("n", "doc_id", person_label("operatore").alias("operatore"), person_label("alunno").alias("alunno"), person_label("istituto").alias("istituto"), "mese", "anno", "prog", "calc", "dich", "ric", ratio.alias("quota"), "giorni", "ass_al", "ass_op", "firme", "totale_mensile_dichiarato", F.col("n_errori").alias("errori"), F.col("n_attenzioni").alias("attenzioni"), "stato")


def outcome(rows: DataFrame, findings: DataFrame, codes: DataFrame) -> DataFrame:
    """Typed rows with ``esito``: errors, else warnings, by their titles (with the fields of doubtful ones), else what the row says."""
    labels = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v.lower()))])
    worst = F.when(F.col("gravita") == "errore", 0).otherwise(1)
    told = findings.where(F.col("giorno").isNotNull() & F.col("gravita").isin("errore", "attenzione")).join(F.broadcast(codes.select("codice", "titolo")), "codice").withColumn("w", worst)
    by_code = told.groupBy("doc_id", "giorno", "w", "codice", "titolo").agg(F.min("ordine").alias("o"), F.array_sort(F.collect_list(F.struct("ordine", F.try_element_at(labels, F.col("campo")).alias("l")))).alias("fields"))
    fields = F.array_join(F.array_distinct(F.transform("fields", lambda x: x["l"])), ", ")
    text = F.when(F.col("codice") == CODE["E05"], F.concat(F.lit("illeggibile: "), fields)).when(F.col("codice") == CODE["W04"], F.concat(F.lit("lettura incerta: "), fields)).otherwise(F.col("titolo"))
    by_day = by_code.groupBy("doc_id", "giorno", "w").agg(F.array_sort(F.collect_list(F.struct("o", text.alias("t")))).alias("t"))
    first = by_day.groupBy("doc_id", "giorno").agg(F.min_by("t", "w").alias("t"), F.min("w").alias("w"))
    line = first.select("doc_id", "giorno", F.concat(F.when(F.col("w") == 0, "Errore: ").otherwise("Da verificare: "), F.array_join(F.transform("t", lambda x: x["t"]), "; ")).alias("problemi"))
    skipped = pair_written("prog") & ~pair_written("eff") & ((F.col("ore_dichiarate").isNull()) | F.coalesce(F.col("dich") <= 0.01, F.lit(False))) & ~F.array_contains("illeggibili", "ore_dichiarate")
    plain = (
        F.when(F.col("assenza_operatore"), "Assenza operatore").when(F.col("assenza_alunno"), "Assenza alunno").when(~has_content(), "").when(skipped, "Non svolto")
        .when((F.col("ric") > 0) | pair_written("eff"), "OK").otherwise("Non svolto")
    )
    return rows.join(line, ["doc_id", "giorno"], "left").withColumn("esito", F.coalesce("problemi", plain)).drop("problemi")


def detail(sheets: DataFrame, rows: DataFrame, findings: DataFrame, codes: DataFrame, empty_days: bool = False, odd_days: bool = False) -> DataFrame:
    """One row per exportable sheet and day: the workbook's daily detail. With odd_days, days that don't exist but hold
    something stay, as in the preview."""
    told = outcome(spreadsheet_measures(rows), findings, codes)
    shown_days = F.col("esiste") if not odd_days else F.col("esiste") | has_content()
    kept = told.where(shown_days if empty_days else shown_days & has_content())
    heads = sheets.where(exportable()).select("doc_id", person_label("operatore").alias("operatore"), person_label("alunno").alias("alunno"), person_label("istituto").alias("istituto"))
    return kept.join(heads, "doc_id").select(
        "doc_id", "operatore", "alunno", "istituto", "anno", "mese", "giorno", "tipo", "festivita", clock(F.col("min_prog_entrata")).alias("prog_entrata"), clock(F.col("min_prog_uscita")).alias("prog_uscita"),
        clock(F.col("min_eff_entrata")).alias("eff_entrata"), clock(F.col("min_eff_uscita")).alias("eff_uscita"), *(F.round(f"x_{c}", 2).cast("decimal(12,2)").alias(c) for c in ("prog", "calc", "dich", "ric", "diff")),
        "assenza_alunno", "assenza_operatore", "firma", "note", F.coalesce(F.nullif(F.col("esito"), F.lit("")), F.col("festivita"), F.lit("")).alias("esito"),
    )


def findings_table(sheets: DataFrame, findings: DataFrame, codes: DataFrame) -> DataFrame:
    """Findings of exportable sheets with their titles, numbered within each sheet."""
    joined = findings.join(sheets.where(exportable()).select("doc_id", person_label("operatore").alias("operatore"), "mese", "anno"), "doc_id").join(F.broadcast(codes.select("codice", "titolo")), "codice")
    return joined.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy(*ordered(findings)))).select("doc_id", "n", "operatore", "anno", "mese", "giorno", "codice", "gravita", "titolo", "campo", "valore_letto", "valore_atteso")


def grouped_totals(sheets: DataFrame, rows: DataFrame, field: str, other: str) -> DataFrame:
    """Totals of exportable sheets by operator, pupil or school, ignoring case, under the first spelling; the ratio is
    taken of the sums; the last row (gruppo null) is the section's total. Placeholder names come last (``segnaposto``)."""
    base = sheets.where(exportable()).select("doc_id", person_label(field).alias("label"), person_label(other).alias("other")).join(sheet_sums(rows), "doc_id")
    total = base.groupBy(F.lower("label").alias("k")).agg(
        F.min("label").alias("gruppo"), F.count(F.lit(1)).alias("fogli"), F.sum("ric").alias("ric"), F.sum("prog").alias("prog"), F.sum("giorni").alias("giorni"), F.sum("ass_al").alias("ass_al"), F.sum("ass_op").alias("ass_op"),
        F.array_join(F.array_sort(F.collect_set("other")), ", ").alias("altri"),
    )
    last = total.agg(F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("gruppo"), *(F.sum(c).alias(c) for c in ("fogli", "ric", "prog", "giorni", "ass_al", "ass_op")), F.lit(None).cast("string").alias("altri"))
    both = total.unionByName(last).withColumn("ric", F.col("ric").cast("decimal(18,2)")).withColumn("prog", F.col("prog").cast("decimal(18,2)"))
    return both.withColumn("quota", F.round(F.try_divide("ric", "prog"), 4)).withColumn("segnaposto", F.coalesce(F.startswith("gruppo", F.lit("(")), F.lit(False))).drop("k")


def month_pivot(sheets: DataFrame, rows: DataFrame, field: str, periods: list[str]) -> DataFrame:
    """Recognised hours by group and month; ``senza_periodo`` for sheets without a period."""
    base = sheets.where(exportable()).select("doc_id", F.lower(person_label(field)).alias("gruppo"), F.coalesce(period_label(), F.lit("senza_periodo")).alias("periodo")).join(sheet_sums(rows).select("doc_id", "ric"), "doc_id")
    return base.groupBy("gruppo").pivot("periodo", periods).agg(F.sum("ric").cast("decimal(18,2)"))


def reader_statistics(sheets: DataFrame) -> DataFrame:
    """Sheets and mean confidence by engine and model; confidences beyond 0..1 don't count."""
    c = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    return sheets.groupBy("engine", "model").agg(F.count(F.lit(1)).alias("documenti"), F.round(F.avg(c), 4).cast("double").alias("confidenza"))


def search(sheets: DataFrame, words: str) -> DataFrame:
    """Sheets whose names, file and period hold every word, without regard to case and accents."""
    hay = normal(F.concat_ws(" ", "operatore", "alunno", "istituto", "ente", "source_file", "mese", "anno"))
    out = sheets
    for w in words.split():
        out = out.where(F.contains(hay, normal(F.lit(w))))
    return out


def state_key() -> Column:
    """The one state that lists are sorted and filtered by."""
    return F.when(F.col("status") != "completato", F.col("status")).when(~F.col("is_foglio_firma"), "scartato").otherwise(F.col("stato"))


def named_filter(name: str) -> Column:
    """The list's filters by name."""
    key = state_key()
    return {
        "tutti": F.lit(True), "da_controllare": (key.isin("da_verificare", "errori")) & ~F.col("user_verified"), "con_errori": key == "errori", "illeggibili": F.col("campi_illeggibili") > 0,
        "ok": key == "ok", "verificati": F.col("user_verified"), "in_lettura": F.col("status").isin("in_coda", "in_lavorazione"), "scartati": key == "scartato",
    }[name]
