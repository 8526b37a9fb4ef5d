"""What lists of sheets and findings show: counts of their filters, periods, footers, shortest tops, and pending edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import SEVERITIES
from .duplicates import exportable
from .reports import named_filter, period_label

# How many candidates a note names, alternatives a cell offers, and exports a list shows; the names of the filters.
TOP_CANDIDATES, TOP_ALTERNATIVES, TOP_EXPORTS = 3, 4, 8
FILTERS = ["tutti", "da_controllare", "con_errori", "illeggibili", "ok", "verificati", "in_lettura", "scartati"]
# End of fixed values.


def filter_counts(listed: DataFrame) -> DataFrame:
    """(filtro, n): how many sheets each of the list's filters leaves, zero included, in one pass."""
    one = listed.agg(*(F.count_if(F.coalesce(named_filter(f), F.lit(False))).alias(f) for f in FILTERS))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("filtro"), F.col(f).alias("n")) for f in FILTERS))).alias("x")).select("x.*")


def periods(sheets: DataFrame) -> DataFrame:
    """(periodo, n): the periods that occur, the latest first."""
    return sheets.select(period_label().alias("periodo")).where("periodo is not null").groupBy("periodo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("periodo"))


def footer(sheets: DataFrame, totals: DataFrame, states: DataFrame) -> DataFrame:
    """One row: sheets, confirmed ones, and sums of their totals."""
    joined = sheets.join(totals, "doc_id", "left").join(states.select("doc_id", "n_errori", "n_attenzioni", "n_info", "campi_incerti", "campi_illeggibili"), "doc_id", "left")
    summed = lambda c, kind: F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c)
    return joined.agg(
        F.count(F.lit(1)).alias("fogli"), F.count_if("user_verified").alias("confermati"), *(summed(c, "decimal(18,2)") for c in ("ore_dichiarate", "ore_calcolate", "ore_riconosciute")),
        *(summed(c, "long") for c in ("giorni_lavorati", "n_errori", "n_attenzioni", "n_info", "campi_incerti", "campi_illeggibili")),
    )


def confirmed(sheets: DataFrame) -> DataFrame:
    """Exportable sheets that a person has confirmed."""
    return sheets.where(exportable() & F.col("user_verified"))


def by_severity(findings: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(doc_id, gravita, n) of the wanted severities."""
    return findings.where(F.col("gravita").isin(wanted or SEVERITIES)).groupBy("doc_id", "gravita").agg(F.count(F.lit(1)).alias("n"))


def top(items: Column, most: int, order) -> Column:
    """The first ``most`` elements of an array by a sort key of each element; equal keys keep the elements' own order."""
    placed = F.transform(items, lambda x, i: F.struct(order(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(placed), 1, most), lambda p: p["x"])


def top_candidates(candidates: Column) -> Column:
    """The candidates that a note names: structs of valore, punteggio and somiglianza, the best first."""
    return top(candidates, TOP_CANDIDATES, lambda c: F.struct(-c["punteggio"], -c["somiglianza"], c["valore"]))


def top_alternatives(options: Column) -> Column:
    """The alternatives of a cell that a reconciliation tries: structs of value and logprob, the likeliest first."""
    return top(options, TOP_ALTERNATIVES, lambda o: -o["logprob"])


def latest_exports(files: DataFrame, most: int = TOP_EXPORTS) -> DataFrame:
    """The latest exports (path, modified) without hidden and temporary files; ``most`` of them (a list's top)."""
    name = F.substring_index("path", "/", -1)
    return files.where(~name.rlike(r"^[.~]") & ~name.rlike(r"\.tmp$")).orderBy(F.desc("modified"), "path").limit(most)


def person_sums(names: DataFrame, summary: DataFrame, field: str, measure: str) -> DataFrame:
    """(nome, totale): for each asked name the measure's sum over the rows of exactly that name, without regard to case; characters that
    are wildcards elsewhere mean themselves. A name without rows has 0."""
    asked = names.select("nome", F.lower("nome").alias("k"))
    sums = summary.groupBy(F.lower(field).alias("k")).agg(F.sum(measure).alias("totale"))
    return asked.join(sums, "k", "left").select("nome", F.coalesce("totale", F.lit(0)).alias("totale"))


def pending_edits(edits: DataFrame) -> DataFrame:
    """(doc_id, giorno, modifiche): all edits of a day (doc_id, giorno, campo, valore, seq) as one map; of a field the latest counts."""
    last = edits.groupBy("doc_id", "giorno", "campo").agg(F.max_by("valore", "seq").alias("valore"))
    return last.groupBy("doc_id", "giorno").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("campo", "valore")))).alias("modifiche"))
