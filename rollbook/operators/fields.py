"""States and choices of single fields, lonely marks, plausible hours, costs and list orders."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import clock, minutes, normal
from ..plans.model import DAY_FIELDS, HOUR_FIELDS
from .notes import alike
from .readings import COHERENCE, same_value
from .reports import state_key

# Thresholds of a choice, plausible shares of hours, digits taken for others, ranks of states.
LEGIBLE, UNCERTAIN, WEAK, TAU_LEAST, CONTEXT_P = 0.05, 0.7, 0.3, 0.25, 0.02
SHARES, SHARE_TOLERANCE, ODD_DURATION = (0.25, 1 / 3, 0.5, 2 / 3, 0.75, 1.0), 0.03, 60
CONFUSED, W_CONFUSED = {"1": "47", "4": "1", "7": "1", "2": "9", "9": "2", "0": "6", "6": "0"}, -4.0
STATE_RANK = ["errore", "errori", "da_verificare", "in_coda", "in_lavorazione", "ok", "scartato"]
ALIKE_NEIGHBOUR = 0.45
CONFIDENCE_CELLS, CONFIDENCE_GRID, CACHE_WRITE, CACHE_READ = 0.85, 0.15, 1.25, 0.1
# End of fixed values.


def field_state(field: str, edited_key: str, illegible: str = "illeggibili", uncertain: str = "incerti", edited: str = "user_edited") -> Column:
    """illeggibile before incerto before corretto; empty if read and left as it is."""
    return F.when(F.array_contains(illegible, field), "illeggibile").when(F.array_contains(uncertain, field), "incerto").when(F.array_contains(edited, edited_key), "corretto").otherwise("")


def worst_state(*states: Column) -> Column:
    """The worst of several fields shown in one cell."""
    order = ["illeggibile", "incerto", "corretto"]
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, (s == name for s in states)), name) for name in order), F.lit(""))


def coherent_rows(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows without a finding of the six codes of incoherence."""
    return rows.join(findings.where(F.substring("codice", 1, 3).isin(COHERENCE)).select("doc_id", "giorno").distinct(), ["doc_id", "giorno"], "left_anti")


def choose(options: DataFrame, rival: float = 1.0) -> DataFrame:
    """Evidence with ``valore``, ``p``, ``incerto`` and ``illeggibile``: the best reading, in doubt if unlikely, contradicted by the
    free reading, or rivalled."""
    top, second = F.get("options", F.lit(0)), F.get("options", F.lit(1))
    bad = top.isNull() | (F.col("coverage") < LEGIBLE)
    p = F.exp(top["logprob"]) * F.col("coverage")
    doubt = (p < UNCERTAIN) | F.coalesce(F.col("free_value") != top["value"], F.lit(False)) | (F.coalesce(F.exp(second["logprob"]), F.lit(0.0)) >= rival)
    return options.withColumns({"valore": F.when(~bad, top["value"]), "p": F.when(bad, 0.0).otherwise(p), "incerto": ~bad & doubt, "illeggibile": bad})


def weak_options(options: Column, suggested: Column, coverage: Column) -> Column:
    """Options of a weak reading: differences lessened with the coverage, and values that the context suggests added. Not
    normalised."""
    tau = F.least(F.lit(1.0), F.greatest(F.lit(TAU_LEAST), coverage / WEAK))
    own = F.transform(options, lambda o: F.struct(o["value"].alias("value"), (o["logprob"] * tau).alias("logprob")))
    fresh = F.filter(F.array_distinct(suggested), lambda v: v.isNotNull() & ~F.coalesce(F.array_contains(F.transform(options, lambda o: o["value"]), v), F.lit(False)))
    return F.concat(own, F.transform(fresh, lambda v: F.struct(v.alias("value"), (F.log(F.lit(CONTEXT_P)) * tau).alias("logprob"))))


def suggestions(field: str) -> Column:
    """What the rest of a row (its fields as columns, minutes) suggests for a field: its twin, and times and hours that differ by
    the hours of the day."""
    pe, pu, ee, eu, h = (F.col(f) for f in HOUR_FIELDS)
    told = {
        HOUR_FIELDS[0]: [ee, pu - h, eu - h], HOUR_FIELDS[1]: [eu, pe + h, ee + h], HOUR_FIELDS[2]: [pe, eu - h, pu - h], HOUR_FIELDS[3]: [pu, ee + h, pe + h],
        HOUR_FIELDS[4]: [F.when((eu > ee) & ((eu - ee) % 15 == 0), eu - ee), F.when((pu > pe) & ((pu - pe) % 15 == 0), pu - pe)],
    }[field]
    inside = [v if field == HOUR_FIELDS[4] else F.when(v.between(360, 1200) & (v % 5 == 0), v) for v in told]
    return F.array_distinct(F.array_compact(F.array(*inside)))


def digit_confusions(minute: Column) -> Column:
    """Times that differ from one in a digit that handwriting confuses, within the form's hours."""
    text = clock(minute)
    spots = (1, 2, 4, 5)
    made = [F.when(F.substring(text, k, 1) == d, minutes(F.concat(F.substring(text, 1, k - 1), F.lit(a), F.substring(text, k + 1, 5)))) for k in spots for d, alts in CONFUSED.items() for a in alts]
    return F.filter(F.array_distinct(F.array_compact(F.array(*made))), lambda m: m.between(360, 1200) & (m % 5 == 0))


def lonely_marks(rows: DataFrame) -> DataFrame:
    """(doc_id, giorno, campo): signatures and absence marks of rows in which no time, hour or note is sure."""
    sure = lambda f: F.col(f).isNotNull() & ~F.array_contains("incerti", f) & ~F.array_contains("illeggibili", f)
    nothing = ~reduce(lambda a, b: a | b, (sure(f) for f in [*HOUR_FIELDS, "note"]))
    marks = F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in DAY_FIELDS[5:8])))
    return rows.where(nothing).select("doc_id", "giorno", F.explode(marks).alias("campo"))


def odd_absence_hours(rows: DataFrame) -> DataFrame:
    """(doc_id, giorno, quota): typed rows of an absent pupil whose hours are no usual share of the programmed ones."""
    ratio = F.col("dich").cast("double") * 60 / F.col("min_prog")
    usual = reduce(lambda a, b: a | b, (F.abs(ratio - s) <= SHARE_TOLERANCE for s in SHARES))
    return rows.where("assenza_alunno and dich > 0 and min_prog > 0").where(~usual).select("doc_id", "giorno", F.round(ratio, 6).alias("quota"))


def odd_durations(rows: DataFrame) -> DataFrame:
    """(doc_id, giorno): typed rows whose programmed duration is an hour or more off the one that all others of the weekday, two at
    least, share. Without a row, a weekday's extremes are its first or second."""
    known = rows.where("min_prog is not null").select("doc_id", "giorno", (F.col("giorno") % 7).alias("w"), "min_prog")
    week = known.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("min_prog")).alias("v"))
    last = F.size("v")
    joined = known.join(week.where("n >= 3"), ["doc_id", "w"])
    low = F.when(F.col("v")[0] == F.col("min_prog"), F.col("v")[1]).otherwise(F.col("v")[0])
    high = F.when(F.element_at("v", last) == F.col("min_prog"), F.element_at("v", last - 1)).otherwise(F.element_at("v", last))
    return joined.where((low == high) & (F.abs(F.col("min_prog") - low) >= ODD_DURATION)).select("doc_id", "giorno")


def neighbour_notes(notes: DataFrame, least: float = ALIKE_NEIGHBOUR) -> DataFrame:
    """Doubtful notes (doc_id, giorno, note, dubbia) with ``vicina``: a sure note of the day before or after that is alike by
    matching blocks, the day before first."""
    sure = notes.where(~F.col("dubbia") & F.col("note").isNotNull())
    near = notes.where("dubbia and note is not null").select("doc_id", "giorno", "note")
    for name, shift in (("prima", 1), ("dopo", -1)):
        near = near.join(sure.select("doc_id", (F.col("giorno") + shift).alias("giorno"), F.col("note").alias(name)), ["doc_id", "giorno"], "left")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("note", "prima", "dopo")), strict=True)
            found = [next((x for x in (before, after) if x and alike(note, x) >= least), None) for note, before, after in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "giorno", "note")), pa.array(found, pa.string())], names=["doc_id", "giorno", "note", "vicina"])

    kinds = {f.name: f.dataType.simpleString() for f in near.schema}
    return near.mapInArrow(run, f"doc_id {kinds['doc_id']}, giorno {kinds['giorno']}, note string, vicina string")


def merge_total(first: DataFrame, again: DataFrame, sums: DataFrame) -> DataFrame:
    """(doc_id, totale, incerto, illeggibile) of two readings of the monthly total (doc_id, totale, incerto, illeggibile):
    equal ones are cleared, in doubt only if the second doubts it and the sum of days differs; another value of the second is
    taken, in doubt unless it equals the sum; sums: (doc_id, ore_dichiarate) after the rows were merged."""
    b = again.select("doc_id", F.col("totale").alias("b"), F.col("incerto").alias("b_inc"), F.col("illeggibile").alias("b_ill"))
    j = first.join(b, "doc_id", "left").join(sums.select("doc_id", "ore_dichiarate"), "doc_id", "left")
    read, agrees = F.col("b_ill").isNotNull(), F.coalesce(F.abs(F.col("b") - F.col("ore_dichiarate")) <= 0.01, F.lit(False))
    same = ~F.col("illeggibile") & same_value("ore_dichiarate", F.col("totale"), F.col("b"))
    none, only = read & F.col("illeggibile") & F.col("b_ill"), read & F.col("b_ill")
    value = F.when(none, F.lit(None)).when(~read | only | same, F.col("totale")).otherwise(F.col("b"))
    doubt = F.when(~read, F.col("incerto")).when(none, False).when(only, True).when(same, F.col("b_inc") & ~agrees).otherwise(F.col("b_inc") | ~agrees)
    return j.select("doc_id", value.alias("totale"), doubt.alias("incerto"), F.when(read, none).otherwise(F.col("illeggibile")).alias("illeggibile"))


def document_confidence(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """(doc_id, confidence): 0.85 of the mean cell probability and 0.15 of the grid's score, within 0..1, three decimals."""
    mean = cells.groupBy("doc_id").agg(F.avg("p").alias("p")).join(grid, "doc_id", "left")
    return mean.select("doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), CONFIDENCE_CELLS * F.col("p") + CONFIDENCE_GRID * F.coalesce("score", F.lit(0.0)))), 3).alias("confidence"))


def costs(usage: DataFrame, prices: DataFrame, default: str) -> DataFrame:
    """(doc_id, input_tokens, output_tokens, cost_usd) of reader calls (doc_id, model, input, output, cache_write, cache_read): prices
    (model, family, price_in, price_out) by model, else by the longest family in the model's name, else of the default, else
    unknown. The price list is a few rows; each model is priced once."""
    models = usage.select("model").distinct()
    exact = F.broadcast(prices.select("model", F.struct("price_in", "price_out").alias("own")))
    family = F.broadcast(prices.groupBy("family").agg(F.min_by(F.struct("price_in", "price_out"), "model").alias("kin")))
    base = F.broadcast(prices.where(F.col("model") == default).agg(F.first(F.struct("price_in", "price_out")).alias("base")))
    kin = models.join(family, F.contains("model", "family")).groupBy("model").agg(F.max_by("kin", F.struct(F.length("family"), "family")).alias("kin"))
    priced = models.join(exact, "model", "left").join(kin, "model", "left").join(base).select("model", F.coalesce("own", "kin", "base").alias("price"))
    j = usage.join(priced, usage["model"].eqNullSafe(priced["model"]), "left")
    cost = ((F.col("input") + CACHE_WRITE * F.col("cache_write") + CACHE_READ * F.col("cache_read")) * F.col("price.price_in") + F.col("output") * F.col("price.price_out")) / 1e6
    return j.groupBy("doc_id").agg(F.sum(F.col("input") + F.col("cache_write") + F.col("cache_read")).alias("input_tokens"), F.sum("output").alias("output_tokens"), F.round(F.sum(cost), 6).alias("cost_usd"))


def list_order(key: str, descending: bool = False) -> list[Column]:
    """The sheet list's orders; the id settles ties. States go by rank."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATE_RANK)), state_key()), F.lit(0))
    by = {"stato": rank, "periodo": F.col("anno") * 100 + F.col("mese"), "ore": F.col("ore_riconosciute"), "operatore": normal(F.col("operatore")), "alunno": normal(F.col("alunno")), "istituto": normal(F.col("istituto")), "caricato": F.col("created_at")}[key] if key != "file" else F.lower("source_file")
    return [by.desc_nulls_last() if descending else by.asc_nulls_last(), F.col("doc_id")]


def store_order() -> list[Column]:
    """The store's own order: when a sheet came, its file without regard to case, its page."""
    return [F.col("created_at").asc_nulls_first(), F.lower("source_file"), F.col("source_page"), F.col("doc_id")]


def queue(sheets: DataFrame, most: int = 40) -> DataFrame:
    """The dashboard's queue: sheets being read and waiting, then the latest finished, ``most`` in all (a report's top)."""
    place = F.when(F.col("status") == "in_lavorazione", 0).when(F.col("status") == "in_coda", 1).otherwise(2)
    return sheets.withColumn("posto", place).orderBy("posto", F.when(F.col("posto") < 2, F.col("created_at")), F.when(F.col("posto") == 2, F.col("updated_at")).desc_nulls_last(), "doc_id").limit(most)


def visible_totals(report: DataFrame, sums: list[str]) -> DataFrame:
    """The total row of the rows that a filter left: their number and the sums of these columns."""
    return report.agg(F.count(F.lit(1)).alias("righe"), *(F.sum(c).alias(c) for c in sums))
