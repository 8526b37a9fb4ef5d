"""What a reading says, and flags that follow from a whole page.

Readings are (doc_id, giorno, campo, candidates array<struct<value:int,logprob:double>>, free_value int,
free_logprob double); times are minutes of the day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import admissible_hours
from ..plans.model import DAY_FIELDS, HOUR_FIELDS

# Pseudo-counts of minutes, floors, weights of hours off school, and page thresholds.
PSEUDO, PSEUDO_OTHER, FLOOR, FLOOR_OTHER, IN_USE = {0: 3.0, 30: 2.0, 15: 0.5, 45: 0.5}, 0.02, -2.5, -5.0, 3
EDGE, OUTSIDE = -1.0, -2.5
OUTLIER_MINUTES, OUTLIER_REFERENCES = 90, 6
DIFFICULT_SHARE, DIFFICULT_CELLS = 0.85, 20
PAGE_ALIGNED, ROW_ALIGNED = 0.7, 0.5
TOTAL_SHARE, DAYS_FOR_YEAR, YEAR_MARGIN = 0.1, 8, 3.0
# End of fixed values.


def log_sum_exp(values: Column) -> Column:
    """Of an array of logarithms; null if it is empty."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def evidence(readings: DataFrame, prior: Column | None = None) -> DataFrame:
    """Readings with ``options`` (value, logprob normalised over admissible values, best first) and ``coverage``: how much of
    the probability they hold against a free reading that is none of them. prior: a function of x, an SQL name."""
    lp = F.transform("candidates", lambda c: c["logprob"])
    z = log_sum_exp(lp)
    known = F.exists("candidates", lambda c: c["value"] == F.col("free_value"))
    other = F.when(F.col("free_logprob").isNotNull() & ~F.coalesce(known, F.lit(False)), F.col("free_logprob"))
    coverage = F.when(F.size("candidates") == 0, 0.0).otherwise(F.exp(z - log_sum_exp(F.array_compact(F.array(z, other)))))
    scored = F.transform("candidates", lambda c: F.struct((c["logprob"] + (prior(c["value"]) if prior else F.lit(0.0))).alias("lp"), c["value"].alias("value")))
    norm = log_sum_exp(F.transform(scored, lambda s: s["lp"]))
    ranked = F.array_sort(F.transform(scored, lambda s: F.struct((norm - s["lp"]).alias("cost"), s["value"].alias("value"))))
    return readings.withColumn("coverage", coverage).withColumn("options", F.transform(ranked, lambda s: F.struct(s["value"].alias("value"), (-s["cost"]).alias("logprob"))))


def minute_prior(times: DataFrame) -> DataFrame:
    """(doc_id, minuto, peso): the preference for each five-minute mark on a page, 0 for the full hour; marks that aren't
    quarters count only if the page has them several times. times: (doc_id, minuti)."""
    marks = F.array(*(F.struct(F.lit(m).alias("minuto"), F.lit(PSEUDO.get(m, PSEUDO_OTHER)).alias("pseudo"), F.lit(m in PSEUDO).alias("quarto")) for m in range(0, 60, 5)))
    seen = times.where("minuti is not null").groupBy("doc_id", (F.col("minuti") % 60).alias("minuto")).agg(F.count(F.lit(1)).alias("n"))
    spine = times.select("doc_id").distinct().select("doc_id", F.explode(marks).alias("k")).select("doc_id", "k.*")
    counted = spine.join(seen, ["doc_id", "minuto"], "left").withColumn("c", F.col("pseudo") + F.when(F.col("quarto") | (F.col("n") >= IN_USE), F.coalesce("n", F.lit(0))).otherwise(0))
    full = counted.where("minuto = 0").select("doc_id", F.col("c").alias("c0"))
    floor = F.when(F.col("quarto") | (F.col("c") >= IN_USE), FLOOR).otherwise(FLOOR_OTHER)
    weight = F.when(F.col("minuto") == 0, 0.0).otherwise(F.greatest(floor, F.least(F.lit(0.0), F.log(F.col("c") / F.col("c0")))))
    return counted.join(full, "doc_id").select("doc_id", "minuto", F.round(weight, 6).alias("peso"))


def hours_prior(minutes: Column) -> Column:
    """Whole hours are likelier than halves, halves than quarters; beyond a school day less likely."""
    rest = minutes % 60
    return F.when(rest == 0, 0.0).when(rest == 30, -0.4).otherwise(-0.9) + F.when((minutes <= 0) | (minutes > 480), -1.0).otherwise(0.0)


def _sure(rows: DataFrame) -> DataFrame:
    """(doc_id, giorno, campo, m) of times that are read without doubt."""
    cells = F.array(*(F.struct(F.lit(f).alias("campo"), F.col(f"min_{f}").alias("m")) for f in HOUR_FIELDS[:4]))
    out = rows.select("doc_id", "giorno", "incerti", "illeggibili", F.explode(cells).alias("c")).where("c.m is not null")
    return out.where(~F.array_contains("incerti", F.col("c.campo")) & ~F.array_contains("illeggibili", F.col("c.campo"))).select("doc_id", "giorno", "c.*")


def time_outliers(rows: DataFrame) -> DataFrame:
    """(doc_id, giorno, campo): sure times far beyond all sure times of other days, six at least. Each day's extremes are
    enough: without a day, a page's extreme is its first or its second."""
    sure = _sure(rows)
    by_day = sure.groupBy("doc_id", "giorno").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count(F.lit(1)).alias("n"))
    page = by_day.groupBy("doc_id").agg(F.sum("n").alias("total"), F.slice(F.array_sort(F.collect_list(F.struct("lo", "giorno"))), 1, 2).alias("los"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("hi")).alias("hi"), "giorno"))), 1, 2).alias("his"))
    other = lambda c, f: F.when(F.col(c)[0]["giorno"] != F.col("giorno"), F.col(c)[0][f]).otherwise(F.get(F.col(c), F.lit(1))[f])
    ready = sure.join(by_day.select("doc_id", "giorno", "n"), ["doc_id", "giorno"]).join(page, "doc_id").withColumns({"others": F.col("total") - F.col("n"), "low": other("los", "lo"), "high": -other("his", "hi")})
    return ready.where((F.col("others") >= OUTLIER_REFERENCES) & ((F.col("m") > F.col("high") + OUTLIER_MINUTES) | (F.col("m") < F.col("low") - OUTLIER_MINUTES))).select("doc_id", "giorno", "campo")


def difficult_pages(rows: DataFrame) -> DataFrame:
    """(doc_id, celle, dubbie): pages on which nearly all times and hours are in doubt, so that all should be checked."""
    doubt = lambda f: F.array_contains("incerti", f) | F.array_contains("illeggibili", f)
    cells = reduce(lambda a, b: a + b, ((F.col(f).isNotNull() | doubt(f)).cast("int") for f in HOUR_FIELDS))
    flagged = reduce(lambda a, b: a + b, (doubt(f).cast("int") for f in HOUR_FIELDS))
    page = rows.groupBy("doc_id").agg(F.sum(cells).alias("celle"), F.sum(flagged).alias("dubbie"))
    return page.where((F.col("celle") >= DIFFICULT_CELLS) & (F.col("dubbie") >= DIFFICULT_SHARE * F.col("celle")) & (F.col("dubbie") < F.col("celle")))


def flag_all(rows: DataFrame, pages: DataFrame, fields: list[str] = HOUR_FIELDS, only_written: bool = True) -> DataFrame:
    """Rows of these pages (doc_id, and giorno if only some days) with all, or all written, fields in doubt."""
    keys = [k for k in ("doc_id", "giorno") if k in pages.columns]
    marked = rows.join(pages.select(*keys, F.lit(True).alias("_all")).distinct(), keys, "left")
    named = F.array_compact(F.array(*(F.when(F.col(f).isNotNull() if only_written else F.lit(True), F.lit(f)) for f in fields)))
    return marked.withColumn("incerti", F.when(F.col("_all"), F.array_union("incerti", F.array_except(named, F.col("illeggibili")))).otherwise(F.col("incerti"))).drop("_all")


def unreliable_grid(rows: DataFrame, grids: DataFrame) -> DataFrame:
    """Rows with every field in doubt, empty ones too, where the page's or the row's grid isn't aligned.
    grids: (doc_id, alignment, row_quality)."""
    bad = grids.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(31))).alias("giorno"), "alignment", "row_quality").where((F.col("alignment") < PAGE_ALIGNED) | (F.get("row_quality", F.col("giorno") - 1) < ROW_ALIGNED))
    return flag_all(rows, bad.select("doc_id", "giorno"), DAY_FIELDS, only_written=False)


def choose_total(options: DataFrame, sums: DataFrame) -> DataFrame:
    """(doc_id, valore, incerto): of the three best readings of the monthly total the one that equals the sum of daily hours
    if it has a tenth of the probability; else the best, in doubt unless illegible days may explain the difference.
    options: (doc_id, options); sums: (doc_id, somma, mancanti), in minutes."""
    joined = options.join(sums, "doc_id")
    equal = F.get(F.filter(F.slice("options", 1, 3), lambda o: (o["value"] == F.col("somma")) & (F.exp(o["logprob"]) >= TOTAL_SHARE)), F.lit(0))
    top = F.get("options", F.lit(0))
    within = (F.col("mancanti") > 0) & top["value"].between(F.col("somma"), F.col("somma") + 480 * F.col("mancanti"))
    return joined.select("doc_id", F.coalesce(equal["value"], top["value"]).alias("valore"), F.when(equal.isNotNull(), equal["value"] != top["value"]).otherwise((top["value"] != F.col("somma")) & ~within).alias("incerto"))


def total_on_last_row(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc_id, totale): a number on day 31 that can't be a day's hours is the monthly total, where the sheet has none."""
    last = rows.where((F.col("giorno") == 31) & (F.col("ore_dichiarate") > 24)).select("doc_id", F.col("ore_dichiarate").alias("totale"))
    return last.join(sheets.where("totale_mensile_dichiarato is null").select("doc_id"), "doc_id", "left_semi")


def year_by_calendar(penalties: DataFrame, worked: DataFrame) -> DataFrame:
    """(doc_id, mese, anno): where eight worked days or more fit one year (two Saturdays at most) and every other worse by three.
    penalties as calendar_penalty gives them."""
    own = penalties.groupBy("doc_id", "mese").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("penalty")).alias("cost"), "anno"))), 1, 2).alias("best"))
    days = worked.groupBy("doc_id").agg(F.count_distinct("giorno").alias("giorni")).where(F.col("giorni") >= DAYS_FOR_YEAR)
    first, second = F.col("best")[0], F.get("best", F.lit(1))
    return own.join(days, "doc_id").where((first["cost"] <= 1.0) & (second.isNull() | (second["cost"] >= first["cost"] + YEAR_MARGIN))).select("doc_id", "mese", first["anno"].alias("anno"))


def admissible_cells(rows: DataFrame) -> DataFrame:
    """Typed rows with ``ammesse``: whether every written time and hour is one that the form admits."""
    times = [F.col(f"min_{f}").isNull() | (F.col(f"min_{f}").between(360, 1200) & (F.col(f"min_{f}") % 5 == 0)) for f in HOUR_FIELDS[:4]]
    return rows.withColumn("ammesse", reduce(lambda a, b: a & b, times) & F.coalesce(admissible_hours(F.col("ore_dichiarate")), F.lit(True)))
