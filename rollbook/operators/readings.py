"""Reconciling uncertain readings: the likeliest coherent row, consensus within a sheet, second opinions and re-reads.

Readings are (doc_id, giorno, campo, candidates array<struct<value:int,logprob:double>>); times are minutes of the
day and hours are minutes too, so that all relations are exact.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import DAY_FIELDS, HOUR_FIELDS

# Weights of a row's coherence (logarithms), numbers of alternatives, and thresholds.
W_ORDER, W_DURATION, W_SAME, W_HOURS, W_HOURS_OFF, W_PROG, W_WITHIN, W_BEYOND = -8.0, -3.0, 1.0, 2.5, -2.0, 0.5, 0.3, -1.0
TOP, CONFIRM, SHORTEST, LONGEST = 4, 0.8, 30, 480
COHERENCE = ["E01", "E03", "W01", "W02", "W05", "W11"]
REREAD = [*COHERENCE, "E05", "W04"]
SUBSTITUTE, CONFIRM_SECOND = 0.5, 0.5
# End of fixed values.
_T = HOUR_FIELDS[:4]


def best_rows(readings: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    """(doc_id, giorno, prog_entrata, ..., ore_dichiarate, score): of all combinations of the four best alternatives of each
    field, the one with the largest sum of log probabilities and coherence; of equals the one with likelier readings
    in the fields' order. The at most 4**5 combinations of a batch's rows are scored as one numpy array."""
    if absent is None:
        absent = readings.select("doc_id", "giorno").distinct().withColumn("assente", F.lit(False))
    wide = readings.groupBy("doc_id", "giorno").agg(*(F.max(F.when(F.col("campo") == f, F.col("candidates"))).alias(f) for f in HOUR_FIELDS)).join(absent, ["doc_id", "giorno"], "left")
    schema = pa.schema([("doc_id", pa.string()), ("giorno", pa.int32()), *((f, pa.int32()) for f in HOUR_FIELDS), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                value, weight = _alternatives(part)
                out = _best_combination(value, weight, np.array([bool(x) for x in part.column("assente").to_pylist()]))
                chosen = [pa.array(v, pa.int32(), mask=np.isnan(v)) for v in out[:5]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("giorno").cast(pa.int32()), *chosen, pa.array(out[5])], schema=schema)

    return wide.mapInArrow(run, "doc_id string, giorno int, " + ", ".join(f"{f} int" for f in HOUR_FIELDS) + ", score double")


def _alternatives(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values and log probabilities of each row's fields, the best four in order: (rows, 5, 4). A field without candidates has one
    alternative, no value; what is missing beyond that can't win."""
    value, weight = np.full((part.num_rows, 5, TOP), np.nan), np.full((part.num_rows, 5, TOP), -np.inf)
    for k, f in enumerate(HOUR_FIELDS):
        for i, options in enumerate(part.column(f).to_pylist()):
            best = sorted(options or (), key=lambda o: (-o["logprob"], o["value"]))[:TOP]
            value[i, k, : len(best)] = [o["value"] for o in best]
            weight[i, k, : len(best)] = [o["logprob"] for o in best]
            if not best:
                weight[i, k, 0] = 0.0
    return value, weight


def _best_combination(value: np.ndarray, weight: np.ndarray, absent: np.ndarray) -> list[np.ndarray]:
    """The five values of each row's best combination, and its score."""
    n = len(value)
    grid = np.stack(np.meshgrid(*[np.arange(TOP)] * 5, indexing="ij")).reshape(5, -1)  # in the fields' order: the first of equals wins
    v = [value[:, k, :][:, grid[k]] for k in range(5)]
    score = sum(weight[:, k, :][:, grid[k]] for k in range(5))
    pe, pu, ee, eu, h = v
    with np.errstate(invalid="ignore"):
        for a, b in ((pe, pu), (ee, eu)):
            length = b - a
            score += np.where(length <= 0, W_ORDER, np.where((length < SHORTEST) | (length > LONGEST), W_DURATION, 0.0)) * ~np.isnan(length)
        score += W_SAME * (pe == ee) + W_SAME * (pu == eu)
        eff, prog = np.where(eu > ee, eu - ee, np.nan), np.where(pu > pe, pu - pe, np.nan)
        less = absent[:, None] & (h < eff)
        near = np.abs(eff - h) < 0.6
        score += np.where(near, W_HOURS, np.where(~np.isnan(eff) & ~np.isnan(h) & ~less, W_HOURS_OFF, 0.0))
        planned = np.abs(prog - h) < 0.6
        alone = ~np.isnan(prog) & ~np.isnan(h) & (np.isnan(ee) | np.isnan(eu))
        score += np.where(planned, W_PROG, np.where(alone, np.where(h <= prog + 0.6, W_WITHIN, W_BEYOND), 0.0))
    best = np.round(score, 9).argmax(1)
    return [*(x[np.arange(n), best] for x in v), score[np.arange(n), best]]


def _relations(field: str, v: dict) -> list[tuple[tuple[str, ...], int | None, bool]]:
    """What other cells of a row imply for one: (cells, value, whether a breach is an incoherence)."""
    pe, pu, ee, eu, h = HOUR_FIELDS
    twin = {pe: ee, ee: pe, pu: eu, eu: pu}.get(field)
    out = [((twin,), v[twin], False)] if twin and v.get(twin) is not None else []
    for a, b in ((pe, pu), (ee, eu)):
        x, y, z, strict = v.get(a), v.get(b), v.get(h), a == ee
        if field == a and None not in (y, z):
            out.append(((b, h), y - z, strict))
        if field == b and None not in (x, z):
            out.append(((a, h), x + z, strict))
        if field == h and None not in (x, y):
            out.append(((a, b), y - x if y > x else None, strict))
    return out


def consensus(cells: DataFrame) -> DataFrame:
    """(doc_id, giorno, campo): doubtful cells that become sure. cells: (doc_id, giorno, campo, value int, sure boolean,
    may boolean: its doubts can be overcome and its own reading agrees). A cell becomes sure if an exact relation with
    sure cells of its row implies its value and none of hours and times is broken; for programmed times also if all
    sure peers of the same weekday agree (two at least). Repeated to the end; sheets are small, so each is one group."""
    schema = pa.schema([("doc_id", pa.string()), ("giorno", pa.int32()), ("campo", pa.string())])

    def run(rows: pa.Table) -> pa.Table:
        cell = {(r["giorno"], r["campo"]): r for r in rows.to_pylist()}
        value = {}
        for (g, f), r in cell.items():
            value.setdefault(g, {})[f] = r["value"]
        sure, won = {k for k, r in cell.items() if r["sure"]}, []
        again = True
        while again:
            again = False
            for key in sorted(k for k, r in cell.items() if k not in sure and r["may"]):
                g, f = key
                known = [(x, strict) for others, x, strict in _relations(f, value[g]) if all((g, o) in sure for o in others)]
                holds = any(x == value[g][f] for x, _ in known)
                broken = any(x != value[g][f] and strict for x, strict in known)
                if not holds and not broken and f.startswith("prog_"):
                    peers = [value[k[0]][f] for k in sure if k[1] == f and k[0] != g and (k[0] - g) % 7 == 0]
                    holds = len(peers) >= 2 and set(peers) == {value[g][f]}
                if holds and not broken:
                    sure.add(key)
                    won.append(key)
                    again = True
        doc = rows.column("doc_id")[0].as_py() if rows.num_rows else None
        return pa.table([pa.array([doc] * len(won), pa.string()), pa.array([k[0] for k in won], pa.int32()), pa.array([k[1] for k in won], pa.string())], schema=schema)

    return cells.select("doc_id", F.col("giorno").cast("int").alias("giorno"), "campo", F.col("value").cast("int").alias("value"), "sure", "may").groupBy("doc_id").applyInArrow(run, "doc_id string, giorno int, campo string")


def _satisfied(v: dict, absent: bool) -> int:
    pe, pu, ee, eu, h = (v[f] for f in HOUR_FIELDS)
    score = sum(a is not None and a == b for a, b in ((pe, ee), (pu, eu)))
    score -= 3 * sum(None not in (a, b) and b <= a for a, b in ((pe, pu), (ee, eu)))
    if h is not None and not absent:
        if None not in (ee, eu):
            score += 2 if eu - ee == h and eu > ee else -1
        elif None not in (pe, pu):
            score += int(pu - pe == h and pu > pe)
    return score


def second_opinions(rows: DataFrame) -> DataFrame:
    """(doc_id, giorno, campo, esito, value): sostituito or confermato. rows: (doc_id, giorno, campo, value, flagged,
    blocked, opinion, confidence, plausible, absent), one for each of the five fields of a day.

    First, of all joint choices between the readers' values of flagged cells the one that satisfies most relations is
    taken, the first reader winning ties; a substituted cell stays flagged. Then a cell on which both agree is confirmed
    if an equality with a cell that the first reader was sure of, or a difference among trusted cells, implies it."""
    schema = pa.schema([("doc_id", pa.string()), ("giorno", pa.int32()), ("campo", pa.string()), ("esito", pa.string()), ("value", pa.int32())])

    def decide(cells: dict[str, dict]) -> list[tuple[str, str, int | None]]:
        base = {f: cells[f]["value"] if f in cells else None for f in HOUR_FIELDS}
        absent = any(c["absent"] for c in cells.values())
        flagged = sorted(f for f, c in cells.items() if c["flagged"])
        sure = lambda c, t: c["opinion"] is not None and c["confidence"] >= t and c["plausible"]
        options = [[base[f], *([cells[f]["opinion"]] if sure(cells[f], SUBSTITUTE) and cells[f]["opinion"] != base[f] else [])] for f in flagged]
        choices = itertools.product(*(range(len(o)) for o in options))
        chosen = max(choices, key=lambda c: (_satisfied(base | {f: o[j] for f, o, j in zip(flagged, options, c, strict=True)}, absent), -sum(c)))
        out = [(f, "sostituito", o[j]) for f, o, j in zip(flagged, options, chosen, strict=True) if j]
        taken = {f for f, _, _ in out}
        agreed = {f for f in flagged if f not in taken and sure(cells[f], CONFIRM_SECOND) and cells[f]["opinion"] == base[f]}
        solid = {f: None if f in flagged else v for f, v in base.items()}
        trusted = {f: None if f in flagged and f not in agreed else v for f, v in base.items()}
        for f in sorted(agreed):
            if cells[f]["blocked"]:
                continue
            equal = [x for others, x, _ in _relations(f, solid | {f: None}) if len(others) == 1]
            # differences count among effective times and hours only, and not while the pupil is absent
            exact = [] if absent or f.startswith("prog_") else [x for others, x, strict in _relations(f, trusted | {f: None}) if len(others) == 2 and strict]
            if base[f] in equal + exact:
                out.append((f, "confermato", base[f]))
        return out

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += [(r["doc_id"], r["giorno"], *x) for x in decide({c["campo"]: c for c in r["cells"]})]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    one = rows.select("doc_id", F.col("giorno").cast("int").alias("giorno"), F.struct("campo", F.col("value").cast("int").alias("value"), "flagged", "blocked", F.col("opinion").cast("int").alias("opinion"), F.col("confidence").cast("double").alias("confidence"), "plausible", "absent").alias("c"))
    return one.groupBy("doc_id", "giorno").agg(F.collect_list("c").alias("cells")).mapInArrow(run, "doc_id string, giorno int, campo string, esito string, value int")


def same_value(field: str, a: Column, b: Column) -> Column:
    """Equal readings of a field: hours within a hundredth, notes by their words, both absent."""
    if field == "ore_dichiarate":
        equal = F.abs(a - b) <= 0.01
    elif field == "note":
        equal = F.lower(F.regexp_replace(F.trim(a), r"\s+", " ")) == F.lower(F.regexp_replace(F.trim(b), r"\s+", " "))
    else:
        equal = a == b
    return (a.isNull() & b.isNull()) | F.coalesce(equal, F.lit(False))


def shifted(minute: Column, hours: Column, sign: int, first_reader: bool = True) -> Column:
    """A time so many hours later (sign 1) or earlier (-1): the first reader's must be one that the form admits, the second's lies
    within the day."""
    moved = minute + sign * F.round(hours * 60).cast("int")
    return F.when(moved.between(360, 1200) & (moved % 5 == 0) if first_reader else moved.between(0, 1439), moved)


def merge_readings(first: DataFrame, again: DataFrame, coherent: Column) -> DataFrame:
    """Rows of a first reading with a targeted re-read, field by field. Both have the day fields, incerti and illeggibili;
    ``coherent`` is an expression over the merged day fields.

    Illegible in both: none. Illegible again only: the first value, in doubt. Equal: the first value, cleared, in doubt
    only if the re-read doubts it and the row is incoherent. Otherwise: the re-read's value, in doubt if the re-read doubts
    it, if only one sees writing, or if the row is incoherent. An empty re-read of a filled row is ignored. A dash in the effective
    times (trattino_effettivo, if both have it) is the re-read's where both effective times are taken from it or equal."""
    keys = ["doc_id", "giorno"]
    dash = "trattino_effettivo"
    with_dash = dash in first.columns and dash in again.columns
    b = again.select(*keys, *(F.col(f).alias(f"b_{f}") for f in DAY_FIELDS), F.col("incerti").alias("b_inc"), F.col("illeggibili").alias("b_ill"), *([F.col(dash).alias(f"b_{dash}")] if with_dash else []))
    present = lambda f, c: F.coalesce(c, F.lit(False)) if f in DAY_FIELDS[5:8] else c.isNotNull()
    written = lambda p: F.array_contains(F.array(*(present(f, F.col(p + f)) for f in DAY_FIELDS)), True)
    both = first.join(b, keys, "left").withColumn("read", F.col("b_inc").isNotNull() & ~(written("") & ~written("b_") & (F.size("b_ill") == 0) & (F.size("b_inc") == 0)))
    step: dict[str, Column] = {}
    for f in DAY_FIELDS:
        a_ill, b_ill = F.array_contains("illeggibili", f), F.array_contains("b_ill", f)
        kind = (
            F.when(~F.col("read"), "keep").when(a_ill & b_ill, "none").when(b_ill, "doubt").when(~a_ill & same_value(f, F.col(f), F.col(f"b_{f}")), "same")
            .when(F.array_contains("b_inc", f) | ((a_ill | present(f, F.col(f))) != present(f, F.col(f"b_{f}"))), "taken_doubt").otherwise("taken")
        )
        step[f"k_{f}"] = kind
    told = both.withColumns(step)
    if with_dash:  # before the times are replaced
        from_again = lambda f: F.col(f"k_{f}").isin("same", "taken", "taken_doubt") | ((F.col(f"k_{f}") != "keep") & same_value(f, F.col(f), F.col(f"b_{f}")))
        told = told.withColumn(dash, F.when(from_again("eff_entrata") & from_again("eff_uscita"), F.col(f"b_{dash}")).otherwise(F.col(dash)))
    empty = {f: F.lit(False) if f in DAY_FIELDS[5:8] else F.lit(None).cast(first.schema[f].dataType) for f in DAY_FIELDS}
    merged = told.withColumns({f: F.when(F.col(f"k_{f}") == "none", empty[f]).when(F.col(f"k_{f}").startswith("taken"), F.col(f"b_{f}")).otherwise(F.col(f)) for f in DAY_FIELDS}).withColumn("coerente", F.coalesce(coherent, F.lit(False)))
    listed = lambda test: F.array_compact(F.array(*(F.when(test(f), F.lit(f)) for f in DAY_FIELDS)))
    kind = lambda f: F.col(f"k_{f}")
    doubt = lambda f: (kind(f) == "keep") & F.array_contains("incerti", f) | kind(f).isin("doubt", "taken_doubt") | (~F.col("coerente") & ((kind(f) == "taken") | ((kind(f) == "same") & F.array_contains("b_inc", f))))
    illegible = lambda f: (kind(f) == "none") | (kind(f) == "keep") & F.array_contains("illeggibili", f)
    return merged.withColumns({"incerti": listed(doubt), "illeggibili": listed(illegible)}).select(*keys, *DAY_FIELDS, *([dash] if with_dash else []), "incerti", "illeggibili")


def rows_to_reread(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, giorno): days with findings of the listed codes or flagged fields, and all days with hours of sheets whose
    monthly total differs."""
    prefix = F.substring("codice", 1, 3)
    by_code = findings.where(F.col("giorno").isNotNull() & prefix.isin(REREAD)).select("doc_id", "giorno")
    flagged = rows.where((F.size("incerti") > 0) | (F.size("illeggibili") > 0)).select("doc_id", "giorno")
    hours = rows.where(F.col("ore_dichiarate").isNotNull() | (F.col("ric") > 0)).join(findings.where(prefix == "E02").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "giorno")
    return by_code.unionByName(flagged).unionByName(hours).where(F.col("giorno").between(1, 31)).distinct()


def column_statistics(cells: DataFrame) -> DataFrame:
    """Leave-one-out statistics of a sheet's column, by algebra on counts: share of the same value among the others (three
    at least), the dominant other value with 60 % at least (the smaller of equals), least and greatest of other days.
    cells: (doc_id, campo, giorno, value)."""
    key = ["doc_id", "campo"]
    known = cells.where("value is not null")
    counts = known.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*key).agg(F.sum("n").alias("total"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))), 1, 3).alias("top"), F.slice(F.array_sort(F.collect_list("value")), 1, 2).alias("low"), F.slice(F.reverse(F.array_sort(F.collect_list("value"))), 1, 2).alias("high"))
    joined = known.join(counts, [*key, "value"]).join(top, key)
    others = F.col("total") - 1
    # the own value counts one less; the best of the three most frequent is best of all
    left = F.array_sort(F.transform("top", lambda t: F.struct((t["m"] + F.when(t["value"] == F.col("value"), 1).otherwise(0)).alias("m"), t["value"].alias("value"))))
    best = left[0]
    edge = lambda c: F.when((F.col("n") > 1) | (F.col(c)[0] != F.col("value")), F.col(c)[0]).otherwise(F.get(F.col(c), F.lit(1)))
    return joined.select(*key, "giorno", "value", F.when(others >= 3, F.round((F.col("n") - 1) / others, 6)).alias("quota"), F.when(-best["m"] >= 0.6 * F.greatest(others, F.lit(1)), best["value"]).alias("dominante"), edge("low").alias("minimo"), edge("high").alias("massimo"))


def weekday_peers(cells: DataFrame) -> DataFrame:
    """(…, pari): whether all other known values of the same weekday agree with a cell, two others at least."""
    key = ["doc_id", "campo", "resto"]
    known = cells.where("value is not null").withColumn("resto", F.col("giorno") % 7)
    grouped = known.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return known.join(grouped, key).select("doc_id", "campo", "giorno", "value", ((F.col("n") >= 3) & (F.col("lo") == F.col("hi"))).alias("pari"))


def month_posterior(scores: DataFrame) -> DataFrame:
    """(doc_id, mese, p): normalised probabilities from log scores (doc_id, mese, anno, score), the year summed out."""
    peak = scores.groupBy("doc_id").agg(F.max("score").alias("peak"))
    weighed = scores.join(peak, "doc_id").groupBy("doc_id", "mese").agg(F.sum(F.exp(F.col("score") - F.col("peak"))).alias("w"))
    return weighed.join(weighed.groupBy("doc_id").agg(F.sum("w").alias("z")), "doc_id").select("doc_id", "mese", (F.col("w") / F.col("z")).alias("p"))


def calendar_penalty(worked: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(doc_id, mese, anno, penalty): half a point for each worked Saturday, one and a half for Sundays, holidays and days
    that don't exist. worked: (doc_id, giorno); hypotheses: (mese, anno), a few rows."""
    from ..functions.calendar import day_kind

    kind = day_kind(F.col("anno"), F.col("mese"), F.col("giorno"))[0]
    cost = F.when(kind == "sabato", -0.5).when(kind == "feriale", 0.0).otherwise(-1.5)
    pairs = F.array_agg(F.struct("mese", "anno")).alias("h")
    few = hypotheses.agg(pairs).first().h
    listed = F.array(*(F.struct(F.lit(h.mese).alias("mese"), F.lit(h.anno).alias("anno")) for h in few))
    return worked.select("doc_id", "giorno", F.explode(listed).alias("h")).select("doc_id", "giorno", "h.*").groupBy("doc_id", "mese", "anno").agg(F.sum(cost).alias("penalty"))
