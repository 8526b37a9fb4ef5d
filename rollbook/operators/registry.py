"""The registry of names: learning with retraction, matching of misread names, and deduction.

Tables: values (campo, chiave, valore), associations (op_key, al_key, operatore, alunno, istituto, ente), and
contributions (doc_id, campo, chiave, valore, aggiornato). Counts are aggregates over contributions, so a
changed or withdrawn document needs no counter to be decremented.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import likeness
from ..functions.values import clean, enough_letters, name_key, normal

# Thresholds by field (replace, coverage, coverage if associated, suggest), bonuses and margins.
LIMITS = {"operatore": (0.72, 0.60, 0.40, 0.70), "alunno": (0.72, 0.60, 0.40, 0.70), "istituto": (0.62, 0.35, 0.25, 0.55), "ente": (0.70, 0.55, 0.30, 0.55)}
SURE, SURE_COVERAGE, MARGIN, BONUS_ONE, BONUS_PAIR = 0.90, 0.80, 0.08, 0.10, 0.15
MAX_LENGTH, MAX_CONTRIBUTIONS = 200, 20_000
# End of fixed values.
FIELDS = list(LIMITS)
DEDUCED = [*FIELDS, "lotto", "municipalita", "ore_pei"]
#: Registry entries of one block, and distinct readings that a task compares with it.
BLOCK, READINGS = 20_000, 2_000


def least_score(field: str) -> float:
    """Entries less alike than this change no decision about a field: with every bonus they are no suggestion, nor do they come
    within the margin of an entry that may replace the reading."""
    replace, _, _, suggest = LIMITS[field]
    return min(suggest, replace - MARGIN) - BONUS_PAIR


class Bounds:
    """Upper bounds of a reading's likeness to all entries of a block, from their characters alone: matching blocks can't be longer than
    the characters that both have, and each other character costs a half at least, a missing one a whole."""

    def __init__(self, names: list[str]):
        texts = [n.replace(" ", "") for n in names]
        self.size = np.array([len(t) for t in texts], np.int32)
        self.count = np.zeros((len(texts), 64), np.int16)
        for i, t in enumerate(texts):
            np.add.at(self.count[i], [ord(ch) & 63 for ch in t], 1)

    def of(self, name: str) -> np.ndarray:
        text = name.replace(" ", "")
        own = np.bincount([ord(ch) & 63 for ch in text], minlength=64).astype(np.int16)
        common = np.minimum(self.count, own).sum(1)
        low, high = np.minimum(self.size, len(text)), np.maximum(self.size, len(text))
        edit = 1 - ((high - low) + 0.5 * (low - common)) / np.maximum(high, 1)
        return np.round((2 * common / np.maximum(low + high, 1) + np.maximum(edit, 0)) / 2 + 1e-4, 6)


def value_order() -> list[Column]:
    """Registry entries by how often they occur, then by value."""
    return [F.desc("conteggio"), F.col("valore")]


def export_order() -> list[Column]:
    """Registry entries as an export lists them: by field and normalised text."""
    return [F.col("campo"), normal(F.col("valore")), F.col("valore")]


def trusted(field: str) -> Column:
    """Edited by hand, or confirmed and not flagged."""
    return F.array_contains("user_edited", f"header.{field}") | (F.col("user_verified") & ~F.array_contains(F.array_union("h_incerti", "h_illeggibili"), field))


def contributions(sheets: DataFrame) -> DataFrame:
    """What each sheet teaches: (doc_id, campo, chiave, valore, aggiornato)."""
    told = F.array(*(F.when(trusted(f), F.struct(F.lit(f).alias("campo"), clean(F.col(f)).alias("valore"))) for f in FIELDS))
    one = sheets.where("is_foglio_firma").select("doc_id", F.col("updated_at").alias("aggiornato"), F.explode(F.array_compact(told)).alias("x")).select("doc_id", "x.*", "aggiornato")
    return one.where(enough_letters(F.col("valore")) & (F.length("valore") <= MAX_LENGTH)).select("doc_id", "campo", name_key(F.col("valore")).alias("chiave"), "valore", "aggiornato")


def values(contributed: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(campo, chiave, valore, conteggio, ultimo_uso, manuale): one entry for each key, under the latest spelling; entries
    made by hand stay without documents."""
    counted = contributed.groupBy("campo", "chiave").agg(F.max_by("valore", F.struct("aggiornato", "doc_id")).alias("valore"), F.count_distinct("doc_id").alias("conteggio"), F.max("aggiornato").alias("ultimo_uso"))
    if manual is None:
        return counted.withColumn("manuale", F.lit(False))
    own = manual.where(enough_letters(F.col("valore")) & (F.length("valore") <= MAX_LENGTH)).select("campo", name_key(F.col("valore")).alias("chiave"), clean(F.col("valore")).alias("m")).dropDuplicates(["campo", "chiave"])
    both = counted.join(own, ["campo", "chiave"], "full")
    return both.select("campo", "chiave", F.coalesce("valore", "m").alias("valore"), F.coalesce("conteggio", F.lit(0)).alias("conteggio"), "ultimo_uso", F.col("m").isNotNull().alias("manuale"))


def remove(values_: DataFrame, associations: DataFrame, contributed: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes entries (campo, valore): persons take their associations along, schools and entities are only blanked there,
    and contributions lose their link."""
    keys = gone.select("campo", name_key(F.col("valore")).alias("chiave")).distinct()
    persons = [associations.join(keys.where(F.col("campo") == f).select(F.col("chiave").alias(k)), k, "left_anti") for f, k in (("operatore", "op_key"),)]
    kept = persons[0].join(keys.where("campo = 'alunno'").select(F.col("chiave").alias("al_key")), "al_key", "left_anti")
    for f in ("istituto", "ente"):
        flagged = keys.where(F.col("campo") == f).select(F.col("chiave").alias("k"), F.lit(True).alias("x"))
        kept = kept.withColumn("k", name_key(F.col(f))).join(flagged, "k", "left").withColumn(f, F.when(F.col("x"), F.lit(None)).otherwise(F.col(f))).drop("k", "x")
    return values_.join(keys, ["campo", "chiave"], "left_anti"), kept.select(associations.columns), contributed.join(keys, ["campo", "chiave"], "left_anti")


def evicted(contributed: DataFrame, most: int = MAX_CONTRIBUTIONS) -> DataFrame:
    """Contributions of the ``most`` latest documents; older ones are unlinked."""
    latest = contributed.groupBy("doc_id").agg(F.max("aggiornato").alias("t")).orderBy(F.desc("t"), "doc_id").limit(most)
    return contributed.join(latest.select("doc_id"), "doc_id", "left_semi")


def to_json(values_: DataFrame, associations: DataFrame, contributed: DataFrame) -> DataFrame:
    """One row (value): the registry as the file that sources.store.registry() reads, keys in order. The registry of one office is
    small; it is its file's size that bounds this."""
    fields = values_.groupBy("campo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chiave", F.struct("valore", "conteggio", "ultimo_uso", "manuale"))))).alias("m"))
    entries = fields.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("campo", F.to_json("m"))))).alias("campi"))
    columns = [c for c in associations.columns if c not in ("op_key", "al_key", "k")]
    key = F.col("k") if "k" in associations.columns else F.concat_ws("|", "op_key", "al_key")
    links = associations.select(key.alias("k"), F.struct(*columns).alias("v")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", F.to_json("v").alias("v"))))).alias("associazioni"))
    one = contributed.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("campo", "chiave")))).alias("campi"), F.max("aggiornato").alias("aggiornato"))
    docs = one.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_id", F.to_json(F.struct("campi", "aggiornato")).alias("v"))))).alias("documenti"))
    whole = entries.join(links).join(docs)
    # the maps hold JSON already: they are put together as text
    block = lambda c: F.concat(F.lit(f'"{c}":{{'), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ","), F.lit("}"))
    return whole.select(F.concat(F.lit("{"), block("campi"), F.lit(","), block("associazioni"), F.lit(","), block("documenti"), F.lit("}")).alias("value"))


def match(readings: DataFrame, vocabulary: DataFrame, bonuses: DataFrame | None = None) -> DataFrame:
    """Decisions for readings (doc_id, campo, letto): identico, sostituito, ambiguo, simile or nuovo.

    vocabulary: (campo, chiave, valore); bonuses: (doc_id, campo, chiave, bonus). Equal keys are found by a join. Only
    distinct readings that are left meet the vocabulary of their field, in blocks of bounded size that a task holds in memory;
    bounds from the characters rule most entries out, and only candidates that can matter leave the task to be ranked.
    """
    # ``in`` names of the struct are those of likeness()
    text = readings.select("doc_id", "campo", clean(F.col("letto")).alias("letto")).where(enough_letters(F.col("letto")))
    keyed = text.withColumn("chiave", name_key(F.col("letto")))
    known = vocabulary.select("campo", "chiave", F.col("valore").alias("noto"))
    same = keyed.join(known, ["campo", "chiave"]).select("doc_id", "campo", "letto", F.lit("identico").alias("esito"), F.col("noto").alias("valore"), F.lit(1.0).alias("somiglianza"), F.lit(False).alias("incerto"))
    rest = keyed.join(known.select("campo", "chiave"), ["campo", "chiave"], "left_anti")
    distinct = rest.select("campo", "letto").distinct().withColumn("n", normal(F.col("letto")))
    blocks, parts = max(1, -(-vocabulary.count() // BLOCK)), max(1, -(-distinct.count() // READINGS))
    placed = vocabulary.select("campo", "chiave", "valore", normal(F.col("valore")).alias("n"), F.pmod(F.xxhash64("campo", "chiave"), F.lit(blocks)).alias("block"))
    schema = pa.schema([("campo", pa.string()), ("letto", pa.string()), ("chiave", pa.string()), ("noto", pa.string()), ("s", pa.float64()), ("c", pa.float64()), ("sospetta", pa.bool_()), ("numeri", pa.bool_())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        words = right.to_pylist()
        bounds = Bounds([w["n"] for w in words])
        out = []
        for r in left.to_pylist():
            least = least_score(r["campo"])
            for k in np.flatnonzero(bounds.of(r["n"]) >= least):
                scored = likeness(r["n"], words[k]["n"])
                if scored[0] >= least:
                    out.append((r["campo"], r["letto"], words[k]["chiave"], words[k]["valore"], *scored))
        return pa.table([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    # every block of the vocabulary meets every part of the readings once; both have bounded sizes
    left = distinct.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("letto"), F.lit(parts)))
    right = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = left.groupBy("campo", "block", "part").cogroup(right.groupBy("campo", "block", "part")).applyInArrow(compare, "campo string, letto string, chiave string, noto string, s double, c double, sospetta boolean, numeri boolean")
    scored = rest.select("doc_id", "campo", "letto").join(found, ["campo", "letto"], "left")
    if bonuses is not None:
        scored = scored.join(bonuses, ["doc_id", "campo", "chiave"], "left")
    bonus = F.coalesce("bonus", F.lit(0.0)) if bonuses is not None else F.lit(0.0)
    cand = F.struct((-F.round(F.col("s") + bonus, 6)).alias("p"), (-F.col("s")).alias("ns"), F.col("noto"), F.col("c"), bonus.alias("b"), F.col("sospetta"), F.col("numeri"))
    ranked = scored.withColumn("x", F.when(F.col("noto").isNotNull(), cand)).groupBy("doc_id", "campo", "letto").agg(F.array_sort(F.collect_list("x")).alias("cs"))
    limit = lambda k: F.element_at(F.create_map(*[v for f, l in LIMITS.items() for v in (F.lit(f), F.lit(l[k]))]), F.col("campo"))
    best, near = F.try_element_at("cs", F.lit(1)), F.filter("cs", lambda x: (-x["ns"] >= limit(3)) | (-x["p"] >= limit(0)) | ((x["b"] > 0) & (-x["p"] >= limit(3))))
    out = ranked.withColumns({"best": best, "second": F.coalesce(-F.try_element_at("cs", F.lit(2))["p"], F.lit(0.0)), "near": near})
    need = F.when(F.col("best.b") > 0, limit(2)).otherwise(limit(1))
    replaced = F.coalesce((-F.col("best.p") >= limit(0)) & (F.col("best.c") >= need) & (-F.col("best.p") - F.col("second") >= MARGIN) & ~F.col("best.sospetta"), F.lit(False))
    ambiguous = F.coalesce((F.size("near") > 1) & (-F.try_element_at("near", F.lit(2))["p"] >= -F.col("best.p") - MARGIN), F.lit(False))
    sure = (-F.col("best.ns") >= SURE) & (F.col("best.c") >= SURE_COVERAGE) & F.col("best.numeri")
    decision = F.when(replaced, "sostituito").when(F.size("near") == 0, "nuovo").when(ambiguous, "ambiguo").otherwise("simile")
    decided = out.select("doc_id", "campo", "letto", decision.alias("esito"), F.when(replaced, F.col("best.noto")).alias("valore"), F.when(decision != "nuovo", -F.col("best.ns")).otherwise(0.0).alias("somiglianza"), F.when(replaced, ~sure).otherwise(decision != "nuovo").alias("incerto"))
    return same.unionByName(decided)


def association_bonuses(resolved: DataFrame, associations: DataFrame, field: str) -> DataFrame:
    """(doc_id, campo, chiave, bonus) for a field: entries associated with the recognised operator or pupil, more for both.
    resolved: (doc_id, op_key, al_key), null where not recognised."""
    a = associations.select(F.col("op_key").alias("a_op"), F.col("al_key").alias("a_al"), name_key(F.col(field)).alias("chiave")).where("chiave <> ''")
    by_op = resolved.where("op_key is not null").join(a, F.col("op_key") == F.col("a_op"))
    by_al = resolved.where("al_key is not null").join(a, F.col("al_key") == F.col("a_al"))
    if field == "operatore":
        found = by_al.withColumn("w", F.lit(BONUS_ONE))
    elif field == "alunno":
        found = by_op.withColumn("w", F.lit(BONUS_ONE))
    else:
        found = by_op.withColumn("w", F.when(F.coalesce(F.col("al_key") == F.col("a_al"), F.lit(False)), BONUS_PAIR).otherwise(BONUS_ONE)).unionByName(by_al.withColumn("w", F.lit(BONUS_ONE)))
    return found.groupBy("doc_id", "chiave").agg(F.max("w").alias("bonus")).withColumn("campo", F.lit(field))


def deduce(resolved: DataFrame, associations: DataFrame, field: str) -> DataFrame:
    """(doc_id, campo, valore): the only value that the associations of the recognised operator and pupil give, if all give one."""
    both = (F.col("op_key").isNull() | (F.col("op_key") == F.col("a_op"))) & (F.col("al_key").isNull() | (F.col("al_key") == F.col("a_al")))
    a = associations.select(F.col("op_key").alias("a_op"), F.col("al_key").alias("a_al"), F.col(field).alias("v"))
    by_op = resolved.where("op_key is not null").join(a, F.col("op_key") == F.col("a_op")).where(both)
    by_al = resolved.where("op_key is null and al_key is not null").join(a, F.col("al_key") == F.col("a_al"))
    return by_op.unionByName(by_al).groupBy("doc_id").agg(F.count_distinct(name_key(F.col("v").cast("string"))).alias("k"), F.count(F.lit(1)).alias("n"), F.count("v").alias("m"), F.max("v").alias("valore")).where("k = 1 and n = m").select("doc_id", F.lit(field).alias("campo"), "valore")


def correct(sheets: DataFrame, vocabulary: DataFrame, associations: DataFrame) -> DataFrame:
    """All decisions for flat sheets, in fixed order: operator, pupil, the operator again with the pupil's associations if it
    was not recognised, school, entity. Bonuses rest on what is recognised so far. Then illegible fields without a value are
    deduced (dedotto, in doubt) where the associations leave one value."""
    read = lambda f: sheets.select("doc_id", F.lit(f).alias("campo"), F.col(f).alias("letto"))
    known = lambda f: vocabulary.where(F.col("campo") == f)
    good = F.col("esito").isin("identico", "sostituito")

    def keys(op: DataFrame | None, al: DataFrame | None) -> DataFrame:
        out = sheets.select("doc_id")
        for d, k in ((op, "op_key"), (al, "al_key")):
            got = d.where(good).select("doc_id", name_key(F.col("valore")).alias(k)) if d is not None else None
            out = out.join(got, "doc_id", "left") if got is not None else out.withColumn(k, F.lit(None).cast("string"))
        return out

    op = match(read("operatore"), known("operatore"))
    al = match(read("alunno"), known("alunno"), association_bonuses(keys(op, None), associations, "alunno"))
    undone = keys(op, al).where("op_key is null and al_key is not null")
    again = match(read("operatore").join(undone.select("doc_id"), "doc_id", "left_semi"), known("operatore"), association_bonuses(undone, associations, "operatore")).where(good)
    op = op.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(again)
    out, resolved = op.unionByName(al), keys(op, al)
    for f in ("istituto", "ente"):
        out = out.unionByName(match(read(f), known(f), association_bonuses(resolved, associations, f)))
    for f in DEDUCED:
        if f in sheets.columns and f in associations.columns:
            lost = sheets.where(F.col(f).isNull() & F.array_contains("h_illeggibili", f)).select("doc_id")
            told = deduce(resolved.join(lost, "doc_id", "left_semi"), associations, f)
            out = out.unionByName(told.select("doc_id", "campo", F.lit(None).cast("string").alias("letto"), F.lit("dedotto").alias("esito"), F.col("valore").cast("string").alias("valore"), F.lit(0.0).alias("somiglianza"), F.lit(True).alias("incerto")))
    return out


def apply_decision(value: Column, uncertain: Column, illegible: Column, field: Column, decision: Column) -> Column:
    """A struct of value, incerti and illeggibili after a decision (struct esito, valore, incerto): what is recognised or
    deduced replaces the value and isn't illegible any more; identical clears the doubt, others set it."""
    takes = decision["esito"].isin("identico", "sostituito", "dedotto") & decision["valore"].isNotNull()
    left = F.when(takes, F.array_remove(illegible, field)).otherwise(illegible)
    doubt = F.when(decision["incerto"], F.array_union(uncertain, F.array(field))).when(decision["esito"].isin("identico", "sostituito"), F.array_remove(uncertain, field)).otherwise(uncertain)
    return F.struct(F.when(takes, decision["valore"]).otherwise(value).alias("valore"), doubt.alias("incerti"), left.alias("illeggibili"))
