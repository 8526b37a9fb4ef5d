"""States, choices and flags of single fields."""

import math

from pyspark.sql import functions as F

from rollbook.operators import fields as X


def test_states(spark):
    d = spark.createDataFrame([(["a"], ["a", "b"], ["header.c"])], "illeggibili array<string>, incerti array<string>, user_edited array<string>")
    assert d.select(*(X.field_state(f, f"header.{f}").alias(f) for f in "abcd")).first() == ("illeggibile", "incerto", "corretto", "")
    assert d.select(X.worst_state(F.lit("corretto"), F.lit("incerto"))).first()[0] == "incerto"


def test_choices(spark):
    d = spark.createDataFrame([("a", 0.9, [(5, math.log(0.95)), (6, math.log(0.05))], 5), ("b", 0.01, [(5, 0.0)], None), ("c", 1.0, [(5, -0.01)], 7)], "k string, coverage double, options array<struct<value:int,logprob:double>>, free_value int")
    got = {r.k: (r.valore, r.incerto, r.illeggibile) for r in X.choose(d).collect()}
    assert got == {"a": (5, False, False), "b": (None, False, True), "c": (5, True, False)} and X.choose(d, 0.02).where("k = 'a'").first().incerto
    weak = d.where("k = 'a'").select(X.weak_options(F.col("options"), F.array(F.lit(6), F.lit(9)), F.lit(0.03)).alias("o")).first().o
    assert [o.value for o in weak] == [5, 6, 9] and abs(weak[1].logprob - 0.25 * math.log(0.05)) < 1e-9
    assert set(spark.range(1).select(X.digit_confusions(F.lit(19 * 60 + 30)).alias("d")).first().d) == {12 * 60 + 30}
    row = spark.createDataFrame([(480, 660, None, 600, 120)], "prog_entrata int, prog_uscita int, eff_entrata int, eff_uscita int, ore_dichiarate int")
    assert row.select(X.suggestions("eff_entrata").alias("s")).first().s == [480, 540]


def test_marks_hours_and_durations(spark):
    schema = "doc_id string, giorno int, prog_entrata string, prog_uscita string, eff_entrata string, eff_uscita string, ore_dichiarate double, note string, firma boolean, assenza_alunno boolean, assenza_operatore boolean, incerti array<string>, illeggibili array<string>, dich double, min_prog int"
    rows = spark.createDataFrame([("d", 1, None, None, None, None, None, None, True, False, False, [], [], None, 180), ("d", 8, "8", "11", None, None, 0.9, None, True, True, False, [], [], 0.9, 180), ("d", 15, "8", "11", None, None, 1.5, None, True, True, False, [], [], 1.5, 180), ("d", 22, "8", "13", None, None, None, None, True, False, False, [], [], None, 300)], schema)
    assert [tuple(r) for r in X.lonely_marks(rows).collect()] == [("d", 1, "firma")]
    assert [(r.giorno, r.quota) for r in X.odd_absence_hours(rows).collect()] == [(8, 0.3)]
    assert [r.giorno for r in X.odd_durations(rows).collect()] == [22]


def test_notes_totals_and_costs(spark):
    n = spark.createDataFrame([("d", 1, "permesso", False), ("d", 2, "pernesso", True), ("d", 5, "gita", True)], "doc_id string, giorno int, note string, dubbia boolean")
    assert {(r.giorno, r.vicina) for r in X.neighbour_notes(n).collect()} == {(2, "permesso"), (5, None)}
    t = "doc_id string, totale double, incerto boolean, illeggibile boolean"
    first = spark.createDataFrame([("a", 60.0, True, False), ("b", 60.0, False, False), ("c", None, False, True), ("d", 60.0, False, False), ("e", 60.0, True, False)], t)
    again = spark.createDataFrame([("a", 60.0, False, False), ("b", 61.0, False, False), ("c", None, False, True), ("d", None, False, True)], t)
    sums = spark.createDataFrame([(k, 61.0) for k in "abcde"], "doc_id string, ore_dichiarate double")
    assert {tuple(r) for r in X.merge_total(first, again, sums).collect()} == {("a", 60.0, False, False), ("b", 61.0, False, False), ("c", None, False, True), ("d", 60.0, True, False), ("e", 60.0, True, False)}
    use = spark.createDataFrame([("d", "big-1", 100, 10, 0, 0), ("d", "small-9", 0, 10, 100, 100), ("e", "?", 1000, 0, 0, 0)], "doc_id string, model string, input long, output long, cache_write long, cache_read long")
    prices = spark.createDataFrame([("big-1", "big", 10.0, 50.0), ("small-1", "small", 1.0, 5.0)], "model string, family string, price_in double, price_out double")
    assert {(r.doc_id, r.input_tokens, r.cost_usd) for r in X.costs(use, prices, "big-1").collect()} == {("d", 300, 0.001685), ("e", 1000, 0.01)}
    cells = spark.createDataFrame([("d", 0.9), ("d", 0.7)], "doc_id string, p double")
    assert X.document_confidence(cells, spark.createDataFrame([("d", 1.0)], "doc_id string, score double")).first().confidence == 0.83


def test_orders(spark):
    s = spark.createDataFrame([("a", "completato", True, "ok", "1", "5"), ("b", "in_coda", True, None, "2", None), ("c", "in_lavorazione", True, None, "3", None), ("d", "completato", True, "errori", "4", "9")], "doc_id string, status string, is_foglio_firma boolean, stato string, created_at string, updated_at string")
    assert [r.doc_id for r in X.queue(s, 3).collect()] == ["c", "b", "d"]
    full = s.withColumns({"anno": F.lit(2026), "mese": F.lit(1), "ore_riconosciute": F.lit(1), "operatore": F.lit("x"), "alunno": F.lit("x"), "istituto": F.lit("x"), "source_file": F.lit("f")})
    assert [r.doc_id for r in full.orderBy(*X.list_order("stato")).collect()] == ["d", "b", "c", "a"]
    assert X.visible_totals(full, ["ore_riconosciute"]).first() == (4, 4)
