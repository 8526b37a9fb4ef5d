"""Evidence of readings and flags of whole pages."""

import json
import math

from pyspark.sql import functions as F

from rollbook.operators import evidence as E
from rollbook.operators import payloads
from rollbook.plans.model import DAY_FIELDS


def test_evidence(spark):
    d = spark.createDataFrame([("d", [(480, math.log(0.3)), (540, math.log(0.1))], 999, math.log(0.6)), ("e", [(480, -1.0)], 480, -0.1), ("f", [], None, None)], "doc_id string, candidates array<struct<value:int,logprob:double>>, free_value int, free_logprob double")
    got = {r.doc_id: r for r in E.evidence(d).collect()}
    assert abs(got["d"].coverage - 0.4) < 1e-9 and [o.value for o in got["d"].options] == [480, 540] and abs(math.exp(got["d"].options[0].logprob) - 0.75) < 1e-9
    assert abs(got["e"].coverage - 1) < 1e-9 and got["f"].coverage == 0
    turned = E.evidence(d, lambda v: F.when(v == 540, 5.0).otherwise(0.0)).where("doc_id = 'd'").first()
    assert turned.options[0].value == 540 and abs(turned.coverage - 0.4) < 1e-9


def test_totals(spark):
    o = spark.createDataFrame([("a", [(600, math.log(0.7)), (660, math.log(0.2))]), ("b", [(600, -0.1)]), ("c", [(600, -0.1)])], "doc_id string, options array<struct<value:int,logprob:double>>")
    s = spark.createDataFrame([("a", 660, 0), ("b", 500, 0), ("c", 500, 1)], "doc_id string, somma int, mancanti int")
    assert {tuple(r) for r in E.choose_total(o, s).collect()} == {("a", 660, True), ("b", 600, True), ("c", 600, False)}


def test_year_by_calendar(spark):
    p = spark.createDataFrame([("a", 2, 2025, -6.0), ("a", 2, 2026, 0.0), ("b", 2, 2025, -2.0), ("b", 2, 2026, 0.0), ("c", 2, 2025, -9.0), ("c", 2, 2026, -3.0)], "doc_id string, mese int, anno int, penalty double")
    w = spark.createDataFrame([(d, g) for d in "abc" for g in range(1, 10)], "doc_id string, giorno int")
    assert [tuple(r) for r in E.year_by_calendar(p, w).collect()] == [("a", 2, 2026)]


def test_grid_and_difficult_pages(spark):
    schema = "doc_id string, giorno int, " + ", ".join(f"{f} string" for f in DAY_FIELDS) + ", incerti array<string>, illeggibili array<string>"
    rows = spark.createDataFrame([("d", g, "8", "9", "8", "9", "1" if g > 1 else None, None, None, None, None, ["prog_entrata", "prog_uscita", "eff_entrata", "eff_uscita"] + (["ore_dichiarate"] if g > 2 else []), ["note"] if g == 1 else []) for g in range(1, 6)], schema)
    grids = spark.createDataFrame([("d", 0.9, [1.0, 0.2] + [1.0] * 29)], "doc_id string, alignment double, row_quality array<double>")
    got = {r.giorno: r for r in E.unreliable_grid(rows, grids).collect()}
    assert set(got[2].incerti) == set(DAY_FIELDS) and len(got[1].incerti) == 4
    pages = E.difficult_pages(rows)
    assert [tuple(r) for r in pages.collect()] == [("d", 24, 23)]
    assert all(set(r.incerti) >= {"ore_dichiarate"} for r in E.flag_all(rows, pages).where("giorno = 2").collect())


def test_payloads(spark, tmp_path):
    s = spark.createDataFrame([("d", "f.pdf", 2, 3, "completato", True, False, " ROSSI  MARIO", "A", "I", "Coop", 2, 2026), ("e", "f.pdf", 1, 3, "completato", True, False, None, "A", "I", "Coop", None, None)], "doc_id string, source_file string, source_page int, page_count int, status string, is_foglio_firma boolean, user_verified boolean, operatore string, alunno string, istituto string, ente string, mese int, anno int")
    assert [r.n for r in s.orderBy("doc_id").select(payloads.display_name().alias("n")).collect()] == ["ROSSI MARIO – febbraio 2026", "f.pdf – pagina 1"]
    c = payloads.caption(s).first()
    assert (c.dal, c.al, c.file, c.ente) == ("2026-02", "2026-02", "presenze_2026-02.xlsx", "Coop")
    payloads.write_tables({"fogli": s}, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/fogli").count() == 2 and json.loads('{"a": 1}')
