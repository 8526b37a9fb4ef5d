"""Wordings, inputs, lexicons, notes, doubts, workbook cells, readers, the queue and snapshots."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rollbook.functions import inputs, lexicons, messages
from rollbook.functions import values as V
from rollbook.functions.similarity import likeness
from rollbook.operators import doubts, fields, lists, notes, readers, readings, registry, workbook
from rollbook.sources import store
from rollbook.streaming import ingest, queue


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_wordings(spark):
    r = one(
        spark, a=messages.hours_label(F.lit(1)), b=messages.hours_label(F.lit(1.5)), c=messages.hours_done(F.lit(1), "programmat"), d=messages.hours_done(F.lit(3), "programmat"), e=messages.percent(F.lit(33.333)),
        f=messages.percent(F.lit(50.0)), g=messages.from_to(F.lit(2), F.lit(8), F.lit(2)), h=messages.from_to(F.lit(1), F.lit(7)), i=messages.from_to(F.lit(3), F.lit(3)), j=messages.note_description(F.lit("L.104")),
        k=messages.note_description(F.lit("1042")), m=messages.outcome_wording(F.lit("Errore: illeggibile: note")), n=messages.code_title(F.lit("E05_X"), F.lit("campo illeggibile")), o=messages.quoted_sheet(F.lit("D'ANGELO")),
        p=messages.literal_criterion(F.lit("ROSS? M*~")), q=messages.week_caption(F.lit(2026), F.lit(2), F.lit(1), F.lit(1), F.lit(1)), r=messages.week_caption(F.lit(None).cast("int"), F.lit(2), F.lit(2), F.lit(3), F.lit(9)),
    )
    assert tuple(r) == ("1 ora", "1,5 ore", "1 ora programmata", "3 ore programmate", "33,3%", "50%", "dal 2 all'8 febbraio", "dall'1 al 7", "3", "nota «L.104» (permesso Legge 104/1992)", "nota «1042»", "Errore – illeggibile: note", "E05 · Campo illeggibile", "'D''ANGELO'", "=ROSS~? M~*~~", "1ª · 01/02", "2ª · giorni 3–9")


def test_registry_notes(spark):
    schema = "campo string, esito string, letto string, valore string, somiglianza double, incerto boolean, associato boolean, era_incerto boolean, candidati array<struct<valore:string,somiglianza:double,associato:boolean>>"
    rows = [
        ("operatore", "identico", "rossi mario", "ROSSI MARIO", 1.0, False, False, False, []), ("operatore", "identico", "A B", "A B", 1.0, False, False, False, []), ("alunno", "identico", "A B", "A B", 1.0, False, False, True, []),
        ("alunno", "sostituito", "R0SSI", "ROSSI", 0.9, True, True, False, []), ("ente", "simile", "X", None, 0.6, True, False, False, [("Y", 0.6, False), ("Z", 0.5, True)]), ("lotto", "dedotto", None, "4", 0.0, True, True, False, []),
    ]
    got = [r.n for r in spark.createDataFrame(rows, schema).select(messages.registry_note(F.struct("*")).alias("n")).collect()]
    assert got == [
        "Operatore uniformato all'anagrafica: letto «rossi mario», usato «ROSSI MARIO».", None, "Alunno «A B» presente nell'anagrafica: lettura confermata.",
        "Alunno riconosciuto dall'anagrafica (somiglianza 90%, associazione nota, da verificare): letto «R0SSI», proposto «ROSSI».",
        "Ente letto «X»: possibile corrispondenza nell'anagrafica «Y» (60%), «Z» (50%, associazione nota), da verificare.", "Lotto non leggibile: proposto «4» dall'anagrafica (unico valore associato), da verificare.",
    ]


def test_typed_inputs(spark):
    cases = {"1,5": (Decimal("1.5000"), False, False), "-": (None, False, True), "": (None, False, False), None: (None, False, False), "25": (None, True, False), "abc": (None, True, False)}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", inputs.typed_hours(F.col("t")).alias("x")).collect()
    assert {r.t: (r.x.value, r.x.error is not None, r.x.dash) for r in d} == cases
    r = one(
        spark, a=inputs.typed_time(F.lit("8.30")), b=inputs.typed_time(F.lit("boh")), c=inputs.typed_time(F.lit("—")), d=inputs.typed_time(F.lit("x" * 21)), e=inputs.typed_month(F.lit("Feb")), f=inputs.typed_month(F.lit("13")), g=inputs.typed_year(F.lit("26")),
        h=inputs.typed_year(F.lit("1999")), i=inputs.typed_replacement(F.lit("Sì")), j=inputs.typed_replacement(F.lit("forse")), k=inputs.typed_text(F.lit(" a  b "), 3), m=inputs.typed_text(F.lit("abcd"), 3),
    )
    assert (r.a.value, r.b.value, r.c.dash, r.d.error is None, r.e.value, r.f.error is None, r.g.value, r.h.value, r.i.value, r.j.error is None, r.k.value, r.m.value) == ("08:30", "boh", True, False, 2, False, 2026, None, "SI", False, "a b", None)


@pytest.mark.parametrize("kind, cases", [
    ("orario", {"8:3O": ("valore", "08:30"), "```text\n14,00```": ("valore", "14:00"), "-": ("vuota", None), "None": ("vuota", None), "ore": ("illeggibile", None), "123456": ("illeggibile", None)}),
    ("ore", {"2h30'": ("valore", "2.5"), "l,5": ("valore", "1.5"), "99": ("illeggibile", None), "/": ("vuota", None)}),
    ("testo", {"rossi": ("valore", "ROSSI"), "x": ("vuota", None)}),
])
def test_second_readings(spark, kind, cases):
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", inputs.second_reading(kind, F.col("t")).alias("x")).collect()
    assert {r.t: (r.x.stato, r.x.valore) for r in d} == cases
    r = one(spark, a=inputs.same_reading("orario", F.lit("8:00"), F.lit("08.00")), b=inputs.same_reading("ore", F.lit("1.5"), F.lit("1.505")), c=inputs.same_reading("testo", F.lit("D'Angelo"), F.lit("DANGELO")), d=inputs.plausible("orario", F.lit("06:55")), e=inputs.plausible("ore", F.lit("0.25")))
    assert tuple(r) == (True, True, True, False, True)


def test_lexicons(spark):
    table = lexicons.lexicons(spark, 2025, 2027).cache()
    assert table.groupBy("lessico", "chiave").count().where("count > 1").count() == 0
    cases = [("orari", "8:00", "08:00"), ("orari", "O8.3O", "08:30"), ("orari", ".830-", "08:30"), ("orari", "8:30h", "08:30"), ("orari", "20:05", None), ("orari", "5:55", None), ("orari", "...8:00", None), ("orari", "8:000", "08:00"),
             ("ore", "2h30'", "2.50"), ("ore", "2,25", None), ("ore", "½", "0.50"), ("ore", "45min", "0.75"), ("ore", "8", "8.00"), ("ore", "8,5", None), ("totale", "49,5", "49.50"), ("totale", "300.5", None), ("ore_pei", "15h", "15.00"),
             ("lotto", "07", "7"), ("municipalita", "iv", "4"), ("mese_anno", "2/26", "2026-02"), ("mese_anno", "febbraio 2026", "2026-02"), ("mese_anno", "02|2026", "2026-02"), ("date", "3/2/26", "03/02/2026"), ("date", "30/2/2026", None),
             ("note", "perm. 104", "104"), ("note", "scuola chiusa.", "SCUOLA CHIUSA"), ("note", "104 bis", None)]
    got = lexicons.look_up(spark.createDataFrame([(a, b, c) for a, b, c in cases], "lessico string, testo string, voluto string"), table).collect()
    assert [(r.lessico, r.testo, r.valore) for r in got if r.valore != r.voluto] == []


def test_names_and_notes(spark):
    texts = [("  Rossi, Mario ", 0.9), ("Rossi", 0.5), ("Rossi", 0.1), ("R.R.R.R.R.R.", 0.9), ("a b c d ef", 0.9), ("!!", 0.9), (None, 0.9)]
    got = [r.x for r in spark.createDataFrame(texts, "t string, c double").select(notes.name_field(F.col("t"), F.col("c")).alias("x")).collect()]
    assert [(x.valore, x.incerto, x.illeggibile) for x in got] == [("ROSSI MARIO", False, False), ("ROSSI", True, False), *[(None, False, True)] * 5]
    schema = "doc_id string, giorno int, free_text string, free_confidence double, free_tokens int, phrase string, phrase_logprob double, aspect double"
    cases = [
        (("SCIOPERO", 0.9, 1, "SCIOPERO", -0.1, 1.0), ("SCIOPERO", False, False)), (("SCIOPER0", 0.5, 1, "SCIOPERO", -0.1, 1.0), ("SCIOPERO", True, False)), ((None, 0.5, 1, None, None, 1.0), (None, False, True)),
        (("", 0.5, 1, None, None, 1.0), (None, False, True)), (("MALATIA", 0.9, 1, None, None, 1.0), ("MALATTIA", True, False)), (("DE", 0.9, 1, None, None, 1.0), (None, False, False)), (("DE", 0.9, 1, None, None, 4.0), (None, False, True)),
        (("1OH", 0.5, 1, "104", -1.0, 1.0), ("104", True, False)), (("CHIUSURA COMUNE", 0.9, 2, None, None, 1.0), ("CHIUSURA COMUNE", False, False)), (("PROTOCOLLO 1234", 0.9, 2, None, None, 1.0), ("PROTOCOLLO 1234", True, False)),
        (("IL", 0.9, 1, None, None, 1.0), (None, False, False)), (("GLO", 0.9, 1, None, None, 1.0), ("GLO", False, False)), (("QUALCOSA DI STRANO", 0.9, 3, None, None, 1.0), ("QUALCOSA DI STRANO", True, False)),
    ]
    d = spark.createDataFrame([(str(k), k, *c) for k, (c, _) in enumerate(cases)], schema)
    got = {r.giorno: (r.valore, r.incerto, r.illeggibile) for r in notes.note_fields(d).collect()}
    assert [(cases[k][0], v, cases[k][1]) for k, v in got.items() if v != cases[k][1]] == []


def test_cell_doubts(spark):
    schema = "campo string, value int, p double, options array<struct<value:int,logprob:double>>, coverage double, free_value int, dominante int, gemello int, implicato int, minuti array<int>"
    rows = [
        ("eff_entrata", 480, 0.99, [(480, -0.01)], 1.0, 480, 480, 480, None, None), ("eff_entrata", 480, 0.5, [(510, -0.5), (480, -0.7)], 0.01, 490, 510, 510, None, None),
        ("eff_entrata", 480, 0.9, [(480, -0.1), (510, -3.0)], 1.0, 510, None, 510, 480, None), ("ore_dichiarate", 180, 0.9, [(180, -0.1)], 1.0, 185, None, None, None, None),
    ]
    got = [(r.motivi, r.superabile) for r in doubts.cell_doubts(spark.createDataFrame(rows, schema)).collect()]
    assert got == [([], True), (["dedotto", "alternativa", "bassa_prob", "rivale", "colonna", "lettura_libera_anomala", "gemello"], False), (["lettura_libera"], False), (["lettura_libera_anomala"], True)]
    cells = spark.createDataFrame([("d", g, "prog_entrata", 480, g != 15) for g in (1, 8, 15)] + [("d", g, "prog_uscita", 800 + g, True) for g in (1, 8, 15)], "doc_id string, giorno int, campo string, value int, sure boolean")
    assert {(r.giorno, r.campo) for r in doubts.weekly_support(cells).collect()} == {(15, "prog_entrata")}


def test_workbook_cells_and_names(spark):
    r = one(spark, a=workbook.typed_text_cell(F.lit("1,5")), b=workbook.typed_text_cell(F.lit("8:30")), c=workbook.typed_text_cell(F.lit("=x")))
    assert (r.a.number, r.b.kind, round(r.b.number, 6), r.c.text) == (1.5, "time", round(510 / 1440, 6), "=x")
    long = "DELLA VALLE MARIA GRAZIA ANTONIETTA"
    names = workbook.name_sheets([(1, "ROSSI MARIO", "02-2026"), (2, "ROSSI MARCO", "02-2026"), (3, "rossi mario", "02-2026"), (4, "", ""), (5, long, "02-2026"), (6, "A/B: C", "")])
    assert names == {1: "ROSSI M. 02-2026", 2: "ROSSI MARCO 02-2026", 3: names[3], 4: "Foglio 4", 5: names[5], 6: names[6]}
    assert len({n.casefold() for n in names.values()}) == 6 and all(len(n) <= 31 and not set(n) & set("[]:*?/\\") for n in names.values()) and names[3].endswith("(2)") and names[5].endswith("02-2026")
    note = workbook.comment("eff_entrata", "rows.1.eff_entrata", F.lit(True), F.array().cast("array<string>"), F.array(F.lit("eff_entrata")), F.array(F.lit("rows.1.eff_entrata")), F.create_map(F.lit("rows.1.eff_entrata"), F.lit("8")), F.lit(0.456))
    assert one(spark, a=note).a == "Lettura incerta: verificare sull'originale.\nAffidabilità della lettura: 46%.\nCorretto manualmente – valore OCR originale: 08:00"


def test_tops_and_exports(spark):
    options = F.array(*(F.struct(F.lit(v).alias("value"), F.lit(p).alias("logprob")) for v, p in ((1, -3.0), (2, -1.0), (3, -1.0), (4, -2.0), (5, -9.0))))
    assert [o.value for o in one(spark, a=lists.top_alternatives(options)).a] == [2, 3, 4, 1]
    files = spark.createDataFrame([(f"/x/{n}", t) for n, t in ((".hidden", 9), ("~lock", 9), ("a.xlsx", 1), ("b.xlsx", 3), ("c.tmp", 8))], "path string, modified int")
    assert [r.path for r in lists.latest_exports(files).collect()] == ["/x/b.xlsx", "/x/a.xlsx"]


def made():
    """A reader of pages and one of cells; local classes, so that they travel to the workers by value."""

    class Pages:
        def is_available(self):
            return True, ""

        def extract(self, page):
            if page["doc_id"] == "bad":
                raise ValueError("unreadable")
            return {"is_foglio_firma": page["doc_id"] != "other", "rows": []}

    class Cells:
        def read(self, requests):
            if any(r["campo"] == "bad" for r in requests):
                raise ValueError("no such cell")
            return [{"free_text": r["campo"].upper(), "free_logprob": -0.5, "free_tokens": 1, "candidates": [{"value": "x", "logprob": -1.0}]} for r in requests]

    return Pages, Cells


def test_readers(spark):
    Pages, Cells = made()  # noqa: N806
    got = {r.doc_id: r for r in readers.read_pages(spark.createDataFrame([("a",), ("bad",)], "doc_id string"), Pages).collect()}
    assert json.loads(got["a"].body)["is_foglio_firma"] and got["bad"].error == "unreadable" and got["bad"].body is None
    cells = spark.createDataFrame([("a", 1, "note"), ("a", 2, "bad"), ("a", 3, "firma")], "doc_id string, giorno int, campo string").coalesce(1)
    assert {(r.giorno, r.free_text, r.error) for r in readers.read_cells(cells, Cells).collect()} == {(1, "NOTE", None), (2, None, "no such cell"), (3, "FIRMA", None)}


def test_queue_reads_requests(spark, tmp_path):
    sheets, landing, Pages = ingest.Snapshots(spark, str(tmp_path / "sheets")), tmp_path / "in", made()[0]  # noqa: N806
    landing.mkdir()

    def ask(name, *ids):
        (landing / name).write_text("\n".join(json.dumps({"doc_id": i}) for i in ids))
        queue.serve(spark, str(landing), "doc_id string", sheets, str(tmp_path / "check"), Pages, "cloud", 3).awaitTermination()

    ask("1.json", "a", "a", "bad", "other")
    ask("2.json", "a")
    assert {(r.doc_id, r.gen, r.status, r.error) for r in sheets.read().collect()} == {("a", 2, "completato", None), ("bad", 1, "errore", "unreadable"), ("other", 1, "scartato", None)}
    queue.read_batch(spark.createDataFrame([("a",)], "doc_id string"), 1, sheets, Pages, 1)  # a batch that is done changes nothing
    assert {r.gen for r in sheets.read().where("doc_id = 'a'").collect()} == {2}
    assert (queue.concurrency("cloud", 99), queue.concurrency("local", 5), queue.concurrency("?"), queue.concurrency("cloud", 0)) == (8, 1, 1, 1)
    waiting = spark.createDataFrame([("a", "in_lavorazione", 1), ("b", "in_coda", 3), ("c", "in_coda", 2), ("d", "completato", 0)], "doc_id string, status string, queued_at int")
    assert [r.doc_id for r in queue.next_jobs(waiting, 2).collect()] == ["c"]


def test_snapshots_survive_a_crash_between_steps(spark, tmp_path, monkeypatch):
    table = ingest.Snapshots(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(r, "doc_id string, gen long, v string")
    table.upsert(rows(("a", 1, "x"), ("b", 1, "x")), 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda state: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            table.upsert(rows(("a", 2, "y")), 1)
    again = ingest.Snapshots(spark, str(tmp_path))
    assert {(r.doc_id, r.v) for r in again.read().collect()} == {("a", "x"), ("b", "x")} and again.current()["revision"] == 1
    again.upsert(rows(("a", 2, "y")), 1)
    again.delete(rows(("b", 0, "")))
    again.upsert(rows(("b", 1, "back"), ("a", 1, "late")), 2)
    monkeypatch.setattr(ingest.Snapshots, "MAX_DELTAS", 1)
    again.upsert(rows(("c", 1, "z")), 3)
    assert len(again.current()["parts"]) == 1 and {(r.doc_id, r.v) for r in again.read().collect()} == {("a", "y"), ("b", "back"), ("c", "z")}
    again.vacuum()
    assert {(r.doc_id, r.v, r.rev) for r in again.read().collect()} == {("a", "y", 2), ("b", "back", 4), ("c", "z", 5)}


def test_imports_resume(spark):
    import hashlib

    sha = hashlib.sha256(b"x").hexdigest()
    copies = spark.createDataFrame([(i, i, bytearray(b"x"), sha if i != "torn" else "0") for i in ("new", "tired", "torn", "done")], "import_id string, path string, content binary, source_sha256 string")
    tries = spark.createDataFrame([("tired",)] * 3 + [("new",)], "import_id string")
    assert {(r.import_id, r.azione) for r in ingest.resumed(copies, tries, spark.createDataFrame([("done",)], "import_id string")).collect()} == {("new", "riprova"), ("tired", "abbandona"), ("torn", "danneggiata")}


def test_match_equals_all_pairs(spark, monkeypatch):
    """Bounds and blocks lose no decision: against the ladder over every pair in plain Python."""
    monkeypatch.setattr(registry, "BLOCK", 7)
    monkeypatch.setattr(registry, "READINGS", 5)
    r = random.Random(4)
    names = sorted({f"{r.choice(['ROSSI', 'RUSSO', 'ESPOSITO', 'BIANCHI', 'DE LUCA', 'FERRARO'])} {r.choice(['MARIO', 'MARIA', 'ANNA', 'CIRO', 'LUCA', 'ROSARIA'])}" for _ in range(24)})
    damage = lambda n: "".join({"O": "0", "I": "1"}.get(c, c) if r.random() < 0.3 else r.choice(["", c, c, c, c, c]) for c in n)
    read = [(str(k), "operatore", damage(r.choice(names))) for k in range(40)] + [("x", "operatore", "TOTALMENTE DIVERSO")]
    vocabulary = spark.createDataFrame([("operatore", " ".join(sorted(n.split())), n) for n in names], "campo string, chiave string, valore string")
    got = {x.doc_id: (x.esito, x.valore, x.incerto) for x in registry.match(spark.createDataFrame(read, "doc_id string, campo string, letto string"), vocabulary).collect()}
    replace, covered, _, suggest = registry.LIMITS["operatore"]
    for doc_id, _, text in read:
        clean = " ".join("".join(c if c.isalnum() else " " for c in text.upper()).split())
        if " ".join(sorted(clean.split())) in {" ".join(sorted(n.split())) for n in names}:
            assert got[doc_id][0] == "identico"
            continue
        scored = sorted(((*likeness(clean, n), n) for n in names), key=lambda s: (-s[0], s[4]))
        (s, c, odd, same, best), second = scored[0], scored[1][0]
        near = [x for x in scored if x[0] >= suggest]
        if s >= replace and c >= covered and round(s - second, 6) >= registry.MARGIN and not odd:
            want = ("sostituito", best, not (s >= registry.SURE and c >= registry.SURE_COVERAGE and same))
        else:
            want = ("nuovo" if not near else "ambiguo" if len(near) > 1 and near[1][0] >= s - registry.MARGIN else "simile", None, bool(near))
        assert got[doc_id] == want, (text, scored[:2])


def test_deduction_and_registry_file(spark, tmp_path):
    header = "doc_id string, operatore string, alunno string, istituto string, ente string, lotto string, h_illeggibili array<string>"
    sheets = spark.createDataFrame([("a", "ROSSI MARIO", None, None, None, None, ["alunno", "lotto", "istituto"]), ("b", None, "VERDI ANNA", None, None, None, ["operatore"]), ("c", "ROSSI MARIO", None, None, None, None, [])], header)
    links = spark.createDataFrame([("MARIO ROSSI", "ANNA VERDI", "ROSSI MARIO", "VERDI ANNA", "IC 1", "Coop", "4"), ("MARIO ROSSI", "BIANCHI CIRO", "ROSSI MARIO", "BIANCHI CIRO", "IC 2", "Coop", "4")], "op_key string, al_key string, operatore string, alunno string, istituto string, ente string, lotto string")
    vocabulary = spark.createDataFrame([("operatore", "MARIO ROSSI", "ROSSI MARIO"), ("alunno", "ANNA VERDI", "VERDI ANNA")], "campo string, chiave string, valore string")
    told = {(r.doc_id, r.campo): (r.esito, r.valore) for r in registry.correct(sheets, vocabulary, links).collect()}
    assert told["a", "lotto"] == ("dedotto", "4") and told["b", "operatore"] == ("dedotto", "ROSSI MARIO") and ("a", "istituto") not in told and ("a", "alunno") not in told and ("c", "lotto") not in told
    values = spark.createDataFrame([("operatore", "MARIO ROSSI", 'ROSSI "M" MARIO', 2, "2026", False), ("ente", "COOP", "Coop", 1, "2025", True)], "campo string, chiave string, valore string, conteggio int, ultimo_uso string, manuale boolean")
    docs = spark.createDataFrame([("d1", "operatore", "MARIO ROSSI", "2026")], "doc_id string, campo string, chiave string, aggiornato string")
    text = registry.to_json(values, links, docs).first().value
    assert json.loads(text)["campi"]["operatore"]["MARIO ROSSI"]["valore"] == 'ROSSI "M" MARIO'
    (tmp_path / "registry.json").write_text(text)
    back = store.registry(spark, str(tmp_path / "registry.json"))
    assert {(r.campo, r.chiave, r.conteggio, r.manuale) for r in back[0].collect()} == {("operatore", "M MARIO ROSSI", 2, False), ("ente", "COOP", 1, True)}
    assert back[1].count() == 2 and [(r.doc_id, r.campo, r.chiave) for r in back[2].collect()] == [("d1", "operatore", "MARIO ROSSI")]


def test_settings_and_uploads(spark, tmp_path, monkeypatch):
    (tmp_path / "s.json").write_text('{"concorrenza": 4, "engine": 7, "unknown": 1, "soglia": 1, "attivo": "yes"}')
    defaults = {"concorrenza": 1, "engine": "local", "soglia": 0.5, "attivo": True}
    assert store.settings(spark, str(tmp_path / "s.json"), defaults) == {"concorrenza": 4, "engine": "local", "soglia": 1, "attivo": True}
    assert store.settings(spark, str(tmp_path / "none.json"), defaults) == defaults
    land = tmp_path / "up"
    land.mkdir()
    for k in range(3):
        (land / f"{k}.pdf").write_bytes(b"%PDF" + bytes([k]))
    known = store.uploads(spark, str(land)).where("path like '%0.pdf'").selectExpr("'doc0' as doc_id", "source_sha256")
    assert {(r.path[-5:], r.error) for r in store.uploads(spark, str(land), known).collect()} == {("0.pdf", "già importato"), ("1.pdf", None), ("2.pdf", None)}
    monkeypatch.setattr(store, "MOST_FILES", 2)
    with pytest.raises(ValueError):
        store.uploads(spark, str(land))


def test_costs_by_longest_family(spark):
    prices = spark.createDataFrame([("pro-1", "pro", 1.0, 2.0), ("pro-max-1", "pro-max", 10.0, 20.0)], "model string, family string, price_in double, price_out double")
    usage = spark.createDataFrame([("a", "pro-max-9", 1_000_000, 0, 0, 0), ("b", None, 0, 1_000_000, 0, 0), ("c", "pro-1", 0, 0, 0, 1_000_000)], "doc_id string, model string, input long, output long, cache_write long, cache_read long")
    assert {(r.doc_id, r.cost_usd) for r in fields.costs(usage, prices, "pro-1").collect()} == {("a", 10.0), ("b", 2.0), ("c", 0.1)}
    assert {(r.doc_id, r.cost_usd) for r in fields.costs(usage, prices, "gone").collect()} == {("a", 10.0), ("b", None), ("c", 0.1)}


def test_shifts_and_orders(spark):
    r = one(spark, a=readings.shifted(F.lit(480), F.lit(3.0), 1), b=readings.shifted(F.lit(480), F.lit(3.0), -1), c=readings.shifted(F.lit(480), F.lit(3.0), -1, False), d=V.degenerate_name(F.lit("ANANANAN")), e=V.degenerate_name(F.lit("Anna Maria")))
    assert tuple(r) == (660, None, 300, True, False)
    d = spark.createDataFrame([("2", "B.pdf", 1, "x"), ("1", "b.pdf", 2, "y"), ("1", "A.pdf", 9, "z")], "created_at string, source_file string, source_page int, doc_id string")
    assert [r.doc_id for r in d.orderBy(*fields.store_order()).collect()] == ["z", "y", "x"]
    v = spark.createDataFrame([("ente", "b", 2), ("ente", "À", 2), ("alunno", "z", 9)], "campo string, valore string, conteggio int")
    assert [r.valore for r in v.orderBy(*registry.value_order()).collect()][0] == "z" and [r.valore for r in v.orderBy(*registry.export_order()).collect()] == ["z", "À", "b"]
