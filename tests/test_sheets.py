"""Rules, totals and cross-sheet checks over hand-made sheets."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rollbook.operators import duplicates, readings, registry, reports, rows
from rollbook.operators.rules import ordered
from rollbook.plans.model import DAY_FIELDS, HEADER_FIELDS, SHEET, codes
from rollbook.plans.pipeline import validate

D = Decimal
HEAD = dict(operatore="ROSSI MARIO", alunno="BIANCHI LUCA", istituto="IC 1", ente="Coop", mese=2, anno=2026, ore_pei=D(15), firma_coordinatore=True, timbro_referente=True, totale_mensile_dichiarato=D(60), incerti=[], illeggibili=[])
WEEKDAYS = [g for g in range(1, 29) if datetime.date(2026, 2, g).weekday() < 5]


def day(g, **changes):
    base = dict(giorno=g, prog_entrata="08:00", prog_uscita="11:00", eff_entrata="08:00", eff_uscita="11:00", ore_dichiarate=D(3), assenza_alunno=False, assenza_operatore=False, firma=True, note=None, trattino_effettivo=False, incerti=[], illeggibili=[], confidenza={})
    return base | changes


def sheet(key="aaaaaaaaaaaa", head=None, days=None, **more):
    d = dict.fromkeys(SHEET.names) | dict(id=key, source_file="a.pdf", source_page=1, page_count=1, status="completato", is_foglio_firma=True, user_verified=False, avvisi=[], user_edited=[], ocr_originali={})
    return d | dict(header=dict.fromkeys(HEADER_FIELDS) | HEAD | (head or {}), rows=[day(g) for g in WEEKDAYS] if days is None else days) | more


def run(spark, *sheets):
    nested = spark.createDataFrame(list(sheets), SHEET)
    return validate(rows.flat(nested), rows.day_rows(nested))


def found(spark, *args, **kw):
    f = run(spark, sheet(*args, **kw)).findings
    return [(r.codice[:3], r.giorno, r.gravita, r.campo) for r in f.orderBy(*ordered(f)).collect()]


def test_clean_month(spark):
    v = run(spark, sheet())
    assert v.findings.collect() == [] and v.states.first().stato == "ok"
    t = v.totals.first()
    assert (t.ore_riconosciute, t.ore_calcolate, t.ore_programmate, t.giorni_lavorati) == (60, 60, 60, 20)
    assert [r.ore_pei for r in v.weeks.orderBy("settimana").collect()] == [0, 15, 15, 15, 15]


def test_rows_are_always_31(spark):
    nested = spark.createDataFrame([sheet(days=[day(3, note="first"), day(3, note="last")])], SHEET)
    got = rows.day_rows(nested).orderBy("giorno").collect()
    assert [r.giorno for r in got] == list(range(1, 32)) and got[2].note == "last" and got[0].firma is False


CASES = [
    (dict(ore_dichiarate=D(30)), ("E01", "errore", "ore_dichiarate")), (dict(ore_dichiarate=D(2)), ("E01", "errore", "ore_dichiarate")), (dict(eff_entrata="xx"), ("E03", "errore", "eff_entrata")),
    (dict(eff_entrata="11:00", eff_uscita="08:00"), ("E03", "errore", "eff_uscita")), (dict(eff_uscita=None), ("E03", "errore", "eff_uscita")), (dict(illeggibili=["ore_dichiarate"], ore_dichiarate=None), ("E05", "errore", "ore_dichiarate")),
    (dict(illeggibili=["note"]), ("E05", "attenzione", "note")), (dict(firma=False), ("W01", "attenzione", "firma")), (dict(eff_entrata=None, eff_uscita=None), ("W02", "attenzione", "ore_dichiarate")),
    (dict(incerti=["note"]), ("W04", "attenzione", "note")), (dict(assenza_operatore=True), ("W05", "attenzione", "assenza_operatore")), (dict(assenza_alunno=True, assenza_operatore=True), ("W11", "attenzione", "assenza_alunno")),
    (dict(ore_dichiarate=None), ("W12", "attenzione", "ore_dichiarate")), (dict(assenza_alunno=True), ("I01", "info", "assenza_alunno")), (dict(assenza_operatore=True), ("I02", "info", "assenza_operatore")),
    (dict(eff_uscita="12:00", ore_dichiarate=D(4)), ("I03", "info", "eff_uscita")), (dict(prog_entrata=None, prog_uscita=None), ("I04", "info", "prog_entrata")),
    (dict(eff_entrata=None, eff_uscita=None, ore_dichiarate=None), ("I05", "info", "eff_entrata")),
]
QUIET = [
    (dict(ore_dichiarate=D(2), assenza_alunno=True), "E01"), (dict(ore_dichiarate=D("3.01")), "E01"), (dict(eff_entrata="xx", illeggibili=["eff_entrata"]), "E03"), (dict(firma=False, incerti=["firma"]), "W01"),
    (dict(firma=False, assenza_operatore=True), "W01"), (dict(eff_entrata=None, eff_uscita=None, assenza_alunno=True), "W02"), (dict(ore_dichiarate=None, illeggibili=["ore_dichiarate"]), "W12"), (dict(incerti=["note"], illeggibili=["note"]), "W04"),
]


def test_rules_fire_and_stay_quiet(spark):
    made = [sheet(f"{k:012x}", days=[day(g) if g != 10 else day(g, **c) for g in WEEKDAYS]) for k, c in enumerate([c for c, _ in CASES + QUIET])]
    got = {}
    for r in run(spark, *made).findings.where("giorno = 10").collect():
        got.setdefault(int(r.doc_id, 16), set()).add((r.codice[:3], r.gravita, r.campo))
    for k, (_, want) in enumerate(CASES):
        assert want in got.get(k, set()), CASES[k]
    for k, (_, code) in enumerate(QUIET, len(CASES)):
        assert code not in {c for c, _, _ in got.get(k, set())}, QUIET[k - len(CASES)]


def test_calendar_rules(spark):
    assert ("W03", 14, "info", None) in found(spark, days=[day(14)]) and ("W03", 15, "attenzione", None) in found(spark, days=[day(15)])
    assert ("E04", 30, "errore", None) in found(spark, days=[day(30)])
    assert ("W03", 6, "attenzione", None) in found(spark, head=dict(mese=4), days=[day(6)])
    no_month = run(spark, sheet(head=dict(mese=None, totale_mensile_dichiarato=D(66)), days=[day(g) for g in range(1, 23)]))
    assert no_month.totals.first().ore_riconosciute == 66 and no_month.weeks.count() == 0


def test_header_rules(spark):
    got = found(spark, head=dict(operatore=" ", mese=13, firma_coordinatore=False, timbro_referente=False, totale_mensile_dichiarato=None, incerti=["lotto"], illeggibili=["istituto"]))
    assert {("W07", None, "attenzione", "operatore"), ("W07", None, "attenzione", "mese"), ("W08", None, "attenzione", "firma_coordinatore"), ("W09", None, "attenzione", "timbro_referente"), ("W10", None, "attenzione", "totale_mensile_dichiarato"), ("W04", None, "attenzione", "lotto"), ("E05", None, "attenzione", "istituto")} <= set(got)
    assert ("E02", None, "errore", "totale_mensile_dichiarato") in found(spark, head=dict(totale_mensile_dichiarato=D(61)))
    assert ("W06", None, "attenzione", "ore_pei") in found(spark, head=dict(ore_pei=D(10)))
    assert found(spark, is_foglio_firma=False, days=[], head=dict(operatore=None)) == [("E06", None, "errore", None)]


def test_saturday_makes_six_days(spark):
    v = run(spark, sheet(days=[day(14), day(16)]))
    assert [float(r.ore_pei) for r in v.weeks.orderBy("settimana").collect()] == [0.0, 15.0, 15.0, 15.0, 15.0]
    v = run(spark, sheet(head=dict(ore_pei=D(12), mese=4, anno=2026), days=[day(11)]))
    assert [float(r.ore_pei) for r in v.weeks.orderBy("settimana").collect()] == [8.0, 10.0, 12.0, 10.0, 8.0]


def test_reader_warnings(spark):
    warn = lambda c, g=None: dict(codice=c, gravita="attenzione", giorno=g, campo=None, valore_letto=None, valore_atteso=None)
    got = found(spark, avvisi=[warn("W14_GRIGLIA_INCERTA", 10), warn("W14_GRIGLIA_INCERTA", 10), warn("X99")], days=[day(g) if g != 10 else day(10, incerti=["note", "firma"]) for g in WEEKDAYS])
    assert [c for c, g, _, _ in got if g == 10] == ["W04", "W14"]  # the empty note says nothing new; the signature does


def test_duplicates_and_kpis(spark):
    made = [sheet("a" * 12), sheet("b" * 12, head=dict(operatore="Mario  Rossì")), sheet("c" * 12, head=dict(mese=3)), sheet("d" * 12, status="scartato"), sheet("e" * 12, head=dict(alunno=None))]
    v = run(spark, *made)
    peers = duplicates.duplicate_peers(v.sheets)
    assert {r.doc_id[0]: [p[0] for p in r.peers] for r in peers.collect()} == {"a": ["b"], "b": ["a"]}
    k = duplicates.kpis(v.sheets, v.states, v.totals, peers).first()
    assert (k.documenti, k.completati, k.possibili_duplicati, k.scartati, k.verificati) == (5, 4, 2, 1, 0)


def test_outcomes_and_report(spark):
    days = [day(2), day(3, assenza_operatore=True, eff_entrata=None, eff_uscita=None, ore_dichiarate=None), day(4, eff_entrata=None, eff_uscita=None, ore_dichiarate=None, firma=False), day(5, firma=False, illeggibili=["note"]), day(6, eff_uscita="xx"), day(28, note=" ", prog_entrata=None, prog_uscita=None, eff_entrata=None, eff_uscita=None, ore_dichiarate=None, firma=False)]
    v = run(spark, sheet(days=days))
    got = {r.giorno: r.esito for r in reports.outcome(v.rows, v.findings, codes(spark)).where("esiste").collect()}
    assert got[2] == "OK" and got[3] == "Assenza operatore" and got[4] == "Non svolto" and got[28] == "" and got[6] == "Errore: orario non valido"
    assert got[5] == "Da verificare: firma operatore mancante; illeggibile: note"
    assert reports.detail(v.sheets, v.rows, v.findings, codes(spark)).count() == 5
    s = reports.summary(v.sheets, v.rows, v.states).first()
    assert (s.n, s.operatore, s.giorni) == (1, "ROSSI MARIO", 2 + 1 - 0)


def test_numbering_is_total(spark):
    d = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    got = reports.numbered(d, [F.col("v")], "n", 7).collect()
    assert sorted((r.v, r.n) for r in got) == [(k, k + 1) for k in range(1000)]


ROW = dict.fromkeys(DAY_FIELDS[:5]) | dict.fromkeys(DAY_FIELDS[5:8], False) | dict(note=None)


def test_merge_of_two_readings(spark):
    schema = "doc_id string, giorno int, prog_entrata string, prog_uscita string, eff_entrata string, eff_uscita string, ore_dichiarate decimal(9,4), assenza_alunno boolean, assenza_operatore boolean, firma boolean, note string, incerti array<string>, illeggibili array<string>"
    make = lambda *rs: spark.createDataFrame([tuple([x["doc_id"], x["giorno"], *(x[f] for f in DAY_FIELDS), x["incerti"], x["illeggibili"]]) for x in rs], schema)
    base = ROW | dict(doc_id="d", giorno=1, incerti=[], illeggibili=[], eff_entrata="08:00", eff_uscita="11:00")
    first = [base | dict(note="a", incerti=["note"]), base | dict(giorno=2, illeggibili=["note"]), base | dict(giorno=3, note="x"), base | dict(giorno=4, note="keep"), base | dict(giorno=5, note="x")]
    again = [base | dict(note="A "), base | dict(giorno=2, illeggibili=["note"]), base | dict(giorno=3, note=None), ROW | dict(doc_id="d", giorno=4, incerti=[], illeggibili=[]), base | dict(giorno=5, illeggibili=["note"])]
    got = {r.giorno: (r.note, r.incerti, r.illeggibili) for r in readings.merge_readings(make(*first), make(*again), F.lit(True)).collect()}
    assert got == {1: ("a", [], []), 2: (None, [], ["note"]), 3: (None, ["note"], []), 4: ("keep", [], []), 5: ("x", ["note"], [])}


def test_best_row_prefers_coherence(spark):
    opt = lambda *vs: [(v, p) for v, p in vs]
    data = [("d", 1, "eff_entrata", opt((480, -0.1))), ("d", 1, "eff_uscita", opt((600, -0.5), (660, -0.9))), ("d", 1, "ore_dichiarate", opt((180, -0.1)))]
    got = readings.best_rows(spark.createDataFrame(data, "doc_id string, giorno int, campo string, candidates array<struct<value:int,logprob:double>>")).first()
    assert (got.eff_entrata, got.eff_uscita, got.ore_dichiarate, got.prog_entrata) == (480, 660, 180, None) and abs(got.score - (-1.1 + 2.5)) < 1e-9


def test_consensus_reaches_its_end(spark):
    cell = lambda f, v, sure, may=True: ("d", 1, f, v, sure, may)
    cells = [cell("eff_entrata", 480, True), cell("ore_dichiarate", 180, True), cell("eff_uscita", 660, False), cell("prog_uscita", 660, False), cell("prog_entrata", 490, False)]
    got = readings.consensus(spark.createDataFrame(cells, "doc_id string, giorno int, campo string, value int, sure boolean, may boolean")).collect()
    assert {r.campo for r in got} == {"eff_uscita", "prog_uscita"}


def test_second_opinion(spark):
    row = lambda f, v, flagged=False, opinion=None, c=0.9, **k: ("d", 1, f, v, flagged, k.get("blocked", False), opinion, c, True, False)
    schema = "doc_id string, giorno int, campo string, value int, flagged boolean, blocked boolean, opinion int, confidence double, plausible boolean, absent boolean"
    told = lambda *rs: {r.campo: (r.esito, r.value) for r in readings.second_opinions(spark.createDataFrame(list(rs), schema)).collect()}
    assert told(row("prog_entrata", 480), row("prog_uscita", 660), row("eff_entrata", 480), row("eff_uscita", 600, True, 660), row("ore_dichiarate", 180)) == {"eff_uscita": ("sostituito", 660)}
    assert told(row("eff_entrata", 480), row("eff_uscita", 660, True, 660), row("ore_dichiarate", 180)) == {"eff_uscita": ("confermato", 660)}
    assert told(row("eff_entrata", 480), row("eff_uscita", 660, True, 660, blocked=True), row("ore_dichiarate", 180)) == {}


@pytest.fixture(scope="module")
def vocabulary(spark):
    names = [("operatore", n) for n in ("ESPOSITO GENNARO", "ROSSI MARIO", "ROSSI MARIA", "BIANCHI LUCA")] + [("istituto", "IC 9 VERDI"), ("istituto", "IC 10 VERDI")]
    return registry.values(spark.createDataFrame([(f"d{k}", c, n, n, "t") for k, (c, n) in enumerate(names)], "doc_id string, campo string, chiave string, valore string, aggiornato string").withColumn("chiave", registry.name_key(F.col("valore"))))


def test_registry_ladder(spark, vocabulary):
    read = [("1", "operatore", "gennaro esposito"), ("2", "operatore", "ESPOSITQ GENNAR0"), ("3", "operatore", "ROSSI MARI"), ("4", "operatore", "VERDI GIUSEPPE"), ("5", "operatore", "B1ANCHI LUCA"), ("6", "operatore", None)]
    got = {r.doc_id: (r.esito, r.valore) for r in registry.match(spark.createDataFrame(read, "doc_id string, campo string, letto string"), vocabulary).collect()}
    assert got["1"] == ("identico", "ESPOSITO GENNARO") and got["2"] == ("sostituito", "ESPOSITO GENNARO") and got["3"][0] == "ambiguo" and got["4"] == ("nuovo", None) and got["5"][0] == "sostituito" and "6" not in got


def test_registry_associations(spark):
    links = spark.createDataFrame([("A", "X", "a", "x", "S1", "E"), ("A", "Y", "a", "y", "S1", "E"), ("B", "X", "b", "x", "S2", None)], "op_key string, al_key string, operatore string, alunno string, istituto string, ente string")
    done = spark.createDataFrame([("1", "A", None), ("2", None, "X"), ("3", "A", "X")], "doc_id string, op_key string, al_key string")
    assert {(r.doc_id, r.valore) for r in registry.deduce(done, links, "istituto").collect()} == {("1", "S1"), ("3", "S1")}
    assert {(r.doc_id, r.chiave, r.bonus) for r in registry.association_bonuses(done, links, "istituto").collect()} == {("1", "S1", 0.1), ("2", "S1", 0.1), ("2", "S2", 0.1), ("3", "S1", 0.15), ("3", "S2", 0.1)}


def test_registry_retraction(spark):
    made = [sheet("a" * 12, user_verified=True, updated_at="1"), sheet("b" * 12, user_verified=True, updated_at="2", head=dict(operatore="Rossi Mario"))]
    flat = lambda *s: rows.flat(spark.createDataFrame(list(s), SHEET))
    both = {(r.campo, r.chiave): (r.valore, r.conteggio) for r in registry.values(registry.contributions(flat(*made))).collect()}
    assert both["operatore", "MARIO ROSSI"] == ("Rossi Mario", 2)
    left = registry.contributions(flat(made[0], made[1] | dict(user_verified=False)))
    assert {(r.campo, r.chiave): r.conteggio for r in registry.values(left).collect()}["operatore", "MARIO ROSSI"] == 1
    manual = spark.createDataFrame([("ente", "Nuovo Ente"), ("ente", "1")], "campo string, valore string")
    assert {(r.valore, r.conteggio) for r in registry.values(left, manual).where("manuale").collect()} == {("Nuovo Ente", 0)}


def test_sentences(spark):
    from rollbook.operators.sentences import sentences

    cases = [
        day(2, eff_entrata="8,x", firma=False), day(3, eff_entrata="11:00", eff_uscita="08:00"), day(4, eff_uscita=None), day(5, ore_dichiarate=D(2)), day(6, assenza_alunno=True, ore_dichiarate=D("1.5"), note="gita"),
        day(7), day(9, ore_dichiarate=None), day(10, assenza_operatore=True, eff_entrata=None, eff_uscita=None, ore_dichiarate=None, note="104"), day(11, eff_entrata=None, eff_uscita=None, ore_dichiarate=None), day(12, incerti=["note"], illeggibili=["ore_dichiarate"], ore_dichiarate=None), day(30, note="x"),
    ]
    v = run(spark, sheet(days=cases, head=dict(operatore=None, totale_mensile_dichiarato=None, ore_pei=D(3), firma_coordinatore=False, timbro_referente=False, incerti=["lotto"])))
    told = {r.messaggio for r in sentences(v.findings, v.rows, v.weeks).collect()}
    assert None not in told
    assert told >= {
        "Giorno 2: entrata effettiva non interpretabile come orario («8,x»).", "Giorno 3: l'uscita effettiva (08:00) non è successiva all'entrata (11:00).", "Giorno 4: orario effettivo incompleto, manca l'uscita (entrata 08:00).",
        "Giorno 5: dichiarate 2 ore ma l'orario effettivo 08:00–11:00 corrisponde a 3 ore.", "Giorno 6: assenza dell'alunno; riconosciute 1,5 ore su 3 programmate (50%). Nota «gita».",
        "Giorno 7 (sabato): prestazione registrata di sabato; verificare che sia prevista dal calendario scolastico.", "Giorno 9: ore effettive non indicate sul foglio; riconosciute 3 ore calcolate dall'orario 08:00–11:00.",
        "Giorno 10: assenza dell'operatore – nota «104» (permesso Legge 104/1992); 3 ore programmate non svolte.", "Giorno 11: prestazione programmata non svolta (orario programmato 08:00–11:00).", "Giorno 12: campo «Tot. ore effettive» illeggibile: da leggere sulla scansione e inserire a mano.",
        "Giorno 12: lettura incerta del campo «Note» (valore letto: campo vuoto); verificare sulla scansione.", "Giorno 30: il giorno non esiste nel mese di febbraio 2026 ma la riga contiene dati; i valori non sono conteggiati nei totali.", "Intestazione incompleta: manca il nome dell'operatore.",
        "Lettura incerta del campo «Lotto» (valore letto: campo vuoto); verificare sulla scansione.", "Manca la firma del coordinatore dell'ente accanto al totale mensile.",
    }
    assert any(m.startswith("Settimana 2 (dal 2 all'8 febbraio): ") and "oltre il limite settimanale del PEI (3 ore; eccedenza " in m for m in told)
