"""Registered queries against their SQL, sources and streams."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rollbook.plans import catalogue
from rollbook.sources import store
from rollbook.streaming import ingest

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    got = catalogue.queries()[name](spark, SF)
    rows = got.collect()
    if name in catalogue.oracle_sql():
        import duckdb

        con = duckdb.connect()
        for t in ("events", "orders", "part", "embeddings"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(catalogue.oracle_sql()[name])
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        assert sorted(repr([plain(r[c]) for c in cols]) for r in rows) == sorted(repr([plain(v) for _, v in sorted(zip(want.columns, r, strict=True))]) for r in want.fetchall())
    else:
        assert rows


def test_groups_of_any_size(spark, tmp_path):
    """Possible duplicates lists all sheets of a group: one of more than a thousand, some around a block, one alone, and sheets without an operator."""
    import duckdb

    compared = lambda u: all(u % m for m in (29, 31, 37, 41, 53))
    users = [u for r, n in enumerate((1, 1100, 63, 64, 65, 128, 129), 1) for u in [60 * k + r for k in range(1400) if compared(60 * k + r)][:n]] + [53 * k for k in range(200)]
    con = duckdb.connect()
    con.sql(f"copy (select row_number() over () as event_id, timestamp '2024-01-05 08:00:00' as ts, unnest({users})::bigint as user_id, 'click' as event_type, 0.5 as value, '{{}}' as props) to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.sql("select doc_id, gruppo, fogli, peers from (" + catalogue.oracle_sql()["possible_duplicates"] + ")").fetchall()
    assert {r[2] for r in want} == {63, 64, 65, 128, 129, 1100}
    assert sorted(tuple(r) for r in catalogue.queries()["possible_duplicates"](spark, str(tmp_path)).select("doc_id", "gruppo", "fogli", "peers").collect()) == sorted(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_document_store(spark, tmp_path):
    for name, body in (("0123456789ab", {"id": "wrong", "source_file": "a.pdf", "status": "completato", "header": {"mese": 2}, "rows": [{"giorno": 1}]}), ("0123456789ac", None), ("not-an-id", {"id": "x"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "doc.json").write_text("{broken" if body is None else json.dumps(body))
    (tmp_path / "0123456789ab" / "grid.json").write_text(json.dumps({"col_x": list(range(11)), "row_y": list(range(32)), "row_quality": [1.0] * 31}))
    got = store.documents(spark, str(tmp_path)).collect()
    assert [(r.id, r.source_file, r.header.mese) for r in got] == [("0123456789ab", "a.pdf", 2)]
    assert [r.doc_id for r in store.grids(spark, str(tmp_path)).collect()] == ["0123456789ab"]


def test_extraction_and_alignment(spark):
    body = {"header": {"operatore": " ROSSI  MARIO ", "mese": "febbraio", "anno": "26", "ore_pei": "15", "illeggibili": ["lotto", "?"], "lotto": "9"}, "rows": [{"giorno": "4"}, {"giorno": "4", "eff_entrata": "8", "ore_dichiarate": "1 e mezza", "firma": "x", "illeggibili": ["note"], "note": "?"}, {"giorno": "7", "note": "  "}]}
    r = store.extraction(spark.createDataFrame([("a", json.dumps(body))], "id string, body string")).first()
    assert (r.header.operatore, r.header.mese, r.header.anno, r.header.lotto, r.header.illeggibili) == ("ROSSI MARIO", 2, 2026, None, ["lotto"])
    assert [(x.giorno, x.eff_entrata, x.ore_dichiarate, x.firma, x.note) for x in r.rows] == [(4, "8", Decimal("1.5"), True, None), (7, None, None, False, None)]
    two = {"rows": [{"note": "one"}, {"note": "two"}]}
    got = store.extraction(spark.createDataFrame([("a", json.dumps(two))], "id string, body string"), wanted=[3, 9]).first()
    assert [(x.giorno, x.note) for x in got.rows] == [(3, "one"), (9, "two")]


def test_file_kinds(spark, tmp_path):
    for name, data in (("a.bin", b"%PDF-1.7"), ("b.jpg", b"\xff\xd8\xff\xe0"), ("c.PNG", b"???"), ("d.txt", b"text")):
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5:]: (r.kind, r.error) for r in store.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": ("pdf", None), "b.jpg": ("jpeg", None), "c.PNG": ("png", None), "d.txt": (None, "formato non riconosciuto")}


def test_stream_upserts_by_generation(spark, tmp_path):
    landing, state = tmp_path / "in", ingest.Snapshots(spark, str(tmp_path / "state"))
    landing.mkdir()
    schema = "doc_id string, gen long, status string"

    def land(name, *rows):
        (landing / name).write_text("\n".join(json.dumps(dict(zip(("doc_id", "gen", "status"), r))) for r in rows))
        ingest.ingest(spark, str(landing), schema, state, str(tmp_path / "check")).awaitTermination()

    land("1.json", ("a", 1, "in_coda"), ("b", 1, "in_coda"))
    land("2.json", ("a", 3, "completato"), ("b", 0, "late"))
    land("3.json", ("a", 2, "superseded"))
    assert {(r.doc_id, r.gen, r.status) for r in state.read().collect()} == {("a", 3, "completato"), ("b", 1, "in_coda")}
    assert state.since(state.current()["revision"]) is None and {r.doc_id for r in state.since(1).collect()} == {"a"}
    revision = state.current()["revision"]
    assert state.upsert(state.read().drop("rev"), 0) == revision  # a batch that was merged before
    state.delete(spark.createDataFrame([("a",)], "doc_id string"))
    assert [r.doc_id for r in state.read().collect()] == ["b"]


def test_ingest_helpers(spark):
    pages = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 1)], "source_sha256 string, source_page int")
    assert {tuple(r) for r in ingest.new_pages(pages, pages.where("source_sha256 = 'y'")).collect()} == {("x", 1), ("x", 2)}
    tries = spark.createDataFrame([("a", False), ("a", False), ("a", False), ("b", False), ("c", False), ("c", True)], "doc_id string, ok boolean")
    assert {tuple(r) for r in ingest.retries(tries).collect()} == {("a", 3, True), ("b", 1, False)}
    log = spark.createDataFrame([("d", "f", 1, "x", "y"), ("d", "f", 2, "y", "x"), ("d", "g", 1, None, "z")], "doc_id string, campo string, seq int, old string, new string")
    assert {(r.campo, r.originale, r.valore, r.modificato) for r in ingest.edit_state(log).collect()} == {("f", "x", "x", False), ("g", None, "z", True)}
    cells = spark.createDataFrame([("d", 1, "a", True), ("d", 2, "b", False), ("d", 3, "c", True)], "doc_id string, giorno int, campo string, segnalata boolean")
    assert {(r.giorno, r.successiva.giorno) for r in ingest.next_flag(cells).collect()} == {(1, 3), (3, 1)}
    assert F is not None
