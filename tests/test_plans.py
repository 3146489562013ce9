import datetime
import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import aggregates, tables, windows
from folioflow.plans import report
from folioflow.sources import files
from folioflow.streaming import ingest

GOOD = '{"Cuenta":"001","cheque":"7","beneficiario":"Ana Pérez","monto":"1.250,50","valor_letras":"mil doscientos cincuenta con 50/100","fecha":"2026/01/10","ciudad":"Quito","firma":true,"endoso":"al dorso"}'


def rows(spark, *payloads, rules=None):
    df = spark.createDataFrame(list(enumerate(payloads)), "n int, p string")
    return [r for r in report.report_rows(df, "n", "p", rules or report.Rules(), "2026-06-01").orderBy("nombre_archivo").collect()]


def test_a_clean_record(spark):
    (r,) = rows(spark, GOOD)
    assert (r.cuenta_no, r.cheque_no, r.a_la_orden_de, str(r.valor_numero), r.fecha, r.endoso_texto, r.incluir) == ("001", "7", "Ana Pérez", "1250.50", "Quito, 2026/01/10", "al dorso", False)


@pytest.mark.parametrize("change,flag", [(('"firma":true', '"firma":"no"'), "firma"), (('"Ana Pérez"', '"no presente"'), "beneficiario"), (("1.250,50", "1.251,50"), "coincide_valor"), (("2026/01/10", "2024/01/10"), "fecha_correcta"), (('"al dorso"', '"falso"'), "endoso")])
def test_each_rule(spark, change, flag):
    (r,) = rows(spark, GOOD.replace(*change))
    assert not r[flag] and r.incluir and all(r[f] for f in ("firma", "beneficiario", "coincide_valor", "fecha_correcta", "endoso") if f != flag)
    (r,) = rows(spark, GOOD.replace(*change), rules=report.Rules(active={flag: False}))
    assert not r.incluir


def test_unreadable_payloads(spark):
    for r in rows(spark, "nothing", None, "[1]", "{}", '{"a":null}'):
        assert r.incluir and not r.firma and r.cuenta_no == "" and r.valor_numero is None


def test_signature_kinds(spark):
    cases = ['true', 'false', '0', '2', '""', '"sin firma"', '"x"', '[]', '["no", {"a": "x"}]', '["no", {"a": "no hay"}]', '{}', 'null']
    got = [r.firma for r in rows(spark, *[f'{{"firma":{c}}}' for c in cases])]
    assert got == [True, False, False, True, True, False, True, False, True, False, False, False]


def test_aliases(spark):
    a, b, c = rows(spark, '{"Número Cheque":12,"cheque":"9"}', '{"cheque":" ","no_cheque":"N","num_cheque":"5"}', '{"NÚMERO CHEQUE":"1","numero_cheque":"2"}')
    assert (a.cheque_no, b.cheque_no, c.cheque_no) == ("12", "5", "1")


def test_rules_are_checked():
    text = '{"fecha":{"meses_maximos":13,"formatos":["aaaa/mm/dd","dd De mes de aaaa"]},"validaciones":{"firma":{"activa":false}}}'
    r = report.Rules.from_json(text)
    assert r.formats == ["aaaa/mm/dd", "dd de mes de aaaa"] and not r.active["firma"] and r.active["endoso"]
    for bad in ("{", '{"fecha":{"meses_maximos":-1,"formatos":["aaaa/mm/dd"]}}', '{"fecha":{"meses_maximos":1,"formatos":[]}}', '{"fecha":{"meses_maximos":1,"formatos":["mm"]}}', '{"fecha":{"meses_maximos":"1","formatos":["aaaa/mm/dd"]}}'):
        with pytest.raises(ValueError):
            report.Rules.from_json(bad)


def test_report_sink(spark, tmp_path):
    df = report.report_rows(spark.createDataFrame([("a", GOOD), ("b", "x")], "n string, p string"), "n", "p", report.Rules(), "2026-06-01")
    files.write_report(df, f"file://{tmp_path}/out")
    (r,) = spark.read.option("header", True).csv(f"file://{tmp_path}/out").collect()
    assert r.nombre_archivo == "b" and r.firma == "NO"
    t = report.report_totals(df).first()
    assert (t.leidos, t.con_observaciones, t.sin_observaciones) == (2, 1, 1)


def test_paging_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i % 4), "OK", "n%" if i == 5 else "x", i == 7) for i in range(10)], "id long, v double, status string, name string, deleted boolean")
    q = tables.Filter(sort_by="v", sortable=["id", "v"], descending=True)
    down = [r.id for r in tables.page(df, q, "id", size=0).collect()]
    up = [r.id for r in tables.page(df, tables.Filter(sort_by="v", sortable=["id", "v"], descending=False), "id", size=0).collect()]
    assert down[-4:] == [9, 6, 3, 0] and up[-4:] == [0, 3, 6, 9] and 7 not in down
    assert [r.id for r in tables.page(df, q, "id", number=2, size=3).collect()] == down[3:6]
    assert [r.id for r in tables.page(df, tables.Filter(search="N%", search_columns=["name"], sortable=["id"]), "id", size=0).collect()] == [5]
    assert [r.id for r in tables.page(df, tables.Filter(sort_by="nope", sortable=["id"]), "id", size=2).collect()] == [9, 8]


def test_truth_join_falls_back(spark):
    left = spark.createDataFrame([("a", "d/a"), (None, "d/b"), ("c", "d/c")], "name string, path string")
    truth = spark.createDataFrame([("a", "zz", 1), ("q", "d/b", 2), ("q", "d/a", 3)], "file string, rel string, v int")
    got = {r.path: r.v for r in tables.join_two_keys(left, truth, ("name", "file"), ("path", "rel"), ["v"]).collect()}
    assert got == {"d/a": 1, "d/b": 2, "d/c": None}


def test_votes_break_ties_by_first(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "z", 5)], "k int, v string, i int")
    assert sorted(map(tuple, aggregates.plurality(df, ["k"], "v", "i").collect())) == [(1, "b", 2), (2, "z", 1)]
    s = spark.createDataFrame([(1, "a", 5.0), (1, "b", 2.0), (2, "c", 1.0)], "k int, v string, s double")
    assert {r.k: (r.v, r.margin) for r in aggregates.winner_margin(s, ["k"], "v", "s").collect()} == {1: ("a", 3.0), 2: ("c", 99.0)}


def test_runs_and_repeats(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabba")], "k int, i int, v string")
    assert sorted(r.i for r in windows.drop_repeats(df, ["k"], "i", "v").collect()) == [0, 2, 4]
    g = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 2, 3), (1, 2, 12, 13), (1, 3, 30, 31)], "k int, i int, a int, b int")
    assert [r.run for r in windows.gap_runs(g, ["k"], "i", F.col("a"), F.col("b"), 5).orderBy("i").collect()] == [0, 0, 0, 1]


def test_scan_and_truth(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, data in (("a.JPG", b"1"), ("b.png", b"1"), ("~$c.png", b"2"), ("d.txt", b"3")):
        (tmp_path / "in" / n).write_bytes(data)
    got = files.scan(spark, f"file://{tmp_path}/in")
    assert sorted(r.name for r in got.collect()) == ["a.JPG", "b.png"] and got.select("content_hash").distinct().count() == 1
    (tmp_path / "t.csv").write_text("﻿archivo,monto\na,1\na,2\nb,05\n", encoding="utf-8")
    assert {r.archivo: r.monto for r in files.read_truth(spark, f"file://{tmp_path}/t.csv", "archivo").collect()} == {"a": "2", "b": "05"}
    both = files.with_readings(got.select("name"), spark.createDataFrame([("a.JPG", "{}")], "name string, payload string"), "name", "payload")
    assert {r.name: r.error for r in both.collect()} == {"a.JPG": None, "b.png": "unread"}


def test_stream_keeps_each_content_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store, check = f"file://{tmp_path}/store", f"file://{tmp_path}/check"
    (tmp_path / "in" / "a.png").write_bytes(b"1")
    (tmp_path / "in" / "b.png").write_bytes(b"1")
    ingest.ingest(ingest.watch(spark, f"file://{tmp_path}/in"), store, check).awaitTermination()
    (tmp_path / "in" / "c.png").write_bytes(b"1")
    (tmp_path / "in" / "d.png").write_bytes(b"2")
    ingest.ingest(ingest.watch(spark, f"file://{tmp_path}/in"), store, check).awaitTermination()
    assert spark.read.parquet(store).count() == 2


def test_as_of_is_a_parameter(spark):
    assert rows(spark, GOOD)[0].fecha_correcta
    df = spark.createDataFrame([(1, GOOD)], "n int, p string")
    assert not report.report_rows(df, "n", "p", report.Rules(), str(datetime.date(2027, 2, 10))).first().fecha_correcta
    assert report.report_rows(df, "n", "p", report.Rules(), str(datetime.date(2027, 2, 9))).first().fecha_correcta


def test_totals_are_settled_without_parsing(spark):
    said = json.loads(GOOD)
    rows = [("good", GOOD), ("broken", "x"), ("unsigned", json.dumps({**said, "firma": "No detectada"})), ("nested", json.dumps({**said, "firma": ["no", {"x": "sí"}]})), ("words", json.dumps({**said, "valor_texto": "un mil"})), ("late", json.dumps({**said, "fecha": "2001/01/01"}))]
    df, rules = spark.createDataFrame(rows, "n string, p string"), report.Rules()
    whole = {r.nombre_archivo: r for r in report.report_rows(df, "n", "p", rules, "2026-06-01").collect()}
    settled = {r.nombre_archivo: r for r in report.report_rows(df, "n", "p", rules, "2026-06-01", settle=True).collect()}
    assert {k: r.incluir for k, r in settled.items()} == {k: r.incluir for k, r in whole.items()}
    assert whole["unsigned"].valor_numero is not None and settled["unsigned"].valor_numero is None and settled["words"].valor_numero is not None
    assert not whole["good"].incluir and whole["nested"].firma and not whole["words"].coincide_valor
