"""Fact documents, snapshots, logs and arrivals."""

import json

from factloom.sources import facts as S
from factloom.streaming.arrivals import ingest_arrivals


def document(n):
    return {"program": "p", "functions": [{"address": f"0x{n}", "name": f"f{n}", "size": 3, "decompilation": "", "callees": ["0x9"], "callers": None, "is_constructor": True, "owner_class": "A"}],
            "strings": [{"address": "0x5", "value": "hi"}], "inheritance": [{"derived": "A", "base": "B"}], "fields": [{"class_name": "A", "offset": "0x8", "type": "int"}]}


def test_documents_and_arrivals(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text(json.dumps(document(1)))
    triples = S.document_triples(S.read_fact_documents(spark, str(inbox)))
    got = {(r.subject, r.predicate, r.value) for r in triples.collect()}
    assert got == {("0x1", "has_name", "f1"), ("0x1", "size_bytes", "3"), ("0x1", "calls", "0x9"), ("0x1", "is_method_of", "A"), ("0x1", "is_constructor_of", "A"),
                   ("0x5", "contains_string", "hi"), ("A", "inherits_from", "B"), ("A", "has_field_candidate", "0x8:int")}
    assert S.insert_if_absent(triples, triples).count() == 0
    run = lambda: ingest_arrivals(spark, str(inbox), str(tmp_path / "store"), str(tmp_path / "marks")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 8
    (inbox / "b.json").write_text(json.dumps(document(2)))
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 13


def test_data_objects_and_vtables(spark, tmp_path):
    flags = {"readable": True, "writable": False, "executable": None, "initialized": True}
    data = {"address": "0x7", "symbol_name": "g", "section": ".data", **flags, "data_type": "int", "size": 4, "size_confident": True, "bytes_hex": "00",
            "inside_function": "0x1", "pointee_address": "0x8", "pointee_source": "reloc", "referenced_from": ["0x1", "0x2"]}
    other = {"address": "0x9", "size": 8, "size_confident": False}
    doc = {"program": "p", "functions": [{"address": "0x1", "installs_vtable_of": "A"}], "data_objects": [data, other]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = {(r.subject, r.predicate, r.value) for r in S.document_triples(S.read_fact_documents(spark, str(tmp_path))).collect()}
    pattern = [v for s, p, v in got if (s, p) == ("0x1", "vtable_install_pattern")]
    assert len(pattern) == 1 and pattern[0].startswith("stores A's own vtable pointer")
    stated = {("symbol_name", "g"), ("section", ".data"), ("readable", "true"), ("writable", "false"), ("initialized", "true"), ("type_name", "int"), ("size_bytes", "4"), ("bytes_hex", "00"),
              ("inside_function", "0x1"), ("pointee", "0x8 (reloc)"), ("referenced_from", "0x1"), ("referenced_from", "0x2")}
    assert {(s, p, v) for s, p, v in got if p.startswith("data_")} == {("0x7", f"data_{p}", v) for p, v in stated} | {("0x9", "data_size_bytes_estimated", "8")}


def test_ingest_of_payloads(spark, tmp_path):
    from factloom.plans.reference import f2_ingest

    payloads = [json.dumps({"functions": [{"address": {"space": "ram", "offset": 16}, "name": "f", "callers": "0X0020", "callees": [48, None, {"offset": "0x40"}]}],
                            "strings": [{"address": "0x050", "value": "hi"}], "inheritance": [{"derived": "A", "base": "B"}]}), "{", "[]", None]
    spark.createDataFrame([(p,) for p in payloads], "payload string").write.parquet(str(tmp_path / "fact_documents.parquet"))
    for name in ("function_facts", "observations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.subject, r.predicate, r.value) for r in f2_ingest(spark, str(tmp_path)).collect()}
    assert got == {("0x10", "has_name", "f"), ("0x10", "called_by", "0x20"), ("0x10", "calls", "0x30"), ("0x10", "calls", "0x40"), ("0x50", "contains_string", "hi"), ("A", "inherits_from", "B")}


def test_snapshots(spark, tmp_path):
    for v in (1, 2):
        S.save_snapshot({"t": spark.range(v)}, str(tmp_path / "s"), v)
    assert S.load_snapshot(spark, str(tmp_path / "s"), "t").count() == 2


def test_linker_log(spark, tmp_path):
    (tmp_path / "log").write_text("a.o: undefined reference to `FUN_1400018CA(int)'\nx\nb.o: undefined reference to `FUN_1400018CA(int)'\nc: undefined reference to `DAT_14'\nd: undefined reference to `thunk_FUN_12(void)'\n")
    got = {tuple(r) for r in S.read_linker_symbols(spark, str(tmp_path / "log")).collect()}
    assert got == {("FUN_1400018CA", "FUNCTION", "0x1400018ca"), ("DAT_14", "DATA", None), ("thunk_FUN_12", "FUNCTION", "0x12")}


def test_text_sink(spark, tmp_path):
    S.write_texts(spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "file_name string, place int, text string"), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o" / "file_name=a")).collect()] == ["x", "y"]


def test_corrupt_documents_stay(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document(1)))
    (tmp_path / "b.json").write_text('{"program": "q", "functions": [')
    docs = S.read_fact_documents(spark, str(tmp_path)).cache()
    assert [r.program for r in docs.where("_corrupt_record is null").collect()] == ["p"]
    assert docs.where("_corrupt_record is not null").count() == 1
    assert S.document_triples(docs).count() == 8


def test_migration(spark):
    old = spark.createDataFrame([(1, "x")], "id bigint, v string")
    new = S.migrated(old, {"v": ("string", "y"), "status": ("string", "ACTIVE"), "superseded_by": ("bigint", None)})
    assert [tuple(r) for r in new.collect()] == [(1, "x", "ACTIVE", None)] and new.schema["superseded_by"].dataType.simpleString() == "bigint"
    assert S.migrated(new, {"status": ("string", "OTHER")}).columns == new.columns


def test_stored_observations(spark, tmp_path):
    from factloom.operators import views as V
    from factloom.plans.reference import f3_live_facts, f4_latest_values

    sf = "/root/testdata/sf0.001"
    both = lambda: [sorted(map(str, q(spark, sf).collect())) for q in (f3_live_facts, f4_latest_values)]
    plain = both()
    V.store_observations(spark, sf, str(tmp_path / "obs"))
    try:
        assert both() == plain
        plan = V.facts(V.observations(spark, sf), "has_name")._jdf.queryExecution().executedPlan().toString()
        assert "predicate" in plan.split("PartitionFilters:")[1].split("]")[0]
    finally:
        spark.conf.unset(V.STORED)
