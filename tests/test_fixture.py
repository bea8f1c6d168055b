"""A small program whose rows make every rule of the core say something: results by hand and against the SQL."""

import datetime as dt
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import updates as U
from factloom.plans import flows, inventory, maintenance, oracles, reference

SF = "/root/testdata/sf0.001"
QUERIES = reference.QUERIES | inventory.QUERIES | maintenance.QUERIES | flows.QUERIES
ORACLES = oracles.ORACLES | inventory.ORACLES | maintenance.ORACLES | flows.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DAY = dt.datetime(2025, 1, 1)
GATE = "semantic_role 'renders frame' rejected: subject's provenance is not Application"

# entry -> crt -> {argv, reloc, main}; main -> {init, loop -> {render, update -> collide}}; argv -> out (an import)
ENTRY, CRT, ARGV, RELOC, MAIN, INIT, LOOP, RENDER, UPDATE, COLLIDE, OUT = (f"0x14000{i:04x}" for i in range(0x1000, 0x100B))
CALLS = [(ENTRY, CRT), (CRT, ARGV), (CRT, RELOC), (CRT, MAIN), (MAIN, INIT), (MAIN, LOOP), (LOOP, RENDER), (LOOP, UPDATE), (UPDATE, COLLIDE), (ARGV, OUT)]


def observations():
    facts = [(a, "calls", b) for a, b in CALLS] + [(b, "called_by", a) for a, b in CALLS]
    facts += [
        (ENTRY, "exports", "entry"), (OUT, "imports", "std!cout"), (ARGV, "size_bytes", "12"), (RELOC, "size_bytes", "400"), (MAIN, "has_name", "main"), (RENDER, "has_name", "render_frame"),
        (INIT, "has_name", "__mingw_init"), (COLLIDE, "has_name", "FUN_14000100a"), (UPDATE, "is_method_of", "Snake"), (RENDER, "is_method_of", "Screen"), (INIT, "is_method_of", "_Guard"),
        (COLLIDE, "decompiles_to", "void FUN_1(Wall *this)\n{\n  this[1] = 2; *this = 3; x = this + 8;\n  return;\n}"),
        (RENDER, "provenance_gate_rejected", GATE), (LOOP, "provenance_gate_rejected", "semantic_role 'loops' rejected: subject's provenance is not Application"),
        (LOOP, "rejection_premise_invalidated", "older"), (LOOP, "rejection_premise_invalidated", "newer"),
        ("0x9000", "data_size_bytes", "8"), ("0x9000", "data_section", ".rdata"), ("0x9000", "data_executable", "false"), ("0x9000", "data_bytes_hex", "00ff"), ("0x9000", "data_type_name", "int"),
        ("0x9000", "data_symbol_name", "PTR_FUN_140009A0"), ("0x9010", "data_size_bytes", "8"), ("0x9010", "data_section", ".text"), ("0x9010", "data_executable", "true"), ("0x9010", "data_bytes_hex", "00"),
        ("0x9010", "data_symbol_name", "g_12345"), ("0x9020", "data_size_bytes", "8"), ("0x9020", "data_bytes_hex", "0f0"), ("0x9020", "data_symbol_name", "DAT_4a0"),
        ("0x9030", "data_size_bytes", "4"), ("0x9030", "data_type_name", "undefined"), ("0x9030", "data_bytes_hex", "00"), ("0x9030", "data_symbol_name", "x_123456_last"), ("0x9040", "contains_string", "plain"),
    ]
    return [{"id": i + 1, "subject": s, "predicate": p, "value": v, "confidence": 0.9, "source": "ghidra:x", "created_at": DAY, "status": "ACTIVE"} for i, (s, p, v) in enumerate(facts)]


def functions():
    body = lambda inner, head="void f(void)": f"{head}\n\n{{\n{inner}\n}}\n"
    rows = [
        (MAIN, "main", "int main(void (*cb)(int, long), map<int, int> *m)", body(f"  FUN_{INIT[2:]}();\n  FUN_{LOOP[2:].upper()}();\n  _initterm(a, b);\n  return 0;"), None, False, False),
        (LOOP, "loop_all", "undefined loop_all(void)", body(f"  FUN_{RENDER[2:]}();\n  FUN_{UPDATE[2:]}();\n  return;", "undefined loop_all(void)"), None, False, False),
        (UPDATE, "update", "undefined update(Snake * this, int)", body(f"  x = 1;\n  FUN_{COLLIDE[2:]}(x);\n  return;"), "Snake", False, False),
        (COLLIDE, "hit", "float hit(Wall *this)", body("  loop_all(1); return 1.0;"), "Wall", False, False), (RENDER, "draw", "void draw(int a)", body("  x = DAT_140009070 + 1;"), "Screen", False, False),
        (INIT, "draw", "void draw(int a)", body("  x = DAT_14000ffff + 1;"), "Screen", False, False), (CRT, "Screen", "Screen(void)", None, "Screen", True, False), (ARGV, "~Screen", "~Screen(void)", "", "Screen", False, True),
        ("0x2000", "outer", "void outer(int param_1,int *param_2)", body("  if (param_1) {\n    inner((long)param_1 + 8,param_2);\n  }", "void outer(int param_1,int *param_2)"), None, False, False),
        ("0x2010", "inner", "void inner(int param_1,int *param_2)", body("  *(int *)(param_1 + 4) = 1;\n  deep(param_1,param_2);\n  outer(1);", "void inner(int param_1,int *param_2)"), None, False, False),
        ("0x2020", "deep", "void deep(int a,int *b)", body("  x = *(short *)(a + 2); y = *(int *)(b + 3); z = *(int *)b;", "void deep(int a,int *b)"), None, False, False),
    ]
    out = []
    for i, (a, n, s, b, o, c, d) in enumerate(rows):
        out.append({"fact_id": i + 1, "program": "p", "address": a, "name": n, "size": 9, "signature": s, "decompilation": b, "owner_class": o, "is_constructor": c, "is_destructor": d, "extracted_at": DAY,
                    "callers": [x for x, y in CALLS if y == a], "callees": [y for x, y in CALLS if x == a]})
    return out


def hypotheses():
    why = {"kind": "PROVENANCE_NOT_APPLICATION", "ref": None, "text": None}
    rows = [
        (RENDER, "semantic_role", "renders frame", "REJECTED", None), (UPDATE, "semantic_role", "moves the snake", "REJECTED", why), (ARGV, "semantic_role", "copies arguments", "REJECTED", why),
        (LOOP, "semantic_role", "loops", "REJECTED", None), (MAIN, "semantic_role", "drawGrid", "ACCEPTED", None), (MAIN, "mechanical_behavior", "draws and then does draw the grid14", "PROPOSED", None),
        (RENDER, "semantic_role", "draws itself", "ACCEPTED", None), (COLLIDE, "mechanical_behavior", "tests overlap", "ACCEPTED", None),
    ]
    return [{"id": i + 1, "subject": s, "predicate": p, "value": v, "confidence": 0.9, "status": st, "rejection_reason": r, "supporting_evidence": "E1", "contradicting_evidence": "E2;E99", "created_by": 1, "created_at": DAY}
            for i, (s, p, v, st, r) in enumerate(rows)]


TABLES = {
    "observations": observations, "function_facts": functions, "hypotheses": hypotheses,
    "evidence": lambda: [{"id": 1, "observation_id": 1, "source": "a"}, {"id": 2, "observation_id": 2, "source": "a"}, {"id": 3, "observation_id": 999, "source": "a"}],
    "investigations": lambda: [{"id": 1, "task": "AnalyzeFunction", "target": MAIN, "evidence_created": [1, 3, 77], "hypotheses_created": [1, 50], "hypotheses_modified": [2], "created_at": DAY}],
    "recovered_classes": lambda: [{"name": "Snake", "base": None, "methods": [{"address": UPDATE, "raw_name": "loop_all", "display_name": "update"}]}],
    "fact_documents": list, "documents": list,
}


@pytest.fixture(scope="module")
def program(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("program")
    for name, rows in TABLES.items():
        schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
        spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows()], schema).coalesce(1).write.parquet(str(at / f"{name}.parquet"))
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    return str(at), db


def result(spark, program, name):
    got = QUERIES[name](spark, program[0])
    columns = sorted(got.columns)
    return [dict(zip(columns, r, strict=True)) for r in got.select(*columns).collect()]


#: Queries that have no row, or nearly none, on the given tables.
RARE = (
    "f12_reserved_names", "f28_confident_data", "f29_import_aliases", "j3_fingerprint_reuse", "j6_premise_links", "j7_gate_rejections", "j8_restated_roles",
    "j17_named_calls", "j25_function_references", "m21_reconsidered", "g10_import_chains",
    "u1_startup_only", "a15_method_collisions", "t9_crt_calls", "t39_this_owners", "x61_strings", "j14_resolved_calls",
    "a18_passed_offsets",
)


@pytest.mark.parametrize("name", RARE)
def test_rare_query(spark, program, name):
    got = result(spark, program, name)
    assert got
    columns = sorted(got[0])
    theirs = program[1].execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(theirs)


def test_main_is_found(spark, program):
    assert {r["subject"] for r in result(spark, program, "u1_startup_only")} == {ENTRY, CRT, ARGV, RELOC, OUT}
    what = {r["subject"]: r["disposition"] for r in result(spark, program, "g17_dispositions")}
    assert what[CRT] == "RUNTIME_ARTIFACT" and what[UPDATE] == "REQUIRED_APPLICATION" and what[INIT] == "REQUIRED_RUNTIME_BODY"


def test_symbols_and_data(spark, program):
    assert {r["symbol"]: r["address"] for r in result(spark, program, "f27_symbol_addresses")} == {"PTR_FUN_140009A0": "0x140009a0", "DAT_4a0": "0x4a0", "x_123456_last": "0x123456"}
    assert {r["subject"] for r in result(spark, program, "f28_confident_data")} == {"0x9000"}
    assert {r["subject"] for r in result(spark, program, "f28_sized_data")} == {"0x9000", "0x9020"}


def test_return_types_travel(spark, program):
    # loop_all ends in a call of update, update in one of hit, which returns a float
    got = {r["subject"]: (r["target"], r["return_type"]) for r in result(spark, program, "g11_return_types")}
    assert got == {LOOP: (COLLIDE, "float"), UPDATE: (COLLIDE, "float")}


def test_values_flow(spark, program):
    fields = {(r["subject"], r["pos"], r["field_offset"], r["width"], r["hops"]) for r in result(spark, program, "g13_field_facts")}
    through_b = {("0x2020", 1, 12, 4, 0), ("0x2020", 1, 0, 4, 0), ("0x2010", 1, 12, 4, 1), ("0x2010", 1, 0, 4, 1), ("0x2000", 1, 12, 4, 2), ("0x2000", 1, 0, 4, 2)}
    assert fields == {("0x2020", 0, 2, 2, 0), ("0x2010", 0, 4, 4, 0), ("0x2010", 0, 2, 2, 1), ("0x2000", 0, 12, 4, 1), ("0x2000", 0, 10, 2, 2)} | through_b
    uses = {(r["subject"], r["pos"], r["target"], r["target_pos"], r["hops"]) for r in result(spark, program, "g14_value_consumers")}
    assert uses == {("0x2000", 1, "0x2010", 1, 1), ("0x2000", 1, "0x2020", 1, 2), ("0x2010", 0, "0x2020", 0, 1), ("0x2010", 1, "0x2020", 1, 1)}
    fits = {(r["subject"], r["callee"]): r["fits"] for r in result(spark, program, "j14_resolved_calls")}
    assert fits["0x2000", "inner"] and fits["0x2010", "deep"] and not fits["0x2010", "outer"]


def test_nested_parameters(spark, program):
    n = {r["name"]: r["n_params"] for r in result(spark, program, "t21_signatures")}
    assert n["main"] == 2 and n["update"] == 2 and n["loop_all"] == 0
    kinds = {r["type"]: r["n"] for r in result(spark, program, "t25_parameter_types")}
    assert kinds["map<int, int> *"] == 1 and kinds["int"] == 6  # with a name five times, without one once


def test_call_context(spark, program):
    got = {(r["subject"], r["side"], r["distance"], r["address"], r["label"], r["mechanics"]) for r in result(spark, program, "j10_call_context")}
    assert (UPDATE, "before", 1, RENDER, "semantic_role: draws itself", None) in got
    assert (RENDER, "after", 1, UPDATE, None, None) in got


def test_premises(spark, program):
    obs, hyp = spark.read.parquet(f"{program[0]}/observations.parquet"), spark.read.parquet(f"{program[0]}/hypotheses.parquet")
    ids = {r.value if r.predicate == "rejection_premise_invalidated" else r.subject: r.id for r in obs.where("predicate in ('provenance_gate_rejected', 'rejection_premise_invalidated')").collect()}
    assert [tuple(r) for r in U.premise_links(obs).collect()] == [(ids[LOOP], ids["newer"])]
    origin = spark.createDataFrame([(s, "APPLICATION") for s in (RENDER, UPDATE, LOOP)], "subject string, provenance string")
    got = {r.id: r.superseded for r in U.reconsidered(hyp, obs, origin).collect()}
    assert got == {1: ids[RENDER], 2: None}  # the record against LOOP is superseded already, ARGV is still no application code


def test_updates(spark):
    obs = spark.createDataFrame([(1, "ACTIVE", None, "x"), (2, "ACTIVE", None, "y"), (3, "RETRACTED", None, None)], "id bigint, status string, superseded_by bigint, _new string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 99), (98, 1), (None, 1), (3, 3)], "old bigint, new bigint")
    assert sorted(map(tuple, U.superseded(obs.withColumnRenamed("_new", "v"), pairs).collect())) == [(1, "SUPERSEDED", 3, "x"), (2, "ACTIVE", None, "y"), (3, "RETRACTED", None, None)]
    gone = U.retracted(obs, spark.createDataFrame([(2,), (2,), (None,), (50,)], "id bigint"))
    assert {r.id: r.status for r in gone.collect()} == {1: "ACTIVE", 2: "RETRACTED", 3: "RETRACTED"}
    hyp = spark.createDataFrame([(1, "ACCEPTED", None, None), (2, "CONTESTED", None, None)], "id bigint, status string, rejection_reason struct<kind string, ref bigint, text string>, last_verified_at timestamp_ntz")
    lost = {r.id: (r.status, r.rejection_reason and r.rejection_reason.kind) for r in U.rejected(hyp, spark.createDataFrame([(2, "B"), (2, "A"), (None, "C")], "id bigint, kind string")).collect()}
    assert lost == {1: ("ACCEPTED", None), 2: ("REJECTED", "A")}
    seen = {r.id: r.last_verified_at for r in U.verified(hyp, spark.createDataFrame([(1,)], "id bigint"), F.lit(DAY).cast("timestamp_ntz")).collect()}
    assert seen == {1: DAY, 2: None}
    evidence = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id bigint, observation_id bigint")
    held = spark.createDataFrame([(10,), (11,)], "id bigint")
    assert [r.id for r in U.valid_evidence(evidence, held).collect()] == [1]
    listed, links = spark.createDataFrame([(1, 1), (1, 44)], "id bigint, evidence_id bigint"), spark.createDataFrame([(1, 2), (1, 1), (1, 77), (2, None)], "id bigint, evidence_id bigint")
    assert sorted(map(tuple, U.attached(listed, links, evidence).collect())) == [(1, 1), (1, 2), (1, 44)]
    deps = spark.createDataFrame([(1, 2), (1, 2), (1, 9), (None, 2)], "source bigint, target bigint")
    assert [tuple(r) for r in U.valid_dependencies(deps, hyp).select("source", "target").collect()] == [(1, 2)]
