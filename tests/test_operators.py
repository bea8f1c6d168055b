"""The core's data-preparation operators on small cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.names import text_or_null, whole_bytes, yes_no
from factloom.operators.hierarchy import hierarchies
from factloom.operators.nested import _deep, call_links, label_nodes, node_tables
from factloom.operators.packed import _automaton, _hits, _segment, split_values
from factloom.operators.references import dangling
from factloom.operators.wide import characteristic_sets


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_siblings_by_root(spark, tmp_path):
    from factloom.plans.reference import j4_hierarchy_slots, j5_hierarchy_roles

    classes = [("Drawable", None, "0x1"), ("Collideable", "Drawable", "0x2"), ("Wall", "Collideable", "0x3"), ("Food", "Collideable", "0x4"), ("Other", None, "0x5")]
    data = [(n, b, [{"address": a, "raw_name": "m", "display_name": "m"}]) for n, b, a in classes]
    schema = "name string, base string, methods array<struct<address string, raw_name string, display_name string>>"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "recovered_classes.parquet"))
    kept = spark.read.parquet("/root/testdata/sf0.001/hypotheses.parquet")
    role = {"id": 1, "subject": "0x3", "predicate": "semantic_role", "value": "draws itself", "status": "ACCEPTED", "confidence": 0.9}
    spark.createDataFrame([tuple(role.get(c) for c in kept.columns)], kept.schema).write.parquet(str(tmp_path / "hypotheses.parquet"))
    assert rows(j4_hierarchy_slots(spark, str(tmp_path)).select("root", "slot", "n_classes", "first_class")) == [("Drawable", 0, 4, "Collideable")]
    got = rows(j5_hierarchy_roles(spark, str(tmp_path)).select("class_name", "address", "from_class"))
    assert got == [("Collideable", "0x2", "Wall"), ("Drawable", "0x1", "Wall"), ("Food", "0x4", "Wall")]


# --- packed ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "ids"), [
    ("[1,2, 3]", [1, 2, 3]), ('["E1", "E2"]', [1, 2]), ("E1 | e2 + #3", [1, 2, 3]), (",5;;7,", [5, 7]), ("'E1','E1'", [1, 1]),
    ("E162 (unsigned), E138 (8 sites)", [162, 138]), ('E162|"E120 (said ""tracker"")"|"144"', [162, 120, 144]), ('"";"122"', [122]),
    ('"E9 (from 0x23a8 | sorter, 4)","10"', [9, 10]), ("E00013257、E5；7", [13257, 5, 7]), ("E1. E2.", [1, 2]), ("none", []), ("0x12", []),
    ('"E1, "E2"', [1, 2]), ('""     ""', []), ('"", 12, ""', [12]), ("9" * 30, []), ('"no number", 4', [4]),
    ("observation12, E5", [12, 5]), ("hypothesis7;E5", [7, 5]), ("##3", [3]),
])
def test_segments(text, ids):
    assert _segment(text, {}) == ids
    assert _segment(text, _hits(text, _automaton(set(ids)))) == ids


@pytest.mark.parametrize(("text", "known", "ids"), [
    ("1,234; E7", {1234}, [1234, 7]), ("1,234; E7", {1234, 1}, [1, 234, 7]), ("1,234; E7", set(), [1, 234, 7]), ("1,234,567", {1234567}, [1234567]),
    ("1,234,5", {1234}, [1, 234, 5]), ("0.1,234", {1234}, [234]), ("E12E13", {12, 13}, [12, 13]), ("E12E13", {12}, []), ("id_12 and id_13", {12}, [12]),
    ("0x12 1cd3832e0 x86", {12, 1, 3832, 86}, [86]), ("E0012E12", {12}, [12, 12]), ("112 12", {12}, [112, 12]),
])
def test_dictionary_decides(text, known, ids):
    assert _segment(text, _hits(text, _automaton(known))) == ids


def test_split_values(spark):
    df = spark.createDataFrame([(1, "E1, E7"), (1, "E1, E7"), (2, None), (3, ""), (4, '"x 7, 8" 9'), (5, "7 " * 3000)], "id bigint, t string")
    known = spark.createDataFrame([(7,), (7,), (None,)], "id bigint")
    expected = [(1, 1, 1), (1, 2, 7), (4, 1, 7), (4, 2, 9)] + [(5, i, 7) for i in range(1, 3001)]
    assert rows(split_values(df, ["id"], "t", known)) == sorted(expected, key=str)
    assert rows(split_values(df, ["id"], "t", None)) == sorted(expected, key=str)
    assert rows(split_values(df.limit(0), ["id"], "t", known)) == []
    packed = spark.createDataFrame([(1, "1,234 | E7")], "id bigint, t string").withColumn("_n", F.lit("clash"))
    assert rows(split_values(packed, ["id"], "t", spark.createDataFrame([(1234,)], "id bigint"), least_hot=0)) == [(1, 1, 1234), (1, 2, 7)]
    assert rows(split_values(packed, ["id"], "t", None)) == [(1, 1, 1), (1, 2, 234), (1, 3, 7)]


# --- wide -----------------------------------------------------------------------------------------------------


def test_wide(spark):
    data = [
        (1, "a", "t", " x "), (2, "a", "t", "y"), (3, "a", "n", "0x10"), (4, "a", "n", "large"), (5, "b", "f", "Y"), (5, "b", "f", "Y"),
        (6, "c", "t", None), (7, None, "t", "z"), (8, "d", "other", "1"), (None, "e", "t", "w"), (9, "c", None, "q"),
    ]
    df = spark.createDataFrame(data, "id bigint, s string, p string, v string").withColumn("_sig", F.lit(1)).withColumn("t", F.lit("clash"))
    v = F.col("_v")
    got = characteristic_sets(df, "s", "p", "v", "id", {"t": ("string", text_or_null(v)), "n": ("bigint", whole_bytes(v)), "f": ("int", yes_no(v))})
    assert got.columns == ["s", "t", "n", "f"]
    assert rows(got) == sorted([("a", "y", 16, None), ("b", None, None, 1), ("c", None, None, None), ("e", "w", None, None)], key=str)
    assert rows(characteristic_sets(df.limit(0), "s", "p", "v", "id", {"t": ("string", text_or_null(v))})) == []


def test_wide_of_many_attributes(spark):
    rng = random.Random(3)
    names = ["_e", "_sig", "a0", *(f"x{i}" for i in range(37))]
    data = [(i, f"s{rng.randrange(60)}", n, str(rng.randrange(9))) for i in range(1500) if (n := rng.choice(names))]
    data += [(2000 + i, "hot", names[i % 40], "1") for i in range(400)] + [(3000 + i, f"same{i}", "x1", "5") for i in range(50)]
    df = spark.createDataFrame(data, "id bigint, s string, p string, v string")
    last = {}
    for i, s, p, v in data:
        last[s, p] = v
    got = characteristic_sets(df, "s", "p", "v", "id", {n: ("bigint", F.col("_v").cast("bigint")) for n in names}, most_tables=3)
    assert got.columns == ["s", *names]
    assert rows(got) == sorted((tuple([s, *(int(last[s, n]) if (s, n) in last else None for n in names)]) for s in {s for s, _ in last}), key=str)


# --- nested ---------------------------------------------------------------------------------------------------


def test_intervals_nest(spark):
    payload = json.dumps({"a": [{"b": [1, 2]}, None, {"b": 3}]})
    got = {(r.node_type, r.pos): (r.pre, r.post) for r in label_nodes(spark.createDataFrame([(1, payload)], "d bigint, p string"), "d", "p", ["a", "a[]", "a[].b", "a[].b[]"]).collect()}
    assert got["a", None][0] < got["a[]", 0][0] < got["a[].b[]", 0][0] <= got["a[].b[]", 0][1] < got["a[]", 0][1] < got["a[]", 2][0] < got["a", None][1]


@pytest.mark.parametrize("text", [
    '{"a": [1, -2.5e3, "x\\u00e9\\"", true, false, null, {}, []], "b": {"c": {"a": [[]]}}, "a": 3}', " [ ] ", "3", '"x"', '{"k" : {"l":[{"m":1},{"m":2}]}}',
])
def test_deep_reader(text):
    assert _deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "[1,]", '{"a":1,}', "{1:2}", "[1 2]", "[", '{"a"', "tru", "1 2", "[01]", "[NaN]", '{"a" 1}', '["a'])
def test_deep_reader_refuses(text):
    with pytest.raises(ValueError):
        json.loads(text, parse_constant=int)
    with pytest.raises(ValueError):
        _deep(text)


def test_documents_stay_apart(spark):
    one = lambda a, b: json.dumps({"functions": [{"address": a, "callees": [b]}]})
    deep = '{"x": ' + "[" * 50_000 + "]" * 50_000 + ', "functions": [{"address": "0x7", "callees": ["0x8"]}]}'
    df = spark.createDataFrame([(1, one("0x1", "0x2")), (1, one("0x3", "0x4")), (None, one("0x5", "0x6")), (2, deep)], "id bigint, p string").withColumn("key", F.lit(0))
    got = rows(call_links(df, "id", "p").select("id", "function_address", "link_address"))
    assert got == sorted([(1, "0x1", "0x2"), (1, "0x3", "0x4"), (None, "0x5", "0x6"), (2, "0x7", "0x8")], key=str)


def test_node_tables_link_by_containment(spark):
    payload = json.dumps({"a": [{"b": [1, 2]}, {"b": [3]}]})
    t = node_tables(label_nodes(spark.createDataFrame([(1, payload), (2, payload)], "d bigint, p string"), "d", "p", ["a[]", "a[].b[]"]), ["a[]", "a[].b[]"])
    up, low = t["a[]"].alias("u"), t["a[].b[]"].alias("l")
    inside = [F.col("u.doc") == F.col("l.doc"), F.col("u.key") == F.col("l.key"), F.col("l.pre").between(F.col("u.pre"), F.col("u.post"))]
    assert rows(up.join(low, inside).select("u.doc", "u.pos", "l.scalar")) == sorted([(d, p, s) for d in (1, 2) for p, s in ((0, "1"), (0, "2"), (1, "3"))], key=str)


def test_call_links(spark):
    doc = {"functions": [
        {"address": "0X00A", "callers": ["0xB", None, 12, {"space": "ram", "offset": "0xD"}], "callees": "0xE"},
        None,
        {"callees": [{"sites": [{"at": "0x1"}], "address": {"offset": 15}}], "callers": None, "address": {"offset": 16}},
        {"address": 17, "callers": [], "callees": {"address": "0x12"}},
    ]}
    data = [(1, json.dumps(doc)), (1, json.dumps(doc)), (2, '{"functions": ['), (3, None), (4, ""), (5, '{"functions": null}'), (6, "null"), (7, '{"functions": [{"callers": [NaN]}]}')]
    got = rows(call_links(spark.createDataFrame(data, "id bigint, p string"), "id", "p").select("id", "function_pos", "function_address", "link_side", "link_pos", "link_address"))
    assert got == sorted([
        (1, 0, "0xa", "caller", 0, "0xb"), (1, 0, "0xa", "caller", 2, "0xc"), (1, 0, "0xa", "caller", 3, "0xd"), (1, 0, "0xa", "callee", 0, "0xe"),
        (1, 2, "0x10", "callee", 0, "0xf"), (1, 3, "0x11", "callee", 0, "0x12"),
    ], key=str)


# --- references -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least_hot", [20_000, 2])
def test_dangling(spark, least_hot):
    day = lambda n: dt.datetime(2025, 1, n)
    refs = [("o", 1, i, day(5)) for i in range(20)] + [("o", 2, 1, day(5)), ("o", 2, 1, day(5)), ("o", 3, 2, day(5)), ("o", 4, 3, None), ("o", None, 4, day(1)), ("e", 1, 5, day(5)), ("o", 5, 6, day(5))]
    parents = [("o", 1, day(9), False), ("o", 1, day(9), False), ("o", 2, day(1), True), ("o", 4, day(9), None), ("o", 5, None, False), ("o", None, day(1), False)]
    got = dangling(
        spark.createDataFrame(refs, "kind string, key bigint, row_id bigint, time timestamp_ntz"),
        spark.createDataFrame(parents, "kind string, key bigint, valid_from timestamp_ntz, deleted boolean"), most_hot=1000, least_hot=least_hot,
    ).select("kind", "key", "row_id", "state")
    assert rows(got) == sorted([("o", 1, i, "later") for i in range(20)] + [("o", 2, 1, "deleted"), ("o", 3, 2, "missing"), ("e", 1, 5, "missing")], key=str)


# --- hierarchies ----------------------------------------------------------------------------------------------


def brute(parent: dict) -> set:
    below, out = dict.fromkeys(parent, 0), set()
    for n in parent:
        way = [n]
        while (p := parent.get(way[-1])) is not None and p not in way:
            way.append(p)
        for a in way[1:]:
            if a in below:
                below[a] += 1
        k = way.index(p) if p is not None else len(way)
        ring = way[k:]
        state = "tree" if p is None else "cycle" if k == 0 else "below_cycle"
        out.add((n, min(ring) if ring else way[-1], (k if ring else len(way) - 1), state, n if k == 0 and ring else " > ".join(reversed(way[: k + 1])), n))
    return {(a, b, c, d, e, below[f]) for a, b, c, d, e, f in out}


def shapes():
    yield "chain", {f"c{i:02}": f"c{i - 1:02}" if i else None for i in range(30)}
    yield "ring", {f"r{i}": f"r{(i + 1) % 7}" for i in range(7)} | {"x": "r3", "y": "x", "z": "y", "self": "self", "below": "self"}
    rng = random.Random(5)
    yield "random", {f"n{i}": rng.choice([None, f"n{rng.randrange(60)}", f"gone{i % 3}"]) for i in range(60)}
    yield "two hubs", {f"t{i}": f"hub{i % 2}" for i in range(9)} | {"hub0": "hub1", "hub1": "hub0"}
    yield "star", {f"s{i}": "hub" for i in range(40)} | {"hub": None}


@pytest.mark.parametrize(("name", "parent"), list(shapes()))
def test_hierarchies(spark, name, parent):
    links = [(n, p) for n, p in parent.items()] + [(next(iter(parent)), None), (None, "q")]
    got = set(map(tuple, hierarchies(spark.createDataFrame(links, "v string, w string"), "v", "w").collect()))
    assert got == brute(parent)


def test_no_hierarchy(spark):
    assert hierarchies(spark.createDataFrame([], "v string, w string"), "v", "w").collect() == []
