"""The training-data operators against brute force, with dirty rows, ties, hot groups and empty tables."""

import datetime as dt
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import queries
from factloom.llm.components import components
from factloom.llm.hashing import window_minima
from factloom.llm.leakage import RUN_MASKS, _held, find_leaks, seed_filter
from factloom.llm.neardup import near_groups, near_links, near_pairs, prob_min_hash
from factloom.llm.packing import fill, fills, pack
from factloom.llm.spans import shared_spans
from factloom.llm.survivors import SENSITIVITY_PRIOR, SETTLED, SPECIFICITY_PRIOR, _claims, _stated, judged_values, stated_survivors, survivors, truth_model


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- near duplicates ------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def sets(data, least=40):
    out = {}
    for i, t in data:
        k = TOKEN.findall(t or "")
        if i is not None and len(k) >= least:
            out[i] = {tuple(k[j : j + 3]) for j in range(len(k) - 2)}
    return out


def edited(rng, text, n):
    w = list(text)
    for _ in range(n):
        at, what = rng.randrange(len(w)), rng.random()
        if what < 0.4:
            w[at] = f"v{rng.randrange(10**6)}"
        elif what < 0.7:
            w.insert(at, f"0x{rng.randrange(10**6):x}")
        else:
            a = rng.randrange(len(w))
            w[a:a], w[at : at + 5] = w[at : at + 5], []
    return w


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(3)
    data = []
    for g in range(12):
        base = words(rng, 150, 10**6)
        data += [" ".join(edited(rng, base, rng.randrange(0, 14))) for _ in range(6)]
    data += [data[0]] * 9 + [data[7]] * 2 + ["( ; ) " * 40, "( ; ) " * 41, "short one", "", "é ü 漢 字 " * 30, "x" * 50_000, "a b " * 5000]
    table = [(i, t) for i, t in enumerate(data)] + [(1, data[1]), (500, None), (None, data[0])]
    return table


@pytest.mark.parametrize("cell", [4096, 3])
def test_near_pairs(spark, bodies, cell):
    df = spark.createDataFrame(bodies, "id bigint, t string").withColumn("text", F.lit("clash")).withColumn("n", F.lit(0))
    s = sets(bodies)
    expected = [(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])]
    assert rows(near_pairs(df, "id", "t", cell=cell)) == sorted(expected, key=str)


def test_relocated_bodies(spark):
    """Copies of a function at other addresses: every token with digits differs, but most triples have none."""
    rng = random.Random(5)
    data = []
    for g in range(40):
        base = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(200)]
        for at in range(5, 195, 15 + g % 5):
            base[at] = None
        data += [" ".join(w or f"DAT_{rng.randrange(16**8):08x}" for w in base) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(data)), "id bigint, t string")
    s = sets(enumerate(data))
    expected = [(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])]
    assert len(expected) == 40
    assert rows(near_pairs(df, "id", "t")) == sorted(expected, key=str)


def test_recall_at_each_similarity(spark):
    """Relocated copies at overlaps from 0.6 to 0.95: addresses differ at every so many tokens."""
    rng = random.Random(17)
    data, every = [], (12, 13, 14, 16, 20, 22, 28, 40, 60, 110)
    for step in every:
        for _ in range(40):
            base = [f"{''.join(rng.choice('abcdefghijklmn') for _ in range(4))}" for _ in range(330)]
            for _ in range(2):
                data.append(" ".join(f"DAT_{rng.randrange(16**8):08x}" if k % step == step - 1 else w for k, w in enumerate(base)))
    s = sets(enumerate(data))
    sim = {(a, a + 1): len(s[a] & s[a + 1]) / len(s[a] | s[a + 1]) for a in range(0, len(data), 2)}
    expected = {p: x for p, x in sim.items() if x >= 0.6}
    got = set(map(tuple, near_pairs(spark.createDataFrame(list(enumerate(data)), "id bigint, t string"), "id", "t").collect()))
    assert got <= set(expected)
    for low in (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9):
        here = [p for p, x in expected.items() if low <= x < low + 0.05]
        assert here and all(p in got for p in here), (low, len(here), sum(p in got for p in here))


@pytest.mark.parametrize("least_hot", [20_000, 1])  # 1: whatever recurs is dealt over several tasks
def test_near_groups(spark, bodies, least_hot):
    df = spark.createDataFrame(bodies, "id bigint, t string")
    s = sets(bodies)
    near = defaultdict(set)
    for a in s:
        for b in s:
            if a != b and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b]):
                near[a].add(b)
    got = {r.id: (r.group_id, r.n_links) for r in near_groups(df, "id", "t", least_hot=least_hot).collect()}
    assert {i: n for i, (_, n) in got.items()} == {i: len(x) for i, x in near.items()}
    for a, x in near.items():
        assert all(got[a][0] == got[b][0] <= a for b in x)


def test_no_near_pairs(spark):
    df = spark.createDataFrame([], "id bigint, t string")
    assert rows(near_pairs(df, "id", "t")) == rows(near_groups(df, "id", "t")) == []


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 2**54, 300, dtype=np.uint64), rng.integers(0, 2**54, 300, dtype=np.uint64)
    a, b = np.concatenate((shared, own[:150])), np.concatenate((shared, own[150:]))
    keys = np.concatenate((np.sort(a), np.sort(b) | np.uint64(1 << 54)))
    sig = prob_min_hash(keys, np.ones(len(keys)), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 300 / 600) < 0.05
    weights = np.where(np.isin(keys & np.uint64((1 << 54) - 1), shared), 3.0, 1.0)
    sig = prob_min_hash(keys, weights, 2, 2048)
    # probability Jaccard: each shared element counts 1 / sum of max(w_d'(a)/w_d(a), w_d'(b)/w_d(b))
    assert abs((sig[0] == sig[1]).mean() - 300 / (300 + 300 / 3)) < 0.05


def test_links_are_exact(spark, bodies):
    _, links = near_links(spark.createDataFrame(bodies, "id bigint, t string"), "id", "t")
    s = sets(bodies)
    for r in links.collect():
        assert math.isclose(r.similarity, len(s[r.a] & s[r.b]) / len(s[r.a] | s[r.b]))


@pytest.mark.parametrize("least_hot", [20_000, 1])
def test_components(spark, least_hot):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b", least_hot).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, **dict.fromkeys(range(200, 260), 200)}


# --- survivors ------------------------------------------------------------------------------------------------


def facts():
    rng = random.Random(4)
    out, good = [], {"a": 0.95, "b": 0.9, "c": 0.3}
    for g in range(120):
        for source, p in good.items():
            if rng.random() < 0.9:
                v = "right" if rng.random() < p else f"wrong{rng.randrange(3)}"
                out.append((len(out), f"s{g}", "p", v, rng.choice([0.5, 0.9, None]), source, dt.datetime(2025, 1, 1 + rng.randrange(5)) if rng.random() < 0.8 else None, True))
    return out


def test_model_trusts_good_sources(spark):
    schema = "id bigint, subject string, predicate string, value string, confidence double, source string, created_at timestamp_ntz, says boolean"
    df = spark.createDataFrame(facts(), schema)
    claims = [(r.subject, r.value, r.probability) for r in judged_values(df).collect()]
    dealt = [(r.subject, r.value, r.probability) for r in judged_values(df, least_hot=1).collect()]
    assert sorted(dealt) == [(s, v, pytest.approx(p)) for s, v, p in sorted(claims)]
    right = [p for _, v, p in claims if v == "right"]
    wrong = [p for _, v, p in claims if v != "right"]
    assert np.mean(right) > 0.8 > 0.4 > np.mean(wrong)


def test_model_equals_plain_em(spark):
    data = facts()
    schema = "id bigint, subject string, predicate string, value string, confidence double, source string, created_at timestamp_ntz, says boolean"
    patterns, quality = truth_model(_claims(_stated(spark.createDataFrame(data, schema)), least_hot=1), rounds=4, settled=0.0, least_hot=1)
    got = {r.source: (r.sensitivity, r.specificity) for r in quality.collect()}
    named, spoken = defaultdict(set), defaultdict(set)
    for _, s, _, v, _, source, _, _ in data:
        named[s, v].add(source)
        spoken[s].add(source)
    q = dict.fromkeys("abc", (0.7, 0.9))
    for _ in range(4):
        prob = {}
        for (s, v), yes in named.items():
            o = sum(math.log(q[x][0] / (1 - q[x][1])) if x in yes else math.log((1 - q[x][0]) / q[x][1]) for x in spoken[s])
            prob[s, v] = 1 / (1 + math.exp(-o))
        q = {
            x: (
                (sum(p for k, p in prob.items() if x in named[k]) + SENSITIVITY_PRIOR[0]) / (sum(p for k, p in prob.items() if x in spoken[k[0]]) + sum(SENSITIVITY_PRIOR)),
                (sum(1 - p for k, p in prob.items() if x in spoken[k[0]] and x not in named[k]) + SPECIFICITY_PRIOR[0]) / (sum(1 - p for k, p in prob.items() if x in spoken[k[0]]) + sum(SPECIFICITY_PRIOR)),
            )
            for x in "abc"
        }
    for x in "abc":
        assert got[x] == pytest.approx(q[x], rel=1e-9)


def test_model_runs_until_it_settles(spark):
    """Sources of middling quality need 15 rounds; the default runs them all, as plain rounds do that end by themselves."""
    rng = random.Random(4)
    data, quality = [], {"a": 0.9, "b": 0.6, "c": 0.4}
    for g in range(400):
        for source, p in quality.items():
            if rng.random() < 0.8:
                v = "right" if rng.random() < p else f"wrong{rng.randrange(2)}"
                data.append((len(data), f"s{g}", "p", v, 0.5, source, None, True))
    schema = "id bigint, subject string, predicate string, value string, confidence double, source string, created_at timestamp_ntz, says boolean"
    claims = _claims(_stated(spark.createDataFrame(data, schema)))
    got = {r.source: (r.sensitivity, r.specificity) for r in truth_model(claims)[1].collect()}
    patterns = [({c.source: c.yes for c in r.pattern}, r["count"]) for r in claims.groupBy("pattern").count().collect()]
    q, moved, done = dict.fromkeys("abc", (0.7, 0.9)), 1.0, 0
    while moved >= SETTLED:
        odds = [sum(math.log(q[x][0] / (1 - q[x][1])) if yes else math.log((1 - q[x][0]) / q[x][1]) for x, yes in p.items()) for p, _ in patterns]
        true = [(p, n / (1 + math.exp(-o))) for (p, n), o in zip(patterns, odds, strict=True)]
        false = [(p, n / (1 + math.exp(o))) for (p, n), o in zip(patterns, odds, strict=True)]
        new = {
            x: (
                (sum(t for p, t in true if p.get(x)) + SENSITIVITY_PRIOR[0]) / (sum(t for p, t in true if x in p) + sum(SENSITIVITY_PRIOR)),
                (sum(f for p, f in false if p.get(x) is False) + SPECIFICITY_PRIOR[0]) / (sum(f for p, f in false if x in p) + sum(SPECIFICITY_PRIOR)),
            )
            for x in "abc"
        }
        moved, q, done = max(abs(a - b) for x in "abc" for a, b in zip(q[x], new[x], strict=True)), new, done + 1
    assert done == 15
    for x in "abc":
        assert got[x] == pytest.approx(q[x], rel=1e-9)


def test_survivors(spark):
    day = lambda n: dt.datetime(2025, 1, n)
    data = [
        (1, "s", "p", "old", 0.9, "a", day(1), True), (2, "s", "p", "new", 0.9, "b", day(2), True), (2, "s", "p", "new", 0.9, "b", day(2), True), (3, "s", "p", None, 1.0, "c", None, False),
        (4, "t", "p", "?", 0.9, None, None, False), (5, "t", "p", None, None, None, None, False), (6, "u", "p", "lonely", 0.9, "a", day(1), True), (10, "w", "p", "single", 0.9, "b", day(1), True),
        (7, "v", "p", "x", float("nan"), None, None, True), (8, "v", "p", "y", None, None, None, True), (None, "v", "p", "z", 1.0, "a", day(3), True), (9, None, "p", "z", 1.0, "a", day(3), True),
    ]
    df = spark.createDataFrame(data, "id bigint, subject string, predicate string, value string, confidence double, source string, created_at timestamp_ntz, says boolean")
    got = rows(survivors(df, rounds=2).select("subject", "first_id", "value_id", "value", "created_id"))
    assert got == [("s", 1, 2, "new", 2), ("t", 4, None, None, 5), ("v", 7, 8, "y", 8)]
    assert rows(survivors(df.limit(0), rounds=1)) == []
    assert rows(stated_survivors(df)) == [("s", "p", 1, 2, 2), ("t", "p", 4, None, 5), ("v", "p", 7, 8, 8)]
    assert rows(stated_survivors(df.limit(0))) == []


def test_model_decides_the_record(spark, tmp_path):
    """Two good sources outvote a bad one that claims more confidence, through the registered query."""
    from factloom.llm.queries import p3_records

    rng = random.Random(11)
    data = []
    for g in range(150):
        right, wrong = f"v{rng.randrange(1000)}", f"w{rng.randrange(1000)}"
        for source, p, confidence in (("good", 0.95, 0.5), ("fair", 0.9, 0.5), ("bad", 0.15, 0.99)):
            data.append((len(data), f"0x{g + 16:x}", "hasName", right if rng.random() < p else wrong, confidence, source, None, dt.datetime(2025, 1, 1), "ACTIVE", None))
    schema = "id bigint, subject string, predicate string, value string, confidence double, source string, artifact string, created_at timestamp_ntz, status string, superseded_by bigint"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "observations.parquet"))
    records = p3_records(spark, str(tmp_path)).collect()
    assert len(records) == 150 and sum(r.value.startswith("v") for r in records) >= 138
    stated = stated_survivors(spark.createDataFrame(data, schema).withColumn("says", F.lit(True))).collect()
    assert sum(data[r.value_id][3].startswith("v") for r in stated) < 50


# --- packing --------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(6)
    texts = [" ".join(words(rng, rng.choice([1, 5, 40, 300, 900]))) for _ in range(300)] + ["", None, "word " * 9000, "x" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "d bigint, t string").withColumn("tokens", F.lit("clash"))
    got = pack(df, "d", "t", capacity=512, group_tokens=20_000)
    placed = got.collect()
    import factloom.llm.packing as P

    count = P._encoding(*P._ranks(P.default_tokenizer())).encode_ordinary
    size = Counter()
    for r in placed:
        size[r.d] += r.tokens
    assert size == Counter({d: len(count(t)) if t else 0 for d, t in enumerate(texts)} | {3: 2 * len(count(texts[3]))})
    held = defaultdict(list)
    for r in placed:
        held[r.container].append((r.place, r.tokens))
    for parts in held.values():
        parts.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[-1][0] + parts[-1][1] <= 512
    parts = defaultdict(list)
    for r in placed:
        parts[r.d].append((r.part, r.tokens))
    assert all(n == 512 for d, p in parts.items() if d != 3 for _, n in sorted(p)[:-1])
    used = [r.used for r in fills(got).collect()]
    assert sum(used) / (512 * len(used)) > 0.95
    assert rows(pack(df.limit(0), "d", "t")) == []


def test_fill_balances_cost():
    sizes = np.array([100] * 40 + [400] * 10 + [7] * 30)
    container, _ = fill(sizes, 512, 1.0, 0.01)
    room = Counter()
    for c, s in zip(container, sizes, strict=True):
        room[c] += s
    assert max(room.values()) <= 512 and len(room) <= math.ceil(sizes.sum() / 512) + 2


# --- leakage --------------------------------------------------------------------------------------------------


def tokens(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


@pytest.mark.parametrize("settings", [{}, {"masks": RUN_MASKS, "substitutions": 0}, {"least_hot": 1}])
def test_leaks(spark, settings):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randrange(5, 60)))) for i in range(30)] + [(100, None), (101, ""), (None, "x"), (0, None)]
    docs = []
    for d in range(80):
        w = words(rng, rng.randrange(0, 200))
        source = tokens(rng.choice(items)[1])
        if source:
            a = rng.randrange(len(source))
            w[len(w) // 2 : len(w) // 2] = source[a : a + rng.choice([5, 12, 13, 14, 40])]
        docs.append((d, rng.choice([" ", "\n", "-", "__"]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    docs += [(200, None), (201, ""), (202, " ".join(tokens(items[3][1]) * 300)), (5, docs[5][1])]
    grams = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(i)
    expected = set()
    for d, t in docs:
        w = tokens(t)
        for k in range(len(w) - 12):
            expected |= {(d, i) for i in grams.get(tuple(w[k : k + 13]), ())}
    got = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("t", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string"), **settings)
    assert set(map(tuple, got.where("exact_words >= 13").select("doc_id", "item_id").collect())) == expected


def test_seed_filter(spark):
    seeds = np.random.default_rng(3).integers(-(2**63), 2**63, 3000)
    bits = seed_filter(spark.createDataFrame([(int(h),) for h in seeds], "h bigint"))
    assert len(_held(seeds.view(np.uint64), bits)) == 3000
    others = np.random.default_rng(4).integers(0, 2**64, 200_000, dtype=np.uint64)
    assert len(_held(others, bits)) < 50
    assert not seed_filter(spark.createDataFrame([], "h bigint")).any()


def test_leaks_with_substitutions(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen last"
    doc = item.replace("three", "X").replace("six", "Y")  # both fall on places that some mask ignores
    got = find_leaks(spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert [(r.overlap_words, r.substitutions) for r in got] == [(16, 2)]
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert rows(find_leaks(none, spark.createDataFrame([(1, item)], "item_id bigint, text string"))) == []
    assert rows(find_leaks(spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string"))) == []


def test_leaks_with_any_two_substitutions(spark):
    item = [f"i{k}" for k in range(13)]
    places = [(a, b) for a in range(13) for b in range(a, 13)]
    docs = [(n, " ".join(["p", "q", *("X" if k in ab else w for k, w in enumerate(item)), "r"])) for n, ab in enumerate(places)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert sorted(r.doc_id for r in got.collect() if r.overlap_words == 13) == list(range(len(places)))


def test_longest_overlap_on_another_alignment(spark):
    item = [f"i{k}" for k in range(60)]
    doc = [*item[:12], "a", "b", "c", "d", *item[20:28], "X", *item[29:37], "Y", *item[38:46], "e", "f", "g"]
    got = find_leaks(spark.createDataFrame([(1, " ".join(doc))], "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert [(r.exact_words, r.overlap_words, r.substitutions) for r in got.collect()] == [(12, 26, 2)]


# --- shared spans ---------------------------------------------------------------------------------------------


def shared(docs, k):
    seen = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - k + 1):
            seen[t[i : i + k]].add(d)
    out = {}
    for d, t in docs:
        flags = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - k + 1):
            if len(seen[t[i : i + k]]) > 1:
                flags[i : i + k] = True
        if flags.any():
            out[d] = int(flags.sum())
    return out


@pytest.mark.parametrize("hot_windows", [2_000_000, 40, 1])
def test_shared_spans(spark, hot_windows):
    rng = random.Random(9)
    letters = "abcdefgh éü漢😀"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [noise(90), noise(45), "ab" * 60, noise(39)]
    docs = [(d, "".join(noise(rng.randrange(60)) + rng.choice(passages)[rng.randrange(8) :] for _ in range(rng.randrange(4)))) for d in range(60)]
    docs += [(100, None), (101, ""), (102, "z" * 900), (103, "z" * 300), (104, docs[3][1]), (3, docs[3][1]), (105, noise(5000) + passages[0])]
    got = shared_spans(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("doc", F.lit(1)), k=40, m=12, hot_windows=hot_windows)
    assert dict(map(tuple, got.collect())) == shared(docs, 40)


def test_no_shared_spans(spark):
    assert rows(shared_spans(spark.createDataFrame([], "doc_id bigint, text string"))) == []


def test_window_minima():
    x = np.random.default_rng(2).integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 2, 7, 499, 500, 501):
        assert window_minima(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


# --- registered queries ----------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    """Each query against its SQL; without one, what must hold of its rows."""
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = Counter(map(tuple, got.select(*columns).collect()))
    assert max(mine.values()) == 1
    table = lambda t: f"'{SF}/{t}.parquet'"
    db = duckdb.connect()
    for t in ("observations", "function_facts", "documents", "eval_items"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM {table(t)}")
    if name in queries.ORACLES:
        assert mine == Counter(db.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())
    elif name == "p1_groups":
        pairs = db.execute(queries.ORACLES["p1_found"]).fetchall()
        links = Counter(x for p in pairs for x in p)
        assert {r[columns.index("fact_id")]: r[columns.index("n_links")] for r in mine} == links
        group = {r[columns.index("fact_id")]: r[columns.index("group_id")] for r in mine}
        assert all(group[a] == group[b] for a, b in pairs)
    elif name == "p3_records":
        groups = db.execute(f"SELECT count(*) FROM ({queries.ORACLES['p3_found']})").fetchone()[0]
        assert sum(mine.values()) == groups
        assert all(0 < r[columns.index("probability")] < 1 for r in mine if r[columns.index("probability")] is not None)
    elif name == "p8_pack":
        assert {r[columns.index("doc_id")] for r in mine} == {d for (d,) in db.execute("SELECT doc_id FROM documents").fetchall()}
    elif name == "p8_fill":
        assert all(0 <= r[columns.index("used")] <= 2048 for r in mine)
    elif name == "p9_leaks":
        exact = Counter(i for _, i in db.execute(f"SELECT doc_id, item_id FROM ({queries.ORACLES['p9_found']})").fetchall())
        assert {r[columns.index("item_id")]: r[columns.index("n_exact")] for r in mine if r[columns.index("n_exact")]} == exact
