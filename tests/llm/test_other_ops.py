"""Tool calls, URL filter, SQL of the registered queries, and the pipeline."""

import glob
import json
import math
import os
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import queries, reputation, toolcalls
from chatloom.llm.common import table

EVENTS = "conv string, turn long, role string, kind string, id string, name string, arguments string, text string, after array<string>, id2 string"
SCHEMAS = {"add": toolcalls.Schema({"a": "integer", "b": "number", "o": "object"}, ("a",)), "free": toolcalls.Schema({}, others=True)}


def events(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], EVENTS)


def call(conv, turn, id_, args='{"a":1}', after=(), name="add"):
    return conv, turn, "assistant", "call", id_, name, args, None, list(after)


def result(conv, turn, id_, text="r"):
    return conv, turn, "tool", "result", id_, None, None, text, None


def test_linking_and_order(spark):
    rows = [
        result("c", 0, "k1"), call("c", 1, "k1"), ("c", 2, "user", "message", None, None, None, "hi", None), call("c", 3, "k2", after=["k3"]), call("c", 4, "k3"), result("c", 5, "k1", "again"),
        result("c", 6, "none"), call("c", 7, "k1"), call("d", 0, "k1", after=["x2", "unknown"]), call("d", 1, "x2", after=["k1"]), call("d", 2, "late", after=["k1"]), (None, None, None, "message", None, None, None, None, None),
    ]
    got = toolcalls.format_chats(events(spark, rows), SCHEMAS).collect()
    by = {(r.conv, r.turn): r for r in got}
    assert {k: r.status for k, r in by.items()} == {
        ("c", 0): "linked", ("c", 1): "answered", ("c", 2): None, ("c", 3): "open", ("c", 4): "open", ("c", 5): "second answer", ("c", 6): "no call", ("c", 7): "repeated id",
        ("d", 0): "open", ("d", 1): "open", ("d", 2): "open", (None, None): None,
    }
    order = lambda c: [r.turn for r in sorted((r for r in got if r.conv == c), key=lambda r: r.place)]
    assert order("c") == [1, 0, 2, 4, 3, 5, 6, 7] and order("d") == [0, 1, 2]
    assert {r.turn for r in got if r.cyclic} == {0, 1, 2} and all(r.conv == "d" for r in got if r.cyclic)
    for c in ("c", "d", None):
        mine = sorted(r.place for r in got if r.conv == c)
        assert mine == list(range(len(mine)))


def test_numbers_have_one_form(spark):
    forms = {
        '{"k":1e3}': '{"k":1000}', '{"k":1000.0}': '{"k":1000}', '{"k":1000}': '{"k":1000}', '{"k":-0.50}': '{"k":-0.5}', '{"k":-0.0}': '{"k":0}', '{"k":[1E-2,0.01,10e-3]}': '{"k":[0.01,0.01,0.01]}',
        '{"k":"1.0, 2.50,1e3\\\\"}': '{"k":"1.0, 2.50,1e3\\\\"}', '{"k":"a\\"1.0,"}': '{"k":"a\\"1.0,"}', '{"k":1e25}': '{"k":10000000000000000000000000}', '{"k":10000000000000000000000000.0}': '{"k":10000000000000000000000000}', '{"k":1e40}': '{"k":1.0E40}', '{"k":1e-30}': '{"k":1.0E-30}', '{"b":2.0,"a":{"x":1.10}}': '{"a":{"x":1.1},"b":2}', "2.0": "2",
    }
    df = spark.createDataFrame([(x,) for x in forms], "t string")
    got = {r.t: r.c for r in df.select("t", toolcalls.canonical(toolcalls.strict_value(F.col("t"))).alias("c")).collect()}
    assert got == forms
    rows = [call("c", i, f"c{i}", t, name="f") for i, t in enumerate(['{"k":1E400}', '{"k":"1E400"}', '{"k":-1e999}', '{"k":2.0}', '{"k":3}', '{"k":4}', '{"k":"' + "\\n" * 20_000 + '1.0","l":1.0}'])]
    schemas = {"f": toolcalls.Schema({"k": toolcalls.Value("number", enum=(2.0, 3.0))}, ("k",))}
    rows = {r.turn: (r.fault, json.loads(r.json)["arguments"]) for r in toolcalls.format_chats(events(spark, rows), schemas).collect()}
    assert rows[5][0].startswith("k is not one of 2, 3") and rows[6][1]["k"].endswith("\n1.0") and rows[6][1]["l"] == 1
    assert rows[0] == ("a number is out of range", {"raw": '{"k":1E400}'}) and rows[2][0] == "a number is out of range"
    assert rows[1] == ("k is not number", {"k": "1E400"}) and rows[3] == (None, {"k": 2}) and rows[4] == (None, {"k": 3})


def test_arguments_and_canonical_json(spark):
    texts = ['{"b":2.5, "a":1 , "o":{"z":1,"y":[1,{"d":1,"c":null}]}}', '{"a":"1"}', "{}", '{"a":1,"x":2}', "[1]", "no", None, '{"a":null}', '{"a":1,"o":[]}']
    rows = [call("c", i, str(i), t) for i, t in enumerate(texts)] + [call("c", 20, "f", '{"any":"é\\n\\""}', name="free"), call("c", 21, "g", name="nope")]
    got = {r.turn: r for r in toolcalls.format_chats(events(spark, rows), SCHEMAS).collect()}
    assert [got[i].fault for i in (*range(len(texts)), 20, 21)] == [None, "a is not integer", "missing a", "unknown argument", "not a JSON object", "not a JSON object", "not a JSON object", "a is not integer", "o is not object", None, "unknown tool"]
    assert json.loads(got[0].json)["arguments"] == json.loads(texts[0])
    for r in got.values():
        value = json.loads(r.json)
        assert r.json == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_arguments_are_one_json_value_and_nothing_else(spark):
    texts = ['{"a":1} garbage', '{"a":1}{"a":2}', '{"a":1},{"a":2}', '{"a":1}]', '{"a":1}] x', '{"a":1}}', '{"a":1},"end":1}', '1,"end":1} x', '  {"a":1}\n', "", " "]
    rows = [call("c", i, str(i), t) for i, t in enumerate(texts)]
    got = {r.turn: r for r in toolcalls.format_chats(events(spark, rows), SCHEMAS).collect()}
    assert [got[i].fault for i in range(len(texts))] == [None if i == 8 else "not a JSON object" for i in range(len(texts))]
    for i, t in enumerate(texts):
        assert json.loads(got[i].json)["arguments"] == ({"a": 1} if i == 8 else {"raw": t})


def test_nested_schemas(spark):
    point = toolcalls.Schema({"x": "number", "y": "number"}, ("x",))
    schema = toolcalls.Schema({"mode": toolcalls.Value("string", enum=("on", "off")), "n": toolcalls.Value("integer", enum=(1, 2)), "tags": toolcalls.Value("array", items="string"), "at": toolcalls.Value("object", fields=point), "path": toolcalls.Value("array", items=toolcalls.Value("object", fields=point))})
    cases = {
        '{"mode":"on","n":2,"tags":["a"],"at":{"x":1,"y":2.5},"path":[{"x":0},{"x":1,"y":1}]}': None, "{}": None, '{"tags":[],"path":[]}': None, '{"mode":"up"}': 'mode is not one of "on", "off"', '{"n":3}': "n is not one of 1, 2",
        '{"n":"1"}': "n is not integer", '{"tags":["a",1]}': "tags[] is not string", '{"tags":"a"}': "tags is not array", '{"at":{"y":1}}': "missing at.x", '{"at":{"x":1,"z":1}}': "unknown argument in at", '{"at":{"x":"1"}}': "at.x is not number",
        '{"path":[{"x":0},{"y":1}]}': "missing path[].x", '{"at":[1]}': "at is not object", '{"n":12345678901234567890}': "n is not one of 1, 2",
    }
    rows = [call("c", i, str(i), t, name="move") for i, t in enumerate(cases)]
    got = {r.turn: r.fault for r in toolcalls.format_chats(events(spark, rows), {"move": schema}).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_ties_do_not_depend_on_how_rows_are_stored(spark):
    rows = [call("c", 1, "k", '{"a":1}'), call("c", 1, "k", '{"a":2}'), result("c", 1, "k", "one"), result("c", 1, "k", "two"), call(None, None, "k"), call(None, None, "k", '{"a":3}'), result("c", 1, "k", "one")]
    told = [sorted(map(repr, toolcalls.format_chats(events(spark, x).coalesce(1), SCHEMAS).collect())) for x in (rows, rows[::-1], rows[3:] + rows[:3])]
    assert told[0] == told[1] == told[2]


def levels_by_hand(nodes, edges):
    needs, at, depth = defaultdict(set), {}, {}
    for u, v in edges:
        needs[u].add(v)
    for _ in nodes:
        for u, turn in nodes.items():
            if u not in at and all(v in at for v in needs[u]):
                at[u], depth[u] = max([turn, *(at[v] for v in needs[u])]), max([0, *(depth[v] + 1 for v in needs[u])])
    return {u: (at[u], depth[u], False) if u in at else (nodes[u], 0, True) for u in nodes}


def test_levels_by_brute_force(spark):
    rng = random.Random(14)
    nodes = {u: rng.randrange(50) for u in range(120)}
    edges = [(u, v) for u in range(120) for v in [*([u - 1] if u % 12 and rng.random() < 0.8 else []), *(rng.sample(range(120), 1) if rng.random() < 0.2 else [])]] + [(5, 4), (5, 4)]
    want = levels_by_hand(nodes, edges)
    assert 5 < sum(x[2] for x in want.values()) < 115 and max(x[1] for x in want.values()) > 5
    got = toolcalls.levels(spark.createDataFrame(list(nodes.items()), "uid long, turn long"), spark.createDataFrame(edges, "uid long, needs long")).collect()
    assert {r.uid: (r.at, r.depth, r.cyclic) for r in got} == want


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], toolcalls.cut
    monkeypatch.setattr(toolcalls, "cut", lambda df, label: rounds.append(label) or cut(df, label))
    n = 5000
    nodes, edges = spark.range(n).selectExpr("id as uid", f"{n} - id as turn"), spark.range(1, n).selectExpr("id as uid", "id - 1 as needs")
    got = toolcalls.levels(nodes, edges).agg(F.max("depth"), F.min("at"), F.max("at"), F.count_if("cyclic")).first()
    assert tuple(got) == (n - 1, n, n, 0) and rounds.count("jumps") <= 15


def test_columns_of_the_operators_own_names_and_long_texts(spark):
    rows = [call("c", 0, "k1", '{"a":1,"b":' + "1" * 300 + "}"), result("c", 1, "k1", "é\n" * 200_000), ("c", 2, "user", "message", None, None, None, "x" * 300_000, None), call("c", 3, "k2", '{"a":"' + "y" * 200_000 + '"}')]
    plain = events(spark, rows)
    clash = plain.selectExpr("*", "7 as uid", "'q' as content", "8 as target", "9 as needs", "10 as at", "11 as place", "'z' as value", "true as large", "'s' as status", "12 as depth")
    of = lambda df: sorted(map(repr, toolcalls.format_chats(df, SCHEMAS).collect()))
    assert of(plain) == of(clash) and len(of(plain)) == 4
    told = {r.turn: json.loads(r.json) for r in toolcalls.format_chats(clash, SCHEMAS).collect()}
    assert told[1]["content"] == "é\n" * 200_000 and told[2]["content"] == "x" * 300_000 and told[3]["arguments"] == {"a": "y" * 200_000}


def test_url_filter_edges(spark):
    urls = ["http://" + "a" * 100_000 + ".com/en/" + "x" * 100_000, "https://www.example.com/en/7" + "9" * 200_000, None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/de/8?q", "http://example.net/de/8?q"]
    pages = spark.createDataFrame([(i, i % 3, u) for i, u in enumerate(urls)] * 2 + [(None, None, urls[0])], "page_id long, page_key long, url string")
    outcomes = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (0, 0)], "page_key long, bad int")
    of = lambda p, o: sorted(map(repr, reputation.judge(p, o).collect()))
    clash_p = pages.selectExpr("*", "'h' as host", "'p' as path", "'r' as rule", "true as blocked", "5 as bad", "'v' as verdict", "1 as n")
    clash_o = outcomes.selectExpr("*", "'h' as host", "'u' as url", "3 as page_id")
    assert of(pages, outcomes) == of(clash_p, clash_o) and len(of(pages, outcomes)) == 17
    by = {r.page_id: r for r in reputation.judge(clash_p, clash_o).collect()}
    assert (by[0].host, by[0].rule, by[0].verdict) == ("a" * 100_000 + ".com", "com/en/", "block") and by[1].rule == "example.com/en/7" and len(by[1].path) == 200_005
    assert all((by[i].host, by[i].path, by[i].rule) == ("", "", None) for i in (2, 3, 4, 5)) and by[6].host == "example.net" and by[7].rule == "example.net/de/8"
    assert reputation.judge(pages.limit(0), outcomes.limit(0)).count() == 0


def test_long_chains_and_places(spark):
    rows = [call("c", 299 - i, str(i), after=[str(i - 1)] if i % 10 else []) for i in range(300)]
    got = sorted(toolcalls.format_chats(events(spark, rows), SCHEMAS).collect(), key=lambda r: r.place)
    place = {r.id: r.place for r in got}
    assert [r.place for r in got] == list(range(300)) and all(place[str(i - 1)] < place[str(i)] for i in range(300) if i % 10)
    assert toolcalls.format_chats(events(spark, rows).limit(0), SCHEMAS).count() == 0


def posterior_by_hand(rows, z=1.645):
    n, bad = defaultdict(int), defaultdict(int)
    for host, b in rows:
        n[host] += b is not None
        bad[host] += b or 0
    parts = {h: (h, ".".join(h.split(".")[-2:]), h.split(".")[-1]) for h in n}
    mean = {"": (sum(bad.values()) + 0.5) / (sum(n.values()) + 1)}
    weight = {}
    for level in (2, 1, 0):
        gn, gb, up = defaultdict(int), defaultdict(int), {}
        for h, p in parts.items():
            gn[p[level]] += n[h]
            gb[p[level]] += bad[h]
            up[p[level]] = p[level + 1] if level < 2 else ""
        m = {g: mean[up[g]] for g in gn}
        x = sum((gb[g] - gn[g] * m[g]) ** 2 - gn[g] * m[g] * (1 - m[g]) for g in gn if gn[g] > 1)
        y = sum(gn[g] * (gn[g] - 1) * m[g] * (1 - m[g]) for g in gn if gn[g] > 1)
        rho = min(max(x / y, 0.001), 0.5) if y else 0.001
        s = (1 - rho) / rho
        mean = {g: (gb[g] + s * m[g]) / (gn[g] + s) for g in gn}
        weight = {g: gn[g] + s for g in gn}
    return {h: mean[h] - z * math.sqrt(mean[h] * (1 - mean[h]) / (weight[h] + 1)) for h in n}


def test_reputation_by_hand(spark):
    rows = [(f"h{i % 13}.d{i % 5}.{'com' if i % 3 else 'net'}", [None, 0, 1, int(i % 5 == 0)][i % 4]) for i in range(600)] + [("", 1), ("solo", None)]
    got = {r.host: r.lower for r in reputation.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    want = posterior_by_hand(rows)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-9 for h in want)


def test_urls_rules_and_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/71?x", "x://example.com/en/8", "a://b://c/d", "http://exämple.NET/de/8#f", "http://example.net/de/8", "http://notexample.net/de/8", "http://h?q/p", "http://org/es/", "http://a.org/ES/"]
    pages = spark.createDataFrame([*enumerate(urls), (None, urls[4])], "page_id long, url string").withColumn("page_key", F.col("page_id"))
    none = spark.createDataFrame([], "page_key long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judge(pages, none).collect()}
    assert [got[i][:3] for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("a.example.com", "/en/71", "example.com/en/7"), ("example.com", "/en/8", "com/en/"), ("b:", "//c/d", None), ("exämple.net", "/de/8", "net/de/"),
        ("example.net", "/de/8", "example.net/de/8"), ("notexample.net", "/de/8", "net/de/"), ("h", "", None), ("org", "/es/", "org/es/"), ("a.org", "/ES/", None),
    ]
    assert [got[i][3] for i in (0, 4, 5, 7, 8, 11, 12)] == ["allow", "allow", "block", "allow", "block", "block", "allow"] and got[None][2] == "example.com/en/7"
    assert reputation.judge(pages.limit(0), none).count() == 0
    bad = spark.createDataFrame([(100 + i, f"http://bad.test/{i}") for i in range(60)] + [(200 + i, f"http://good.test/{i}") for i in range(60)], "page_id long, url string").withColumn("page_key", F.col("page_id"))
    marks = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(100, 0), (100, None), (None, 1)] + [(200 + i, 0) for i in range(60)], "page_key long, bad int")
    verdicts = {(r.host, r.verdict) for r in reputation.judge(bad, marks).collect()}
    assert verdicts == {("bad.test", "block"), ("good.test", "allow")}
    hosts = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x": ("x", "x"), "": ("", ""), "a.example.com:8080": ("example.com", "com"), "example.com:": ("example.com", "com"), "u:p@w.example.com:1": ("example.com", "com"),
        "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "11.9.2.3:80": ("11.9.2.3", "11.9.2.3"), "[::1]:80": ("[::1]", "[::1]"), "shop.co.uk": ("shop.co.uk", "co.uk"), "other.co.uk": ("other.co.uk", "co.uk"), "w.example.com.": ("example.com", "com"),
    }
    host = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: (r.d, r.s) for r in host.select("h", reputation.domain_and_suffix(F.col("h"))[0].alias("d"), reputation.domain_and_suffix(F.col("h"))[1].alias("s")).collect()} == hosts


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.sql(queries.ORACLES[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    rows = lambda t: sorted(repr(tuple(r[k] for k in sorted(r))) for r in t.to_pylist())
    assert rows(queries.QUERIES[name](spark, sf_dir).toArrow()) == rows(want)


def test_pipeline_stage_by_stage(spark, sf_dir, docs):
    from test_text_ops import components_by_hand, judged_by_hand, leaks_by_hand

    from chatloom.llm.common import cut

    first = table(spark, sf_dir, "documents")
    now, seen = first, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = cut(stage(spark, now, sf_dir), "test")
        assert now.columns == first.columns and now.dtypes == first.dtypes
        seen[name] = ([tuple(r) for r in before.select("doc_id", "text").collect()], dict(map(tuple, now.select("doc_id", "text").collect())))
    before, after = seen["language ID"]
    assert {d for d, t in before if t and any(map(str.isalpha, t))} == set(after)
    before, after = seen["line dedup"]
    judged = judged_by_hand(before)
    for d, t in before:
        rest = [x for k, x in enumerate(t.split("\n")) if not any(judged.get((d, k), ())[:2])]
        assert after.get(d, "") == ("\n".join(rest) if d in after else "") and (d in after or not "".join(rest).strip())
    before, after = seen["n-gram Jaccard join"]
    assert set(after) == {d for d, _, c in components_by_hand(before) if d == c}
    before, after = seen["benchmark decontamination"]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = lambda t: "".join(c if c.isalnum() else " " for c in t)
    holding = [(d, clean(t)) for d, t in before if any(clean(b).lower()[:20] in clean(t).lower() for _, b in items)]
    assert set(after) == {d for d, _ in before} - {d for d, _ in leaks_by_hand(holding, [(i, clean(b)) for i, b in items])}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)
