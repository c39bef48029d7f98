"""Hard cases of the tool calls and of the secret scan."""

import json
import random
import time

import pytest

from acvlens.llm import secret_scan, tool_calls

CALLS = "conv_id long, call_id string, position long, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, position long, content string"
SCHEMA = {"tool": {"type": "object", "properties": {
    "a": {"type": ["string", "null"]}, "n": {"type": "null"}, "e": {"enum": [1, "x", [True], {"k": 0}]},
    "i": {"type": "integer"}, "odd": {"type": "date"}, "m": {"type": "number", "minimum": 2}}}}

# arguments -> errors of the call
CASES = {
    '{"a":1e999}': "$: not a JSON object", '{"a":-1e999}': "$: not a JSON object", '{"a":NaN}': "$: not a JSON object",
    '{"a":"\\ud800"}': "$: not a JSON object", '{"\\udc00":1}': "$: not a JSON object", '{"a":"\\ud83d\\ude00"}': "",
    '{"a":' + "9" * 5000 + "}": "$: not a JSON object", '{"x":' + "[" * 5000 + "]" * 5000 + "}": "$: not a JSON object",
    '{"x":' + "[" * 250 + "]" * 250 + "}": "$: not a JSON object", '{"x":' + "[" * 150 + "]" * 150 + "}": "",
    '{"a":null,"n":null}': "", '{"a":"t"}': "", '{"a":5}': "$.a: not string or null", '{"n":0}': "$.n: not null",
    '{"e":true}': "$.e: not in enum", '{"e":1}': "", '{"e":1.0}': "", '{"e":[1]}': "$.e: not in enum", '{"e":[true]}': "",
    '{"e":{"k":false}}': "$.e: not in enum", '{"e":{"k":0}}': "", '{"i":true}': "$.i: not integer", '{"i":2.0}': "",
    '{"i":2.5}': "$.i: not integer", '{"odd":1}': "$.odd: not date", '{"m":1}': "$.m: below minimum", '{"m":true}': "$.m: not number",
    "[1]": "$: not a JSON object", "1": "$: not a JSON object", "": "$: not a JSON object", '{"a"': "$: not a JSON object",
    '{"b":"' + "x" * 10_000_000 + '"}': "", "\x00": "$: not a JSON object", '{"a":1,"a":"t"}': "",
}


def test_no_arguments_stop_the_job(spark):
    rows = [(1, f"c{k}", k, "tool", text, None) for k, text in enumerate([*CASES, None])]
    calls = spark.createDataFrame(rows, CALLS).repartition(4)
    found = {r.call_id: r for r in tool_calls.link_calls(calls, spark.createDataFrame([], RESULTS), SCHEMA).collect()}
    for k, errors in enumerate([*CASES.values(), "$: not a JSON object"]):
        r = found[f"c{k}"]
        assert (r.errors, r.valid) == (errors, not errors), rows[k][4] and rows[k][4][:40]
        assert json.loads(r.line)["id"] == f"c{k}"


def brute_levels(calls):
    """Levels of (conv, call, needs) by looking at all calls until nothing changes."""
    level, change = {}, True
    while change:
        change = False
        for conv, call, needs in calls:
            if (conv, call) not in level and all((conv, n) in level for n in needs):
                level[conv, call] = max((level[conv, n] + 1 for n in needs), default=0)
                change = True
    return level


@pytest.mark.parametrize("most", [1 << 17, 30, 0])
def test_whole_rows_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(tool_calls, "MOST_ROWS", most)
    rng = random.Random(most)
    calls, results = [], []
    for conv in (1, 2, None):
        for k in range(14):
            needs = rng.sample([f"c{j}" for j in range(k)], min(k, rng.randrange(4))) + ["gone"] * (k == 5)
            needs = needs + ["c13"] * (k == 11 and conv == 2)   # with c13 needing c11 or not: maybe a circle
            text = rng.choice(['{"a":"t"}', '{"a":5}', "none"])
            calls.append((conv, f"c{k}", k, rng.choice(["tool", "other"]), text, needs))
            if rng.random() < 0.6:
                results.append((conv, f"c{k}", k, f"result {k}"))
        results.append((conv, "orphan", 99, None))
    own = {(c, i) for c, i, *_ in calls}
    kept = [(c, i, [n for n in needs if (c, n) in own]) for c, i, _, _, _, needs in calls]
    level = brute_levels(kept)
    content = {(c, i): x for c, i, _, x in results}
    want = []
    for c, i, position, name, text, needs in calls:
        unknown = sorted(n for n in set(needs) if (c, n) not in own)
        valid, errors, line = tool_calls.call_line(i, name, text, content.get((c, i)), needs, unknown, SCHEMA)
        status = "circular" if (c, i) not in level else "linked" if (c, i) in content else "no_result"
        want.append((c, i, level.get((c, i)), position, 1, status, valid, errors, line))
    want += [(c, "orphan", None, None, 0, "orphan", None, "", '{"id":"orphan","result":null}') for c in (1, 2, None)]
    found = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMA)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_a_conversation_where_every_call_waits_for_a_circle(spark):
    needs = [(c, a, b) for c in (1, None) for a, b in ("ab", "ba", "da", "db")] + [(2, "d", "a"), (2, "d", "b"), (2, "e", "f"), (2, "e", "g")]
    needs += [(2, "f", "g"), (2, "g", "f")]
    nodes = {(c, x) for c, a, b in needs for x in (a, b)}
    got = tool_calls.levels(spark.createDataFrame(list(nodes), "conv_id long, call_id string"),
                            spark.createDataFrame(needs, "conv_id long, call_id string, need string"))
    assert sorted(map(tuple, got.collect())) == [(2, "a", 0), (2, "b", 0), (2, "d", 1)]


def test_a_deep_graph_takes_few_rounds(spark, monkeypatch):
    """1,000 calls, each with two needs behind it: levels 0 to 999."""
    written = []
    real = tool_calls.stash
    monkeypatch.setattr(tool_calls, "stash", lambda df, *a: written.append(1) or real(df, *a))
    needs = [(1, f"c{k}", f"c{j}") for k in range(1, 1000) for j in {k - 1, max(0, k - 2)}]
    nodes = spark.createDataFrame([(1, f"c{k}") for k in range(1000)], "conv_id long, call_id string")
    got = tool_calls.levels(nodes, spark.createDataFrame(needs, "conv_id long, call_id string, need string"))
    assert {r.call_id: r.level for r in got.collect()} == {f"c{k}": k for k in range(1000)}
    assert len(written) < 12


@pytest.mark.parametrize("text", [
    "a" * 1_000_000 + " see x://y", "eyJ" * 300_000 + " .eyJ.", "eyJ" * 300_000 + ".eyJ" + "eyJ" * 1000, "a" * 1_000_000,
    "x://" * 200_000 + "eyJ.eyJ", "password" + " " * 500_000 + "token" * 100_000, "eyJa." * 150_000, "a://b:" * 100_000])
def test_a_megabyte_of_one_kind_takes_seconds(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    secret_scan.digest(secret_scan.scan(docs)).collect()
    assert time.time() - began < 60


def test_guards_change_no_match(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["eyJ", "a", "eyJa", ".", ".eyJb", "-", " ", "eyJeyJ", "x://", "u:p@", "://", "q", ":", "@", "é"])
                     for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts.append("xeyJa.eyJb.cZ http://u:p@hftp://v:w@x")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: [(s.start, s.rule, s.end) for s in r.spans] for r in secret_scan.scan(docs).collect()}
    assert sum(map(len, rows.values())) > 50
    for i, t in enumerate(texts):
        assert rows[i] == secret_scan.brute_force(t), t


def test_rules_may_hold_any_character(spark):
    rule = secret_scan.Rule("smile", "\U0001f600+key[0-9]+", 0, 6)
    docs = spark.createDataFrame([(1, "a \U0001f600\U0001f600key12345 b")], "doc_id long, text string")
    spans = secret_scan.scan(docs, (*secret_scan.BASE, rule)).first().spans
    assert [(s.start, s.rule, s.end) for s in spans] == [(2, 3, 12)]
