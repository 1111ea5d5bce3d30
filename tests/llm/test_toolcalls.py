import json
import math
import random
from collections import defaultdict

import pytest

from podia.llm import toolcalls as tc

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "number", "minimum": 0}, "b": {}}, "additionalProperties": False}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": "add", "arguments": a} for i, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_violations():
    s = {"type": "object", "properties": {"x": {"type": "array", "items": {"type": "string", "pattern": "^a", "maxLength": 2}}, "y": {"enum": [1, 2]}}, "required": ["y"]}
    assert tc.violations({"x": ["a", "ab"], "y": 1}, s) == []
    assert tc.violations({"x": ["b", "abc", 3]}, s) == ["$.y: missing", "$.x[0]: no match", "$.x[1]: too long", "$.x[2]: not of type string"]
    assert tc.violations(True, {"type": "integer"}) and not tc.violations(2.0, {"type": "integer"})


def test_canonical():
    assert tc.canonical({"b": [1.0, 1.5, None], "a": {"ü": True}}) == '{"a":{"ü":true},"b":[1,1.5,null]}'


def test_links(spark):
    rows = [
        (1, 0, call(("x", {"a": 1}), ("y", {"a": -1, "b": {"$call": "x"}}))),
        (1, 1, result("y", "late")),
        (1, 2, result("x", {"k": [2.0]})),
        (1, 3, result("x", "again")),
        (1, 4, call(("x", {"a": 9}))),
        (1, 5, call(("z", "not json"))),
        (1, 5, result("nobody", 1)),
        (2, 0, result("x", 0)),
        (2, 1, call(("x", {"a": 1, "b": {"$call": "gone"}, "c": 1}))),
        (None, 0, call(("n", {"a": 1}))),
        (None, 1, result("n", None)),
        (3, 0, "plain text"),
        (3, 1, None),
        (3, 2, "{broken"),
        (4, 0, call(("p", {"a": 1, "b": {"$call": "q"}}), ("q", {"a": 1, "b": {"$call": "p"}}), ("r", {"a": 1}))),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, text string, call_id string")
    got = {(r.conv_id, r.call_id): r for r in tc.link(df, SCHEMAS).collect()}
    assert set(got) == {(1, "x"), (1, "y"), (1, "z"), (1, "nobody"), (2, "x"), (None, "n"), (4, "p"), (4, "q"), (4, "r")}
    x, y = got[1, "x"], got[1, "y"]
    assert (x.status, x.call_turn, x.result_turn, x.n_calls, x.n_results, x.level) == ("linked", 0, 2, 2, 2, 0)
    assert x.record == '{"arguments":{"a":1},"id":"x","name":"add","result":{"k":[2]}}'
    assert (y.level, y.violations, y.dangling) == (1, ["$.a: too small"], [])
    assert got[1, "z"].status == "no result" and got[1, "z"].violations == ["$: not JSON"]
    assert got[1, "nobody"].status == "no call" and got[1, "nobody"].call_turn is None
    assert got[2, "x"].status == "early" and got[2, "x"].dangling == ["gone"] and got[2, "x"].violations == ["$.c: not allowed"]
    assert got[None, "n"].status == "linked"
    assert got[4, "p"].level is None and got[4, "q"].level is None and got[4, "r"].level == 0
    assert tc.link(df.limit(0), SCHEMAS).count() == 0


def test_deep_order_within_a_message(spark):
    ids = list(range(12))
    random.Random(1).shuffle(ids)
    message = call(*[(f"c{i}", {"a": 1, "b": {"$call": f"c{i - 1}"} if i else None}) for i in ids])
    df = spark.createDataFrame([(1, 0, message)], "conv_id long, turn long, text string")
    assert {r.call_id: r.level for r in tc.link(df, SCHEMAS).collect()} == {f"c{i}": i for i in range(12)}


def test_plain_conversations(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", 'say "hi"\n'), (1, 2, "assistant", "hi"), (1, 3, "user", ""), (2, 0, "assistant", "?"), (2, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in tc.link(tc.as_calls(df), tc.DIALOGUE).collect()}
    assert got[1, "c1"].status == "linked" and json.loads(got[1, "c1"].record)["arguments"]["text"] == 'say "hi"\n'
    assert got[1, "c3"].status == "no result" and got[1, "c3"].violations == ["$.text: too short"] and got[1, "c3"].dangling == []
    assert got[2, "c-1"].status == "no call" and got[2, "c1"].violations == ["$.text: missing"]


def test_awkward_messages(spark):
    deep = "[" * 5000 + "]" * 5000
    nested = '{"a":' * 700 + "1" + "}" * 700
    texts = [
        '{"tool_calls": [{"id": "nan", "name": "add", "arguments": "NaN"}, {"id": "big", "name": "add", "arguments": "{\\"a\\": 1e999}"}]}',
        '{"tool_calls": [{"id": "x", "name": "add", "arguments": {"a": 1e999}}]}',
        '{"tool_calls": [{"id": "half \\ud800", "name": "\\udfff", "arguments": {"\\ud800": {"$call": "\\udc00"}}}]}',
        '{"tool_calls": [{"id": "deep", "name": "add", "arguments": ' + deep + "}]}",
        '{"tool_call_id": "nested", "content": ' + nested + "}",
        '{"tool_calls": [7, {"id": 3}, {"id": "none", "name": null}, {"id": "text", "name": "add", "arguments": "{"}]}',
        '{"tool_calls": 7, "tool_call_id": null}',
        "[]",
        " ",
        None,
    ]
    df = spark.createDataFrame([(None if i % 2 else 1, i, t) for i, t in enumerate(texts)] * 2, "conv_id long, turn long, text string")
    got = {r.call_id: r for r in tc.link(df, SCHEMAS).collect()}
    assert got["nan"].violations == got["text"].violations == ["$: not JSON"]
    assert got["big"].violations == got["x"].violations == ["$.a: beyond a double"]
    assert got["none"].violations == ["$: no such tool"] and got["none"].n_calls == 2
    half = got["half \\ud800"]
    assert half.dangling == ["\\udc00"] and '"\\ud800":' in half.record
    assert got["deep"].violations == ["$: not of type object"] and got["deep"].record.startswith('{"arguments":' + deep)
    assert got["nested"].record.endswith(f',"name":null,"result":{nested}}}')
    for r in got.values():
        tc.parsed(r.record)


def test_deep_texts_read_like_json():
    rng = random.Random(4)

    def value(depth):
        kind = rng.randint(0, 5 if depth else 3)
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind == 5:
            return {rng.choice(["a", "b", "é\n", '"', "$call"]): value(depth - 1) for _ in range(rng.randint(0, 3))}
        return rng.choice([None, True, False, 0, -3, 1.5, 2e10, "", "x\\y", "é\u2028", '"'])

    def outcome(read, text):
        try:
            return read(text)
        except ValueError:
            return "no JSON"

    for _ in range(3000):
        v = value(4)
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert tc._deep(text) == v
        assert json.loads(tc.canonical(v)) == v
        at = rng.randrange(len(text))
        broken = text[:at] + rng.choice(["", ",", "]", "}", ":", '"', "1", " ", "[", "tru"]) + text[at + rng.randint(0, 1) :]
        assert outcome(tc._deep, broken) == outcome(json.loads, broken), broken
    assert tc.canonical({"b": [], "a": {}}) == '{"a":{},"b":[]}'


def test_messages_with_line_breaks_stay_as_they_are(spark):
    text = '{\n  "tool_calls": [\n    {"id": "a", "name": "f", "arguments": {}}\n  ]\n}'
    rows = [("k", 0, "user", "hello"), ("k", 1, "assistant", text)]
    got = tc.as_calls(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    assert text in {r.text for r in got}


def brute_links(rows):
    """{(conv, id): (call_turn, result_turn, status, n_calls, n_results, level, dangling, violations, record)} by plain loops."""
    first = lambda found: min(found, key=lambda x: (math.inf if x[0] is None else x[0], x[1]))
    calls, results = defaultdict(list), defaultdict(list)
    for conv, turn, text in rows:
        for pos, (kind, i, name, body, wrong, refs) in enumerate(tc.events(text, SCHEMAS)):
            (calls if kind == "call" else results)[conv, i].append((turn, pos, name, body, wrong, refs))
    calls, results = ({k: (first(v), len(v)) for k, v in x.items()} for x in (calls, results))
    at = lambda turn: math.inf if turn is None else turn

    def level(conv, i, above=()):
        if i in above:
            return None
        turn, *_, refs = calls[conv, i][0]
        deeper = [level(conv, r, (*above, i)) for r in refs if (conv, r) in calls and at(calls[conv, r][0][0]) == at(turn)]
        return None if None in deeper else max((d + 1 for d in deeper), default=0)

    out = {}
    for conv, i in calls.keys() | results.keys():
        (c, n), (r, k) = calls.get((conv, i), (None, 0)), results.get((conv, i), (None, 0))
        status = "no call" if c is None else "no result" if r is None else "early" if (at(r[0]), r[1]) < (at(c[0]), c[1]) else "linked"
        dangling = sorted(x for x in c[5] if (conv, x) not in calls or at(calls[conv, x][0][0]) > at(c[0])) if c else []
        record = {"arguments": c and json.loads(c[3]), "id": i, "name": c and c[2], "result": r and json.loads(r[3])}
        out[conv, i] = (c and c[0], r and r[0], status, n, k, level(conv, i) if c else None, dangling, c[4] if c else [], tc.canonical(record))
    return out


def test_links_match_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for conv in [None, *range(40)]:
        ids = [f"c{i}" for i in range(rng.randint(1, 5))]
        for turn in [*range(rng.randint(0, 8)), None]:
            kind = rng.random()
            if kind < 0.5:
                text = call(*[(i, {"a": rng.randint(-1, 3), "b": {"$call": rng.choice([*ids, "gone"])}} if rng.random() < 0.7 else rng.choice(["{", '{"a": 2}', 3])) for i in rng.sample(ids, rng.randint(1, len(ids)))])
            else:
                text = result(rng.choice([*ids, "nobody"]), rng.choice([None, 1.0, "x", {"k": [turn]}])) if kind < 0.9 else rng.choice(["words", None, ""])
            rows.append((conv, turn, text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)
    got = {(r.conv_id, r.call_id): (r.call_turn, r.result_turn, r.status, r.n_calls, r.n_results, r.level, r.dangling, r.violations, r.record) for r in tc.link(df, SCHEMAS).collect()}
    want = brute_links(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_huge_numbers_lose_no_call(spark):
    digits = "9" * 5000
    text = '{"tool_calls": [{"id": "a", "name": "t", "arguments": {"x": 1e400, "y": -2E999, "n": %s}}, {"id": "b", "name": "t", "arguments": "{\\"x\\": 2}"}]}' % digits
    schemas = {"t": {"properties": {"x": {"type": "number", "maximum": 10}, "y": {"minimum": 0}, "n": {"type": "integer"}}}}
    rows = [(1, 1, text), (1, 2, '{"tool_call_id": "b", "content": 1E400}'), (2, 1, '{"tool_calls": [{"id": "c", "arguments": NaN}]}')]
    got = {r.call_id: r for r in tc.link(spark.createDataFrame(rows, "conv_id long, turn long, text string"), schemas).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].violations == ["$.x: too large", "$.x: beyond a double", "$.y: too small", "$.y: beyond a double", "$.n: beyond a double"]
    assert got["a"].record.startswith('{"arguments":{"n":' + digits + ',"x":1e400,"y":-2E999}')
    assert got["b"].violations == [] and got["b"].record.endswith('"result":1E400}')


def test_turns_without_a_number_are_calls(spark):
    rows = [(1, None, "user", "a"), (1, None, "user", "b"), (1, None, "assistant", "c"), (1, 1, None, "x"), (1, 2, "user", None)]
    calls = tc.as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.call_id: r for r in tc.link(calls, tc.DIALOGUE).collect()}
    assert set(got) == {"cnull", "c2"}
    assert (got["cnull"].n_calls, got["cnull"].n_results, got["cnull"].status) == (2, 1, "linked")
    assert "$.text: missing" in got["c2"].violations


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"const": 1}, [1, 1.0], [True, "1", 2]), ({"enum": [1, None]}, [1, None], [True, False, 0]), ({"multipleOf": 0.1}, [0.3, 2], [0.35]), ({"uniqueItems": True}, [[1, True], []], [[1, 1.0]]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2, "x"], [1, 3]), ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 6], [4]), ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, [0, 4], [2]),
        ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, [2], [0, 4]), ({"not": {"type": "null"}}, [0], [None]), ({"minItems": 1, "maxItems": 2}, [[1]], [[], [1, 2, 3]]),
        ({"additionalProperties": {"type": "integer"}}, [{"a": 1}], [{"a": "b"}]), ({"properties": {"a": False}}, [{}], [{"a": 1}]), ({"minProperties": 1}, [{"a": 1}], [{}]),
    ],
)
def test_schema_keywords(schema, good, bad):
    tc.known_schema(schema)
    assert all(tc.violations(v, schema) == [] for v in good)
    assert all(tc.violations(v, schema) for v in bad)


@pytest.mark.parametrize("schema", [{"if": {}}, {"type": "text"}, {"properties": {"a": {"dependentRequired": {}}}}, {"anyOf": [{"$ref": "#"}]}, 3])
def test_unknown_keywords_are_refused(spark, schema):
    with pytest.raises(ValueError, match="unknown|no schema"):
        tc.link(spark.createDataFrame([], "conv_id long, turn long, text string"), {"t": schema})
