"""Tool-call linking in conversations: calls meet results by identifier, in dependency order, checked against schemas, as canonical JSON."""

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podia.llm.common import materialise, small_batches

class Huge:
    """A number that no double holds, or of more digits than are worth counting: its text, which comes back as it was."""

    def __init__(self, text: str) -> None:
        self.text = text

    def __eq__(self, other) -> bool:
        return isinstance(other, Huge) and self.text == other.text

    def __hash__(self) -> int:
        return hash(self.text)

    def __lt__(self, other) -> bool:
        return self.text.startswith("-")

    def __gt__(self, other) -> bool:
        return not self.text.startswith("-")

    __le__, __ge__ = __lt__, __gt__


#: Digits up to which an integer is read as one.
MOST_DIGITS = 4000

_KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer() or isinstance(v, Huge) and v.text.lstrip("-").isdigit(),
    "number": lambda v: isinstance(v, int | float | Huge) and not isinstance(v, bool),
}
#: The keywords that are checked, those that hold schemas, and those that say nothing of validity.
_CHECKED = {
    "type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "minItems", "maxItems", "uniqueItems", "required", "minProperties", "maxProperties",
}
_ONE, _MANY, _NAMED = {"items", "not", "additionalProperties"}, {"anyOf", "oneOf", "allOf"}, {"properties"}
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "format", "deprecated", "readOnly", "writeOnly"}


def known_schema(schema, at: str = "$") -> None:
    """ValueError if a schema has keywords or types that violations() doesn't know, so that none is passed over in silence."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: no schema")
    if unknown := sorted(set(schema) - _CHECKED - _ONE - _MANY - _NAMED - _NOTES):
        raise ValueError(f"{at}: unknown keywords {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if wrong := [k for k in ([kinds] if isinstance(kinds, str) else kinds) if k not in _KINDS]:
        raise ValueError(f"{at}: unknown types {wrong}")
    for k in _ONE & set(schema):
        known_schema(schema[k], f"{at}.{k}")
    for k in _MANY & set(schema):
        for i, each in enumerate(schema[k]):
            known_schema(each, f"{at}.{k}[{i}]")
    for k in _NAMED & set(schema):
        for name, each in schema[k].items():
            known_schema(each, f"{at}.{k}.{name}")


def violations(value, schema: dict | bool, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema, of the keywords that known_schema() lets pass; values are equal if their canonical JSON is."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](value) for k in kinds):
        return [f"{at}: not of type {'|'.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not one of the values")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the value")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: no match")
    if _KINDS["number"](value):
        if "minimum" in schema and value < schema["minimum"] or "exclusiveMinimum" in schema and not value > schema["exclusiveMinimum"]:
            out.append(f"{at}: too small")
        if "maximum" in schema and value > schema["maximum"] or "exclusiveMaximum" in schema and not value < schema["exclusiveMaximum"]:
            out.append(f"{at}: too large")
        if isinstance(value, Huge):
            out.append(f"{at}: beyond a double")
        elif "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            out.append(f"{at}: no multiple")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: too few")
        if len(value) > schema.get("maxItems", len(value)):
            out.append(f"{at}: too many")
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            out.append(f"{at}: repeated")
        if "items" in schema:
            for i, v in enumerate(value):
                out += violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            out.append(f"{at}: not so many properties")
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif others is False:
                out.append(f"{at}.{k}: not allowed")
            elif others is not True:
                out += violations(v, others, f"{at}.{k}")
    for each in schema.get("allOf", []):
        out += violations(value, each, at)
    if "anyOf" in schema and all(violations(value, each, at) for each in schema["anyOf"]):
        out.append(f"{at}: none of the schemas")
    if "oneOf" in schema and sum(not violations(value, each, at) for each in schema["oneOf"]) != 1:
        out.append(f"{at}: not one of the schemas alone")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: what must not be")
    return out


def canonical(value) -> str:
    """JSON with keys in order of code points, no white space, and numbers without a needless fraction."""

    out, todo = [], [(value, False)]
    while todo:  # an explicit stack: values nest as deep as they like
        v, done = todo.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict):
            out.append("{")
            todo.append(("}", True))
            for i, k in reversed(list(enumerate(sorted(v)))):
                todo += [(v[k], False), (f"{',' if i else ''}{_scalar(k)}:", True)]
        elif isinstance(v, list):
            out.append("[")
            todo.append(("]", True))
            for i in range(len(v) - 1, -1, -1):
                todo += [(v[i], False), ("," if i else "", True)]
        else:
            out.append(_scalar(v))
    return "".join(out)


def _scalar(v) -> str:
    if isinstance(v, Huge):
        return v.text
    if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53:
        v = int(v)
    return json.dumps(v, ensure_ascii=False, allow_nan=False)


def references(value) -> list[str]:
    """Identifiers that arguments name as {"$call": id}, wherever they stand."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$call"), str):
                out.append(v["$call"])
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return out


def _fraction(number: str) -> "float | Huge":
    return Huge(number) if math.isinf(found := float(number)) else found


def _integer(number: str) -> "int | Huge":
    return int(number) if len(number) <= MOST_DIGITS else Huge(number)


def _no_number(name: str):
    raise ValueError(name)


def _loads(text: str):
    return json.loads(text, parse_float=_fraction, parse_int=_integer, parse_constant=_no_number)


#: Scalars and marks of JSON, each with the white space before it.
_TOKEN = re.compile(r'[ \t\n\r]*("(?:[^"\\\x00-\x1f]|\\.)*"|-?\d[\d.eE+-]*|true|false|null|[\[\]{}:,])')


def _deep(text: str):
    """A text as JSON, by an explicit stack: what json.loads does for texts that nest deeper than Python recurses."""
    stack: list = []  # open containers; of an object with a key that waits for its value, the key after it
    root, at, wanted = None, 0, "value"  # wanted: value, first (value or end), key, first key, colon, more (comma or end), nothing
    for _ in iter(int, 1):
        m = _TOKEN.match(text, at)
        if m is None:
            break
        at, t = m.end(), m[1]
        if t in "{[" and wanted in ("value", "first"):
            stack.append({} if t == "{" else [])
            wanted = "first key" if t == "{" else "first"
            continue
        if t in "}]" and wanted in ("more", "first" if t == "]" else "first key") and stack and isinstance(stack[-1], dict if t == "}" else list):
            value = stack.pop()
        elif t == "," and wanted == "more":
            wanted = "key" if isinstance(stack[-1], dict) else "value"
            continue
        elif t == ":" and wanted == "colon":
            wanted = "value"
            continue
        elif t[0] == '"' and wanted in ("key", "first key"):
            stack.append(_loads(t))
            wanted = "colon"
            continue
        elif wanted in ("value", "first") and t not in "}]:,":
            value = _loads(t)
        else:
            raise ValueError(f"{t} at {at}")
        if not stack:
            root, wanted = value, "nothing"
            break
        if isinstance(stack[-1], str):
            key = stack.pop()
            stack[-1][key] = value
        else:
            stack[-1].append(value)
        wanted = "more"
    if wanted != "nothing" or text[at:].strip(" \t\n\r"):
        raise ValueError(f"no JSON beyond {at}")
    return root


def parsed(text: str):
    """A text as JSON, however deep, numbers of any size as Huge where need be; ValueError if it isn't (NaN is none)."""
    try:
        return _loads(text)
    except RecursionError:
        return _deep(text)


def plain(text: str) -> str:
    r"""A text that UTF-8 can hold: half of a surrogate pair is written \udxxx, as JSON escapes it."""
    return text.encode("utf-8", "backslashreplace").decode()


def events(text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(kind, call id, name, canonical arguments or content, violations, references) of each call or result in a message.

    A message with calls is an object with `tool_calls`, a list of objects with id, name
    and arguments (an object, or one as text); one with a result has
    `tool_call_id` and content. Anything else has no events. Values may nest
    as deep as they like; a number beyond a double keeps its text and is a
    violation. Halves of surrogate pairs are escaped.
    """
    if not text or not text.lstrip().startswith("{"):
        return []
    try:
        return _events(parsed(text), schemas)
    except ValueError:
        return []


def _events(message: dict, schemas: dict[str, dict]) -> list[tuple]:
    out = []
    if isinstance(message.get("tool_calls"), list):
        for call in message["tool_calls"]:
            if not isinstance(call, dict) or not isinstance(call.get("id"), str):
                continue
            name, arguments, wrong = call.get("name"), call.get("arguments"), []
            if isinstance(arguments, str):
                try:
                    arguments = parsed(arguments)
                except ValueError:
                    wrong = ["$: not JSON"]
            if not wrong:
                wrong = violations(arguments, schemas[name]) if isinstance(name, str) and name in schemas else ["$: no such tool"]
            out.append(("call", plain(call["id"]), plain(name) if isinstance(name, str) else None, plain(canonical(arguments)), [plain(w) for w in wrong], sorted({plain(r) for r in references(arguments)})))
    elif isinstance(message.get("tool_call_id"), str):
        out.append(("result", plain(message["tool_call_id"]), None, plain(canonical(message.get("content"))), [], []))
    return out


def message_events(messages: DataFrame, schemas: dict[str, dict], conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, pos, kind, call_id, name, body, violations, refs): one row for each call and result, in no order."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["conv", "turn", "pos", "kind", "call_id", "name", "body", "violations", "refs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, turn, pos, *e) for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for pos, e in enumerate(events(text, schemas))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    small_batches(messages.sparkSession)
    cols = messages.select(F.col(conv_col).cast("long"), F.col(turn_col).cast("long"), F.col(text_col).cast("string"))
    return cols.mapInArrow(run, "conv long, turn long, pos int, kind string, call_id string, name string, body string, violations array<string>, refs array<string>")


def _levels(same_turn: DataFrame) -> DataFrame | None:
    """(conv, call_id, level): how many calls of its own message stand before a call at least; null in a cycle.

    Takes edges (conv, call_id, ref) within a message. Each round settles the
    calls whose references are settled; rounds are as many as the longest chain within a message.
    """
    left = materialise(same_turn.distinct(), "call-edges")
    if left.isEmpty():
        return None
    done, level = None, 0
    while not left.isEmpty():
        waiting = left.select("conv", "call_id").distinct()
        ready = left.select("conv", F.col("ref").alias("call_id")).distinct().join(waiting.withColumnsRenamed({"conv": "c", "call_id": "i"}), F.col("conv").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left_anti")
        ready = materialise(ready, "calls-ready")
        if ready.isEmpty():
            break
        gone = ready.withColumnsRenamed({"conv": "c", "call_id": "i"})
        rest = left.join(gone, F.col("conv").eqNullSafe(F.col("c")) & (F.col("ref") == F.col("i")), "left_anti")
        rest = materialise(rest, "call-edges")
        still = rest.select("conv", "call_id").distinct().withColumnsRenamed({"conv": "c", "call_id": "i"})
        settled = waiting.join(still, F.col("conv").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left_anti").withColumn("level", F.lit(level + 1))
        done = settled if done is None else done.unionByName(settled)
        left, level = rest, level + 1
    cyclic = left.select("conv", "call_id").distinct().withColumn("level", F.lit(None).cast("int"))
    return materialise(cyclic if done is None else done.unionByName(cyclic), "call-levels")


def link(messages: DataFrame, schemas: dict[str, dict], conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row for each identifier of a conversation that a call or a result has.

    Columns: conv_col, call_id, call_turn, level, pos, result_turn, status, n_calls, n_results,
    dangling (references without an earlier call), violations, record (canonical JSON).

    Of calls that share an identifier the first counts, of results too; both
    are found by partial aggregation, so that repeats never meet in pairs, and
    then joined by (conversation, identifier): no conversation is one task's
    work, however long. Turns are in order of time, so (call_turn, level, pos)
    is a topological order: a reference to an earlier turn holds by itself, and
    level orders calls of one message that refer to each other (null: a cycle,
    last). status: linked, no result, no call, or early (the result precedes the call).

    Null or empty texts and texts that are no such message have no events; a
    null conversation or turn is a value like any other, null turns last; an
    empty table gives an empty result; other columns are ignored.
    """
    for schema in schemas.values():
        known_schema(schema)
    every = materialise(message_events(messages, schemas, conv_col, turn_col, text_col), "events")
    when = F.coalesce("turn", F.lit(2**63 - 1))
    first_call = F.min(F.struct(when.alias("at"), "pos", "turn", "name", "body", "violations", "refs")).alias("call")
    first_result = F.min(F.struct(when.alias("at"), "pos", "turn", "body")).alias("result")
    calls = every.filter("kind = 'call'").groupBy("conv", "call_id").agg(first_call, F.count("*").alias("n_calls"))
    calls = materialise(calls, "calls")
    results = every.filter("kind = 'result'").groupBy("conv", "call_id").agg(first_result, F.count("*").alias("n_results"))

    edges = calls.select("conv", "call_id", F.col("call.at").alias("at"), F.explode("call.refs").alias("ref"))
    ends = calls.select(F.col("conv").alias("c"), F.col("call_id").alias("i"), F.col("call.at").alias("ref_at"))
    edges = materialise(edges.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("ref") == F.col("i")), "left"), "references")
    dangling = edges.filter("ref_at is null or ref_at > at").groupBy("conv", "call_id").agg(F.sort_array(F.collect_set("ref")).alias("dangling"))
    levels = _levels(edges.filter("ref_at = at").select("conv", "call_id", "ref"))

    def met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({"conv": "c", "call_id": "i"})
        both = left.join(right, F.col("conv").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), how)
        if how == "full":
            both = both.withColumn("conv", F.when(F.col("call_id").isNull(), F.col("c")).otherwise(F.col("conv"))).withColumn("call_id", F.coalesce("call_id", "i"))
        return both.drop("c", "i")

    out = met(met(calls, dangling, "left"), results, "full")
    if levels is None:
        out = out.withColumn("level", F.when(F.col("call").isNotNull(), F.lit(0)))
    else:
        out = met(out, levels.withColumn("known", F.lit(True)), "left")
        out = out.withColumn("level", F.when(F.col("call").isNotNull() & F.col("known").isNull(), F.lit(0)).otherwise(F.col("level"))).drop("known")
    status = F.when(F.col("call").isNull(), "no call").when(F.col("result").isNull(), "no result").when(F.struct("result.at", "result.pos") < F.struct("call.at", "call.pos"), "early").otherwise("linked")
    # '"text"' out of '{"x":"text"}'
    string = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce("call.body", F.lit("null")), F.lit(',"id":'), string(F.col("call_id")),
        F.lit(',"name":'), string(F.col("call.name")), F.lit(',"result":'), F.coalesce("result.body", F.lit("null")), F.lit("}"),
    )
    none = F.array().cast("array<string>")
    return out.select(
        F.col("conv").alias(conv_col), "call_id", F.col("call.turn").alias("call_turn"), "level", F.col("call.pos").alias("pos"), F.col("result.turn").alias("result_turn"),
        status.alias("status"), F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        F.coalesce("dangling", none).alias("dangling"), F.coalesce("call.violations", none).alias("violations"), record.alias("record"),
    )


#: What the turns of a plain conversation are checked against, as calls of one tool.
DIALOGUE = {
    "answer": {
        "type": "object",
        "required": ["text", "turn"],
        "additionalProperties": False,
        "properties": {
            "text": {"type": "string", "minLength": 1, "maxLength": 4000},
            "turn": {"type": "integer", "minimum": 0},
            "after": {"type": ["object", "null"], "required": ["$call"]},
        },
    }
}


def as_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages with calls: a user's turn calls `answer`, the assistant's next turn is the result.

    A call is named by its turn and refers to the user's turn two before; turns
    without a number share the name cnull, so the first of them counts. A null
    text is an argument that is missing, a null role neither call nor result. Texts
    that are messages with calls or results already stay as they are.
    """
    turn = F.col("turn")
    is_message = F.coalesce(F.col("text"), F.lit("")).rlike(r'(?s)^\s*\{.*"(tool_calls|tool_call_id)"')
    name = lambda t: F.concat(F.lit("c"), F.coalesce(t.cast("string"), F.lit("null")))
    after = F.when(turn >= 2, F.struct(name(turn - 2).alias("$call")))
    call = F.struct(name(turn).alias("id"), F.lit("answer").alias("name"), F.struct(F.col("text"), turn.alias("turn"), after.alias("after")).alias("arguments"))
    user = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    assistant = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    text = F.when(is_message, F.col("text")).when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))
