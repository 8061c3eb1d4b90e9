"""Chat formatting: linking tool calls with their results, in order, as canonical JSON.

Calls and results of a conversation meet in a hash join by conversation and identifier. A call may name the calls
that it comes after. Its depth is the length of the longest chain of calls before it: pointer jumping takes every
run of calls with one predecessor each in about log2(length) joins, and calls with several predecessors are settled
in rounds, as many as such calls follow on each other. Within a conversation calls are numbered by depth, then by a
hash of the identifier (`position`), a total order that respects every link; numbers come from cells of about
CELL_ROWS calls, so a conversation with a third of all rows is never one task's work. Arguments are validated
against JSON schemas, and each row becomes one canonical JSON line (sorted keys, no spaces, UTF-8).

Defined cases: a call without a result and a result without a call each keep a row, with `state` missing or orphan.
Of call rows, or result rows, that repeat an identifier in a conversation the smallest by content is linked (ties:
equal rows, either); the others keep rows of their own with state repeat. A call in a cycle, or after one, has state
cycle and neither depth nor position; a predecessor that does not exist is none. A null identifier links with
nothing; rows of null conversation are one conversation. Null arguments fail the schema. Arguments that are no JSON,
hold NaN or an infinity, have numbers beyond a double, or nest too deeply to be read stay a string in the line and
are reported; lone surrogates stay escaped; of a name that an object repeats the last value counts. A schema with keywords that are not checked
is refused before anything runs. Empty and very long texts are kept whole. Empty tables give no rows.
Further columns of either table, whatever their names, are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import stage

TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}
CELL_ROWS = SHARE_ROWS = 1_000
HOT_KEYS = 100_000
_SURROGATE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; whole-numbered floats as integers; no NaN; lone surrogates escaped."""

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    line = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", line)


def _refuse(constant: str):
    raise ValueError(constant)


def _finite(digits: str) -> float:
    number = float(digits)
    return number if math.isfinite(number) else _refuse(digits)


def read_json(text: str):
    """The value of a JSON text; ValueError for anything else, also for NaN, infinities and numbers beyond a double."""
    return json.loads(text, parse_constant=_refuse, parse_float=_finite)


#: Keywords that are checked, those that only describe, and the kinds of their values.
CHECKED = {
    "type": (str, list), "enum": list, "const": object, "minLength": int, "maxLength": int, "pattern": str, "minimum": (int, float), "maximum": (int, float),
    "exclusiveMinimum": (int, float), "exclusiveMaximum": (int, float), "multipleOf": (int, float), "items": (dict, bool), "minItems": int, "maxItems": int, "uniqueItems": bool,
    "properties": dict, "required": list, "additionalProperties": (dict, bool), "minProperties": int, "maxProperties": int, "allOf": list, "anyOf": list, "oneOf": list, "not": (dict, bool),
}
DESCRIBING = frozenset("title description default examples $schema $id $comment deprecated readOnly writeOnly format".split())


def checked_schema(schema, at: str = "#") -> None:
    """ValueError for a schema with keywords, types or patterns that are not checked: a schema that looks stricter than it is, is refused."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: not a schema")
    for word, value in schema.items():
        if word in DESCRIBING:
            continue
        if word not in CHECKED:
            raise ValueError(f"{at}: {word} is not checked")
        if not isinstance(value, CHECKED[word]) or isinstance(value, bool) and CHECKED[word] not in (bool, object, (dict, bool)):
            raise ValueError(f"{at}: {word} cannot be {value!r}")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in (*TYPES, "number", "integer"):
            raise ValueError(f"{at}: there is no type {kind!r}")
    if schema.get("multipleOf", 1) <= 0:
        raise ValueError(f"{at}: multipleOf must be above 0")
    try:
        re.compile(schema.get("pattern", ""))
    except re.error as e:
        raise ValueError(f"{at}: pattern: {e}") from e
    for word in ("items", "additionalProperties", "not"):
        checked_schema(schema.get(word, True), f"{at}/{word}")
    for word in ("allOf", "anyOf", "oneOf"):
        for i, part in enumerate(schema.get(word, [])):
            checked_schema(part, f"{at}/{word}/{i}")
    for name, part in schema.get("properties", {}).items():
        checked_schema(part, f"{at}/properties/{name}")


def same(a, b) -> bool:
    """Equal as JSON: a number equals a number of its value, true and false are no numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, TYPES[kind])


def violations(value, schema, at: str = "$") -> list[str]:
    """What breaks a checked schema; the keywords are CHECKED, with the meaning of the published draft of 2020, patterns as Python's."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    found: list[str] = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_is(value, k) for k in kinds):
            return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        found.append(f"{at}: not in enum")
    if "const" in schema and not same(value, schema["const"]):
        found.append(f"{at}: not the constant")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            found.append(f"{at}: length {len(value)}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: not of the pattern")
    elif _is(value, "number"):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            found.append(f"{at}: out of range")
        elif value <= schema.get("exclusiveMinimum", -math.inf) or value >= schema.get("exclusiveMaximum", math.inf):
            found.append(f"{at}: out of range")
        if "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            found.append(f"{at}: not a multiple")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", math.inf):
            found.append(f"{at}: {len(value)} items")
        if schema.get("uniqueItems") and len({canonical([x]) for x in value}) < len(value):
            found.append(f"{at}: repeated items")
        for i, x in enumerate(value if "items" in schema else ()):
            found += violations(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, dict):
        if len(value) < schema.get("minProperties", 0) or len(value) > schema.get("maxProperties", math.inf):
            found.append(f"{at}: {len(value)} properties")
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            found += violations(value[k], known[k] if k in known else other, f"{at}.{k}")
    for part in schema.get("allOf", []):
        found += violations(value, part, at)
    if "anyOf" in schema and all(violations(value, part, at) for part in schema["anyOf"]):
        found.append(f"{at}: none of the choices")
    if "oneOf" in schema and sum(not violations(value, part, at) for part in schema["oneOf"]) != 1:
        found.append(f"{at}: not exactly one of the choices")
    if "not" in schema and not violations(value, schema["not"], at):
        found.append(f"{at}: what it must not be")
    return found


def depths(calls: DataFrame) -> DataFrame:
    """(key, depth) for calls (key, before array<string>), one row a key: the longest chain of calls before each; null in and after a cycle."""
    nodes = calls.select("key")
    links = calls.select("key", F.explode(F.array_distinct("before")).alias("p")).join(nodes.select(F.col("key").alias("p")), "p", "left_semi")
    links = stage(links.select("key", "p"), "links")
    counted = nodes.join(links.groupBy("key").agg(F.count("*").alias("n"), F.min("p").alias("p")), "key", "left")
    single = F.col("n") == 1
    # open: the run has not reached its top yet, a call with no or with several predecessors.
    one = F.coalesce(single, F.lit(False))
    now = stage(
        counted.select(
            "key", F.when(one, F.col("p")).otherwise(F.col("key")).alias("top"), one.cast("long").alias("steps"), one.alias("open"),
            F.coalesce("n", F.lit(0)).alias("n"),
        ),
        "runs",
    )
    for _ in range(max(1, int(now.count()).bit_length()) + 1):
        if now.filter("open").isEmpty():
            break
        ahead = now.select(F.col("key").alias("top"), F.col("top").alias("further"), F.col("steps").alias("more"), F.col("open").alias("still"))
        moved = now.filter("open").join(ahead, "top").select(
            "key", F.col("further").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"), "n",
        )
        now = stage(now.filter("not open").unionByName(moved), "runs")
    ended = now.filter("not open")
    settled = ended.filter("n = 0").select("key", F.lit(0).cast("long").alias("depth"))
    if not now.filter("n > 1").isEmpty():
        settled = _settle(settled, links, now, ended)
    found = ended.select("key", "top", "steps").join(settled.select(F.col("key").alias("top"), "depth"), "top")
    return nodes.join(found.select("key", (F.col("depth") + F.col("steps")).alias("depth")), "key", "left")


def _settle(settled: DataFrame, links: DataFrame, now: DataFrame, ended: DataFrame) -> DataFrame:
    """settled (key, depth) with the calls of several predecessors, each once the tops of all its predecessors are settled."""
    several = now.filter("n > 1").select("key", "n")
    waiting = links.join(several, "key").join(ended.select(F.col("key").alias("p"), "top", "steps"), "p")
    waiting = stage(waiting.select("key", "n", "top", "steps"), "waiting")
    settled = stage(settled, "settled")
    while True:
        met = waiting.join(settled.select(F.col("key").alias("top"), "depth"), "top")
        ready = met.groupBy("key").agg(F.count("*").alias("got"), F.first("n").alias("n"), (F.max(F.col("depth") + F.col("steps")) + 1).alias("depth"))
        ready = stage(ready.filter("got = n").select("key", "depth"), "ready")
        if ready.isEmpty():
            return settled
        settled = stage(settled.unionByName(ready), "settled")
        waiting = stage(waiting.join(ready.select("key"), "key", "left_anti"), "waiting")


def _numbered(placed: DataFrame, cell_rows: int) -> DataFrame:
    """(key, position) for (key, conv, depth): by depth, then by the key's hash, gapless from 0 in each conversation."""
    rows = placed.filter("depth is not null").select("key", "conv", "depth", F.xxhash64("key").alias("salt"))
    sizes = rows.groupBy("conv", "depth").agg(F.ceil(F.count("*") / cell_rows).cast("long").alias("cells"))
    celled = rows.join(sizes, ["conv", "depth"]).withColumn("cell", F.pmod("salt", F.col("cells")))
    before = Window.partitionBy("conv").orderBy("depth", "cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = celled.groupBy("conv", "depth", "cell").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("conv", "depth", "cell").orderBy("salt", "key")
    ranked = celled.withColumn("r", F.row_number().over(within) - 1).join(counts.drop("count"), ["conv", "depth", "cell"])
    return ranked.select("key", (F.col("before") + F.col("r")).alias("position"))


def _once(rows: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """The smallest row of each key by its values, and the rows beside it (as often as they are there).

    A key of many different rows is dealt in shares of SHARE_ROWS or more; such keys are at most HOT_KEYS, which
    bounds what is broadcast.
    """
    known = stage(rows.filter("key is not null").groupBy("key", *values).agg(F.count("*").alias("times")), "rows")
    best = stage(known.groupBy("key").agg(F.min(F.struct(*values)).alias("best"), F.count("*").alias("n"), F.sum("times").alias("total")), "best")
    chosen = best.select("key", *[F.col(f"best.{v}").alias(v) for v in values])
    repeated = best.filter("total > 1").select("key", "best", "n")
    if repeated.isEmpty():
        return chosen, known.limit(0).select("key", *values)
    share = max(SHARE_ROWS, -(-known.count() // HOT_KEYS))
    shares = F.ceil(F.col("n") / share).cast("int")
    hot = repeated.filter(F.col("n") > share).select("key", shares.alias("shares"))
    dealt = known.join(F.broadcast(hot), "key", "left").withColumn("share", F.pmod(F.xxhash64(*values), F.coalesce("shares", F.lit(1))))
    heads = repeated.select("key", "best", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    others = dealt.join(heads, ["key", "share"]).withColumn("times", F.col("times") - F.struct(*values).eqNullSafe(F.col("best")).cast("int"))
    return chosen, others.filter("times > 0").select("key", *values, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).drop("nth")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows for calls (conversation, id, after, name, arguments) and results (conversation, id, content).

    after: an identifier or an array of them. Returns conversation, id, depth, position, name, state (linked,
    missing, orphan, cycle, repeat), valid, problems, line.
    """
    for name, schema in schemas.items():
        checked_schema(schema, name)
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conversation").cast("string")), F.lit("n"))
    key = lambda i: F.concat(F.length("conv").cast("string"), F.lit(":"), F.col("conv"), i)  # noqa: E731  null for a null identifier
    listed = F.col("after") if calls.schema["after"].dataType.simpleString().startswith("array") else F.array(F.col("after").cast("string"))
    after = F.array_sort(F.array_distinct(F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    kind = calls.schema["conversation"].dataType.simpleString()
    asked = calls.select(
        "conversation", conv.alias("conv"), F.col("id").cast("string").alias("id"), after.alias("after"), "name", "arguments",
    ).withColumn("key", key(F.col("id")))
    answers = results.select(
        F.col("conversation").cast(kind).alias("conversation"), conv.alias("conv"), F.col("id").cast("string").alias("id"), "content",
    ).withColumn("key", key(F.col("id")))
    asked, answers = stage(asked, "calls"), stage(answers, "results")

    call, more_calls = _once(asked, ["conversation", "conv", "id", "after", "name", "arguments"])
    answer, more_answers = _once(answers, ["conversation", "conv", "id", "content"])
    call = stage(call, "call")
    before = call.select("key", F.transform("after", lambda x: F.concat(F.length("conv").cast("string"), F.lit(":"), F.col("conv"), x)).alias("before"))
    placed = stage(call.select("key", "conv").join(depths(before), "key"), "placed")
    order = placed.select("key", "depth").join(_numbered(placed, cell_rows), "key", "left")
    joined = call.withColumn("is_call", F.lit(True)).join(order, "key")
    other = answer.select("key", F.col("conversation").alias("of"), F.col("id").alias("answers"), "content", F.lit(True).alias("is_result"))
    linked = joined.join(other.hint("shuffle_hash"), "key", "full")
    state = F.when(F.col("is_call").isNull(), "orphan").when(F.col("depth").isNull(), "cycle").when(F.col("is_result").isNull(), "missing").otherwise("linked")
    rows = linked.select(
        F.when(
            F.col("is_call"), F.col("conversation"),
        ).otherwise(F.col("of")).alias("conversation"), F.coalesce("id", "answers").alias("id"), "depth", "position", "name", state.alias("state"), "after", "arguments", "content",
        F.coalesce("is_call", F.lit(False)).alias("is_call"),
    )
    none = {"depth": "long", "position": "long", "name": "string", "after": "array<string>", "arguments": "string", "content": "string"}

    def apart(part: DataFrame, state: str, is_call: bool) -> DataFrame:
        return part.select(
            "conversation", "id", *[F.col(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()],
            F.lit(state).alias("state"), F.lit(is_call).alias("is_call"),
        )

    rows = rows.unionByName(apart(more_calls, "repeat", True)).unionByName(apart(more_answers, "repeat", False))
    rows = rows.unionByName(apart(asked.filter("id is null"), "missing", True)).unionByName(apart(answers.filter("id is null"), "orphan", False))
    rows = rows.select("conversation", "id", "depth", "position", "name", "state", "after", "arguments", "content", "is_call")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [formatted(r, schemas) for r in batch.to_pylist()]
            columns = [pa.array([m[0] for m in made], pa.bool_()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(6)), *columns],
                names=["conversation", "id", "depth", "position", "name", "state", "valid", "problems", "line"],
            )

    return rows.mapInArrow(run, f"conversation {kind}, id string, depth long, position long, name string, state string, valid boolean, problems string, line string")


def formatted(r: dict, schemas: dict[str, dict]) -> tuple[bool, str, str]:
    """Whether a row is valid, what is wrong with it, and its canonical line."""
    shown = raw = r["arguments"]
    wrong = []
    try:
        if raw is not None:
            shown = read_json(raw)
            canonical(shown)  # a value that can be read may still be too deep to write
        if r["is_call"]:
            wrong = violations(shown, schemas[r["name"]]) if r["name"] in schemas else ["unknown tool"]
    except RecursionError:
        shown, wrong = raw, ["nested too deeply"]
    except ValueError:
        shown, wrong = raw, ["not JSON"]
    if r["state"] == "orphan":
        wrong = ["no call"]
    elif r["state"] == "repeat":
        wrong.append("repeated identifier")
    body = {
        "id": r["id"], "depth": r["depth"], "position": r["position"], "state": r["state"], "after": r["after"],
        "call": {"name": r["name"], "arguments": shown} if r["is_call"] else None, "result": r["content"],
    }
    return not wrong, "; ".join(wrong), canonical(body)


#: What the turns of a conversation table call: users ask, system turns configure, assistants answer.
SCHEMAS = {
    "ask": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    },
    "configure": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}},
}


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table (conv_id, turn, role, text) without tool identifiers.

    A user or system turn t is a call named by conversation and turn, after the call two turns before (or one,
    for a turn that follows a system turn); an assistant turn answers the turn before it.
    """
    name = lambda turn: F.concat_ws("-", F.concat(F.lit("c"), F.col("conv_id").cast("string")), turn.cast("string"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    own = F.when(whole, name(F.col("turn")))
    calls = messages.filter(F.col("role").isin("user", "system") | F.col("role").isNull())
    starts = messages.filter("role = 'system'").select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t")).distinct()
    calls = calls.join(starts, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    before = F.col("turn") - F.when(F.col("t").isNotNull(), 1).otherwise(2)
    calls = calls.select(
        F.col("conv_id").alias("conversation"), own.alias("id"), F.when(whole & (before >= 0), name(before)).alias("after"),
        F.when(F.col("role") == "system", "configure").otherwise("ask").alias("name"), F.to_json(
            F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn"))
        ).alias("arguments"),
    )
    answers = messages.filter(~F.col("role").isin("user", "system")).select(
        F.col("conv_id").alias("conversation"), F.when(whole, name(F.col("turn") - 1)).alias("id"), F.col("text").alias("content"),
    )
    return calls, answers


def format_conversations(messages: DataFrame) -> DataFrame:
    calls, answers = conversation_calls(messages.select("conv_id", "turn", "role", "text"))
    return link_tool_calls(calls, answers, SCHEMAS)
