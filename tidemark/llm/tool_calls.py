"""Chat formatting: tool calls linked with their results, ordered, validated and serialised.

Input. ``calls``: conv_id, pos, call_id, name, arguments (JSON text), needs (ids of calls of the conversation whose results it uses).
``results``: conv_id, pos, call_id, content. ``schemas``: name, schema (JSON text; the subset below). Positions are places in time.

Linking. Both sides are reduced to the first row of an identifier before the join (so one identifier that fills a third of a table
is one row per task), then meet in a full outer hash join by (conv_id, call_id). Status: ``linked``, ``no_result``, ``no_call``,
``repeated_call`` or ``repeated_result`` (a later row with a known id), ``no_id``.

Order. A result comes after its call, a call after the results that it needs; otherwise time decides. A row's place is
(``order_pos``, ``order_depth``): the latest position among itself and all it depends on, then how many dependencies lie between. It
is the fixed point of one join per round; rounds are needed only along chains of rows that stand before what they need, not along a
conversation, and nothing is gathered per conversation. On a cycle depths outgrow the number of calls that had to wait: those
that do (on the cycle, or waiting for it) get status ``cycle``, their own position, and their needs are dropped, which breaks it.

Validation. Schemas are joined by name and read once per task. ``errors`` lists the paths that break ``type``, ``required``,
``properties``, ``additionalProperties`` (false), ``enum``, ``minimum``, ``maximum``, ``minLength``, ``maxLength`` or ``items``;
``invalid_json``, ``unknown_tool`` and ``invalid_schema`` (a schema that is no JSON object, or whose rules have values of the wrong
kind) are errors too. A ``type`` that is none of JSON's fits no value.

Canonical JSON. Keys sorted by UTF-16 units, no blanks, shortest numbers (1.0 is 1), only necessary escapes; equal values give equal
bytes. ``message`` is {"arguments", "id", "name", "result"} of a call with its result (null without). A lone surrogate, which UTF-8
cannot hold, stays an escape of four lower-case digits, in messages and in error paths. Of equal keys of an object the last counts.
Integers are exact, of whatever size up to ``MAX_DIGITS`` digits. Beyond what can be stated in these terms, text is ``invalid_json``:
numbers outside the range of doubles (1e400), longer integers, and values nested deeper than ``MAX_DEPTH``.

Defined cases. Null ids link with nothing; null arguments are invalid JSON; a null result is null; null needs are none, unknown ids
in it are ignored, as is an id's own. Of rows with equal position and id the smallest content counts as first. Empty tables give an
empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

MAX_DEPTH = 200
MAX_DIGITS = 4000
_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}
_LONE = re.compile("[\ud800-\udfff]")


def _storable(text: str) -> str:
    """Text with its lone surrogates as escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _number(x: int | float) -> str:
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits = repr(x)
    if "e" in digits:
        head, _, power = digits.partition("e")
        sign, size = power[0] if power[0] in "+-" else "+", power.lstrip("+-").lstrip("0")
        if sign == "-" and int(size) <= 6:
            return f"{x:.{len(head.replace('.', '').lstrip('-')) - 1 + int(size)}f}"
        return f"{head.removesuffix('.0')}e{sign}{size}"
    return digits


def canonical(value) -> str:
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, str):
        return _storable(json.dumps(value, ensure_ascii=False))
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (isinstance(value, int) or value.is_integer())
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, ()))


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """Paths with the rule that they break, in the order of the schema."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}: type"]
    out = []
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{path}: enum")
    if _is(value, "number"):
        out += [f"{path}: {k}" for k, wrong in (("minimum", lambda m: value < m), ("maximum", lambda m: value > m)) if k in schema and wrong(schema[k])]
    if isinstance(value, str):
        out += [f"{path}: {k}" for k, wrong in (("minLength", lambda m: len(value) < m), ("maxLength", lambda m: len(value) > m)) if k in schema and wrong(schema[k])]
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: additionalProperties")
    return out


def _constant(text: str):
    raise ValueError(f"{text} is not JSON")


def _float(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(f"{text} is out of range")
    return x


def _int(text: str) -> int:
    if len(text.lstrip("-")) > MAX_DIGITS:
        raise ValueError("too many digits")
    return int(text)


def _shallow(value) -> bool:
    level = [value]
    for _ in range(MAX_DEPTH + 1):
        level = [x for v in level if isinstance(v, (list, dict)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return True
    return False


def parse(text: str | None):
    """(value, whether it is JSON within the stated bounds)."""
    try:
        value = json.loads(text, parse_constant=_constant, parse_float=_float, parse_int=_int)
    except (TypeError, ValueError, RecursionError):
        return None, False
    return (value, True) if _shallow(value) else (None, False)


def errors_of(value, schema) -> list[str]:
    """``violations`` in a form that can be stored; ``invalid_schema`` where the rules themselves cannot be read."""
    if not isinstance(schema, dict):
        return ["invalid_schema"]
    try:
        return [_storable(e) for e in violations(value, schema)]
    except (TypeError, AttributeError):
        return ["invalid_schema"]


def _first(df: DataFrame, *content: str) -> DataFrame:
    """The first row of each (conv_id, call_id) by position, then content."""
    order = F.struct("pos", *content)
    best = df.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(order).alias("_best"))
    return best.select("conv_id", "call_id", *[F.col(f"_best.{c}").alias(c) for c in ("pos", *content)])


def _later(df: DataFrame, first: DataFrame, status: str) -> DataFrame:
    """Rows of known ids that are not the first, and rows without an id."""
    counted = df.groupBy("conv_id", "call_id", "pos").agg(F.count(F.lit(1)).alias("_n"))
    marks = first.select("conv_id", "call_id", F.col("pos").alias("_first"))
    named = counted.where("call_id is not null").join(marks, [counted.conv_id.eqNullSafe(marks.conv_id), counted.call_id == marks.call_id]).select(
        counted.conv_id, counted.call_id, counted.pos, (F.col("_n") - (counted.pos.eqNullSafe(F.col("_first"))).cast("int")).alias("_n"), F.lit(status).alias("status")
    )
    none = counted.where("call_id is null").select("conv_id", "call_id", "pos", "_n", F.lit("no_id").alias("status"))
    both = named.unionByName(none).where("_n > 0")
    return both.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n", "_again")


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, status, pos, name, arguments, needs, result_pos, content), a row per call, or result without one."""
    one, two = _first(calls, "name", "arguments", "needs"), _first(results, "content")
    right = two.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("pos").alias("result_pos"), "content")
    both = one.join(right.hint("shuffle_hash"), one.conv_id.eqNullSafe(right._conv) & (one.call_id == right._call), "full")
    status = F.when(F.col("_call").isNull(), "no_result").when(F.col("call_id").isNull(), "no_call").otherwise("linked")
    joined = both.select(
        F.coalesce("conv_id", "_conv").alias("conv_id"), F.coalesce("call_id", "_call").alias("call_id"), status.alias("status"),
        "pos", "name", "arguments", "needs", "result_pos", "content",
    )
    odd_calls = _later(calls, one, "repeated_call")
    odd_results = _later(results, two, "repeated_result").withColumnRenamed("pos", "result_pos")
    return joined.unionByName(odd_calls, allowMissingColumns=True).unionByName(odd_results, allowMissingColumns=True)


def ordered(linked: DataFrame) -> DataFrame:
    """``linked`` with order_pos and order_depth; calls on a cycle have status ``cycle``."""
    linked = stored(linked, "tool-linked")
    calls = linked.where("status in ('linked', 'no_result')")
    # what a call waits for: linked calls that it needs; a result waits for its own call, and takes its place in what it passes on
    needs = calls.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("_need")).where("_need is not null and _need != call_id")
    known = linked.where("status = 'linked'").select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_need"), "result_pos")
    edges = needs.join(known, needs.conv_id.eqNullSafe(known._conv) & (needs._need == known._need)).select("conv_id", "call_id", known._need, "result_pos")
    edges = stored(edges, "tool-needs")
    place = calls.select("conv_id", "call_id", "pos", F.struct(F.col("pos").alias("p"), F.lit(0).cast("bigint").alias("d")).alias("place"))
    cyclic = None
    while True:
        place = stored(place, "tool-place")
        # place of the result of a needed call: not before its own position, one step after the call
        from_call = place.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("place").alias("_from"))
        step = F.greatest(
            F.struct(F.col("result_pos").alias("p"), F.lit(0).cast("bigint").alias("d")),
            F.struct(F.col("_from.p").alias("p"), (F.col("_from.d") + 1).alias("d")),
        )
        after = edges.join(from_call, edges.conv_id.eqNullSafe(from_call._conv) & (F.col("_need") == F.col("_call"))).select("conv_id", "call_id", step.alias("s"))
        wait = after.groupBy("conv_id", "call_id").agg(F.max(F.struct(F.col("s.p").alias("p"), (F.col("s.d") + 1).alias("d"))).alias("_wait"))
        moved = place.join(wait.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), "_wait"), place.conv_id.eqNullSafe(F.col("_conv")) & (place.call_id == F.col("_call")), "left")
        moved = moved.select("conv_id", "call_id", "pos", F.col("place").alias("_old"), F.greatest("place", F.coalesce("_wait", "place")).alias("place"))
        moved = stored(moved, "tool-moved")
        changed = moved.where("place > _old")
        if changed.isEmpty():
            break
        # steps lead through different delayed calls of the conversation, unless there is a cycle; a delayed call stays delayed
        late = moved.where("place.p > pos or place.d > 0")
        room = late.groupBy(F.col("conv_id").alias("_conv")).agg((F.count(F.lit(1)) * 2).alias("_room"))
        beyond = changed.join(room, changed.conv_id.eqNullSafe(room._conv)).where(F.col("place.d") > F.col("_room"))
        found = stored(beyond.select("conv_id", "call_id"), "tool-cycle")
        place = moved.select("conv_id", "call_id", "pos", "place")
        if not found.isEmpty():
            cyclic = found if cyclic is None else stored(cyclic.unionByName(found).distinct(), "tool-cycles")
            mark = found.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"))
            edges = stored(edges.join(mark, edges.conv_id.eqNullSafe(F.col("_conv")) & (edges.call_id == F.col("_call")), "left_anti"), "tool-needs")
            place = place.withColumn("place", F.struct(F.col("pos").alias("p"), F.lit(0).cast("bigint").alias("d")))
    named = place.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), "place")
    active = F.col("status").isin("linked", "no_result")
    out = linked.join(named, linked.conv_id.eqNullSafe(F.col("_conv")) & (linked.call_id == F.col("_call")) & active, "left").drop("_conv", "_call")
    if cyclic is None:
        out = out.withColumn("_cyclic", F.lit(False))
    else:
        mark = cyclic.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.lit(True).alias("_cyclic"))
        out = out.join(mark, out.conv_id.eqNullSafe(F.col("_conv")) & (out.call_id == F.col("_call")) & active, "left").drop("_conv", "_call")
    return out.select(
        "conv_id", "call_id", F.when(F.col("_cyclic"), "cycle").otherwise(F.col("status")).alias("status"), "name", "arguments", "needs", "content", "pos", "result_pos",
        F.coalesce(F.col("place.p"), "pos", "result_pos").alias("order_pos"), F.coalesce(F.col("place.d"), F.lit(0).cast("bigint")).alias("order_depth"),
    )


def formatted(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, status, order_pos, order_depth, valid, errors, message) of every call and loose result.

    ``valid``, ``errors`` and ``message`` are null for rows that are no first call of an identifier.
    """
    rows = ordered(link(calls, results))
    tools = schemas.groupBy(F.col("name").alias("_tool")).agg(F.min("schema").alias("_schema"))
    rows = rows.join(tools, rows.name == F.col("_tool"), "left").select(
        "conv_id", "call_id", "status", "order_pos", "order_depth", "name", "arguments", "content", "_schema"
    )
    kept = ["conv_id", "call_id", "status", "order_pos", "order_depth"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", valid boolean, errors array<string>, message string"

    def run(batches):
        read: dict[str, dict] = {}
        for batch in batches:
            n = batch.num_rows
            get = {c: batch.column(c).to_pylist() for c in ("call_id", "status", "name", "arguments", "content", "_schema")}
            valid, errors, messages = [None] * n, [None] * n, [None] * n
            for i in range(n):
                if get["status"][i] not in ("linked", "no_result", "cycle"):
                    continue
                value, good = parse(get["arguments"][i])
                rules = get["_schema"][i]
                if not good:
                    errors[i] = ["invalid_json"]
                elif rules is None:
                    errors[i] = ["unknown_tool"]
                else:
                    if rules not in read:
                        read[rules] = parse(rules)[0]
                    errors[i] = errors_of(value, read[rules])
                valid[i] = not errors[i]
                messages[i] = canonical({"arguments": value, "id": get["call_id"][i], "name": get["name"][i], "result": get["content"][i]})
            arrays = [batch.column(c) for c in kept] + [pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(messages, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "valid", "errors", "message"])

    return rows.mapInArrow(run, schema)
