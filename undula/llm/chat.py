"""Chat formatting with tool calls linked to their results.

Assistant messages may carry calls, tool messages results, as JSON objects in the text:

    {"content": ..., "tool_calls": [{"id": ..., "name": ..., "arguments": {...}}]}
    {"tool_call_id": ..., "content": ...}

System and developer messages may declare the tools of their conversation:

    {"tools": [{"name": ..., "parameters": {JSON schema}}]}

Calls and results are hash-joined by (conversation, id). A call may name results it
needs ("after": [ids]); messages are ordered so that no result comes before its call
and no call before what it needs, otherwise by turn. Arguments are validated against
schemas, and every message becomes one line of canonical JSON: keys sorted, no blanks,
equal values written alike. Other keys of a message or a call are carried along as they
are; a call without an id or a name is written as given and reported.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.llm import scratch

#: Turns of a conversation whose links one task follows in a round; no bound on chains, which go on in the next round.
BLOCK = 4096

#: Messages of 256 turns beyond which they are placed by several tasks.
LARGE_BLOCK = 100_000

_PARSED = "conv_id long, turn long, role string, content string, calls array<struct<id:string,name:string,arguments:string,after:array<string>,written:string>>, result_of string, problem string, rest string, tools array<struct<name:string,parameters:string>>"


def canonical(value: Any) -> str:
    """One spelling for equal JSON values; whole floats are written as integers."""

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            if x != x or x in (float("inf"), float("-inf")):
                raise ValueError("JSON has no such number")
            return int(x) if x == int(x) and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks a JSON schema (type, enum, const, properties, required,
    additionalProperties, items, minimum, maximum, minLength, maxLength, minItems, maxItems)."""

    def is_a(kind: str) -> bool:
        if kind in ("number", "integer"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
        return kind in _KINDS and isinstance(value, _KINDS[kind])

    found = []
    if kinds := schema.get("type"):
        if not any(map(is_a, [kinds] if isinstance(kinds, str) else kinds)):
            return [f"{at}: not of type {kinds}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not among the values allowed")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        found.append(f"{at}: not the constant")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        rest = schema.get("additionalProperties", True)
        for k in sorted(value):
            if k in own:
                found += violations(value[k], own[k], f"{at}.{k}")
            elif rest is False:
                found.append(f"{at}.{k}: not allowed")
            elif isinstance(rest, dict):
                found += violations(value[k], rest, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
    for name, size, wrong in (
        ("minimum", value if numeric else None, lambda a, b: a < b),
        ("maximum", value if numeric else None, lambda a, b: a > b),
        ("minLength", len(value) if isinstance(value, str) else None, lambda a, b: a < b),
        ("maxLength", len(value) if isinstance(value, str) else None, lambda a, b: a > b),
        ("minItems", len(value) if isinstance(value, list) else None, lambda a, b: a < b),
        ("maxItems", len(value) if isinstance(value, list) else None, lambda a, b: a > b),
    ):
        if name in schema and size is not None and wrong(size, schema[name]):
            found.append(f"{at}: {name} is {schema[name]}")
    return found


def _parse(role: str | None, text: str | None) -> tuple[str | None, list[dict], str | None, str | None, str | None]:
    """(content, calls, id of the call this is the result of, problem, other keys as JSON)."""
    if role not in ("assistant", "tool") or not text or not text.lstrip().startswith("{"):
        return text, [], None, "a result without an id" if role == "tool" else None, None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return text, [], None, "a result without an id" if role == "tool" else None, None
    if role == "tool":
        if not isinstance(value.get("tool_call_id"), str):
            return text, [], None, "a result without an id", None
        content = value.get("content")
        rest, problem = _rest(role, value, ("content", "tool_call_id"))
        return content if isinstance(content, str) else _safe(content), [], value["tool_call_id"], problem, rest
    given = value.get("tool_calls")
    if not isinstance(given, list):
        return text, [], None, None, None
    rest, problem = _rest(role, value, ("content", "tool_calls") if given else ("content",))
    calls = []
    for raw in given:
        call = raw
        if isinstance(call, dict) and isinstance(call.get("function"), dict):  # the nested spelling
            call = {k: v for k, v in call.items() if k != "function"} | call["function"]
        if not (isinstance(call, dict) and isinstance(call.get("id"), str) and isinstance(call.get("name"), str)):
            problem = "a call without an id or a name"
            calls.append({"id": None, "name": None, "arguments": None, "after": [], "written": _plain(raw)})
            continue
        arguments = call.get("arguments", {})
        if isinstance(arguments, str):
            try:
                arguments = json.loads(arguments)
            except (ValueError, RecursionError):
                problem = "arguments that aren't JSON"
        after = [x for x in call.get("after", []) if isinstance(x, str)] if isinstance(call.get("after", []), list) else []
        written = call | {"arguments": json.loads(_safe(arguments))}
        if call is not raw and any(k in raw and _plain(raw[k]) != _plain(v) for k, v in raw["function"].items()):
            problem, written = "a call that gives a key twice", raw
        calls.append({"id": call["id"], "name": call["name"], "arguments": _safe(arguments), "after": after, "written": _plain(written)})
    content = value.get("content")
    return content if content is None or isinstance(content, str) else _safe(content), calls, None, problem, rest


def _tools(role: str | None, text: str | None) -> list[dict]:
    """The tools that a message declares: names, and schemas of their arguments as JSON."""
    if role not in ("system", "developer") or not text or not text.lstrip().startswith("{"):
        return []
    try:
        given = json.loads(text).get("tools")
    except (ValueError, RecursionError):
        return []
    found = []
    for tool in given if isinstance(given, list) else []:
        if isinstance(tool, dict) and isinstance(tool.get("function"), dict):  # the nested spelling
            tool = tool | tool["function"]
        if isinstance(tool, dict) and isinstance(tool.get("name"), str):
            found.append({"name": tool["name"], "parameters": _safe(tool.get("parameters", tool.get("input_schema", {})))})
    return found


def _rest(role: str, value: dict, known: tuple[str, ...]) -> tuple[str | None, str | None]:
    """(the keys of a message that have no column, as JSON; problem)."""
    rest = {k: v for k, v in value.items() if k not in known and (k, v) != ("role", role)}
    if "role" not in rest:
        return _plain(rest) if rest else None, None
    rest["role_in_text"] = rest.pop("role")  # the row's own role holds
    return _plain(rest), "another role in the text"


def _plain(value: Any) -> str:
    """Canonical JSON; of an object, values that JSON can't hold are written as text."""
    return canonical({k: json.loads(_safe(v)) for k, v in value.items()}) if isinstance(value, dict) else _safe(value)


def _safe(value: Any) -> str:
    try:
        return canonical(value)
    except ValueError:
        return json.dumps(str(value))


_CALL = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("after", pa.list_(pa.string())), ("written", pa.string())])
_TOOL = pa.struct([("name", pa.string()), ("parameters", pa.string())])
_PARSED_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_CALL), pa.string(), pa.string(), pa.string(), pa.list_(_TOOL)]


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "turn", "role", "content", "calls", "result_of", "problem", "rest", "tools"]
    for batch in batches:
        rows = [(c, t, r, *_parse(r, x), _tools(r, x)) for c, t, r, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _PARSED_KINDS, strict=True)], names=names)


def _unmet(arguments: Any, schema: Any) -> list[str]:
    try:
        return violations(arguments, schema)
    except (AttributeError, TypeError, ValueError, OverflowError, RecursionError):  # schemas come with the data
        return ["a schema that can't be read"]


def _write(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, problems = [], []
            for row in batch.to_pylist():
                wrong = [row["problem"]] if row["problem"] else []
                message: dict[str, Any] = (json.loads(row["rest"]) if row["rest"] else {}) | {"role": row["role"], "content": row["content"]}
                declared = {t["name"]: json.loads(t["parameters"]) for t in row["declared"] or []}
                if row["calls"]:
                    message["tool_calls"] = []
                    for call in row["calls"]:
                        message["tool_calls"].append(json.loads(call["written"]))
                        if call["id"] is None:
                            continue
                        arguments = json.loads(call["arguments"])
                        if call["name"] in declared:
                            wrong += [f"{call['id']}: {x}" for x in _unmet(arguments, declared[call["name"]])]
                        elif call["name"] in schemas:
                            wrong += [f"{call['id']}: {x}" for x in violations(arguments, schemas[call["name"]])]
                        elif schemas or row["declares"]:
                            wrong.append(f"{call['id']}: no schema for {call['name']}")
                if row["result_of"] is not None:
                    message["tool_call_id"] = row["result_of"]
                    if not row["linked"]:
                        wrong.append(f"{row['result_of']}: a result without a call")
                if row["unanswered"]:
                    wrong += [f"{x}: a call without a result" for x in sorted(row["unanswered"])]
                if row["repeated"]:
                    wrong += [f"{x}: an id used twice" for x in sorted(row["repeated"])]
                if row["cyclic"]:
                    wrong.append("calls that wait for each other")
                lines.append(canonical(message))
                problems.append(wrong)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("conv_id", "turn", "depth", "place")), pa.array(lines, pa.string()), pa.array(problems, pa.list_(pa.string())), pa.array([not p for p in problems])],
                names=["conv_id", "turn", "depth", "place", "message", "problems", "valid"],
            )

    return run


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, sort, depth) of the messages all of whose predecessors are known, or become so in this task."""
    table = pa.Table.from_batches(list(batches), _LINK)
    before, after, turn, sort, depth = (table[x].fill_null(-2).to_numpy() for x in ("before", "next", "turn", "sort", "depth"))
    if not len(after):
        return
    rows, own = np.unique(after, return_inverse=True)
    known = depth >= 0
    sorts, depths = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
    np.maximum.at(sorts, own, turn)
    np.maximum.at(sorts, own[known], sort[known])
    np.maximum.at(depths, own[known], depth[known] + 1)
    waiting = np.bincount(own[~known], minlength=len(rows)).tolist()
    source = np.minimum(np.searchsorted(rows, before), len(rows) - 1)
    inside = np.flatnonzero(~known & (rows[source] == before))
    inside = inside[np.argsort(source[inside], kind="stable")]
    starts = np.searchsorted(source[inside], np.arange(len(rows) + 1)).tolist()
    targets, sorts, depths = own[inside].tolist(), sorts.tolist(), depths.tolist()
    done = [i for i, n in enumerate(waiting) if not n]
    for i in done:  # grows meanwhile
        for j in targets[starts[i] : starts[i + 1]]:
            sorts[j], depths[j], waiting[j] = max(sorts[j], sorts[i]), max(depths[j], depths[i] + 1), waiting[j] - 1
            if not waiting[j]:
                done.append(j)
    yield pa.RecordBatch.from_arrays([pa.array(rows[done]), pa.array([sorts[i] for i in done], pa.int64()), pa.array([depths[i] for i in done], pa.int32())], names=["row", "sort", "depth"])


_LINK = pa.schema([("before", pa.int64()), ("next", pa.int64()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("sort", pa.int64()), ("depth", pa.int32())])


def _declared(parsed: DataFrame, calls: DataFrame) -> DataFrame:
    """(row, declared, declares): the schemas of each message's calls, and if its conversation declares any tool."""
    tools = parsed.where("size(tools) > 0").select("row", "conv_id", "turn", F.posexplode("tools").alias("at", "tool"))
    tools = tools.groupBy("conv_id", F.col("tool.name").alias("name")).agg(F.max_by("tool.parameters", F.struct(F.coalesce("turn", F.lit(-1)), "row", "at")).alias("parameters"))
    tools = scratch.table(tools, "tools")
    own = calls.select("row", "conv_id", "name").distinct().join(tools, ["conv_id", "name"], "left")
    own = own.join(tools.select("conv_id", F.lit(True).alias("declares")).distinct(), "conv_id")
    return own.groupBy("row").agg(F.collect_list(F.when(F.col("parameters").isNotNull(), F.struct("name", "parameters"))).alias("declared"), F.max("declares").alias("declares"))


def link(conversations: DataFrame) -> DataFrame:
    """Parsed messages with their links: linked, unanswered, repeated, cyclic, depth.

    ``depth`` is the length of the longest chain call -> result -> call before a
    message, ``sort`` the latest turn in it. Messages without open predecessors are
    peeled off until none is left: a task follows chains through a block of turns, and
    a round carries them on to other blocks. What is never peeled is on or behind a
    cycle (cyclic). By (sort, depth) every other message follows its chain.
    """
    parsed = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(_parse_batches, _PARSED)
    parsed = scratch.table(parsed.withColumn("row", F.monotonically_increasing_id()), "messages")
    calls = parsed.where("size(calls) > 0").select("row", "conv_id", "turn", F.explode("calls").alias("call")).where("call.id is not null").select("row", "conv_id", "turn", F.col("call.id").alias("id"), F.col("call.after").alias("after"), F.col("call.name").alias("name"))
    if calls.isEmpty():
        calls_state = parsed.where("false").select("row")
        unanswered = repeated = calls_state.withColumn("ids", F.lit(None).cast("array<string>"))
        moved = calls_state.withColumn("sort", F.lit(0).cast("long")).withColumn("depth", F.lit(0)).withColumn("cyclic", F.lit(False))
        linked = calls_state
        declared = calls_state.withColumns({"declared": F.lit(None).cast("array<struct<name:string,parameters:string>>"), "declares": F.lit(None).cast("boolean")})
    else:
        calls = scratch.table(calls, "calls")
        results = parsed.where("result_of is not null").select("row", "conv_id", "turn", F.col("result_of").alias("id"))
        declared = _declared(parsed, calls)
        own = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
        key = ["conv_id", "id"]
        repeated = calls.join(own.where("n > 1"), key).where(F.col("row") != F.col("first.row")).groupBy("row").agg(F.collect_set("id").alias("ids"))
        answered = results.select(*key).distinct()
        unanswered = calls.join(answered, key, "left_anti").groupBy("row").agg(F.collect_set("id").alias("ids"))
        linked = results.join(own, key, "left_semi").select("row")
        # an edge for each message that has to come after another
        first = own.select(*key, F.col("first.row").alias("before"))
        turn = F.coalesce("turn", F.lit(-1)).alias("turn")
        edges = results.join(first, key).select("before", F.col("row").alias("next"), "conv_id", turn)
        needs = calls.select("row", "conv_id", "turn", F.explode("after").alias("id"))
        done = results.groupBy(*key).agg(F.max("row").alias("answer"))
        needs = needs.join(first, key).join(done, key, "left").select(F.coalesce("answer", "before").alias("before"), F.col("row").alias("next"), "conv_id", turn)
        edges = scratch.table(edges.unionByName(needs).where("before <> next").distinct(), "edges")
        followers = edges.select(F.col("next").alias("row")).distinct()
        roots = edges.select(F.col("before").alias("row")).distinct().join(followers, "row", "left_anti")
        turns = parsed.select("row", F.coalesce("turn", F.lit(-1)).alias("sort"))
        known = scratch.table(roots.join(turns, "row").withColumn("depth", F.lit(0)), "order")
        while True:
            waiting = edges.join(known.select(F.col("row").alias("next")), "next", "left_anti")
            waiting = waiting.join(known.withColumnRenamed("row", "before"), "before", "left").select(_LINK.names)
            more = scratch.table(waiting.repartition("conv_id", F.floor(F.col("turn") / BLOCK)).mapInArrow(_peel, "row long, sort long, depth int"), "peeled")
            if more.isEmpty():
                break
            known = scratch.table(known.unionByName(more), "order")
        stuck = followers.join(known, "row", "left_anti").join(turns, "row").withColumn("depth", F.lit(0))
        moved = known.withColumn("cyclic", F.lit(False)).unionByName(stuck.withColumn("cyclic", F.lit(True)))
    out = parsed.join(moved, "row", "left").join(linked.distinct().withColumn("linked", F.lit(True)), "row", "left")
    out = out.join(unanswered.withColumnRenamed("ids", "unanswered"), "row", "left").join(repeated.withColumnRenamed("ids", "repeated"), "row", "left").join(declared, "row", "left")
    return out.withColumns({"sort": F.coalesce("sort", "turn", F.lit(-1)), "depth": F.coalesce("depth", F.lit(0)), "cyclic": F.coalesce("cyclic", F.lit(False)), "linked": F.coalesce("linked", F.lit(False))})


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, place, message (canonical JSON), problems, valid: one row a message.

    ``place`` orders a conversation's messages from 0: a message follows those it
    depends on, otherwise by turn (on and behind a cycle by turn only). A message stays a row of its own, so a conversation
    of any length is formatted by many tasks; places come from counts by blocks of
    turns. Arguments are held against the schema that the conversation declares for the
    tool (the last one, if it declares several), else against ``schemas``: a JSON schema
    for each tool. A call of any other tool is reported where there are schemas or
    declarations, and unchecked where there are neither.

    A null role, text or turn is kept as null (null turns first); text that isn't the
    JSON above is content; an empty table gives no rows; rows that repeat a message
    are messages of their own; other columns are ignored.
    """
    messages = link(conversations)
    messages = messages.withColumn("block", F.floor(F.col("sort") / 256))
    sizes = scratch.table(messages.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")), "blocks")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.select(F.col("conv_id").alias("__conv"), F.col("block").alias("__block"), "first", (F.col("n") > LARGE_BLOCK).alias("large"))
    messages = messages.join(starts, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("block") == F.col("__block"))).drop("__conv", "__block")
    within = Window.partitionBy("conv_id", "block").orderBy("sort", "depth", "turn", "row")
    if sizes.where(F.col("n") > LARGE_BLOCK).isEmpty():
        placed = messages.withColumn("place", F.col("first") + F.row_number().over(within) - 1)
    else:  # turns that repeat or are null: of such a block, the messages of a turn fall into the partitions they were read in
        small = messages.where(~F.col("large")).withColumn("place", F.col("first") + F.row_number().over(within) - 1)
        large = messages.where("large").withColumn("read", F.shiftright("row", 33))
        cell = ["conv_id", "block", "sort", "depth", "turn", "read"]
        counts = scratch.table(large.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")), "cells")
        earlier = Window.partitionBy("conv_id", "block").orderBy(*cell[2:]).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(*(F.col(c).alias(f"__{c}") for c in cell), "earlier")
        same = F.lit(True)
        for c in cell:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        large = large.join(counts, same).drop(*(f"__{c}" for c in cell))
        large = large.withColumn("place", F.col("first") + F.col("earlier") + F.row_number().over(Window.partitionBy(*cell).orderBy("row")) - 1)
        placed = small.unionByName(large.drop("read", "earlier"))
    placed = placed.withColumn("place", F.col("place").cast("long")).drop("first", "large")
    out = placed.mapInArrow(_write(schemas or {}), "conv_id long, turn long, depth int, place long, message string, problems array<string>, valid boolean")
    return out.drop("depth")
