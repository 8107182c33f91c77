"""Chat formatting: tool calls linked to their results, put in order, checked against schemas, written canonically.

Calls and results meet in a hash join on their conversation and identifier. A call may name calls of its conversation that
must come before it. Its place is the largest turn among itself and all it depends on, directly or not, and among equals
the number of dependencies that lead up to it; both are found by rounds of joins over the calls whose place still changes,
which are none if every call already stands after those it depends on. Calls that depend on themselves, directly or not,
are marked, as are calls between two groups of such; their dependencies on each other don't count for the order. Arguments
are checked against the JSON schema of the tool, and every call with its first result becomes one canonical JSON object:
sorted keys, no white space. Results without a call, and further results of a call, are rows of their own.

Nulls and empties: a null identifier is linked with nothing and left out; a null conversation is one of its own; null or
unreadable arguments are an error of the call, a null result is a result. Calls that repeat an identifier within their
conversation are one, the one with the smallest turn and content, with their number, as are equal results; so an
identifier that holds a large part of all rows is summed up before it is joined.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow, dropped, written

# The schema of a plain exchange, in which a user's turn asks the assistant for a reply.
REPLY = {
    "reply": {
        "type": "object", "required": ["text"], "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1}, "after": {"type": "array", "items": {"type": "string"}}},
    }
}

_KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int,
}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema``: type, enum, bounds, required and further properties, items."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        fits = any(isinstance(value, _KINDS[k]) and (not isinstance(value, bool) or k == "boolean") for k in kinds)
        if not fits:
            return [f"{at}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{at}: too large")
    elif isinstance(value, list) and "items" in schema:
        out += [p for i, x in enumerate(value) for p in problems(x, schema["items"], f"{at}[{i}]")]
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        out += [p for k in sorted(value) if k in known for p in problems(value[k], known[k], f"{at}.{k}")]
    return out


def calls_of(messages: DataFrame) -> DataFrame:
    """Calls of a table of messages (conv_id, turn, role, text): every user turn asks for a reply.

    Identifiers are conversation and turn. A call depends on the exchange before it.
    """
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    before = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    asked = messages.where("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    return asked.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"),
                        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("arguments"), before.alias("after"))


def results_of(messages: DataFrame) -> DataFrame:
    """Results of a table of messages: an assistant's turn answers the turn before it.

    One that follows no user's turn is a result without a call.
    """
    asked = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    spoken = messages.where("role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    return spoken.select("conv_id", asked.alias("call_id"), "turn", F.coalesce("text", F.lit("")).alias("content"))


def _knots(edges: DataFrame, late: DataFrame) -> DataFrame | None:
    """Edges on cycles, or between two, among the calls ``late``: what is left when loose ends are taken off in rounds."""
    now = written(edges.join(late, "call_id", "left_semi").join(late.select(F.col("call_id").alias("needs")), "needs", "left_semi").select("call_id", "needs"), "call-knots")
    n = now.count()
    while n:
        asked, asking = now.select(F.col("call_id").alias("needs")).distinct(), now.select(F.col("needs").alias("call_id")).distinct()
        left = written(now.join(asked, "needs", "left_semi").join(asking, "call_id", "left_semi").select("call_id", "needs"), "call-knots")
        dropped(now)
        now, before, n = left, n, left.count()
        if n == before:
            return now
    dropped(now)
    return None


def _places(edges: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Places after all rounds and None; or, if some calls depend on themselves, any places and the edges between those.

    A round hands every place on to the calls that depend on it; only late ones change anything. Without a cycle the
    rounds end by themselves; cycles are looked for after 1, 2, 4, ... rounds among the calls that were late so far.
    """
    late_so_far, rounds = None, 0
    while True:
        needed = now.select(F.col("call_id").alias("needs"), F.col("order_turn").alias("t"), F.col("order_step").alias("s"))
        late = edges.join(needed, "needs").join(now, "call_id").where("t > order_turn OR (t = order_turn AND s >= order_step)")
        late = late.groupBy("call_id").agg(F.max(F.struct("t", "s")).alias("last"))
        changed = written(late.select("call_id", F.col("last.t").alias("t"), (F.col("last.s") + 1).alias("s")), "call-late")
        if changed.isEmpty():
            return now, None
        rounds += 1
        ids = changed.select("call_id")
        late_so_far = written(ids if late_so_far is None else late_so_far.union(ids).distinct(), "call-late-so-far")
        if rounds & (rounds - 1) == 0 and (knots := _knots(edges, late_so_far)) is not None:
            return now, knots
        step = now.join(changed, "call_id", "left").select(
            "call_id", F.coalesce("t", "order_turn").alias("order_turn"),
            F.when(F.col("t").isNotNull(), F.col("s")).otherwise(F.col("order_step")).alias("order_step"),
        )
        step = written(step, "call-order")
        if rounds > 1:  # the first places are the caller's
            dropped(now)
        dropped(changed)
        now = step


def _order(calls: DataFrame) -> DataFrame:
    """``call_id``, ``order_turn``, ``order_step``, ``cyclic`` of calls (call_id, turn, after)."""
    edges = written(
        calls.select("call_id", F.explode("after").alias("needs")).distinct().join(calls.select(F.col("call_id").alias("needs")), "needs", "left_semi"),
        "call-edges",
    )
    start = written(calls.select("call_id", F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_step")), "call-order")
    cyclic = start.select("call_id").limit(0)
    while True:
        now, knots = _places(edges, start)
        if knots is None:
            break
        cyclic = cyclic.union(knots.select("call_id"))
        edges = written(edges.join(knots, ["call_id", "needs"], "left_anti"), "call-edges")
    marked = cyclic.distinct().select("call_id", F.lit(True).alias("cyclic"))
    return now.join(marked, "call_id", "left").select("call_id", "order_turn", "order_step", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


_COLUMNS = (
    "kind string, conv_id long, call_id string, turn long, n_copies long, n_results long, linked boolean, n_missing long, order_turn long, "
    "order_step long, cyclic boolean, valid boolean, errors string, record string"
)
_PLAIN = [c.split()[0] for c in _COLUMNS.split(", ")][:-3]


def _formatted(schemas: dict):
    """Checks and records of calls and results; a result's row has the errors that are known of it."""

    def of(r: dict) -> tuple[list[str], dict]:
        if r["kind"] != "call":
            return [r["kind"].replace("_", " ")], {"id": r["call_id"], "result": r["content"]}
        try:
            arguments = json.loads(r["arguments"])
            schema = schemas.get(r["name"])
            found = ["no such tool"] if schema is None else problems(arguments, schema)
        except (TypeError, ValueError):
            arguments, found = r["arguments"], ["arguments are no JSON"]
        return found, {"id": r["call_id"], "name": r["name"], "arguments": arguments, "after": r["after"], "result": r["content"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [of(r) for r in batch.to_pylist()]
            ends = [pa.array([not e for e, _ in done], pa.bool_()), pa.array(["; ".join(e) for e, _ in done], pa.string()),
                    pa.array([canonical(r) for _, r in done], pa.string())]
            plain = [batch.column(batch.schema.get_field_index(k)) for k in _PLAIN]
            yield pa.RecordBatch.from_arrays([*plain, *ends], [*_PLAIN, "valid", "errors", "record"])

    return run


def _key(call_id: Column) -> Column:
    """What a call is known by: its conversation and its identifier."""
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("/"), call_id)


def _further(each: DataFrame, first: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the results that no call carries: those besides a call's first, and all of identifiers without a call."""
    carried = first.join(known, "key", "left_semi").select("key", F.col("r.turn").alias("t"), F.col("r.content").alias("c"))
    rest = each.join(carried, (each["key"] == carried["key"]) & each["turn"].eqNullSafe(F.col("t")) & each["content"].eqNullSafe(F.col("c")), "left_anti")
    rest = rest.join(known.withColumn("known", F.lit(True)), "key", "left")
    linked_, zero = F.coalesce("known", F.lit(False)), F.lit(0).cast("long")
    return rest.select(
        F.when(linked_, "further_result").otherwise("result_without_call").alias("kind"), "conv_id", "call_id", "turn", "n_copies", zero.alias("n_results"),
        linked_.alias("linked"), zero.alias("n_missing"), F.col("turn").alias("order_turn"), zero.alias("order_step"), F.lit(False).alias("cyclic"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("array<string>").alias("after"), "content",
    )


def linked(calls: DataFrame, results: DataFrame, schemas: dict = REPLY) -> DataFrame:
    """One row per call and per result that no call carries, told apart by ``kind``.

    A ``call`` has its place, its first result, the number of different results, what is wrong with its arguments, and its
    record; a ``further_result`` or ``result_without_call`` stands at its own turn and is not valid.
    ``calls`` (conv_id, call_id, turn, name, arguments, after) and ``results`` (conv_id, call_id, turn, content).
    """
    keyed = calls.where("call_id IS NOT NULL").select("conv_id", "call_id", "turn", "name", "arguments", F.coalesce("after", F.array()).alias("after"))
    once = keyed.withColumn("key", _key(F.col("call_id"))).groupBy("key", "conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.count(F.lit(1)).alias("n_copies")
    )
    once = written(once.select("key", "conv_id", "call_id", "c.turn", "c.name", "c.arguments", "c.after", "n_copies"), "calls")
    each = results.where("call_id IS NOT NULL").select("conv_id", "call_id", "turn", "content", _key(F.col("call_id")).alias("key"))
    each = each.groupBy("key", "conv_id", "call_id", "turn", "content").agg(F.count(F.lit(1)).alias("n_copies"))
    first = each.groupBy("key").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    answer = first.select("key", "r.content", "n_results")
    # The keys of what a call names, in its own conversation.
    graph = once.select(F.col("key").alias("call_id"), "turn", F.transform("after", _key).alias("after"))
    known = once.select("key")
    missing = graph.select("call_id", F.explode("after").alias("needs")).join(known.withColumnRenamed("key", "needs"), "needs", "left_anti")
    missing = missing.groupBy(F.col("call_id").alias("key")).agg(F.count(F.lit(1)).alias("n_missing"))
    order = _order(graph).withColumnRenamed("call_id", "key")
    joined = once.join(answer, "key", "left").join(missing, "key", "left").join(order, "key")
    ready = joined.select(
        F.lit("call").alias("kind"), "conv_id", "call_id", "turn", "n_copies", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.col("n_results").isNotNull().alias("linked"), F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"),
        "order_turn", "order_step", "cyclic", "name", "arguments", "after", "content",
    )
    return arrow(ready.unionByName(_further(each, first, known)), _formatted(schemas), _COLUMNS)
