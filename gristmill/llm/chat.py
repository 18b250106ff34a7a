"""Chat formatting with tool calls linked to their results, in DataFrame functions alone.

1. Calls are the elements of a message's ``tool_calls``; the first call of an identifier in a
   conversation (by turn, then place) is the one that results of that identifier answer.  Both
   meet in a hash join on conversation and identifier.
2. Messages are put in topological order: by turn, but a result never before its call and a call
   never before calls that it ``needs``.  A message's place is the largest of its own turn and
   its predecessors' places, found by relaxation; without references against the order of turns
   no round is needed.
3. Arguments are checked against the tool's schema, and every message becomes one line of JSON
   with sorted keys and without blanks; the arguments within are canonical too.

One row comes out for each message, so a conversation of any length is no cell and no task.

Defined results: null and empty texts are empty contents; a result without a call is ``orphan``;
calls that repeat an identifier stay in their message, and results answer the first; messages of
a cycle, and those behind more than ``ROUNDS / 2`` references against the order of turns, keep
their own turn and are ``unordered``; ties of a turn are ordered by role, identifier and content;
messages without conversation form one conversation, those without a turn come first; repeated
rows are numbered each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.frames import lookup_join
from gristmill.llm.shared import saved

#: Rounds of relaxation; what still moves in the second half of them is taken for a cycle.
ROUNDS = 32
#: Turns that are numbered together.
SPAN = 1024
TYPES = {
    "string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL).*",
    "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID",
}
#: tool -> argument -> (type, required)
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, as an array of texts; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    whole = F.schema_of_variant(parsed)
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        found = []
        for field, (kind, required) in fields.items():
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            missing = F.lit(f"{field} is missing") if required else F.lit(None).cast("string")
            found.append(F.when(value.isNull(), missing).when(
                ~value.rlike(f"^{TYPES[kind]}$"), F.lit(f"{field} is no {kind}")))
        known = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
        extra = F.transform(
            F.array_sort(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), known)),
            lambda k: F.concat(k, F.lit(" is not known")))
        errors = F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), extra)
        errors = F.when(whole.isNull(), F.array(F.lit("no JSON"))).when(
            ~whole.startswith("OBJECT"), F.array(F.lit("no object"))).otherwise(errors)
        out = F.when(name == tool, errors).otherwise(out)
    return out


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys and without blanks; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(arguments)), arguments)


def _placed(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """``key, place``: of messages that references put later than their turn; null if there is no such place."""
    backward = edges.where("before_turn >= turn")
    if not backward.head(1):
        return messages.select("key", F.struct("turn", F.lit(0).alias("depth")).alias("place")).limit(0)
    own = edges.select(F.col("key"), F.col("turn")).union(edges.select("before_key", "before_turn")).distinct()
    places = saved(own.select("key", F.struct("turn", F.lit(0).alias("depth")).alias("place")))
    links = edges.select("key", "before_key").distinct()
    halfway = places
    for turn in range(ROUNDS):
        pushed = (
            links.join(places.withColumnRenamed("key", "before_key"), "before_key").groupBy("key")
            .agg(F.max(F.struct(F.col("place.turn").alias("turn"), (F.col("place.depth") + 1).alias("depth"))).alias("p")))
        step = places.join(pushed, "key", "left").select(
            "key", F.greatest("place", "p").alias("place"), (F.col("p") > F.col("place")).alias("moved"))
        step = saved(step.withColumn("moved", F.coalesce("moved", F.lit(False))))
        places = step.select("key", "place")
        if not step.where("moved").head(1):
            return places
        if turn == ROUNDS // 2:
            halfway = places
    old = halfway.withColumnRenamed("place", "old")
    return places.join(old, "key").select("key", F.when(F.col("place") == F.col("old"), F.col("place")).alias("place"))


def format_chats(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """``conv_id, turn, position, role, status, errors, message`` of every message.

    ``messages``: conv_id, turn, role, text, tool_calls (array of id, name, arguments, needs) and
    tool_call_id.
    """
    rows = messages.select(
        F.coalesce("conv_id", F.lit(-(2**63))).alias("conv"), F.coalesce("turn", F.lit(-(2**63))).alias("turn"),
        F.col("role"), F.coalesce("text", F.lit("")).alias("text"), "tool_calls", "tool_call_id", "conv_id",
        F.col("turn").alias("given_turn"))
    # Messages that agree in all of this are interchangeable.
    rows = saved(rows.withColumn("key", F.xxhash64("conv", "turn", "role", "text", "tool_call_id", "tool_calls")))
    listed = rows.select("conv", "turn", "key", F.posexplode("tool_calls").alias("at", "call"))
    calls = listed.where("call.id is not null").groupBy("conv", F.col("call.id").alias("id")).agg(
        F.min(F.struct("turn", "at", "key")).alias("first"))
    calls = saved(calls.select("conv", "id", F.col("first.turn").alias("before_turn"), F.col("first.key").alias("before_key")))
    results = rows.where("tool_call_id is not null").select("conv", "turn", "key", F.col("tool_call_id").alias("id"))
    linked = lookup_join(results, calls, ["conv", "id"], "left")
    needed = listed.select("conv", "turn", "key", F.explode("call.needs").alias("id"))
    columns = ["key", "turn", "before_key", "before_turn"]
    edges = linked.where("before_key is not null").select(*columns).union(
        lookup_join(needed, calls, ["conv", "id"], "inner").select(*columns))
    places = _placed(rows, saved(edges.where("key <> before_key")))
    # A message's calls, and how many of them have results.
    answered = lookup_join(
        listed.select("conv", "key", F.col("call.id").alias("id")),
        results.select("conv", "id").distinct().withColumn("has", F.lit(1)), ["conv", "id"], "left",
    ).groupBy("key").agg(F.min(F.coalesce("has", F.lit(0))).alias("answered"))
    orphans = linked.groupBy("key").agg(F.max(F.col("before_key").isNull()).alias("orphan"))
    # Each of these has one row per message key.
    joined = rows
    for side in (answered, orphans, places.withColumn("placed", F.lit(True))):
        joined = lookup_join(joined, side, ["key"], "left")
    unordered = F.coalesce(F.col("placed") & F.col("place").isNull(), F.lit(False))
    errors = F.flatten(F.transform("tool_calls", lambda c: F.transform(
        argument_errors(c["name"], c["arguments"], schemas), lambda e: F.concat_ws(": ", c["id"], e))))
    calls_out = F.transform("tool_calls", lambda c: F.struct(
        canonical(c["arguments"]).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    line = F.to_json(F.struct(
        F.col("text").alias("content"), F.col("role"), F.col("tool_call_id"),
        F.when(F.size("tool_calls") > 0, calls_out).alias("tool_calls")))
    status = (
        F.when(unordered, "unordered").when(F.col("tool_call_id").isNotNull(), F.when(F.col("orphan"), "orphan")
                                            .otherwise("linked"))
        .when(F.size("tool_calls") > 0, F.when(F.col("answered") == 1, "answered").otherwise("open"))
        .otherwise("plain"))
    place = F.coalesce("place", F.struct("turn", F.lit(0).alias("depth")))
    lines = saved(joined.select(
        "conv", "conv_id", F.col("given_turn").alias("turn"), F.col("role"), status.alias("status"),
        F.array_join(F.coalesce(errors, F.array().cast("array<string>")), "; ").alias("errors"),
        line.alias("message"), place.alias("place"), F.col("turn").alias("own"),
        F.floor(place["turn"] / SPAN).alias("span")))
    # Spans of turns are numbered for themselves, so that a long conversation is many tasks.
    sizes = lines.groupBy("conv", "span").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("conv", "span", (F.sum("n").over(W.partitionBy("conv").orderBy("span")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("conv", "span").orderBy("place", "own", "role", "message"))
    numbered = lines.withColumn("inside", inside).join(before, ["conv", "span"])
    return numbered.select(
        "conv_id", "turn", (F.col("before") + F.col("inside") - 1).cast("long").alias("position"),
        "role", "status", "errors", "message")


def example_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as tool chats: an assistant's turn calls a tool, the user's next turn is its result.

    Every part comes from the row: the tool from the text's length, the arguments from its first
    word and its length.  In some turns an argument has the wrong type or is missing, every eighth
    third turn needs the call two turns before, and results of turn 1 come before their calls.
    """
    call = lambda turn: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), turn)
    calls_here = F.col("role") == "assistant"
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "^[a-zA-Z]+", 0)
    size = F.length(F.coalesce("text", F.lit("")))
    topic = F.concat(F.lit('"topic" : "'), word, F.lit('"'))
    length = F.concat(F.lit('"length": '), F.when(F.col("turn") == 5, F.concat(F.lit('"'), size, F.lit('"')))
                      .otherwise(size.cast("string")))
    arguments = F.when(F.col("turn") == 7, F.concat(F.lit("{"), topic, F.lit("}"))).otherwise(
        F.concat(F.lit("{ "), topic, F.lit(", "), length, F.lit(" }")))
    needs = F.when(F.col("turn") == 3, F.array(call(F.lit("1")))).otherwise(F.array().cast("array<string>"))
    return conversations.select(
        "conv_id",
        # The result of the second turn is moved before its call; ordering brings it back.
        F.when((F.col("role") == "user") & (F.col("turn") == 2), F.lit(0)).otherwise(F.col("turn")).cast("long").alias("turn"),
        F.when((F.col("role") == "user") & (F.col("turn") > 0), F.lit("tool")).otherwise(F.col("role")).alias("role"),
        "text",
        F.when(calls_here, F.array(F.struct(
            call(F.col("turn")).alias("id"), F.when(size > 500, "summarise").otherwise("look_up").alias("name"),
            arguments.alias("arguments"), needs.alias("needs")))).alias("tool_calls"),
        F.when((F.col("role") == "user") & (F.col("turn") > 0), call(F.col("turn") - 1)).alias("tool_call_id"))


EXAMPLE_SCHEMAS: Schemas = {
    "look_up": {"topic": ("string", True), "length": ("integer", True)},
    "summarise": {"topic": ("string", True), "length": ("integer", False)},
}
