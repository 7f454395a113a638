"""Chat formatting [native]: tool calls linked to their results.

Items are plain messages, calls and results. Calls and results meet by (conversation, identifier)
in a hash join; the identifier belongs to its first call. A topological order puts each result
right after its call, wherever it stood, and leaves everything else in the order of turns.
Arguments are checked against the tool's schema by expressions over the variant type, and every
item is written as canonical JSON: keys sorted, no blanks.

Cases: a null text is an empty content; a result without a call stays at its own turn and is
``orphan``; a second call with an identifier in use is ``duplicate``, and results go to the first;
several results of one call follow it in the order of their turns; arguments that are no JSON
object, and tools without a schema, are errors in the row, never exceptions; null identifiers link
with nothing; rows that are repeated stay, side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import saved

ITEMS = ("conv_id", "turn", "place", "role", "kind", "call_id", "name", "arguments", "content")
#: Turns of a conversation that are numbered together.
CHUNK = 512


@dataclass(frozen=True)
class Parameter:
    kind: str  # string, integer, number, boolean, array or object
    required: bool = False
    choices: tuple = ()
    least: float | None = None
    most: float | None = None  # of numbers their value, of strings their length

    def fault(self, name: str, v: Column) -> Column:
        """Text of what is wrong with this argument of the variant v, or null."""
        at = F.try_variant_get(v, F.lit(f"$['{name}']"), "variant")
        kind = F.schema_of_variant(at)
        right = {
            "string": kind == "STRING",
            "integer": kind == "BIGINT",
            "number": kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
            "boolean": kind == "BOOLEAN",
            "array": kind.startswith("ARRAY"),
            "object": kind.startswith("OBJECT"),
        }[self.kind]
        missing = F.lit(f"{name} is missing") if self.required else F.lit(None).cast("string")
        out = F.when(at.isNull() | (kind == "VOID"), missing).when(~right, F.lit(f"{name} is no {self.kind}"))
        text = F.try_variant_get(v, F.lit(f"$['{name}']"), "string")
        if self.choices:
            out = out.when(~text.isin(*map(str, self.choices)), F.lit(f"{name} is none of the choices"))
        size = F.length(text) if self.kind == "string" else F.try_variant_get(v, F.lit(f"$['{name}']"), "double")
        if self.least is not None:
            out = out.when(size < self.least, F.lit(f"{name} is below {self.least:g}"))
        if self.most is not None:
            out = out.when(size > self.most, F.lit(f"{name} is above {self.most:g}"))
        return out


@dataclass(frozen=True)
class Tool:
    parameters: dict[str, Parameter] = field(default_factory=dict)
    closed: bool = True  # other arguments than these are errors

    def faults(self, arguments: Column, v: Column) -> Column:
        found = [p.fault(n, v) for n, p in sorted(self.parameters.items())]
        if self.closed:
            strange = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(n) for n in self.parameters]).cast("array<string>")))
            found.append(F.when(F.size(strange) > 0, F.concat(F.lit("unknown: "), F.array_join(strange, ", "))))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def quoted(text: Column) -> Column:
    """A JSON string."""
    inner = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no blanks; null if it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def from_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> items. A text that is a JSON object with ``tool_calls`` (each
    with id and function.name, function.arguments) gives a call for each; one with
    ``tool_call_id`` is a result; anything else is a plain message."""
    call = "struct<id: string, function: struct<name: string, arguments: string>>"
    looks = F.ltrim("text").startswith("{")
    df = messages.select("conv_id", "turn", "role", "text", F.when(looks, F.from_json("text", f"tool_calls array<{call}>, tool_call_id string, content string")).alias("j"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("struct<name: string, arguments: string>").alias("function")))
    is_call, is_result = F.size(F.coalesce("j.tool_calls", F.array().cast(f"array<{call}>"))) > 0, F.col("j.tool_call_id").isNotNull()
    df = df.select("*", F.posexplode(F.when(is_call, F.col("j.tool_calls")).otherwise(none)).alias("place", "c"))
    kind = F.when(is_call, F.lit("call")).when(is_result, F.lit("result")).otherwise(F.lit("message"))
    return df.select(
        "conv_id", "turn", "place", "role", kind.alias("kind"),
        F.when(is_call, F.col("c.id")).when(is_result, F.col("j.tool_call_id")).alias("call_id"),
        F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"),
        F.when(is_call | is_result, F.col("j.content")).otherwise(F.col("text")).alias("content"),
    )


def turns_as_calls(messages: DataFrame, tool: str = "reply") -> DataFrame:
    """Items of a table without tool calls: a user's turn calls a tool with its text, and the
    assistant's next turn is the result. Messages that do hold calls or results keep them."""
    df = from_messages(messages)
    plain = F.col("kind") == "message"
    asks, answers = plain & (F.col("role") == "user"), plain & (F.col("role") == "assistant")
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    arguments = F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("text"), F.col("turn")))
    return df.select(
        "conv_id", "turn", "place", "role",
        F.when(asks, F.lit("call")).when(answers, F.lit("result")).otherwise(F.col("kind")).alias("kind"),
        F.when(asks, ident(F.col("turn"))).when(answers, ident(F.col("turn") - 1)).otherwise(F.col("call_id")).alias("call_id"),
        F.when(asks, F.lit(tool)).otherwise(F.col("name")).alias("name"),
        F.when(asks, arguments).otherwise(F.col("arguments")).alias("arguments"),
        F.when(asks, F.lit(None).cast("string")).otherwise(F.col("content")).alias("content"),
    )


def link(items: DataFrame, tools: dict[str, Tool]) -> DataFrame:
    """Items with state (ok, duplicate, orphan, unanswered), call_turn, errors, position and json.

    The join's small side holds a row for each identifier, from a partial aggregate, so an
    identifier that many rows share is one row there; both sides are read from files, which lets
    the join split a partition that is large on the other side. Positions are ranks within blocks
    of CHUNK turns plus the sizes of the blocks before, so no task numbers a whole conversation."""
    items = saved(items.select(*ITEMS), "items")
    keyed = items.filter(F.col("call_id").isNotNull() & (F.col("kind") != "message"))
    is_call = F.col("kind") == "call"
    first = F.min(F.when(is_call, F.struct("turn", "place")))
    links = keyed.groupBy("conv_id", "call_id").agg(first.alias("first"), F.count_if(F.col("kind") == "result").alias("n_results"))
    links = saved(links.select(F.col("conv_id").alias("__conv"), F.col("call_id").alias("__id"), "first", "n_results"), "links")
    # a hash join by name, whatever the sizes: the table held is a partition's share of the identifiers
    df = items.join(links.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("call_id") == F.col("__id")), "left").drop("__conv", "__id")
    is_result = F.col("kind") == "result"
    own = F.col("first").isNotNull() & F.col("first.turn").eqNullSafe(F.col("turn")) & (F.col("first.place") == F.col("place"))
    state = F.when(is_call & F.col("first").isNotNull() & ~own, F.lit("duplicate")).when(is_call & (F.coalesce("n_results", F.lit(0)) == 0), F.lit("unanswered"))
    df = df.withColumn("state", state.when(is_result & F.col("first").isNull(), F.lit("orphan")).otherwise(F.lit("ok")))
    linked = is_result & F.col("first").isNotNull()
    df = df.withColumns({"call_turn": F.when(linked, F.col("first.turn")), "__turn": F.when(linked, F.col("first.turn")).otherwise(F.col("turn")), "__at": F.when(linked, F.col("first.place")).otherwise(F.col("place")), "__depth": F.when(linked, 1).otherwise(0)})

    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    faults = F.array(F.concat(F.lit("no schema for "), F.coalesce("name", F.lit("null"))))
    for name, tool in sorted(tools.items()):
        faults = F.when(F.col("name") == name, tool.faults(F.col("arguments"), parsed)).otherwise(faults)
    errors = F.when(~is_call, F.array().cast("array<string>")).when(~is_object, F.array(F.lit("arguments are no JSON object"))).otherwise(faults)
    body = F.coalesce(canonical(F.col("arguments")), quoted(F.col("arguments")))
    json = (
        F.when(is_call, F.concat(F.lit('{"arguments":'), body, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")))
        .when(is_result, F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")))
        .otherwise(F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")))
    )

    df = df.withColumn("__chunk", F.floor(F.coalesce("__turn", F.lit(-1)) / CHUNK))
    sizes = df.groupBy(F.col("conv_id").alias("__conv"), F.col("__chunk").alias("__c")).agg(F.count("*").alias("__n"))
    before = W.partitionBy("__conv").orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).drop("__n")
    order = W.partitionBy("conv_id", "__chunk").orderBy("__turn", "__at", "__depth", "turn", "place", "role", "content", "arguments")
    df = df.withColumn("__rank", F.row_number().over(order) - 1)
    df = df.join(sizes, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__chunk") == F.col("__c")))
    return df.select("conv_id", "turn", "place", "role", "kind", "call_id", "state", "call_turn", errors.alias("errors"), (F.col("__before") + F.col("__rank")).cast("long").alias("position"), json.alias("json"))
