"""Tool-call linking for chat formatting.

Calls and results meet in a hash join by conversation and identifier, calls take their place after
those whose results they use, arguments are checked against schemas, and each call with its result
becomes one line of canonical JSON (sorted keys, no spaces). All steps are DataFrame functions; no
step gathers a conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _dist


#: Rounds of depths() before chains are doubled.
SHORT = 8


@dataclass(frozen=True)
class Tool:
    """A tool's name and its arguments: name -> (type, required). Types: string, integer, number, boolean, array, object."""

    name: str
    arguments: tuple[tuple[str, str, bool], ...]


def _typed(value: Column, kind: str) -> Column:
    found = F.schema_of_variant(value)
    number = (found == "BIGINT") | (found == "DOUBLE") | found.startswith("DECIMAL")
    if kind == "string":
        return found == "STRING"
    if kind == "integer":  # 1.0 and 1e0 are integers too
        exact = F.try_variant_get(value, "$", "double")
        return (found == "BIGINT") | (number & (exact == F.floor(exact)))
    if kind == "number":
        return number
    if kind == "boolean":
        return found == "BOOLEAN"
    return found.startswith({"array": "ARRAY", "object": "OBJECT"}[kind])


#: What JSON text is made of: strings, numbers, and all between them. Possessive, so long strings need no stack.
_PARTS = r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*|[^"0-9-]++'
#: Whole numbers below this, and decimals of so many digits, are exact as doubles.
_WHOLE, _DIGITS = 1e15, 15


def canonical_numbers(json: Column) -> Column:
    """JSON text with each number that has a point or an exponent in one form: whole ones below 10^15 without either, others as the shortest text of their double; decimals of over 15 digits without exponent stay as they are."""

    def number(part: Column) -> Column:
        value = part.try_cast("double")
        digits = F.length(F.regexp_replace(part, "^[-0.]+|[.]", ""))
        long_ = ~part.rlike("[eE]") & (digits > _DIGITS)
        whole = (value == F.floor(value)) & (F.abs(value) < _WHOLE)
        fit = F.when(whole, value.cast("long").cast("string")).when(F.abs(value) < float("inf"), value.cast("string"))
        return F.when(long_, part).otherwise(F.coalesce(fit, part))

    parts = F.regexp_extract_all(json, F.lit(_PARTS), 0)
    rewritten = F.transform(parts, lambda p: F.when(p.rlike("^-?[0-9]+[.eE]"), number(p)).otherwise(p))
    return F.when(json.rlike("[0-9][.eE]"), F.array_join(rewritten, "")).otherwise(json)


def valid_arguments(name: Column, arguments: Column, tools: tuple[Tool, ...]) -> Column:
    """True if the JSON text `arguments` is an object that has what the schema of tool `name` asks for and nothing else; false for unknown tools and objects that repeat a key."""
    parsed = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool in tools:
        good = F.schema_of_variant(parsed).startswith("OBJECT")
        for key, kind, required in tool.arguments:
            value = F.try_variant_get(parsed, f"$['{key}']", "variant")
            has = value.isNotNull()
            fits = F.coalesce(_typed(value, kind), F.lit(False))
            good &= F.when(has, fits).otherwise(F.lit(not required))
        known = F.array(*[F.lit(k) for k, _, _ in tool.arguments]) if tool.arguments else F.array().cast("array<string>")
        good &= F.size(F.array_except(F.json_object_keys(arguments), known)) == 0
        out = F.when(name == tool.name, F.coalesce(good, F.lit(False))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of calls(conv_id, call_id, after array<string>): 0 without earlier calls, else one more than the deepest of them; null on or behind a cycle.

    after may name calls that the conversation doesn't have; they don't count. A null conv_id is a
    conversation too. Each round settles the calls whose earlier ones are settled, until none is left or
    no more settle: as many rounds as the longest chain has calls. After SHORT of them, chains of calls
    with one earlier call each are cut short by doubling, so those take logarithmic rounds.
    """
    keys = ["conv_id", "call_id"]
    nodes = calls.select(*keys).distinct()
    needs = calls.select(*keys, F.explode("after").alias("before")).distinct()
    needs = _dist.materialize(_null_safe(needs, nodes.withColumnRenamed("call_id", "before"), ["conv_id", "before"], "left_semi"), "needs")
    settled = _dist.materialize(_null_safe(nodes, needs.select(*keys).distinct(), keys, "left_anti").withColumn("depth", F.lit(0).cast("long")), "depth0")
    # step: how much deeper a call is than the earlier one at least
    open_, turn = needs.withColumn("step", F.lit(1).cast("long")), 0
    while open_.limit(1).count():
        turn += 1
        if turn > SHORT:
            open_ = _doubled(open_, turn)
        known = settled.select("conv_id", F.col("call_id").alias("before"), "depth")
        state = _null_safe(open_, known, ["conv_id", "before"], "left").groupBy(*keys).agg(F.count("*").alias("n"), F.count("depth").alias("done"), F.max(F.col("depth") + F.col("step")).alias("depth"))
        fresh = _dist.materialize(state.where("n = done").select(*keys, "depth"), f"depth{turn}")
        if not fresh.limit(1).count():
            break
        settled = _dist.materialize(settled.unionByName(fresh), f"settled{turn}")
        open_ = _dist.materialize(_null_safe(open_, fresh.select(*keys), keys, "left_anti"), f"open{turn}")
    return _null_safe(nodes, settled, keys, "left")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """left joined with right on keys, nulls equal to nulls; columns of left, then the others of right."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, match, how).drop(*[f"__{k}" for k in keys])


def _doubled(open_: DataFrame, turn: int) -> DataFrame:
    """open_(conv_id, call_id, before, step) with each earlier call that waits for one call only replaced by that one, steps added.

    A call then reaches twice as far back, and its depth is the same: the replaced one's depth is that
    of the one it waits for and its step. Of several ways to one call the longest counts.
    """
    keys = ["conv_id", "call_id"]
    single = open_.groupBy(*keys).agg(F.count("*").alias("n"), F.min("before").alias("further"), F.min("step").alias("more")).where("n = 1")
    single = single.select("conv_id", F.col("call_id").alias("before"), "further", "more")
    joined = _null_safe(open_, single, ["conv_id", "before"], "left")
    moved = joined.select(*keys, F.coalesce("further", "before").alias("before"), F.least(F.col("step") + F.coalesce("more", F.lit(0)), F.lit(1 << 60)).alias("step"))  # only cycles get that far
    return _dist.materialize(moved.groupBy(*keys, "before").agg(F.max("step").alias("step")), f"doubled{turn}")


def link_calls(calls: DataFrame, results: DataFrame, tools: tuple[Tool, ...]) -> DataFrame:
    """One row per distinct call of calls(conv_id, turn, call_id, name, arguments, after): conv_id, call_id, turn, name, depth, status, valid, line.

    results(conv_id, turn, call_id, content). Of rows with one identifier the one with the smallest turn,
    then the smallest content, counts, and status is "repeated"; else it is "linked", or "unanswered"
    without a result. Results of no call and calls without identifier go. Sorting a conversation's rows
    by (depth, turn, call_id) is a topological order; depth is null on or behind a cycle. valid: the
    arguments fit the tool's schema. line: canonical JSON of arguments (null if they aren't JSON),
    call_id, content and name; numbers are in the form of canonical_numbers(), and arguments in which an
    object repeats a key stay as they are, as a JSON string. Very long contents pass through whole, each
    row by itself. Nulls become JSON nulls; empty tables give no rows; other columns don't
    matter.
    """
    keys = ["conv_id", "call_id"]
    said = calls.where(F.col("call_id").isNotNull()).groupBy(*keys).agg(F.min(F.struct("turn", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))).alias("c"), F.count("*").alias("n_calls"))
    given = results.where(F.col("call_id").isNotNull()).groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    said = _dist.materialize(said.select(*keys, "c.*", "n_calls"), "calls")
    placed = depths(said.select(*keys, "after"))
    null_safe = lambda right: F.col("conv_id").eqNullSafe(F.col(f"{right}_conv")) & (F.col("call_id") == F.col(f"{right}_call"))
    joined = said.join(given.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), "r", "n_results"), null_safe("r"), "left")
    joined = joined.join(placed.select(F.col("conv_id").alias("d_conv"), F.col("call_id").alias("d_call"), "depth"), null_safe("d"), "left")
    status = F.when((F.col("n_calls") > 1) | (F.coalesce("n_results", F.lit(0)) > 1), "repeated").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    text = lambda c: F.coalesce(F.to_json(F.try_parse_json(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "true"}))), F.lit("{}"))
    quoted = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_extract(text(c), r'(?s)^\{"x":(.*)\}$', 1))
    # a variant's objects keep their keys in order, so printing one is canonical; it has no objects that repeat a key
    repeated = F.json_object_keys("arguments").isNotNull() | F.json_array_length("arguments").isNotNull()
    canonical = F.coalesce(canonical_numbers(F.to_json(F.try_parse_json("arguments"))), F.when(repeated, quoted(F.col("arguments"))), F.lit("null"))
    line = F.concat(F.lit('{"arguments":'), canonical, F.lit(',"call_id":'), quoted(F.col("call_id")), F.lit(',"content":'), quoted(F.col("r.content")), F.lit(',"name":'), quoted(F.col("name")), F.lit("}"))
    return joined.select("conv_id", "call_id", "turn", "name", "depth", status.alias("status"), valid_arguments(F.col("name"), F.col("arguments"), tools).alias("valid"), line.alias("line"))


#: Tools of the conversations that turn_calls() makes.
TURN_TOOLS = (
    Tool("lookup", (("turn", "integer", True), ("chars", "integer", True), ("after", "array", False))),
    Tool("outline", (("turn", "integer", True), ("chars", "integer", True), ("after", "array", True))),
)


def turn_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a table of plain turns(conv_id, turn, role, text): a user's turn calls a tool about itself, the assistant's turn after it is the result, and a call uses the result of the call half as far into the conversation."""
    name = lambda turn: F.concat(F.lit("c"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    users = conversations.where("role = 'user'").select("conv_id", "turn", name(turn).alias("call_id"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.floor(turn / 2).alias("half"))
    kind = F.when(F.pmod(F.col("chars"), F.lit(3)) == 0, "outline").otherwise("lookup")
    # the call half as far, if that is an earlier turn
    half = F.when(F.col("half") < turn, name(F.col("half") - F.pmod(F.col("half"), F.lit(2))))
    arguments = F.concat(F.lit('{"turn": '), turn.cast("string"), F.when(half.isNotNull(), F.concat(F.lit(', "after": ["'), half, F.lit('"]'))).otherwise(""), F.lit(', "chars": '), F.col("chars").cast("string"), F.lit("}"))
    calls = users.select("conv_id", "turn", "call_id", kind.alias("name"), arguments.alias("arguments"), F.when(half.isNotNull(), F.array(half)).otherwise(F.array().cast("array<string>")).alias("after"))
    answers = conversations.where("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.md5(F.coalesce("text", F.lit(""))).alias("content"))
    return calls, answers
