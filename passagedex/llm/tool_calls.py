"""Tool calls in conversations: linked to results, ordered, validated and serialised.

DataFrame functions only. Calls meet results by a hash join on conversation and
call id. The order is topological: a call that names other calls comes after
them. Arguments are checked against the tool's parameter schema, and what is
written is canonical JSON: keys sorted, no white space.

Tables:
  calls    conv_id, turn, call_id, name, arguments (JSON text), after (array of call ids)
  results  conv_id, turn, call_id, content
  tools    name, parameters (JSON schema text)

Of a schema, type (a name or a list of names), properties, required,
additionalProperties, items and enum are checked, at any depth. Other words, such
as $ref, anyOf, pattern or minimum, are not.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from passagedex.llm.common import Scratch
from passagedex.session import cut_lineage
from passagedex.sources.storage import fresh_folder

# Type names of a JSON schema and the kinds of values they admit.
KINDS = {
    "string": ["string"],
    "integer": ["integer"],
    "number": ["integer", "number"],
    "boolean": ["boolean"],
    "array": ["array"],
    "object": ["object"],
    "null": ["null"],
}

# A tool table larger than this is refused: it goes through the driver and is broadcast.
MAX_TOOL_BYTES = 8 << 20

# One schema within a tool's parameters. Schemas in it are named by their places in
# the tool's list; kinds and enum are null where anything is admitted.
RULE = (
    "struct<kinds:array<string>,enum:array<string>,properties:map<string,int>,"
    "required:array<string>,closed:boolean,rest:int,items:int>"
)


def _kind(value: Column) -> Column:
    """Kind of a JSON value held as a variant, in the words of a JSON schema."""
    named = F.schema_of_variant(value)
    return (
        F.when(named.startswith("BIGINT") | named.rlike(r"^DECIMAL\(\d+,0\)"), "integer")
        .when(named.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(named == "STRING", "string")
        .when(named == "BOOLEAN", "boolean")
        .when(named.startswith("ARRAY"), "array")
        .when(named.startswith("OBJECT"), "object")
        .when(named == "VOID", "null")
    )


def parsed_json(text: Column) -> Column:
    """A JSON text as a variant; null if it is anything but one JSON value.

    The parser stops after the first value, so the text is also read as the one
    element of an array and as the one field of an object: whatever follows the
    value breaks at least one of the two.
    """
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit("}")))
    return F.when(element.isNotNull() & field.isNotNull(), F.try_parse_json(text))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and without white space; null if it cannot be parsed.

    Repeated keys count as an error of parsing.
    """
    return F.to_json(parsed_json(text))


def _first_of(table: DataFrame) -> DataFrame:
    """One row per call id: the earliest turn; ties by the other columns."""
    rest = [c for c in table.columns if c not in ("conv_id", "call_id")]
    picked = table.dropna(subset=["call_id"]).groupBy("conv_id", "call_id")
    return picked.agg(
        F.min(F.struct("turn", *[c for c in rest if c != "turn"])).alias("row"),
        (F.count(F.lit(1)) - 1).alias("repeats"),
    )


def link_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and results as rows (conv_id, call_id, call, result, state).

    state: linked; no_result; no_call; early (the result's turn is not after the
    call's). Of several calls or results with one id the earliest counts. Rows
    without an id link to nothing. These and the later rows with an id are given by
    `unlinked_rows`. A null conversation is a conversation of its own.
    """
    one = _first_of(calls).select("conv_id", "call_id", F.col("row").alias("call"))
    two = _first_of(results).select(
        F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("row").alias("result")
    )
    both = one.join(
        two,
        F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_call")),
        "full",
    )
    state = (
        F.when(F.col("call").isNull(), "no_call")
        .when(F.col("result").isNull(), "no_result")
        .when(F.col("result.turn") <= F.col("call.turn"), "early")
        .otherwise("linked")
    )
    own = F.col("call").isNotNull()
    return both.select(
        F.when(own, F.col("conv_id")).otherwise(F.col("r_conv")).alias("conv_id"),
        F.coalesce("call_id", "r_call").alias("call_id"),
        "call",
        "result",
        state.alias("state"),
    )


def _spare(table: DataFrame) -> DataFrame:
    """The rows that `_first_of` leaves out, with a column `spare`: no_id or repeated."""
    others = [c for c in table.columns if c not in ("conv_id", "call_id", "turn")]
    nameless = table.where("call_id IS NULL").withColumn("spare", F.lit("no_id"))
    row = F.struct("turn", *others)
    kinds = table.dropna(subset=["call_id"]).groupBy("conv_id", "call_id", row.alias("row")).count()
    first = kinds.groupBy(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_call")).agg(
        F.min("row").alias("first")
    )
    # Equal rows are one of these with a count; one of the first ones is in the links.
    again = kinds.join(
        first,
        F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("call_id") == F.col("f_call")),
    ).withColumn("n", F.col("count") - F.when(F.col("row") == F.col("first"), 1).otherwise(0))
    again = again.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    again = again.select("conv_id", "call_id", "row.*").withColumn("spare", F.lit("repeated"))
    return nameless.unionByName(again)


def unlinked_rows(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and results that `format_tool_calls` has no row for, one row for each.

    Rows (conv_id, call_id, turn, state, name, arguments, after, content). state:
    call_no_id and result_no_id for rows without an id; call_repeated and
    result_repeated for all but the earliest row of an id. With the rows of
    `format_tool_calls` every call and every result is there once.
    """
    one = _spare(calls.select("conv_id", "call_id", "turn", "name", "arguments", "after"))
    two = _spare(results.select("conv_id", "call_id", "turn", "content"))
    columns = ["conv_id", "call_id", "turn", "state", "name", "arguments", "after", "content"]
    parts = [
        part.withColumn("state", F.concat(F.lit(label), F.col("spare"))).drop("spare")
        for part, label in ((one, "call_"), (two, "result_"))
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).select(*columns)


def _same(a: DataFrame, left: str, b: DataFrame, right: str) -> Column:
    """Columns `left` of a and `right` of b name one call of one conversation.

    b has its conversation in k_conv; a null conversation is equal to itself.
    """
    return a["conv_id"].eqNullSafe(b["k_conv"]) & (a[left] == b[right])


def _keyed(df: DataFrame, *columns) -> DataFrame:
    """The table with conv_id and call_id as k_conv and k_call, for joins with `_same`."""
    return df.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_call"), *columns)


def _chain_ends(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Where single-file runs of calls begin: (conv_id, call_id, to, steps, ends).

    Edges (conv_id, call_id, to, steps) have one row per call. Following them from a
    call leads in `steps` to the first `to` that has no row, or is null. Every round
    doubles the way of the calls still going, so there are about log2 of the longest
    run. Calls that run into a cycle never arrive; they are all that is left when a
    round lets nobody arrive, and have ends = false.
    """
    inside = _keyed(edges)
    onward = edges.join(inside, _same(edges, "to", inside, "k_call"), "left_semi")
    there = edges.join(inside, _same(edges, "to", inside, "k_call"), "left_anti")
    hops = scratch.keep(
        onward.withColumn("ends", F.lit(False)).unionByName(there.withColumn("ends", F.lit(True)))
    )
    going = hops.where("NOT ends").count()
    while going:
        rest = hops.where("NOT ends")
        via = _keyed(
            hops,
            F.col("to").alias("k_to"),
            F.col("steps").alias("k_steps"),
            F.col("ends").alias("k_ends"),
        )
        moved = rest.join(via, _same(rest, "to", via, "k_call")).select(
            "conv_id",
            "call_id",
            F.col("k_to").alias("to"),
            (F.col("steps") + F.col("k_steps")).alias("steps"),
            F.col("k_ends").alias("ends"),
        )
        before, hops = hops, scratch.keep(hops.where("ends").unionByName(moved))
        scratch.drop(before)
        left, going = going, hops.where("NOT ends").count()
        if left == going:
            break
    return hops


def _longest_ways(calls: DataFrame, edges: DataFrame, free: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls in `edges`, which name known calls.

    A way (call, to, steps) says that the call comes `steps` after `to`, or has that
    level where `to` is null. Of several ways of a call to the same place the longest
    counts. Calls with one way left are followed to where runs begin, by doubling,
    and the ways of the others are led on to there, where they may meet in turn.
    Ways to calls without names of their own all meet at the bottom, so each round
    settles at least the lowest calls that name several. Rounds that settle nothing
    leave calls on or behind cycles, which get no level.
    """
    spark = calls.sparkSession
    scratch, settled = Scratch(spark, "levels"), fresh_folder(spark, "levels")
    bottom = _keyed(free, F.lit(True).alias("k_free"))

    def shortened(ways: DataFrame) -> DataFrame:
        longest = ways.groupBy("conv_id", "call_id", "to").agg(F.max("steps").alias("steps"))
        return scratch.keep(longest)

    ways = shortened(
        edges.join(bottom, _same(edges, "needs", bottom, "k_call"), "left").select(
            "conv_id",
            "call_id",
            F.when(F.col("k_free").isNull(), F.col("needs")).alias("to"),
            F.lit(1).cast("long").alias("steps"),
        )
    )
    levels = StructType([*ways.select("conv_id", "call_id").schema, StructField("level", LongType())])
    n_ways, n_round = ways.count(), 0
    while n_ways:
        counted = ways.groupBy("conv_id", "call_id").agg(
            F.count(F.lit(1)).alias("n"), F.max("to").alias("to"), F.max("steps").alias("steps")
        )
        hops = _chain_ends(scratch, counted.where("n = 1").drop("n"))
        hops.where("ends AND to IS NULL").select(
            "conv_id", "call_id", F.col("steps").alias("level")
        ).write.parquet(f"{settled}/{n_round}")
        via = _keyed(
            hops,
            F.col("to").alias("k_to"),
            F.col("steps").alias("k_steps"),
            F.col("ends").alias("k_ends"),
        )
        single = _keyed(hops)
        others = ways.join(single, _same(ways, "call_id", single, "k_call"), "left_anti")
        # A way into a cycle becomes a cycle of its own call, which never settles.
        led = others.join(via, _same(others, "to", via, "k_call"), "left").select(
            "conv_id",
            "call_id",
            F.when(F.col("k_ends").isNull(), F.col("to"))
            .when(F.col("k_ends"), F.col("k_to"))
            .otherwise(F.col("call_id"))
            .alias("to"),
            (F.col("steps") + F.when(F.col("k_ends"), F.col("k_steps")).otherwise(0)).alias("steps"),
        )
        going = hops.where("ends AND to IS NOT NULL").drop("ends")
        barred = hops.where("NOT ends").select("conv_id", "call_id", F.col("call_id").alias("to"))
        barred = barred.withColumn("steps", F.lit(1).cast("long"))
        before, ways = ways, shortened(led.unionByName(going).unionByName(barred))
        scratch.drop(before, hops)
        left, n_ways, n_round = n_ways, ways.count(), n_round + 1
        if n_ways == left:
            break
    if not n_round:
        return spark.createDataFrame([], levels)
    return spark.read.schema(levels).option("recursiveFileLookup", "true").parquet(settled)


def call_levels(calls: DataFrame) -> DataFrame:
    """Topological level of every call: (conv_id, call_id, level, missing).

    Calls that name no call of their conversation have level 0, others one more
    than the highest they name. Calls on a cycle, or after one, have no level.
    `missing` counts names of calls that do not exist; a name given twice counts once.

    A conversation of n calls one after the other takes log2 n rounds of joins (see
    `_longest_ways`); calls that name several add rounds only where their ways do not
    meet. Every round is written to the shared folder. Calls are never gathered by
    conversation.
    """
    known = calls.dropna(subset=["call_id"]).select("conv_id", "call_id").distinct()
    named = (
        calls.dropna(subset=["call_id"])
        .select("conv_id", "call_id", F.explode("after").alias("needs"))
        .dropna(subset=["needs"])
        .distinct()
    )
    targets = _keyed(known)
    found = _same(named, "needs", targets, "k_call")
    missing = _keyed(named.join(targets, found, "left_anti")).groupBy("k_conv", "k_call")
    missing = missing.agg(F.count(F.lit(1)).alias("missing"))
    edges = cut_lineage(named.join(targets, found, "left_semi"))
    naming = _keyed(edges).distinct()
    free = known.join(naming, _same(known, "call_id", naming, "k_call"), "left_anti")
    free = cut_lineage(free)

    above = _keyed(_longest_ways(calls, edges, free), "level")
    lowest = _keyed(free, F.lit(0).cast("long").alias("level"))
    tops = above.unionByName(lowest)
    every = known.join(tops, _same(known, "call_id", tops, "k_call"), "left").select(
        "conv_id", "call_id", F.col("level").cast("int").alias("level")
    )
    return every.join(missing, _same(every, "call_id", missing, "k_call"), "left").select(
        "conv_id", "call_id", "level", F.coalesce("missing", F.lit(0)).alias("missing")
    )


def _rules(parameters: str) -> tuple[list[tuple], int]:
    """The schemas within one JSON schema text as RULEs, the outermost first, and how deep
    they lie in each other. What is no schema admits anything.
    """
    rules: list[tuple] = []

    def add(schema, outermost=False) -> tuple[int, int]:
        at, depth = len(rules), 0
        rules.append(())
        if schema is False:
            rules[at] = ([], None, {}, [], False, None, None)
            return at, depth
        schema = schema if isinstance(schema, dict) else {}

        def inner(part) -> int:
            nonlocal depth
            place, below = add(part)
            depth = max(depth, below + 1)
            return place

        kinds = schema.get("type")
        if isinstance(kinds, str):
            kinds = [kinds]
        if isinstance(kinds, list):
            kinds = sorted({x for k in kinds for x in KINDS.get(str(k), [])})
        else:
            kinds = None
        enum, required, named = (schema.get(k) for k in ("enum", "required", "properties"))
        enum = [json.dumps(v) for v in enum] if isinstance(enum, list) else None
        required = [k for k in required if isinstance(k, str)] if isinstance(required, list) else []
        named = named if isinstance(named, dict) else {}
        properties = {k: inner(v) for k, v in named.items()}
        more, items = schema.get("additionalProperties"), schema.get("items")
        closed = more is False or (more is None and (outermost or bool(named)))
        rest = inner(more) if isinstance(more, dict) else None
        items = inner(items) if isinstance(items, (dict, bool)) else None
        rules[at] = (kinds, enum, properties, required, closed, rest, items)
        return at, depth

    try:
        schema = json.loads(parameters)
    except ValueError:
        schema = {}
    return rules, add(schema, outermost=True)[1]


def _enum_text(value: Column) -> Column:
    """The same text for equal JSON values, whole numbers written as decimals included."""
    number = F.try_variant_get(value, "$", "double")
    is_whole = (_kind(value) == "number") & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(is_whole, number.cast("long").cast("string")).otherwise(F.to_json(value))


def argument_errors(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls (name, arguments) with one more column `errors`, a sorted array of strings.

    not_json: the arguments cannot be parsed, or are no object; unknown_tool;
    missing:NAME for a required property; type:NAME for a value of another type
    than the schema says; enum:NAME for a value that is not among those listed;
    extra:NAME for a property the schema does not have. Within objects and arrays
    NAME is a path such as list.0.unit. Properties that a schema does not name are
    errors unless additionalProperties allows them or, in an inner object, its
    schema names none. A null name is an unknown tool.

    Of several tools with one name the one with the smallest parameters text counts;
    one without parameters is unknown. The tool table is the set of tools a model is
    given, not data of the corpus: it is compiled on the driver and broadcast, and
    refused with a ValueError above MAX_TOOL_BYTES.
    """
    spark, compiled, depth = calls.sparkSession, [], 0
    one_each = tools.groupBy("name").agg(F.min("parameters").alias("parameters")).dropna()
    size = one_each.agg(F.sum(F.octet_length("name") + F.octet_length("parameters"))).first()[0] or 0
    if size > MAX_TOOL_BYTES:
        raise ValueError(f"tools of {size} bytes; at most {MAX_TOOL_BYTES} are taken")
    for name, parameters in one_each.collect():
        rules, below = _rules(parameters)
        compiled.append((name, rules))
        depth = max(depth, below)
    specs = spark.createDataFrame(compiled, f"tool string, rules array<{RULE}>")
    enum = lambda texts: F.transform(texts, lambda t: _enum_text(F.parse_json(t)))
    specs = specs.withColumn(
        "rules", F.transform("rules", lambda r: r.withField("enum", enum(r["enum"])))
    )
    parsed = calls.withColumn("value", parsed_json(F.col("arguments"))).withColumn(
        "value", F.when(_kind(F.col("value")) == "object", F.col("value"))
    )
    joined = parsed.join(F.broadcast(specs), F.col("name") == F.col("tool"), "left")
    label = lambda kind, path: F.concat(F.lit(kind), path)
    under = lambda path, key: F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))

    def opened(node: Column) -> Column:
        """A node (path, rule, value) with its kind, members and elements."""
        kind = F.coalesce(_kind(node["value"]), F.lit("null"))
        text = F.to_json(node["value"])
        return F.struct(
            node["path"].alias("path"),
            F.get("rules", node["rule"]).alias("rule"),
            node["value"].alias("value"),
            kind.alias("kind"),
            F.when(kind == "object", F.from_json(text, "map<string,variant>")).alias("members"),
            F.when(kind == "array", F.from_json(text, "array<variant>")).alias("elements"),
        )

    def wrong(node: Column) -> Column:
        rule, path, names = node["rule"], node["path"], F.map_keys(node["members"])
        known = F.map_keys(rule["properties"])
        typed = rule["kinds"].isNotNull() & ~F.array_contains(rule["kinds"], node["kind"])
        listed = rule["enum"].isNull() | F.array_contains(rule["enum"], _enum_text(node["value"]))
        none = F.array().cast("array<string>")
        return F.concat(
            F.when(typed, F.array(label("type:", path)))
            .when(~listed, F.array(label("enum:", path)))
            .otherwise(none),
            F.coalesce(
                F.transform(
                    F.array_except(rule["required"], names), lambda k: label("missing:", under(path, k))
                ),
                none,
            ),
            F.coalesce(
                F.transform(
                    F.when(rule["closed"], F.array_except(names, known)),
                    lambda k: label("extra:", under(path, k)),
                ),
                none,
            ),
        )

    def inside(node: Column) -> Column:
        rule, path = node["rule"], node["path"]
        members = F.transform(
            F.map_entries(node["members"]),
            lambda x: F.struct(
                under(path, x["key"]).alias("path"),
                F.coalesce(F.try_element_at(rule["properties"], x["key"]), rule["rest"]).alias("rule"),
                x["value"].alias("value"),
            ),
        )
        elements = F.transform(
            node["elements"],
            lambda x, i: F.struct(
                under(path, i.cast("string")).alias("path"), rule["items"].alias("rule"), x.alias("value")
            ),
        )
        return F.filter(F.coalesce(members, elements), lambda x: x["rule"].isNotNull())

    # One level after the other, as deep as the schemas go.
    root = F.struct(F.lit("").alias("path"), F.lit(0).alias("rule"), F.col("value").alias("value"))
    joined = joined.withColumn("nodes", F.array(root)).withColumn(
        "found", F.array().cast("array<string>")
    )
    for level in range(depth + 1):
        joined = joined.withColumn("nodes", F.transform("nodes", opened))
        joined = joined.withColumn("found", F.concat("found", F.flatten(F.transform("nodes", wrong))))
        if level < depth:
            inner = F.flatten(F.filter(F.transform("nodes", inside), lambda x: x.isNotNull()))
            joined = joined.withColumn("nodes", inner)
    errors = (
        F.when(F.col("value").isNull(), F.array(F.lit("not_json")))
        .when(F.col("rules").isNull(), F.array(F.lit("unknown_tool")))
        .otherwise(F.array_sort("found"))
    )
    return joined.withColumn("errors", errors).drop("value", "nodes", "found", "rules", "tool")


def format_tool_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per call id (other rows: see `unlinked_rows`): conv_id, call_id, turn, result_turn, state, level, missing,
    errors, valid and message.

    message is canonical JSON of the call with its id, name, arguments (null if
    not parsed), level and the content of its result (null unless linked); for a
    result without a call, of the result. valid: linked, no errors, a level and
    nothing missing. Within a conversation, (level, turn, call_id) is the order
    in which calls can be replayed.

    Null columns are as described for the parts; extra columns are ignored;
    empty tables give no rows. A conversation may be of any size: nothing is
    gathered by conversation.
    """
    linked = link_results(
        calls.select("conv_id", "call_id", "turn", "name", "arguments", "after"),
        results.select("conv_id", "call_id", "turn", "content"),
    )
    flat = linked.select(
        "conv_id",
        "call_id",
        F.col("call.turn").alias("turn"),
        F.col("result.turn").alias("result_turn"),
        "state",
        F.col("call.name").alias("name"),
        F.col("call.arguments").alias("arguments"),
        F.col("result.content").alias("content"),
    )
    levels = call_levels(calls).select(
        F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_call"), "level", "missing"
    )
    checked = argument_errors(flat, tools).join(
        levels,
        F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("call_id") == F.col("l_call")),
        "left",
    )
    is_call = F.col("state") != "no_call"
    content = F.when(F.col("state") != "no_result", F.col("content"))
    message = F.struct(
        F.when(is_call, parsed_json(F.col("arguments"))).alias("arguments"),
        content.alias("content"),
        F.col("call_id").alias("id"),
        "level",
        "name",
    )
    errors = F.when(is_call, F.col("errors")).otherwise(F.array().cast("array<string>"))
    valid = (
        (F.col("state") == "linked")
        & (F.size(errors) == 0)
        & F.col("level").isNotNull()
        & (F.col("missing") == 0)
    )
    return checked.select(
        "conv_id",
        "call_id",
        "turn",
        "result_turn",
        "state",
        "level",
        F.coalesce("missing", F.lit(0)).alias("missing"),
        errors.alias("errors"),
        valid.alias("valid"),
        F.to_json(message, {"ignoreNullFields": "false"}).alias("message"),
    )
