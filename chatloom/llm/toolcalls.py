"""Chat formatting with tool calls linked to their results (operator 6).

Messages, tool calls and tool results of conversations are rows. Results are joined to calls by identifier, arguments are
validated against the schema of the tool, rows are put in a topological order (nothing before what it refers to), and each
row is written as canonical JSON: sorted keys, no white space, no nulls. All of it is joins, aggregations and sorts.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import cut, drop

#: Types an argument may have, as patterns of the names that Spark gives to the types of JSON values.
TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


@dataclass(frozen=True)
class Value:
    """What an argument may be: its type; one of some values; the type of an array's items; the fields of an object."""

    kind: str
    enum: tuple = ()
    items: Value | str | None = None
    fields: Schema | None = None


@dataclass(frozen=True)
class Schema:
    """The fields of an object (a tool's arguments, or a nested one): what each may be (a ``Value`` or the name of a type),
    which must be there, and whether others may be."""

    types: Mapping[str, Value | str]
    required: tuple[str, ...] = ()
    others: bool = False


def strict_value(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else, or null.

    Parsers stop behind the first value. Behind ``[`` and before ``]`` only a value followed by nothing, or by a bracket, comes
    out as an array of one; as a field of an object, followed by another one, what is behind a bracket is an error.
    """
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    field = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"end":1}'))), "$.end", "int")
    return F.when((F.size(alone) == 1) & (field == 1), alone[0])


#: JSON text as strings, numbers and what is between them.
_TOKENS = r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'
_NUMBER = r"\A-?[0-9]"


def out_of_range(text: Column) -> Column:
    """Whether a number in a JSON text is beyond what a double holds: it has no value to be written again."""
    found = F.exists(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), lambda t: t.rlike(_NUMBER) & t.rlike("[eE]|[0-9]{300}") & (F.abs(F.expr("double('Infinity')")) == F.abs(t.try_cast("double"))))
    return F.coalesce(F.when(text.rlike("[0-9][eE]|[0-9]{300}"), found), F.lit(False))


def _one_form(number: Column) -> Column:
    """A number that is not written as an integer: all digits and no exponent, without zeros at the end, where 20 digits
    before and 18 behind the point, or 38 before it, hold it exactly; else as the shortest double."""
    double, plain, large = number.try_cast("double"), number.try_cast("decimal(38,18)"), number.try_cast("decimal(38,0)")
    digits = F.regexp_replace(F.regexp_replace(plain.cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    return F.when(plain.cast("double") == double, F.when(plain == 0, "0").otherwise(digits)).when(large.cast("double") == double, large.cast("string")).otherwise(double.cast("string"))


def canonical(value: Column) -> Column:
    """A VARIANT as canonical JSON: sorted keys, no white space, and one form of each number (1e3, 1000.0 and 1000 are 1000)."""
    whole = F.to_json(value)
    formed = F.transform(F.regexp_extract_all(whole, F.lit(_TOKENS), F.lit(0)), lambda t: F.when(t.rlike(_NUMBER) & t.rlike("[.eE]"), _one_form(t)).otherwise(t))
    return F.when(whole.rlike("[0-9][.eE]"), F.array_join(formed, "")).otherwise(whole)


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _wrong(value: Column, kind: Value | str, name: str) -> Column:
    """What is wrong with a VARIANT value, or null."""
    kind = kind if isinstance(kind, Value) else Value(kind)
    fits = F.coalesce(F.schema_of_variant(value).rlike(f"^(?:{TYPES[kind.kind]})$"), F.lit(False))
    out = F.lit(None).cast("string")
    if kind.fields:
        out = F.coalesce(out, _faulty(value, kind.fields, f"{name}."))
    if kind.items:
        items = F.try_variant_get(value, "$", "array<variant>")
        out = F.coalesce(out, F.get(F.filter(F.transform(items, lambda x: _wrong(x, kind.items, f"{name}[]")), lambda x: x.isNotNull()), F.lit(0)))
    if kind.enum:
        # Whole numbers have no point in the canonical form.
        whole = [int(x) if isinstance(x, float) and x.is_integer() else x for x in kind.enum]
        allowed = [json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in whole]
        out = F.coalesce(out, F.when(~canonical(value).isin(allowed), F.lit(f"{name} is not one of {', '.join(allowed)}")))
    return F.when(fits, out).otherwise(F.lit(f"{name} is not {kind.kind}"))


def _faulty(value: Column, schema: Schema, prefix: str = "") -> Column:
    """What is wrong with a VARIANT object, or null: the first field in the schema's order, then an unknown one."""
    keys = F.json_object_keys(F.to_json(value))
    out = F.lit(None).cast("string")
    if not schema.others:
        known = F.array(*map(F.lit, schema.types)).cast("array<string>")
        out = F.when(F.size(F.array_except(keys, known)) > 0, F.lit(f"unknown argument{' in ' + prefix[:-1] if prefix else ''}"))
    for name, kind in reversed(schema.types.items()):
        absent = F.lit(f"missing {prefix}{name}") if name in schema.required else out
        found = _wrong(F.try_variant_get(value, _path(name), "variant"), kind, prefix + name)
        out = F.when(~F.array_contains(keys, name), absent).otherwise(F.coalesce(found, out))
    return out


def fault(name: Column, arguments: Column, schemas: Mapping[str, Schema]) -> Column:
    """What is wrong with a call's arguments (a VARIANT, null where the text is not JSON), or null."""
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    out = F.lit("unknown tool")
    for tool, schema in schemas.items():
        out = F.when(name == tool, F.when(~is_object, F.lit("not a JSON object")).otherwise(_faulty(arguments, schema))).otherwise(out)
    return out


def _first(rows: DataFrame) -> DataFrame:
    """The first row of each (conv, id): its uid. Of one turn, that whose content hashes lowest, however rows are stored."""
    return rows.groupBy("conv", "id").agg(F.min(F.struct("turn", "content", "uid")).alias("f")).select("conv", "id", F.col("f.uid").alias("first"))


def link(events: DataFrame) -> DataFrame:
    """``events`` with ``target`` (uid of the call a result answers) and ``status``.

    Status of a call: ``answered``, ``open``, or ``repeated id`` (an earlier call has it). Of a result: ``linked``,
    ``second answer``, or ``no call``. Of a message: null. Only first calls are joined, so no key gives pairs of rows.
    """
    calls, results = events.where("kind = 'call'"), events.where("kind = 'result'")
    first_call = _first(calls.where("id is not null")).withColumnRenamed("first", "call_uid")
    first_result = _first(results.where("id is not null")).withColumnRenamed("first", "result_uid")
    both = first_call.join(first_result, ["conv", "id"], "full")
    rows = events.join(both, ["conv", "id"], "left")
    status = (
        F.when(F.col("kind") == "call", F.when(F.col("call_uid") != F.col("uid"), "repeated id").when(F.col("result_uid").isNull(), "open").otherwise("answered"))
        .when(F.col("kind") == "result", F.when(F.col("call_uid").isNull(), "no call").when(F.col("result_uid") != F.col("uid"), "second answer").otherwise("linked"))
    )
    target = F.when(F.col("kind") == "result", F.col("call_uid"))
    return rows.select(*events.columns, target.alias("target"), status.alias("status"), "call_uid")


def _jumps(nodes: DataFrame, single: DataFrame) -> DataFrame:
    """(uid, up, steps, most, open): where the chain of single references from each row of ``single`` (uid, up) ends.

    ``up`` is the first row that has no reference or several, ``steps`` away, ``most`` the highest turn before it. Pointers
    double their reach each round; ``open`` rows never end: they are on or behind a cycle.
    """
    at = cut(single.join(nodes, "uid").select("uid", "up", F.lit(1).cast("long").alias("steps"), F.col("turn").alias("most"), F.lit(True).alias("open")), "jumps")
    before = None
    while True:
        far = at.select(F.col("uid").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("most").alias("most2"))
        found = at.join(far, "up", "left").select("uid", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0).cast("long"))).alias("steps"), F.greatest("most", "most2").alias("most"), F.col("up2").isNotNull().alias("open"))
        new = cut(found, "jumps")
        left = new.where("open").count()
        drop(at)
        at = new
        # As long as a chain is open its rows that are nearest to its end close, so the number falls; cycles alone keep it.
        if not left or left == before:
            return at
        before = left


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, at, depth, cyclic): each row's turn moved behind what it refers to, and how deep its references go.

    ``nodes`` has (uid, turn), ``edges`` (uid, needs). Chains of rows with one reference each are followed by doubling, in as
    many rounds as the logarithm of the longest; what is left are rows with several references, settled one link of the
    longest chain of such rows a round. Rows on or behind a cycle stay where they are.
    """
    edges = cut(edges.distinct(), "edges")
    degree = cut(edges.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("up")), "degrees")
    ends = _jumps(nodes, degree.where("n = 1").select("uid", "up"))
    several = degree.where("n > 1").select("uid")
    done = cut(nodes.join(degree, "uid", "left_anti").select("uid", F.col("turn").alias("at"), F.lit(0).cast("long").alias("depth")), "settled")
    left = cut(nodes.join(several, "uid", "left_semi"), "unsettled")
    if left.count():
        via = ends.select(F.col("uid").alias("needs"), "up", "steps", "most", "open")
        # What rows with several references need, by where the chains behind them end.
        far = edges.join(several, "uid", "left_semi").join(via, "needs", "left")
        far = cut(far.select("uid", F.when(F.col("open"), None).otherwise(F.coalesce("up", "needs")).alias("end"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps"), "most"), "far")
        while True:
            known = far.join(left, "uid", "left_semi").join(done.select(F.col("uid").alias("end"), "at", "depth"), "end", "left")
            ready = known.groupBy("uid").agg(F.bool_and(F.col("depth").isNotNull()).alias("ready"), F.max(F.greatest("at", "most")).alias("behind"), F.max(F.col("depth") + F.col("steps")).alias("d")).where("ready")
            new = cut(left.join(ready, "uid").select("uid", F.greatest("turn", "behind").alias("at"), (F.col("d") + 1).alias("depth")), "settled")
            if not new.count():
                break
            done, left = cut(done.unionByName(new), "settled"), cut(left.join(new, "uid", "left_anti"), "unsettled")
    settled = ends.where("not open").join(done.select(F.col("uid").alias("up"), "at", "depth"), "up").select("uid", F.greatest("at", "most").alias("at"), (F.col("depth") + F.col("steps")).alias("depth"))
    found = done.unionByName(settled)
    rest = nodes.join(found, "uid", "left_anti").select("uid", F.col("turn").alias("at"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
    return found.withColumn("cyclic", F.lit(False)).unionByName(rest)


def in_order(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, each row's number from 0 in its group, however many rows a group has.

    Rows are sorted by ranges of (group, order), so a large group is many tasks' work; where each range of a group begins is
    summed over the ranges, of which there are as many as shuffle partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    ranged = cut(ranged.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)), "ranged")
    counts = ranged.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_p")) - F.col("_n")
    begins = counts.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), (before - F.col("_first")).alias("_shift"))
    joined = ranged.join(begins, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return joined.select(*rows.columns, (F.col("_m") + F.col("_shift")).alias("place"))


def format_chats(events: DataFrame, schemas: Mapping[str, Schema]) -> DataFrame:
    """Canonical rows of conversations in topological order.

    ``events``: conv, turn, role, kind (message, call or result), id, name (of the tool), arguments (JSON text), text,
    after (ids of calls that a row refers to besides its own call). Returns conv, turn, role, kind, id, status, fault,
    cyclic, place (0 upward in each conversation) and json.

    Null conv: ordered as one conversation, its calls and results not linked. Null turn: first. Null id on a call or result:
    open, or no call. Null text or arguments: left out of the JSON (arguments count as faulty); arguments that are not one
    JSON value and nothing else, or have a number beyond what a double holds, are kept as the string ``raw``. Rows of one turn: by depth, role, kind, id, then a hash of
    their content, and of calls with one id in one turn the first by that hash is the first; so nothing depends on how rows
    are stored. Repeated rows: all stay, in places next to each other; the first call and the first answer of an id are
    linked. References to unknown ids do not count. Very long texts are kept whole. Empty table: no rows. Other columns are
    not read.
    """
    content = F.xxhash64("role", "name", "arguments", "text", F.coalesce("after", F.array().cast("array<string>")))
    columns = ["conv", "turn", "role", "kind", "id", "name", "arguments", "text", "after"]
    rows = cut(events.select(*columns, content.alias("content"), F.monotonically_increasing_id().alias("uid")), "events")
    linked = cut(link(rows), "linked")
    own = linked.where("target is not null").select("uid", F.col("target").alias("needs"))
    calls = _first(linked.where("kind = 'call' and id is not null")).select("conv", "id", F.col("first").alias("needs"))
    other = linked.select("uid", "conv", F.explode("after").alias("id")).join(calls, ["conv", "id"]).select("uid", "needs")
    placed = linked.join(levels(linked.select("uid", "turn"), own.unionByName(other)), "uid")
    rows = in_order(placed, "conv", ["at", "depth", "turn", "role", "kind", "id", "content", "uid"])
    large = out_of_range(F.col("arguments"))
    valued = rows.withColumn("large", large).withColumn("value", F.when((F.col("kind") == "call") & ~F.col("large"), strict_value(F.col("arguments"))))
    parts = {
        "arguments": F.when(F.col("kind") == "call", F.coalesce(canonical(F.col("value")), F.to_json(F.struct(F.col("arguments").alias("raw"))))),
        "content": F.when(F.col("text").isNotNull(), json_text(F.col("text"))),
        "id": F.when(F.col("id").isNotNull() & (F.col("kind") != "message"), json_text(F.col("id"))),
        "kind": json_text(F.col("kind")),
        "name": F.when(F.col("kind") == "call", json_text(F.col("name"))),
        "role": F.when(F.col("role").isNotNull(), json_text(F.col("role"))),
    }
    # concat_ws leaves out what is null
    whole = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), F.lit("}"))
    wrong = F.when(F.col("kind") == "call", F.when(F.col("large"), "a number is out of range").otherwise(fault(F.col("name"), F.col("value"), schemas)))
    return valued.select("conv", "turn", "role", "kind", "id", "status", wrong.alias("fault"), "cyclic", "place", whole.alias("json"))


def json_text(value: Column) -> Column:
    """A string as JSON."""
    return F.to_json(F.to_variant_object(F.array(value))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(value)))) - 2)
