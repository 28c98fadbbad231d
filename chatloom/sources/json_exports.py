"""Structured exports as raw messages: message trees, flat conversations, three-file bundles, JSON Lines.

Every adapter takes texts (source_id, text), one row for each export, and gives (messages, skipped): rows of the raw schema
in the export's order, and (source_id, skipped) counts. A text that is not such an export gives no messages.

What an adapter finds in one pass is *told* rows: (source_id, place, kept, role, text, ts_ms, meta, info), also for what is
skipped; ``info`` is what the export says of itself, as JSON text. Messages are the kept ones with their number for a place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from chatloom.functions import text as T
from chatloom.functions import times
from chatloom.functions.jsonx import strict_json
from chatloom.functions.rows import dense_positions, ranked_positions
from chatloom.operators.structure import normal_role
from chatloom.schemas import meta
from chatloom.storage import broadcast_if_small, written

TREE = "struct<title: string, current_node: string, mapping: map<string, struct<id: string, parent: string, children: array<string>, message: struct<author: struct<role: string>, create_time: variant, content: struct<parts: variant>>>>>"
FLAT = "struct<uuid: string, name: string, chat_messages: array<struct<sender: string, text: string, created_at: string, content: variant>>>"


def conversations(docs: DataFrame, field: str, opens: str) -> DataFrame:
    """(source_id, conv, body): the JSON texts of an array, of the array ``conversations`` of an object, or of one object.

    Only objects whose ``field`` is an object or array (as ``opens`` says) are conversations, and only they are numbered.
    """
    clean = docs.select("source_id", strict_json(F.col("text")).alias("_j"))
    wrapped = F.from_json("_j", "struct<conversations: array<string>>")["conversations"]
    items = F.when(F.col("_j").startswith("["), F.from_json("_j", "array<string>")).otherwise(F.coalesce(wrapped, F.array("_j")))
    items = F.filter(items, lambda x: F.coalesce(F.get_json_object(x, f"$.{field}").startswith(opens), F.lit(False)))
    return clean.where(F.col("_j").isNotNull()).select("source_id", F.posexplode(items).alias("conv", "body"))


def chosen(items: DataFrame, field: str, opens: str) -> DataFrame:
    """The same of objects (source_id, item, body) that were read by range: the conversations among them, numbered."""
    found = items.where(F.coalesce(F.get_json_object("body", f"$.{field}").startswith(opens), F.lit(False)))
    return dense_positions(found, "source_id", "item").select("source_id", F.col("_i").cast("int").alias("conv"), "body")


TOLD = ("source_id", "place", "kept", "role", "text", "ts_ms", "meta", "info")


def _told(rows: DataFrame, order: tuple[str, ...], kept: Column, role: Column, ts: Column, known: Column, **info: Column) -> DataFrame:
    """Told rows in the order of integer columns, the first of which are places in arrays of the export."""
    place = F.lit(0).cast("decimal(38,0)")
    for c in order:
        place = place * (1 << 24) + F.col(c)
    kept = F.coalesce(kept, F.lit(False))
    # Of what is skipped only that it was there.
    own = [F.when(kept, x).alias(c) for c, x in (("role", role), ("text", F.col("text")), ("ts_ms", ts), ("meta", known))]
    return rows.select("source_id", place.cast("bigint").alias("place"), kept.alias("kept"), *own, F.to_json(F.struct(*(x.alias(n) for n, x in info.items()))).alias("info"))


def numbered(told: DataFrame) -> DataFrame:
    """The messages of told rows, numbered from 0 in each export."""
    dense = dense_positions(told.where("kept"), "source_id", "place", 1 << 30)
    return dense.select("source_id", F.col("_i").cast("bigint").alias("pos"), "role", "text", "ts_ms", "meta")


def numbered_by_time(told: DataFrame) -> DataFrame:
    """The same, but in the order of their times where all messages of an export have one. Both orders come from one sort by
    ranges, so the messages of one export are many tasks' work. ``told`` is a written table."""
    kept = told.where("kept")
    timed = written(kept.groupBy("source_id").agg((F.bool_and(F.col("ts_ms").isNotNull()) & (F.count(F.lit(1)) > 1)).alias("timed")))
    joined = kept.join(broadcast_if_small(timed.select(F.col("source_id").alias("_s"), "timed"), F.length("_s") + 16), F.col("source_id") == F.col("_s"))
    ranked = ranked_positions(joined.select(*kept.columns, F.when(F.col("timed"), F.col("ts_ms")).alias("_by")), "source_id", [F.col("_by"), F.col("place")])
    return ranked.select("source_id", F.col("_i").cast("bigint").alias("pos"), "role", "text", "ts_ms", "meta")


def skipped_of(told: DataFrame) -> DataFrame:
    return told.groupBy("source_id").agg(F.count_if(~F.col("kept")).alias("skipped"))


@F.pandas_udf(ArrayType(StringType()))
def _tree_order(nodes: pd.Series) -> pd.Series:
    """Node ids depth first from each root, in the order of the export; what no root reaches is left out."""

    def one(rows) -> list[str] | None:
        if rows is None:
            return None
        kids = {r["id"]: list(r["children"]) if r["children"] is not None else [] for r in rows}
        out, seen = [], set()
        stack = [r["id"] for r in reversed(rows) if r["parent"] is None]
        while stack:
            node = stack.pop()
            if node in seen or node not in kids:
                continue
            seen.add(node)
            out.append(node)
            stack.extend(reversed(kids[node]))
        return out

    return nodes.map(one)


@F.pandas_udf(ArrayType(StringType()))
def _path_order(nodes: pd.Series, current: pd.Series) -> pd.Series:
    """Node ids from the root to the current node."""

    def one(rows, at) -> list[str] | None:
        if rows is None:
            return None
        parent = {r["id"]: r["parent"] for r in rows}
        out: dict[str, None] = {}
        while at in parent and at not in out:
            out[at] = None
            at = parent[at]
        return list(out)[::-1]

    return pd.Series([one(r, a) for r, a in zip(nodes, current, strict=True)])


def chatgpt(docs: DataFrame, current_path: bool = False) -> tuple[DataFrame, DataFrame]:
    """Message trees: all branches depth first, or only the path to the current node.

    Tool messages and messages without text are skipped and counted. Nodes of which no root is known do not count at all.
    """
    return tree_messages(conversations(docs, "mapping", "{"), current_path)


def tree_messages(chats: DataFrame, current_path: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same of conversations (source_id, conv, body)."""
    told = tree_told(chats, current_path)
    return numbered(told), skipped_of(told)


def tree_told(chats: DataFrame, current_path: bool = False) -> DataFrame:
    trees = chats.withColumn("c", F.from_json("body", TREE))
    nodes = F.transform(F.map_entries("c.mapping"), lambda e: F.struct(e["key"].alias("id"), e["value"]["parent"].alias("parent"), e["value"]["children"].alias("children")))
    order = _path_order(nodes, F.col("c.current_node")) if current_path else _tree_order(nodes)
    walked = trees.select("source_id", "conv", "c", F.posexplode(order).alias("node", "id")).select("source_id", "conv", "node", F.col("c.title").alias("title"), F.try_element_at("c.mapping", F.col("id"))["message"].alias("m"))
    walked = walked.where(F.col("m").isNotNull())
    parts = F.filter(F.coalesce(F.try_variant_get("m.content.parts", "$", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v) == "STRING")
    texts = F.filter(F.transform(parts, lambda v: T.trim(F.try_variant_get(v, "$", "string"))), lambda v: v != "")
    told = walked.withColumn("text", F.array_join(texts, "\n")).withColumn("author", F.col("m.author.role"))
    keep = F.coalesce(F.col("author") != "tool", F.lit(True)) & (F.col("text") != "")
    role = F.coalesce(normal_role(F.col("author")), F.lit("unlabeled"))
    known = meta(source=F.lit("chatgpt"), conversation_title=F.col("title"), conversation_index=F.col("conv"), original_role=F.when(normal_role(F.col("author")).isNull(), F.col("author")))
    ts = times.epoch_to_ms(F.try_variant_get("m.create_time", "$", "string"))
    return _told(told, ("conv", "node"), keep, role, ts, known, mode=F.lit("current-path" if current_path else "tree"))


def claude(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat conversations: the text, or else the text blocks of the content; messages without text are skipped."""
    return flat_messages(conversations(docs, "chat_messages", "["))


def flat_messages(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of conversations (source_id, conv, body)."""
    told = flat_told(chats)
    return numbered(told), skipped_of(told)


def flat_told(chats: DataFrame) -> DataFrame:
    chats = chats.withColumn("c", F.from_json("body", FLAT))
    rows = chats.select("source_id", "conv", F.col("c.name").alias("name"), F.posexplode("c.chat_messages").alias("node", "m"))
    blocks = F.coalesce(F.try_variant_get("m.content", "$", "array<variant>"), F.array().cast("array<variant>"))
    blocks = F.filter(blocks, lambda v: F.try_variant_get(v, "$.type", "string") == "text")
    said = F.filter(F.transform(blocks, lambda v: T.trim(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit("")))), lambda v: v != "")
    told = rows.withColumn("text", F.coalesce(F.nullif(T.trim(F.col("m.text")), F.lit("")), F.array_join(said, "\n")))
    sender = F.col("m.sender")
    role = F.when(sender == "human", "user").when(sender.isin("assistant", "system"), sender).otherwise("unlabeled")
    known = meta(source=F.lit("claude"), sender=sender, conversation_name=F.col("name"), conversation_index=F.col("conv"))
    return _told(told, ("conv", "node"), F.col("text") != "", role, times.parse_iso_ms(F.col("m.created_at")), known, format=F.lit("flat"))


def _first_text(*values: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(T.trim(v), F.lit("")) for v in values))


#: The files of a bundle by base name, with or without ``.json``, and the fields of one that is one JSON text.
BUNDLE = {"user": ("user",), "character": ("character",), "message": ("message", "messages")}


def characterai(files: DataFrame, need_messages: bool = True) -> tuple[DataFrame, DataFrame]:
    """Bundles of files (source_id, name, text): messages, with the names of user and character.

    A bundle may also be one text, an object with the three as its fields. The raw content of a message is its text. Where
    every message of an export has a time they are put in its order, else they stay as they are. An export without
    ``message.json`` stops the query, or has no messages where they need not be.
    """
    told = written(bundle_told(files, need_messages))
    return numbered_by_time(told), skipped_of(told)


def bundle_told(files: DataFrame, need_messages: bool = True) -> DataFrame:
    file = F.regexp_replace(F.lower(F.regexp_extract(F.replace(F.col("name"), F.lit("\\"), F.lit("/")), r"([^/]*)\z", 1)), r"\.json\z", "")
    named = files.select("source_id", "name", file.alias("file"), strict_json(F.col("text")).alias("j"))
    fields = F.from_json("j", "struct<" + ", ".join(f"{x}: string" for names in BUNDLE.values() for x in names) + ">")
    held = [F.struct(F.lit(kind).alias("file"), F.coalesce(*(fields[x] for x in names)).alias("j")) for kind, names in BUNDLE.items()]
    one = F.col("file").isin(*BUNDLE["message"]) & F.col("j").startswith("{") & F.coalesce(*(fields[x] for names in BUNDLE.values() for x in names)).isNotNull()
    named = named.select("source_id", "name", F.inline(F.when(one, F.array(*held)).otherwise(F.array(F.struct("file", "j"))))).withColumn("j", strict_json(F.col("j")))
    # Of several files with one of these names the first by its whole name; all three in one pass.
    of = lambda kind: F.col("file").isin(*BUNDLE[kind]) & F.col("j").isNotNull()
    bundles = named.groupBy("source_id").agg(*(F.min_by(F.when(of(kind), F.col("j")), F.when(of(kind), F.col("name"))).alias(kind) for kind in BUNDLE))

    def name_in(j: Column, keys: tuple[str, ...]) -> Column:
        # An array stands for its first item; only a string is a name.
        first = F.when(j.startswith("["), F.get(F.from_json(j, "array<string>"), F.lit(0))).otherwise(j)
        found = F.from_json(first, "struct<" + ", ".join(f"{k}: variant" for k in keys) + ">")
        return _first_text(*(F.when(F.schema_of_variant(found[k]) == "STRING", F.try_variant_get(found[k], "$", "string")) for k in keys))

    if need_messages:
        bundles = bundles.withColumn("message", F.when(F.col("message").isNull(), F.raise_error(F.lit("the bundle has no message.json")).cast("string")).otherwise(F.col("message")))
    item = "array<struct<src: struct<name: string, is_human: variant, raw_content: string, created_at: string>, raw_content: string, is_human: variant, name: string, created: string, created_at: string, timestamp: string, create_time: string>>"
    who = (name_in(F.col("user"), ("first_name", "username", "user_name", "name")).alias("user"), name_in(F.col("character"), ("name", "title")).alias("character"))
    rows = bundles.select("source_id", *who, "message").select("source_id", "user", "character", F.posexplode(F.from_json("message", item)).alias("node", "m"))
    told = rows.withColumn("text", _first_text(F.col("m.src.raw_content"), F.col("m.raw_content"))).withColumn("speaker", _first_text(F.col("m.src.name"), F.col("m.name")))
    human = F.coalesce(F.try_variant_get("m.src.is_human", "$", "boolean"), F.try_variant_get("m.is_human", "$", "boolean"))
    role = F.when(human, "user").when(~human, "assistant").when(F.col("speaker") == F.col("user"), "user").when(F.col("speaker") == F.col("character"), "assistant").otherwise("unlabeled")
    dated = (_first_text(F.col("m.created_at"), F.col("m.src.created_at")), _first_text(F.col("m.created"), F.col("m.timestamp")))
    stamp = F.coalesce(*map(times.parse_iso_ms, dated), times.epoch_to_ms(F.col("m.create_time")))
    known = meta(source=F.lit("characterai"), speaker=F.col("speaker"), pending_label=F.when(role == "unlabeled", True))
    return _told(told, ("node",), F.col("text").isNotNull(), role, stamp, known, user=F.col("user"), character=F.col("character"))


def sillytavern(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON Lines with ``mes``: other lines are skipped and counted, lines that only name user or character are neither."""
    return line_messages(lines_of(docs))


def lines_of(docs: DataFrame) -> DataFrame:
    """(source_id, node, line) of texts."""
    return docs.select("source_id", F.posexplode(T.lines(T.without_bom(F.col("text")))).alias("node", "line"))


def line_messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of lines (source_id, node, line) that are trimmed and not blank."""
    told = line_told(lines)
    return numbered(told), skipped_of(told)


def line_told(lines: DataFrame) -> DataFrame:
    item = "struct<mes: variant, is_user: variant, is_system: variant, name: string, send_date: string, user_name: variant, character_name: variant>"
    rows = lines.withColumn("m", F.from_json(strict_json(F.col("line")), item))
    text = F.when(F.schema_of_variant("m.mes") == "STRING", T.trim(F.try_variant_get("m.mes", "$", "string")))
    told = rows.withColumn("text", F.coalesce(text, F.lit("")))
    header = F.col("m.mes").isNull() & (F.col("m.user_name").isNotNull() | F.col("m.character_name").isNotNull())
    told = told.where(~F.coalesce(header, F.lit(False)))
    true = lambda c: F.coalesce(F.try_variant_get(c, "$", "boolean"), F.lit(False))
    role = F.when(true("m.is_system"), "system").when(true("m.is_user"), "user").otherwise("assistant")
    known = meta(source=F.lit("st-chatlog"), speaker=F.nullif(F.col("m.name"), F.lit("")), raw_time=F.col("m.send_date"))
    return _told(told, ("node",), F.col("text") != "", role, times.parse_send_date(F.col("m.send_date")), known, format=F.lit("lines"))
