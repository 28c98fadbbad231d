"""Packs: statistics, and the messages as self-describing JSON Lines, plain JSON Lines and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import times
from chatloom.functions.rows import dense_positions
from chatloom.schemas import META_FIELDS, camel

#: Fixed value: the version of the pack's format. The generator is this library.
SCHEMA_VERSION = "1.0"
GENERATOR = {"name": "chatloom-pack", "version": "1.0.0"}
FIELDS = {
    "ts": "time in epoch milliseconds (UTC), or null",
    "role": "user, assistant, system or unlabeled",
    "text": "the message after cleaning",
    "meta": "where the message comes from",
    "type": "pack-meta for the first line, message for all others",
}
#: Labels of the Markdown form.
UNKNOWN_TIME, UNKNOWN = "未知时间", "未知"
ROLE_LABELS = {"user": "主人", "assistant": "伴侣", "system": "系统"}
OTHER_LABEL = "（待标注）"


def pack_stats(messages: DataFrame, by: str = "source_id") -> DataFrame:
    """(by, message_count, start, end, by_role): ISO times of the first and last message, and counts by role."""
    roles = messages.groupBy(by, "role").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    by_role = F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "n")))).alias("by_role")
    return roles.groupBy(by).agg(F.sum("n").alias("message_count"), times.iso_text(F.min("lo")).alias("start"), times.iso_text(F.max("hi")).alias("end"), by_role)


def _meta_json(meta: Column) -> Column:
    """The meta struct as JSON without nulls, its keys in camel case."""
    return F.to_json(F.struct(*(meta[k].alias(camel(k)) for k in META_FIELDS)))


def _fixed(**values: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())), {"ignoreNullFields": "false"})


def message_json(messages: DataFrame) -> DataFrame:
    """(source_id, pos, line): type, ts, role, text, and meta where there is one."""
    line = _fixed(type=F.lit("message"), ts=F.col("ts_ms"), role=F.col("role"), text=F.col("text"))
    with_meta = F.concat(F.substring(line, F.lit(1), F.length(line) - 1), F.lit(',"meta":'), _meta_json(F.col("meta")), F.lit("}"))
    return messages.select("source_id", "pos", F.when(F.col("meta").isNull(), line).otherwise(with_meta).alias("line"))


def full_jsonl(messages: DataFrame, created_at: str, source: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Each pack's lines (source_id, pos, line): at -1 the line that describes the pack, then the messages.

    ``sources`` names packs that may be without messages.
    """
    stats = pack_stats(messages)
    if sources is not None:
        stats = sources.select("source_id").distinct().join(stats, "source_id", "left")
    struct = lambda values: F.struct(*(F.lit(v).alias(k) for k, v in values.items()))
    shown = F.struct(F.coalesce("message_count", F.lit(0)).alias("messageCount"), F.struct("start", "end").alias("timeSpan"), F.coalesce("by_role", F.create_map().cast("map<string,bigint>")).alias("byRole"))
    parts = [F.lit("pack-meta").alias("type"), F.lit(SCHEMA_VERSION).alias("schemaVersion"), struct(GENERATOR).alias("generator"), F.lit(created_at).alias("createdAt"), struct(FIELDS).alias("fields"), shown.alias("stats")]
    if source:
        parts.append(F.lit(source).alias("source"))
    head = stats.select("source_id", F.lit(-1).cast("bigint").alias("pos"), F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("line"))
    return head.unionByName(message_json(messages))


def messages_jsonl(messages: DataFrame) -> DataFrame:
    """(source_id, pos, line): ts, role, content."""
    return messages.select("source_id", "pos", _fixed(ts=F.col("ts_ms"), role=F.col("role"), content=F.col("text")).alias("line"))


def role_label(role: Column, speaker: Column) -> Column:
    out = F.lit(OTHER_LABEL)
    for name, label in ROLE_LABELS.items():
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return F.coalesce(speaker, out)


def timeline(messages: DataFrame, span: int = 4096) -> DataFrame:
    """(source_id, pos, part, line): the Markdown timeline, with a heading where the date differs from the message before.

    The message before is the last of the block before for the first of a block, so no source is one task's work.
    """
    rows = dense_positions(messages, "source_id", "pos", span)
    date = F.coalesce(F.date_format(times.stamp(F.col("ts_ms")), "yyyy-MM-dd"), F.lit(UNKNOWN_TIME))
    rows = rows.withColumns({"_date": date, "_b": F.floor(F.col("_i") / span)})
    handed = F.explode(F.when(F.col("_i") % span == span - 1, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array("_b")))
    spread = rows.withColumn("_at", handed)
    before = F.lag("_date").over(Window.partitionBy("source_id", "_at").orderBy("_i"))
    dated = spread.withColumn("_new", ~before.eqNullSafe(F.col("_date"))).where(F.col("_at") == F.col("_b"))
    clock = F.coalesce(F.date_format(times.stamp(F.col("ts_ms")), "HH:mm:ss"), F.lit("--:--"))
    said = F.concat(F.lit("- **"), clock, F.lit("** "), role_label(F.col("role"), F.col("meta.speaker")), F.lit("："), F.col("text"))
    lines = F.when(F.col("_new"), F.array(F.concat(F.lit("## "), "_date"), F.lit(""), said)).otherwise(F.array(said))
    return dated.select("source_id", "pos", F.posexplode(lines).alias("part", "line"))


#: The labels of the Markdown head.
HEAD = {"generator": "- 生成器：", "created": "- 生成时间：", "messages": "- 消息数：", "span": "- 时间跨度：", "roles": "- 角色分布：", "source": "- 来源："}


def markdown(messages: DataFrame, created_at: str, title: str = "记忆包", source: str | None = None) -> DataFrame:
    """(source_id, pos, part, line): title and statistics at -1, then the timeline."""
    roles = F.array_join(F.transform(F.map_entries("by_role"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " / ")
    head = [
        F.lit(f"# {title}"), F.lit(""), F.lit(f"{HEAD['generator']}{GENERATOR['name']} v{GENERATOR['version']}"), F.lit(f"{HEAD['created']}{created_at}"),
        F.concat(F.lit(HEAD["messages"]), F.col("message_count").cast("string")),
        F.concat(F.lit(HEAD["span"]), F.coalesce("start", F.lit(UNKNOWN)), F.lit(" ~ "), F.coalesce("end", F.lit(UNKNOWN))),
        F.concat(F.lit(HEAD["roles"]), roles), *([F.lit(f"{HEAD['source']}{source}")] if source else []), F.lit(""),
    ]
    top = pack_stats(messages).select("source_id", F.lit(-1).cast("bigint").alias("pos"), F.posexplode(F.array(*head)).alias("part", "line"))
    return top.unionByName(timeline(messages))


def write_pack(messages: DataFrame, folder: str, created_at: str, prefix: str = "pack", source: str | None = None) -> list[str]:
    """Write the three forms below ``folder`` as text, one folder for each form and pack, lines in order; returns the paths."""
    forms = {"pack.jsonl": full_jsonl(messages, created_at, source), "messages.jsonl": messages_jsonl(messages), "md": markdown(messages, created_at, source=source)}
    paths = []
    for suffix, lines in forms.items():
        order = [c for c in ("source_id", "pos", "part") if c in lines.columns]
        # Ranges of the order are files in order; a pack that fits in one range is one file.
        lines.repartitionByRange(*order).sortWithinPartitions(*order).select("source_id", F.col("line").alias("value")).write.partitionBy("source_id").mode("overwrite").text(path := f"{folder}/{prefix}.{suffix}")
        paths.append(path)
    return paths


def even_sample(rows: DataFrame, n: int, by: str = "source_id", order: str = "pos") -> DataFrame:
    """n rows of each source at even distances (number i of n is row floor(i * rows / n)); all rows where there are no more."""
    dense = dense_positions(rows, by, order)
    # row r is taken if some i has floor(i * rows / n) = r: the least such i is ceil(r * n / rows)
    i = F.ceil(F.col("_i") * n / F.col("_n"))
    taken = (F.col("_n") <= n) | ((i < n) & (F.floor(i * F.col("_n") / n) == F.col("_i")))
    return dense.where(taken).select(*rows.columns)
