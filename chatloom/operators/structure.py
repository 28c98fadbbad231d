"""Structuring: cleaned segments and raw messages as the unified table (source_id, pos, ts_ms, role, text, meta)."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from chatloom.functions import text as T
from chatloom.functions import times
from chatloom.functions.jsonx import extract_json
from chatloom.functions.patterns import longest_of
from chatloom.functions.rows import dense_positions, one_of
from chatloom.operators.ledger import answered
from chatloom.schemas import META, META_FIELDS, ROLES, camel, meta, meta_with
from chatloom.storage import written

#: Fixed value: a segment's header: name, month-day, time; the seconds may be missing.
HEADER = rf"\A([^\s:：][^\s:：]{{0,19}})[{T.SPACES}]*[:：][{T.SPACES}]*(\d{{1,2}})-(\d{{1,2}})[{T.SPACES}]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?[{T.SPACES}]*\z"


def normal_role(role: Column) -> Column:
    """One of the four roles, else null."""
    return one_of(role, ROLES)


def longest_alias(speaker: Column, aliases: Mapping[str, str]) -> Column:
    """The longest alias that the speaker's name contains; of equally long ones the first declared; else null."""
    return longest_of(speaker, aliases)["pattern"]


def match_alias(speaker: Column, aliases: Mapping[str, str]) -> Column:
    """The role of the longest alias in a name, or null."""
    return longest_of(speaker, aliases)["value"]


def parse_header(header: Column, year: Column) -> tuple[Column, Column, Column]:
    """Speaker, time and the time as written, of a header; all null where it does not parse."""
    h = T.trim(header)
    ok, part = h.rlike(HEADER), lambda i: F.regexp_extract(h, HEADER, i)
    number = lambda i: F.when(ok, F.when(part(i) == "", "0").otherwise(part(i)).cast("int"))
    raw = F.concat(part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.when(part(6) != "", F.concat(F.lit(":"), part(6))).otherwise(""))
    return F.when(ok, part(1)), times.header_ms(year, number(2), number(3), number(4), number(5), number(6)), F.when(ok, raw)


def raw_messages(rows: DataFrame) -> DataFrame:
    """Messages of a caller's own (source_id, pos, role, text; ts_ms or ts, and meta, if there are any) as the raw schema.

    A time is a number or text of epoch milliseconds, or a date. ``meta`` may be a map of strings, JSON text or VARIANT; its
    fields are known by their names in snake or camel case, and all others are kept as JSON text in ``extra``. A meta struct
    of the schema stays.
    """
    types = dict(rows.dtypes)
    at = next((c for c in ("ts_ms", "ts") if c in types), None)
    ts = F.lit(None).cast("bigint") if at is None else times.parse_ts(F.col(at)) if types[at] == "string" else F.col(at).cast("bigint")
    role = F.col("role") if "role" in types else F.lit(None).cast("string")
    if "meta" not in types:
        known = meta()
    elif types["meta"].startswith("struct"):
        held = {f.name for f in rows.schema["meta"].dataType}
        known = meta(**{c: F.col("meta")[c] for c in META_FIELDS if c in held})
    else:
        value = {"variant": F.col("meta"), "string": F.try_parse_json("meta")}.get(types["meta"], F.to_variant_object("meta"))
        named = lambda c: F.coalesce(*(F.try_variant_get(value, f"$.{n}", META_FIELDS[c]) for n in dict.fromkeys((c, camel(c)))))
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        others = F.map_filter(fields, lambda k, _: ~k.isin(sorted({n for c in META_FIELDS for n in (c, camel(c))})))
        known = meta(**{c: named(c) for c in META_FIELDS if c != "extra"}, extra=F.coalesce(named("extra"), F.when(F.size(others) > 0, F.to_json(others))))
    return rows.select("source_id", F.col("pos").cast("bigint").alias("pos"), role.alias("role"), "text", ts.alias("ts_ms"), known.alias("meta"))


def structure_raw(raw: DataFrame, default_role: str = "unlabeled") -> DataFrame:
    """Raw messages (role, text, a time, meta: see ``raw_messages``) with one of the four roles; another role is kept as
    ``original_role``."""
    raw = raw_messages(raw)
    known = normal_role(F.col("role"))
    old = F.coalesce("meta.original_role", F.when(known.isNull(), F.col("role")))
    return raw.select("source_id", "pos", "ts_ms", F.coalesce(known, F.lit(default_role)).alias("role"), "text", meta_with(F.col("meta"), source=F.lit("structured"), original_role=old).alias("meta"))


def structure_segments(segments: DataFrame, aliases: Mapping[str, str] | None = None, default_role: str = "unlabeled", base_year: int | None = None) -> DataFrame:
    """Cleaned segments as messages, with ``pending`` where a person has yet to name the role.

    A segment that came from a structured message (``has_ref``) gets its role, time and meta back with the cleaned text. One
    with a header is parsed and its speaker matched to the aliases. The rest have the default role.
    """
    year = F.lit(base_year) if base_year else F.year(F.current_timestamp())
    speaker, ts, raw_time = parse_header(F.col("header"), year)
    segments = segments.withColumn("_alias", longest_of(speaker, aliases or {}))  # both of it, found once
    alias, matched = F.col("_alias.pattern"), F.col("_alias.value")
    headed = F.col("header").isNotNull()
    has_ref = F.col("has_ref") if "has_ref" in segments.columns else F.lit(False)
    ref_role, ref_ts, ref_meta = (F.col(c) if c in segments.columns else F.lit(None).cast(t) for c, t in (("role", "string"), ("ts_ms", "bigint"), ("meta", META)))
    pending = ~has_ref & (~headed | matched.isNull())
    own = meta(source=F.lit("segment"), speaker=speaker, raw_time=raw_time, role_matched=alias, pending_label=F.when(pending, True))
    known = normal_role(ref_role)
    kept = meta_with(ref_meta, source=F.lit("structured"), original_role=F.coalesce(ref_meta["original_role"], F.when(known.isNull(), ref_role)))
    role = F.when(has_ref, F.coalesce(known, F.lit(default_role))).when(headed, F.coalesce(matched, F.lit(default_role))).otherwise(F.lit(default_role))
    return segments.select("source_id", "pos", F.when(has_ref, ref_ts).when(headed, ts).alias("ts_ms"), role.alias("role"), "text", F.when(has_ref, kept).otherwise(own).alias("meta"), pending.alias("pending"))


#: Lines that go to a provider in one call.
LINE_BATCH = 60
ROLE_PROMPT = (
    "Below are numbered lines of a chat. Return a JSON array with one object for each message, in order: "
    '{"role": "user" | "assistant" | "system" | "unlabeled", "text": the line\'s text without a number}. JSON only.'
)


@F.pandas_udf(ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())])))
def _labelled(replies: pd.Series) -> pd.Series:
    """The messages of a reply that is a JSON array, those of the right shape; null for any other reply."""

    def one(reply: str | None) -> list[dict] | None:
        found = None if reply is None else extract_json(reply)
        if not isinstance(found, list):
            return None
        good = [x for x in found if isinstance(x, dict) and isinstance(x.get("text"), str) and x["text"]]
        return [{"role": x["role"] if isinstance(x.get("role"), str) else None, "text": x["text"]} for x in good]

    return replies.map(one)


def structure_lines(docs: DataFrame, provider=None, ledger: str | None = None) -> DataFrame:
    """Plain texts (source_id, text) as messages, one for each line that is not empty, all of unknown role.

    With a provider (a function that makes an object with ``chat(system, user)``), batches of 60 lines are sent to it, and
    its JSON array of (role, text) takes the lines' place; a reply without an array, or a call that fails, leaves the batch as
    lines. The provider is called when this is called; with a ``ledger`` folder only for what has no reply there.
    """
    lines = docs.select("source_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    if provider is None:
        plain = meta(source=F.lit("plaintext"), pending_label=F.lit(True))
        return lines.select("source_id", "pos", F.lit(None).cast("bigint").alias("ts_ms"), F.lit("unlabeled").alias("role"), "text", plain.alias("meta"), F.lit(True).alias("pending"))

    # Sixty lines of a batch.
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    calls = lines.groupBy("source_id", F.floor(F.col("pos") / LINE_BATCH).alias("batch")).agg(texts.alias("lines")).withColumn("system", F.lit(ROLE_PROMPT))
    asked = answered(calls.withColumn("user", F.array_join(F.transform("lines", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")), provider, ledger)
    known = asked.withColumn("found", _labelled("reply"))
    rows = F.when(F.col("found").isNotNull(), F.transform("found", lambda x, k: F.struct(k.cast("long").alias("k"), x["role"].alias("role"), x["text"].alias("text"), F.lit(True).alias("labelled")))).otherwise(
        F.transform("lines", lambda t, k: F.struct(k.cast("long").alias("k"), F.lit(None).cast("string").alias("role"), t.alias("text"), F.lit(False).alias("labelled")))
    )
    batches = written(known.select("source_id", "batch", F.inline(rows)))
    role = F.coalesce(normal_role(F.col("role")), F.lit("unlabeled"))
    pending = ~F.col("labelled")
    # A reply may have more messages than the batch had lines, so places are counted from the replies.
    numbered = dense_positions(batches.withColumn("_p", F.col("batch") * 1_000_000 + F.col("k")), "source_id", "_p", 1_000_000)
    labelled = meta(source=F.lit("plaintext"), llm_role_label=F.when(F.col("labelled"), True), line_batch=F.col("batch"), pending_label=F.when(pending, True))
    return numbered.select("source_id", F.col("_i").alias("pos"), F.lit(None).cast("bigint").alias("ts_ms"), role.alias("role"), "text", labelled.alias("meta"), pending.alias("pending"))


def structure_stats(messages: DataFrame, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """(…by, total, by_role, pending_label, llm_assisted)."""
    pending = F.col("pending") if "pending" in messages.columns else F.coalesce("meta.pending_label", F.lit(False))
    roles = messages.select(*by, F.coalesce("role", F.lit("unlabeled")).alias("role"), pending.alias("p"), F.coalesce("meta.llm_role_label", F.lit(False)).alias("l"))
    counts = roles.groupBy(*by, "role").agg(F.count(F.lit(1)).alias("n"), F.count_if("p").alias("p"), F.count_if("l").alias("l"))
    by_role = F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "n")))).alias("by_role")
    return counts.groupBy(*by).agg(F.sum("n").alias("total"), by_role, F.sum("p").alias("pending_label"), F.sum("l").alias("llm_assisted"))


def source_stats(raw: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(source_id, total, by_role, pending_label, llm_assisted, skipped) of what an adapter read."""
    stats = structure_stats(raw)
    if skipped is None:
        return stats.withColumn("skipped", F.lit(0).cast("bigint"))
    joined = stats.join(skipped, "source_id", "full")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("total", "pending_label", "llm_assisted", "skipped")}
    return joined.withColumns({**zero, "by_role": F.coalesce("by_role", F.create_map().cast("map<string,bigint>"))})
