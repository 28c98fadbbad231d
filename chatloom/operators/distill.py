"""Distilling: ISO-week batches, transcripts within a budget, and what a model provider makes of them."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from chatloom.functions import text as T
from chatloom.functions import times
from chatloom.functions.jsonx import extract_json
from chatloom.functions.rows import dense_positions
from chatloom.operators.ledger import answered
from chatloom.storage import written

#: UTF-16 units of a week's transcript, lines of a review batch, and what stands for no time.
WEEK_CHARS, REVIEW_BATCH, UNKNOWN_TIME = 12_000, 40, "未知时间"
#: What stands before and behind the number of messages that a transcript leaves out.
LEFT_OUT = ("（另有 ", " 条消息因长度上限未纳入转录）")


class Provider(Protocol):
    """Anything that answers a prompt. Operators take a function that makes one, so that it can be sent to executors."""

    name: str

    def chat(self, system: str, user: str) -> str: ...


@dataclass
class HttpProvider:
    """A provider with the usual chat-completions interface over HTTP."""

    endpoint: str
    api_key: str
    model: str
    timeout: float = 60.0
    temperature: float = 0.2
    post: Callable[[str, Mapping[str, str], bytes, float], bytes] | None = None

    @property
    def name(self) -> str:
        return urlparse(self.endpoint).hostname or self.endpoint

    def body(self, system: str, user: Any) -> dict:
        return {"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}

    def chat(self, system: str, user: Any) -> str:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        url, data = self.endpoint.rstrip("/") + "/chat/completions", json.dumps(self.body(system, user)).encode()
        if self.post:
            reply = self.post(url, headers, data, self.timeout)
        else:
            with urllib.request.urlopen(urllib.request.Request(url, data, dict(headers)), timeout=self.timeout) as r:
                reply = r.read()
        return json.loads(reply)["choices"][0]["message"]["content"] or ""


@dataclass
class HttpVisionProvider(HttpProvider):
    """The same interface with a picture in the message."""

    timeout: float = 90.0
    temperature: float = 0.1

    def see(self, prompt: str, data_uri: str) -> str:
        return self.chat(prompt, [{"type": "image_url", "image_url": {"url": data_uri}}])


#: The variables of the environment that name a provider, in order: prefix, default endpoint and model, and
#: whether the environment may change these two.
ENV = (
    ("MEMORY_LLM", "https://api.deepseek.com", "deepseek-chat", True),
    ("DEEPSEEK", "https://api.deepseek.com", "deepseek-chat", False),
    ("OPENAI", "https://api.openai.com/v1", "gpt-4o-mini", True),
)


def provider_from_env(env: Mapping[str, str] = os.environ) -> HttpProvider | None:
    """The first provider of which the environment has a key, or None."""
    for prefix, endpoint, model, free in ENV:
        if key := env.get(f"{prefix}_API_KEY"):
            own = {k: env.get(f"{prefix}_{k}") for k in ("BASE_URL", "MODEL")} if free else {}
            return HttpProvider(own.get("BASE_URL") or endpoint, key, own.get("MODEL") or model)
    return None


def with_week(messages: DataFrame) -> DataFrame:
    return messages.withColumn("week", times.iso_week(F.col("ts_ms")))


def week_batches(messages: DataFrame) -> DataFrame:
    """(source_id, week, start, end, messages): first and last date and the number of messages of each week."""
    day = F.date_format(times.stamp(F.col("ts_ms")), "yyyy-MM-dd")
    found = with_week(messages).groupBy("source_id", "week").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("messages"))
    return found.withColumns({c: F.coalesce(c, F.lit(UNKNOWN_TIME)) for c in ("start", "end")})


def in_week_order(rows: DataFrame) -> DataFrame:
    """Rows (source_id, week, ...) by source and week, ``unknown`` last."""
    return rows.orderBy("source_id", F.col("week") == "unknown", "week")


def transcript_line() -> Column:
    return F.concat(times.plain_text(F.col("ts_ms")), F.lit(" "), "role", F.lit(": "), "text")


def may_fit(rows: DataFrame, budget: int, span: int = 4096) -> DataFrame:
    """Of rows (source_id, week, pos, line, len) those that can be in a transcript, and ``n``, the rows they stand for.

    What is used of the budget never falls; so of a week's lines of one length those that are taken are the first ones, and
    at most as many as the budget holds. They are picked within blocks of positions, then within blocks of blocks, so that no
    task sees all lines of a week. Lines that never fit (len is null) are only counted.
    """
    out = rows.withColumns({"len": F.when(F.col("len") <= budget, F.col("len")), "line": F.when(F.col("len") <= budget, F.col("line")), "n": F.lit(1).cast("long")})
    for width in (span, span * span, None):
        same = Window.partitionBy("source_id", "week", "len", *([F.floor(F.col("pos") / width)] if width else []))
        placed = out.withColumns({"_at": F.row_number().over(same.orderBy("pos", "line")), "_rows": F.sum("n").over(same)})
        picked = placed.where((F.col("_at") == 1) | (F.col("_at") * F.col("len") <= budget))
        out = picked.withColumn("n", F.when(F.col("_at") == 1, F.col("_rows")).otherwise(0)).drop("_at", "_rows")
    return out


def transcripts(messages: DataFrame, budget: int = WEEK_CHARS) -> DataFrame:
    """(source_id, week, transcript, taken, left_out): lines in order while they fit; a line that does not is skipped.

    Gathered for a week are the lines that ``may_fit``: about budget * ln(budget) at most, however many the week has.
    """
    rows = with_week(messages).select("source_id", "week", "pos", transcript_line().alias("line"))
    rows = may_fit(rows.withColumn("len", T.utf16_length(F.col("line"))), budget)
    lines = F.sort_array(F.collect_list(F.when(F.col("len").isNotNull(), F.struct("pos", "len", "line"))))
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("lines"))
    fold = F.aggregate(lines, empty, lambda a, x: F.when(a["used"] + x["len"] <= budget, F.struct((a["used"] + x["len"]).alias("used"), F.array_append(a["lines"], x["line"]).alias("lines"))).otherwise(a))
    week = rows.groupBy("source_id", "week").agg(fold.alias("f"), F.sum("n").alias("n"))
    left_out = F.col("n") - F.size("f.lines")
    note = F.when(left_out > 0, F.array(F.concat(F.lit(LEFT_OUT[0]), left_out.cast("string"), F.lit(LEFT_OUT[1])))).otherwise(F.array().cast("array<string>"))
    return week.select("source_id", "week", F.array_join(F.concat("f.lines", note), "\n").alias("transcript"), F.size("f.lines").cast("long").alias("taken"), left_out.alias("left_out"))


def shape_of(value: Column, fields: Mapping[str, tuple[str, bool]]) -> Column:
    """Whether a VARIANT object has these fields: name = (type, may be missing). Types: string, number, number?, or a|b|c."""
    out = F.schema_of_variant(value).startswith("OBJECT")
    for name, (kind, optional) in fields.items():
        part = F.try_variant_get(value, f"$.{name}", "variant")
        seen = F.schema_of_variant(part)
        if kind == "string":
            fits = seen == "STRING"
        elif kind in ("number", "number?"):
            fits = seen.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
            fits = fits | (seen == "VOID") if kind == "number?" else fits
        else:
            fits = (seen == "STRING") & F.try_variant_get(value, f"$.{name}", "string").isin(kind.split("|"))
        out = out & (F.when(part.isNull(), F.lit(optional)).otherwise(fits))
    return F.coalesce(out, F.lit(False))


#: The shapes of what a provider returns.
SHAPES = {
    "anchor": {"date": ("string", False), "event": ("string", False), "ts": ("number?", True), "importance": ("number", True)},
    "long_term": {"text": ("string", False), "category": ("identity|relationship|core_fact", True)},
    "notebook": {"text": ("string", False), "score": ("number", True), "category": ("string", True), "reason": ("string", True)},
    "profile": {"dimension": ("preferences|personality|habits", False), "key": ("string", False), "value": ("string", False)},
}


def items_of_shape(texts: Column, shape: str, at: str = "$") -> Column:
    """The items of a JSON array (at a path) that have a shape, as VARIANT values."""
    items = F.try_variant_get(F.try_parse_json(texts), at, "array<variant>")
    return F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda v: shape_of(v, SHAPES[shape]))


SUMMARY_PROMPT = 'Summarise this week of a conversation in a few sentences. Reply with JSON: {"summary": "..."}'
ANCHOR_PROMPT = 'List the dated events of this week that matter later. Reply with JSON: {"anchors": [{"date": "YYYY-MM-DD", "ts": epoch ms or null, "event": "...", "importance": 1-5}]}'
LAYER_PROMPT = (
    "From these weekly summaries and events, sort what should be remembered. Reply with JSON: "
    '{"longTerm": [{"text", "category": identity | relationship | core_fact}], "notebook": [{"text", "score", "category", "reason"}], '
    '"profile": [{"dimension": preferences | personality | habits, "key", "value"}]}'
)
REVIEW_PROMPT = 'These lines may still hold personal data. For each that does, return it redacted. Reply with JSON: {"hits": [{"index": number, "text": "..."}]}'


@dataclass(frozen=True)
class Distilled:
    """Tables of what was distilled; all empty where there was no provider. ``failed``: calls that no try got an answer to
    (source_id, week, call, error)."""

    skipped: bool
    reason: str | None
    summaries: DataFrame
    anchors: DataFrame
    long_term: DataFrame
    notebook: DataFrame
    profile: DataFrame
    meta: dict = field(default_factory=dict)
    failed: DataFrame | None = None


TABLES = {
    "summaries": "source_id string, week string, start string, end string, messages bigint, summary string",
    "anchors": "source_id string, week string, date string, ts bigint, event string, importance double",
    "long_term": "source_id string, text string, category string",
    "notebook": "source_id string, text string, score double, category string, reason string",
    "profile": "source_id string, dimension string, key string, value string",
}


def skipped(messages: DataFrame, reason: str) -> Distilled:
    spark = messages.sparkSession
    return Distilled(True, reason, *(spark.createDataFrame([], s) for s in TABLES.values()), {"llm_calls": 0})


def distill(messages: DataFrame, provider: Callable[[], Provider] | None, budget: int = WEEK_CHARS, ledger: str | None = None) -> Distilled:
    """Two calls for each week (summary, anchors), one for each source over all its weeks.

    Replies without usable JSON give nothing; items without the right shape are left out; calls that fail give nothing and are
    rows of ``failed``. Weeks are called side by side. ``ledger`` is a folder that keeps replies: a later run with the same
    folder asks only for what has none.
    """
    if provider is None:
        return skipped(messages, "no_provider")

    told = written(transcripts(messages, budget).select("source_id", "week", "transcript"))
    prompts = F.explode(F.array(*(F.struct(F.lit(n).alias("call"), F.lit(p).alias("system")) for n, p in (("summary", SUMMARY_PROMPT), ("anchors", ANCHOR_PROMPT)))))
    calls = told.select("source_id", "week", F.col("transcript").alias("user"), prompts.alias("p")).select("source_id", "week", "p.*", "user")
    by_call = written(answered(calls, provider, ledger))
    asked = by_call.groupBy("source_id", "week").agg(*(F.max(F.when(F.col("call") == c, F.col("reply"))).alias(c) for c in ("summary", "anchors")))
    asked = written(asked.select("source_id", "week", _json_text("summary").alias("summary_reply"), _json_text("anchors").alias("anchor_reply")))
    weeks = week_batches(messages)
    summary = F.try_variant_get(F.try_parse_json("summary_reply"), "$.summary", "string")
    summaries = weeks.join(asked, ["source_id", "week"]).select("source_id", "week", "start", "end", "messages", F.coalesce(summary, F.lit("")).alias("summary"))
    item = asked.select("source_id", "week", F.explode(items_of_shape(F.col("anchor_reply"), "anchor", "$.anchors")).alias("v"))
    get = lambda name, kind: F.try_variant_get(F.col("v"), f"$.{name}", kind)
    anchors = item.select("source_id", "week", get("date", "string").alias("date"), get("ts", "bigint").alias("ts"), get("event", "string").alias("event"), F.coalesce(get("importance", "double"), F.lit(3.0)).alias("importance"))

    told = summaries.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("week", "summary"))), lambda x: F.concat(x["week"], F.lit(": "), x["summary"])), "\n").alias("told"))
    dated = anchors.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "event"))), lambda x: F.concat(x["date"], F.lit(" "), x["event"])), "\n").alias("dated"))

    whole = told.join(dated, "source_id", "left").select("source_id", F.lit(None).cast("string").alias("week"), F.lit("layers").alias("call"), F.lit(LAYER_PROMPT).alias("system"), F.concat("told", F.lit("\n\n"), F.coalesce("dated", F.lit(""))).alias("user"))
    by_source = written(answered(whole, provider, ledger))
    layers = written(by_source.select("source_id", _json_text("reply").alias("reply")))
    of = lambda shape, path: layers.select("source_id", F.explode(items_of_shape(F.col("reply"), shape, path)).alias("v"))
    long_term = of("long_term", "$.longTerm").select("source_id", get("text", "string").alias("text"), get("category", "string").alias("category"))
    notebook = of("notebook", "$.notebook").select("source_id", get("text", "string").alias("text"), get("score", "double").alias("score"), get("category", "string").alias("category"), get("reason", "string").alias("reason"))
    profile = of("profile", "$.profile").select("source_id", *(get(c, "string").alias(c) for c in ("dimension", "key", "value")))
    failed = by_call.unionByName(by_source).where("error is not null").select("source_id", "week", "call", "error")
    return Distilled(False, None, summaries, anchors, long_term, notebook, profile, {"llm_calls": 2 * asked.count() + layers.count()}, failed)


@F.pandas_udf(StringType())
def _json_text(replies: pd.Series) -> pd.Series:
    def one(reply: str | None) -> str | None:
        found = None if reply is None else extract_json(reply)
        return None if found is None else json.dumps(found, ensure_ascii=False)

    return replies.map(one)


@F.pandas_udf(ArrayType(StructType([StructField("index", LongType()), StructField("text", StringType())])))
def _review_hits(replies: pd.Series) -> pd.Series:
    """Numbers and new texts of a review's reply that have the right shape; the last one counts."""

    def one(reply: str | None) -> list[dict]:
        found = None if reply is None else extract_json(reply)
        hits = found.get("hits") if isinstance(found, dict) else None
        good = [h for h in hits if isinstance(h, dict) and type(h.get("index")) is int and abs(h["index"]) < 1 << 62 and isinstance(h.get("text"), str) and h["text"].strip()] if isinstance(hits, list) else []
        return [{"index": i, "text": t} for i, t in {h["index"]: h["text"] for h in good}.items()]

    return replies.map(one)


def review_redaction(segments: DataFrame, provider: Callable[[], Provider] | None, ledger: str | None = None) -> DataFrame:
    """Segments after a provider looked over batches of 40 of a source's segments in order, numbered through the source; only
    lines of a batch with a text that is not blank are replaced. The provider is called when this is called, once a batch; a
    batch whose call fails stays as it is, and a later run with the same ``ledger`` folder asks for it again."""
    if provider is None:
        return segments
    numbered = written(dense_positions(segments.select("source_id", "pos", "header", "text"), "source_id", "pos").withColumn("_batch", F.floor(F.col("_i") / REVIEW_BATCH)))
    line = F.concat(F.lit("#"), F.col("_i").cast("string"), F.lit("|"), F.coalesce("header", F.lit("")), F.coalesce("text", F.lit("")))
    # Forty lines of a batch.
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", line.alias("line")))), lambda x: x["line"]), "\n")
    calls = numbered.groupBy("source_id", "_batch").agg(shown.alias("user")).withColumn("system", F.lit(REVIEW_PROMPT))
    hits = written(answered(calls, provider, ledger).where("reply is not null").select("source_id", "_batch", F.inline(_review_hits("reply"))))
    new = numbered.join(hits.withColumnsRenamed({"text": "new_text", "source_id": "_s", "_batch": "_b"}), F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("_batch") == F.col("_b")) & (F.col("_i") == F.col("index")))
    new = new.select(F.col("source_id").alias("_s"), F.col("pos").alias("_p"), "new_text")
    return segments.join(new, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("pos") == F.col("_p")), "left").withColumn("text", F.coalesce("new_text", "text")).select(*segments.columns)
