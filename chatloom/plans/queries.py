"""The registered queries of the chat-archive operators, with DuckDB SQL for the same results.

The driver's tables stand in for chat archives: lines of ``documents`` are segments (a language is a source), ``events`` are
timed messages, ``pages`` are saved pages, and ``conversations`` are written as each kind of export and read back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.functions import times
from chatloom.functions.patterns import longest_of
from chatloom.operators import clean as C
from chatloom.operators import distill as D
from chatloom.operators import pack as P
from chatloom.operators import structure as S
from chatloom.plans.pipeline import run_pipeline
from chatloom.schemas import meta
from chatloom.sources import json_exports as J
from chatloom.sources import texts as X
from chatloom.sources.ranges import read_items, read_lines
from chatloom.sources.registry import convert_files, sniff_texts
from chatloom.storage import new_folder
from chatloom.streaming.arrivals import convert_arrivals, converted_arrivals
from chatloom.streaming.weekly import weekly_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Lines of one document are at most this many positions apart; blocks of positions hold 64 documents.
LINES, BLOCK = 1 << 20, 1 << 26
NOISE = (C.NoiseRule("contains", "Released under"), C.NoiseRule("exact", "The."), C.NoiseRule("regex", r"^[A-Z][a-z]{0,2}\.$"), *C.DEFAULT_NOISE)
REDACTIONS = (
    C.RedactionRule("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "[email]"),
    C.RedactionRule("ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[ip]"),
    C.RedactionRule("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}", "[phone $1]"),
    C.RedactionRule("card", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "[card]"),
    C.RedactionRule("first_number", r"\d+", "#", "i"),
)
CONFIG = C.CleanConfig(noise_rules=NOISE, redaction_rules=REDACTIONS)


def query(sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str, source: str = "lang") -> DataFrame:
    """Lines of documents as segments: source_id, pos, header, text, doc_id, line_no."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col(source).alias("source_id"), "doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "text"))
    return lines.select("source_id", (F.col("doc_id") * LINES + F.col("line_no")).alias("pos"), F.lit(None).cast("string").alias("header"), "text", "doc_id", F.col("line_no").cast("bigint").alias("line_no"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: a type of event is a source."""
    events = table(spark, sf_dir, "events")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    role = F.when(F.col("user_id") % 3 == 0, "user").when(F.col("user_id") % 3 == 1, "assistant").otherwise("unlabeled")
    ts = F.when(F.col("event_id") % 50 != 7, ts)
    return events.select(F.col("event_type").alias("source_id"), F.col("event_id").alias("pos"), ts.alias("ts_ms"), role.alias("role"), F.col("props").alias("text"), meta(source=F.lit("events")).alias("meta"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages, a minute from turn to turn."""
    chats = table(spark, sf_dir, "conversations")
    return chats.select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("pos"), (F.lit(1_750_000_000_000) + F.col("conv_id") * 86_400_000 + F.col("turn") * 60_000).alias("ts_ms"), "role", "text", meta(source=F.lit("chats")).alias("meta"))


def _json(value: dict) -> str:
    """A dictionary as JSON inside a SQL string."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).replace("'", "''")


LINES_SQL = r"""
lines as (
  select doc_id, lang, unnest(range(len(l))) as line_no, unnest(l) as text
  from (select *, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') as l from documents))"""
QUIET_SQL = LINES_SQL + r""",
quiet as (
  select * from lines where not (contains(text, 'Released under') or text = 'The.' or regexp_matches(text, '^[A-Z][a-z]{0,2}\.$')
    or regexp_matches(text, '钻石余额不足|请充值后继续使用|消息发送失败|对方已下线|网络连接已断开|签到成功，获得')
    or text in ('4G', '5G', 'Wi-Fi', '正在输入…', '[系统消息]') or regexp_matches(text, '^\d{1,3}$')))"""
UNIQUE_SQL = QUIET_SQL + r""",
numbered as (
  select *, row_number() over (partition by lang order by doc_id, line_no) as i, count(*) over (partition by lang) as n,
    left(sha256(lower(regexp_replace(text, '\s+', '', 'g'))), 16) as fp, length(text) < 4 as short from quiet),
windows as (
  select lang, i, n, string_agg(fp, '') over w as k, count(*) over w as size, bool_and(short) over w as all_short
  from numbered window w as (partition by lang order by i rows between current row and 4 following)),
marked as (
  select lang, i, i > min(i) over (partition by lang, k) as again from windows where size = 5 and not all_short and n >= 10),
gone as (select distinct lang, i + d as i from marked, unnest(range(5)) as u(d) where again),
uniq as (select * from numbered anti join gone using (lang, i))"""
REDACT_SQL = UNIQUE_SQL + r""",
r1 as (select *, len(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}')) as h1, regexp_replace(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}', '[email]', 'g') as t1 from uniq),
r2 as (select *, len(regexp_extract_all(t1, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) as h2, regexp_replace(t1, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '[ip]', 'g') as t2 from r1),
r3 as (select *, len(regexp_extract_all(t2, '\+1 \(\d{3}\) \d{3}-\d{4}')) as h3, regexp_replace(t2, '\+1 \(\d{3}\) \d{3}-\d{4}', '[phone $1]', 'g') as t3 from r2),
r4 as (select *, len(regexp_extract_all(t3, '\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b')) as h4, regexp_replace(t3, '\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b', '[card]', 'g') as t4 from r3),
r5 as (select *, least(len(regexp_extract_all(t4, '\d+')), 1) as h5, regexp_replace(t4, '\d+', '#') as t5 from r4)"""
EVENTS_SQL = """
messages as (
  select event_type as source_id, event_id as pos, case when event_id % 50 <> 7 then epoch_ms(ts) end as ts_ms, case when event_id % 50 <> 7 then ts end as t,
    case user_id % 3 when 0 then 'user' when 1 then 'assistant' else 'unlabeled' end as role, props as text from events)"""


@query(f"with {LINES_SQL} select doc_id, line_no, text from lines")
def chat_lines(spark, sf_dir):
    """Trimmed lines of every document."""
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", "text")


@query(f"with {QUIET_SQL} select doc_id, line_no, text from quiet")
def chat_noise_filter(spark, sf_dir):
    """Lines that no noise rule drops."""
    return C.drop_noise(doc_lines(spark, sf_dir), NOISE).select("doc_id", "line_no", "text")


@query(f"with {UNIQUE_SQL} select lang as source_id, doc_id, line_no, text from uniq")
def chat_window_dedup(spark, sf_dir):
    """Lines that are left when windows of five that came before in the language are taken out."""
    quiet = C.drop_noise(doc_lines(spark, sf_dir), NOISE)
    return C.dedupe(quiet, pos_span=BLOCK).select("source_id", "doc_id", "line_no", "text")


@query(f"with {REDACT_SQL} select doc_id, line_no, t5 as text, h1 + h2 + h3 + h4 + h5 as n_hits from r5")
def chat_redaction(spark, sf_dir):
    """Cleaned lines with every rule applied in turn, and the number of hits."""
    cleaned = C.clean(doc_lines(spark, sf_dir), CONFIG, BLOCK).segments
    return cleaned.select("doc_id", "line_no", "text", F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_hits"))


@query(
    f"""with {REDACT_SQL}, hits as (
  select lang as source_id, unnest(['email', 'ipv4', 'phone', 'card', 'first_number']) as rule, unnest([sum(h1), sum(h2), sum(h3), sum(h4), sum(h5)])::bigint as hits from r5 group by lang)
select source_id, rule, hits from hits where hits > 0"""
)
def chat_redaction_hits(spark, sf_dir):
    """Hits of each rule in each language."""
    cleaned = C.clean(doc_lines(spark, sf_dir), CONFIG, BLOCK)
    return C.redaction_hits(cleaned.segments, REDACTIONS, ("source_id",))


@query(
    f"""with {REDACT_SQL},
hits as (
  select lang, concat_ws(' ', case when sum(h4) > 0 then 'card=' || sum(h4) end, case when sum(h1) > 0 then 'email=' || sum(h1) end, case when sum(h5) > 0 then 'first_number=' || sum(h5) end,
    case when sum(h2) > 0 then 'ipv4=' || sum(h2) end, case when sum(h3) > 0 then 'phone=' || sum(h3) end) as redaction_hits from r5 group by lang)
select lang as source_id, count(*) as input_segments, count(*) - count(q.doc_id) as noise_removed, count(q.doc_id) - count(n.doc_id) as dedup_removed, count(n.doc_id) as output_segments, any_value(h.redaction_hits) as redaction_hits
from lines l left join quiet q using (doc_id, line_no, lang) left join uniq n using (doc_id, line_no, lang) left join hits h using (lang) group by lang"""
)
def chat_clean_stats(spark, sf_dir):
    """What cleaning took out of each language, step by step, and the hits of each rule; read from what cleaning wrote."""
    stats = C.clean(doc_lines(spark, sf_dir), CONFIG, BLOCK).written().stats()
    told = F.transform(F.array_sort(F.map_entries("redaction_hits")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return stats.withColumn("redaction_hits", F.array_join(told, " "))


@query(f"with {REDACT_SQL} select lang as source_id, count(*) as segments, sum(length(t5))::bigint as chars, sum(h1 + h2 + h3 + h4 + h5)::bigint as hits from r5 group by lang")
def chat_clean_by_lang(spark, sf_dir):
    """The flagship: lines through noise filter, window de-duplication and redaction, summed by language."""
    cleaned = C.clean(doc_lines(spark, sf_dir), CONFIG, BLOCK).segments
    hits = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return cleaned.groupBy("source_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("chars"), F.sum(hits).alias("hits"))


def rendered_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text with headers: ``name: MM-DD HH:MM:SS body``, bodies without line ends."""
    chats = table(spark, sf_dir, "conversations")
    name = F.when(F.col("role") == "user", "Ada").when(F.col("role") == "assistant", "Helper Bot").otherwise("notice")
    body = F.regexp_replace("text", r"\s+", " ")
    when = F.concat(F.lpad((F.col("conv_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":07"))
    line = F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit(": "), when, F.lit(" "), body)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return chats.groupBy("conv_id").agg(F.array_join(parts, "\n").alias("text")).select(F.col("conv_id").cast("string").alias("source_id"), "text")


ALIASES = {"Ada": "user", "Bot": "system", "Helper_Bot": "assistant"}


@query(
    r"""select conv_id::varchar as source_id, turn as pos, case when role in ('user', 'assistant') then role else 'unlabeled' end as role,
  regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') as text,
  epoch_ms(make_timestamp(2024, (conv_id % 12 + 1)::bigint, (conv_id % 28 + 1)::bigint, 10, (turn % 60)::bigint, 7.0)) as ts_ms,
  case role when 'user' then 'Ada' when 'assistant' then 'Helper_Bot' else 'notice' end as speaker, role not in ('user', 'assistant') as pending
from conversations"""
)
def chat_headers(spark, sf_dir):
    """Conversations written with headers and read back: speaker, time, and role by the longest alias."""
    segments = C.split_text(rendered_chats(spark, sf_dir))
    messages = S.structure_segments(segments, ALIASES, base_year=2024)
    return messages.select("source_id", "pos", "role", "text", "ts_ms", F.col("meta.speaker").alias("speaker"), "pending")


#: A thousand and more names, one to three letters of ten; equally long ones are told apart by their order.
NAMES = {"".join(x): ("user", "assistant", "system")[i % 3] for i, x in enumerate(x for n in (3, 1, 2) for x in product("etaoinshrd", repeat=n))}


@query(
    """with letters as (select unnest(string_split('e t a o i n s h r d', ' ')) as c, unnest(range(10)) as i),
names as (
  select x.c || y.c || z.c as name, x.i * 100 + y.i * 10 + z.i as k from letters x, letters y, letters z
  union all select c, 1000 + i from letters union all select x.c || y.c, 1010 + x.i * 10 + y.i from letters x, letters y),
hit as (
  select conv_id, turn, arg_min(struct_pack(name := name, k := k), -length(name) * 10000 + k) as h
  from conversations join names on contains(regexp_extract(text, '^.{0,20}', 0, 's'), name) group by conv_id, turn)
select conv_id, turn, h.name as alias, case h.k % 3 when 0 then 'user' when 1 then 'assistant' when 2 then 'system' end as role
from conversations left join hit using (conv_id, turn)"""
)
def chat_alias_many(spark, sf_dir):
    """The longest of 1,110 names in the first twenty characters of each turn, and its role."""
    chats = table(spark, sf_dir, "conversations").withColumn("hit", longest_of(F.substring("text", 1, 20), NAMES))
    return chats.select("conv_id", "turn", F.col("hit.pattern").alias("alias"), F.col("hit.value").alias("role"))


@query(
    """select c_custkey, case when c_name like '%9%' and c_name like '%00%' then 'assistant' when c_name like '%77%' then 'system' when c_name like '%00%' then 'assistant' when c_name like '%5%' then 'user' end as role
from (select c_custkey, c_name from customer)"""
)
def chat_alias_match(spark, sf_dir):
    """The role of the longest alias in each customer's name; of aliases of one length, that of the first."""
    aliases = {"5": "user", "00": "assistant", "77": "system"}
    name = F.col("c_name")
    longest = F.when(F.contains(name, F.lit("9")) & F.contains(name, F.lit("00")), S.match_alias(name, {"00": "assistant", "9": "user"}))
    plain = S.match_alias(name, {"77": "system", **aliases})
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(longest, plain).alias("role"))


@query("select role, count(*) as n from (select case when role in ('user', 'assistant', 'system') then role else 'unlabeled' end as role from conversations) group by role")
def chat_role_counts(spark, sf_dir):
    """Messages by normalised role."""
    raw = chat_messages(spark, sf_dir)
    stats = S.structure_stats(S.structure_raw(raw).withColumn("all", F.lit("all")), ("all",))
    return stats.select(F.explode("by_role").alias("role", "n"))


@query(
    r"""with texts as (
  select 'doc' || doc_id as source_id, text, 0 as chats from documents
  union all select 'chat' || conv_id, string_agg(case role when 'user' then 'Ada' when 'assistant' then 'Helper_Bot' else 'notice' end || ': ' || lpad((conv_id % 12 + 1)::varchar, 2, '0') || '-' || lpad((conv_id % 28 + 1)::varchar, 2, '0')
    || ' 10:' || lpad((turn % 60)::varchar, 2, '0') || ':07 ' || regexp_replace(text, '\s+', ' ', 'g'), chr(10) order by turn), 1 from conversations group by conv_id),
counted as (
  select source_id, len(regexp_extract_all(text, '[^\s:：][^\s:：]{0,19}\s*[:：]\s*\d{1,2}-\d{1,2}\s+\d{1,2}:\d{2}(?::\d{2})?\s+')) as hits,
    len(list_filter(regexp_split_to_array(text, '\r?\n'), lambda v: regexp_matches(v, '\S'))) as n from texts)
select source_id, (hits >= 2 and hits / greatest(n, 1) >= 0.2) or (hits = 1 and n = 1) as headed from counted"""
)
def chat_header_mode(spark, sf_dir):
    """Whether a text is read by its headers, for documents and rendered chats."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_id"), "text")
    chats = rendered_chats(spark, sf_dir).select(F.concat(F.lit("chat"), "source_id").alias("source_id"), "text")
    return docs.unionByName(chats).select("source_id", X.header_mode(F.col("text")).alias("headed"))


@query(
    f"""with {EVENTS_SQL}
select source_id, count(*) as message_count, strftime(min(t), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as start, strftime(max(t), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as end,
  count(*) filter (role = 'user') as n_user, count(*) filter (role = 'assistant') as n_assistant, count(*) filter (role = 'unlabeled') as n_unlabeled
from messages group by source_id"""
)
def chat_pack_stats(spark, sf_dir):
    """Count, span and roles of each source's messages."""
    stats = P.pack_stats(event_messages(spark, sf_dir))
    roles = (F.coalesce(F.try_element_at("by_role", F.lit(r)), F.lit(0).cast("bigint")).alias(f"n_{r}") for r in ("user", "assistant", "unlabeled"))
    return stats.select("source_id", "message_count", "start", "end", *roles)


@query(
    """select conv_id::varchar as source_id, turn as pos, '{"ts":' || (1750000000000 + conv_id * 86400000 + turn * 60000) || ',"role":' || to_json(role) || ',"content":' || to_json(text) || '}' as line from conversations"""
)
def chat_messages_jsonl(spark, sf_dir):
    """The plain JSON Lines form."""
    return P.messages_jsonl(chat_messages(spark, sf_dir))


@query(
    """select conv_id::varchar as source_id, turn as pos, '{"type":"message","ts":' || (1750000000000 + conv_id * 86400000 + turn * 60000) || ',"role":' || to_json(role) || ',"text":' || to_json(text) || ',"meta":{"source":"chats"}}' as line
from conversations
union all
select conv_id::varchar, -1, '{"type":"pack-meta","schemaVersion":"1.0","generator":""" + _json(P.GENERATOR) + ""","createdAt":"2026-01-01T00:00:00.000Z","fields":""" + _json(P.FIELDS) + """,'
  || '"stats":{"messageCount":' || sum(n) || ',"timeSpan":{"start":"' || strftime(make_timestamp_ms(min(lo)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","end":"' || strftime(make_timestamp_ms(max(hi)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z"},'
  || '"byRole":{' || string_agg('"' || role || '":' || n, ',' order by role) || '}},"source":"chats"}'
from (select conv_id, role, count(*) as n, min(1750000000000 + conv_id * 86400000 + turn * 60000) as lo, max(1750000000000 + conv_id * 86400000 + turn * 60000) as hi from conversations group by conv_id, role) group by conv_id"""
)
def chat_pack_jsonl(spark, sf_dir):
    """The self-describing form: its first line, then the messages."""
    return P.full_jsonl(chat_messages(spark, sf_dir), "2026-01-01T00:00:00.000Z", "chats")


@query(
    f"""with {EVENTS_SQL},
dated as (select *, coalesce(strftime(t, '%Y-%m-%d'), '未知时间') as d from messages),
marked as (select *, d is distinct from lag(d) over (partition by source_id order by pos) as fresh from dated),
said as (select *, '- **' || coalesce(strftime(t, '%H:%M:%S'), '--:--') || '** ' || case role when 'user' then '主人' when 'assistant' then '伴侣' else '（待标注）' end || '：' || text as line from marked),
body as (select source_id, pos, case when fresh then ['## ' || d, '', line] else [line] end as l from said),
roles as (select source_id, role, count(*) as n, min(t) as lo, max(t) as hi from messages group by all),
head as (
  select source_id, -1 as pos, ['# 记忆包', '', '- 生成器：{P.GENERATOR["name"]} v{P.GENERATOR["version"]}', '- 生成时间：2026-01-01T00:00:00.000Z', '- 消息数：' || sum(n),
    '- 时间跨度：' || coalesce(strftime(min(lo), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '未知') || ' ~ ' || coalesce(strftime(max(hi), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '未知'),
    '- 角色分布：' || string_agg(role || '=' || n, ' / ' order by role), ''] as l from roles group by source_id)
select source_id, pos, unnest(range(len(l))) as part, unnest(l) as line from (select * from body union all select * from head)"""
)
def chat_markdown(spark, sf_dir):
    """The Markdown form: title and statistics, then the lines of the timeline."""
    found = P.markdown(event_messages(spark, sf_dir), "2026-01-01T00:00:00.000Z")
    return found.withColumn("part", F.col("part").cast("bigint"))


@query(
    """with n as (select *, row_number() over (partition by role order by conv_id, turn) - 1 as i, count(*) over (partition by role) as n from conversations)
select role, conv_id, turn from n where n <= 20 or i in (select (k * n) // 20 from unnest(range(20)) as u(k))"""
)
def chat_even_sample(spark, sf_dir):
    """Twenty messages of each role at even distances."""
    rows = table(spark, sf_dir, "conversations").withColumn("pos", F.col("conv_id") * 1024 + F.col("turn"))
    return P.even_sample(rows, 20, by="role").select("role", "conv_id", "turn")


@query(
    f"""with {EVENTS_SQL}
select source_id, coalesce(strftime(t, '%G-W%V'), 'unknown') as week, coalesce(min(strftime(t, '%Y-%m-%d')), '未知时间') as start, coalesce(max(strftime(t, '%Y-%m-%d')), '未知时间') as end, count(*) as messages
from messages group by all"""
)
def chat_week_batches(spark, sf_dir):
    """Messages of each ISO week."""
    return D.week_batches(event_messages(spark, sf_dir))


@query(
    f"""with recursive {EVENTS_SQL},
lines as (
  select source_id, coalesce(strftime(t, '%G-W%V'), 'unknown') as week, pos, coalesce(strftime(t, '%Y-%m-%d %H:%M:%S'), '[--:--]') || ' ' || role || ': ' || text as line from messages),
numbered as (select *, row_number() over (partition by source_id, week order by pos) as i, length(line) as n from lines),
fold as (
  select source_id, week, 0::bigint as i, 0::bigint as used, 0::bigint as taken, '' as said from numbered where i = 1
  union all
  select f.source_id, f.week, x.i, f.used + case when f.used + x.n <= 600 then x.n else 0 end, f.taken + case when f.used + x.n <= 600 then 1 else 0 end,
    f.said || case when f.used + x.n <= 600 then x.line || chr(10) else '' end
  from fold f join numbered x on x.source_id = f.source_id and x.week = f.week and x.i = f.i + 1),
ends as (select source_id, week, max(taken) as taken, max(i) - max(taken) as left_out, arg_max(said, i) as said from fold group by source_id, week)
select source_id, week, taken, left_out, case when left_out > 0 then said || '（另有 ' || left_out || ' 条消息因长度上限未纳入转录）' else rtrim(said, chr(10)) end as transcript from ends"""
)
def chat_transcripts(spark, sf_dir):
    """The transcript of each week within 600 characters, with how many messages are in it and how many are not."""
    return D.transcripts(event_messages(spark, sf_dir), 600)


@query("select o_orderkey, strftime(o_orderdate, '%G-W%V') as week from orders")
def chat_iso_weeks(spark, sf_dir):
    """The ISO week of every order's date."""
    return table(spark, sf_dir, "orders").select("o_orderkey", times.iso_week(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("week"))


@query(
    """select event_id, event_id % 2 = 0 as is_long_term, event_id % 3 <> 0 as is_notebook, event_id % 5 < 3 as is_profile, event_id % 7 <> 0 as is_anchor from events"""
)
def chat_shapes(spark, sf_dir):
    """Shape checks on JSON made from events."""
    n = F.col("event_id")
    item = F.struct(
        F.lit("x").alias("text"), F.when(n % 2 == 0, "identity").otherwise("other").alias("category"), F.when(n % 3 != 0, F.lit("1.5")).otherwise(F.lit('"1.5"')).alias("score"),
        F.when(n % 5 < 3, F.element_at(F.array(F.lit("preferences"), F.lit("personality"), F.lit("habits")), F.pmod(n, F.lit(3)).cast("int") + 1)).otherwise("moods").alias("dimension"),
        F.when(n % 7 == 0, F.lit("5")).otherwise(F.lit('"2024-01-01"')).alias("date"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", item.alias("i"))
    json = F.format_string('{"text":"x","category":"%s","score":%s,"dimension":"%s","key":"k","value":"v","date":%s,"event":"e","ts":null}', "i.category", "i.score", "i.dimension", "i.date")
    value = F.try_parse_json(json)
    return rows.select("event_id", *(D.shape_of(value, D.SHAPES[s]).alias(f"is_{s}") for s in ("long_term", "notebook", "profile", "anchor")))


@query(
    r"""select page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&mdash;', '—'), '&hellip;', '…'), '&amp;', '&'), '\s+', ' ', 'g'), '^ | $', '', 'g') as title from pages"""
)
def chat_html_title(spark, sf_dir):
    """Titles of saved pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


_STRIP = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in ("script", "style", "noscript", "template", "svg", "head"):
    _STRIP = rf"regexp_replace({_STRIP}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', ' ', 'g')"
_STRIP = rf"regexp_replace(regexp_replace({_STRIP}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</?(?:{T.BLOCKS})\b[^>]*>', chr(10), 'g')"
_STRIP = f"regexp_replace({_STRIP}, '<[^>]+>', ' ', 'g')"
for _name, _char in {**T.HTML_ENTITIES, "amp": "&"}.items():
    _STRIP = f"replace({_STRIP}, '&{_name};', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(
    rf"""with blocks as (
  select page_id, list_filter(list_transform(regexp_split_to_array({_STRIP}, '\n+'), lambda v: regexp_replace(regexp_replace(v, '[ \t ]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda v: v <> '') as b from pages)
select page_id, unnest(range(len(b))) as block_no, unnest(b) as text from blocks"""
)
def chat_html_blocks(spark, sf_dir):
    """Text blocks of saved pages."""
    blocks = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.html_blocks(F.col("html"))).alias("block_no", "text"))
    return blocks.withColumn("block_no", F.col("block_no").cast("bigint"))


def as_tree(spark: SparkSession, sf_dir: str, size: int = 1000) -> DataFrame:
    """Conversations as exports of message trees, a thousand conversations in each; odd turns have a dead branch."""
    chats = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("n"), turn.cast("string"))
    node = lambda id_, parent, role, text, kids: F.struct(id_.alias("id"), parent.alias("parent"), kids.alias("children"), F.struct(F.struct(role.alias("role")).alias("author"), (F.lit(1_750_000_000) + F.col("turn")).cast("double").alias("create_time"), F.struct(F.array(text).alias("parts")).alias("content")).alias("message"))
    first = F.min("turn").over(_by_conv())
    last = F.max("turn").over(_by_conv())
    rows = chats.withColumns({"first": first, "last": last})
    kids = F.concat(F.when(F.col("turn") < F.col("last"), F.array(name(F.col("turn") + 1))).otherwise(F.array().cast("array<string>")), F.when(F.col("turn") % 2 == 1, F.array(F.concat(F.lit("x"), F.col("turn").cast("string")))).otherwise(F.array().cast("array<string>")))
    main = node(name(F.col("turn")), F.when(F.col("turn") > F.col("first"), name(F.col("turn") - 1)), F.col("role"), F.col("text"), kids)
    dead = node(F.concat(F.lit("x"), F.col("turn").cast("string")), name(F.col("turn")), F.lit("tool"), F.lit("gone"), F.array().cast("array<string>"))
    rows = rows.select("conv_id", "turn", "last", F.explode(F.when(F.col("turn") % 2 == 1, F.array(main, dead)).otherwise(F.array(main))).alias("n"))
    trees = rows.groupBy("conv_id").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("turn", "n"))), lambda x: F.struct(x["n"]["id"], x["n"]))).alias("mapping"), F.max("last").alias("last"))
    export = F.to_json(F.struct(F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("title"), F.concat(F.lit("n"), F.col("last").cast("string")).alias("current_node"), "mapping"), {"ignoreNullFields": "false"})
    return _exports(trees.select("conv_id", export.alias("json")), size)


def _by_conv():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id")


def _exports(rows: DataFrame, size: int = 1000) -> DataFrame:
    """JSON of conversations as arrays, ``size`` to an export."""
    source = F.concat(F.lit("export"), F.floor(F.col("conv_id") / size).cast("string"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("conv_id", "json"))), lambda x: x["json"])
    return rows.groupBy(source.alias("source_id")).agg(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("text"))


_ROUND = """with rows as (
  select 'export' || conv_id // 1000 as source_id, row_number() over (partition by conv_id // 1000 order by conv_id, turn) - 1 as pos, *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as said from conversations)
"""


@query(_ROUND + "select source_id, pos, case when role in ('user', 'assistant', 'system') then role else 'unlabeled' end as role, said as text, (1750000000 + turn) * 1000 as ts_ms, 'chat ' || conv_id as title from rows")
def chat_tree_import(spark, sf_dir):
    """Conversations written as message trees and read back, depth first; tool messages go."""
    found = J.chatgpt(as_tree(spark, sf_dir))[0]
    return found.select("source_id", "pos", "role", "text", "ts_ms", F.col("meta.conversation_title").alias("title"))


#: Bytes of a range in the queries on large files, so that each file has several.
RANGE = 1 << 20


def _as_files(spark: SparkSession, rows: DataFrame, *order: str) -> str:
    """Texts or lines (source_id, text) written as one file a source, and the folder."""
    path = new_folder(spark, "files")
    rows.repartition("source_id").sortWithinPartitions("source_id", *order).select("source_id", "text").write.partitionBy("source_id").text(path)
    return path


def _source(df: DataFrame) -> DataFrame:
    return df.withColumn("source_id", F.regexp_extract("source_id", "source_id=([^/]+)", 1))


@query(_ROUND + "select source_id, pos, case when role in ('user', 'assistant', 'system') then role else 'unlabeled' end as role, said as text, (1750000000 + turn) * 1000 as ts_ms, 'chat ' || conv_id as title from rows")
def chat_tree_ranges(spark, sf_dir):
    """Message trees in files of a thousand conversations, each file read in ranges side by side."""
    items = read_items(spark, _as_files(spark, as_tree(spark, sf_dir)), range_bytes=RANGE)
    found = J.tree_messages(J.chosen(_source(items), "mapping", "{"))[0]
    return found.select("source_id", "pos", "role", "text", "ts_ms", F.col("meta.conversation_title").alias("title"))


@query(_ROUND + "select source_id, pos, role, said as text from rows")
def chat_tree_path(spark, sf_dir):
    """The same by the path to the current node."""
    return J.chatgpt(as_tree(spark, sf_dir), current_path=True)[0].select("source_id", "pos", "role", "text")


@query(_ROUND + "select source_id, pos, role, said as text, epoch_ms(make_timestamp(2025, 1, 1, 0, turn::bigint, 0.5)) as ts_ms from rows")
def chat_flat_import(spark, sf_dir):
    """Conversations written as flat exports (even turns in content blocks) and read back."""
    found = J.claude(as_flat(table(spark, sf_dir, "conversations")))[0]
    return found.select("source_id", "pos", "role", "text", "ts_ms")


def as_flat(chats: DataFrame, size: int = 1000) -> DataFrame:
    """Conversations as flat exports; even turns are in content blocks."""
    even = F.col("turn") % 2 == 0
    blocks = F.when(even, F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text"))))
    created = F.concat(F.lit("2025-01-01T00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":00.500Z"))
    message = F.struct(F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.when(even, "").otherwise(F.col("text")).alias("text"), blocks.alias("content"), created.alias("created_at"))
    flat = chats.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("chat_messages"))
    return _exports(flat.select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("name"), "chat_messages")).alias("json")), size)


@query(
    r"""select conv_id::varchar as source_id, row_number() over (partition by conv_id order by turn) - 1 as pos, role, regexp_replace(text, '^\s+|\s+$', '', 'g') as text,
  case when turn % 3 = 2 then epoch_ms(make_timestamp(2025, 6, 13, 22, turn::bigint, 37.0)) else 1750000000000 + turn end as ts_ms from conversations"""
)
def chat_jsonl_import(spark, sf_dir):
    """Conversations written as JSON Lines, with a header and a broken line, and read back."""
    return J.sillytavern(as_jsonl(table(spark, sf_dir, "conversations"), broken=True))[0].select("source_id", "pos", "role", "text", "ts_ms")


@query(
    _ROUND
    + r"""select source_id, pos, role, said as text,
  case when turn % 3 = 2 then epoch_ms(make_timestamp(2025, 6, 13, 22, turn::bigint, 37.0)) else 1750000000000 + turn end as ts_ms from rows"""
)
def chat_jsonl_ranges(spark, sf_dir):
    """JSON Lines of a thousand conversations a file, with headers and broken lines, each file read in ranges side by side."""
    texts = as_jsonl(table(spark, sf_dir, "conversations"), broken=True).withColumn("conv", F.col("source_id").cast("long"))
    lines = texts.select(F.concat(F.lit("export"), F.floor(F.col("conv") / 1000).cast("string")).alias("source_id"), "conv", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    found = J.line_messages(_source(read_lines(spark, _as_files(spark, lines, "conv", "k"), range_bytes=RANGE)))[0]
    return found.select("source_id", "pos", "role", "text", "ts_ms")


def as_jsonl(chats: DataFrame, broken: bool = False) -> DataFrame:
    """Conversations as JSON Lines, with a header, a blank message, and a broken line if wanted."""
    date = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("June 13, 2025 10:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":37pm"))).otherwise((F.lit(1_750_000_000_000) + F.col("turn")).cast("string"))
    line = F.to_json(F.struct(F.lit("x").alias("name"), (F.col("role") == "user").alias("is_user"), (F.col("role") == "system").alias("is_system"), date.alias("send_date"), F.col("text").alias("mes")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    last = F.array(F.lit("{broken")) if broken else F.array(F.lit('{"mes":" ","is_user":true}'))
    whole = F.concat(F.array(F.lit('{"user_name":"a","character_name":"b"}')), lines, last)
    return chats.groupBy("conv_id").agg(F.array_join(whole, "\n").alias("text")).select(F.col("conv_id").cast("string").alias("source_id"), "text")


@query(
    r"""select conv_id::varchar as source_id, row_number() over (partition by conv_id order by turn) - 1 as pos, case when role = 'system' then 'unlabeled' else role end as role,
  regexp_replace(text, '^\s+|\s+$', '', 'g') as text, epoch_ms(make_timestamp(2025, 1, 1, 0, turn::bigint, 0.0)) as ts_ms from conversations"""
)
def chat_bundle_import(spark, sf_dir):
    """Conversations written as bundles of three files with messages out of order, and read back by time."""
    chats = table(spark, sf_dir, "conversations")
    speaker = F.when(F.col("role") == "user", "Ada").when(F.col("role") == "assistant", "Bot").otherwise("other")
    created = F.concat(F.lit("2025-01-01T00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":00Z"))
    message = F.struct(F.struct(speaker.alias("name"), F.when(F.col("turn") % 2 == 0, F.when(F.col("role") == "user", True).when(F.col("role") == "assistant", False)).alias("is_human"), F.col("text").alias("raw_content"), F.lit("decoy").alias("text")).alias("src"), created.alias("created_at"))
    bodies = chats.groupBy("conv_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("turn")).alias("turn"), message.alias("m")))), lambda x: x["m"])).alias("text"))
    source = F.col("conv_id").cast("string").alias("source_id")
    files = bodies.select(source, F.lit("u/data/message.json").alias("name"), "text")
    for name, text in (("user.json", '{"first_name":"Ada"}'), ("character.json", '{"name":"Bot"}')):
        files = files.unionByName(bodies.select(source, F.lit(f"u\\data\\{name}").alias("name"), F.lit(text).alias("text")))
    return J.characterai(files)[0].select("source_id", "pos", "role", "text", "ts_ms")


@query(
    """select 'page' || page_id as source_id, 'local-web' as name, 'high' as confidence from pages
union all select 'chat' || conv_id, case when count(*) >= 2 then 'txt-docx' end, case when count(*) >= 2 then 'low' end from conversations group by conv_id
union all select 'export' || conv_id // 1000, 'chatgpt', 'high' from conversations group by 1"""
)
def chat_sniff(spark, sf_dir):
    """What pages, rendered chats and exports are recognised as."""
    named = lambda kind, df: df.select(F.concat(F.lit(kind), F.col("source_id").cast("string")).alias("source_id"), "text")
    page = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), F.col("html").alias("text"))
    return sniff_texts(named("page", page).unionByName(named("chat", rendered_chats(spark, sf_dir))).unionByName(named("", as_tree(spark, sf_dir))))


@query(
    r"""with said as (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from conversations)
select conv_id::varchar as source_id, turn as pos, case when role in ('user', 'assistant', 'system') then role else 'unlabeled' end as role, t as text,
  case when role not in ('user', 'assistant', 'system') then role end as original_role, 1750000000000 + conv_id * 86400000 + turn * 60000 as ts_ms
from said where t <> '' and not regexp_matches(t, '^\d{1,3}$')"""
)
def chat_pipeline(spark, sf_dir):
    """The whole pipeline on conversations as raw messages with times as text, without a provider: the messages of each source."""
    chats = chat_messages(spark, sf_dir).withColumn("ts_ms", F.col("ts_ms").cast("string"))
    messages = run_pipeline(chats).messages
    return messages.select("source_id", "pos", "role", "text", F.col("meta.original_role").alias("original_role"), "ts_ms")


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of four kinds, dealt by conv_id, some with a telling name; one file in ten has a line more that
    is not UTF-8, and there are a damaged archive, an empty page and a file of nothing known."""
    chats = table(spark, sf_dir, "conversations")
    kind = F.col("source_id").cast("bigint") % 4
    one_by_one = lambda export: export.withColumn("source_id", F.regexp_extract("source_id", r"(\d+)\z", 1))
    headed = rendered_chats(spark, sf_dir).where(kind == 0)
    trees = one_by_one(as_tree(spark, sf_dir, 1)).where(kind == 1)
    jsonl = as_jsonl(chats).where(kind == 2)
    flat = one_by_one(as_flat(chats, 1)).where(kind == 3)
    texts = headed.withColumn("path", F.lit("chat.txt")).unionByName(trees.withColumn("path", F.lit("conversations.json"))).unionByName(jsonl.withColumn("path", F.lit("chat.jsonl"))).unionByName(flat.withColumn("path", F.lit("export")))
    broken = F.when(F.col("source_id").cast("bigint") % 20 == 2, F.unhex(F.lit("0AFF7B"))).otherwise(F.unhex(F.lit("")))
    found = texts.select("source_id", "path", F.concat(F.encode("text", "UTF-8"), broken).alias("content"))
    odd = spark.createDataFrame([("zip", "a.zip", bytearray(b"PK\x03\x04 damaged")), ("page", "a.html", bytearray(b"<p> </p>")), ("what", "a.bin", bytearray(b"\xff\xfe"))], "source_id string, path string, content binary")
    return found.unionByName(odd)


_MIXED = r"""with chats as (
  select conv_id::varchar as source_id, conv_id, turn, role, text, regexp_replace(text, '^\s+|\s+$', '', 'g') as said, row_number() over (partition by conv_id order by turn) - 1 as pos from conversations),
sizes as (select conv_id, count(*) as n, count(*) filter (turn % 2 = 1) as odd from conversations group by conv_id)
"""


_MIXED_MESSAGES = (
    _MIXED
    + r"""select source_id, pos, case when conv_id % 4 = 0 and role not in ('user', 'assistant') then 'unlabeled' else role end as role,
  case when conv_id % 4 = 0 then regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') else said end as text, ['txt-docx', 'chatgpt', 'st-chatlog', 'claude'][conv_id % 4 + 1] as source
from chats join sizes using (conv_id)
where (conv_id % 4 > 0 or n >= 2)"""
)


@query(_MIXED_MESSAGES)
def chat_mixed_files(spark, sf_dir):
    """Files of several kinds in one table, each read by the adapter that it is recognised as needing."""
    names = {"txt-docx": {"aliases": ALIASES, "base_year": 2024}}
    found = convert_files(mixed_files(spark, sf_dir), options=names).messages
    source = F.when(F.col("meta.source") == "segment", "txt-docx").otherwise(F.col("meta.source"))
    return found.select("source_id", "pos", "role", "text", source.alias("source"))


@query(_MIXED_MESSAGES)
def chat_mixed_stream(spark, sf_dir):
    """The same files arriving as a stream, in two batches."""
    path, out = new_folder(spark, "arriving"), new_folder(spark, "arrived")
    mixed_files(spark, sf_dir).repartition(4).write.parquet(path)
    files = spark.readStream.schema("source_id string, path string, content binary").option("maxFilesPerTrigger", 2).parquet(path)
    convert_arrivals(files, out, new_folder(spark, "offsets"), options={"txt-docx": {"aliases": ALIASES, "base_year": 2024}}).awaitTermination()
    source = F.when(F.col("meta.source") == "segment", "txt-docx").otherwise(F.col("meta.source"))
    return converted_arrivals(spark, out).messages.select("source_id", "pos", "role", "text", source.alias("source"))


@query(
    _MIXED
    + r"""select conv_id::varchar as source_id, case when conv_id % 4 > 0 or n >= 2 then ['txt-docx', 'chatgpt', 'st-chatlog', 'claude'][conv_id % 4 + 1] end as adapter,
  case when conv_id % 4 > 0 or n >= 2 then n else 0 end as messages, case when conv_id % 20 = 2 then 2 when conv_id % 4 = 1 then odd when conv_id % 4 = 2 then 1 else 0 end as skipped,
  case when conv_id % 4 = 0 and n < 2 then 'not recognised' end as error from sizes
union all select 'zip', null, 0, 0, 'File is not a zip file' union all select 'page', 'local-web', 0, 0, 'no text on the page' union all select 'what', null, 0, 0, 'not recognised'"""
)
def chat_mixed_status(spark, sf_dir):
    """What became of each file of that table."""
    found = convert_files(mixed_files(spark, sf_dir), options={"txt-docx": {"aliases": ALIASES, "base_year": 2024}}).status
    return found.select("source_id", "adapter", "messages", "skipped", "error")


@query("select (date_trunc('week', ts))::date as week_start, event_type as kind, count(*) as n from events group by all")
def chat_weekly_counts(spark, sf_dir):
    """Events by week and type; the same operator runs on streams."""
    return weekly_counts(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind")))
