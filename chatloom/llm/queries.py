"""The registered query of each operator: the whole intended table, production parameters, the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import decontaminate, langid, linededup, ngramjoin, pii, quality, reputation, toolcalls
from chatloom.llm.common import new_dir, table, vocabulary
from chatloom.llm.hardnegatives import mine
from chatloom.llm.packing import pack
from chatloom.llm.resampling import resample
from chatloom.llm.sharding import shard
from chatloom.llm.tokenfile import read_documents, write_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 ids, by minimum bin slack."""
    packed = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, counts at most one apart."""
    dealt = shard(table(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids, read back from the Arrow files."""
    folder = new_dir(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_documents(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; a page's outcome is the label of the document whose number is in its path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(reputation.host_and_path(F.col("url"))[1], r"^/[a-z]+/([0-9]+)", 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_key"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    return reputation.judge(pages.withColumn("page_key", number.try_cast("long")), labels)


def _level(name: str, above: str | None) -> str:
    """SQL of one level of shrinking: the groups with their parent's rate m, the strength s, and the shrunk rate."""
    groups = f"select {name}, {f'any_value({above}) as {above},' if above else ''} sum(n) as n, sum(bad) as bad from hosts group by {name}"
    parent = f"select g.*, p.rate as m from g_{name} g join r_{above} p using ({above})" if above else f"select g.*, t.rate as m from g_{name} g, total t"
    return f"""
g_{name} as ({groups}),
m_{name} as ({parent}),
s_{name} as (select case when y > 0 then (1 - rho) / rho else 999.0 end as s from (
  select y, least(greatest(x / nullif(y, 0), 0.001), 0.5) as rho from (
    select sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) as x, sum(n * (n - 1) * m * (1 - m)) as y from m_{name} where n > 1))),
r_{name} as (select a.*, (bad + s * m) / (n + s) as rate, n + s as weight from m_{name} a, s_{name})"""


ORACLES["op9_url_filter"] = f"""
with urls as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
rows as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from urls),
known as (select doc_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels where doc_id is not null and (toxic is not null or quality is not null) group by doc_id),
seen as (
  select host, bad from rows left join known on doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') as bigint)),
bare as (select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\\.$', '') as name from seen group by host),
cut as (
  select *, regexp_matches(name, '^\\[|^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') as address, string_split(name, '.') as l,
    case when array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') in ({", ".join(f"'{x}'" for x in reputation.SUFFIXES)}) then 2 else 1 end as k from bare),
hosts as (
  select host, n, bad, case when address then name else array_to_string(list_slice(l, -k - 1, -1), '.') end as domain, case when address then name else array_to_string(list_slice(l, -k, -1), '.') end as suffix
  from cut),
total as (select (sum(bad) + 0.5) / (sum(n) + 1) as rate from hosts),{_level("suffix", None)},{_level("domain", "suffix")},{_level("host", "domain")},
blocked as (select host from r_host where rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) >= 0.5),
ruled as (
  select *, case
    when (host = 'example.com' or host like '%.example.com') and path like '/en/7%' then 'example.com/en/7'
    when (host = 'example.net' or host like '%.example.net') and path like '/de/8%' then 'example.net/de/8'
    when (host = 'com' or host like '%.com') and path like '/en/%' then 'com/en/'
    when (host = 'net' or host like '%.net') and path like '/de/%' then 'net/de/'
    when (host = 'org' or host like '%.org') and path like '/es/%' then 'org/es/' end as rule
  from rows)
select page_id, host, path, rule, case
    when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block'
    when host in (select host from blocked) then 'block' else 'allow' end as verdict
from ruled"""


@query
def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


ORACLES["op2_line_quality"] = r"""
with docs as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
worded as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs),
windows as (select doc_id, p, words[p : p + 7] as w from worded, unnest(range(1, len(words) - 6)) as u(p) where len(words) >= 8),
twice as (select doc_id, p from windows where true qualify count(*) over (partition by doc_id, w) > 1),
covered as (select doc_id, count(distinct p + k) as n from twice, unnest(range(8)) as u(k) group by doc_id),
base as (
  select doc_id, len(words) as n_words, list_sum(list_transform(words, lambda w: length(w))) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines from worded),
counted as (
  select doc_id, n_words::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols::bigint as n_symbols,
    n_dup_lines::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words from base left join covered using (doc_id)),
line as (
  select doc_id, host, text, trim(regexp_replace(regexp_replace(lower(l), '\p{Nd}+', '0', 'g'), '[^\p{L}\p{Nd}]+', ' ', 'g')) as norm,
    len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as n
  from docs, unnest(string_split(text, chr(10))) as u(l)),
held as (select * from line where n > 0),
frequent as (select host, norm from held group by host, norm having count(distinct text) > 25),
gone as (select doc_id, sum(n)::bigint as n_line_words from held join frequent using (host, norm) group by doc_id),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(n_line_words, 0) as lost from counted left join gone using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words - lost >= 0.3 * n_words and n_words - lost >= 20 as kept, lost as n_line_words
from judged"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, the window's first word and its similarity."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op8_decontamination"] = r"""
with docs as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda w: w <> '') as w from documents where text is not null),
items as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda w: w <> '') as v from benchmark where text is not null),
di as (select doc_id, len(w) as n, p - 1 as pos, array_to_string(w[p : p + 4], ' ') as s from docs, unnest(range(1, greatest(len(w) - 3, 2))) as u(p) where len(w) > 0),
ii as (select item_id, len(v) as size, array_to_string(v[p : p + 4], ' ') as s from items, unnest(range(1, greatest(len(v) - 3, 2))) as u(p) where len(v) > 0),
ig as (select item_id, size, s, count(*) as c from ii group by item_id, size, s),
ic as (select *, sum(c) over (partition by item_id) as m from ig),
hits as (select distinct doc_id, n, item_id, size, m, pos from di join ic using (s)),
starts as (select distinct doc_id, item_id, size, m, greatest(0, least(pos, n - size)) as start from hits),
bag as (
  select doc_id, item_id, start, m, s, count(*) as c from starts join di using (doc_id)
  where pos >= start and pos < start + greatest(size - 4, 1) group by all),
scored as (
  select b.doc_id, b.item_id, b.start, sum(least(b.c, coalesce(ic.c, 0))) as shared, sum(b.c) as w, any_value(b.m) as m
  from bag b left join ic on ic.item_id = b.item_id and ic.s = b.s group by all),
good as (select doc_id, item_id, start::int as start, (shared / (w + m - shared))::double as similarity from scored)
select doc_id, item_id, start, similarity from (
  select * from good where similarity >= 0.75
  union all select doc_id, item_id, (p - 1)::int, 1.0 from docs, items, unnest(range(1, len(w) - len(v) + 2)) as u(p) where len(v) between 1 and 4 and w[p : p + len(v) - 1] = v)
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1"""


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its lines with a word, those equal to an earlier line, those one word from an earlier line that
    stays (of ten words or more), which line stands for each that goes (line:document.line), and what is left of the text."""
    told = linededup.report(table(spark, sf_dir, "documents"))
    links = F.transform("links", lambda x: F.concat(x["line_no"], F.lit(":"), x["doc"], F.lit("."), x["line"]))
    return told.select("doc_id", "n_lines", "n_repeats", "n_near", F.coalesce(F.array_join(links, " "), F.lit("")).alias("links"), F.md5("text").alias("text_md5"), "kept")


# Lines with near neighbours are gone through one after the other: each stays unless one that stayed is near.
ORACLES["op1_line_dedup"] = r"""
with recursive line as (
  select doc_id, i - 1 as line_no, string_split(text, chr(10))[i] as raw, list_filter(regexp_split_to_array(lower(string_split(text, chr(10))[i]), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as u(i)),
worded as (select * from line where len(w) > 0),
firsts as (select row_number() over (order by doc_id, line_no) as f, * from (select w, doc_id, line_no from worded qualify row_number() over (partition by w order by doc_id, line_no) = 1)),
keys as (
  select f, len(w) - 1 as n, i, array_to_string(list_slice(w, 1, i), ' ') as a, array_to_string(list_slice(w, i + 2, len(w)), ' ') as b
  from firsts, unnest(range(len(w))) as u(i) where len(w) >= 10
  union all
  select f, len(w), i, array_to_string(list_slice(w, 1, i), ' '), array_to_string(list_slice(w, i + 1, len(w)), ' ')
  from firsts, unnest(range(len(w) + 1)) as u(i) where len(w) >= 10),
near as (select y.f, list(distinct x.f) as before from keys x join keys y using (n, i, a, b) where x.f < y.f group by y.f),
turn as (select row_number() over (order by f) as k, f, coalesce(before, []) as before from (select f from near union select unnest(before) from near) left join near using (f)),
walk(k, stays) as (
  select 0::bigint, []::bigint[]
  union all select turn.k, case when list_has_any(stays, before) then stays else list_append(stays, f) end from walk join turn on turn.k = walk.k + 1),
close as (select f, list_min(list_intersect(before, stays)) as m from turn, (select stays from walk order by k desc limit 1) where list_has_any(stays, before)),
judged as (
  select l.doc_id, l.line_no, l.raw, f.f is null as wordless, l.doc_id <> f.doc_id or l.line_no <> f.line_no as is_repeat, m is not null as is_near,
    coalesce(m, f.f) as stand from line l left join firsts f using (w) left join close c on c.f = f.f),
placed as (select j.*, p.doc_id as kept_doc, p.line_no as kept_line, not wordless and (is_repeat or is_near) as gone from judged j left join firsts p on p.f = stand),
told as (
  select doc_id, count(*) filter (not wordless) as n_lines, count(*) filter (gone and is_repeat) as n_repeats, count(*) filter (gone and not is_repeat) as n_near,
    string_agg(line_no || ':' || kept_doc || '.' || kept_line, ' ' order by line_no) filter (gone) as links,
    string_agg(raw, chr(10) order by line_no) filter (not gone) as rest, count(*) filter (gone) > 0 as cut
  from placed group by doc_id)
select doc_id, n_lines::bigint as n_lines, n_repeats::bigint as n_repeats, n_near::bigint as n_near, coalesce(links, '') as links,
  case when text is null then null when cut then md5(coalesce(rest, '')) else md5(text) end as text_md5, not cut or regexp_matches(coalesce(rest, ''), '[^\x20\x09-\x0D]') as kept
from documents join told using (doc_id)"""


@query
def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations in canonical form: a user's turn is a call of the tool ``reply``, identified by
    conversation and turn, and an assistant's turn is the result of the call of the turn before."""
    chats = table(spark, sf_dir, "conversations")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    events = chats.select(
        F.col("conv_id").alias("conv"), "turn", "role",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user | assistant, F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - F.when(assistant, 1).otherwise(0)).cast("string"))).alias("id"),
        F.when(user, "reply").alias("name"),
        F.when(user, F.to_json(F.struct("turn", F.col("text").alias("prompt")))).alias("arguments"),
        F.when(~user, F.col("text")).alias("text"),
        F.array().cast("array<string>").alias("after"),
    )
    schemas = {"reply": toolcalls.Schema({"prompt": "string", "turn": "integer"}, ("prompt", "turn"))}
    return toolcalls.format_chats(events, schemas).select(F.col("conv").alias("conv_id"), "turn", "role", "kind", "id", "status", "fault", "place", "json")


ORACLES["op6_tool_calls"] = r"""
with rows as (
  select conv_id, turn, role, text, case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind,
    case role when 'user' then conv_id || ':' || turn when 'assistant' then conv_id || ':' || (turn - 1) end as id from conversations),
linked as (
  select r.*, case kind
    when 'call' then case when exists (select 1 from rows x where x.kind = 'result' and x.id = r.id) then 'answered' else 'open' end
    when 'result' then case when exists (select 1 from rows x where x.kind = 'call' and x.id = r.id) then 'linked' else 'no call' end end as status
  from rows r)
select conv_id, turn, role, kind, id, status,
  case when kind = 'call' and text is null then 'missing prompt' end as fault,
  row_number() over (partition by conv_id order by turn, (status = 'linked')::int, role, kind, id, text) - 1 as place,
  '{' || case kind when 'call' then '"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(id) || ',"kind":"call","name":"reply"'
    when 'result' then '"content":' || to_json(text) || ',"id":' || to_json(id) || ',"kind":"result"'
    else '"content":' || to_json(text) || ',"kind":"message"' end || ',"role":' || to_json(role) || '}' as json
from linked"""


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of 5-word shingles and its component at a Jaccard similarity of 0.75."""
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"))


ORACLES["op5_ngram_join"] = r"""
with recursive worded as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents where text is not null),
grams as (
  select distinct doc_id, array_to_string(w[p : p + 4], ' ') as g from worded, unnest(range(1, greatest(len(w) - 3, 2))) as u(p) where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
joint as (select a.doc_id as a, b.doc_id as b, count(*) as x from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from joint join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * x >= 75 * (s.n + t.n - x)),
reach as (select doc_id as a, doc_id as b from sizes union select r.a, l.b from reach r join links l on l.a = r.b),
named as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id
from documents left join sizes using (doc_id) left join named using (doc_id)"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every anchor and each of its five positives, the five hardest negatives; one label in seven is set off by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label, positives=5, negatives=5, share=(80, 100), scale=256)


ORACLES["op11_hard_negatives"] = """
with rows as (
  select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.id as anchor_id, r.id, r.label = a.label as same, list_dot_product(a.q, r.q)::bigint as score from rows a join rows r on a.id <> r.id where a.id % 100 = 0),
positive as (
  select anchor_id, id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
ranked as (
  select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as rank, id as negative_id, positive_score, score as negative_score
  from positive p join scored s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 5"""


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: what the patterns find, and other mentions of it by a field trained on a sample."""
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.train(pii.sample(docs)))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark's texts, and the rank of the five in a hundred drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


# CRCs by the usual table, one byte a step, of each distinct feature.
ORACLES["op13_importance_resampling"] = r"""
with recursive step(i, k, c) as (
  select i::bigint, 0, i::bigint from range(256) r(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8),
crc as (select list(c order by i) as row from step where k = 8),
texts as (select 'd' as side, doc_id, text from documents union all select 'b', null, text from benchmark),
worded as (
  select side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from texts),
runs as (
  select side, doc_id, array_to_string(w[p : p + n - 1], ' ') as f
  from worded, unnest([1, 2, 3]) as a(n), unnest(range(1, greatest(len(w) - n + 2, 1))) as b(p)),
counted as (select f, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from runs group by f),
hexed as (select f, s, t, hex(encode(f)) as h from counted),
bucketed as (
  select f, s, t, xor(list_reduce(list_transform(range(0, len(h), 2), lambda i: ('0x' || h[i + 1 : i + 2])::bigint), lambda x, b: xor(x >> 8, crc.row[(xor(x, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket
  from hexed, crc),
total as (select sum(s)::double as s_all, sum(t)::double as t_all from bucketed),
bucket as (select bucket, sum(s)::double as s, sum(t)::double as t from bucketed group by bucket),
gain as (select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from bucket, total),
feature as (select f, gain from bucketed join gain using (bucket)),
weighed as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from runs join feature using (f) where side = 'd' group by doc_id),
scored as (
  select d.doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1 : 8])::bigint + 0.5::double) / 4294967296)))::bigint as score
  from worded d left join weighed using (doc_id) where side = 'd'),
placed as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as n from scored)
select doc_id, n_words::bigint as n_words, n_features, weight, score, case when n_words >= 20 and place <= 5 * n // 100 then place end as rank
from placed"""
