"""Cleaning: segments, noise filter, windowed de-duplication, redaction, and their statistics.

Segments are rows (source_id, pos, header, text, ...); ``pos`` is an integer that orders the segments of a source. Further
columns are carried along, so a structured message keeps its role, time and meta through cleaning.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.functions.patterns import FEW, any_of, may_hit
from chatloom.storage import broadcast_if_small, written


@dataclass(frozen=True)
class NoiseRule:
    type: str  # contains, exact or regex
    pattern: str
    flags: str = ""
    label: str = ""


@dataclass(frozen=True)
class RedactionRule:
    name: str
    pattern: str
    replacement: str
    flags: str = "g"


@dataclass(frozen=True)
class Dedup:
    enabled: bool = True
    window_size: int = 5
    min_segment_length: int = 4


#: The default rules and the pattern at which a text is cut into messages.
DEFAULT_NOISE = (
    NoiseRule("contains", "钻石余额不足"),
    NoiseRule("contains", "请充值后继续使用"),
    NoiseRule("contains", "消息发送失败"),
    NoiseRule("contains", "对方已下线"),
    NoiseRule("contains", "网络连接已断开"),
    NoiseRule("contains", "签到成功，获得"),
    NoiseRule("exact", "4G"),
    NoiseRule("exact", "5G"),
    NoiseRule("exact", "Wi-Fi"),
    NoiseRule("exact", "正在输入…"),
    NoiseRule("exact", "[系统消息]"),
    NoiseRule("regex", r"^\d{1,3}$"),
)
DEFAULT_REDACTIONS = (
    RedactionRule("id_card_18", r"(?<!\d)\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)", "[已脱敏:身份证号]"),
    RedactionRule("id_card_15", r"(?<!\d)\d{6}\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}(?!\d)", "[已脱敏:身份证号]"),
    RedactionRule("phone", r"(?<!\d)1[3-9]\d{9}(?!\d)", "[已脱敏:手机号]"),
    RedactionRule("student_id", r"(?:学号|学籍号|考号|工号|证件号码?|护照号)\s*[:：]?\s*[A-Za-z0-9-]{5,25}", "[已脱敏:证件号]"),
)
BOUNDARY = r"([^\s:：][^\s:：]{0,19})\s*[:：]\s*(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s+"


@dataclass(frozen=True)
class CleanConfig:
    noise_rules: Sequence[NoiseRule] = DEFAULT_NOISE
    dedup: Dedup = field(default_factory=Dedup)
    redaction_rules: Sequence[RedactionRule] = DEFAULT_REDACTIONS
    strip_control_chars: bool = True
    boundary: str | None = BOUNDARY

    def merged(self, partial: dict[str, Any]) -> CleanConfig:
        """With the fields of a partial configuration: rule lists replace, ``dedup`` merges field by field."""
        out = self
        if partial.get("noiseRules") is not None:
            out = replace(out, noise_rules=tuple(NoiseRule(r["type"], r["pattern"], r.get("flags") or "", r.get("label") or "") for r in partial["noiseRules"]))
        if partial.get("redactionRules") is not None:
            out = replace(out, redaction_rules=tuple(RedactionRule(r["name"], r["pattern"], r["replacement"], r.get("flags") or "g") for r in partial["redactionRules"]))
        if partial.get("dedup"):
            d = partial["dedup"]
            out = replace(out, dedup=Dedup(d.get("enabled", out.dedup.enabled), d.get("windowSize", out.dedup.window_size), d.get("minSegmentLength", out.dedup.min_segment_length)))
        if partial.get("stripControlChars") is not None:
            out = replace(out, strip_control_chars=partial["stripControlChars"])
        if partial.get("messageBoundary"):
            out = replace(out, boundary=java_regex(partial["messageBoundary"]["pattern"], partial["messageBoundary"].get("flags") or ""))
        return out


def load_config(path: str) -> CleanConfig:
    """A configuration file in JSON, over the defaults."""
    with open(path, encoding="utf-8") as f:
        return CleanConfig().merged(json.load(f))


def java_regex(pattern: str, flags: str = "") -> str:
    """A rule's pattern for Spark: white space is Unicode's, ``$`` is the very end, flags i, m and s are kept.

    ``u`` and ``y`` are not supported; ``g`` is up to the operator.
    """
    if set(flags) - set("gims"):
        raise ValueError(f"unsupported regex flags: {flags}")
    out, i, inside = [], 0, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if two == "\\s":
            out.append(T.SPACES if inside else f"[{T.SPACES}]")
        elif two == "\\S" and not inside:
            out.append(f"[^{T.SPACES}]")
        elif c == "\\":
            out.append(two)
        elif c == "$" and not inside and "m" not in flags:
            out.append(r"\z")
        elif inside:
            inside = c != "]"
            out.append(r"\[" if c == "[" else c)
        else:
            inside = c == "["
            out.append(c)
        i += 2 if c == "\\" else 1
    kept = "".join(sorted(set(flags) & set("ims")))
    return (f"(?{kept}{'u' if 'i' in kept else ''})" if kept else "") + "".join(out)


#: What follows a name in a boundary, and the most characters of a name.
_AFTER_NAME, _NAME = BOUNDARY[BOUNDARY.index(")") + 1 :].removeprefix(r"\s*"), 20


def headed_pieces(text: Column) -> Column:
    """A text cut at the default boundary: an array of (header, text), the first without a header. Null where a time has no
    name before it; the pattern itself must say what such a text is.

    The pattern tries a name at each character. Here what follows a name is found first, which begins with a colon, and the
    name is the last characters before it.
    """
    after = java_regex(_AFTER_NAME)
    name_of = lambda p: F.regexp_extract(F.right(F.rtrim(p, F.lit(T.SPACE_CHARS)), F.lit(_NAME)), rf"[^{T.SPACES}:：]+\z", 0)

    def cut(x: Column) -> Column:
        n = F.size(x["cores"])
        named = F.transform(x["pieces"], lambda p, i: F.struct(p.alias("p"), F.when(i < n, name_of(p)).alias("name"), F.when(i > 0, F.get(x["cores"], i - 1)).alias("core")))

        def whole(parts: Column) -> Column:
            # A piece loses the name of the next header and the space behind it; that name is the next one's.
            def piece(y: Column, i: Column) -> Column:
                kept = F.length(F.rtrim(y["p"], F.lit(T.SPACE_CHARS))) - F.length(y["name"])
                before = F.get(parts, i - 1)
                gap = F.substring(before["p"], F.length(F.rtrim(before["p"], F.lit(T.SPACE_CHARS))) + 1, F.length(before["p"]))
                return F.struct(F.when(i > 0, F.concat(before["name"], gap, y["core"])).alias("header"), F.when(i < n, F.substring(y["p"], F.lit(1), kept)).otherwise(y["p"]).alias("text"))

            return F.when(F.forall(parts, lambda y: F.coalesce(y["name"] != "", F.lit(True))), F.transform(parts, piece))

        return T.let(named, whole)

    return T.let(F.struct(F.regexp_extract_all(text, F.lit(after), F.lit(0)).alias("cores"), F.split(text, after).alias("pieces")), cut)


def split_text(docs: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """Segments of whole texts (source_id, text): at each boundary, or by line where a text has none.

    What stands before the first boundary is a segment without header. Bodies are trimmed and may be empty.
    """
    text = T.strip_controls(F.col("text")) if config.strip_control_chars else F.col("text")
    rows = docs.select("source_id", F.coalesce(text, F.lit("")).alias("_t"))
    segment = lambda h, t: F.struct(h.alias("header"), t.alias("text"))
    by_line = F.transform(T.lines(F.col("_t")), lambda v: segment(F.lit(None).cast("string"), v))
    if config.boundary is None:
        found = by_line
    else:
        pattern = java_regex(config.boundary)
        heads, bodies = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)), F.split("_t", pattern)
        cut = F.zip_with(F.concat(F.array(F.lit(None).cast("string")), heads), bodies, lambda h, b: segment(T.trim(h), T.trim(b)))
        found = cut
        if config.boundary == BOUNDARY:
            rows = rows.withColumn("_p", headed_pieces(F.col("_t")))
            found = F.when(F.col("_p").isNotNull(), F.transform("_p", lambda p: segment(T.trim(p["header"]), T.trim(p["text"])))).otherwise(cut)
        found = F.filter(found, lambda s: s["header"].isNotNull() | (s["text"] != ""))
        rows = rows.withColumn("_f", found)
        found = F.when(F.exists("_f", lambda s: s["header"].isNotNull()), F.col("_f")).otherwise(by_line)
    return rows.select("source_id", F.posexplode(found).alias("pos", "s")).select("source_id", F.col("pos").cast("long").alias("pos"), "s.header", "s.text")


def split_lines(lines: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """Segments of given lines (source_id, pos, text): a boundary counts at the start of the trimmed line only."""
    line = T.trim(F.col("text"))
    head = F.regexp_extract(line, r"\A(?:" + java_regex(config.boundary) + ")", 0) if config.boundary else F.lit("")
    rows = lines.withColumn("_l", line).withColumn("_h", head).where(F.col("_l") != "")
    body = T.trim(F.substring("_l", F.length("_h") + 1, F.length("_l")))
    return rows.select("source_id", "pos", F.when(F.col("_h") != "", T.trim(F.col("_h"))).alias("header"), F.when(F.col("_h") != "", body).otherwise(F.col("_l")).alias("text"))


def is_noise(text: Column, rules: Sequence[NoiseRule]) -> Column:
    """Whether a text is empty or any rule applies to it (trimmed). However many fixed texts the rules name, a text is gone
    through once for all of them."""
    exact = [r.pattern for r in rules if r.type == "exact"]
    held = [r.pattern for r in rules if r.type == "contains"]
    trimmed = T.trim(F.coalesce(text, F.lit("")))
    many = len(held) > FEW

    def noisy(t: Column) -> Column:
        out = t == ""
        if exact:
            out = out | t.isin(exact)
        if held and not many:
            out = out | any_of(t, held)
        for r in rules:
            if r.type == "regex":
                out = out | t.rlike(java_regex(r.pattern, r.flags))
        return out

    rest = T.let(trimmed, noisy)
    return rest | any_of(trimmed, held) if many else rest


def drop_noise(segments: DataFrame, rules: Sequence[NoiseRule] = DEFAULT_NOISE) -> DataFrame:
    return segments.where(~is_noise(F.col("text"), rules))


#: Positions whose windows are formed in one task.
SPAN = 4096


def repeated_rows(segments: DataFrame, window_size: int = 5, min_length: int = 4, pos_span: int = SPAN) -> DataFrame:
    """(source_id, pos) of the segments in a window of ``window_size`` whose fingerprints came before in the same source.

    A window counts unless all its texts are shorter than ``min_length`` UTF-16 units; sources with fewer than two windows'
    rows have none. Windows are formed in blocks of ``pos_span`` positions, and those that reach over a block's end from the
    first and last rows of all blocks, so a long source is many tasks' work. The segments are read once; of their texts only
    fingerprints are written and shuffled.
    """
    w = window_size
    short = T.utf16_length(T.trim(F.coalesce("text", F.lit("")))) < min_length
    # A fingerprint is 8 bytes, a window's key those of its rows.
    prints = segments.select("source_id", "pos", F.unhex(T.fingerprint(F.coalesce("text", F.lit("")))).alias("fp"), short.alias("short"), F.floor(F.col("pos") / pos_span).alias("b"))
    block = Window.partitionBy("source_id", "b").orderBy("pos")

    def window(over) -> list[Column]:
        ahead = lambda c: [F.lead(c, k).over(over) if k else F.col(c) for k in range(w)]
        return [F.concat(*ahead("fp")).alias("key"), F.min("short").over(over.rowsBetween(0, w - 1)).alias("all_short"), F.array(*ahead("pos")).alias("places")]

    placed = written(prints.select("*", (F.row_number().over(block) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("source_id", "b")).alias("n"), *window(block)))
    counts = placed.where("i = 0").select("source_id", "b", "n")
    total = counts.groupBy("source_id").agg(F.sum("n").alias("total"))
    # The last rows of a block and the first of the next; a window is one if its rows follow each other.
    order = Window.partitionBy("source_id").orderBy("b")
    before = counts.select("source_id", "b", (F.sum("n").over(order) - F.col("n")).alias("before"))
    edges = placed.where((F.col("i") < w - 1) | (F.col("i") >= F.col("n") - (w - 1))).drop("key", "all_short", "places").join(before, ["source_id", "b"])
    edges = edges.withColumn("at", F.col("before") + F.col("i"))
    source = Window.partitionBy("source_id").orderBy("at")
    over_end = edges.select("source_id", "pos", *window(source), (F.lead("at", w - 1).over(source) - F.col("at")).alias("reach"), (F.col("i") + w > F.col("n")).alias("over")).where(F.col("over") & (F.col("reach") == w - 1))
    windows = placed.select("source_id", "pos", "key", "all_short", "places").where("key is not null").unionByName(over_end.drop("reach", "over")).where("not all_short")
    again = windows.groupBy("source_id", "key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("source_id", "key", "first")
    found = windows.join(broadcast_if_small(written(again), 160), ["source_id", "key"]).where(F.col("pos") > F.col("first")).join(total, "source_id").where(F.col("total") >= 2 * w)
    return written(found.select("source_id", F.explode("places").alias("pos")).distinct())


def dedupe(segments: DataFrame, window_size: int = 5, min_length: int = 4, span: int = SPAN, pos_span: int | None = None) -> DataFrame:
    """Segments without those in a window that came before in the same source; see ``repeated_rows``. What goes is found when
    this is called; the segments themselves are one plan, which reads them once more."""
    if window_size < 2:
        return segments
    return without_rows(segments, repeated_rows(segments, window_size, min_length, pos_span or span))


def without_rows(segments: DataFrame, gone: DataFrame) -> DataFrame:
    """Segments but those at the places (source_id, pos) of a written table."""
    places = broadcast_if_small(gone, F.length("source_id") + 56).withColumnsRenamed({"source_id": "_source", "pos": "_pos"})
    return segments.join(places, (F.col("source_id") == F.col("_source")) & (F.col("pos") == F.col("_pos")), "left_anti")


def redact(segments: DataFrame, rules: Sequence[RedactionRule] = DEFAULT_REDACTIONS) -> DataFrame:
    """Texts with each rule's hits replaced, rule after rule, and ``hits``: an array of counts in the rules' order."""
    counts = [f"_hits{i}" for i in range(len(rules))]
    patterns = [java_regex(r.pattern, r.flags) for r in rules]
    # A text that no rule hits as it stands is never changed, so no rule is hit at all; most are such. Most of these have no
    # character that a hit would have, and are searched for that alone.
    any_hit = F.lit(False)
    for p in patterns:
        any_hit = any_hit | F.col("text").rlike(p)
    may = may_hit(F.col("text"), [(r.pattern, r.flags) for r in rules])
    any_hit = any_hit if may is None else may & any_hit
    out = segments.drop("hits").withColumn("_any", F.coalesce(any_hit, F.lit(False)))
    none = F.lit(0).cast("long")
    for r, name, pattern in zip(rules, counts, patterns, strict=True):
        # Each rule is a projection of its own, so a text is computed once however many rules follow.
        count = F.regexp_count("text", F.lit(pattern)).cast("long")
        if "g" in r.flags:
            new = F.regexp_replace("text", pattern, T.literal(r.replacement))
        else:
            count, new = F.least(count, F.lit(1).cast("long")), T.replace_first(F.col("text"), pattern, r.replacement)
        out = out.withColumns({name: F.when(F.col("_any"), count).otherwise(F.when(F.col("text").isNotNull(), none)), "text": F.when(F.col("_any"), new).otherwise(F.col("text"))})
    others = [c for c in segments.columns if c not in ("text", "hits")]
    return out.select(*others, "text", (F.array(*counts) if counts else F.array().cast("array<bigint>")).alias("hits"))


def redaction_hits(redacted: DataFrame, rules: Sequence[RedactionRule], by: Sequence[str] = ()) -> DataFrame:
    """(…by, rule, hits) for rules with a hit."""
    sums = redacted.groupBy(*by).agg(*(F.sum(F.get("hits", F.lit(i))).alias(f"_{i}") for i in range(len(rules))))
    pairs = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"_{i}").alias("hits")) for i, r in enumerate(rules)))
    named = sums.select(*by, F.explode(pairs).alias("p")).select(*by, "p.rule", "p.hits").where("hits > 0")
    return named.groupBy(*by, "rule").agg(F.sum("hits").alias("hits"))


@dataclass(frozen=True)
class Cleaned:
    """Segments after cleaning (with ``hits``), before it, and the places that de-duplication took out (or None).

    ``marked``, where there is one, is a written table of all segments with what became of each; segments and statistics are
    then read from it.
    """

    segments: DataFrame
    split: DataFrame
    gone: DataFrame | None
    config: CleanConfig
    marked: DataFrame | None = None

    def _mark(self) -> DataFrame:
        """All segments, redacted, with ``_noise`` and ``_gone``; of those that go, the text goes too."""
        rows = self.split.withColumn("_noise", is_noise(F.col("text"), self.config.noise_rules))
        if self.gone is None:
            rows = rows.withColumn("_gone", F.lit(False))
        else:
            places = broadcast_if_small(self.gone, F.length("source_id") + 56).select(F.col("source_id").alias("_source"), F.col("pos").alias("_pos"), F.lit(True).alias("_gone"))
            rows = rows.join(places, (F.col("source_id") == F.col("_source")) & (F.col("pos") == F.col("_pos")), "left").withColumn("_gone", F.coalesce("_gone", F.lit(False))).drop("_source", "_pos")
        return redact(rows.withColumn("text", F.when(~F.col("_noise") & ~F.col("_gone"), F.col("text"))), self.config.redaction_rules)

    def written(self) -> Cleaned:
        """The same, written in one pass: what reads segments and statistics afterwards runs no rule again."""
        marked = written(self._mark())
        kept = marked.where(~F.col("_noise") & ~F.col("_gone"))
        return replace(self, segments=kept.select(*self.segments.columns), marked=marked)

    def stats(self, by: Sequence[str] = ("source_id",)) -> DataFrame:
        """(…by, input_segments, noise_removed, dedup_removed, output_segments, redaction_hits as a map), in one pass."""
        rules = self.config.redaction_rules
        marked = self._mark() if self.marked is None else self.marked
        noise, gone = F.col("_noise"), F.col("_gone")
        kept = ~noise & ~gone
        hits = [F.coalesce(F.sum(F.when(kept, F.get("hits", F.lit(i)))), F.lit(0).cast("long")) for i in range(len(rules))]
        counts = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("input_segments"), F.count_if(noise).alias("noise_removed"), F.count_if(~noise & gone).alias("dedup_removed"), F.count_if(kept).alias("output_segments"), *(h.alias(f"_h{i}") for i, h in enumerate(hits)))
        by_rule = _summed([r.name for r in rules])
        return counts.select(*by, "input_segments", "noise_removed", "dedup_removed", "output_segments", by_rule.alias("redaction_hits"))


def _summed(names: Sequence[str]) -> Column:
    """Columns _h0, _h1, ... as a map by name, those of one name summed, without zeros, in the order of names."""
    by_name: dict[str, Column] = {}
    for i, name in enumerate(names):
        by_name[name] = by_name[name] + F.col(f"_h{i}") if name in by_name else F.col(f"_h{i}")
    if not by_name:
        return F.create_map().cast("map<string,bigint>")
    return F.map_filter(F.create_map(*(x for name in sorted(by_name) for x in (F.lit(name), by_name[name]))), lambda _, v: v > 0)


def clean(segments: DataFrame, config: CleanConfig = CleanConfig(), pos_span: int | None = None) -> Cleaned:
    """Noise filter, de-duplication, redaction, in this order. ``pos_span``: positions of a block, for positions with gaps."""
    quiet = drop_noise(segments, config.noise_rules)
    d = config.dedup
    gone = repeated_rows(quiet, d.window_size, d.min_segment_length, pos_span or SPAN) if d.enabled and d.window_size >= 2 else None
    unique = quiet if gone is None else without_rows(quiet, gone)
    return Cleaned(redact(unique, config.redaction_rules), segments, gone, config)
