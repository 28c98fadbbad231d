"""Cleaning and structuring against plain Python and worked examples."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.functions import times
from chatloom.operators import clean as C
from chatloom.operators import structure as S
from chatloom.plans.pipeline import segments_of


def lines(spark, texts, source="a"):
    return spark.createDataFrame([(source, i, t) for i, t in enumerate(texts)], "source_id string, pos long, text string")


def texts_of(df):
    return [r.text for r in df.orderBy("pos").collect()]


def test_noise_drops_and_keeps(spark):
    rows = lines(spark, ["好的", "4G", "  12 ", "网络连接已断开，请重试", "正在输入…", "12\n", "1234", "", None, "wifi"])
    assert texts_of(C.drop_noise(rows)) == ["好的", "1234", "wifi"]


def by_the_book(texts, w, m):
    """Windows in order; a window seen before takes its rows out, whatever was taken out already."""
    if w < 2 or len(texts) < 2 * w:
        return texts
    seen, gone = set(), set()
    for i in range(len(texts) - w + 1):
        part = texts[i : i + w]
        if all(len(t.strip()) < m for t in part):
            continue
        key = "|".join(hashlib.sha256(re.sub(r"\s", "", t).lower().encode()).hexdigest()[:16] for t in part)
        if key in seen:
            gone.update(range(i, i + w))
        seen.add(key)
    return [t for i, t in enumerate(texts) if i not in gone]


@pytest.mark.parametrize("span", [4, 7, 4096])
def test_window_dedup_by_simulation(spark, span):
    rng = random.Random(span)
    runs = [[rng.choice(["alpha", "beta", "Alpha ", "x", "yy", "delta"]) for _ in range(rng.randrange(0, 40))] for _ in range(30)]
    runs += [["one long line"] * 10, [f"line {i % 12} is here" for i in range(24)], ["嗯", "好"] * 7]
    rows = spark.createDataFrame([(str(k), 3 * i, t) for k, r in enumerate(runs) for i, t in enumerate(r)], "source_id string, pos long, text string")
    got = C.dedupe(rows, 3, 4, span=span).collect()
    for k, r in enumerate(runs):
        assert [x.text for x in sorted((x for x in got if x.source_id == str(k)), key=lambda x: x.pos)] == by_the_book(r, 3, 4), r


def test_redaction_in_order_with_hits(spark):
    rows = lines(spark, ["call 13812345678 or 13912345678", "id 11010519900307123X", "long 1381234567890", "学号：20230001 $1", "plain"])
    got = C.redact(rows).orderBy("pos").collect()
    assert [r.text for r in got] == ["call [已脱敏:手机号] or [已脱敏:手机号]", "id [已脱敏:身份证号]", "long 1381234567890", "[已脱敏:证件号] $1", "plain"]
    hits = {r.rule: r.hits for r in C.redaction_hits(C.redact(rows), C.DEFAULT_REDACTIONS).collect()}
    assert hits == {"phone": 2, "id_card_18": 1, "student_id": 1}
    once = C.redact(lines(spark, ["a1 b2"]), [C.RedactionRule("n", r"\d", r"<$1\>", "i")]).first()
    assert once.text == r"a<$1\> b2" and once.hits == [1]


def test_many_rules_are_analysed_fast(spark):
    import time

    rules = [C.RedactionRule(f"r{i}", rf"x{i}(?!\d)", f"<{i}>", "" if i % 4 else "g") for i in range(20)]
    began = time.time()
    found = C.redact(lines(spark, [" ".join(f"x{i}. x{i}." for i in range(20)).replace(".", "")]), rules)
    found.schema, found._jdf.queryExecution().optimizedPlan()
    assert time.time() - began < 5
    r = found.first()
    assert r.text.split() == [w for i in range(20) for w in (f"<{i}>", f"<{i}>" if i % 4 == 0 else f"x{i}")] and r.hits == [2 if i % 4 == 0 else 1 for i in range(20)]


def test_cleaning_reads_its_input_once_a_pass(spark, sf_dir):
    from chatloom.plans import queries as Q

    plan = C.clean(Q.doc_lines(spark, sf_dir), Q.CONFIG, Q.BLOCK).segments._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1 and plan.count("Exchange ") + plan.count("BroadcastExchange") <= 3


def test_split_at_boundaries_and_lines(spark):
    docs = spark.createDataFrame([("a", "intro\nAda: 06-01 10:00:00 hi​ there Bob：6-2 9:05 yes\nmore Ada: 06-03 10:00 "), ("b", " x \n\n y\r\nz"), ("c", None)], "source_id string, text string")
    got = [(r.source_id, r.pos, r.header, r.text) for r in C.split_text(docs).orderBy("source_id", "pos").collect()]
    assert got == [("a", 0, None, "intro"), ("a", 1, "Ada: 06-01 10:00:00", "hi there"), ("a", 2, "Bob：6-2 9:05", "yes\nmore"), ("a", 3, "Ada: 06-03 10:00", ""), ("b", 0, None, "x"), ("b", 1, None, "y"), ("b", 2, None, "z")]
    at_start = C.split_lines(lines(spark, ["Ada: 06-01 10:00 hi", "then Ada: 06-01 10:00 hi", "Ada: 06-01 10:00", "  "])).orderBy("pos").collect()
    assert [(r.header, r.text) for r in at_start] == [("Ada: 06-01 10:00", "hi"), (None, "then Ada: 06-01 10:00 hi"), (None, "Ada: 06-01 10:00")]


def test_clean_statistics(spark):
    rows = lines(spark, [*(f"unique line {i}" for i in range(12)), "4G", *(f"unique line {i}" for i in range(12)), "tel 13812345678"])
    found = C.clean(rows.withColumn("header", F.lit(None).cast("string"))).stats().first()
    assert (found.input_segments, found.noise_removed, found.dedup_removed, found.output_segments, found.redaction_hits) == (26, 1, 12, 13, {"phone": 1})


def test_config_merges(tmp_path):
    (tmp_path / "c.json").write_text('{"noiseRules": [{"type": "exact", "pattern": "x"}], "dedup": {"windowSize": 3}}')
    got = C.load_config(str(tmp_path / "c.json"))
    assert got.noise_rules == (C.NoiseRule("exact", "x"),) and got.dedup == C.Dedup(True, 3, 4) and got.redaction_rules == C.DEFAULT_REDACTIONS
    with pytest.raises(ValueError):
        C.java_regex("a", "y")
    assert C.java_regex("a[[$]$", "gi") == r"(?iu)a[\[$]\z"


def test_headers_and_aliases(spark):
    rows = spark.createDataFrame(
        [("a", 0, "Ada: 06-01 10:00:05", "hi"), ("a", 1, "dia_image1.jpeg)Nova: 02-31 09:30", "x"), ("a", 2, "Stranger: 13-32 99:99:99", "y"), ("a", 3, None, "z")],
        "source_id string, pos long, header string, text string",
    )
    got = S.structure_segments(rows, {"No": "system", "Nova": "assistant", "Ada": "user"}, base_year=2026).orderBy("pos").collect()
    assert [(r.role, r.ts_ms, r.meta.speaker, r.pending) for r in got] == [
        ("user", 1780308005000, "Ada", False), ("assistant", 1772530200000, "dia_image1.jpeg)Nova", False), ("unlabeled", None, "Stranger", True), ("unlabeled", None, None, True),
    ]
    assert [(r.meta.role_matched, r.meta.raw_time, r.meta.pending_label) for r in got] == [("Ada", "06-01 10:00:05", None), ("Nova", "02-31 09:30", None), (None, "13-32 99:99:99", True), (None, None, True)]
    stats = S.structure_stats(S.structure_segments(rows)).first()
    assert (stats.total, stats.by_role, stats.pending_label) == (4, {"unlabeled": 4}, 4)


def test_raw_messages_keep_what_they_were(spark):
    from chatloom.schemas import RAW

    meta = {"speaker": "S", "extra": '{"turn":3}'}
    raw = spark.createDataFrame([("a", 0, "user", " \u3000hi\n", 5, meta), ("a", 1, "narrator", "tel 13812345678", None, meta), ("a", 2, None, " \n", 7, None)], RAW)
    assert C.clean(segments_of(raw, C.CleanConfig())).stats().first().input_segments == 2
    cleaned = C.clean(segments_of(raw, C.CleanConfig())).segments
    got = S.structure_segments(cleaned).orderBy("pos").collect()
    assert [(r.role, r.text, r.ts_ms, r.meta.original_role, r.meta.speaker, r.meta.extra, r.pending) for r in got] == [("user", "hi", 5, None, "S", '{"turn":3}', False), ("unlabeled", "tel [已脱敏:手机号]", None, "narrator", "S", '{"turn":3}', False)]


def test_times_and_meta_of_raw_messages(spark):
    import json

    rows = spark.createDataFrame([("a", 0, "user", "x", "1749853657500", '{"speaker":"S","rawTime":"t","turn":3,"tags":["a"]}'), ("a", 1, "bot", "y", "2025-06-13T22:27:37Z", None), ("a", 2, None, "z", "soon", "{}")], "source_id string, pos long, role string, text string, ts string, meta string")
    got = S.structure_raw(rows).orderBy("pos").collect()
    assert [r.ts_ms for r in got] == [1749853657500, 1749853657000, None] and got[1].meta.original_role == "bot" and got[1].meta.source == "structured"
    assert (got[0].meta.speaker, got[0].meta.raw_time, json.loads(got[0].meta.extra)) == ("S", "t", {"turn": 3, "tags": ["a"]}) and got[2].meta.extra is None
    mapped = rows.withColumn("meta", F.from_json("meta", "map<string,string>"))
    assert json.loads(S.structure_raw(mapped).orderBy("pos").first().meta.extra) == {"turn": "3", "tags": '["a"]'}
    assert S.structure_raw(rows.drop("meta", "ts", "role")).where("role = 'unlabeled' and ts_ms is null").count() == 3


@pytest.mark.parametrize("text, ok", [("{}", True), ("\ufeff [1] ", True), ("1", True), ('"x"', True), ("null", True), ("[1] x", False), ("[1]]", False), ("[1],[2]", False), ("{}}", False), ("{'a':1}", False), ("NaN", False), ("[Infinity]", False), ("", False), (None, False), ('{"a":1,"a":2}', True), ("01", False), ('1,"end":1} x', False), ("[" * 50 + "]" * 50, True)])
def test_strict_json(spark, text, ok):
    from chatloom.functions.jsonx import strict_json

    found = spark.createDataFrame([(text,)], "t string").select(strict_json(F.col("t")).alias("x")).first().x
    assert (found is not None) == ok and (not ok or found == text.replace("\ufeff", "").strip())


class Labels:
    name = "mock"

    def chat(self, system, user):
        return "none" if "zap" in user else '```json\n[{"role":"user","text":"one"},{"role":"boss","text":" two "},{"role":"user"}]\n```'


def test_plain_lines_with_and_without_a_provider(spark):
    docs = spark.createDataFrame([("a", "l1\n\nl2"), ("b", "zap\nx")], "source_id string, text string")
    plain = S.structure_lines(docs).orderBy("source_id", "pos").collect()
    assert [(r.source_id, r.text, r.role, r.pending) for r in plain] == [("a", "l1", "unlabeled", True), ("a", "l2", "unlabeled", True), ("b", "zap", "unlabeled", True), ("b", "x", "unlabeled", True)]
    told = S.structure_lines(docs, Labels).orderBy("source_id", "pos").collect()
    assert [(r.source_id, r.pos, r.text, r.role, r.pending) for r in told] == [("a", 0, "one", "user", False), ("a", 1, " two ", "unlabeled", False), ("b", 0, "zap", "unlabeled", True), ("b", 1, "x", "unlabeled", True)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("2025-06-13T22:27:37.500Z", 1749853657500), ("2025-06-13", 1749772800000), ("2025-06-13T22:27:37+02:00", 1749846457000), ("", None), ("nonsense", None), ("2025-13-45", None)],
)
def test_iso_times(spark, text, want):
    assert one(spark, times.parse_iso_ms(F.lit(text))) == want


def test_other_times(spark):
    epoch = lambda v: one(spark, times.epoch_to_ms(F.lit(v)))
    assert [epoch("1749853657"), epoch("1749853657.25"), epoch(1749853657500), epoch("-1"), epoch("0"), epoch("x"), epoch(None)] == [1749853657000, 1749853657250, 1749853657500, None, None, None, None]
    assert one(spark, times.parse_ts(F.lit("1749853657"))) == 1749853657
    sent = lambda v: one(spark, times.parse_send_date(F.lit(v)))
    assert [sent("June 13, 2025 10:27:37pm"), sent("May 19, 2023 12:07am"), sent("1749853657"), sent("soon")] == [1749853657000, 1684454820000, 1749853657000, None]
    assert [sent("May 19, 2023 10:07 p.m."), sent("May 19, 2023 10:07 A.M."), sent("May 19, 2023 10:07pm garbage"), sent("Mayhem 19, 2023 10:07pm"), sent("Dec 1, 2023 12:00:01 pm"), sent("J 1, 2023 1:00am")] == [1684534020000, 1684490820000, None, None, 1701432001000, 1672534800000]
    assert [one(spark, times.iso_week(F.lit(x).cast("bigint"))) for x in (1767225600000, 1798675200000, None)] == ["2026-W01", "2026-W53", "unknown"]


def test_text_functions(spark):
    assert one(spark, T.trim(F.lit(" 　 x y ﻿\n"))) == "x y"
    assert one(spark, T.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, T.decode_entities(F.lit("&#x4F60;&#22909; &lt;b&gt; &amp;lt; &#38;lt; &#x110000;|&nbsp;&copy;"))) == "你好 <b> &lt; < | &copy;"
    assert one(spark, T.preview(F.lit("ab😀cd"), 4)) == "ab😀…" and one(spark, T.preview(F.lit("ab"), 2)) == "ab"
    page = "<html><head><title> A &amp;\n B </title><style>p{}</style></head><!-- <p>no</p> --><body><p>one<b> two</b></p>three<br>four<SCRIPT>x()</SCRIPT ><ul><li>five&#160; six</ul></body>"
    assert one(spark, T.html_title(F.lit(page))) == "A & B" and one(spark, T.html_title(F.lit("<p>x"))) is None
    assert one(spark, T.html_blocks(F.lit(page))) == ["one two", "three", "four", "five six"]


def test_written_cleaning_is_read_and_not_run_again(spark):
    rows = spark.createDataFrame([("a", i, None, t) for i, t in enumerate(["one two", "4G", "tel 13812345678", "x y z", *[f"line {k}" for k in range(6)], *[f"line {k}" for k in range(6)], None, " "])], "source_id string, pos long, header string, text string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    plain = C.clean(rows)
    counted = C.clean(rows.mapInPandas(count, rows.schema))
    before = seen.value  # what de-duplication read
    written = counted.written()
    assert seen.value == before + rows.count()
    as_rows = lambda df: sorted(map(repr, df.collect()))
    assert as_rows(written.segments.select(*plain.segments.columns)) == as_rows(plain.segments)
    assert as_rows(written.stats()) == as_rows(plain.stats()) and written.stats().first().redaction_hits == {"phone": 1}
    assert seen.value == before + rows.count()
    plan = written.stats()._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "RLIKE" not in plan.upper() and plan.count("FileScan") == 1
