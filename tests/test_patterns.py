"""Many patterns at once: the automaton and the chain against plain Python, ties, and the time it takes to analyse."""

import random
import time

import pytest
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.functions.patterns import any_of, hit_chars, longest_of
from chatloom.operators import clean as C
from chatloom.operators import structure as S

TEXTS = [None, "", "a", "abcabc", "😀", "é̀x", "line\nbreak", "x" * 200_000 + "ab", *("".join(random.Random(i).choices("abcé😀 ", k=i % 40)) for i in range(300))]


def longest_by_hand(text, values):
    found = [p for p in values if text is not None and p in text]
    best = max(found, key=lambda p: len(p.encode("utf-16-le")), default=None)  # the first of equally long ones
    return None if best is None else (best, values[best])


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("empty", [False, True])
def test_longest_pattern_by_brute_force(spark, few, empty):
    rng = random.Random(few + empty)
    values = {"".join(rng.choices("abcé😀", k=rng.randrange(1, 4))): f"v{i}" for i in range(60)}  # many of one length
    if empty:
        values = {"": "none", **values}
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string")
    got = {r.i: r.x and tuple(r.x) for r in df.select("i", longest_of(F.col("t"), values, few).alias("x")).collect()}
    assert got == {i: longest_by_hand(t, values) for i, t in enumerate(TEXTS)}
    some = ["bb", "c\n", "é😀", *([""] if empty else [])]
    got = {r.i: r.x for r in df.select("i", any_of(F.col("t"), some, few).alias("x")).collect()}
    assert got == {i: None if t is None else any(p in t for p in some) for i, t in enumerate(TEXTS)}
    assert {r.x for r in df.select(any_of(F.col("t"), []).alias("x")).collect()} == {None, False} and df.select(longest_of(F.col("t"), {}).alias("x")).where("x is not null").count() == 0


def test_ten_thousand_aliases(spark):
    aliases = {f"name{i:05d}"[: 5 + i % 6]: ("user", "assistant")[i % 2] for i in range(10_000)}
    aliases |= {f"n{i}": "system" for i in range(10_000)}
    segments = spark.createDataFrame([("a", i, f"{w}: 06-01 10:00", "t") for i, w in enumerate(["xname00007y", "n12345", "n9999", "other", "nam"])], "source_id string, pos long, header string, text string")
    began = time.time()
    messages = S.structure_segments(segments, aliases, base_year=2025)
    messages.schema  # noqa: B018
    assert time.time() - began < 1
    got = {r.pos: (r.meta.role_matched, r.role) for r in messages.collect()}
    want = {i: longest_by_hand(w, aliases) for i, w in enumerate(["xname00007y", "n12345", "n9999", "other", "nam"])}
    assert got == {i: x or (None, "unlabeled") for i, x in want.items()}


def test_many_noise_rules_are_those_of_a_few(spark):
    rng = random.Random(9)
    rules = [C.NoiseRule("contains", "".join(rng.choices("abc", k=3))) for _ in range(12)] + [C.NoiseRule("exact", "x"), C.NoiseRule("regex", "^b+$")]
    more = [C.NoiseRule("contains", f"never {i}") for i in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "x", " x ", "bbb", "b b"])], "i long, t string")
    few, many = (df.select("i", C.is_noise(F.col("t"), r).alias("x")) for r in (rules, rules + more))
    assert sorted(few.collect()) == sorted(many.collect()) and few.where("x").count() > 10
    assert "ArrowEval" in many._jdf.queryExecution().executedPlan().toString() and "ArrowEval" not in few._jdf.queryExecution().executedPlan().toString()


RULES = (*C.DEFAULT_REDACTIONS, C.RedactionRule("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "[email]"), C.RedactionRule("sign", r"(?:\+|学){1,2}[^x]?", "#", ""))


@pytest.mark.parametrize(
    ("pattern", "flags", "want"),
    [(r"[a-z]+@[a-z]+\.de", "", "@"), (r"\b\d+\.\d", "", "0123456789"), (r"(?<!\d)(?:19|20)x", "", "12"), ("[]", "i", None), ("(?:ab|c)+", "", "ac"), ("(a)?b", "", "b"), (r"(a)b\1", "", None), ("7?", "", None), ("8|9*", "", None), ("[^a]", "", None)]
    + [(p, "", None) for p in (r"\v", r"\e", r"\p{L}", r"\Q+\E", r"\0123", "(?i)a", "(?x)a b", "(?<n>a)", "[]a]", "(", "x{0}", "(?=a)")]
    + [("k", "i", None), ("k5", "i", "5"), ("\u212a", "i", None)],
)
def test_characters_that_every_hit_has(pattern, flags, want):
    found = hit_chars(pattern, flags)
    assert found == (want if want is None else frozenset(want))


def test_texts_that_are_not_searched_have_no_hits(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", *("".join(rng.choices(["a", "@", ".", "de", "+", "\u5b66\u53f7", "A123456", "13800138000", " ", "x", "\n"], k=rng.randrange(9))) for _ in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
    got = sorted(C.redact(df, RULES).collect())
    assert sum(sum(r.hits) for r in got if r.text is not None) > 300
    monkeypatch.setattr(C, "may_hit", lambda text, rules: None)
    assert got == sorted(C.redact(df, RULES).collect())


def test_long_words_without_the_sign_of_a_rule_are_not_searched(spark):
    texts = spark.range(64).select(F.col("id").alias("pos"), F.repeat(F.when(F.col("id") >= 0, "word"), 10_000).alias("text"))
    began = time.time()
    assert C.redact(texts, RULES).agg(F.sum(F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] == 0
    assert time.time() - began < 20


def test_fingerprints_leave_out_each_kind_of_white_space(spark):
    texts = [*(f"A{chr(c)}b\0" for c in (*range(0, 0x3100), 0xFEFF) if not 0xD800 <= c < 0xE000), "", " ", "\u3000X\ufeff \ty"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = F.substring(F.sha2(F.lower(F.regexp_replace("t", f"[{T.SPACES}]+", "")), 256), 1, 16)
    assert df.where(T.fingerprint(F.col("t")) != want).count() == 0
