"""Importance resampling against plain Python: features, weights, scores and the draw, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chatloom.llm import queries, resampling

ALPHABET = st.text(alphabet=st.sampled_from(list("abZ09 ,-é語\0\n")) | st.characters(codec="utf-8"), max_size=60)


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled_by_hand(rows, target, percent=5, least=20):
    t, s = Counter(), Counter()
    for side, texts in ((t, target), (s, [x for _, x in rows])):
        for x in texts:
            side.update(c % 10_000 for c in features_of(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for doc, x in rows:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        f = features_of(x)
        weight = sum(gain(c % 10_000) for c in f)
        out.append([doc, len(words_of(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for r in out:
        r.append(None)
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return out


def same(got, want):
    return sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, map(tuple, want)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | ALPHABET, max_size=8), st.integers(0, 3))
def test_features_are_those_of_plain_python(texts, cut):
    n, who, crc = resampling.features(pa.array(texts, pa.string()).slice(cut))
    for i, text in enumerate(texts[cut:]):
        assert n[i] == len(words_of(text)) and sorted(crc[who == i].tolist()) == sorted(features_of(text))


def test_long_words():
    texts = ["x" * n + " y " + "z" * (3 * n) for n in (63, 64, 65, 128, 4096, 100_001)]
    n, who, crc = resampling.features(pa.array(texts))
    assert all(sorted(crc[who == i].tolist()) == sorted(features_of(t)) for i, t in enumerate(texts))


def test_resampling_by_brute_force(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    target = [" ".join(word().replace("a", "b") for _ in range(30)) for _ in range(10)]
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got, want = resampling.resample(docs(rows), bench, percent=20).collect(), resampled_by_hand(rows, target, percent=20)
    assert same(got, want) and sum(r[5] is not None for r in want) > 30


def test_resampling_edges(spark, docs):
    # null and empty texts, null and repeated ids, repeated rows, a very long text; the fixture's other columns have clashing names
    long = " ".join(["word"] * 30)
    rows = [(1, None), (2, ""), (None, long), (None, None), (3, long), (3, long), (4, "a " * 200_000), (5, "x" * 300_000), *[(i, long) for i in range(10, 50)]]
    for target in ([], ["word word", None, ""]):
        bench = spark.createDataFrame([(x, "row", 1) for x in target], "text string, row string, bucket int")
        assert same(resampling.resample(docs(rows), bench, percent=50).collect(), resampled_by_hand(rows, target, percent=50))
    assert resampling.resample(docs(rows).limit(0), bench).collect() == []
    no_target = resampling.resample(docs([(1, "a"), (2, " ")]), bench.limit(0)).collect()
    assert {(r.doc_id, r.n_features, r["rank"]) for r in no_target} == {(1, 1, None), (2, 0, None)}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert same(queries.QUERIES["op13_importance_resampling"](spark, sf_dir).collect(), resampled_by_hand(rows, target))
