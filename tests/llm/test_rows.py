"""Filters decide by row: doc_ids that repeat, are null or stand for two texts."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import common, linededup, quality


def text(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_of_equal_rows_one_stays(spark, docs):
    rows = docs([(1, text("a")), (1, text("a")), (None, text("b")), (None, text("b")), (5, text("c")), (5, text("a")), (None, text("c")), (7, None), (7, None)])
    got = kept(corpus_pipeline.keep_one_of_each_group(spark, rows.select("doc_id", "text", "lang", "source", "n_chars"), ""))
    assert got == sorted([(1, text("a")), (None, text("b")), (5, text("c")), (7, None), (7, None)], key=repr)


def test_lines_go_from_the_row_that_repeats_them(spark, docs):
    rows = docs([(1, text("a", 8)), (1, text("a", 8)), (2, text("b", 8) + "\n" + text("c", 8)), (2, text("d", 8) + "\n" + text("a", 8)), (None, text("e", 8)), (None, text("e", 8))])
    got = kept(linededup.dedup_lines(rows))
    assert got == sorted([(1, text("a", 8)), (2, text("b", 8) + "\n" + text("c", 8)), (2, text("d", 8)), (None, text("e", 8))], key=repr)


def test_a_leak_takes_its_row_alone(spark, docs, tmp_path):
    spark.createDataFrame([(1, text("v", 20))], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    rows = docs([(9, text("a")), (9, text("b", 5) + " " + text("v", 20)), (None, text("c")), (None, text("v", 20))])
    assert kept(corpus_pipeline.drop_benchmark(spark, rows, str(tmp_path))) == sorted([(9, text("a")), (None, text("c"))], key=repr)


def test_frequent_lines_count_for_their_row(spark, docs):
    common = text("common", 16)
    rows = [(i, f"{common}\n{text(f'w{i}x', 30)}") for i in range(30)] + [(50, f"{common}\n{text('u', 5)}"), (50, text("own", 40)), (None, f"{common}\n{text('n', 30)}"), (None, text("m", 40))]
    got = sorted(((r.doc_id, r.n_words, r.n_line_words, r.kept) for r in quality.judge(docs(rows)).where("doc_id is null or doc_id = 50").collect()), key=repr)
    assert got == sorted([(50, 21, 16, False), (50, 40, 0, True), (None, 46, 16, True), (None, 40, 0, True)], key=repr)
    left = kept(quality.remove_frequent_lines(docs(rows)).where("doc_id is null or doc_id = 50"))
    assert left == sorted([(50, text("u", 5)), (50, text("own", 40)), (None, text("n", 30)), (None, text("m", 40))], key=repr)


def test_short_lines_are_compared_for_equality(spark, docs):
    rows = docs([(1, "Read more\n" + text("a", 8)), (2, "read  more\nRead less\n" + text("b", 8)), (3, "Read more"), (4, "x y z w"), (5, "x y z w v")])
    got = {(r.doc, r.line_no): (r.repeat, r.near) for r in linededup.judged_lines(rows).collect()}
    assert got == {(d, k): ((d, k) in {(2, 0), (3, 0)}, False) for d, k in [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (4, 0), (5, 0)]}
    assert kept(linededup.dedup_lines(rows)) == [(1, "Read more\n" + text("a", 8)), (2, "Read less\n" + text("b", 8)), (4, "x y z w"), (5, "x y z w v")]


EDGES = [(1, None, None, None), (2, "", "en", None), (3, " \n\t ", "en", "s"), (None, None, None, None), (None, "alone here with five words", "en", "s"), (4, "12 34", "en", "s"), (4, "12 34", "en", "s"), (5, "word " * 20_000, "de", "s"), (6, text("k"), None, "s"), (6, text("k"), None, "s"), (7, text("k"), "en", "s")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, docs, tmp_path, name, stage):
    """Nulls, empty and very long texts, repeated rows, an empty table, and columns with clashing names."""
    spark.createDataFrame([(1, text("v", 20)), (None, None)], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    extra = ["row", "r", "of", "links", "rest", "component", "text_hash", "h", "uid", "lang_pred", "score", "_row", "key", "k", "doc", "at"]
    rows = docs(EDGES).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(i).alias(c) for i, c in enumerate(extra)))
    found = stage(spark, rows, str(tmp_path))
    got = found.collect()
    assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
    if name == "packing":
        assert sum(r.start == 0 for r in got) == len(EDGES)
        return
    assert found.columns == rows.columns and {tuple(r)[5:] for r in got} == {tuple(range(len(extra)))}
    left = sorted((r.doc_id, r.text) for r in got if r.text and r.doc_id is not None)
    long, same = (5, "word " * 20_000), text("k")
    want = {
        "language ID": [long, (6, same), (6, same), (7, same)],
        "line dedup": [(3, " \n\t "), (4, "12 34"), long, (6, same)],
        "n-gram Jaccard join": [(3, " \n\t "), (4, "12 34"), long, (6, same)],
        "benchmark decontamination": [(3, " \n\t "), (4, "12 34"), (4, "12 34"), long, (6, same), (6, same), (7, same)],
    }
    assert left == want[name]
    blank = sorted(((r.doc_id, r.text) for r in got if not r.text), key=repr)
    assert blank == ([] if name == "language ID" else sorted([(1, None), (2, ""), (None, None)], key=repr))


def test_what_stages_write_is_deleted(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert sorted(x.rpartition("-")[0] for x in os.listdir(tmp_path)) == sorted(f"stage-{n.split()[0].lower()}" for n, _ in corpus_pipeline.STAGES)
