"""Transcripts gather a bounded number of lines, however long a week is."""

import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import distill as D


def fold(lines, budget):
    used, taken = 0, []
    for line in lines:
        if used + len(line) <= budget:
            used, taken = used + len(line), [*taken, line]
    return taken


@pytest.mark.parametrize("budget", [40, 300])
def test_transcripts_by_brute_force(spark, budget):
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(2)}", pos, None if pos % 3 else 1749722400000 + 86_400_000 * rng.randrange(9), "user", rng.choice("ab") * rng.choice([0, 1, 5, 20, 30, 400])) for pos in rng.sample(range(10_000), 600)]
    m = spark.createDataFrame(rows, "source_id string, pos long, ts_ms long, role string, text string")
    lines = D.with_week(m).select("source_id", "week", "pos", D.transcript_line().alias("line")).orderBy("pos").collect()
    weeks = {}
    for r in lines:
        weeks.setdefault((r.source_id, r.week), []).append(r.line)
    got = {(r.source_id, r.week): r for r in D.transcripts(m, budget).collect()}
    assert set(got) == set(weeks)
    for key, all_lines in weeks.items():
        taken = fold(all_lines, budget)
        assert (got[key].taken, got[key].left_out) == (len(taken), len(all_lines) - len(taken))
        assert got[key].transcript.split("\n")[: len(taken)] == taken


def test_an_undated_week_is_not_gathered_whole(spark, monkeypatch):
    m = spark.range(60_000).select(F.lit("hot").alias("source_id"), F.col("id").alias("pos"), F.lit(None).cast("long").alias("ts_ms"), F.lit("user").alias("role"), F.repeat(F.lit("x"), (F.col("id") % 3).cast("int") + 80).alias("text"))
    collect_list, most = F.collect_list, 3 * (600 // 80)
    monkeypatch.setattr(F, "collect_list", lambda x: F.when(F.size(collect_list(x)) <= most, collect_list(x)).otherwise(F.raise_error(F.lit("too many lines gathered"))))
    r = D.transcripts(m, 600).first()
    assert (r.taken, r.left_out) == (6, 59_994)
