"""Provider calls that survive: failing providers, later runs, jobs that die, and what is sent."""

import os
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from chatloom.operators import distill as D
from chatloom.operators.ledger import answered
from chatloom.operators.structure import structure_lines
from chatloom.schemas import RAW
from chatloom.sources import texts as X


class Calls:
    """A provider that notes every call in a file of its own, and fails as told."""

    name = "calls"

    def __init__(self, folder, fails=lambda user, n: False):
        self.folder, self.fails = folder, fails

    def chat(self, system, user):
        name = f"{zlib.crc32(user.encode())}"
        n = len([x for x in os.listdir(self.folder) if x.startswith(f"{name}-")])
        (open(f"{self.folder}/{name}-{n}-{random.random()}", "w")).close()
        if self.fails(user, n):
            raise TimeoutError("no answer")
        return f"{system} {user}!"

    see = chat


@pytest.fixture
def notes(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def requests(spark, n):
    return spark.range(n).select(F.col("id"), F.lit("s").alias("system"), F.concat(F.lit("u"), (F.col("id") % (n // 2)).cast("string")).alias("user"))


def test_a_failing_provider_is_asked_for_the_rest_alone(spark, notes, tmp_path):
    ledger = str(tmp_path / "ledger")
    # each request fails at first; every third fails three times, which is all the tries of one run
    fails = lambda user, n: n < (3 if int(user[1:]) % 3 == 0 else 1)
    first = {r.id: (r.reply, r.error) for r in answered(requests(spark, 60), lambda: Calls(notes, fails), ledger).collect()}
    assert {i for i, (reply, _) in first.items() if reply is None} == {i for i in range(60) if i % 30 % 3 == 0}
    assert all((error == "TimeoutError: no answer") == (reply is None) for reply, error in first.values())
    before = len(os.listdir(notes))
    assert before == 10 * 3 + 20 * 2  # equal requests are one
    second = {r.id: (r.reply, r.error) for r in answered(requests(spark, 60), lambda: Calls(notes, fails), ledger).collect()}
    assert second == {i: (f"s u{i % 30}!", None) for i in range(60)} and len(os.listdir(notes)) == before + 10
    assert answered(requests(spark, 60), lambda: Calls(notes, lambda *_: True), ledger).where("error is null").count() == 60 and len(os.listdir(notes)) == before + 10


def test_a_job_that_dies_keeps_what_its_tasks_were_told(spark, notes, tmp_path):
    ledger = str(tmp_path / "ledger")

    class Dies(Calls):
        def chat(self, system, user):
            if user == "u77":
                time.sleep(6)  # meanwhile other tasks end
                raise KeyboardInterrupt  # not a failing call: the task dies, and with it the job
            return super().chat(system, user)

    with pytest.raises(Exception, match="KeyboardInterrupt|crashed|terminated|Job aborted|EOF"):
        answered(requests(spark, 400), lambda: Dies(notes), ledger)
    told, kept = -1, 0
    while told != len(os.listdir(notes)):  # tasks that run on when the job has failed
        told = len(os.listdir(notes))
        time.sleep(3)
        kept = spark.read.parquet(ledger).count()
    got = answered(requests(spark, 400), lambda: Calls(notes), ledger)
    assert got.where("reply is null").count() == 0 and kept > 0 and len(os.listdir(notes)) == told + 200 - kept


def test_operators_ask_once_over_two_runs(spark, notes, tmp_path):
    ledger = str(tmp_path / "ledger")
    lines = spark.createDataFrame([("a", "\n".join(f"line {i}" for i in range(150))), ("b", "one"), ("c", "")], "source_id string, text string")
    class Broken(Calls):
        def chat(self, system, user):
            super().chat(system, user)
            return '[{"role":"user","text":"x"},{"role":3,"text":"y"},{"text":""}]'

    got = structure_lines(lines, lambda: Broken(notes, lambda user, n: "line 100" in user and n < 3), ledger)
    assert sorted((r.source_id, r.role, r.text) for r in got.where("pos < 2").collect())[:2] == [("a", "unlabeled", "y"), ("a", "user", "x")]
    assert got.count() == 2 + 60 + 2 + 2 and got.where("pending").count() == 60
    again = structure_lines(lines, lambda: Broken(notes), ledger)
    assert again.count() == 8 and again.where("pending").count() == 0 and len(os.listdir(notes)) == 3 + 3 + 1

    messages = spark.createDataFrame([("a", i, "user", f"say {i}", 1700000000000 + i * 86400000 * 7, None) for i in range(3)], RAW).withColumn("meta", F.lit(None).cast(dict(spark.createDataFrame([], RAW).dtypes)["meta"]))
    before = len(os.listdir(notes))
    fails = lambda user, n: "say 1" in user and n < 6  # noqa: E731 - both calls of that week, three tries each
    found = D.distill(messages, lambda: Calls(notes, fails), ledger=ledger)
    assert sorted(r.call for r in found.failed.collect()) == ["anchors", "summary"] and found.summaries.count() == 3
    assert len(os.listdir(notes)) - before == 4 + 6 + 1
    found = D.distill(messages, lambda: Calls(notes), ledger=ledger)
    assert found.failed.count() == 0 and len(os.listdir(notes)) - before == 11 + 2 + 1  # the two, and the layers, whose prompt has one more summary

    pictures = spark.createDataFrame([("p", "p.png", bytearray(b"\x89PNG1")), ("q", "q.png", bytearray(b"\x89PNG2"))], "source_id string, path string, content binary")
    seen = X.seen_pictures(pictures, lambda: Calls(notes, lambda *_: True), ledger)
    assert {r.source_id: r.error for r in seen.collect()} == {"p": "TimeoutError: no answer", "q": "TimeoutError: no answer"}
    assert {r.raw for r in X.seen_pictures(pictures, lambda: Calls(notes), ledger).collect()} == {True}
