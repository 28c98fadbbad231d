"""Cutting at the default boundary from its times backwards, against the pattern itself."""

import random

from pyspark.sql import functions as F

from chatloom.operators import clean as C
from chatloom.sources import texts as X

PIECES = ["Ada: 06-01 10:00 ", "Ada：06-01 10:00:05\n", "x" * 25 + ": 1-2 3:04 ", ": 06-01 10:00 ", "hello ", " ", "\n", "Bob :  6-1  1:22:33　", "é ", "10:00 ", "06-01 ", "a:b ", "Ada: 06-01 10:00x", "Ada: 06-01 10:00:5 ", "::", "n: 1-1 1:11: 2-2 2:22 ", "Eve: 06-01 10:0", "　", "Zed:06-01 10:00 "]


def test_pieces_are_those_of_the_pattern(spark):
    rng = random.Random(7)
    rows = [(str(i), "".join(rng.choices(PIECES, k=rng.randrange(0, 12)))) for i in range(2000)] + [("none", None), ("empty", "")]
    df = spark.createDataFrame(rows, "source_id string, text string")
    # the same pattern under another name goes the plain way
    plain = C.CleanConfig(boundary="(?:)" + C.BOUNDARY)
    a, b = ({(r.source_id, r.pos): (r.header, r.text) for r in C.split_text(df, c).collect()} for c in (C.CleanConfig(), plain))
    assert a == b and sum(h is not None for h, _ in a.values()) > 2000
    wrong = df.select(X.boundary_count(F.col("text")).alias("n"), F.regexp_count("text", F.lit(C.java_regex(C.BOUNDARY))).alias("m")).where("not (n <=> m)")
    assert wrong.count() == 0


def test_redaction_where_one_rule_makes_a_hit_of_another(spark):
    rules = [C.RedactionRule("a", "cat", "dog"), C.RedactionRule("b", "dog", "bird"), C.RedactionRule("c", "bi", "BI", "")]
    rows = [("cat dog bird",), ("no",), ("bird bird",), (None,), ("cat",)]
    df = spark.createDataFrame(rows, "text string").selectExpr("'s' as source_id", "text")
    got = {r.text: r.hits for r in C.redact(df, rules).collect()}
    assert got == {"BIrd bird bird": [1, 2, 1], "no": [0, 0, 0], "BIrd bird": [0, 0, 1], None: [None, None, None], "BIrd": [1, 1, 1]}
