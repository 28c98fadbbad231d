"""A training corpus from raw documents: language, lines, near copies, benchmark passages, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; every stage but the last returns the columns of
``documents``. ``run`` writes each result as Parquet in the shared folder and gives it to the next stage.

What all stages have in common: each decides row by row, so null or repeated doc_ids and repeated rows lose nothing but what
the stage is there to take out. An empty table gives an empty table. Texts count whole, whatever their length. Columns besides
those of ``documents`` come through the filters as they are, whatever their names, and are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import decontaminate, langid, linededup, ngramjoin, packing
from chatloom.llm.common import cut, new_dir, table, temporary, unused, vocabulary, with_row_key

#: Least posterior probability of the predicted language; texts without a letter have none.
LEAST_SCORE = 0.5


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose text has no recognisable language go; ``lang`` becomes the predicted language.

    Null, empty and letterless texts go. Null lang or doc_id: judged like any other. Equal probabilities: the language that
    comes first by name. Repeated rows: each is judged. Without a labelled row nothing is recognised, so nothing stays.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    kept = langid.judged(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that an earlier line repeats or nearly repeats go; documents left without a word go.

    Earlier is by doc_id (null first), then by row, then by line. Null text, and text without a word: stays. Repeated rows:
    the first stays. ``n_chars`` becomes the length of what is left, null for null text.
    """
    rest = linededup.dedup_lines(docs)
    return rest.withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component one row stays, that with the smallest doc_id; null ids come last.

    Of equal doc_ids in a component the first row stays, so of repeated rows one. Null text, and text without a word: in no
    component, stays.
    """
    rows, row = with_row_key(docs)
    of, component = unused(rows, "of", "component")
    members = ngramjoin.jaccard_components(rows, key=row).select(F.col(row).alias(of), F.col("component_id").alias(component))
    members = cut(members.join(rows.select(row, "doc_id"), F.col(of) == F.col(row)).select(of, component, "doc_id"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(of).alias("row")))
    heads = members.groupBy(component).agg(first.alias("first")).select(F.col("first.row").alias(of))
    copies = cut(members.join(heads, of, "left_anti").select(of), "copies")
    return rows.join(copies, F.col(row) == F.col(of), "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows that hold a benchmark item go.

    Null text, and text without a word: holds nothing, stays. Of repeated rows all go or stay. An empty benchmark: all stay.
    """
    rows, row = with_row_key(docs)
    (of,) = unused(rows, "of")
    leaks = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), key=row)
    return rows.join(cut(leaks.select(F.col(row).alias(of)).distinct(), "leaks"), F.col(row) == F.col(of), "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the ids of all documents in sequences of at most 4096, with the ids.

    Null and empty text: the end id alone. Null doc_id: packed, without a name. Repeated rows: each is packed.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [
    ("language ID", keep_language),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack),
]

#: Naive Bayes scores and token ids are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on ``documents``. What a stage wrote besides its result is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_dir(spark, f"stage-{name.split()[0].lower()}")
        with temporary(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
