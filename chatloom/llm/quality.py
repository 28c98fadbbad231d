"""Quality rules by cross-document line frequency (operator 2).

Lines are normalised and hashed, and for each host the distinct documents that hold a line are counted; lines in more
documents than the limit allows are taken out, and a document that is left with too little is rejected. A few counts of
the text itself (repeated windows, repeated lines, symbols) decide first. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import cut, let, unused, with_row_key, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Words of a window for ``n_repeat_words``.
WINDOW = 8


def n_repeat_words(words: Column) -> Column:
    """Words that lie in 8-word windows found twice or more in the text, the first one included."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))

    def covered(found: Column) -> Column:
        # Equal windows are neighbours once sorted; their places, sorted again, give the words that they cover.
        keyed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(keyed, lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        gaps = let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x))
        return F.coalesce(gaps, F.lit(0).cast("long"))

    found = let(windows, lambda f: F.when(F.size(F.array_distinct(f)) == F.size(f), F.lit(0).cast("long")).otherwise(covered(f)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(found)


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    worded = docs.select(*keep, text.alias("_t"), words_of(text).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    counted = worded.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("_w")).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words")))


def normalised(line: Column) -> Column:
    """A line for comparison: lower case, digits as 0, only letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", "0"), r"[^\p{L}\p{Nd}]+", " "))


def _line(line: Column) -> Column:
    return F.struct(F.xxhash64(normalised(line)).alias("line_hash"), F.size(words_of(line)).alias("n_words"))


def line_table(docs: DataFrame, key: str, host: str) -> DataFrame:
    """Lines with a word: key, host, text_hash, line_no, line_hash, n_words. Texts stay in the tasks that read them."""
    text = F.coalesce("text", F.lit(""))
    found = F.transform(F.split(text, "\n"), _line)
    lines = docs.select(F.col(key).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("text_hash"), F.posexplode(found).alias("line_no", "l"))
    return lines.select("key", "host", "text_hash", "line_no", "l.*").where("n_words > 0")


def frequent_lines(lines: DataFrame, most: int) -> DataFrame:
    """(host, line_hash) of lines that are in more than ``most`` distinct documents of their host, whatever its size.

    Documents with equal texts are one document, as copies are another operator's business: else every line of a page that is
    there in ``most`` copies would be frequent, and no copy of it would be left.
    """
    held = lines.select("host", "line_hash", "text_hash").distinct()
    return held.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > most).select("host", "line_hash")


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", most: int = 25, least_left: float = 0.3) -> DataFrame:
    """Each document's counts, the words its frequent lines hold (``n_line_words``), ``base_failed`` and ``kept``.

    Kept: not failed by its own counts, and at least ``least_left`` of its words, and 20 of them, are outside lines that
    many documents of its host hold. Null text: no words, so it fails. Null host: the host ``""``. Each row is judged by its
    own lines, also where keys are null or repeat. Empty table: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.transform(F.split(text, "\n"), _line)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.filter(found, lambda x: x["n_words"] > 0).alias("lines"))
    # One pass over the texts; only counts and hashes are written, with a number for each row.
    rows = cut(base_counts(rows, ["id", "host", "text_hash", "lines"]).withColumn("key", F.monotonically_increasing_id()), "rows")
    lines = rows.select("key", "host", "text_hash", F.inline("lines"))
    removed = lines.join(frequent_lines(lines, most), ["host", "line_hash"]).groupBy("key").agg(F.sum("n_words").cast("long").alias("n_line_words"))
    judged = rows.drop("lines").join(removed, "key", "left").withColumn("lost", F.coalesce("n_line_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("lost")
    kept = ~F.col("base_failed") & (left >= F.lit(least_left) * F.col("n_words")) & (left >= 20)
    return judged.select(F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("lost").alias("n_line_words"))


def remove_frequent_lines(docs: DataFrame, key: str = "doc_id", host: str = "source", most: int = 25) -> DataFrame:
    """``docs`` with frequent lines taken out of ``text``; other columns as they are. Rows keep their lines' order.

    Null text stays null; a text may become empty. Null host: the host ``""``. Repeated rows and null or equal keys: each row
    is a text of its own. Empty table: no rows.
    """
    keyed, row = with_row_key(docs)
    lines = cut(line_table(keyed, row, host), "lines")
    of, gone = unused(keyed, "of", "gone")
    held = lines.join(frequent_lines(lines, most), ["host", "line_hash"]).groupBy(F.col("key").alias(of)).agg(F.collect_list("line_no").alias(gone))  # a document's own lines
    rows = keyed.join(held, F.col(row) == F.col(of), "left")
    rest = F.array_join(let(F.split("text", "\n"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.sort_array(F.col(gone))), lambda i: F.get(x, i))), "\n")
    return rows.select(*(F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(c) for c in docs.columns))
