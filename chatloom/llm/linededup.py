"""Near-duplicate lines of a corpus by a deletion-neighbourhood join (operator 1).

Lines are sequences of lower-cased words, and one edit puts in, takes out or changes one word. A line's neighbourhood is
the line itself and the line without one of its words; a variant's key hashes what stands before and after the place where
the word is missing. Two lines within one edit have a key in common, and lines that have a key in common are within one
edit of each other, all of them: so lines and keys are joined, and no pairs are listed.

In the order of the corpus, a line stays unless a line that stays is within its bound: a line goes for a line that is there
to be read, never for one that goes itself. That is settled in rounds over (key, line): a line that is the earliest
undecided one of all its keys stays, the others of its keys go, and the rest takes part in the next round. The edit distance
of each line that goes to the line that stands for it is verified on the words themselves.

Before variants are emitted, lines that cannot have a neighbour are set aside: with one edit, either the first half of the
words or the last half is untouched (pigeonhole), so a line whose halves nobody shares has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import broadcast_if_small, cut, let, unused, with_row_key

#: One edit in ten words: lines with fewer words are compared for equality alone.
MIN_WORDS = 10
_SMALL = 1 << 40


def lines_of(text: Column) -> Column:
    """The lines of a text in lower case, with spaces for other white space; null text has one empty line."""
    spaced = lambda low: F.when(low.rlike(r"[\x09\x0B-\x0D]"), F.translate(low, "\t\x0b\x0c\r", "    ")).otherwise(low)
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.split(spaced(low), "\n"))


def line_words(line: Column) -> Column:
    """The words of such a line."""
    return F.array_remove(F.split(line, " "), "")


def line_table(docs: DataFrame, key: str, min_words: int) -> DataFrame:
    """Lines to compare: doc, line_no, h (hash of the words), n (words) and, for similarity, the keys of their halves."""
    words = F.transform(lines_of(F.col("text")), line_words)
    hashed = docs.select(F.col(key).alias("doc"), F.posexplode(words).alias("line_no", "w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    # Lines of n and of n + 1 words share a half of (n + 1) div 2 words, lines of n words one of n div 2.
    half = lambda k: F.array(F.xxhash64(F.lit(0), k, F.slice("w", 1, k)), F.xxhash64(F.lit(1), k, F.slice("w", F.col("n") - k + 1, k)))
    low, high = F.expr("n div 2").cast("int"), F.expr("(n + 1) div 2").cast("int")
    halves = F.when(low == high, half(low)).otherwise(F.concat(half(low), half(high)))
    return hashed.select("doc", "line_no", F.xxhash64("n", "w").alias("h"), "n", F.when(F.col("n") >= min_words, halves).alias("halves"))


def with_a_shared_half(distinct: DataFrame) -> DataFrame:
    """(h, n) of distinct lines of which another line has the same first or last half."""
    halves = distinct.select("h", "n", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("half")
    return halves.join(shared, "half", "left_semi").select("h", "n").distinct()


def variants(lines: DataFrame) -> DataFrame:
    """Keys of the deletion neighbourhood of lines (h, n, doc, line_no, words): one row for each key.

    Running sums over a line's words hash what is before and after each place, so the work grows with the line's length
    and not with its square.
    """
    placed = lines.select("h", "n", "doc", "line_no", F.posexplode("words").alias("i", "word"))
    before = F.pmod(F.xxhash64(F.lit(2), "i", "word"), F.lit(_SMALL))
    after = F.pmod(F.xxhash64(F.lit(3), F.col("n") - F.col("i"), "word"), F.lit(_SMALL))
    line = Window.partitionBy("h", "n").orderBy("i")
    run = placed.select("h", "n", "doc", "line_no", "i", before.alias("b"), after.alias("a"))
    run = run.withColumns({"before": F.sum("b").over(line) - F.col("b"), "after": F.sum("a").over(line.orderBy(F.col("i").desc())) - F.col("a")})
    whole = F.xxhash64("n", "i", "before", F.col("after") + F.col("a"))
    without = F.xxhash64(F.col("n") - 1, "i", "before", "after")
    # The gap behind the last word: nothing comes after it.
    end = F.xxhash64("n", F.col("i") + 1, F.col("before") + F.col("b"), F.lit(0).cast("long"))
    keys = F.when(F.col("i") == F.col("n") - 1, F.array(whole, without, end)).otherwise(F.array(whole, without))
    return run.select("h", "n", "doc", "line_no", F.explode(keys).alias("variant"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word lists are within one edit: what they share at the start and at the end leaves one word at most."""
    def shared(x: Column, y: Column) -> Column:
        same = F.zip_with(F.slice(x, 1, F.least(F.size(x), F.size(y))), F.slice(y, 1, F.least(F.size(x), F.size(y))), lambda p, q: p == q)
        at = F.array_position(same, False)
        return F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1)

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def settled(members: DataFrame) -> DataFrame:
    """Which lines go, of ``members`` (variant, place, h, n: the lines of each key): (h, n, kept: the place of the earliest
    line that stays and shares a key).

    A round decides every line whose earlier neighbours are decided, so there are as many rounds as the longest chain of
    neighbours in falling order needs. Only undecided lines take part in the next.
    """
    left, told = members, None
    while True:
        # Of lines with a key in common at most one stays, and it is the first undecided one of the key.
        first = broadcast_if_small(cut(left.groupBy("variant").agg(F.min("place").alias("first")), "first-of-key"), 64)
        marked = left.join(first, "variant")
        stays = marked.groupBy("place").agg(F.bool_and(F.col("place") == F.col("first")).alias("all")).where("all").select(F.col("place").alias("first"))
        ruled = cut(marked.join(stays, "first", "left_semi").groupBy("place", "h", "n").agg(F.min("first").alias("kept")), "ruled")
        gone = ruled.where("place <> kept").select("h", "n", "kept")
        told = gone if told is None else told.unionByName(gone)
        left = cut(left.join(broadcast_if_small(ruled.select("place"), 48), "place", "left_anti"), "undecided")
        if left.isEmpty():
            return told


def near_lines(docs: DataFrame, distinct: DataFrame, key: str) -> DataFrame:
    """(h, n, like) of distinct lines that are within one edit of an earlier one that stays; ``like`` is its place."""
    candidates = cut(distinct.select("h", "n", "first.*").join(with_a_shared_half(distinct), ["h", "n"], "left_semi"), "candidates")
    # A document's own lines: as many at most as its text has.
    holders = cut(candidates.groupBy("doc").agg(F.collect_list("line_no").alias("at")), "holders")
    rows = docs.select(F.col(key).alias("k"), "text").join(broadcast_if_small(holders, F.size("at") * 4 + 64), F.col("k") == F.col("doc"))
    picked = let(lines_of(F.col("text")), lambda x: F.transform("at", lambda i: F.struct(i.alias("line_no"), line_words(F.get(x, i)).alias("words"))))
    lines = rows.select("doc", F.inline(picked)).withColumn("n", F.size("words"))
    lines = cut(lines.select(F.xxhash64("n", "words").alias("h"), "n", "doc", "line_no", "words"), "candidate-lines")
    keyed = variants(lines)
    shared = keyed.groupBy("variant").agg(F.max("h").alias("hi"), F.min("h").alias("lo")).where("lo <> hi").select("variant")
    members = keyed.join(shared, "variant", "left_semi").select("variant", F.struct("doc", "line_no").alias("place"), "h", "n")
    pairs = settled(cut(members, "key-lines"))
    other = lines.select(F.struct("doc", "line_no").alias("kept"), F.col("words").alias("other"))
    checked = pairs.join(lines.select("h", "n", "words"), ["h", "n"]).join(other, "kept")
    return checked.where(within_one_edit(F.col("words"), F.col("other"))).select("h", "n", F.col("kept").alias("like"))


def _removed(docs: DataFrame, key: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """For documents with a key of their own: all compared lines (doc, line_no), and those that go (doc, line_no, repeat,
    near, kept: the place of the line that stands for it)."""
    lines = cut(line_table(docs, key, min_words), "lines")
    distinct = lines.groupBy("h", "n").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("times"))
    distinct = cut(distinct, "distinct-lines")
    near = near_lines(docs, distinct.where(F.col("n") >= min_words), key)
    known = distinct.select("h", "n", "first", "times").join(near, ["h", "n"], "left").where("times > 1 or like is not null").select("h", "n", "first", "like")
    joined = lines.select("doc", "line_no", "h", "n").join(broadcast_if_small(cut(known, "known-lines"), 128), ["h", "n"])
    repeat = F.struct("doc", "line_no") != F.col("first")
    gone = joined.select("doc", "line_no", repeat.alias("repeat"), F.col("like").isNotNull().alias("near"), F.coalesce("like", "first").alias("kept"))
    return lines.select("doc", "line_no"), gone.where("repeat or near")


def _keyed(docs: DataFrame, key: str, numbered: bool = True) -> tuple[DataFrame, DataFrame, Column]:
    """``docs`` with a column that tells rows with one key apart, the same as (key, text) where the key orders by ``key``, then
    by that column, and this key. Rows are numbered, which writes them out, or told apart by a hash of the text alone."""
    if numbered:
        rows, row = with_row_key(docs)
    else:
        (row,) = unused(docs, "row")
        rows = docs.withColumn(row, F.xxhash64(F.col("text").cast("string")))
    own = F.struct(F.col(key).alias("id"), F.col(row).alias("row"))
    return rows, rows.select(own.alias("key"), F.col("text").cast("string").alias("text")), own


def judged_lines(docs: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Every line with a word: doc, line_no, repeat (an equal line came before), near (a similar one that stays did, both of
    ``min_words`` words or more), and the place (kept_doc, kept_line) of the line that stands for it, or nulls. That line
    stays itself: a chain of lines, each near the one before, keeps the first, the first that is not near it, and so on.

    Before means: a smaller doc, then an earlier row, then a smaller line number. Null text: no lines. Null doc: comes
    first. Rows with equal or null docs, and repeated rows, are texts of their own. Empty table: no rows. Lines of any length
    are compared whole. Other columns are not read, whatever their names.
    """
    lines, gone = _removed(_keyed(docs, key)[1], "key", min_words)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    joined = lines.join(gone, ["doc", "line_no"], "left")
    return joined.select(F.col("doc.id").alias("doc"), "line_no", no("repeat"), no("near"), F.col("kept.doc.id").alias("kept_doc"), F.col("kept.line_no").alias("kept_line"))


def _has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def _linked(docs: DataFrame, key: str, min_words: int, numbered: bool) -> tuple[DataFrame, Column, Column]:
    """``docs`` with an array of the lines that go, ordered by line number (null where none goes); its column; and the text
    that is left."""
    rows, keyed, own = _keyed(docs, key, numbered)
    gone = _removed(keyed, "key", min_words)[1]
    link = F.struct("line_no", F.col("kept.doc.id").alias("doc"), F.col("kept.line_no").alias("line"), "repeat")
    r, links = unused(rows, "r", "links")
    found = gone.groupBy(F.col("doc").alias(r)).agg(F.sort_array(F.collect_set(link)).alias(links))  # a document's own lines
    joined = rows.join(broadcast_if_small(cut(found, "gone-lines"), F.size(links) * 40 + 64), own == F.col(r), "left")
    at, text = F.transform(links, lambda x: x["line_no"]), F.col("text").cast("string")
    rest = let(F.split(text, "\n"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), at), lambda i: F.get(x, i)))
    return joined, F.col(links), F.when(F.col(links).isNull(), text).otherwise(F.array_join(rest, "\n"))


def report(docs: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """What the operator finds in every row and leaves of it: the key, n_lines (lines with a word), n_repeats, n_near
    (similar to an earlier line, equal to none), links (for each line that goes its line_no, the place doc and line of the
    line that stands for it, and whether it is equal to one; null where none goes), text (what is left) and kept (whether a
    word is left, or there was none). Edge cases are those of ``judged_lines``, but rows with one key and one text are told
    what the first of them is told: nothing is written out to number them.
    """
    joined, links, rest = _linked(docs, key, min_words, numbered=False)
    count = lambda found: F.when(links.isNull(), 0).otherwise(F.size(found)).cast("long")
    n_lines = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), _has_word)).cast("long")
    told = joined.select(F.col(key), n_lines.alias("n_lines"), count(F.filter(links, lambda x: x["repeat"])).alias("n_repeats"), count(F.filter(links, lambda x: ~x["repeat"])).alias("n_near"), links.alias("links"), rest.alias("text"))
    return told.withColumn("kept", F.col("links").isNull() | _has_word(F.col("text")))


def dedup_lines(docs: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated and similar lines taken out of ``text``, the earliest kept; rows left without a word go.

    Other columns are as they were. Rows whose text had no word before stay as they are. Edge cases: see ``judged_lines``.
    """
    joined, links, rest = _linked(docs, key, min_words, numbered=True)
    (text,) = unused(joined, "rest")
    kept = joined.withColumn(text, rest).where(links.isNull() | _has_word(F.col(text)))
    return kept.select(*(F.col(text).alias(c) if c == "text" else F.col(c) for c in docs.columns))
