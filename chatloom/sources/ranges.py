"""Large sources by byte range: a file of any size is the work of as many tasks as it has ranges.

Spark's text reader cuts a file into ranges and gives each the records that begin in it. With ``}`` as the end of a record
that holds for JSON on one line too: a file is a sequence of *fragments*, each up to the next brace. Whether a fragment begins
inside a string, and how deep in brackets, follows from sums over the fragments before it: sums within a range, and what all
ranges before add up to. Where the depth is that of the array's items an item begins or ends, and only an item's own fragments
are put together again. Lines are numbered in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.functions.jsonx import strict_json
from chatloom.storage import broadcast_if_small, written

#: Bytes of a row of the table of ranges, of which a file has few.
_ROW = 200


@contextmanager
def _ranges_of(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Ranges of at most so many bytes while files are read; without a size those of the session."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        if size:
            spark.conf.set(name, str(size))
        yield
    finally:
        spark.conf.set(name, before)


def _records(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(source_id, block, at, text): records of files, in order of ``block`` (where a range begins) and ``at``."""
    rows = spark.read.option("lineSep", end).text(path)
    return rows.select(F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def _before(rows: DataFrame, **sums: str) -> DataFrame:
    """``rows`` (source_id, block, at, ...) with running sums: for name=column what the column adds up to in all earlier rows
    of the source. A range's rows are summed in its own task, the ranges' totals in a table of one row a range."""
    within = Window.partitionBy("source_id", "block").orderBy("at")
    totals = written(rows.groupBy("source_id", "block").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items())))
    ranges = Window.partitionBy("source_id").orderBy("block")
    carried = totals.select(F.col("source_id").alias("_s"), F.col("block").alias("_b"), *((F.sum(f"_{n}").over(ranges) - F.col(f"_{n}")).alias(f"_{n}") for n in sums))
    joined = rows.join(broadcast_if_small(written(carried), _ROW), (F.col("source_id") == F.col("_s")) & (F.col("block") == F.col("_b")))
    return joined.withColumns({n: F.sum(c).over(within) - F.col(c) + F.col(f"_{n}") for n, c in sums.items()}).drop("_s", "_b", *(f"_{n}" for n in sums))


def read_lines(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(source_id, node, line): the lines of files that are not blank, trimmed, in the order of ``node`` in each file, however
    many there are. Lines end with a line feed; a byte order mark goes. A line that reaches over a range's end belongs to the
    range in which it begins."""
    with _ranges_of(spark, range_bytes):  # what is written keeps its ranges, whatever the session's become
        rows = written(_records(spark, path, "\n").withColumn("one", F.lit(1).cast("long")))
    numbered = _before(rows, node="one")
    line = T.trim(F.when(F.col("node") == 0, T.without_bom(F.col("text"))).otherwise(F.col("text")))
    return numbered.select("source_id", "node", line.alias("line")).where("line <> ''")


def _net(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return F.length(F.translate(text, "}]", "")) - F.length(F.translate(text, "{[", ""))


def _outside(parts: Column, first: Column) -> Column:
    """What is not in strings, of a text split at its quotes; ``first``: 0 if it begins outside."""
    return F.array_join(F.filter(parts, lambda _, i: (i + first) % 2 == 0), "")


def _unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\.?", "")).otherwise(text)


def _opening(text: Column, inside: Column, depth: Column, base: Column) -> Column:
    """Length of what stands before the first brace outside strings that opens at depth ``base``; null if there is none. The
    text begins at ``depth``, and in a string if ``inside`` is 1."""
    step = lambda s, piece: F.struct(
        F.when(s["found"] >= 0, s["found"]).when((s["i"] > 0) & (s["quotes"] % 2 == 0) & (s["depth"] == base), s["length"] + s["i"] - 1).otherwise(F.lit(-1)).cast("long").alias("found"),
        (s["i"] + 1).cast("long").alias("i"),
        (s["length"] + F.length(piece)).cast("long").alias("length"),
        (s["quotes"] + F.length(_unescaped(piece)) - F.length(F.replace(_unescaped(piece), F.lit('"'), F.lit("")))).cast("long").alias("quotes"),
        (s["depth"] + F.when((s["i"] > 0) & (s["quotes"] % 2 == 0), 1).otherwise(0) + _net(_outside(F.split(_unescaped(piece), '"'), s["quotes"] % 2))).cast("long").alias("depth"),
    )
    start = F.struct(F.lit(-1).cast("long").alias("found"), *(F.lit(0).cast("long").alias(c) for c in ("i", "length")), inside.cast("long").alias("quotes"), depth.cast("long").alias("depth"))
    return F.nullif(F.aggregate(F.split(text, r"\{"), start, step, lambda s: s["found"]), F.lit(-1))


def _lowest(text: Column, inside: Column, depth: Column) -> Column:
    """The least depth in a text that begins at ``depth``."""
    brackets = F.split(F.regexp_replace(_outside(F.split(_unescaped(text), '"'), inside), r"[^\[\]{}]", ""), "")
    step = lambda s, c: F.struct(
        (s["depth"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).cast("long").alias("depth"),
        F.least(s["low"], s["depth"] + F.when(c.isin("]", "}"), -1).otherwise(0)).cast("long").alias("low"),
    )
    return F.aggregate(brackets, F.struct(depth.cast("long").alias("depth"), depth.cast("long").alias("low")), step, lambda s: s["low"])


def _list_between(text: Column, first: Column, last: Column) -> Column:
    """Whether what stands before, between or behind items of an array is commas and values: with a 0 for the items, JSON."""
    whole = F.concat(F.when(first, "").otherwise("[0"), text, F.when(last, "").otherwise("0]"))
    return strict_json(whole).isNotNull()


def read_items(spark: SparkSession, path: str, wrapper: str = "conversations", range_bytes: int | None = None) -> DataFrame:
    """(source_id, item, body): the objects of JSON files, in order of ``item`` in each file.

    They are the items of an array, those of the array ``wrapper`` of an object, or one object. A file that is not JSON has
    none; but besides the objects, values with braces in them, and what an object has besides its wrapper, are checked for
    their brackets only. A task reads a range of a file,
    and no task holds more than that and one item. A byte order mark goes.
    """
    quoted = F.split(_unescaped(F.col("text")), '"')
    quotes = (F.size(quoted) - 1).cast("long")
    # Each fragment ends with a brace, which counts where it is outside strings.
    change = lambda first: (_net(_outside(quoted, F.lit(first))) - F.when((quotes + first) % 2 == 0, 1).otherwise(0)).cast("long")
    with _ranges_of(spark, range_bytes):
        rows = written(_records(spark, path, "}").withColumns({"quotes": quotes, "d0": change(0), "d1": change(1)}))
    told = _before(rows, seen="quotes").withColumn("inside", F.col("seen") % 2)
    told = _before(told.withColumn("d", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))), depth="d")
    outside = F.col("inside") == 0
    # One row a file: its form, and whether its end closes what is open (its last fragment may lack the brace).
    place = F.struct("block", "at")
    begins = rf'"{wrapper}"\s*:\s*\['
    closers = F.length("text") - F.length(F.translate("text", "}]", ""))
    own_level = (closers >= F.col("depth") - 1) & (_lowest(F.col("text"), F.col("inside"), F.col("depth")) <= 1)
    named = F.when(F.col("text").rlike(begins), own_level)
    last = F.max_by(F.struct("text", "depth", "inside", (F.col("depth") + F.col("d")).alias("after"), ((F.col("inside") + F.col("quotes")) % 2).alias("open")), place)
    files = told.groupBy("source_id").agg(T.trim(T.without_bom(F.min_by("text", place))).alias("head"), F.bool_or(named).alias("named"), last.alias("last"), F.min(place).alias("first"))
    base = F.when(F.col("head").startswith("["), 1).when(F.col("head").startswith("{"), F.when(F.col("named"), 2).otherwise(0))
    closed = (F.col("last.open") == 0) & F.col("last.after").isin(0, -1)
    tail = ~F.col("head").startswith("[") | (F.col("last.depth") != 1) | (F.col("last.inside") == 1) | _list_between(F.col("last.text"), F.lit(False), F.lit(True))
    good = files.where(closed & base.isNotNull() & tail).select(F.col("source_id").alias("_s"), base.alias("base"), F.col("first.at").alias("_first"))
    told = told.join(broadcast_if_small(written(good), _ROW), F.col("source_id") == F.col("_s")).withColumn("text", F.when(F.col("at") == F.col("_first"), T.without_bom(F.col("text"))).otherwise(F.col("text")))
    # Where an item begins and ends, and what stands before it. A fragment that begins deeper must close that before.
    lead = F.when((closers >= F.col("depth") - F.col("base")), _opening(F.col("text"), F.col("inside"), F.col("depth"), F.col("base")))
    ends = ((F.col("inside") + F.col("quotes")) % 2 == 0) & (F.col("depth") + F.col("d") == F.col("base"))
    told = told.withColumn("lead", lead).withColumns({"starts": F.col("lead").isNotNull().cast("long"), "ends": ends.cast("long"), "pre": F.when(F.col("lead").isNotNull(), F.substring(F.col("text"), F.lit(1), F.col("lead").cast("int")))})
    # In an object with a wrapper: where the text is at the object's own level, and whether the wrapper's array begins there.
    wraps = F.col("text").rlike(begins) & (_lowest(F.regexp_replace("text", rf"(?s)\A.*{begins}", ""), F.lit(0), F.lit(2)) >= 2)
    level = F.when(F.col("base") == 2, own_level)
    told = told.withColumns({"level": F.coalesce(level, F.lit(False)).cast("long"), "wraps": F.when(level, wraps)})
    told = written(told.drop("_s", "d0", "d1", "seen"))
    told = _before(told, begun="starts", ended="ends", levels="level")
    own = told.where(F.col("begun") + F.col("starts") - F.col("ended") == 1)
    first = F.col("lead").isNotNull()
    # Between two items of an array there is a comma, or more values; a part of them, after a brace in one, is not checked.
    fits = F.when(F.col("base") == 0, T.trim(F.col("pre")) == "").when((F.col("base") == 1) & outside & (F.col("depth") <= 1), _list_between(F.col("pre"), F.col("begun") == 0, F.lit(False))).otherwise(True)
    part = F.when(first, F.substring(F.col("text"), (F.col("lead") + 1).cast("int"), F.length("text"))).otherwise(F.col("text"))
    level = F.max(F.when(first, F.col("levels") + F.col("level")))
    # The fragments of one item.
    items = own.select("*", part.alias("part"), fits.alias("fits")).groupBy("source_id", (F.col("begun") + F.col("starts") - 1).alias("item")).agg(
        F.sort_array(F.collect_list(F.struct("block", "at", "part"))).alias("parts"), F.bool_and(F.when(first, F.col("fits"))).alias("fits"), level.alias("level"), F.max("base").alias("base")
    )
    body = F.concat(F.array_join(F.transform("parts", lambda x: x["part"]), "}"), F.lit("}"))
    found = written(items.select("source_id", "item", strict_json(body).alias("body"), "fits", "level", "base"))
    bad = found.where("body is null or not fits").select("source_id").distinct()
    found = found.join(bad, "source_id", "left_anti")
    # In an object, the wrapper's items are those between its beginning and the next text at the object's own level.
    wrapped = told.where((F.col("level") == 1) & F.col("wraps")).select("source_id", (F.col("levels") + 1).alias("level"))
    return found.where("base < 2").unionByName(found.where("base = 2").join(wrapped, ["source_id", "level"], "left_semi")).select("source_id", "item", "body")
