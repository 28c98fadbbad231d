"""Benchmark decontamination by SimHash of item-sized windows (operator 8).

A document is contaminated by an item when a window of as many words as the item has is similar to it. The similarity of a
window can only rise while its start moves right to the first shingle it shares with the item, so windows are formed where a
document has a shingle of an item, in that item's size, and nothing else is asked of them. Each window and each item gets a
64-bit SimHash; pairs that share the shingle and whose fingerprints are within the radius are verified by the exact
weighted-shingle similarity: shared weight over the weight of both, where a shingle weighs as often as it occurs.

Hamming blocks do not find the candidates, as the method has it: similarity 0.75 needs a radius of 24 of 64 bits, which
leaves 25 blocks of two or three bits, and on those nearly every pair of a window and an item agrees. A join on the shingle
finds the pairs; the fingerprint only spares most of them the exact comparison. The README has the figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import broadcast_if_small, cut, let

#: Words of a shingle, bits of a fingerprint, and how many bits may differ. Windows at similarity 0.75 share six shingles
#: of seven, so their fingerprints differ in 11 bits on average; 24 is four standard deviations more.
WIDTH, BITS, RADIUS = 5, 64, 24
#: Votes for four bits are counted in one number, in lanes of 16 bits, for windows of so many shingles at most; the votes of
#: a longer one are counted bit by bit.
LANES, LANE_ONES, LANE_TOPS, MOST = 16, 0x0001000100010001, 0x4000400040004000, 0x3FFF


def words(text: Column) -> Column:
    """Words for comparison: runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), "")


def shingles(found: Column, width: int = WIDTH) -> Column:
    """The hashes of all runs of ``width`` words, in order; with fewer words, of all words as one; without words, none."""
    hashed = F.transform(found, lambda w: F.xxhash64(w))
    runs = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))))
    return F.when(F.size(found) >= width, runs).when(F.size(found) > 0, F.array(F.xxhash64(hashed))).otherwise(F.array().cast("array<bigint>"))


def _bit_by_bit(found: Column) -> Column:
    def bit(b: int) -> Column:
        votes = F.aggregate(found, F.lit(0), lambda a, h: a + F.getbit(h, F.lit(b)).cast("int"))
        return F.when(F.lit(2) * votes > F.size(found), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for b in range(1, BITS):
        out = out.bitwiseOR(bit(b))
    return out


def simhash(found: Column) -> Column:
    """64-bit SimHash of shingle hashes: bit b is set when most of them have it set.

    Number k of the struct counts bits k, k + 16, k + 32 and k + 48. Adding 0x3FFF less half the number of
    shingles to a lane sets its bit 14 just when the votes are more than half.
    """
    empty = F.struct(*(F.lit(0).cast("long").alias(f"v{k}") for k in range(LANES)))
    ones, tops = F.lit(LANE_ONES).cast("long"), F.lit(LANE_TOPS).cast("long")

    def count(a: Column, h: Column) -> Column:
        return F.struct(*((a[f"v{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(ones)).alias(f"v{k}") for k in range(LANES)))

    def bits(s: Column) -> Column:
        half = (F.lit(0x3FFF) - F.floor(F.size(s) / 2)).cast("long")

        def finish(a: Column) -> Column:
            out = F.lit(0).cast("long")
            for k in range(LANES):
                over = F.shiftrightunsigned((a[f"v{k}"] + half * ones).bitwiseAND(tops), 14)
                out = out.bitwiseOR(F.shiftleft(over, k))
            return out

        return F.when(F.size(s) <= MOST, F.aggregate(s, empty, count, finish)).otherwise(_bit_by_bit(s))

    return let(found, bits)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags of shingles: sum of the lesser counts over sum of the greater ones."""
    def shared(s: Column) -> Column:
        both = F.array_intersect(s["a"], s["b"])
        count = lambda x, h: F.size(F.filter(x, lambda g: g == h))
        once = (F.size(F.array_distinct(s["a"])) == F.size(s["a"])) | (F.size(F.array_distinct(s["b"])) == F.size(s["b"]))
        return F.when(once, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda t, h: t + F.least(count(s["a"], h), count(s["b"], h))))

    pair = let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(shared(s).alias("n"), (F.size(s["a"]) + F.size(s["b"])).alias("both")))
    return let(pair, lambda s: s["n"] / (s["both"] - s["n"]))


def items_of(benchmark: DataFrame, item: str = "item_id") -> DataFrame:
    """Items with a word: item, size (words), shingles, fingerprint. Items with equal words are one row each."""
    rows = benchmark.select(F.col(item).alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return rows.select("item", F.size("words").alias("size"), shingles(F.col("words")).alias("shingles")).withColumn("fingerprint", simhash(F.col("shingles")))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", least: float = 0.75, radius: int = RADIUS) -> DataFrame:
    """Pairs (key, item) with the window's first word and similarity, where that is at least ``least``.

    Documents' words are hashed in the scan; only documents that share a shingle with an item go further, with their
    shingles. An item of fewer than five words is one shingle, and is found where a text has exactly its words in a row.
    Null text or a text without a word: no pairs. Null key: found like others. Different texts of one key: each is reported;
    a repeated row is reported once. Empty tables: no pairs. Repeated items: each is reported. Very long texts count whole.
    Other columns are not read.
    """
    items = cut(items_of(benchmark, item).withColumn("no", F.monotonically_increasing_id()), "items")
    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    long = items.where(F.col("size") >= WIDTH)
    candidates = within_radius(item_windows(rows, long), long, radius)
    shingled = long.select("no", "item", "shingles")
    whole = candidates.join(broadcast_if_small(shingled, F.size("shingles") * 8 + 96), "no")
    scored = whole.withColumn("similarity", similarity(F.col("window"), F.col("shingles"))).where(F.col("similarity") >= least)
    found = scored.select("key", "h", "item", "start", "similarity").unionByName(short_items(rows, items))
    best = found.groupBy("key", "h", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity"))


def short_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(key, h, item, start, similarity) of items of fewer than five words, wherever a text has their words in a row."""
    short = items.where(F.col("size") < WIDTH)
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())  # four at most
    empty = F.array().cast("array<struct<size:int,start:int,shingle:bigint>>")
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    run = lambda h, i, n: F.struct(F.lit(n).alias("size"), i.alias("start"), F.xxhash64(F.slice(h, i + 1, n)).alias("shingle"))
    runs = lambda h, n: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: run(h, i, n))).otherwise(empty)
    found = let(hashed, lambda h: F.flatten(F.array(*(runs(h, n) for n in sizes)))) if sizes else empty
    placed = rows.select("key", "h", F.inline(found))
    held = cut(short.select("item", "size", F.element_at("shingles", 1).alias("shingle")), "short-items")
    met = placed.join(broadcast_if_small(held, 96), ["size", "shingle"])
    return met.select("key", "h", "item", "start", F.lit(1.0).alias("similarity"))


def item_windows(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows (key, h, size, start, anchor, window, print) of texts (key, text, h: a hash of it): one for each place where a
    text has a shingle (``anchor``) of an item, and each size of such an item. ``window`` has the shingles."""
    sizes = cut(items.select("size", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.collect_set("size").alias("sizes")), "sizes")
    placed = rows.select("key", "h", F.posexplode(shingles(words(F.col("text")))).alias("pos", "shingle"))
    hits = placed.join(broadcast_if_small(sizes, F.size("sizes") * 4 + 48), "shingle")
    # One text's places, also where keys are null or repeat.
    held = cut(hits.groupBy("key", "h").agg(F.collect_set(F.struct("pos", "sizes")).alias("at")), "anchors")
    texts = rows.select(F.col("key").alias("k"), F.col("h").alias("of"), "text")
    with_hits = texts.join(broadcast_if_small(held, F.size("at") * 48 + 64), (F.col("of") == F.col("h")) & F.col("k").eqNullSafe(F.col("key")))
    places = F.flatten(F.transform("at", lambda a: F.transform(a["sizes"], lambda n: F.struct(a["pos"].alias("pos"), n.alias("size")))))

    def cut_out(w: Column) -> Column:
        # Windows are cut from the shingles where these are made: no row carries them besides its own window.
        def window(s: Column, x: Column) -> Column:
            start = F.greatest(F.lit(0), F.least(x["pos"], F.size(w) - x["size"]))
            return F.struct(x["size"].alias("size"), start.alias("start"), F.get(s, x["pos"]).alias("anchor"), F.slice(s, start + 1, F.greatest(x["size"] - WIDTH + 1, F.lit(1))).alias("window"))

        return let(shingles(w), lambda s: F.transform(places, lambda x: window(s, x)))

    windows = with_hits.select("key", "h", F.inline(let(words(F.col("text")), cut_out)))
    return windows.withColumn("print", simhash(F.col("window")))


def within_radius(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Windows with ``no`` of every item of their size that has their anchor and whose fingerprint is within the radius."""
    index = cut(items.select("no", "size", "fingerprint", F.explode(F.array_distinct("shingles")).alias("anchor")), "index")
    near = windows.join(broadcast_if_small(index, 80), ["size", "anchor"])
    return near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint"))) <= radius).drop("fingerprint")
