"""Hard negatives by a vector-approximation file (operator 11).

Each dimension is cut into at most 256 cells, so a vector's approximation is one byte a dimension. A scan of the
approximations alone looks up the edges of each row's cells and gives, for a block of rows and a block of anchors at once,
a lower and an upper bound of every score: an anchor's component times the middle of a cell, give or take its size times half
the cell's width. From the bounds a task keeps the rows that may still enter an anchor's window. Vectors are fetched and
scored exactly for those alone.

There are two scans: one finds each anchor's positives, the first rows of its label; the other finds for each positive the
first rows of other labels whose scores lie in the window below the positive's. Both are exact. Anchors are a stated query
set; they come in chunks of bounded bytes, each broadcast to one scan of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import cut, thinned
from chatloom.llm.workers import give_back, in_small_batches

#: Cells of a dimension, and the rows whose quantiles place them (those with the smallest hashes of their ids).
CELLS, SAMPLE = 256, 4096
#: Bytes of the anchors of one chunk, which is what a scan broadcasts.
CHUNK_BYTES = 32 << 20
#: Rows and anchors whose bounds are computed at once, and components at most of either.
BLOCK, BLOCK_VALUES = 1024, 1 << 21
#: Integers up to this size, so that a sum of a thousand products fits into 64 bits.
LARGEST = 1 << 26
_DOUBLES = 1 << 52


def integer_rows(df: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """Rows that take part, each once: id, label, q (the components times ``scale``, floored)."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LARGEST), F.lit(False)))
    found = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.when(fits, scaled).cast("array<long>").alias("q"))
    return found.where("id is not null and label is not null and q is not null").dropDuplicates(["id", "label", "q"])


def first_copies(rows: DataFrame, most: int) -> DataFrame:
    """Of rows with one label and one vector those with the ``most`` smallest ids: all have the same score with any anchor, so
    no other row can be among its first. Spark limits the groups before it shuffles them."""
    order = Window.partitionBy("label", "hash", "q").orderBy("id")
    return rows.withColumn("hash", F.xxhash64("q")).withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= most).drop("hash", "_copy")


@dataclass(frozen=True)
class Cells:
    """The least and the greatest value of each cell, by dimension and cell."""

    low: np.ndarray
    high: np.ndarray

    def encode(self, q: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(self.high[d], q[:, d]) for d in range(q.shape[1])], np.uint8).reshape(q.shape[::-1]).T

    def edges(self, codes: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Middle and half width of the cells of approximations, by look-up."""
        at = np.arange(dims)
        low, high = self.low[at, codes[:, :dims]], self.high[at, codes[:, :dims]]
        return (low + high) / 2, (high - low) / 2


def cells(rows: DataFrame, n: int = CELLS, sample: int = SAMPLE) -> Cells:
    """Cells between quantiles of a bounded sample; the outermost reach to the least and the greatest value of all rows."""
    span = rows.select(F.posexplode("q").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = {r.d: (r.lo, r.hi) for r in span.collect()}  # one row a dimension
    taken = [r.q for r in thinned(rows, 2 * sample, "id").orderBy(F.xxhash64("id"), "id").limit(sample).select("q").collect()]
    low, high = np.zeros((len(span), n), np.int64), np.zeros((len(span), n), np.int64)
    for d, (lo, hi) in span.items():
        values = np.array([q[d] for q in taken if len(q) > d] or [lo], np.int64)
        distinct = np.unique(values)
        ends = distinct if len(distinct) < n else np.unique(np.quantile(values, np.arange(1, n) / n, method="inverted_cdf").astype(np.int64))
        ends = np.append(ends[ends < hi][: n - 1], hi)
        high[d] = np.append(ends, np.full(n - len(ends), hi))
        low[d] = np.minimum(np.append(lo, high[d, :-1] + 1), hi)
    return Cells(low, high)


def _matrix(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of integers as rows of a matrix, zeros behind, and their lengths."""
    sizes = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1])
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
    return out, sizes


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    c: Cells = shared.value
    for batch in batches:
        q, sizes = _matrix(batch.column("q"), len(c.low))
        raw = c.encode(q)
        codes = [raw[i, :n].tobytes() for i, n in enumerate(sizes.tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "code"])


class Kept:
    """Rows that may be among the first of each key, by bounds alone.

    Of the rows that surely count, the one at place ``most`` by (lower bound, then smaller id) has ``most`` rows before what is
    surely below it: so a row stays if its upper bound is above that one's lower bound, or equal with no larger id.
    """

    def __init__(self, floors: np.ndarray, most: int):
        self.least, self.most = floors.copy(), most
        self.tie = np.full(len(floors), np.iinfo(np.int64).max)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.waiting = 0

    def add(self, key: np.ndarray, row: np.ndarray, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray, sure: np.ndarray) -> None:
        self.parts.append((key, row, ids, lower, upper, sure))
        self.waiting += len(key)
        if self.waiting > 2 * self.held + (1 << 16):
            self.squeeze()

    def squeeze(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, float, bool))
        key, row, ids, lower, upper, sure = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, np.where(sure, -lower, np.inf), key))
        key, row, ids, lower, upper, sure = (x[order] for x in (key, row, ids, lower, upper, sure))
        place = np.arange(len(key)) - np.searchsorted(key, key)
        last = (place == self.most - 1) & sure
        self.least[key[last]], self.tie[key[last]] = np.maximum(self.least[key[last]], lower[last]), ids[last]
        stay = (upper > self.least[key]) | ((upper == self.least[key]) & (ids <= self.tie[key]))
        kept = tuple(x[stay] for x in (key, row, ids, lower, upper, sure))
        self.parts, self.held, self.waiting = [kept], len(kept[0]), 0
        return kept


@dataclass(frozen=True)
class Anchors:
    """A chunk of anchors: numbers, ids, labels, vectors; and for the second scan the score of each one's positives, by rank."""

    number: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    q: np.ndarray
    score: np.ndarray | None = None


def _scan(batches: Iterator[pa.RecordBatch], anchors, cells_, most: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (number of the anchor, rank of the positive or 0, row, bounds) that may be first for their anchor."""
    a: Anchors = anchors.value
    c: Cells = cells_.value
    dims = min(a.q.shape[1], len(c.low))
    windows = 1 if a.score is None else a.score.shape[1]
    # The least score of each window, rounded down for what may be in it and up for what surely is.
    least = np.full(len(a.ids), -np.inf) if a.score is None else np.where(np.isnan(a.score), 0, a.score).ravel() * share[0] / share[1]
    slack = 0.0 if a.score is None else 1e-6 + np.abs(least) * 2.0**-50
    floors = least + slack
    kept = Kept(least - slack, most)
    wide = np.abs(a.q[:, :dims]).astype(float)
    # Sums beyond what doubles hold exactly are rounded: bounds are then moved apart by more than that.
    loose = float((wide @ np.maximum(np.abs(c.low[:dims]).max(1, initial=0), np.abs(c.high[:dims]).max(1, initial=0)).astype(float)).max(initial=0))
    loose = 0.0 if loose < _DOUBLES // 4 else loose * 2.0**-40
    step = max(1, min(BLOCK, BLOCK_VALUES // max(dims, 1)))
    for batch in batches:
        rows, ids, labels = (batch.column(x).to_numpy() for x in ("row", "id", "label"))
        codes = batch.column("code")
        for at in range(0, len(ids), step):
            part = codes.slice(at, step).to_pylist()
            size = np.array([min(len(x), dims) for x in part])
            raw = np.zeros((len(part), dims), np.uint8)
            raw[np.arange(dims) < size[:, None]] = np.frombuffer(b"".join(x[:dims] for x in part), np.uint8)
            middle, half = c.edges(raw, dims)
            none = np.arange(dims) >= size[:, None]
            middle[none] = half[none] = 0
            row, own, lab = rows[at : at + step], ids[at : at + step], labels[at : at + step]
            for begin in range(0, len(a.ids), step):
                end = min(begin + step, len(a.ids))
                center = middle @ a.q[begin:end, :dims].T.astype(float)
                radius = half @ wide[begin:end].T + loose
                lower, upper = center - radius, center + radius
                same = (lab[:, None] == a.label[None, begin:end])
                able = (same if a.score is None else ~same) & (own[:, None] != a.ids[None, begin:end])
                for w in range(windows):
                    key = np.arange(begin, end) * windows + w
                    mask = able & (upper >= kept.least[key])
                    if a.score is not None:
                        mask &= lower <= a.score[begin:end, w]
                    i, j = np.nonzero(mask)
                    if len(i):
                        lo, hi = lower[i, j], upper[i, j]
                        sure = np.ones(len(i), bool) if a.score is None else (lo >= floors[key[j]]) & (hi <= a.score[begin + j, w])
                        kept.add(key[j], row[i], own[i], lo, hi, sure)
    key, row, _, lower, upper, sure = kept.squeeze()
    out = (a.number[key // windows], key % windows, row, np.where(sure, lower, np.nan), upper)
    yield pa.RecordBatch.from_arrays([pa.array(x, from_pandas=True) for x in out], ["anchor", "window", "row", "lower", "upper"])
    give_back()


def _candidates(vectors: DataFrame, anchors: Anchors, found: Cells, most: int, share: tuple[int, int]) -> DataFrame:
    """What the tasks of one scan keep, without what the other tasks' bounds rule out: anchor, window, row."""
    spark = vectors.sparkSession
    shared, edges = spark.sparkContext.broadcast(anchors), spark.sparkContext.broadcast(found)  # CHUNK_BYTES; dimensions times CELLS
    rows = vectors.select("row", "id", "label", "code")
    kept = rows.mapInArrow(lambda b: _scan(b, shared, edges, most, share), "anchor long, window long, row long, lower double, upper double")
    # A group holds what each task keeps: a few rows.
    order = Window.partitionBy("anchor", "window").orderBy(F.desc_nulls_last("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limited = cut(kept, "bounds").withColumn("least", F.nth_value("lower", most).over(order))
    return limited.where("least is null or upper >= least").select("anchor", "window", "row")


def _scored(candidates: DataFrame, vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates with id and exact score."""
    products = F.zip_with(F.col("q"), F.col("anchor_q"), lambda x, y: F.coalesce(x * y, F.lit(0).cast("long")))
    joined = candidates.join(vectors.select("row", "id", "q"), "row").join(anchors.select("anchor", "anchor_id", F.col("q").alias("anchor_q")), "anchor")
    return joined.select("anchor", "anchor_id", "window", "id", F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))


def _chunk(table: pa.Table) -> Anchors:
    lists = table.column("q").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    q, _ = _matrix(lists, max((len(x) for x in lists), default=0))
    return Anchors(*(table.column(c).to_numpy() for c in ("anchor", "id", "label")), q)


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", label: Column | None = None, vector: str = "embedding", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Hard negatives of every anchor and each of its positives.

    ``is_anchor`` is a condition on ``id``. A row's score is the inner product of its integer components with the anchor's;
    higher scores come first, ties by smaller id. An anchor's positives are the first rows of its label. For each positive
    come the first rows of other labels with ``share[0] * positive_score <= share[1] * score <= share[1] * positive_score``.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    No part take rows with null id or label, with a null vector, with a null or non-finite component, or with one whose
    ``scale``-fold is beyond 2 ** 26. Repeated rows are one row. Rows with one id but other labels or vectors are rows of
    their own, never partners of each other. Vectors of different lengths: the components that both have count; an empty
    vector scores 0 with all. Fewer rows than asked for: all of them. Empty table, or no anchor: no rows. Other columns are
    not read, whatever their names.
    """
    spark = df.sparkSession
    rows = cut(integer_rows(df, key, F.col("label") if label is None else label, vector, scale), "integers")
    anchors = rows.where(is_anchor).select(F.monotonically_increasing_id().alias("anchor"), F.col("id").alias("anchor_id"), "id", "label", "q")
    anchors = cut(anchors, "anchors")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n, width = anchors.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    if not n:
        return empty
    found = cells(rows)
    copies = first_copies(rows, max(positives, negatives) + 1).withColumn("row", F.monotonically_increasing_id())
    shared = spark.sparkContext.broadcast(found)
    fields = "id long, label long, q array<long>, row long"
    vectors = cut(in_small_batches(copies.select("id", "label", "q", "row")).mapInArrow(lambda b: _encode(b, shared), f"{fields}, code binary"), "vectors")
    chunks = -(-n * (width + 3) * 8 * 2 // chunk_bytes) if n * (width + 3) * 8 > chunk_bytes else 1
    results = [_mine_chunk(vectors, anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(chunks)) == i), found, positives, negatives, share) for i in range(chunks)]
    return reduce(DataFrame.unionByName, [x for x in results if x is not None])


def _mine_chunk(vectors: DataFrame, anchors: DataFrame, found: Cells, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame | None:
    table = anchors.select("anchor", "id", "label", "q").toArrow()  # half of chunk_bytes on average
    if not table.num_rows:
        return None
    chunk = _chunk(table)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    first = _scored(_candidates(vectors, chunk, found, positives, share), vectors, anchors).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    first = cut(first.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    told = first.select("anchor", "place", "positive_score").toArrow()
    by_number = np.argsort(chunk.number)
    score = np.full((len(chunk.ids), positives), np.nan)
    at = by_number[np.searchsorted(chunk.number[by_number], told.column("anchor").to_numpy())]
    score[at, told.column("place").to_numpy() - 1] = told.column("positive_score").to_numpy()
    chunk = Anchors(chunk.number, chunk.ids, chunk.label, chunk.q, score)
    second = _scored(_candidates(vectors, chunk, found, negatives, share), vectors, anchors).withColumn("place", F.col("window") + 1)
    second = second.join(first, ["anchor", "place"]).where((F.col("positive_score") * share[0] <= F.col("score") * share[1]) & (F.col("score") <= F.col("positive_score")))
    ranked = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return cut(ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
