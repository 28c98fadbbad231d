"""Importance resampling towards a target distribution: hashed n-grams of words, drawn by Gumbel top-k (operator 13).

Texts are taken apart by a byte automaton over whole Arrow buffers: one look-up classifies (and lower-cases) each byte, words
begin and end where the class differs from the byte before, and the CRCs of all words of a slice advance together, one byte
of every word a step. The CRC of a run of words follows from the words' own: a CRC moves over n more bytes by a linear map,
which is a table for each n, so no byte is read twice.

Counts are one vector of ``buckets`` numbers a task, added up by one aggregation. The drawn rows are numbered over sorted
ranges, so no task sees more of them than its range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import cut
from chatloom.llm.workers import in_small_batches, slices

BUCKETS, WORDS = 10_000, 3
#: Words up to so many bytes advance together; longer ones, of which a slice has few, one by one.
TOGETHER = 64
_POLYNOMIAL = 0xEDB88320
_SPACE = np.uint32(zlib.crc32(b" "))


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(_POLYNOMIAL), row >> 1)
    return row


CRC = _crc_table()
#: The class of each byte: 0 between words, else the byte of the word in lower case. Bytes beyond ASCII belong to words.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def _moved(crc: np.ndarray, tables: np.ndarray, at: np.ndarray | int) -> np.ndarray:
    """CRCs moved over zero bytes by the linear map in row ``at`` of the tables: one look-up for each of a CRC's bytes."""
    b = [(crc >> np.uint32(8 * i)) & np.uint32(255) for i in range(4)]
    return tables[at, 0, b[0]] ^ tables[at, 1, b[1]] ^ tables[at, 2, b[2]] ^ tables[at, 3, b[3]]


@cache
def _maps() -> tuple[np.ndarray, np.ndarray]:
    """Maps over 0 to TOGETHER bytes, and over TOGETHER times 1, 2, 4, ... bytes."""
    first = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    short = [first]
    for _ in range(TOGETHER):
        short.append(CRC[short[-1] & 255] ^ (short[-1] >> 8))
    doubled = [short[-1]]
    for _ in range(30):
        doubled.append(_moved(doubled[-1], doubled[-1][None], 0))
    return np.array(short), np.array(doubled)


def advance(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs after ``n`` more bytes, but for what those bytes add: crc(a + b) is ``advance(crc(a), len(b)) ^ crc(b)``."""
    short, doubled = _maps()
    crc, times = _moved(crc, short, n % TOGETHER), n // TOGETHER
    for k in range(int(times.max(initial=0)).bit_length()):
        some = np.flatnonzero((times >> k) & 1)
        crc[some] = _moved(crc[some], doubled, k)
    return crc


def _crcs(low: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of words, all advanced together: words in order of length, so that those with a next byte come first."""
    order = np.argsort(TOGETHER + 1 - np.minimum(lengths, TOGETHER + 1).astype(np.uint8), kind="stable")
    at, state = begins[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    ready = len(order) - np.cumsum(np.bincount(np.minimum(lengths, TOGETHER), minlength=TOGETHER + 1))  # longer than 0, 1, ...
    for j, k in enumerate(ready[:TOGETHER].tolist()):
        if not k:
            break
        state[:k] = CRC[(state[:k] ^ low[at[:k] + j]) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    for i in np.flatnonzero(lengths > TOGETHER).tolist():
        out[i] = zlib.crc32(low[begins[i] : begins[i] + lengths[i]])
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and for each run of one to three of them its text's number and its CRC."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low = LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, np.uint8)
    edge = np.zeros(len(low) + 1, bool)  # where a text begins, or all end
    edge[offsets - offsets[0]] = True
    inside = np.concatenate([[False], low > 0, [False]])
    begins = np.flatnonzero(inside[1:] & ~(inside[:-1] & ~edge))
    ends = np.flatnonzero(inside[:-1] & ~(inside[1:] & ~edge))  # the byte after the last
    lengths, text = ends - begins, np.searchsorted(offsets - offsets[0], begins, "right") - 1
    crc = _crcs(low, begins, lengths)
    who, found, run = [text], [crc], crc
    for n in range(1, min(WORDS, len(crc))):
        run = advance(advance(run[:-1], np.ones(len(run) - 1, np.int64)) ^ _SPACE, lengths[n:]) ^ crc[n:]
        same = text[:-n] == text[n:]
        who.append(text[n:][same])
        found.append(run[same])
    return np.bincount(text, minlength=len(texts)), np.concatenate(who), np.concatenate(found)


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for part, _ in slices(batches, 0):
        total += np.bincount(features(part.column(0))[2] % np.uint32(buckets), minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all whole texts fall into each bucket: ``buckets`` numbers come to the driver, whatever the input."""
    rows = in_small_batches(texts.select(F.col(text).cast("string").alias("text")))
    found = rows.mapInArrow(lambda b: _count(b, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: thousandths of the log ratio of smoothed shares, floored."""
    t, s, n = target.astype(float), source.astype(float), len(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = gain.value
    for part, _ in slices(batches, 1):
        words, who, crc = features(part.column(1))
        weight = np.bincount(who, weights=table[crc % np.uint32(len(table))], minlength=len(words)).astype(np.int64)  # whole numbers: exact
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in (words, np.bincount(who, minlength=len(words)), weight))], schema=schema)


def _noise(key: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, floored, that the seed and the key alone decide."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digits, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def in_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, from 1 in this order: sorted by ranges, with the counts of the ranges before added."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = cut(ranged.withColumn("_p", F.shiftright("_m", 33)), "ranked")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range, so at most as many as shuffle partitions: one task may add them up, and they may be broadcast.
    before = counts.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    placed = ranged.join(F.broadcast(before), F.col("_p") == F.col("_q"))
    return placed.select(*rows.columns, (F.col("_m").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).alias("place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """Every document with its weight towards the texts of ``target``, its score, and its rank if it is drawn.

    Returns doc_id, n_words, n_features, weight, score and rank. Drawn are ``percent`` of the documents with ``least_words``
    words or more, rounded down, by highest score; equal scores: the smaller doc_id first. Texts are read twice, for counts
    and for weights.

    Null and empty text, and text without a word: no features, weight 0, never drawn. Null doc_id: its noise is that of an
    empty id, and it comes before others of its score. Repeated rows: each counts and each can be drawn. Empty ``docs``: no
    rows. Empty ``target``: all its shares are equal. Very long texts count whole. Other columns are not read.
    """
    gain = gains(bucket_counts(target, buckets=buckets), bucket_counts(docs, buckets=buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    rows = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    names = ["doc_id", "n_words", "n_features", "weight"]
    weighed = rows.mapInArrow(lambda b: _weigh(b, shared, pa.schema([(c, pa.int64()) for c in names])), ", ".join(f"{c} long" for c in names))
    scored = cut(weighed.withColumns({"score": F.col("weight") + _noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()}), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = in_rank(scored, (~able).asc(), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row"))
    return placed.select(*names, "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
