"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 7).

Training counts hashed character n-grams by language in the tasks, adds the counts up with one aggregation, and collects a
matrix of a fixed size: languages times buckets. Its log probabilities are broadcast. Texts are counted and scored in blocks:
the n-grams of a block are a sparse matrix, one entry for each n-gram (its text and its bucket), and one gather of the
matrix' rows and one segmented sum give texts times languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from chatloom.llm.workers import in_small_batches, slices

#: n-grams of 1 to 3 characters, in 2 ** BITS buckets.
SIZES, BITS = (1, 2, 3), 15
BUCKETS = 1 << BITS
#: Characters times languages of a block; a longer text is taken in blocks of its own, with the sums added up.
BLOCK = 1 << 20
#: Languages of a model unless the caller allows more: 4 * 2 ** BITS bytes each in the broadcast, 8 in a training task.
MAX_LANGS = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def _blocks(texts: list[str | None], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about ``most`` characters: which texts, where each begins, and the code points.

    A text longer than a block comes in pieces that overlap so that each n-gram begins in exactly one of them, each piece
    ending with the two characters that only continue its n-grams; such a piece is alone in its block.
    """
    over = max(SIZES) - 1
    who, parts, held = [], [], 0
    for i, text in enumerate(texts):
        codes = _codes(text or "")
        if len(codes) > most:
            for at in range(0, len(codes), most):
                yield np.array([i]), np.array([min(most, len(codes) - at)]), codes[at : at + most + over]
            continue
        if not len(codes):
            continue
        if held + len(codes) > most and held:
            yield np.array(who), np.array([len(p) for p in parts]), np.concatenate(parts)
            who, parts, held = [], [], 0
        who.append(i)
        parts.append(codes)
        held += len(codes)
    if held:
        yield np.array(who), np.array([len(p) for p in parts]), np.concatenate(parts)


def _entries(lengths: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram: the bucket of each, in order, and how many begin in each text of a block."""
    ends = np.cumsum(lengths)
    last = np.repeat(ends if len(lengths) > 1 else np.array([len(codes)]), lengths)  # where the n-grams of a text must end
    wide, key = codes.astype(np.uint64), np.zeros(len(codes), np.uint64)
    for n in range(1, max(SIZES) + 1):
        key = key[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :] + np.uint64(n)
        if n in SIZES:
            mixed = key ^ (key >> np.uint64(29))
            found = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)[: len(last)]
            inside = np.arange(n, len(found) + n) <= last[: len(found)]
            counts = np.add.reduceat(inside, ends - lengths, dtype=np.int64) if len(inside) == len(last) else np.array([np.count_nonzero(inside[b:e]) for b, e in zip(ends - lengths, ends, strict=True)])
            yield found[inside], counts


def _count(batches: Iterator[pa.RecordBatch], langs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    number = {x: i for i, x in enumerate(langs)}
    counts, docs = np.zeros((len(langs), BUCKETS), np.int64), np.zeros(len(langs), np.int64)
    for part, texts in slices(batches, 0):
        lang = np.array([number[x] for x in part.column(1).to_pylist()], np.int64)
        docs += np.bincount(lang, minlength=len(langs))
        for own in np.unique(lang).tolist():
            mine = [texts[i].decode() for i in np.flatnonzero(lang == own).tolist() if texts[i]]
            for _, lengths, codes in _blocks(mine, BLOCK):
                for found, _ in _entries(lengths, codes):
                    counts[own] += np.bincount(found, minlength=BUCKETS)
    own, bucket = np.nonzero(counts)
    seen = np.flatnonzero(docs)
    # bucket -1 holds the number of documents
    arrays = (np.append(own, seen), np.append(bucket, np.full(len(seen), -1)), np.append(counts[own, bucket], docs[seen]))
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], ["lang", "bucket", "n"])


def train(docs: DataFrame, smoothing: float = 0.5, most_langs: int = MAX_LANGS) -> Model:
    """Fit the model on every row's text and non-null lang.

    The languages are listed first. More than ``most_langs`` of them stop the query, so what comes to the driver, and what a
    task holds, is at most so many times 2 ** BITS counts whatever the input. Null and empty texts count for the share of
    their language alone. Repeated rows count as often as they are there. No labelled row: a model without languages, which
    answers ``und`` always. Other columns are not read.
    """
    rows = in_small_batches(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull()))
    langs = tuple(sorted(r.lang for r in rows.select("lang").distinct().limit(most_langs + 1).collect()))
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    counted, prior = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    if langs:
        found = rows.mapInArrow(lambda b: _count(b, langs), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        at, bucket, n = (found.column(c).to_numpy() for c in ("lang", "bucket", "n"))
        prior[at[bucket < 0]] = n[bucket < 0]
        counted[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    counted += smoothing
    return Model(langs, np.log(prior / max(prior.sum(), 1)), np.log(counted / counted.sum(axis=0)).astype(np.float32))


def scores(m: Model, texts: list[str | None]) -> np.ndarray:
    """Log of prior times likelihood of each text (rows) in each language (columns)."""
    total = np.repeat(m.log_prior[None, :], len(texts), axis=0)
    for who, lengths, codes in _blocks(texts, max(BLOCK // max(len(m.langs), 4), max(SIZES))):
        for found, counts in _entries(lengths, codes):
            some = np.flatnonzero(counts)
            if len(some):
                begins = (np.cumsum(counts) - counts)[some]
                total[who[some]] += np.add.reduceat(m.log_prob[found], begins, axis=0, dtype=np.float64)
    return total


def _score(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    for part, raw in slices(batches, len(schema) - 2, most=1 << 20):
        texts = [x.decode() if x else None for x in raw]
        known = np.array([bool(m.langs) and x is not None and any(map(str.isalpha, x)) for x in texts], bool)
        langs, sure = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if known.any():
            total = scores(m, [x for x, k in zip(texts, known.tolist(), strict=True) if k])
            total -= total.max(axis=1, keepdims=True)
            langs[known] = np.array(m.langs, object)[total.argmax(axis=1)]
            sure[known] = np.minimum(1.0, 1 / np.exp(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(sure)], schema=schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 by 3."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def judged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row: all columns of ``docs``, lang_pred, score: the posterior probability of that language), whatever their names.

    Null text and text without a letter: ``und`` with score 0. Ties go to the language that comes first by name. Repeated
    rows and null ids: each row is judged. Empty table: no rows. Whole texts count, whatever their length.
    """
    rows = in_small_batches(docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text")))
    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times buckets, 4 bytes each
    names = ["row", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([batch.schema.field(0), pa.field(names[1], pa.string()), pa.field(names[2], pa.float64())])
            yield from _score(iter([batch]), shared, out)

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``; see ``judged``."""
    found = judged(docs.select(*dict.fromkeys([*keep, text])), model, text)
    return found.select(*(F.col("row")[c].alias(c) for c in keep), "lang_pred", "score")
