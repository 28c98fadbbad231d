"""Tables that a Python worker keeps from task to task, bounded in bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Entries of one generation of a table unless it is said otherwise, and the longest key that is kept.
ENTRIES, LONGEST = 50_000, 64
#: Text that is worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch, which Spark and the worker hold at the same time.
BATCH_ROWS = 500

#: Text after which a task gives freed memory back to the system.
GIVE_BACK = 16 << 20

_held: dict[str, object] = {}


def give_back() -> None:
    """Give memory that is free, but kept by allocators, back to the system: workers stay for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # there is no such call on this system
        pass


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with batches of at most 500 rows for Python from here on in its session: a batch of 10,000, which is Spark's
    setting, would be gigabytes where texts are long. A lower setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def held(name: str, make: Callable[[], object]):
    """The worker's table of this name. A worker keeps one table at a time, so that of another operator's stage goes."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


class Recent(dict):
    """``make`` of a key (bytes), remembered for keys that were asked for lately.

    There are two generations: when the newer has ``entries`` keys it becomes the older, whose place it takes. Long keys are
    not kept, so the table is bounded in bytes.
    """

    def __init__(self, make: Callable[[bytes], object], entries: int = ENTRIES, longest: int = LONGEST):
        super().__init__()
        self.make, self.entries, self.longest, self.older = make, entries, longest, {}

    def __missing__(self, key: bytes):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches with at most ``most`` bytes in a text column, or one row, and that column as a list of bytes.

    What they took is given back to the system now and then, and after the last one.
    """
    worked = 0
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        begin = total = 0
        for end, size in enumerate([*sizes, most + 1]):
            if end > begin and (total + size > most or end == len(sizes)):
                yield batch.slice(begin, end - begin), texts.slice(begin, end - begin).to_pylist()
                begin, total = end, 0
            total += size
        del texts
        worked += sum(sizes)
        if worked > GIVE_BACK:
            worked = 0
            give_back()
    give_back()
