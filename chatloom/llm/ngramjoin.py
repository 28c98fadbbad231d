"""N-gram Jaccard join by vertical partitioning (operator 5).

Each text is the set of its distinct word n-grams, as 64-bit hashes. The order of all n-grams is cut into fragments. In a
fragment, which holds a segment of every set, n-grams of a single set are told from shared ones; the counts of shared
n-grams are then summed over the fragments for each set, and only sets of which enough is shared go on. These are few:
with a threshold of 0.75, three quarters of a set must be in other sets too. Equal sets are one class from the start.

Classes are linked in two rounds. Candidates share an n-gram of the prefix (rare ones first): at first each class is
paired with the most central class of each of its prefix n-grams, which links large groups of copies without listing
their pairs; then pairs across the components so far are sought in the tasks, n-gram by n-gram, where a parity signature
(a bit for each hash, so that the bits that differ never exceed the n-grams that differ) leaves out those below the
threshold. The overlap of a pair is counted in each fragment separately and summed, and links are exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import cut
from chatloom.llm.components import components
from chatloom.llm.workers import Recent, give_back, held, in_small_batches, slices

WORDS, PERCENT = 5, 75
#: Fragments of the n-gram order: at least so many, and more so that one holds about this many n-grams (some 40 bytes each
#: in the task that has it).
FRAGMENTS, FRAGMENT_GRAMS = 32, 2_000_000
#: Fragments in which a pair's overlap is counted.
PARTS = 4
SIGNATURE_BITS = 4096
#: Classes of one n-gram that are compared at once; larger groups are cut into blocks, pair of blocks by pair.
BLOCK = 4096
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes() -> Recent:
    return held("word hashes", lambda: Recent(xxhash.xxh64_intdigest))


def grams_of(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams; with fewer words than n, of all words as one; without words, none."""
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out += _mix(hashed[i : len(hashed) - k + 1 + i] + np.uint64(i)) * _ODD[i % len(_ODD)]
    return np.unique(_mix(out))


def set_key(grams: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = _mix(np.array([np.add.reduce(_mix(grams ^ _ODD[1])), np.uint64(len(grams))], np.uint64))
    return int(_mix(total[:1] + _ODD[2] * total[1:]).view(np.int64)[0])


def _describe(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches, 1):
        sizes, names = [], []
        for text in texts:
            grams = grams_of(text, words)
            sizes.append(len(grams))
            names.append(set_key(grams) if len(grams) else None)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], ["doc_id", "n", "key"])


SEGMENTS = "f int, keys binary, counts binary, tokens binary"
_SEGMENTS = pa.schema([("f", pa.int32()), *((c, pa.binary()) for c in ("keys", "counts", "tokens"))])


def _rows(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]


def _cut_sets(batches: Iterator[pa.RecordBatch], words: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Segments of sets by fragment (the first ``bits`` bits of a hash); of the rest of a hash 32 bits are kept."""
    for _, texts in slices(batches, 0):
        sets = {set_key(s): s for s in (grams_of(t, words) for t in texts) if len(s)}
        if not sets:
            continue
        names, sizes = np.fromiter(sets, np.int64, len(sets)), [len(s) for s in sets.values()]
        grams, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        f = (grams >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(f, kind="stable")  # sets stay in order within a fragment
        tokens, owner, f = ((grams >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype("<u4")[order], owner[order], f[order]
        edges = np.flatnonzero(np.diff(f, prepend=-1, append=-2))
        rows = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            who, counts = np.unique(owner[lo:hi], return_counts=True)
            rows.append((int(f[lo]), names[who].tobytes(), counts.astype("<u4").tobytes(), tokens[lo:hi].tobytes()))
        yield pa.RecordBatch.from_arrays(_rows(rows, _SEGMENTS), schema=_SEGMENTS)


def _joined(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


SHARED = "bucket int, f int, keys binary, counts binary, tokens binary, uses binary"
_SHARED = pa.schema([("bucket", pa.int32()), *_SEGMENTS, ("uses", pa.binary())])


def _find_shared(table: pa.Table, buckets: int) -> pa.Table:
    """One fragment: each set's n-grams that another set has too, and how many sets have them, dealt into buckets of sets."""
    if not table.num_rows:
        return pa.Table.from_batches([], _SHARED)
    fragment = table.column("f")[0].as_py()
    keys, counts, tokens = (_joined(table, c, t) for c, t in (("keys", "<i8"), ("counts", "<u4"), ("tokens", "<u4")))
    _, once = np.unique(keys, return_index=True)
    if len(once) < len(keys):  # equal sets come from several tasks
        first = np.zeros(len(keys), bool)
        first[once] = True
        tokens, keys, counts = tokens[np.repeat(first, counts)], keys[first], counts[first]
    # Sets are numbered bucket by bucket, and one sort of (token, number) brings equal tokens together.
    by_bucket = np.argsort(keys % buckets, kind="stable")
    keys, number = keys[by_bucket], np.empty(len(keys), np.uint32)
    number[by_bucket] = np.arange(len(keys), dtype=np.uint32)
    both = tokens.astype(np.uint64) << np.uint64(32)
    both |= np.repeat(number, counts)
    del tokens, number
    both.sort()
    token = both.view("<u4")[1::2]
    same = token[1:] == token[:-1]
    shared = np.zeros(len(both), bool)
    shared[1:] = same
    shared[:-1] |= same
    both = both[shared]
    del token, same, shared
    token, own = (both >> np.uint64(32)).astype("<u4"), both.astype(np.uint32)
    runs = np.diff(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))) if len(token) else np.zeros(0, np.int64)
    uses = np.repeat(runs, runs).astype("<u4")
    order = np.argsort(own, kind="stable")  # tokens stay in order within a set
    own, token, uses = own[order], token[order], uses[order]
    bucket = (keys % buckets)[own]
    rows = []
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
    for lo, hi in zip(edges, edges[1:], strict=False):
        who, n = np.unique(own[lo:hi], return_counts=True)
        rows.append((int(bucket[lo]), fragment, keys[who].tobytes(), n.astype("<u4").tobytes(), token[lo:hi].tobytes(), uses[lo:hi].tobytes()))
    del both, own, token, uses, order, bucket
    give_back()
    if not rows:
        return pa.Table.from_batches([], _SHARED)
    return pa.Table.from_arrays(_rows(rows, _SHARED), schema=_SHARED)


HEADS = "key long, n long, central long, signature binary, prefix array<long>, parts array<array<long>>"
_HEADS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("central", pa.int64()), ("signature", pa.binary()), ("prefix", pa.list_(pa.int64())), ("parts", pa.list_(pa.list_(pa.int64())))])


def _choose(classes: pa.Table, table: pa.Table, percent: int) -> pa.Table:
    """One bucket of sets (key, n), over all fragments: those of which ``percent`` per cent is shared, with their n-grams."""
    keys, counts, tokens, uses = (_joined(table, c, t) for c, t in (("keys", "<i8"), ("counts", "<u4"), ("tokens", "<u4"), ("uses", "<u4")))
    fragments = np.repeat(table.column("f").to_numpy().astype(np.int64), [len(x.as_py()) // 8 for x in table.column("keys")])
    names, size = classes.column("key").to_numpy(), classes.column("n").to_numpy()
    in_order = np.argsort(names)
    names, size = names[in_order], size[in_order]
    at = np.searchsorted(names, keys)
    total = np.bincount(at, counts, len(names)).astype(np.int64)
    wanted = 100 * total >= percent * size
    owner = np.repeat(at, counts)
    keep = wanted[owner]
    gram = (np.repeat(fragments, counts)[keep] << 32) | tokens[keep].astype(np.int64)
    owner, uses = owner[keep], uses[keep].astype(np.int64)
    order = np.lexsort((gram, uses, owner))
    owner, gram, uses = owner[order], gram[order], uses[order]
    out: list[list] = [[] for _ in _HEADS]
    edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-2))
    for lo, hi in zip(edges, edges[1:], strict=False):
        k, own = owner[lo], gram[lo:hi]
        n = int(size[k])
        # N-grams of this set alone come first in the order of uses; the rest of the prefix is what is shared.
        prefix = n - -(-percent * n // 100) + 1 - (n - len(own))
        bits = np.bincount(_mix(own.view(np.uint64)) % np.uint64(SIGNATURE_BITS), minlength=SIGNATURE_BITS) & 1
        # what is not shared differs from any other set anyway, so it needs no bit
        for column, value in zip(out, (int(names[k]), n, int(uses[lo:hi].sum()), np.packbits(bits.astype(bool)).tobytes(), own[:prefix], [own[own % PARTS == p] for p in range(PARTS)]), strict=True):
            column.append(value)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, _HEADS.types, strict=True)], schema=_HEADS)


PAIRS = "a long, b long"
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(left: list, right: list | None, percent: int) -> np.ndarray:
    """Pairs of one n-gram's classes, across components, that may reach the threshold by size and signature.

    A row is (key, n, root, unshared, signature); ``right`` None compares a block with itself.
    """
    def columns(rows: list) -> tuple:
        return *(np.array([r[i] for r in rows], np.int64) for i in range(4)), np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)

    key, n, root, alone, bits = columns(left)
    other = columns(right) if right is not None else (key, n, root, alone, bits)
    found = []
    for i in range(len(key)):
        lo = i + 1 if right is None else 0
        k, m, r, u, s = (x[lo:] for x in other)
        small, large = np.minimum(n[i], m), np.maximum(n[i], m)
        can = np.flatnonzero((r != root[i]) & (100 * small >= percent * large))
        if len(can):
            differ = np.bitwise_count(s[can] ^ bits[i]).sum(axis=1, dtype=np.int64) + alone[i] + u[can]
            both = n[i] + m[can]
            # overlap >= percent * union, where union + overlap = both and union - overlap >= differ
            can = can[100 * (both - differ) >= percent * (both + differ)]
            found.extend((min(key[i], x), max(key[i], x)) for x in k[can])
    return found


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (gram, i, j, block): each such group is a block with itself or a pair of blocks."""
    now, rows, found = None, [], []

    def settle() -> None:
        if now is None:
            return
        if now[1] == now[2]:
            found.extend(_compare([r[1:] for r in rows], None, percent))
        else:
            halves = [[r[1:] for r in rows if r[0] == side] for side in now[1:3]]
            if all(halves):
                found.extend(_compare(*halves, percent))

    for batch in batches:
        for gram, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (gram, i, j) != now:
                settle()
                now, rows = (gram, i, j), []
            rows.append(row)
        if len(found) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*set(found), strict=True)], schema=_PAIRS)
            found = []
    settle()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*set(found), strict=True)], schema=_PAIRS)


def similar_pairs(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold: overlaps are counted in each part and summed."""
    parts = heads.select("key", "n", F.posexplode("parts").alias("part", "grams"))
    left = pairs.join(parts.select(F.col("key").alias("a"), F.col("n").alias("an"), "part", F.col("grams").alias("ag")), "a")
    both = left.join(parts.select(F.col("key").alias("b"), F.col("n").alias("bn"), "part", F.col("grams").alias("bg")), ["b", "part"])
    counted = both.groupBy("a", "b", "an", "bn").agg(F.sum(F.size(F.array_intersect("ag", "bg"))).alias("x"))
    return counted.where(F.lit(100) * F.col("x") >= F.lit(percent) * (F.col("an") + F.col("bn") - F.col("x"))).select("a", "b")


def jaccard_components(docs: DataFrame, key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document with its n-gram count and component: key, n_shingles, component_id.

    Two documents are linked when 100 times the size of the intersection of their sets is at least ``percent`` times that
    of the union; a component is named by the smallest key in it. Null, empty and blank texts have no n-grams and are
    alone. Null keys: in components like others, but they name none. Repeated rows and equal sets: one component. Empty
    table: no rows. Texts count whole; sets of equal hash (64 bits) are taken as equal.
    """
    spark = docs.sparkSession
    rows = in_small_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    described = cut(rows.mapInArrow(lambda b: _describe(b, words), "doc_id long, n long, key long"), "sets")
    classes = cut(described.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")), "classes")
    grams = classes.agg(F.sum("n")).first()[0] or 0
    bits = max(FRAGMENTS.bit_length() - 1, (grams // FRAGMENT_GRAMS).bit_length())
    buckets = 1 << bits
    segments = rows.select("text").mapInArrow(lambda b: _cut_sets(b, words, bits), SEGMENTS)
    shared = segments.groupBy("f").applyInArrow(lambda t: _find_shared(t, buckets), SHARED)
    by_bucket = classes.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key", "n").groupBy("bucket")
    heads = cut(by_bucket.cogroup(shared.groupBy("bucket")).applyInArrow(lambda c, t: _choose(c, t, percent), HEADS), "heads")

    prefixes = heads.select("key", "n", "central", F.explode("prefix").alias("gram"))
    central = prefixes.groupBy("gram").agg(F.max(F.struct("central", "key", "n")).alias("c"), F.count(F.lit(1)).alias("held")).where("held > 1").select("gram", "c")
    fits = F.lit(100) * F.least("n", "c.n") >= F.lit(percent) * F.greatest("n", "c.n")
    stars = prefixes.join(central, "gram").where((F.col("key") != F.col("c.key")) & fits).select(F.least("key", "c.key").alias("a"), F.greatest("key", "c.key").alias("b")).distinct()
    links = cut(similar_pairs(stars, heads, percent), "links")
    roots = components(links)

    rooted = heads.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = cut(rooted.select("key", "n", "root", (F.col("n") - F.aggregate("parts", F.lit(0), lambda t, p: t + F.size(p))).alias("alone"), "signature", "prefix"), "rooted")
    placed = rooted.select("key", "root", F.explode("prefix").alias("gram"))
    mixed = placed.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo <> hi").select("gram", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    member = placed.join(mixed, "gram").select("key", "gram", block.alias("block"), "blocks")
    member = member.select("key", "gram", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    member = member.join(rooted.select("key", "n", "root", "alone", "signature"), "key")
    member = member.select("gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "root", "alone", "signature")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = member.repartition(parts, "gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    across = dealt.mapInArrow(lambda b: _across(b, percent), PAIRS).distinct()
    more = similar_pairs(across, heads, percent)
    roots = components(links.unionByName(more))

    named = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("key", "root").join(names, "root").select("key", "component_id")
    found = described.join(named, "key", "left")
    return found.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
