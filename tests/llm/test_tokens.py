"""Token files, packing and sharding against plain Python."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatloom.llm import queries
from chatloom.llm.common import new_dir, table, vocabulary
from chatloom.llm.packing import best_fill, pack, pack_lengths
from chatloom.llm.sharding import ROUNDS, grid, shard
from chatloom.llm.tokenfile import TokenFile, read_documents, read_manifest, write_token_files
from chatloom.llm.wordids import WordIds
from chatloom.llm.workers import Recent, slices

PATH = vocabulary("word_bpe_49k.json")
TEXTS = [(3, "a b"), (1, None), (2, ""), (None, "x y z"), (3, "a b"), (5, "word " * 3000), (9, "  Été ²\n<|endoftext|> \"quoted\" ")]


WHOLE, WORDS = Tokenizer.from_file(PATH), WordIds(PATH)


def whole_ids(text, end):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_word_ids_are_those_of_the_whole_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(WORDS.encode(text.encode()), "<u4").tolist() == whole_ids(text, 0)[:-1]


@pytest.mark.parametrize("text", ["H\u0331 T\u0308. h\u0331, I\u0307", "a!, b., c.. d,, \u00d7, \u00f7. \u00e9, \u00c9. 3, 4.\n\u4e2d, x's. I'M, ", "<|EndOfText|>A. B, <|endoftext|>C, d"])
def test_signs_and_capitals_are_taken_off_words_only_where_ids_stay(text):
    assert np.frombuffer(WORDS.encode(text.encode()), "<u4").tolist() == whole_ids(text, 0)[:-1]


def test_words_are_looked_up_without_capitals_and_signs():
    words = WordIds(PATH)
    words.words.clear()
    words.encode("Zorble zorble, ZORBLE. Z\u00f6rble, z\u00f6rble.\nzorble".encode())
    assert set(words.words) == {b"zorble", "z\u00f6rble".encode(), b",", b"."}


def test_a_full_table_of_words_keeps_those_met_lately(monkeypatch):
    monkeypatch.setattr("chatloom.llm.wordids.ENTRIES", 40)
    words, asked = WordIds(PATH), []
    tokenize = words.words.tokenize
    words.words.tokenize = lambda x: asked.append(x) or tokenize(x)
    names = ["q" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(100)]
    for name in names:
        words.encode(f"often {name}".encode())
    assert asked.count("often") <= 1 and len(words.words) <= 40 and len(words.words.older) <= 40


def test_a_vocabulary_whose_tokens_take_in_blanks(spark, docs):
    path = vocabulary("byte_bpe_50k.json")
    assert WORDS.by_word and not WordIds(path).by_word
    whole = Tokenizer.from_file(path)
    want = sorted(((d, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in [*TEXTS, (7, "Hello big world again")]), key=repr)
    ids = lambda x: np.frombuffer(x, "<u4").tolist()
    folder = new_dir(spark, "t")
    write_token_files(docs([*TEXTS, (7, "Hello big world again")]), folder, path, end_id=2, length=64)
    assert sorted(((r.doc_id, ids(r.ids)) for r in read_documents(spark, folder).collect()), key=repr) == want
    pieces = {}
    for r in sorted(pack(docs([(7, "Hello big world again")]), path, capacity=64).collect(), key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).extend(ids(r.ids))
    assert pieces == {7: [15496, 1263, 995, 757, 2]}


def test_worker_tables_are_bounded():
    made = []
    table = Recent(lambda k: made.append(k) or len(k), entries=3)
    assert [table[b"%d" % i] for i in range(10)] == [1] * 10 and table[b"8"] == 1 and len(made) == 10
    assert table[b"x" * 65] == table[b"x" * 65] == 65 and len(made) == 12 and len(table) <= 3 and len(table.older) <= 3


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "t": ["a" * 4, None, "b" * 9, "", "c" * 4, "d" * 5]})
    got = [(part.column(0).to_pylist(), texts) for part, texts in slices(iter([batch, batch.slice(0, 0)]), 1, most=8)]
    assert got == [([0, 1], [b"aaaa", None]), ([2], [b"b" * 9]), ([3, 4], [b"", b"cccc"]), ([5], [b"ddddd"])]


def test_token_files_round_trip(spark, docs):
    folder = new_dir(spark, "t")
    write_token_files(docs(TEXTS), folder, PATH, end_id=1, length=64, files=3, rows=4)
    want, start = [], 0
    for doc_id, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole_ids(text, 1)
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read_documents(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for m in read_manifest(spark, folder).collect():
        f = TokenFile(f"{folder}/{m.tokens_file}")
        assert len(f) == m.n_sequences and f.reader.schema.field("ids").type.value_type == "uint16"
        assert sum(sum(f.sequence(i, "mask").to_pylist()) for i in range(len(f))) == m.n_tokens
        assert sum(sum(f.sequence(i, "ends").to_pylist()) for i in range(len(f))) == m.n_docs
        batches = [f.reader.get_batch(b).num_rows for b in range(f.batches)]
        assert set(batches[:-1]) <= {4}
        runs = np.concatenate([f.reader.get_batch(b).column("ids").values.to_numpy() for b in range(f.batches)])
        assert all(f.sequence(i).to_numpy().tolist() == runs[64 * i : 64 * i + 64].tolist() for i in range(len(f)))
        with pytest.raises(IndexError):
            f.sequence(len(f))


def test_token_files_of_an_empty_table(spark, docs):
    folder = new_dir(spark, "t")
    assert write_token_files(docs(TEXTS).limit(0), folder, PATH, end_id=1).count() == 0
    assert read_documents(spark, folder).count() == 0


def test_token_file_query_against_the_tokenizer(spark, sf_dir):
    rows = sorted(table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    start, want = 0, set()
    for r in rows:
        ids = whole_ids(r.text, 1)
        want.add((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert {tuple(r) for r in queries.op4_token_files(spark, sf_dir).collect()} == want


def pieces_are_whole(got, want):
    """Each id lies in exactly one piece, sequences have no gap, and few have padding."""
    docs, windows = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert sorted(docs, key=repr) == sorted(want, key=repr)
    for k, ids in want.items():
        at = 0
        for r in sorted(docs[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = 0
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_packing_query(spark, sf_dir):
    want = {r.doc_id: whole_ids(r.text, 2) for r in table(spark, sf_dir, "documents").collect()}
    assert pieces_are_whole(queries.op10_packing(spark, sf_dir).collect(), want) == 0


def test_packing_edges(spark, docs):
    got = pack(docs(TEXTS), PATH, capacity=64, end_id=2).collect()
    assert sum(r.length for r in got) == sum(len(whole_ids(t, 2)) for _, t in TEXTS)
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert pack(docs(TEXTS).limit(0), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_best_fill_is_the_closest_multiset(counts, room):
    reach = {0}
    for n, k in counts.items():
        reach = {x + n * j for x in reach for j in range(k + 1) if x + n * j <= room}
    picked = best_fill(counts, room)
    assert sum(n * k for n, k in picked.items()) == max(reach)
    assert all(k <= counts[n] for n, k in picked.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([1, 7, 64]))
def test_pack_lengths_covers_each_unit_once(lengths, capacity):
    windows = pack_lengths(lengths, capacity)
    units = sorted((i, s + k) for w in windows for i, s, n in w for k in range(n))
    assert units == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    assert all(sum(n for *_, n in w) <= capacity for w in windows)


def place_of(x, n, seed):
    def h(i, v):
        out = 42
        for part, form in ((seed, "<q"), (i, "<i"), (v, "<q")):
            data = struct.pack(form, part) if form == "<q" else struct.pack("<i", part)
            out = xxhash.xxh64(data, seed=out).intdigest()
        return out - (1 << 64) if out >> 63 else out

    a, b = grid(n)
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + h(i, right) % a) % a
            else:
                right = (right + h(i, left) % b) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 10, 333])
def test_sharding_is_the_permutation(spark, docs, n):
    got = shard(docs([(i // 2, f"t{i % 7}") for i in range(n)]), shards=8, seed=5).collect()
    assert sorted(r.row_number for r in got) == list(range(n)) == sorted(r.place for r in got)
    for r in got:
        assert (r.place, r.shard, r.slot) == (place_of(r.row_number, n, 5), r.place % 8, r.place // 8)
    again = shard(docs([(i // 2, f"t{i % 7}") for i in range(n)][::-1]).repartition(3), shards=8, seed=5).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_sharding_edges(spark, docs):
    got = {(r.doc_id, r.size, r.text_crc32) for r in shard(docs(TEXTS), shards=8).collect()}
    assert got == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in TEXTS}
    assert shard(docs(TEXTS).limit(0), shards=8).count() == 0


def test_sharding_query(spark, sf_dir):
    got = queries.op3_sharding(spark, sf_dir).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
