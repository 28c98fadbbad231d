"""Files read in ranges against files read whole: JSON of every form cut anywhere, and lines."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from chatloom.sources import json_exports as J
from chatloom.sources.ranges import read_items, read_lines

BOM = "﻿"


def value(rng, depth=0):
    k = rng.randrange(8 if depth < 3 else 5)
    if k < 3:
        return "".join(rng.choice('ab{}[]",\\ é\n:') for _ in range(rng.randrange(8)))
    if k == 3:
        return rng.choice([1, None, True, 1.5])
    if k == 4:
        return {}
    if k == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choice('ab{}["') for _ in range(3)): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def files_of(rng, n):
    out = {}
    for i in range(n):
        items, form = [value(rng) for _ in range(rng.randrange(12))], i % 5
        whole = items if form < 3 else {"x": value(rng), "conversations": items, "y": [value(rng), {"z": 1}]} if form == 3 else {"m": value(rng), "n": 1}
        text = json.dumps(whole, indent=rng.choice([None, 1]), ensure_ascii=rng.choice([True, False]))
        out[f"f{i:02d}.json"] = f"{BOM}{text}\n" if i % 7 == 0 else text
    return out


def objects_by_hand(text):
    try:
        whole = json.loads(text.removeprefix(BOM))
    except ValueError:
        return []
    if isinstance(whole, dict):
        whole = whole["conversations"] if isinstance(whole.get("conversations"), list) else [whole]
    return [x for x in whole if isinstance(x, dict)] if isinstance(whole, list) else []


def put(folder, files):
    for name, text in files.items():
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "0")
    yield 40
    for n, x in before.items():
        spark.conf.set(n, x)


def test_items_of_json_cut_anywhere(spark, tmp_path, small_ranges):
    files = files_of(random.Random(4), 40)
    files |= {"empty.json": "", "blank.json": " \n", "cut.json": '[{"a":1},{"b":', "behind.json": '[{"a":1}] x', "commas.json": '[{"a":1},,{"b":2}]', "none.json": "[]", "none2.json": ' {"conversations": []}', "word.json": "[nul, {}]", "text.json": '"{}"', "badkey.json": '[{"a":1},{b:2}]', "raw.json": b'[{"a":"\xff"}]'}
    rows = read_items(spark, put(tmp_path, files), range_bytes=small_ranges).orderBy("source_id", "item").collect()
    got = {}
    for r in rows:
        got.setdefault(os.path.basename(r.source_id), []).append(json.loads(r.body))
    assert got.pop("raw.json") == [{"a": "�"}]
    want = {name: objects_by_hand(text) for name, text in files.items() if isinstance(text, str)}
    assert got == {name: x for name, x in want.items() if x} and sum(map(len, got.values())) > 60
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(small_ranges)


def test_lines_cut_anywhere(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    files = {f"f{i}.txt": (BOM if i % 2 else "") + "".join(rng.choice(["a", "é", " ", "\n", "\n\n", "\r\n", "x" * 50, "　"]) for _ in range(60)) for i in range(12)} | {"e.txt": "", "bad.txt": b"a\xff\n\xfeb"}
    got = {}
    for r in read_lines(spark, put(tmp_path, files), range_bytes=small_ranges).orderBy("source_id", "node").collect():
        got.setdefault(os.path.basename(r.source_id), []).append(r.line)
    read = {name: (text if isinstance(text, bytes) else text.encode()).decode(errors="replace").removeprefix(BOM) for name, text in files.items()}
    want = {name: [x.strip() for x in text.split("\n") if x.strip()] for name, text in read.items()}
    assert got == {name: x for name, x in want.items() if x}


def test_many_ranges_are_many_tasks(spark, tmp_path, small_ranges):
    # one export of three hundred conversations: read in many ranges, equal to the whole; no range is more than its bytes
    node = lambda i, k: {"id": f"n{k}", "parent": f"n{k - 1}" if k else None, "children": [f"n{k + 1}"] if k < 3 else [], "message": {"author": {"role": ("user", "assistant")[k % 2]}, "create_time": 1700000000 + k, "content": {"parts": [f"say {i} {{{k}}} \"}}\" \\"]}}}
    export = [{"title": f"chat {i}", "current_node": "n3", "mapping": {f"n{k}": node(i, k) for k in range(4)}} if i % 10 else {"other": i} for i in range(300)]
    path = put(tmp_path, {"conversations.json": json.dumps(export)})
    items = read_items(spark, path, range_bytes=4096)
    got = J.tree_messages(J.chosen(items, "mapping", "{"))
    docs = spark.createDataFrame([(items.first().source_id, json.dumps(export))], "source_id string, text string")
    want = J.chatgpt(docs)
    for a, b in zip(got, want, strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert got[0].count() == 270 * 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    sizes = spark.read.option("lineSep", "}").text(path).groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("value") + 1)).collect()
    assert len(sizes) > 20 and max(r[1] for r in sizes) < 3 * 4096
