"""Sources, packs, distilling and the whole pipeline on small made-up exports."""

import io
import json
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from chatloom.operators import distill as D
from chatloom.operators import pack as P
from chatloom.operators.structure import source_stats, structure_lines
from chatloom.plans import queries as Q
from chatloom.plans.pipeline import run_from_source, run_pipeline
from chatloom.schemas import RAW
from chatloom.sources import archives, registry
from chatloom.sources import json_exports as J
from chatloom.sources import texts as X
from chatloom.streaming.weekly import weekly_counts


def docs(spark, *texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "source_id string, text string")


def said(df):
    return [(r.role, r.text, r.ts_ms) for r in df.orderBy("source_id", "pos").collect()]


def node(id_, parent, children, role=None, parts=None, at=None):
    message = None if role is None else {"author": {"role": role}, "create_time": at, "content": {"parts": parts}}
    return {"id": id_, "parent": parent, "children": children, "message": message}


TREE = [{
    "title": "t", "current_node": "u2",
    "mapping": {
        "z": node("z", None, ["u1"]), "u1": node("u1", "z", ["a1", "a2"], "user", [" hi "], 1.5), "a1": node("a1", "u1", ["t"], "assistant", ["old"], 2),
        "a2": node("a2", "u1", ["u2", "nowhere"], "assistant", ["new", {"image": 1}, "er"], None), "t": node("t", "a1", [], "tool", ["x"]),
        "u2": node("u2", "a2", ["u1"], "critic", ["bye"], "1700000000"), "lost": node("lost", "gone", [], "user", ["never"]), "e": node("e", None, [], "user", ["  "]),
    },
}]


def test_message_trees(spark):
    found, skipped = J.chatgpt(docs(spark, json.dumps(TREE), json.dumps({"conversations": TREE}), json.dumps(TREE[0]), "not json", json.dumps(TREE) + "x", "[]"))
    tree = [("user", "hi", 1500), ("assistant", "old", 2000), ("assistant", "new\ner", None), ("unlabeled", "bye", 1700000000000)]
    assert said(found) == tree * 3
    assert {r.source_id: r.skipped for r in skipped.collect()} == {"s0": 2, "s1": 2, "s2": 2}
    assert found.where("role = 'unlabeled'").first().meta.original_role == "critic"
    mixed = J.chatgpt(docs(spark, json.dumps([1, None, {"mapping": 5}, "x", TREE[0]])))[0]
    assert said(mixed) == tree and mixed.first().meta.conversation_index == 0
    path = J.chatgpt(docs(spark, json.dumps(TREE)), current_path=True)[0]
    assert said(path) == [tree[0], tree[2], tree[3]]


def test_deep_trees(spark):
    mapping = {f"n{i}": node(f"n{i}", f"n{i - 1}" if i else None, [f"n{i + 1}"], "user", [str(i)]) for i in range(3000)}
    found = J.chatgpt(docs(spark, json.dumps([{"title": "d", "mapping": mapping, "current_node": "n2999"}])))[0]
    assert [r.text for r in found.orderBy("pos").collect()] == [str(i) for i in range(3000)]


def test_flat_conversations(spark):
    flat = [{"name": "c", "chat_messages": [
        {"sender": "human", "text": "", "content": [{"type": "text", "text": "a"}, {"type": "x", "text": "no"}, {"type": "text", "text": "b"}], "created_at": "2025-01-01T00:00:00Z"},
        {"sender": "assistant", "text": " yes ", "content": None}, {"sender": "other", "text": "?"}, {"sender": "human", "text": " "},
    ]}]
    found, skipped = J.claude(docs(spark, json.dumps(flat)))
    assert said(found) == [("user", "a\nb", 1735689600000), ("assistant", "yes", None), ("unlabeled", "?", None)]
    assert skipped.first().skipped == 1


def bundle(spark, messages, with_messages=True):
    files = [("b", "u/data/user.json", '{"first_name":" Ada "}'), ("b", "u\\data\\Character.json", '{"name":"Bot"}')]
    if with_messages:
        files.append(("b", "u/data/message.json", json.dumps(messages)))
    return spark.createDataFrame(files, "source_id string, name string, text string")


def test_bundles(spark):
    messages = [
        {"src": {"name": "Bot", "is_human": False, "raw_content": "second", "text": "decoy"}, "created_at": "2025-01-01T00:02:00Z"},
        {"raw_content": "first", "name": "Ada", "created": "2025-01-01T00:01:00Z"}, {"src": {"name": "Who", "raw_content": "third"}, "create_time": 1735689900}, {"text": "no raw content"},
    ]
    found, skipped = J.characterai(bundle(spark, messages))
    assert said(found) == [("user", "first", 1735689660000), ("assistant", "second", 1735689720000), ("unlabeled", "third", 1735689900000)]
    del messages[1]["created"]
    assert [t for _, t, _ in said(J.characterai(bundle(spark, messages))[0])] == ["second", "first", "third"]
    with pytest.raises(Exception, match="message.json"):
        J.characterai(bundle(spark, [], with_messages=False))[0].collect()


def test_json_lines(spark):
    lines = [{"user_name": "a", "character_name": "b"}, {"name": "A", "is_user": True, "mes": "hi", "send_date": "June 13, 2025 10:27:37pm"}, {"is_system": True, "mes": "note", "send_date": 1749853657}, {"mes": " "}, {"other": 1}]
    found, skipped = J.sillytavern(docs(spark, "﻿" + "\n".join(map(json.dumps, lines)) + "\nbroken{\n" + json.dumps({"mes": "x"})))
    assert said(found) == [("user", "hi", 1749853657000), ("system", "note", 1749853657000), ("assistant", "x", None)]
    assert skipped.first().skipped == 3


def make_zip(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


WORD = '<w:p><w:r><w:t xml:space="preserve"> Ada &amp; co </w:t><w:br/><w:t>next</w:t><w:tab/><w:t>tab</w:t></w:r></w:p><w:p></w:p><w:p><w:t>last&#33;</w:t></w:p>'


def binaries(spark, **files):
    return spark.createDataFrame([(k, k.replace("_", "."), bytearray(v)) for k, v in files.items()], "source_id string, path string, content binary")


def test_archives_and_word(spark):
    data = make_zip({"word/document.xml": WORD})
    assert archives.word_texts(binaries(spark, a_docx=data)).first().text == "Ada & co\nnext\ttab\nlast!"
    assert {(r.name, bytes(r.content)) for r in archives.entries(binaries(spark, a_zip=make_zip({"x/y": b"1", "z": b""}, zipfile.ZIP_STORED))).collect()} == {("x/y", b"1"), ("z", b"")}
    with pytest.raises(archives.ArchiveError):
        list(archives.read_entries(b"PK\x03\x04 no"))
    with pytest.raises(archives.ArchiveError):
        list(archives.read_entries(make_zip({"a": "1"}, zipfile.ZIP_BZIP2)))


CHAT = "Ada: 06-01 10:00 hi\nBot: 06-01 10:01 hello"


def test_sniffing(spark):
    texts = {
        "local-web": "  <html>", "st-chatlog": '{"user_name":"a"}\n{"mes":"x","is_user":true}', "chatgpt": '[{"x":1},{"mapping":{}}]', "claude": '{"conversations":[{"chat_messages":[]}]}',
        "characterai": '[{"src":{"raw_content":"x"}}]', "txt-docx": CHAT, None: "nothing special", "": '{"conversations":[1]}',
    }
    got = {r.source_id: r.name for r in registry.sniff_texts(docs(spark, *texts.values())).collect()}
    assert [got[f"s{i}"] for i in range(len(texts))] == [k or None for k in texts]
    files = binaries(
        spark, a=make_zip({"word/document.xml": WORD, "message.json": "[]"}), b=make_zip({"d/message.json": "[]", "d/character.json": "{}"}), c=b"\x89PNG\r\n\x1a\n0000", d=CHAT.encode(), e_jpg=b"x", f=b"RIFF1234WEBPxx", g=b"none"
    )
    got = {r.source_id: (r.name, r.confidence) for r in registry.sniff_files(files).collect()}
    assert registry.sniff_files(binaries(spark, z_zip=b"PK\x03\x04 no", t=b"\xff" + CHAT.encode())).where("error is not null").first().source_id == "z_zip"
    assert got == {"a": ("txt-docx", "high"), "b": ("characterai", "high"), "c": ("screenshot", "high"), "d": ("txt-docx", "low"), "e_jpg": ("screenshot", "high"), "f": ("screenshot", "high"), "g": (None, None)}
    assert registry.sniff_bundles(bundle(spark, [])).first().name == "characterai"


def test_registry(spark):
    assert registry.list_adapters(spark).where("status = 'ready'").count() == 7 and registry.get_adapter("nope") is None
    with pytest.raises(ValueError, match="chatgpt"):
        registry.convert("nope", docs(spark, ""))
    with pytest.raises(registry.NotSupportedYet):
        registry.convert("qq-export", docs(spark, ""))


def test_files_of_all_kinds_in_one_table(spark):
    files = binaries(
        spark, word_docx=make_zip({"word/document.xml": WORD}), bundle_zip=make_zip({"u/data/message.json": json.dumps([{"raw_content": "x", "is_human": True}, {"raw_content": " "}]), "u/character.json": '[{"name":"Bot"},{"name":"No"}]'}),
        damaged_zip=b"PK\x03\x04 no", page_html=b"<p>Hi &amp; bye</p><p>two</p>", empty_html=b"<p></p>", tree_json=json.dumps(TREE).encode(), bytes_txt=b"\xff" + CHAT.encode(), shot_png=b"\x89PNG\r\n\x1a\n0000", what_bin=b"nothing", messages_json=json.dumps([{"raw_content": "y"}]).encode(),
    )
    found = registry.convert_files(files, vision=Eyes)
    status = {r.source_id: (r.adapter, r.messages, r.skipped, r.error) for r in found.status.collect()}
    assert status.pop("damaged_zip")[:3] == (None, 0, 0)
    assert status == {
        "word_docx": ("txt-docx", 3, 0, None), "bundle_zip": ("characterai", 1, 1, None), "page_html": ("local-web", 2, 0, None), "empty_html": ("local-web", 0, 0, "no text on the page"), "tree_json": ("chatgpt", 4, 2, None),
        "bytes_txt": ("txt-docx", 2, 0, None), "shot_png": ("screenshot", 2, 0, None), "what_bin": (None, 0, 0, "not recognised"), "messages_json": ("characterai", 1, 0, None),
    }
    by = {}
    for r in found.messages.orderBy("pos").collect():
        by.setdefault(r.source_id, []).append((r.role, r.text))
    assert by["word_docx"][0] == ("unlabeled", "Ada & co") and by["page_html"] == [("unlabeled", "Hi & bye"), ("unlabeled", "two")] and by["bundle_zip"] == [("user", "x")]
    assert {r.source_id: r.error for r in registry.convert_files(files.where("path like '%png'")).status.collect()} == {"shot_png": "pictures need a provider"}
    assert {r.adapter for r in registry.convert_files(files.where("source_id = 'what_bin'"), chosen="txt-docx").status.collect()} == {"txt-docx"}
    assert registry.convert_files(files.limit(0)).status.count() == 0
    result = run_from_source(files, with_distill=False)
    assert result.adapter is None and result.status.count() == 10 and ("unlabeled", "two") in [(r.role, r.text) for r in result.messages.collect()]


def test_files_are_read_once(spark):
    # rows are counted where the files are read; each kind is then read from what was written
    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            rows.add(len(b))
            yield b

    files = binaries(
        spark, word_docx=make_zip({"word/document.xml": WORD}), bundle_zip=make_zip({"message.json": json.dumps([{"raw_content": "x"}]), "character.json": "{}"}), damaged_zip=b"PK\x03\x04 no",
        page_html=b"<p>Hi</p>", tree_json=json.dumps(TREE).encode(), bytes_txt=CHAT.encode(), shot_png=b"\x89PNG\r\n\x1a\n0000", what_bin=b"nothing", lines_jsonl=b'{"mes":"x"}',
    )
    found = registry.convert_files(files.mapInPandas(count, files.schema), vision=Eyes)
    assert found.messages.count() > 9 and found.status.count() == 9 and rows.value == 9
    scans = found.messages._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scans


def test_what_sources_say_of_themselves(spark):
    page = b"<html><title> My chat </title><p>Hi</p><p>two</p></html>"
    messages = [{"raw_content": "x", "is_human": True}]
    whole = {"user": {"first_name": "Ada"}, "character": [{"name": "Bot"}], "messages": [*messages, {"raw_content": "y", "name": "Bot"}]}
    files = binaries(spark, page_html=page, bundle_zip=make_zip({"u/message.json": json.dumps(messages), "u/character.json": '{"name":"Bot"}', "u/user.json": '{"name":"Ada"}'}), one_cai=json.dumps(whole).encode(), tree_json=json.dumps(TREE).encode(), bytes_txt=CHAT.encode(), shot_png=b"\x89PNGxxxx")
    found = registry.convert_files(files.where("source_id <> 'one_cai'"), vision=Eyes)
    info = {r.source_id: json.loads(r.info) for r in found.status.collect()}
    assert info == {
        "page_html": {"mode": "lines", "title": "My chat", "blocks": 3}, "bundle_zip": {"user": "Ada", "character": "Bot"}, "tree_json": {"mode": "tree"},
        "bytes_txt": {"mode": "headers"}, "shot_png": {"mime_type": "image/png", "parse_mode": "json"},
    }
    one = registry.convert_files(files.where("source_id = 'one_cai'"), "characterai")  # a bundle in one JSON text
    assert [(r.role, r.text) for r in one.messages.orderBy("pos").collect()] == [("user", "x"), ("assistant", "y")]
    assert json.loads(one.status.first().info) == {"user": "Ada", "character": "Bot"}


def test_a_blank_picture_stops_nothing_else(spark):
    class Blind:
        def see(self, prompt, uri):
            return " " if uri.endswith("AAAA") else '[{"role":"user","text":"a"}]'

    files = binaries(spark, a_png=b"\x89PNG\0\0\0\0\0", b_png=b"\x89PNG\1\1\1\1\1", c_gif=b"GIF99xx", page_html=b"<p>Hi</p>")
    found = registry.convert_files(files, vision=Blind)
    assert {r.source_id: (r.messages, r.error) for r in found.status.collect()} == {"a_png": (0, "the provider returned nothing"), "b_png": (1, None), "c_gif": (1, None), "page_html": (1, None)}


def test_only_wanted_members_are_unpacked(spark):
    # the picture is damaged, and nobody looks
    data = bytearray(make_zip({"u/data/message.json": json.dumps([{"raw_content": "x"}]), "u/character.json": "{}", "u/picture.png": "A" * 5000}))
    at = data.index(b"u/picture.png") + len(b"u/picture.png")
    data[at : at + 8] = b"\xff" * 8
    found = registry.convert_files(binaries(spark, b_zip=bytes(data)))
    assert [(r.messages, r.error) for r in found.status.collect()] == [(1, None)]


def test_one_large_bundle_is_sorted_in_many_tasks(spark):
    from chatloom.functions.rows import ranked_positions

    rng = random.Random(3)
    stamps = [rng.randrange(1, 500) for _ in range(3000)]
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate(stamps)] + [("b", 1, None), (None, 2, 5), (None, 1, 7)], "source_id string, place long, ts long")
    got = ranked_positions(rows, "source_id", [F.col("ts"), F.col("place")])
    want = {p: k for k, p in enumerate(sorted(range(3000), key=lambda p: (stamps[p], p)))}
    assert {r.place: r._i for r in got.collect() if r.source_id == "a"} == want
    assert {(r.source_id, r.place): r._i for r in got.collect() if r.source_id != "a"} == {("b", 1): 0, (None, 2): 0, (None, 1): 1}
    messages = [{"raw_content": str(i), "is_human": True, "create_time": 1735689600 + s} for i, s in enumerate(stamps)]
    found = J.characterai(bundle(spark, messages))[0].orderBy("pos").collect()
    assert [int(r.text) for r in found] == sorted(range(3000), key=lambda p: (stamps[p], p)) and [r.pos for r in found] == list(range(3000))


def test_arriving_files(spark, tmp_path):
    from chatloom.streaming.arrivals import arriving_files, convert_arrivals, converted_arrivals

    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()

    def run():
        query = convert_arrivals(arriving_files(spark, str(inbox), most=1), out, str(tmp_path / "offsets"))
        query.awaitTermination()
        assert query.exception() is None

    (inbox / "a.html").write_bytes(b"<p>Hi</p><p>two</p>")
    (inbox / "b.jsonl").write_bytes(b'{"mes":"x","is_user":true}\nbroken')
    run()
    (inbox / "c.html").write_bytes(b"<p></p>")
    run()
    run()  # nothing new
    found = converted_arrivals(spark, out)
    assert sorted((r.role, r.text) for r in found.messages.collect()) == [("unlabeled", "Hi"), ("unlabeled", "two"), ("user", "x")]
    assert sorted((r.source_id.rpartition("/")[2], r.messages, r.skipped, r.error) for r in found.status.collect()) == [("a.html", 2, 0, None), ("b.jsonl", 1, 1, None), ("c.html", 0, 0, "no text on the page")]


def test_word_entities(spark):
    xml = "<w:p><w:t>a&nbsp;b &#abc; &#65;&#x42; &#99999999; &amp;lt;</w:t></w:p>"
    assert archives.paragraph_lines(xml) == ["a b &#abc; AB  &lt;"]
    broken = bytearray(make_zip({"word/document.xml": WORD * 50}))
    broken[60] ^= 0xFF
    with pytest.raises(archives.ArchiveError):
        list(archives.read_entries(bytes(broken)))


class Eyes:
    def __init__(self, reply='[{"role":"user","text":"a"},{"role":"x","text":"b"},{"role":"user","text":" "}]'):
        self.reply = reply

    def see(self, prompt, uri):
        assert uri.startswith("data:image/png;base64,")
        return self.reply


def test_screenshots(spark):
    shot = binaries(spark, p=b"\x89PNG\r\n\x1a\n0000")
    assert said(X.screenshots(shot, Eyes)) == [("user", "a", None), ("unlabeled", "b", None)]
    assert said(X.screenshots(shot, lambda: Eyes("[]"))) == [("unlabeled", "[]", None)]
    with pytest.raises(ValueError):
        X.screenshots(shot, None)
    with pytest.raises(Exception, match="nothing"):
        X.screenshots(shot, lambda: Eyes(" ")).collect()


def messages(spark, rows):
    return spark.createDataFrame([("a", i, r, t, ts, {"speaker": s}) for i, (ts, r, t, s) in enumerate(rows)], RAW)


ROWS = [(1749722400000, "user", 'hi "x"', None), (1749722460000, "assistant", "hello", "Nova"), (None, "system", "?", None), (1750500000000, "other", "later", None)]


def test_packs(spark, tmp_path):
    m = messages(spark, ROWS)
    full = [json.loads(r.line) for r in P.full_jsonl(m, "2026-01-01T00:00:00.000Z", "here").orderBy("pos").collect()]
    assert full[0]["stats"] == {"messageCount": 4, "timeSpan": {"start": "2025-06-12T10:00:00.000Z", "end": "2025-06-21T10:00:00.000Z"}, "byRole": {"assistant": 1, "other": 1, "system": 1, "user": 1}} and full[0]["source"] == "here"
    assert [(x["ts"], x["role"], x["text"]) for x in full[1:]] == [(a, b, c) for a, b, c, _ in ROWS] and full[2]["meta"] == {"speaker": "Nova"}
    plain = [json.loads(r.line) for r in P.messages_jsonl(m).orderBy("pos").collect()]
    assert plain[2] == {"ts": None, "role": "system", "content": "?"}
    body = [r.line for r in P.timeline(m, span=2).orderBy("pos", "part").collect()]
    assert body == ["## 2025-06-12", "", '- **10:00:00** 主人：hi "x"', "- **10:01:00** Nova：hello", "## 未知时间", "", "- **--:--** 系统：?", "## 2025-06-21", "", "- **10:00:00** （待标注）：later"]
    empty = P.full_jsonl(m.limit(0), "t", sources=docs(spark, "")).collect()
    assert len(empty) == 1 and json.loads(empty[0].line)["stats"]["messageCount"] == 0
    paths = P.write_pack(m, str(tmp_path), "t")
    assert [r.value for r in spark.read.text(paths[2]).select("value").collect()][0] == "# 记忆包"


@pytest.mark.parametrize("rows, n", [(10, 3), (3, 10), (7, 7), (100, 9)])
def test_even_sample(spark, rows, n):
    df = spark.range(rows).select(F.lit("a").alias("source_id"), (F.col("id") * 5).alias("pos"))
    want = range(rows) if rows <= n else [i * rows // n for i in range(n)]
    assert sorted(r.pos // 5 for r in P.even_sample(df, n).collect()) == sorted(set(want))


class Mock:
    name = "mock"

    def chat(self, system, user):
        if system == D.SUMMARY_PROMPT:
            return '{"summary": "s"}'
        if system == D.ANCHOR_PROMPT:
            return 'sure: {"anchors": [{"date": "2025-06-12", "event": "met"}, {"date": 3, "event": "bad"}, {"date": "d", "event": "e", "ts": 5, "importance": 4}]} ok'
        if system == D.REVIEW_PROMPT:
            return '{"hits": [{"index": 0, "text": "[gone]"}, {"index": 99, "text": "no"}, {"index": 1, "text": " "}]}'
        return '{"longTerm": [{"text": "a", "category": "identity"}, {"text": "b", "category": "no"}], "notebook": [{"text": "n", "score": "x"}, {"text": "m"}], "profile": [{"dimension": "habits", "key": "k", "value": "v"}, {"dimension": "moods", "key": "k", "value": "v"}]}'


def test_distill(spark):
    m = messages(spark, ROWS)
    got = D.distill(m, Mock)
    assert got.meta["llm_calls"] == 7 and got.summaries.count() == 3
    assert {(r.event, r.ts, r.importance) for r in got.anchors.collect()} == {("met", None, 3.0), ("e", 5, 4.0)}
    assert [r.text for r in got.long_term.collect()] == ["a"] and [r.text for r in got.notebook.collect()] == ["m"] and got.profile.count() == 1
    assert D.distill(m, None).skipped and D.distill(m, None).anchors.count() == 0


def test_transcripts_skip_what_does_not_fit(spark):
    m = messages(spark, [(None, "user", t, None) for t in ("aaaa", "b" * 50, "cc")])
    got = D.transcripts(m, 40).first()
    assert got.transcript == "[--:--] user: aaaa\n[--:--] user: cc\n（另有 1 条消息因长度上限未纳入转录）"


def test_providers():
    assert D.provider_from_env({}) is None
    found = D.provider_from_env({"OPENAI_API_KEY": "k", "DEEPSEEK_API_KEY": "d"})
    assert (found.name, found.model) == ("api.deepseek.com", "deepseek-chat")
    sent = {}

    def post(url, headers, body, timeout):
        sent.update(url=url, body=json.loads(body), auth=headers["Authorization"])
        return json.dumps({"choices": [{"message": {"content": "ok"}}]}).encode()

    assert D.HttpProvider("http://h/v1/", "k", "m", post=post).chat("s", "u") == "ok"
    assert sent["url"] == "http://h/v1/chat/completions" and sent["body"]["messages"][1] == {"role": "user", "content": "u"} and sent["auth"] == "Bearer k"


def test_pipeline_from_source_to_pack(spark, tmp_path):
    result = run_from_source(docs(spark, json.dumps(TREE)), output=str(tmp_path), created_at="t")
    assert result.adapter == "chatgpt" and result.degraded and result.distilled.reason == "no_provider" and len(result.files) == 3
    assert [(r.role, r.text) for r in result.messages.orderBy("pos").collect()] == [("user", "hi"), ("assistant", "old"), ("assistant", "new\ner"), ("unlabeled", "bye")]
    with pytest.raises(ValueError, match="name an adapter"):
        run_from_source(docs(spark, "nothing"))
    with pytest.raises(ValueError, match="no adapter"):
        run_from_source(docs(spark, "nothing"), adapter="nope")
    whole = run_pipeline(docs(spark, CHAT + "\nBot: 06-01 10:02 call 13812345678"), aliases={"Ada": "user", "Bot": "assistant"}, base_year=2025, provider=Mock, review=True, with_distill=False)
    assert [(r.role, r.text) for r in whole.messages.orderBy("pos").collect()] == [("user", "[gone]"), ("assistant", "hello"), ("assistant", "call [已脱敏:手机号]")]
    assert whole.distilled.reason == "disabled" and not whole.degraded and set(whole.pack()) == {"pack_jsonl", "messages_jsonl", "markdown", "stats"}


class Counted:
    """Writes a file for each call, since calls are made in Python workers."""

    name = "counted"

    def __init__(self, folder, reply):
        self.folder, self.reply = folder, reply

    def chat(self, system, user):
        open(f"{self.folder}/{uuid.uuid4()}", "w").close()
        return self.reply


@pytest.mark.parametrize("reply", ["{}", '{"hits": []}', '{"hits": {"index": 0}}', "no JSON", '{"hits": [{"index": 41, "text": "[gone]"}]}'])
def test_review_asks_once_a_batch(spark, tmp_path, reply):
    lines = spark.createDataFrame([("a", 1000 * i, f"user line number {i}") for i in range(90)], "source_id string, pos long, text string")
    calls, packs = tmp_path / "calls", tmp_path / "packs"
    calls.mkdir()
    result = run_pipeline(lines, provider=lambda: Counted(calls, reply), review=True, with_distill=False, output=str(packs))
    texts = [r.text for r in result.messages.orderBy("pos").collect()]
    assert texts == [f"user line number {i}" if i != 41 or "41" not in reply else "[gone]" for i in range(90)]
    assert result.stats.first().total == 90 and result.pack()["markdown"].count() > 90 and len(list(calls.iterdir())) == 3


def test_labels_and_pictures_are_asked_for_once(spark, tmp_path):
    found = structure_lines(docs(spark, "\n".join(f"line {i}" for i in range(130))), lambda: Counted(tmp_path, "[]"))
    assert found.count() == 0 and found.select("text").count() == 0 and len(list(tmp_path.iterdir())) == 3


def test_weeks_in_order(spark):
    weeks = D.in_week_order(D.week_batches(messages(spark, [(None, "user", "a", None), *ROWS, (1767225600000, "user", "b", None)])))
    assert [r.week for r in weeks.collect()] == ["2025-W24", "2025-W25", "2026-W01", "unknown"]


def test_weekly_counts_on_a_stream(spark, sf_dir, tmp_path):
    table = Q.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    table.write.parquet(str(tmp_path / "in"))
    stream = weekly_counts(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("weeks").collect())) == sorted(map(tuple, weekly_counts(table).collect()))


def test_a_bundle_in_an_archive_and_its_statistics(spark):
    data = make_zip({"u/data/message.json": json.dumps([{"raw_content": "x", "is_human": True}, {"raw_content": " "}])})
    found, skipped = J.characterai(archives.text_entries(binaries(spark, b_zip=data)))
    stats = source_stats(found, skipped).first()
    assert (stats.total, stats.by_role, stats.pending_label, stats.skipped) == (1, {"user": 1}, 0, 1)
    chosen = registry.sniffed_or(registry.sniff_texts(docs(spark, "plain", "<p>")), "txt-docx")
    assert {r.source_id: r.name for r in chosen.collect()} == {"s0": "txt-docx", "s1": "local-web"}


def test_nothing_is_left_of_what_was_temporary(spark, tmp_path, monkeypatch):
    import chatloom.storage as storage

    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    with storage.temporary(spark):
        found = registry.convert_files(binaries(spark, page_html=b"<p>Hi</p>", tree_json=json.dumps(TREE).encode()))
        found.messages.write.parquet(str(tmp_path / "kept"))
        assert len(list((tmp_path / "shared").iterdir())) > 3
    assert list((tmp_path / "shared").iterdir()) == [] and spark.read.parquet(str(tmp_path / "kept")).count() == 5


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\ufeffone\ntwo")
    assert registry.read_texts(spark, str(tmp_path)).first().text == "one\ntwo"
    assert bytes(registry.read_binaries(spark, str(tmp_path)).first().content).endswith(b"two")


def test_a_picture_goes_into_the_message():
    def post(url, headers, body, timeout):
        assert timeout == 90 and json.loads(body)["messages"][1]["content"][0]["image_url"]["url"] == "data:x"
        return b'{"choices":[{"message":{"content":"[]"}}]}'

    assert D.HttpVisionProvider("http://h", "k", "m", post=post).see("p", "data:x") == "[]"


def test_the_public_names():
    import chatloom

    assert all(getattr(chatloom, name) for name in chatloom.__all__)
    with pytest.raises(AttributeError):
        chatloom.nothing
