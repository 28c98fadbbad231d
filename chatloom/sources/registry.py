"""The adapters by name, recognising which one a source needs, and converting with it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.functions.jsonx import strict_json
from chatloom.schemas import META, RAW
from chatloom.sources import archives, json_exports, texts
from chatloom.sources.texts import boundary_count, header_mode, image_type
from chatloom.storage import broadcast_if_small, new_folder, written


class NotSupportedYet(NotImplementedError):
    """An adapter that has a name and a contract only."""


@dataclass(frozen=True)
class Adapter:
    """``convert`` takes the form of input that ``takes`` names and gives raw messages.

    text: (source_id, text); files: (source_id, name, text); binary: (source_id, path, content).
    """

    name: str
    label: str
    description: str
    takes: str
    convert: Callable[..., DataFrame]
    status: str = "ready"


def _placeholder(*_, **__) -> DataFrame:
    raise NotSupportedYet("qq-export")


ADAPTERS = {
    a.name: a
    for a in (
        Adapter("chatgpt", "ChatGPT", "message trees in JSON", "text", lambda d, **o: json_exports.chatgpt(d, **o)[0]),
        Adapter("claude", "Claude", "flat conversations in JSON", "text", lambda d, **o: json_exports.claude(d, **o)[0]),
        Adapter("characterai", "Character.AI", "bundles of three JSON files", "files", lambda d, **o: json_exports.characterai(d, **o)[0]),
        Adapter("st-chatlog", "SillyTavern", "JSON Lines", "text", lambda d, **o: json_exports.sillytavern(d, **o)[0]),
        Adapter("txt-docx", "Text or Word", "texts with or without headers", "text", lambda d, **o: texts.chat_text(d, **o)),
        Adapter("local-web", "Web page", "saved pages", "text", lambda d, **o: texts.pages(d, **o)),
        Adapter("screenshot", "Screenshot", "pictures, through a provider", "binary", lambda d, **o: texts.screenshots(d, **o)),
        Adapter("qq-export", "QQ", "not there yet", "text", _placeholder, "placeholder"),
    )
}


def get_adapter(name: str) -> Adapter | None:
    return ADAPTERS.get(name)


def list_adapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a.name, a.label, a.description, a.status) for a in ADAPTERS.values()], "name string, label string, description string, status string")


def convert(adapter: str | Adapter, source: DataFrame, **options) -> DataFrame:
    """Raw messages of a source by an adapter or its name."""
    found = adapter if isinstance(adapter, Adapter) else ADAPTERS.get(adapter)
    if found is None:
        raise ValueError(f"no adapter {adapter!r}; there are: {', '.join(ADAPTERS)}")
    return found.convert(source, **options)


def sniff_text(text: Column) -> Column:
    """The adapter a text needs and how sure that is, as a struct (name, confidence), or null. JSON with anything behind it is
    not JSON."""
    has = lambda json, *names: F.coalesce(F.arrays_overlap(F.json_object_keys(json), F.array(*map(F.lit, names))), F.lit(False))
    sure = lambda name: F.struct(F.lit(name).alias("name"), F.lit("high").alias("confidence"))

    def named(t: Column) -> Column:
        rows = F.transform(T.lines(t), strict_json)
        is_message = lambda v: has(v, "mes") & has(v, "is_user", "is_system")
        jsonl = lambda r: F.exists(r, is_message) & F.forall(r, lambda v: is_message(v) | has(v, "user_name", "character_name"))
        return (
            F.when(t.startswith("<"), sure("local-web"))
            .when(t.startswith("{") & T.let(rows, jsonl), sure("st-chatlog"))
            .when(t.startswith("{") | t.startswith("["), T.let(strict_json(t), of_json))
        )

    def of_json(j: Column) -> Column:
        wrapped = F.from_json(j, "struct<conversations: array<string>>")["conversations"]
        items = F.when(j.startswith("["), F.from_json(j, "array<string>")).otherwise(wrapped)

        def kind(held: Column) -> Column:
            any_has = lambda name: F.coalesce(F.exists(held, lambda x: has(x, name)), F.lit(False))
            in_src = F.coalesce(F.exists(held, lambda x: has(F.get_json_object(x, "$.src"), "raw_content")), F.lit(False))
            alone = lambda name: held.isNull() & has(j, name)
            return (
                F.when(any_has("mapping") | alone("mapping"), sure("chatgpt"))
                .when(any_has("chat_messages") | alone("chat_messages"), sure("claude"))
                .when(any_has("raw_content") | in_src, sure("characterai"))
            )

        return T.let(items, kind)

    low = lambda t: F.when(boundary_count(t) >= 2, F.struct(F.lit("txt-docx").alias("name"), F.lit("low").alias("confidence")))
    return T.let(T.trim(T.without_bom(F.coalesce(text, F.lit("")))), lambda t: F.coalesce(named(t), low(t)))


def sniff_texts(docs: DataFrame) -> DataFrame:
    """(source_id, name, confidence) for texts; both null where nothing fits."""
    return docs.select("source_id", sniff_text(F.col("text")).alias("s")).select("source_id", "s.name", "s.confidence")


#: Adapters by file extension; other extensions are told by content.
EXTENSIONS = {"docx": "txt-docx", "html": "local-web", "htm": "local-web", "jsonl": "st-chatlog", **{e: "screenshot" for e in texts.IMAGE_EXTENSIONS}}


def sniff_files(files: DataFrame) -> DataFrame:
    """(source_id, name, confidence, error) for files (source_id, path, content): by extension, archive entries, picture, or
    text. Of an archive only the names are read; one that is damaged has no name but an error. Malformed UTF-8 is replaced."""
    return _sniffed(files).select("source_id", "name", "confidence", "error")


def _sniffed(files: DataFrame) -> DataFrame:
    """The files with name, confidence and error, in one pass."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)\z", 1))
    by_ext = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        by_ext = F.when(ext == e, F.lit(name)).otherwise(by_ext)
    zipped, image = archives.is_archive("content"), image_type(F.col("content"))
    rows = files.withColumn("_zip", archives.archive_names(F.when(zipped & by_ext.isNull(), F.col("content"))))
    has = lambda n: F.coalesce(F.exists("_zip.names", lambda x: F.regexp_extract(F.replace(x, F.lit("\\"), F.lit("/")), r"([^/]*)\z", 1) == n), F.lit(False))
    in_zip = F.when(has("document.xml"), "txt-docx").when(has("message.json") & has("character.json"), "characterai")
    text = F.when(by_ext.isNull() & ~zipped & image.isNull(), T.decoded(F.col("content")))
    rows = rows.withColumns({"_known": F.coalesce(by_ext, in_zip, F.when(image.isNotNull(), "screenshot")), "_s": sniff_text(text)})
    told = {"name": F.coalesce("_known", "_s.name"), "confidence": F.when(F.col("_known").isNotNull(), "high").otherwise(F.col("_s.confidence")), "error": F.col("_zip.error")}
    return rows.select(*files.columns, *(x.alias(c) for c, x in told.items()))


def sniff_bundles(files: DataFrame) -> DataFrame:
    """(source_id, name, confidence) for bundles of named files: one with a message or character file is known."""
    file = F.lower(F.regexp_extract(F.replace("name", F.lit("\\"), F.lit("/")), r"([^/]*)\z", 1))
    known = files.groupBy("source_id").agg(F.bool_or(file.isin("message.json", "character.json")).alias("k"))
    return known.select("source_id", F.when(F.col("k"), "characterai").alias("name"), F.when(F.col("k"), "high").alias("confidence"))


def sniffed_or(sniffed: DataFrame, chosen: str) -> DataFrame:
    """(source_id, name): what was recognised, else what the caller chose."""
    return sniffed.select("source_id", F.coalesce("name", F.lit(chosen)).alias("name"))


@dataclass(frozen=True)
class Converted:
    """Raw messages of sources of any kinds, and what became of each source: (source_id, adapter, confidence, messages,
    skipped, error, info: what the source says of itself, as JSON text)."""

    messages: DataFrame
    status: DataFrame


#: What an adapter that found nothing says.
NOTHING = {"chatgpt": "no conversation with a mapping", "claude": "no conversation with chat_messages", "characterai": "no messages", "st-chatlog": "no message line", "txt-docx": "no text", "local-web": "no text on the page", "screenshot": "no picture"}
_FOUND = "source_id string, place bigint, kept boolean, role string, text string, ts_ms bigint, meta " + META + ", info string, error string"


def _told_of(name: str, rows: DataFrame, own: dict, provider, vision, ledger: str | None) -> DataFrame:
    """What an adapter finds in its files (source_id, content), in one pass over them: told rows, with an error where one
    cannot be read."""
    zipped = archives.is_archive("content")
    none = F.lit(None)
    found_error = lambda df: df.select("source_id", none.alias("place"), F.lit(False).alias("kept"), *(none.alias(c) for c in ("role", "text", "ts_ms", "meta", "info")), "error")
    placed = lambda df, info: df.select("source_id", F.col("pos").alias("place"), F.lit(True).alias("kept"), "role", "text", "ts_ms", "meta", info.alias("info"), none.alias("error"))
    texts_of = rows.select("source_id", T.decoded(F.col("content")).alias("text"))
    if name == "screenshot":
        if vision is None:
            return found_error(rows.select("source_id", F.lit("pictures need a provider").alias("error")))
        seen = texts.seen_pictures(rows, vision, ledger)
        info = F.to_json(F.struct(F.col("meta.mime_type").alias("mime_type"), F.when(F.col("meta.pending_label"), "fallback").otherwise("json").alias("parse_mode")))
        return placed(texts.picture_messages(seen.where("error is null")), info).unionByName(found_error(seen.where("error is not null")))
    if name in ("txt-docx", "local-web"):
        if name == "local-web":
            words = texts.page_texts(texts_of).where("text <> ''").withColumn("error", none.cast("string"))
        else:
            read = rows.select("source_id", archives.word_text(F.when(zipped, F.col("content"))).alias("w"), F.when(~zipped, T.decoded(F.col("content"))).alias("t"))
            words = read.select("source_id", F.coalesce("w.text", "t").alias("text"), F.col("w.error").alias("error"))
        words = written(words.withColumn("_headed", F.coalesce(header_mode(F.coalesce("text", F.lit("")), mode=own.get("mode")), F.lit(False))))
        said = texts.chat_text(words.where("error is null"), **({"provider": provider, "ledger": ledger} | own if name == "txt-docx" else own))
        own_info = {"mode": F.when(F.col("_headed"), "headers").otherwise("lines"), **({c: F.col(c) for c in ("title", "blocks")} if name == "local-web" else {})}
        info = broadcast_if_small(written(words.select(F.col("source_id").alias("_w"), F.to_json(F.struct(*(x.alias(c) for c, x in own_info.items()))).alias("_info"))), F.length("_w") + F.length("_info") + 16)
        return placed(said.join(info, F.col("source_id") == F.col("_w"), "left"), F.col("_info")).unionByName(found_error(words.where("error is not null")))
    if name == "characterai":
        wanted = {f"{x}{end}" for names in json_exports.BUNDLE.values() for x in names for end in ("", ".json")}
        files = written(archives.bundle_texts(rows, lambda n: archives.base_name(n).lower() in wanted))
        told = json_exports.bundle_told(files.where("error is null"), need_messages=False).withColumn("error", none)
        return told.unionByName(found_error(files.where("error is not null")))
    if name == "st-chatlog":
        told = json_exports.line_told(json_exports.lines_of(texts_of))
    elif name == "chatgpt":
        told = json_exports.tree_told(json_exports.conversations(texts_of, "mapping", "{"), **own)
    else:
        told = json_exports.flat_told(json_exports.conversations(texts_of, "chat_messages", "["))
    return told.withColumn("error", none)


def convert_files(files: DataFrame, adapter: str | None = None, chosen: str | None = None, options: Mapping[str, Mapping] | None = None, provider=None, vision=None, ledger: str | None = None) -> Converted:
    """Files (source_id, path, content) of any kinds, each through the adapter that it is recognised as needing.

    ``adapter`` names one for all; ``chosen`` stands in where none is recognised; ``options`` are each adapter's own, by name;
    ``provider`` labels plain lines, and pictures need ``vision``, a provider that takes them. A source that is damaged, not
    recognised or empty, or a picture of which the provider says nothing, has no messages, and the status table says why.

    ``ledger`` is a folder that keeps providers' replies for later runs.

    The files are read once, and written by kind as they are recognised; each adapter reads its own kind once, and writes
    messages and what it skipped together. All else reads what was written.
    """
    if adapter and adapter not in ADAPTERS:
        raise ValueError(f"no adapter {adapter!r}; there are: {', '.join(ADAPTERS)}")
    if adapter and ADAPTERS[adapter].status != "ready":
        _placeholder()
    spark, nothing = files.sparkSession, F.lit(None).cast("string")
    files = files.select("source_id", "path", "content")
    if adapter:
        sniffed = files.select("*", F.lit(adapter).alias("name"), nothing.alias("confidence"), nothing.alias("error"))
    else:
        sniffed = _sniffed(files)
        sniffed = sniffed.withColumn("name", F.when(F.col("error").isNull(), F.coalesce("name", F.lit(chosen)))) if chosen else sniffed
    folder = new_folder(spark, "kinds")
    kept = F.when(F.col("name").isNotNull(), F.col("content"))
    sniffed.select("source_id", "path", kept.alias("content"), "confidence", "error", F.coalesce("name", F.lit("-")).alias("kind")).write.partitionBy("kind").parquet(folder)
    routed = spark.read.schema("source_id string, path string, content binary, confidence string, error string, kind string").parquet(folder)
    kinds = sorted(r.kind for r in routed.select("kind").distinct().collect() if r.kind in ADAPTERS)  # at most as many as there are adapters
    empty = spark.createDataFrame([], _FOUND)
    told = {k: written(empty.unionByName(_told_of(k, routed.where(F.col("kind") == k), dict((options or {}).get(k, {})), provider, vision, ledger))) for k in kinds}
    union = lambda dfs, schema: reduce(DataFrame.unionByName, dfs) if dfs else spark.createDataFrame([], schema)
    dense = {"characterai": json_exports.numbered_by_time, **dict.fromkeys(("chatgpt", "claude", "st-chatlog"), json_exports.numbered)}
    as_placed = lambda t: t.where("kept").select("source_id", F.col("place").alias("pos"), "role", "text", "ts_ms", "meta")
    messages = union([dense.get(k, as_placed)(t) for k, t in told.items()], RAW)
    seen = union(list(told.values()), _FOUND).groupBy("source_id").agg(
        F.count_if("kept").alias("messages"), F.count_if(~F.col("kept") & F.col("error").isNull()).alias("skipped"), F.max("error").alias("said"), F.max("info").alias("info")
    )
    none = nothing
    for name, text in NOTHING.items():
        none = F.when(F.col("kind") == name, text).otherwise(none)
    status = routed.select("source_id", "kind", "confidence", "error").join(seen, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    why = F.coalesce("error", "said", F.when(F.col("kind") == "-", "not recognised").when(F.coalesce("messages", F.lit(0)) == 0, none))
    return Converted(messages, written(status.select("source_id", F.nullif("kind", F.lit("-")).alias("adapter"), "confidence", zero("messages"), zero("skipped"), why.alias("error"), "info")))


def as_files(source: DataFrame) -> DataFrame:
    """Texts (source_id, text) as files."""
    return source.select("source_id", F.lit("").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Files as (source_id, path, text), one row each."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), T.without_bom(F.col("value")).alias("text"))
    return rows.select(F.col("path").alias("source_id"), "path", "text")


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """Files as (source_id, path, content), one row each."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_id"), "path", "content")

