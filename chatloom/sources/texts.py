"""Texts, Word documents, saved pages and screenshots as raw messages."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from chatloom.functions import text as T
from chatloom.functions.jsonx import extract_json
from chatloom.operators.clean import BOUNDARY, CleanConfig, headed_pieces, java_regex, split_text
from chatloom.operators.ledger import answered
from chatloom.operators.structure import normal_role, structure_lines, structure_segments
from chatloom.schemas import meta
from chatloom.storage import written

#: Fixed value: the least part of lines with a header at which a text is read by headers.
HEADER_RATIO = 0.2


def boundary_count(text: Column) -> Column:
    return T.let(headed_pieces(text), lambda p: F.when(p.isNotNull(), F.size(p) - 1).otherwise(F.regexp_count(text, F.lit(java_regex(BOUNDARY)))))


def header_mode(text: Column, ratio: float = HEADER_RATIO, mode: str | None = None) -> Column:
    """Whether a text is read by its headers: two or more that are a fifth of its lines, or one in a text of one line."""
    if mode:
        return F.lit(mode == "headers")
    hits, lines = boundary_count(text), F.size(T.lines(text))
    return ((hits >= 2) & (hits / F.greatest(lines, F.lit(1)) >= ratio)) | ((hits == 1) & (lines == 1))


def chat_text(docs: DataFrame, aliases: Mapping[str, str] | None = None, base_year: int | None = None, provider=None, mode: str | None = None, source: str = "txt-docx", ledger: str | None = None) -> DataFrame:
    """Texts (source_id, text) as messages: by their headers, or line by line with roles unknown."""
    rows = docs.select("source_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("_headed") if "_headed" in docs.columns else header_mode(F.col("text"), mode=mode)).alias("_headed"))
    segments = split_text(rows.where("_headed"), CleanConfig(strip_control_chars=False)).where(F.col("text") != "")
    headed = structure_segments(segments, aliases, base_year=base_year)
    plain = structure_lines(rows.where("not _headed"), provider, ledger)
    return headed.unionByName(plain).select("source_id", "pos", "role", "text", "ts_ms", "meta")


def pages(docs: DataFrame, **options) -> DataFrame:
    """Saved pages (source_id, text) as messages, from their text blocks."""
    blocks = page_texts(docs)
    return chat_text(blocks.where(F.col("text") != ""), **options)


def page_texts(docs: DataFrame) -> DataFrame:
    """(source_id, title, blocks: their number, text: their lines) of saved pages."""
    html = F.coalesce("text", F.lit(""))
    found = docs.select("source_id", F.nullif(T.html_title(html), F.lit("")).alias("title"), T.html_blocks(html).alias("b"))
    return found.select("source_id", "title", F.size("b").alias("blocks"), F.array_join("b", "\n").alias("text"))


#: The first bytes of images and the types by file extension.
IMAGE_MAGIC = {"89504E47": "image/png", "FFD8FF": "image/jpeg", "474946": "image/gif"}
IMAGE_EXTENSIONS = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def image_type(content: Column) -> Column:
    """The type of an image by its first bytes, or null."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for magic, mime in IMAGE_MAGIC.items():
        out = F.when(head.startswith(magic), F.lit(mime)).otherwise(out)
    return out


def type_of_path(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for ext, mime in IMAGE_EXTENSIONS.items():
        out = F.when(F.lower(path).endswith("." + ext), F.lit(mime)).otherwise(out)
    return out


SEE_PROMPT = 'Transcribe the chat in this picture, from top to bottom, as a JSON array of {"role": "user" | "assistant" | "system", "text": "..."}. JSON only.'


def screenshots(files: DataFrame, provider: Callable[[], object] | None) -> DataFrame:
    """Pictures (source_id, path, content) as messages, through a provider with ``see(prompt, data_uri)``.

    A reply without a JSON array of texts becomes one message whose role is pending; a blank reply, or a call that fails,
    stops the query. The provider is called when this is called.
    """
    seen = seen_pictures(files, provider)
    blank = F.raise_error(F.concat("source_id", F.lit(": "), "error")).cast("boolean")
    return picture_messages(seen.where(F.when(F.col("error").isNotNull(), blank).otherwise(True)))


@F.pandas_udf(ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType()), StructField("raw", BooleanType())])))
def _pictured(replies: pd.Series) -> pd.Series:
    """The messages of a reply, or the whole reply as one."""

    def one(reply: str | None) -> list[dict] | None:
        if reply is None:
            return None
        found = extract_json(reply)
        good = [x for x in found if isinstance(x, dict) and isinstance(x.get("text"), str) and x["text"].strip()] if isinstance(found, list) else []
        return [{"role": x["role"] if isinstance(x.get("role"), str) else None, "text": x["text"].strip(), "raw": False} for x in good] or [{"role": None, "text": reply.strip(), "raw": True}]

    return replies.map(one)


def seen_pictures(files: DataFrame, provider: Callable[[], object] | None, ledger: str | None = None) -> DataFrame:
    """What the provider saw in each picture, written: (source_id, mime, pos, role, text, raw, error); of one on which it
    returned nothing, or failed, a row with the error. With a ``ledger`` folder only pictures without a reply there are sent."""
    if provider is None:
        raise ValueError("screenshots need a provider that takes pictures")
    mime = F.coalesce(image_type(F.col("content")), type_of_path(F.col("path")), F.lit("image/png"))
    uri = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.coalesce(F.base64("content"), F.lit("")))
    told = answered(files.select("source_id", mime.alias("mime"), F.lit(SEE_PROMPT).alias("system"), uri.alias("user")), provider, ledger, method="see")
    blank = F.trim(F.coalesce("reply", F.lit(""))) == ""
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(blank, "the provider returned nothing")
    rows = told.select("source_id", "mime", error.alias("error"), _pictured(F.when(~blank, F.col("reply"))).alias("found"))
    return written(rows.select("source_id", "mime", "error", F.posexplode_outer("found").alias("pos", "x")).select("source_id", "mime", F.coalesce(F.col("pos"), F.lit(0)).cast("long").alias("pos"), "x.role", "x.text", "x.raw", "error"))


def picture_messages(seen: DataFrame) -> DataFrame:
    role = F.coalesce(normal_role(F.col("role")), F.lit("unlabeled"))
    known = meta(source=F.lit("screenshot"), mime_type=F.col("mime"), llm_role_label=F.when(~F.col("raw"), True), pending_label=F.when(F.col("raw"), True))
    return seen.select("source_id", "pos", role.alias("role"), "text", F.lit(None).cast("bigint").alias("ts_ms"), known.alias("meta"))
