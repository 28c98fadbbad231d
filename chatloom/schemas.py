"""The tables that operators pass on, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is known about a message besides its text; ``extra`` holds keys of the source's own as JSON text.
META_FIELDS = {
    "source": "string", "speaker": "string", "raw_time": "string", "original_role": "string", "conversation_title": "string", "conversation_index": "int",
    "conversation_name": "string", "sender": "string", "mime_type": "string", "pending_label": "boolean", "llm_role_label": "boolean", "role_matched": "string",
    "line_batch": "int", "extra": "string",
}
META = "struct<" + ", ".join(f"{k}: {v}" for k, v in META_FIELDS.items()) + ">"
RAW = f"source_id string, pos bigint, role string, text string, ts_ms bigint, meta {META}"
ROLES = ("user", "assistant", "system", "unlabeled")


def camel(name: str) -> str:
    """A field's name in camel case, as JSON has it."""
    first, *rest = name.split("_")
    return first + "".join(p.title() for p in rest)


def meta(**known: Column) -> Column:
    """The meta struct with these fields, the others null."""
    return F.struct(*(known.get(k, F.lit(None)).cast(t).alias(k) for k, t in META_FIELDS.items()))


def meta_with(old: Column, **changed: Column) -> Column:
    """A meta struct with some fields changed."""
    return F.struct(*(changed.get(k, old[k]).cast(t).alias(k) for k, t in META_FIELDS.items()))
