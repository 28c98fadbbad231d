"""From a source to a pack: clean, structure, distill, export. Messages are written once; all else reads them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import distill as D
from chatloom.operators import pack
from chatloom.operators.clean import CleanConfig, Cleaned, clean, split_lines, split_text
from chatloom.operators.structure import raw_messages, structure_segments, structure_stats
from chatloom.sources import json_exports
from chatloom.sources.registry import ADAPTERS, as_files, convert_files
from chatloom.storage import written


@dataclass(frozen=True)
class Result:
    cleaned: Cleaned
    messages: DataFrame
    stats: DataFrame
    distilled: D.Distilled
    degraded: bool
    reasons: tuple[str, ...]
    created_at: str
    source: str | None = None
    adapter: str | None = None
    raw: DataFrame | None = None
    status: DataFrame | None = None
    files: list[str] = field(default_factory=list)

    def pack(self) -> dict[str, DataFrame]:
        """The three forms of the pack, and its statistics."""
        return {
            "pack_jsonl": pack.full_jsonl(self.messages, self.created_at, self.source),
            "messages_jsonl": pack.messages_jsonl(self.messages),
            "markdown": pack.markdown(self.messages, self.created_at, source=self.source),
            "stats": pack.pack_stats(self.messages),
        }


def segments_of(source: DataFrame, config: CleanConfig) -> DataFrame:
    """Segments of raw messages (trimmed, without blank ones), of lines (source_id, pos, text), or of whole texts (source_id,
    text)."""
    if "role" in source.columns:
        rows = raw_messages(source).withColumn("text", T.trim(F.coalesce("text", F.lit("")))).where(F.col("text") != "")
        return rows.select("source_id", "pos", F.lit(None).cast("string").alias("header"), "text", F.lit(True).alias("has_ref"), "role", "ts_ms", "meta")
    return split_lines(source, config) if "pos" in source.columns else split_text(source, config)


def run_pipeline(
    source: DataFrame,
    config: CleanConfig = CleanConfig(),
    provider: Callable[[], D.Provider] | None = None,
    aliases: Mapping[str, str] | None = None,
    base_year: int | None = None,
    review: bool = False,
    with_distill: bool = True,
    created_at: str = "1970-01-01T00:00:00.000Z",
    output: str | None = None,
    prefix: str = "pack",
    ledger: str | None = None,
) -> Result:
    """Clean, structure, distill and pack a source; without a provider the steps that need one are left out, and said so.
    ``ledger`` is a folder that keeps the provider's replies: a run after one that failed asks only for the rest."""
    cleaned = clean(segments_of(source, config), config).written()
    segments = D.review_redaction(cleaned.segments, provider, ledger) if review and provider else cleaned.segments
    messages = written(structure_segments(segments, aliases, base_year=base_year))
    reasons = () if provider else ("no_provider",)
    distilled = D.distill(messages, provider, ledger=ledger) if with_distill else D.skipped(messages, "disabled")
    whole = "plaintext" if "pos" not in source.columns else None
    files = pack.write_pack(messages, output, created_at, prefix, whole) if output else []
    return Result(cleaned, messages, structure_stats(messages), distilled, provider is None, reasons, created_at, whole, files=files)


def run_from_source(source: DataFrame, adapter: str | None = None, adapter_options: Mapping | None = None, provider: Callable[[], D.Provider] | None = None, vision: Callable[[], object] | None = None, chosen: str | None = None, **options) -> Result:
    """Convert sources of any kinds, each by the adapter it is recognised as needing, and run the pipeline on their messages.

    ``source``: files (source_id, path, content), texts (source_id, text), or the named texts of bundles (source_id, name,
    text). ``adapter`` names one for all, with ``adapter_options``; else these are by adapter name. ``chosen`` stands in where
    none is recognised. ``Result.status`` says what became of each source; if none at all is recognised that is an error.
    ``vision`` is a provider for pictures.
    """
    if "name" in source.columns and "content" not in source.columns:
        raw, skipped = json_exports.characterai(source)
        counts = raw.groupBy("source_id").agg(F.count(F.lit(1)).alias("messages")).join(skipped, "source_id", "full")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
        kind = "characterai"
        status = counts.select("source_id", F.lit(kind).alias("adapter"), F.lit("high").alias("confidence"), zero("messages"), zero("skipped"), F.lit(None).cast("string").alias("error"))
    else:
        files = source if "content" in source.columns else as_files(source)
        by_name = {adapter: adapter_options or {}} if adapter else adapter_options
        found = convert_files(files, adapter, chosen, by_name, provider, vision, options.get("ledger"))
        raw, status = found.messages, found.status
        kinds = sorted(r.adapter for r in status.where("adapter is not null").select("adapter").distinct().collect())
        if not kinds:
            raise ValueError(f"name an adapter (there are: {', '.join(ADAPTERS)}): no source was recognised")
        kind = kinds[0] if len(kinds) == 1 else None
    result = run_pipeline(raw, provider=provider, **options)
    return Result(**{**{f: getattr(result, f) for f in result.__dataclass_fields__}, "adapter": kind, "raw": raw, "status": status})
