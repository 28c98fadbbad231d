"""chatloom: chat-history cleaning, structuring and export as Spark DataFrame jobs.

The names below are the public interface. They are loaded when they are first used, so that Python workers, which import
single modules, load no more than they need.
"""

from importlib import import_module

_WHERE = {
    "chatloom.operators.clean": ("CleanConfig", "clean", "load_config"),
    "chatloom.operators.distill": ("distill", "provider_from_env"),
    "chatloom.operators.pack": ("full_jsonl", "markdown", "messages_jsonl", "pack_stats", "write_pack"),
    "chatloom.operators.structure": ("structure_lines", "structure_raw", "structure_segments"),
    "chatloom.plans.pipeline": ("Result", "run_from_source", "run_pipeline"),
    "chatloom.sources.registry": ("ADAPTERS", "convert", "get_adapter", "list_adapters", "read_binaries", "read_texts", "convert_files", "sniff_bundles", "sniff_files", "sniff_texts"),
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name in _MODULE:
        return getattr(import_module(_MODULE[name]), name)
    raise AttributeError(name)
