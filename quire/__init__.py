"""Spark-native document chunking, coverage analytics and corpus preparation."""

import importlib

__version__ = "0.1.0"
# public names, taken from their modules when asked for, so that workers load no more than they need
_NAMES = {
    "build_outline": ("quire.operators.outline", "outline_nodes"), "load_chunks": ("quire.sources.documents", "scan_chunks"), "process_documents": ("quire.cli", "process_documents"),
    "process_pdf": ("quire.cli", "process_pdf"), "render_outline_markdown": ("quire.operators.outline", "outline_markdown"),
}
__all__ = list(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(f"module 'quire' has no attribute {name!r}")
    module, found = _NAMES[name]
    return getattr(importlib.import_module(module), found)
