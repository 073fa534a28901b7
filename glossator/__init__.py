"""Annotated-corpus analytics expressed as PySpark DataFrame plans."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

#: Public names and the modules that have them; a module is imported when one of its names is first used.
_WHERE = {
    "Config": "plans.config", "config_of": "plans.config", "load_config": ("plans.config", "load"), "generate": ("plans.generate", "generate"), "demo_config": ("plans.generate", "demo"),
    "write_corpus": ("plans.corpus", "write"), "generate_corpus": ("plans.corpus", "generated"), "load_corpus": ("plans.corpus", "load"), "validate_corpus": ("plans.corpus", "validate"), "audit_corpus": "plans.corpus",
    "reproduce": "plans.corpus", "export_corpus": "plans.corpus", "import_marked": "plans.corpus", "InvalidCorpus": "plans.corpus", "audit": ("plans.audit", "audit"), "audit_external": "plans.audit", "render_audit": ("plans.audit", "render"),
    "read_external": "sources.external", "read_records": "sources.external", "read_predictions": "sources.external", "read_marked": "sources.external", "score": "operators.scoring", "render_score": ("operators.scoring", "render"),
    "near_pairs": "operators.similarity", "probe": ("operators.probe", "probe"), "violations": "operators.validation", "register_value": "plans.generate", "register_family": "plans.generate", "register_shape": "functions.text",
    "register_realistic": "functions.text", "register_verifier": "functions.safety", "clean": "sources.intermediate",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__} has no attribute {name}")
    found = _WHERE[name]
    module, own = (found, name) if isinstance(found, str) else found
    return getattr(importlib.import_module(f"{__name__}.{module}"), own)
