"""The queries of this package and their SQL, for the driver contract."""

from __future__ import annotations

import importlib

_MODULES = (
    "langid",
    "secrets",
    "tokenfile",
    "jaccard",
    "kneser_ney",
    "decontaminate",
    "neighbours",
    "fixity",
    "packing",
    "toxicity",
)

QUERIES: dict = {}
ORACLE: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(getattr(_module, "ORACLE", {}))
