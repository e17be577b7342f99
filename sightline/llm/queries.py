"""Import every operator, so that its query is registered."""

from __future__ import annotations

import importlib

from sightline.llm.registry import ORACLES, QUERIES

OPERATORS = ("exact_dedup", "simhash", "bpe", "token_files", "quality", "line_dedup", "decontaminate", "secrets", "toxicity", "language", "chat_format", "ranked_search", "prefix_trie")


def load() -> tuple[dict, dict]:
    for name in OPERATORS:
        importlib.import_module(f"sightline.llm.{name}")
    return QUERIES, ORACLES
