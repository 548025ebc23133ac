"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from wavecrate.llm import collocations, exact_dedup, fill_in_middle, language, licenses, mixing, near_dedup, neighbours, pieces, private_data, sstable, suffix_dedup, toxicity

MODULES = (exact_dedup, mixing, pieces, sstable, language, toxicity, licenses, neighbours, near_dedup, suffix_dedup, fill_in_middle, private_data, collocations)


def _gathered(attribute: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(module, attribute, {})
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLE")
