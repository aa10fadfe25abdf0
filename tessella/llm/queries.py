"""The registered queries of this subpackage and their SQL."""

from . import chat_format, decontaminate, exact_dedup, language_id, lm_score, near_dedup, packing, sharding, suffix_dedup, toxicity

_MODULES = (suffix_dedup, exact_dedup, near_dedup, lm_score, chat_format, decontaminate, sharding, toxicity, language_id, packing)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
