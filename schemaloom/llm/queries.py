"""The operator queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

from schemaloom.llm import byte_bpe, chat_format, embedding_dedup, html_extract, license_scan, packing, quality_rules, simhash_dedup, substring_dedup, toxicity

MODULES = (license_scan, chat_format, embedding_dedup, byte_bpe, html_extract, toxicity, simhash_dedup, substring_dedup, packing, quality_rules)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()}
