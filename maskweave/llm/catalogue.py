"""Queries of the training-data operators by name, and their SQL."""
from maskweave.llm import bpe_stream, decontaminate, mixing, near_dup, quality, secrets, spelling, suffix_dedup, token_counts, token_records, turns, url_filter, warc

_MODULES = (quality, warc, secrets, token_records, turns, url_filter, mixing, token_counts, near_dup, decontaminate, suffix_dedup, bpe_stream, spelling, turns)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in getattr(m, "SQL", {}).items()}
