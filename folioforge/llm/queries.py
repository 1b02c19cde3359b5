"""All queries of the llm operators, and their SQL where there is any."""

from __future__ import annotations

from folioforge.llm import boilerplate, mixing, names, quality, records, residue, scans, survivors, tokenize

_MODULES = [scans, records, names, survivors, boilerplate, residue, tokenize, mixing, quality]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
