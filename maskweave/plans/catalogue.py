"""Queries of the redaction engine by name, and the SQL that says what they return."""
from maskweave.plans import conversations, documents, model, profiles, sessions, sources, tables

_MODULES = (documents, sessions, tables, conversations, model, sources, profiles)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
