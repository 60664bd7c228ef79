"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from .jobs import fichas, gazette, measures, minutes, parties, sequences, store, streams, text, turns, vectors

GROUPS = (fichas, turns, vectors, text, gazette, store, measures, minutes, parties, sequences, streams)
QUERIES = {name: f for g in GROUPS for name, f in g.QUERIES.items()}
ORACLE = {name: sql for g in GROUPS for name, sql in g.ORACLE.items()}
