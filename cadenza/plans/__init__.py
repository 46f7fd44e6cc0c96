"""Registered queries with their oracles, one module per family."""

from . import catalog, cues, ideas, imaging, live, lyrics, mastering, melody, relational, scoring, service, signals, song, structure, timeline

MODULES = (timeline, relational, lyrics, scoring, signals, live, catalog, song, structure, melody, service, cues, mastering, imaging, ideas)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
