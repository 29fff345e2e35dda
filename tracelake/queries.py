"""The engine's queries by name, and SQL for those that SQL can express."""

from tracelake.plans import scores, sources, windows

_ALL = {**windows.QUERIES, **scores.QUERIES, **sources.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
