"""All queries of the engine, and their SQL."""

from __future__ import annotations

from twinloom.plans import catalogue, interfaces, streams

QUERIES = catalogue.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | interfaces.ORACLE_SQL | streams.ORACLE_SQL
