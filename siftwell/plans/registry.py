"""Queries over the reference operators, and the DuckDB SQL that they are compared with."""

from . import cases, corpus, inline, site

QUERIES: dict = corpus.QUERIES | site.QUERIES | inline.QUERIES | cases.QUERIES
ORACLE_SQL: dict = corpus.ORACLE_SQL | site.ORACLE_SQL | inline.ORACLE_SQL | cases.ORACLE_SQL
