"""Queries over the sample tables, each with the DuckDB SQL that gives the same rows."""

from textloom.plans import builders, checks, conversations, documents, files, formats, measures, pages, retrieval, review, search, stateful, statistics, stored, tables, tools

QUERIES = {}
SQL = {}
for _part in (documents, pages, retrieval, conversations, statistics, tables, formats, review, tools, builders, checks, search, files, stored, stateful, measures):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
