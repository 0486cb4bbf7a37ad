"""Queries that run the library's operators over the given tables, each with the
DuckDB SQL that must return the same rows where SQL can express the operator."""
