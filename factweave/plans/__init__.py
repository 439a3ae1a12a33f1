"""Queries that apply the operators to the given tables, and the same in DuckDB SQL."""
