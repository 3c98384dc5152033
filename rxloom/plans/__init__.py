"""Registered queries over the star schema, and their DuckDB SQL."""
