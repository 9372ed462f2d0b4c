"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and ``oracle`` the DuckDB SQL that some of them are held against.
"""
