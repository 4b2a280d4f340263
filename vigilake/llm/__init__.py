"""Operators for training-data corpora. Nothing else in the library imports this subpackage.

Each module has QUERIES (name -> function of spark and sf_dir) and ORACLE_SQL (name -> DuckDB SQL).
"""

from vigilake.llm import registry

QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL
