"""Queries and oracles of the corpus operators."""

from __future__ import annotations

import corpus_pipeline
from tallygrove.llm import oracles, queries as q


def queries() -> dict:
    """Name to (spark, sf_dir) -> DataFrame."""
    numbered = {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}
    return dict(sorted(numbered.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(oracles.SQL)
