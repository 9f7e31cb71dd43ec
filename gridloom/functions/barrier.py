"""Columns that are computed once.

Catalyst merges projections and repeats an expression wherever its result is
used; deep geometry then grows past what code generation compiles. A generated
row per input row keeps what it computes apart, in the same stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with new columns, each evaluated once a row."""
    own = df.columns if keep is None else keep
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in own if c not in columns], F.inline(F.array(row)))
