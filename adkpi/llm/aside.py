"""Keeps an input's columns apart from an operator's helper columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame


def passing_aside(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Columns of the first frame that begin with ``__`` pass ``operator`` under other names.

    Operators name their helper columns so; a column that must only pass may have any name.
    """

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        names: dict[str, str] = {}
        for column in docs.columns:
            if column.startswith("__"):
                number = len(names)
                while f"passing_{number}" in taken:
                    number += 1
                taken.add(f"passing_{number}")
                names[column] = f"passing_{number}"
        if not names:
            return operator(docs, *args, **kwargs)
        out = operator(docs.withColumnsRenamed(names), *args, **kwargs)
        return out.withColumnsRenamed({new: old for old, new in names.items()})

    return run
