"""Table functions in Python: the extension point for samplers that built-in functions can't express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def sampled(rows: DataFrame, fn: Callable[[Row, dict], Iterator[tuple]], schema: str, keys: list[str], order: list[str]) -> DataFrame:
    """What fn(row, state) gives for each row, as a table of the schema: any number of tuples a row.

    Rows of the same keys come one after the other, in the order, and share state, a dict that is empty at first; so a
    sampler may number its samples or stop after enough of them. A group streams through one task and is never held there.
    """

    class Sampler:
        def __init__(self):
            self.state = {}

        def eval(self, row: Row):
            yield from fn(row, self.state)

    return F.udtf(Sampler, returnType=schema)(rows.asTable().partitionBy(*keys).orderBy(*order))
