"""Folds: steps whose outcome hangs on earlier outcomes, as a stream over sorted rows.

Rows are dealt by their session and sorted in their partition; a task passes over them batch by batch and keeps the open state of one session, a pack or a
time, across the borders of batches. No session is ever a frame of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Fold:
    """State of one session: row() takes its rows in order and gives the rows that are done, end() gives the rest."""

    def row(self, *values) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def folded(rows: DataFrame, by: str, order: list[str], new: Callable[[], Fold], schema: str) -> DataFrame:
    """(by, *schema): what the folds of each value of by give for its rows in order. row() gets all columns of rows but by, as they stand. A null is a value like others."""
    kind = StructType.fromDDL(f"`{by}` {rows.schema[by].dataType.simpleString()}, {schema}")
    arrow = to_arrow_schema(kind)
    rest = [c for c in rows.columns if c != by]

    def run(batches):
        fold, now = None, None

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for b in batches:
            out = []
            for key, *values in zip(*(c.to_pylist() for c in b.columns)):
                if fold is None or key != now:
                    out += [(now, *r) for r in fold.end()] if fold else []
                    fold, now = new(), key
                out += [(now, *r) for r in fold.row(*values)]
            if out:
                yield batch(out)
        if fold and (out := [(now, *r) for r in fold.end()]):
            yield batch(out)

    return rows.select(by, *rest).repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, kind)
