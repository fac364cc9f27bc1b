"""Folds over ordered rows of many streams, with state carried along and nothing else held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple | None], inputs: list[str], schema: str) -> DataFrame:
    """Runs ``step(state, row)`` over each key's rows in order and returns key, order columns and its values.

    Rows are dealt by key and sorted by Spark; a task streams through them with one state at a time, so a
    stream of any length needs constant memory.  ``step`` gives the output values, or None for no row.
    """
    carry = [key, *order]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            out = []
            for row in zip(*(pdf[c] for c in dict.fromkeys([*carry, *inputs]))):
                named = dict(zip(dict.fromkeys([*carry, *inputs]), row))
                if named[key] != current:
                    current, state = named[key], start()
                made = step(state, tuple(named[c] for c in inputs))
                if made is not None:
                    out.append((*(named[c] for c in carry), *made))
            yield pd.DataFrame(out, columns=[*carry, *names])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    full = ", ".join([*(f"{c} {types[c]}" for c in carry), schema])
    return rows.select(*dict.fromkeys([*carry, *inputs])).repartition(key).sortWithinPartitions(*carry).mapInPandas(run, full)
