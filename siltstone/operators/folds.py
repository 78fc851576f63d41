"""Order-dependent folds over ever so long keys: rows are dealt and sorted by key, then read as a stream per partition.

Such a fold keeps one small state per key and emits as it goes, so a key of any size needs no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def streamed_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[tuple | None, tuple, dict], tuple[tuple, list[tuple]]], finish: Callable[[tuple], list[tuple]], schema: str) -> DataFrame:
    """Folds the rows of each key in order. ``step(state, key, row)`` gives the new state and rows to emit (state None at a
    key's first row); ``finish(state)`` gives the rows of a key's end."""
    columns = df.columns

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        state, current = None, None
        for batch in batches:
            out: list[tuple] = []
            for values in batch.itertuples(index=False, name=None):
                row = dict(zip(columns, values, strict=True))
                key = tuple(row[k] for k in keys)
                if key != current:
                    out += finish(state) if current is not None else []
                    state, current = None, key
                state, emitted = step(state, key, row)
                out += emitted
            yield pd.DataFrame(out, columns=names)
        if current is not None:
            yield pd.DataFrame(finish(state), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
