"""User-defined operators: (DataFrame, settings) -> DataFrame, found by a node's type."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

UserOp = Callable[[DataFrame, dict], DataFrame]


def column_map(*columns: Callable[[DataFrame], Column]) -> UserOp:
    """A map by column expressions, each a function of the input."""
    return lambda df, node: df.select(*[c(df).alias(f"c{i}") for i, c in enumerate(columns)])


def column_fold(keys: list[str], *aggregates: Callable[[DataFrame], Column]) -> UserOp:
    """An aggregate by column expressions, each a function of the input: keys, then aggregates. Spark combines before the shuffle."""
    return lambda df, node: df.groupBy(*keys).agg(*[a(df).alias(f"a{i}") for i, a in enumerate(aggregates)])


def row_map(function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> UserOp:
    """A map by batches: any number of rows out for those in, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return lambda df, node: df.mapInPandas(run, schema)


def fold(keys: list[str], start: Callable, step: Callable, finish: Callable, schema: str, combine: Callable | None = None) -> UserOp:
    """An aggregate by start(row), step(state, row) and finish(key, state) -> output row.

    For folds that column expressions can't give (see column_fold): it calls Python for each row.
    With combine(state, state) each batch is folded before the shuffle, and only
    states travel; they are pickled. Without it a key's rows meet in one task.
    """
    import pickle

    def op(df: DataFrame, node: dict) -> DataFrame:
        def of_rows(rows: pd.DataFrame):
            state = None
            for row in rows.itertuples(index=False):
                state = start(row) if state is None else step(state, row)
            return state

        if combine is None:
            return df.groupBy(*keys).applyInPandas(lambda key, rows: pd.DataFrame([finish(key, of_rows(rows))]), schema)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(*(k if isinstance(k, tuple) else (k,)), pickle.dumps(of_rows(rows))) for k, rows in batch.groupby(keys, sort=False, dropna=False)]
                yield pd.DataFrame(out, columns=[*keys, "state"])

        def final(key, rows: pd.DataFrame) -> pd.DataFrame:
            states = [pickle.loads(s) for s in rows["state"]]
            total = states[0]
            for s in states[1:]:
                total = combine(total, s)
            return pd.DataFrame([finish(key, total)])

        kinds = dict(df.dtypes)
        mid = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", state binary"
        return df.mapInPandas(partial, mid).groupBy(*keys).applyInPandas(final, schema)

    return op
