"""Folds of ordered keys that take many keys a call.

A grouped pass pays for a message and a frame a key, which for keys of some hundred bars is most of its
time. Here Spark deals the keys out and sorts them; a task streams its rows and folds runs of whole keys.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Executors get these functions with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows gathered before they are folded; a task holds these, a batch and the rows of one key.
CHUNK = 50_000


def key_starts(g: pd.DataFrame, by: Sequence[str]) -> np.ndarray:
    """Positions at which a key begins, in a frame whose keys lie together."""
    new = np.zeros(len(g), dtype=bool)
    new[:1] = True
    for c in by:
        x = g[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def fold_keys(df: DataFrame, by: Sequence[str], order: str, fold: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, chunk: int = CHUNK) -> DataFrame:
    """fold(rows, starts) on whole keys of df, sorted by key and order; starts are the keys' first rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size < chunk:
                continue
            g = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            starts = key_starts(g, by)
            last = int(starts[-1]) if len(starts) else 0
            if last:
                yield fold(g.iloc[:last].reset_index(drop=True), starts[:-1])
                g = g.iloc[last:].reset_index(drop=True)
            # What is left is one key, not yet known to be whole.
            held, size = [g], 0
        held = [g for g in held if len(g)]
        if held:
            g = pd.concat(held, ignore_index=True)
            yield fold(g, key_starts(g, by))

    return df.sortWithinPartitions(*by, order).mapInPandas(run, schema)


def trailing_columns(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], fold: Callable[[list[np.ndarray], np.ndarray], list[pa.Array]], added: str, chunk: int = CHUNK) -> DataFrame:
    """df with the columns `added`, from the rows before each in its key.

    fold(cols, at) gets whole keys, sorted by key and order: doubles with NaN for null, and each row's
    place in its key from 0. It may compare a row with the rows before it as whole arrays. All
    columns of df pass through untouched.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    names = [f.split()[0] for f in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
            begins = np.flatnonzero(new)
            at = np.arange(len(t)) - np.repeat(begins, np.diff(np.append(begins, len(t))))
            doubles = [pc.cast(t.column(c).combine_chunks(), pa.float64()).to_numpy(zero_copy_only=False) for c in cols]
            for name, values in zip(names, fold(doubles, at)):
                t = t.append_column(name, values)
            yield from t.to_batches(max_chunksize=10_000)

        def begins_key(t: pa.Table) -> np.ndarray:
            new = np.zeros(len(t), dtype=bool)
            new[:1] = True
            for c in by:
                x = t.column(c).combine_chunks()
                a, b = x.slice(1), x.slice(0, len(t) - 1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
                new[1:] |= ~same.to_numpy(zero_copy_only=False)
            return new

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < chunk:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            new = begins_key(t)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from done(t.slice(0, last), new[:last])
            # What is left is one key, not yet known to be whole.
            held, size = t.slice(last).to_batches(), len(t) - last
        if size:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from done(t, begins_key(t))

    return df.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, f"{fields}, {added}")


def before(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The value n rows before each row of its key, NaN where there is none."""
    out = np.full(len(x), np.nan)
    if n < len(x):
        out[n:] = np.where(at[n:] >= n, x[: len(x) - n], np.nan)
    return out
