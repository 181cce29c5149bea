"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

SLICE_ROWS = 256
#: Bytes of a slice, unless a single row has more.
SLICE_BYTES = 1 << 20


def _value_bytes(values: pa.Array) -> np.ndarray:
    """About how many bytes each value takes."""
    kind = values.type
    if pa.types.is_struct(kind):
        return sum((_value_bytes(f) for f in values.flatten()), np.zeros(len(values), dtype=np.int64))
    if pa.types.is_list(kind):
        return pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) * 8
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(values), 8, dtype=np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows and few bytes, so that what a step holds depends neither
    on the batch size nor on how many long texts stand side by side."""
    for batch in batches:
        ends = np.cumsum(sum((_value_bytes(c) for c in batch.columns), np.zeros(batch.num_rows, dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            fit = int(np.searchsorted(ends, before + size, side="right"))
            stop = min(max(fit, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def add_columns(df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[list], dict]],
                source: str, keep: list[str] | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with the columns of ``schema``, computed from column ``source``.

    ``make()`` runs once a task and returns the function from a list of values to the
    columns; columns of ``df`` that have the name of an added one give way, and of the
    others only those in ``keep`` are returned, if it is given."""
    own = [c for c in df.columns if c not in schema.names and (keep is None or c in keep)]
    carried = list(dict.fromkeys([*own, source]))

    def run(batches):
        work = make()
        for part in slices(batches, rows):
            if part.num_rows:
                out = work(part.column(carried.index(source)).to_pylist())
                arrays = [part.column(carried.index(c)) for c in own] + [
                    out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], TYPES[f.dataType.simpleString()])
                    for f in schema]
                yield pa.RecordBatch.from_arrays(arrays, names=own + schema.names)

    whole = T.StructType([df.schema[c] for c in own] + list(schema))
    return df.select(*carried).mapInArrow(run, whole)


TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
         "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
         "binary": pa.binary()}
