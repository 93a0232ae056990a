"""Arrow batches inside Spark tasks: texts as byte buffers, cut into slices of bounded size."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a numpy pass holds at once; one longer document is taken whole.
SLICE_BYTES = 2 << 20


#: What empties the caches of this process, and the module whose tasks ran last.
_clearing: list[Callable[[], None]] = []
_last: dict[str, str] = {}


def cached(f: Callable) -> Callable:
    """functools.cache for what a worker keeps from task to task, until one of another module begins."""
    made = functools.cache(f)
    _clearing.append(made.cache_clear)
    return made


def begin(module: str) -> None:
    """Drops what tasks of another module left in this worker."""
    if _last.get("module", module) != module:
        for clear in _clearing:
            clear()
        release()
    _last["module"] = module


def release() -> None:
    """Gives memory that is free back to the system: workers are used again, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings, null as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most `limit` bytes of text (one row at least): rows, bytes, offsets."""
    texts = texts_of(batch.column(batch.schema.get_field_index(column)))
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def map_slices(df: DataFrame, function: Callable, schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """`function(rows, bytes, offsets)` gives a RecordBatch, or several, for each slice of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(function.__module__)
        for batch in batches:
            for rows, data, offsets in slices(batch, column, limit):
                made = function(rows, data, offsets)
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
        release()

    return df.mapInArrow(run, schema)


def strings(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
