"""Arrow string columns as numpy arrays, cut into slices of bounded size."""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def byte_view(array):
    """(bytes as uint8, offsets as int64) of a string or binary array; null counts as empty."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    binary = pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type)
    array = array.cast(pa.large_binary() if binary else pa.large_string())
    if array.null_count:
        array = array.fill_null(b"" if binary else "")
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets, limit=SLICE_BYTES, rows=None):
    """Ranges of at most ``rows`` rows whose bytes sum to at most ``limit``; a longer row is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n, start + (rows or n))
        yield start, stop
        start = stop


def release():
    """Give the memory this worker has freed back to the system.

    Workers serve one stage after the other, so what they keep adds up beside the JVM.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def releasing(run):
    """A function of batches that gives its freed memory back when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def column_udf(prepare, kind):
    """Column function of Arrow arrays; ``prepare`` runs once per task and returns the function of one array."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        function = prepare()
        try:
            for array in arrays:
                yield function(array)
                release()
        finally:
            del function
            release()

    return F.arrow_udf(run, kind)
