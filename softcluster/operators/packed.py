"""Runs of rows with lists of numbers, packed into bytes.

A run is some rows (id, places, values) of one block.  Lists without nulls are
kept as differences (whole numbers) by the byte: the high bytes of places and
the bytes of repeated values pack to almost nothing, so that an entry takes 2
to 3 bytes of memory, disk and shuffle instead of 12.  Other columns, and lists
with nulls, are Arrow's.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa

#: Entries that a run holds at most, or one row's.
RUN_ENTRIES = 1 << 20
_PLAIN = (pa.int32(), pa.int64(), pa.float64())


def numbers(column) -> np.ndarray:
    return np.asarray(column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False))


def lists(values, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Runs of ``values`` of the given sizes as a list column."""
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(values, kind))


def runs(sizes: np.ndarray, most: int | None = None):
    """(first row, last row + 1) of runs of rows with at most ``most`` entries, or of one row."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        to = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + (most or RUN_ENTRIES), "right")))
        yield i, to
        i = to


def _bytes(flat: np.ndarray) -> bytes:
    if flat.dtype.kind == "i" and len(flat):
        flat = np.concatenate([flat[:1], flat[1:] - flat[:-1]])  # wraps, as the sums do
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _flat(data: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * dtype.itemsize, "zstd", asbytes=True), np.uint8)
    flat = np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype)
    return np.cumsum(flat, dtype=dtype) if dtype.kind == "i" else flat


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack(rows: pa.RecordBatch) -> bytes:
    packed, others, sizes = {}, {}, {}
    for name, column in zip(rows.schema.names, rows.columns):
        kind = column.type
        flat = column.flatten() if pa.types.is_list(kind) and column.null_count == 0 else None
        if flat is None or kind.value_type not in _PLAIN or flat.null_count:
            others[name] = column
            continue
        many = numbers(column.value_lengths()).astype(np.int32)
        key = many.tobytes()
        sizes.setdefault(key, many)
        flat = numbers(flat)
        packed[name] = (flat.dtype.str, len(flat), list(sizes).index(key), _bytes(flat))
    rest = _ipc(pa.RecordBatch.from_arrays(list(others.values()), names=list(others))) if others else None
    return pickle.dumps((rows.num_rows, rows.schema.names, packed, [_bytes(x) for x in sizes.values()], rest), protocol=5)


def unpack(data: bytes, columns: list[str] | None = None) -> pa.Table:
    """A run's rows, or some columns of them."""
    n, names, packed, sizes, rest = pickle.loads(data)
    names = [c for c in names if columns is None or c in columns]
    offsets = [np.append(0, np.cumsum(_flat(x, n, np.dtype(np.int32)))).astype(np.int32) for x in sizes]
    others = pa.ipc.open_stream(rest).read_all() if rest is not None else None

    def column(name):
        if name not in packed:
            return others.column(name).combine_chunks()
        kind, many, which, data = packed[name]
        return pa.ListArray.from_arrays(pa.array(offsets[which]), pa.array(_flat(data, many, np.dtype(kind))))

    return pa.Table.from_arrays([column(c) for c in names], names=names)


class Runs:
    """The runs of a block: every pass over them unpacks one at a time."""

    def __init__(self, column):
        self.column = column

    def __iter__(self):
        for x in self.column:
            yield unpack(x.as_buffer())

    def only(self, name: str):
        for x in self.column:
            yield unpack(x.as_buffer(), [name]).column(name).combine_chunks()
