"""Rows packed many to a compressed batch, each of its texts once: a batch can be stored and moved at less than the size of its texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of the texts of one batch, repeated ones included.
BATCH_BYTES = 24 << 20


def _stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as found:
        held = found.read_all()
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in held.columns], names=held.column_names)


def pack_rows(df: DataFrame) -> DataFrame:
    """(batch, texts, rows): the different texts of a batch of df's rows, and its columns with numbers of texts in their place."""

    def packed(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
        own = [i for i, c in enumerate(columns) if pa.types.is_string(c.type)]
        coded = pa.concat_arrays([columns[i] for i in own]).dictionary_encode()
        for k, i in enumerate(own):
            columns[i] = coded.indices.slice(k * t.num_rows, t.num_rows)
        rows = pa.table(columns, names=t.column_names)
        values = ([number], [_stored(pa.table([coded.dictionary], names=["text"]))], [_stored(rows)])
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.binary(), pa.binary()))], names=["batch", "texts", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, load, number = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            size = np.full(b.num_rows, 16, np.int64)
            for c in b.columns:
                if pa.types.is_string(c.type):
                    size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            filled = (np.cumsum(size) + load) // BATCH_BYTES
            start = 0
            for i in np.flatnonzero(np.diff(filled, prepend=0)).tolist():
                yield packed([*held, b.slice(start, i + 1 - start)], number)
                held, start, number = [], i + 1, number + 1
            load = (load + int(size.sum())) % BATCH_BYTES
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield packed(held, number)

    return df.mapInArrow(run, "batch long, texts binary, rows binary")


def unpack_rows(texts: bytes, rows: bytes) -> tuple[pa.Array, pa.RecordBatch]:
    """The different texts, and the rows with numbers of texts."""
    return _read(texts).column(0), _read(rows)
