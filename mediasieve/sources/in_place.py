"""Bytes last: rows are chosen on keys alone, then their bytes are read where they lie.

Keys (file and row index, or a path) are what joins, ranks and shuffles. The
bytes enter in a map over the chosen keys and never cross an exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ_ROWS = 256                     # rows decoded at once
BATCH_BYTES = 16 * 1024 * 1024      # bytes handed on at once; a longer cell goes alone


def opened(path: str):
    """A file for random reads: a URI of any file system Arrow knows, or a plain path."""
    system, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def fields_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _bounded(sizes: np.ndarray):
    """Ranges [start, stop) whose sizes stay within ``BATCH_BYTES``."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > BATCH_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _sizes(columns: list[pa.Array]) -> np.ndarray:
    """Bytes of each row over the columns of variable length."""
    total = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def _cells(names: list[str]):
    """Leaf columns of a decoded batch; ``a.b`` names field b of a struct column a."""
    def leaf(batch, name):
        top, _, field = name.partition(".")
        column = batch.column(top)
        return pc.struct_field(column, field) if field else column

    return lambda batch: [leaf(batch, name) for name in names]


def _read(names: list[str], types: list[pa.DataType], file_col: str, row_col: str):
    cells = _cells(names)

    def of_file(keys: pa.RecordBatch, source: pq.ParquetFile):
        rows = keys.column(row_col).to_numpy()
        first = 0
        for group in range(source.num_row_groups):
            size = source.metadata.row_group(group).num_rows
            lo, hi = np.searchsorted(rows, [first, first + size])
            if hi > lo:
                at = first
                for batch in source.iter_batches(READ_ROWS, row_groups=[group], columns=names):
                    lo, hi = np.searchsorted(rows, [at, at + batch.num_rows])
                    if hi > lo:
                        inside, found = rows[lo:hi] - at, cells(batch)
                        for a, b in _bounded(_sizes(found)[inside]):
                            taken = pa.array(inside[a:b])
                            yield pa.RecordBatch.from_arrays(
                                [*keys.slice(lo + a, b - a).columns, *[c.take(taken).cast(t) for c, t in zip(found, types)]],
                                [*keys.schema.names, *[f"_{i}" for i in range(len(names))]])
                    at += batch.num_rows
            first += size
        if len(rows) and (rows[0] < 0 or rows[-1] >= first):
            raise IndexError(f"{keys.column(file_col)[0].as_py()} has {first} rows; row {max(rows[-1], -rows[0])} is asked for")

    def run(batches):
        name, handle, source = None, None, None
        for batch in batches:
            files = batch.column(file_col).to_pylist()
            cuts = [0, *[i for i in range(1, len(files)) if files[i] != files[i - 1]], len(files)] if files else [0]
            for start, stop in zip(cuts, cuts[1:]):
                if files[start] != name:
                    if handle:
                        handle.close()
                    name, handle = files[start], opened(files[start])
                    source = pq.ParquetFile(handle)
                yield from of_file(batch.slice(start, stop - start), source)

    return run


def read_rows(keys: DataFrame, columns: dict[str, str], file_col: str = "file", row_col: str = "row") -> DataFrame:
    """``keys`` with columns of the Parquet rows that ``file_col`` and ``row_col`` name.

    ``columns`` maps a column of the files (``a.b`` for a struct field) to ``name type``, binary or
    string. Only the keys are shuffled, into ranges of (file, row), so a row group is
    decoded by few tasks; a row asked for by very many keys falls into several ranges, because
    the other columns break the tie. Keys without file or row drop out; a row outside
    its file fails the run.
    """
    keys = keys.where(F.col(file_col).isNotNull() & F.col(row_col).isNotNull())
    order = [file_col, row_col, F.xxhash64(*keys.columns)]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(file_col, row_col)
    types = [{"binary": pa.binary(), "string": pa.string()}[c.split()[1]] for c in columns.values()]
    return ranged.mapInArrow(_read(list(columns), types, file_col, row_col), f"{fields_of(keys)}, {', '.join(columns.values())}")


def read_files(keys: DataFrame, path_col: str, content: str = "content") -> DataFrame:
    """``keys`` with the bytes of the file ``path_col`` names: one map, no shuffle; a missing file fails the run."""
    def run(batches):
        for batch in batches:
            for i, path in enumerate(batch.column(path_col).to_pylist()):
                try:
                    with opened(path or "") as handle:
                        data = handle.read()
                except (FileNotFoundError, IsADirectoryError) as problem:
                    raise FileNotFoundError(f"missing image file {path}") from problem
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([data], pa.binary())], [*batch.schema.names, "_content"])

    return keys.mapInArrow(run, f"{fields_of(keys)}, `{content}` binary")
