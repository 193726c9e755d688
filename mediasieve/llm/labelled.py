"""What the two learned scores share: the fold, a bounded sample of labels, words by arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Rows no label is learned from: crc32 of the id as text, mod FOLDS, is 0 (null ids are held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, label_cols: list[str]) -> DataFrame:
    """Documents with labels, at most ``rows`` of them in hash order of the id, outside the held-out fold.

    Only the bounded sample of labels is broadcast; an id labelled twice counts with its largest label.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    for name in label_cols:
        usable = usable.filter(F.col(name).isNotNull())
    unique = usable.groupBy(id_col).agg(*[F.max(c).alias(f"_label_{c}") for c in label_cols])
    sample = unique.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    return docs.join(F.broadcast(sample), id_col)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(bounds of each text, code of each word, distinct words); words end at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if "" in words:         # leading and trailing space give empty pieces
        real = codes != words.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return bounds, codes, words
