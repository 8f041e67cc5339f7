"""Dropping most rows without partners before a shuffle.

A Bloom filter of the wanted values is broadcast if they are few enough for ``MAX_BITS`` (16
MB); beyond that the rows are semi-joined. A filter keeps every wanted row and about one in
seventy of the others, so what follows must not rely on the others being gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsline.llm.common import mix

MAX_BITS = 1 << 27
BITS_EACH = 16


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    """Two bit places of each value."""
    h = mix(values.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([h & np.uint64(bits - 1), (h >> np.uint64(36)) & np.uint64(bits - 1)]).astype(np.int64)


def _marks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).drop_null().to_numpy(), bits))
            word, first = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    return run


def keep_wanted(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` (long) is in the only column of ``wanted``, and few others; nulls go.

    ``wanted`` is counted and read, so it should be a written table.
    """
    spark, name = df.sparkSession, wanted.columns[0]
    count = wanted.count()
    if count * BITS_EACH > MAX_BITS:
        return df.join(wanted.select(F.col(name).alias(column)).distinct(), column, "left_semi").select(df.columns)
    bits = max(1 << 10, 1 << (count * BITS_EACH - 1).bit_length()) if count else 1 << 10
    rows = wanted.select(F.col(name).cast("long")).mapInArrow(_marks(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros(bits >> 6, np.int64)
    words[rows.word.to_numpy()] = rows["mask"].to_numpy()
    packed = spark.sparkContext.broadcast(words.tobytes())
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(packed.value, np.uint64)
        for batch in batches:
            col = batch.column(at)
            place = _places(col.fill_null(0).to_numpy(), bits)
            hit = ((mask[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            half = len(hit) // 2
            yield batch.filter(pa.array(hit[:half] & hit[half:] & col.is_valid().to_numpy(zero_copy_only=False)))

    return df.mapInArrow(run, df.schema)
