"""Word counts, the sizes that mixing, packing and sharding work with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import text as T


def with_words(df: DataFrame, text_col: str, keep: list[str], name: str = "tokens") -> DataFrame:
    """The columns ``keep`` and the number of words (runs of bytes above 0x20) of ``text_col``; 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, off in T.pieces(batch.column(len(keep))):
                n[lo:hi] = np.diff(T.words(data, off)[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], [*keep, name])

    some = df.select(*keep, F.col(text_col).alias("__lf_text"))
    return some.mapInArrow(T.tidy(run), S.StructType([*some.schema.fields[:-1], S.StructField(name, S.LongType())]))
