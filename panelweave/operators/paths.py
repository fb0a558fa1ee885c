"""One ordered pass over each instrument's rows, for state that depends on the whole path.

Rows are dealt by instrument, sorted by time and streamed in Arrow batches: a
task holds a batch and one state, however long a history is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold_by_instrument(df: DataFrame, inputs: list[str], outputs: list[str], step: Callable, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """Adds double columns ``outputs``. step(state, *inputs) -> (state, *outputs); the state is None at first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartition(n, *keys).sortWithinPartitions(*keys, "t")
    names = ordered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            ids = list(zip(*(batch.column(names.index(k)).to_pylist() for k in keys), strict=True))
            values = [batch.column(names.index(c)).to_pylist() for c in inputs]
            made: list[list] = [[] for _ in outputs]
            for key, row in zip(ids, zip(*values, strict=True), strict=True):
                if key != now:
                    now, state = key, None
                state, *out = step(state, *row)
                for column, x in zip(made, out, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in made)], names=[*names, *outputs])

    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in ordered.schema), *(T.StructField(c, T.DoubleType(), True) for c in outputs)])
    return ordered.mapInArrow(run, schema)
