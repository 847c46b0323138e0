"""Ordered per-key folds: for what is sequential by nature, over bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def parsed(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def ordered_fold(df: DataFrame, keys: list[str], order: str, make: Callable, schema: str) -> DataFrame:
    """Feeds each key's rows in order to an object of make(key), which returns output rows from step(row) and end().

    Rows stream through by batches, so a key may have any number of them; the
    object holds the only state.
    """
    arrow = to_arrow_schema(parsed(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if fold is None or key != now:
                    if fold is not None:
                        out += fold.end()
                    now, fold = key, make(key)
                out += fold.step(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if fold is not None and (out := fold.end()):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
