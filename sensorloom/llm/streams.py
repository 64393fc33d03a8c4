"""Bounded groups of sorted rows, handed to a function without a task or frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def per_group(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], list[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows dealt and sorted by integer keys; ``run`` gets the table of one group at a time.

    Groups must be bounded: one is held whole, with what is left of the batch before.
    """

    def ends_of(table: pa.Table) -> np.ndarray:
        key = np.stack([table[c].to_numpy().astype(np.int64) for c in keys])
        return np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def made(table: pa.Table, ends: list[int]) -> pa.RecordBatch:
            out, last = [], 0
            for end in ends:
                out += run(table.slice(last, end - last))
                last = end
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            ends = ends_of(table) if len(table) else []
            if len(ends):
                yield made(table, ends.tolist())
                rest = table.slice(int(ends[-1]))
            else:
                rest = table
        if rest is not None and len(rest):
            yield made(rest, [len(rest)])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(apply, schema)
