"""Phases over batches that may fail: a failing batch is halved down to single rows, what still fails is set aside with its error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows of a batch at first.
BATCH_ROWS = 64


def run_phase(df: DataFrame, phase: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], results: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df with the results (a schema) of work, failed_stage, error and tries: as many rows as df has, in no order.

    work gets some rows of df and returns a row of results for each; another number of rows counts as a failure. After a
    MemoryError the task goes on with batches of half the size, which grow back by a row for each that succeeds; any other error concerns
    the failing batch alone. A single row that fails is tried once more, then set aside: no results, failed_stage is the phase with _oom or _inference, error is
    what was raised. Only errors of Python count: a lost executor is Spark's to repeat.
    """
    wanted = T._parse_datatype_string(results)
    schema = T.StructType([*df.schema.fields, *(T.StructField(f.name, f.dataType) for f in wanted), T.StructField("failed_stage", T.StringType()), T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(wanted)
        size = batch_rows

        def row(batch: pa.RecordBatch, done: pa.RecordBatch | None, stage: str | None, error: str | None, tries: int) -> pa.RecordBatch:
            n = len(batch)
            own = [done.column(i).cast(f.type) for i, f in enumerate(types)] if done is not None else [pa.nulls(n, f.type) for f in types]
            return pa.RecordBatch.from_arrays([*batch.columns, *own, pa.array([stage] * n, pa.string()), pa.array([error] * n, pa.string()), pa.array([tries] * n, pa.int32())], names=schema.names)

        def attempt(batch: pa.RecordBatch, tries: int = 1, again: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal size
            try:
                done = work(batch)
                if len(done) != len(batch):
                    raise ValueError(f"{len(done)} results for {len(batch)} rows")
                ready = row(batch, done, None, None, tries)
            except Exception as error:  # whatever the phase's own code raises is kept with the row
                full = isinstance(error, MemoryError)
                if len(batch) > 1:
                    half = len(batch) // 2
                    if full:
                        size = max(1, min(size, half))
                    yield from attempt(batch.slice(0, half), tries + 1)
                    yield from attempt(batch.slice(half), tries + 1)
                elif not again:
                    yield from attempt(batch, tries + 1, True)
                else:
                    yield row(batch, None, f"{phase}_{'oom' if full else 'inference'}", f"{type(error).__name__}: {error}", tries)
                return
            size = min(batch_rows, size + 1)
            yield ready

        for batch in batches:
            at = 0
            while at < len(batch):
                some = batch.slice(at, size)
                at += len(some)
                yield from attempt(some)

    return df.mapInArrow(run, schema)
