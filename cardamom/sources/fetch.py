"""Calls of a service from the rows of a table: a partition function around an injected client.

The client is made once in each task. Rows go through it one after the other at a bounded rate, a
failure is tried again after a wait, and what still fails is an error in its row instead of a failure of
the job. Rows come out as they came in, with what the call gave.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..session import ship

#: Gets a row's columns as keyword arguments, and returns the made columns' values; an exception is a failed call.
Client = Callable[..., dict]


def called(rows: DataFrame, outputs: str, factory: Callable[[], Client], inputs: list[str], per_second: float | None = None, retries: int = 0, wait: Callable[[int, Exception], float | None] = lambda attempt, error: 0.0) -> DataFrame:
    """rows with the columns of the DDL string `outputs`, `error` string and `attempts` int.

    `factory` makes the client; `per_second` bounds the calls of one task. After a failure, `wait` says
    after how many seconds the call is made again, null for not at all; `retries` times at most. A
    column of rows that bears an output's name gives way to it. No shuffle.
    """
    ship(rows.sparkSession)
    made = StructType.fromDDL(f"{outputs}, error string, attempts int")
    keep = [c for c in rows.columns if c not in made.names]
    source = rows.select(*keep, *[rows[c].alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = StructType([*[source.schema[c] for c in keep], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        client, into, due = factory(), to_arrow_schema(made), 0.0
        for batch in batches:
            out: dict[str, list] = {c: [] for c in made.names}
            columns = [batch.column(len(keep) + i).to_pylist() for i in range(len(inputs))]
            for values in zip(*columns, strict=True):
                got, error, attempt = {}, None, 0
                while True:
                    if per_second:
                        time.sleep(max(0.0, due - time.monotonic()))
                        due = max(due, time.monotonic()) + 1 / per_second
                    try:
                        got, error = client(**dict(zip(inputs, values, strict=True))), None
                        break
                    except Exception as failed:  # noqa: BLE001  any failure of the client is the row's
                        error = f"{type(failed).__name__}: {failed}"
                        pause = wait(attempt, failed) if attempt < retries else None
                        if pause is None:
                            break
                        time.sleep(pause)
                        attempt += 1
                for c in made.names[:-2]:
                    out[c].append(got.get(c) if error is None else None)
                out["error"].append(error)
                out["attempts"].append(attempt + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(out[f.name], f.type) for f in into]], names=[*keep, *made.names])

    return source.mapInArrow(run, schema)
