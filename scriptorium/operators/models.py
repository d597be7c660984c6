"""The seam to detection, segmentation and recognition models: a function over batches, loaded once a worker, whose failures are rows.

No model is part of the library. What a model gives (boxes, lines, texts) is a table like any other.
"""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def apply_model(rows: DataFrame, load: Callable[[], Callable[[dict], object]], inputs: list[str], result: str, kind: str = "string", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``rows`` with ``result`` (of the SQL type ``kind``), ``error`` and ``millis``.

    ``load`` is called once in each task and gives the model: a function from a dict of ``inputs`` to the result. A row whose call raises has a null
    result and the error's text; the others go on. Results go out batch by batch.
    """
    keep = keep if keep is not None else [c for c in rows.columns if c not in inputs]
    shown = rows.select(*keep, F.struct(*inputs).alias("_in"))
    empty = rows.sparkSession.createDataFrame([], f"x {kind}").schema["x"]
    shape = StructType([*rows.select(*keep).schema.fields, StructField(result, empty.dataType), StructField("error", StringType()), StructField("millis", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        model, into = None, to_arrow_type(empty.dataType)
        for b in batches:
            if model is None:
                model = load()
            out, errors, took = [], [], []
            for x in b.column(len(keep)).to_pylist():
                began, value, error = time.perf_counter(), None, None
                try:
                    value = model(x)
                except Exception as e:  # noqa: BLE001  (a failure is a row)
                    error = f"{type(e).__name__}: {e}"
                out.append(value)
                errors.append(error)
                took.append(int(1000 * (time.perf_counter() - began)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, into), pa.array(errors, pa.string()), pa.array(took, pa.int64())], names=[*keep, result, "error", "millis"])

    return shown.mapInArrow(run, shape)


def command(arguments: Callable[[dict], list[str]], seconds: float = 300.0) -> Callable[[], Callable[[dict], str]]:
    """A model that runs an external program for each row and gives its output. More than ``seconds`` or an exit code other than 0 is an error."""

    def load() -> Callable[[dict], str]:
        return lambda x: subprocess.run(arguments(x), check=True, capture_output=True, text=True, timeout=seconds).stdout

    return load


def counters(done: DataFrame) -> DataFrame:
    """One row: total, success, failed."""
    return done.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"))
