"""Tasks of a bounded number of rows, whatever the table's size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: rows of a task behind which rows are multiplied, sorted or held in memory
TASK_ROWS = 200_000


def spread(df: DataFrame, rows: int, *by: str, task_rows: int | None = None) -> DataFrame:
    """``df``, which has about ``rows`` rows, in parts of about ``task_rows``, by the hash of ``by`` or evenly.

    Adaptive execution joins small parts by their bytes on disk, which says
    little of what a task makes of them; a number of parts given here stays. A
    table that fits one task is left as it is.
    """
    task_rows = task_rows or TASK_ROWS
    if rows <= task_rows:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / task_rows)), *by)
