"""The first rows in an order and the number of all of them, in one pass over the rows."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that the tasks' results are merged in before they meet in one task.
GROUPS = 256


def first_and_total(rows: DataFrame, order: list[str], most: int, groups: int = GROUPS) -> DataFrame:
    """The first `most` (1 at least) of rows by `order` (ascending, nulls first), in order, with `total`, the number of all; no row where there are none.

    Each task keeps `most` rows and a count. The tasks' results meet in `groups` groups, and what is left of these in one task, so with t tasks
    none sees more than most * max(groups, t / groups) rows. `order` has to tell different rows apart, or which of equals are shown is open.
    """
    columns = rows.columns
    by = [(c, "ascending") for c in order]

    def fold(batches):
        """Rows with the number that each stands for (the first row of a partial result stands for all of it) -> their first ones, likewise."""
        held, total = None, 0
        for batch in batches:
            if batch.num_rows:
                total += pc.sum(batch.column(len(columns))).as_py()
                new = pa.Table.from_batches([batch.select(columns)])
                held = new if held is None else pa.concat_tables([held, new])
                held = held.take(pc.sort_indices(held, sort_keys=by, null_placement="at_start")[:most])
        if total:
            counts = pa.array([total] + [0] * (held.num_rows - 1), pa.int64())
            part = pa.array([TaskContext.get().partitionId() % groups] * held.num_rows, pa.int32())
            yield from held.append_column("total", counts).append_column("__group", part).combine_chunks().to_batches()

    names = [*columns, "total"]
    form = rows.withColumns({"total": F.lit(1).cast("long"), "__group": F.lit(0)}).schema
    found = rows.withColumn("total", F.lit(1).cast("long")).mapInArrow(fold, form)
    found = found.repartition("__group").select(*names).mapInArrow(fold, form)
    whole = found.select(*names).repartition(1)
    whole = whole.mapInArrow(fold, form)

    def spread(batches):
        total = None
        for batch in batches:
            if total is None and batch.num_rows:
                total = batch.column(len(columns))[0].as_py()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), pa.array([total] * batch.num_rows, pa.int64())], names=names)

    return whole.select(*names).mapInArrow(spread, rows.withColumn("total", F.lit(1).cast("long")).schema)
