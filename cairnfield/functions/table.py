"""Functions for SQL that return tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="seq int, row int, col int, total double")
class PlanPath:
    """`plan_path(cells, r0, c0, r1, c1)`: the least-cost path over an array of cells (row, col, cost) and the cost up to each of its
    cells; no rows if an end isn't free or can't be reached. Cells without a cost are passed by none."""

    def eval(self, cells, r0: int, c0: int, r1: int, c1: int):
        from cairnfield.operators.graph import SQRT2, least_cost

        cost = {(c["row"], c["col"]): c["cost"] for c in cells or [] if c["cost"] is not None}
        if (r0, c0) not in cost or (r1, c1) not in cost or not (found := least_cost(cost, (r0, c0), (r1, c1))):
            return
        total, last = 0.0, None
        for seq, cell in enumerate(found[1]):
            if last is not None:
                diagonal = last[0] != cell[0] and last[1] != cell[1]
                total += (SQRT2 if diagonal else 1.0) * 0.5 * (cost[last] + cost[cell])
            last = cell
            yield seq, *cell, total


def register(spark: SparkSession) -> None:
    """Makes `plan_path` known to the session's SQL."""
    spark.udtf.register("plan_path", PlanPath)
