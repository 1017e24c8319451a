"""The synthetic tables of the planner experiments, seeded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orweave.plans.workload import table_name

#: Fixed values of the published experiments: rows and number of tables.
SIZES = {100: 10, 1000: 3, 2000: 3, 5000: 3, 10_000: 3, 20_000: 3, 50_000: 3, 100_000: 3}


def synthetic(spark: SparkSession, rows: int, keys: int = 3, uniform: int = 10, ordered: int = 3, seed: int = 0) -> DataFrame:
    """id 0..rows-1, skew<i> Zipf-distributed over the ids, even<i> uniform in [0, 1), rising<i> uniform and ascending with id.

    All columns are expressions over a range, so a table of any size is made in parallel.
    """
    frame = spark.range(rows)
    for i in range(keys):
        # Inverse of the distribution: sums of k ** -1.5 up to x are near zeta(1.5) - 2 / sqrt(x + 0.5), and zeta(1.5) is 2.612.
        u = F.rand(seed * 1000 + i) * (2.612 - 2 / (rows + 0.5) ** 0.5)
        x = F.pow(2 / (2.612 - u), 2) - 0.5
        frame = frame.withColumn(f"skew{i}", F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.floor(x))).cast("long"))
    for i in range(uniform):
        frame = frame.withColumn(f"even{i}", F.rand(seed * 1000 + 100 + i))
    for i in range(ordered):
        frame = frame.withColumn(f"rising{i}", (F.col("id") + F.rand(seed * 1000 + 200 + i)) / rows)
    return frame


def write_synthetic(spark: SparkSession, path: str, sizes: dict[int, int] | None = None, seed: int = 0) -> list[str]:
    """Write the tables of each size under path; the smallest size has fewer columns and more tables."""
    names = []
    for size, tables in (sizes or SIZES).items():
        for i in range(tables):
            small, name = size == min(SIZES), table_name(size, i)
            synthetic(spark, size, 1 if small else 3, 3 if small else 10, 0 if small else 3, seed + 100 * len(names) + i).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
            names.append(name)
    return names
