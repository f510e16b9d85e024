"""Row numbers over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.session import checkpoint


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Adds the place of each row in the order, from 1, by ranges: rows are numbered within range partitions and shifted by the
    sizes of those before. Ties get any order among themselves."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of the partition and the place in it come from one pass, kept so that they stay the same
    marked = checkpoint(parts.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id() % F.lit(1 << 33)}))
    sizes = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return marked.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_q", "_before")
