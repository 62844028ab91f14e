"""Places in a total order without bringing a key's rows together in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], block: Column, order: list, out: str = "place") -> DataFrame:
    """df with out, the place of each row from 1 among the rows of its keys, which aren't null, in the order of block, then order.

    block cuts the order into pieces: the rows of a piece are ranked in one task, the pieces of a key by a running sum over their counts,
    which has a row a piece. A piece should hold some ten thousand rows."""
    rows = df.withColumn("_block", block)
    one = [*keys, "_block"]
    count = rows.groupBy(*one).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = count.select(*one, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*one).orderBy(*order)))
    return ranked.join(before, one).withColumn(out, F.col("_before") + F.col("_in")).drop("_block", "_in", "_before")


def percentile_ranks(df: DataFrame, value: str, p: float, keys: list[str], cells: int = 4096) -> DataFrame:
    """keys, v, i (rank from 0), n, of the few rows whose ranks the percentile p may need: (n - 1) p, n p and their neighbours.

    A histogram of equal cells between a key's least and largest value tells which cells hold the ranks; only their rows are ranked."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    x = F.col("v").cast("double")
    ends = rows.groupBy(*keys).agg(F.min("v").cast("double").alias("_lo"), F.max("v").cast("double").alias("_hi"), F.count("*").alias("n"))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells), F.lit(cells - 1))).otherwise(F.lit(0)).cast("long")
    placed = rows.join(ends, keys).withColumn("_cell", cell)
    hist = placed.groupBy(*keys, "n", "_cell").agg(F.count("*").alias("_w"))
    upto = F.sum("_w").over(Window.partitionBy(*keys).orderBy("_cell"))
    low, high = F.floor((F.col("n") - 1) * F.lit(p)), F.least(F.ceil(F.col("n") * F.lit(p)), F.col("n") - 1)
    held = hist.withColumn("_upto", upto).filter((F.col("_upto") > low) & (F.col("_upto") - F.col("_w") <= high)).select(*keys, "_cell", (F.col("_upto") - F.col("_w")).alias("_before"))
    near = placed.join(held, [*keys, "_cell"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("v")) - 1
    return near.withColumn("i", F.col("_before") + rank).select(*[k for k in keys if k != "_all"], "v", "i", "n")
