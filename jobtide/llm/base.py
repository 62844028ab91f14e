"""What the operators of this subpackage share: intermediate tables in the shared folder, shipped code, small checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import io
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that is broadcast at most.
MAX_SMALL = 100_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where none is set, a temporary one in local mode only (tests,
    bench), in which driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="jobtide-checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def park(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage with a table that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/jobtide-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._jobtide_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete parked tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_jobtide_path", None):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once, so that Python workers can import it on any cluster."""
    if getattr(spark.sparkContext, "_jobtide_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.write(os.path.join(os.path.dirname(root), "__init__.py"), "jobtide/__init__.py")
        for name in sorted(os.listdir(root)):
            if name.endswith(".py"):
                z.write(os.path.join(root, name), f"jobtide/llm/{name}")
    path = os.path.join(tempfile.mkdtemp(prefix="jobtide-code-"), "jobtide_llm.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._jobtide_shipped = True


def releasing(run):
    """run, a function of Arrow batches, which at the end of a task gives the memory it has freed back to the system: Python workers outlive
    their tasks, and what they hold is missing from the next stage's."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
            ctypes.CDLL(None).malloc_trim(0)

    return task


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has max_rows rows at most, else df as it is: the join then shuffles. df should be parked."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def unit_interval(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values of cols alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def offsets(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """df (parked or files) with out, the sum of value over the rows before in the order of order, whose first column is a long (null first) and
    is cut into 1,024 blocks: short windows instead of one over all rows."""
    first = order[0]
    low, high = df.agg(F.min(first), F.max(first)).first()
    wide = ((high or 0) - (low or 0)) // 1024 + 1
    df = df.withColumn("_block", F.coalesce(F.expr(f"(cast({first} AS decimal(20,0)) - {low or 0}) div {wide}"), F.lit(-1)).cast("long"))
    by = [F.col(c).asc_nulls_first() for c in order]
    inner = Window.partitionBy("_block").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("_block").agg(F.sum(value).alias("_sum"))
    outer = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # 1,025 rows
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    return (
        df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(F.broadcast(blocks), "_block")
        .withColumn(out, F.col("_before") + F.col("_in"))
        .drop("_block", "_before", "_in")
    )
