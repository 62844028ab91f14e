"""Ways for jobs to come in and go out: prepared rows, CSV with a null mark, JSON lines, and writes by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.numbering import numbered
from ..model import DEFAULT_MAX_ATTEMPTS, DEFAULT_PRIORITY, DEFAULT_QUEUE, DEFERRED

# What a null is written as, so that it differs from an empty text.
NULL_MARK = "__JOBTIDE_NULL__"
CSV = {"nullValue": NULL_MARK, "quote": '"', "escape": '"', "header": "true", "multiLine": "true"}


def prepare(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows as they would be inserted: defaults, checks, the state by whether run_at is given (even in the past), the lane's shard by the
    ordering key. Columns: kind, args, and any of queue, priority, max_attempts, run_at, ordering_key, ord."""
    have = lambda c, d: F.coalesce(F.col(c), d) if c in rows.columns else d
    run_at = F.col("run_at") if "run_at" in rows.columns else F.lit(None).cast("timestamp_ntz")
    out = rows.withColumns(
        {
            "queue": have("queue", F.lit(DEFAULT_QUEUE)), "priority": have("priority", F.lit(DEFAULT_PRIORITY)).cast("int"), "max_attempts": have("max_attempts", F.lit(DEFAULT_MAX_ATTEMPTS)).cast("int"),
            "state": F.when(run_at.isNull(), "available").otherwise("scheduled"), "run_at": F.coalesce(run_at, as_of), "created_at": as_of, "attempt": F.lit(0), "run_lease": F.lit(0).cast("long"),
            "args": S.without_nul(have("args", F.lit("{}"))),
        }
    )
    wrong = F.when(~F.col("priority").between(1, 4), "priority").when(~F.col("max_attempts").between(1, 1000), "max_attempts").when(F.length("queue") > 200, "queue").when(F.length("kind") > 200, "kind")
    return out.withColumn("kind", F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("out of range: "), wrong))).otherwise(F.col("kind")))


def with_ids(rows: DataFrame, last_id: int, order: str = "ord") -> DataFrame:
    """Ids after last_id in the rows' given order, a whole number that may repeat; pieces of 65,536 of the order are numbered at a time."""
    return numbered(rows, [], F.floor(F.col(order) / 65_536), [order], "id").withColumn("id", F.lit(last_id) + F.col("id"))


def reserve_lanes(rows: DataFrame, heads: DataFrame, order: str = "ord") -> DataFrame:
    """rows with lane_seq: a contiguous range after each lane's head (queue, priority, enqueue_shard, next_seq)."""
    from pyspark.sql import Window

    lane = ["queue", "priority", "enqueue_shard"]
    n = F.row_number().over(Window.partitionBy(*lane).orderBy(order)) - 1
    return rows.join(heads, lane, "left").withColumn("lane_seq", F.coalesce("next_seq", F.lit(1)) + n).drop("next_seq")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").options(**{k: v for k, v in CSV.items() if k != "multiLine"}).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV).csv(path)


def copy_in(spark: SparkSession, path: str, schema: str, as_of: Column, last_id: int, jobs: DataFrame | None = None) -> DataFrame:
    """Bulk rows from CSV, staged and then prepared as one batch with ids after last_id in their order (ord); with jobs, rows whose unique
    claim is held, in the batch or by a job, are left out before ids are given."""
    from ..operators.transitions import enforce_unique

    rows = prepare(read_csv(spark, path, schema), as_of)
    if jobs is not None:
        rows = enforce_unique(rows, jobs)
    return with_ids(rows, last_id)


def enqueue_ready(rows: DataFrame, heads: DataFrame, slot: int, generation: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Prepared rows with ids that are due go straight into a slot of the ready ledger, each in its lane's next places; the others
    are deferred: (entries, deferred rows)."""
    due = F.col("run_at") <= as_of
    entries = reserve_lanes(rows.filter(due), heads, "id").withColumns({"ready_slot": F.lit(slot), "ready_generation": F.lit(generation).cast("long")})
    return entries.withColumnRenamed("id", "job_id"), rows.filter(~due).withColumnRenamed("id", "job_id")


def insert_one(jobs: DataFrame, kind: str, args: str, as_of: Column, last_id: int, **options) -> DataFrame:
    """jobs with one more row, with the defaults of a prepared one."""
    types = {"queue": "string", "priority": "int", "max_attempts": "int"}
    one = jobs.sparkSession.createDataFrame([(kind, args, *options.values())], ", ".join(["kind string", "args string", *[f"{k} {types[k]}" for k in options]]))
    row = prepare(one, as_of).withColumn("id", F.lit(last_id + 1).cast("long"))
    return jobs.unionByName(row.select(*[(F.col(c) if c in row.columns else F.lit(None)).cast(t).alias(c) for c, t in jobs.dtypes]))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_by_state(jobs: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned into hot and deferred rows by state, so that a scan for some states reads only theirs."""
    jobs.withColumn("tier", F.when(F.col("state").isin(*DEFERRED), "deferred").otherwise("hot")).write.mode(mode).partitionBy("tier", "state").parquet(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("tier")
