"""Size checks that decide between a broadcast and a shuffle, and where written tables go."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch of texts or tokens, unless the session sets another number.
BATCH_ROWS, _BATCH = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
_local_folders: dict[str, str] = {}


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of driver-side constants, such as `"ord long, symbol string"`.

    Built from Arrow it becomes a local relation with a known size: no Python job, and the planner
    can broadcast it by itself.
    """
    fields = [f.split() for f in schema.split(", ")]
    columns = {
        name: pa.array([r[i] for r in rows], _ARROW[kind]) for i, (name, kind) in enumerate(fields)
    }
    return spark.createDataFrame(pa.table(columns))


def is_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Measure `df`, reading at most `max_rows + 1` rows of it."""
    size = (
        df.limit(max_rows + 1)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes"),
        )
        .first()
    )
    return size["n"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def broadcast_if_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only when the measured size allows it.

    A larger side is returned without a hint: the join then shuffles, and adaptive execution splits
    the skewed partitions.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def short_batches(spark: SparkSession) -> None:
    """Texts and tokens may be long, so a batch of them has fewer rows than Spark's default for narrow rows.

    With the default a batch, and with it the memory of a Python worker, grows with the rows of a task.
    """
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    Only a session inside one process may go without that setting; it gets one new temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="narrascope-")
    return _local_folders[app]


def as_list(key: str | Sequence[str]) -> list[str]:
    """Key columns as a list; a report may be named by several columns, such as dataset and number."""
    return [key] if isinstance(key, str) else list(key)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dealt_out(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Narrow rows over as many tasks as the session works with, for a table that is read often.

    What a single task has written would be read by a single task again. With `task_rows` there are no more
    tasks than so many rows each need, and one per core at least; `df` is counted for it.
    """
    spark = df.sparkSession
    cores, most = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    if task_rows:
        most = -(-df.count() // task_rows)
    return df.repartition(max(cores, most))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used after an expensive step (an encoder) so that nothing is computed twice and a lost executor
    costs a re-read, not a re-run.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
