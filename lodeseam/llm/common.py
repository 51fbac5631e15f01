"""What the corpus operators share: reading tables, the shared folder, size checks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 500  # rows of a batch that leave a Python worker together


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder serves if all runs in this one process; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand so many rows at once to a Python worker; the setting of the session comes back after them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept_rows(docs: DataFrame, keeps: Callable[[str], bool]) -> DataFrame:
    """docs with the rows whose text keeps() is true of; all columns stay. Null counts as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                some = batch.slice(at, SLICE)
                yield some.filter(pa.array([keeps(t.as_py() or "") for t in some.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of df if there are at most limit of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small_side(df: DataFrame, limit: int) -> tuple[DataFrame, int | None]:
    """df ready for a join, and its row count where it is at most limit.

    Up to limit rows are fetched and broadcast; a larger df is left to a shuffled join.
    """
    rows = bounded_rows(df, limit)
    if rows is None:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), len(rows)
