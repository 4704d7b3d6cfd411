"""Small DataFrame helpers of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_ready(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names; only where none is named, and Spark runs on one machine (tests), a
    temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Writes a frame as a table in the shared checkpoint folder and goes on from there. Columns are compressed, and Spark
    knows the table's size when it plans what follows."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    target = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def hold_batches(spark: SparkSession, size: int | None = None) -> None:
    """Holds the session's Arrow batches to BATCH_ROWS rows, and to ``size`` bytes where rows are as long as lists; memory of
    a worker follows their size, and texts are long."""
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= BATCH_ROWS:
        spark.conf.set(most, BATCH_ROWS)
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size and not 0 < int(spark.conf.get(most).rstrip("b")) <= size:
        spark.conf.set(most, f"{size}b")


def give_back() -> None:
    """Returns freed memory to the machine; a worker that waits for its next task would keep it beside the executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def map_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[list[pa.Array] | None]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a generator that turns one batch of at most BATCH_ROWS rows into lists of columns."""
    hold_batches(df.sparkSession)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            for columns in make(batch):
                if columns is not None and len(columns[0]):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def add_columns(df: DataFrame, text: str, make: Callable[[pa.Array], list[pa.Array]], schema: str) -> DataFrame:
    """All columns of ``df`` and new ones made from a text column, without a shuffle. Columns of the same name as a new
    one are replaced."""
    new = T.StructType.fromDDL(schema)
    kept = [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in new.names}]
    source = df.select(*[df[f"`{f.name}`"] for f in kept], df[f"`{text}`"].alias("__text"))

    def columns(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        yield [*batch.columns[:-1], *make(batch.column(batch.num_columns - 1))]

    return map_arrow(source, columns, T.StructType([T.StructField(f.name, f.dataType, True) for f in kept] + new.fields))
