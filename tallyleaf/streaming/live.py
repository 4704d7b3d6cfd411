"""Live views over a growing folder of records: ingest, current row per trial, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyleaf.functions.schema import struct

RECORD = struct("id long, run string, task string, kind_rank int, attempt long, source string, status string, seen_at timestamp")


def ingest(spark: SparkSession, folder: str, schema: T.StructType = RECORD, files_per_batch: int = 4) -> DataFrame:
    """Records as files arrive; lines that are not whole yet are dropped."""
    kind = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch).option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def current_trials(records: DataFrame, longest_run: str) -> DataFrame:
    """A stream of changed current rows: the greatest (rank, attempt, source) of each trial, as an aggregate in the JVM. A
    late lower attempt, which is late by version and not by time, changes nothing. State is one row for each trial and ends
    when the trial's run must have ended: records are grouped by the span of time that holds their run's start, and a span
    is dropped once records are newer than its end by ``longest_run``."""
    rank = F.struct("kind_rank", "attempt", "source")
    rows = records.withWatermark("seen_at", longest_run)
    best = rows.groupBy(F.window("seen_at", longest_run), "id").agg(F.max_by(F.struct("kind_rank", "attempt", "source", "status", "task"), rank).alias("r"))
    return best.select("id", F.col("window.start").alias("span"), "r.*")


def progress(records: DataFrame, plan: DataFrame, longest_run: str) -> DataFrame:
    """Trials saved in each task of a run and in the whole run (task __all__), each counted once, against a static plan (run,
    task, planned); done stops at planned. Ids are kept for ``longest_run`` after their record, then forgotten."""
    once = records.withWatermark("seen_at", longest_run).dropDuplicatesWithinWatermark(["run", "id"])
    counted = once.withColumn("task", F.explode(F.array("task", F.lit("__all__")))).groupBy("run", "task").agg(F.count("*").alias("said"))
    whole = plan.groupBy("run").agg(F.sum("planned").alias("planned")).select("run", F.lit("__all__").alias("task"), "planned")
    rows = counted.join(plan.select("run", "task", "planned").unionByName(whole), ["run", "task"])
    return rows.select("run", "task", F.least("said", "planned").alias("done"), "planned", F.when(F.col("said") >= F.col("planned"), "completed").otherwise("partial").alias("state"))


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, in as many batches as the source makes. Each batch is written as a Parquet folder of its own,
    whole again if it is retried; rows carry their batch's number."""
    target = f"{checkpoint}/{name}-out"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/n={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}-state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    fields = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return stream.sparkSession.read.schema(fields).option("recursiveFileLookup", True).parquet(target)
