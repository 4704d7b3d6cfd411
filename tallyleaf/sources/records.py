"""Readers and writers of trial records. Schemas are explicit, so no pass is spent on inference; unreadable files and lines
are dropped, never fatal. One JSON file per trial is compacted to Parquet once; all further work reads that."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyleaf.functions.schema import struct
from tallyleaf.operators.trial_records import ITEM_COLUMNS

TRIAL = "run_id string, scale_name string, language string, provider string, model string, order_id string, condition_hash string, preset_id string, temperature10 int"
PLAN = struct(f"{TRIAL}, pair_id long, planned_at timestamp, order_no long")
ATTEMPT = struct(f"{TRIAL}, attempt string, status string, response_text string, recorded_at timestamp")
RESULT = struct(f"{TRIAL}, response_status string, raw_response string, recorded_at timestamp", items=T.ArrayType(struct("item_no int, answer string, score double")))
MANIFEST = struct("run_id string, manifest_hash string", tasks=T.ArrayType(struct("scale_name string, language string, model string, trials long")))


def _good(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def _schema(kind: T.StructType) -> T.StructType:
    return T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])


def read_documents(spark: SparkSession, folder: str, pattern: str, kind: T.StructType) -> DataFrame:
    """One multi-line JSON document per file, at any depth below a folder."""
    raw = (
        spark.read.schema(_schema(kind)).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    )
    return _good(raw.withColumn("source", F.col("_metadata.file_path")))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    return read_documents(spark, folder, "order_*.json", RESULT)


def read_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return read_documents(spark, folder, "trial_*_attempt_*.json", ATTEMPT)


def read_lines(spark: SparkSession, folder: str, kind: T.StructType, pattern: str = "*.json*") -> DataFrame:
    """JSON lines; a line that was cut off is skipped and the rest of its file kept."""
    return _good(spark.read.schema(_schema(kind)).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("columnNameOfCorruptRecord", "_corrupt").json(folder))


def read_plan(spark: SparkSession, folder: str) -> DataFrame:
    return read_lines(spark, folder, PLAN)


def read_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per task of every run's manifest."""
    return read_lines(spark, folder, MANIFEST).select("run_id", F.explode("tasks").alias("t")).select("run_id", "t.*")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the cluster names; a temporary one where none is named and Spark runs on one
    machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_items(items: DataFrame, folder: str, tasks: int | None = None) -> None:
    """Item sheets below folders by scale and language; rows of a trial stay together and in order. A folder has one sheet,
    or, where the number of tasks is given, more the more tasks there are, as a large folder is too much for one."""
    keys, usual = ["scale_name", "language"], 48  # folders
    dealt = items.repartition(*keys) if tasks is None else items.repartition(tasks, *keys, F.pmod(F.xxhash64("trial"), F.lit(-(-tasks // usual))))
    order = F.col("index").cast("int")
    sheet = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    dealt.sortWithinPartitions(*keys, "trial", order).write.partitionBy(*keys).options(**sheet).csv(folder)


def read_items(spark: SparkSession, folder: str) -> DataFrame:
    """Item sheets by their header; the header must name the columns in their fixed order."""
    names = ["trial", *ITEM_COLUMNS, "scale_name", "language"]
    schema = ", ".join(f"{n} {'long' if n == 'trial' else 'string'}" for n in names)
    return spark.read.schema(schema).options(header=True, enforceSchema=False, multiLine=True, escape='"', emptyValue="", nullValue="\0", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)


def write_trials(trials: DataFrame, folder: str) -> None:
    """The trial store, laid out by run, scale and language, and sorted by model inside: a folder for each model as well
    would make many tiny files. Rows are brought together by partition first, so that each gets few files; Spark escapes
    what paths cannot hold."""
    keys = ["run_id", "scale_name", "language"]
    trials.repartition(*keys).sortWithinPartitions(*keys, "model").write.partitionBy(*keys).parquet(folder)


def write_audit(tables: dict[str, DataFrame], folder: str, source: str | None = None) -> None:
    """Audit tables below a new folder; it must not be, hold or lie in the source."""
    a, b = folder.rstrip("/") + "/", (source or "").rstrip("/") + "/"
    if source and (a.startswith(b) or b.startswith(a)):
        raise ValueError("the target overlaps the source")
    for name, df in tables.items():
        df.write.mode("errorifexists").option("header", True).csv(f"{folder}/{name}")
