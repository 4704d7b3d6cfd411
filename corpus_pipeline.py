"""A corpus from raw documents: toxic documents go, one document of each near-duplicate class stays, documents with
benchmark passages and with secrets are cleaned, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyleaf.llm import decontaminate, ngram_join, packing, secrets, toxicity
from tallyleaf.llm._frames import checkpoint_ready, read_table

#: Words of a benchmark passage; items of one or two words say nothing of a document that holds them.
FEWEST = 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. Labels come from the table, word scores from the documents given."""
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a Jaccard similarity of five-word shingles of 0.8 or more, the one of the smallest
    id stays. Documents without an id or without words stay. Rows that share an id are one document: they stay or go
    together."""
    classes = ngram_join.jaccard_classes(docs, 5, "0.8").filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(classes, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage of at least FEWEST words go. Rows without an id are told apart by their text."""
    said = F.xxhash64("text")
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.least(said, F.bitwise_not(said))))
    found = decontaminate.find_passages(keyed.select(F.col("__key").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"), fewest=FEWEST)
    return keyed.join(found.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by <secret>; the documents stay. n_chars follows the text."""
    found = secrets.mask_spans(secrets.scan_secrets(docs, secrets.fit_thresholds(docs)), "all_spans", "<secret>")
    changed = F.size("all_spans") > 0
    own = [F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: Edit distances and trained scores are beyond SQL; tests compare stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the documents table."""
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
