"""Substring dedup by windows of words.

Every window of a fixed number of words has a Rabin-Karp hash. Windows in contexts that repeat as a whole, or not at all,
are settled by the context's own hash; the windows of all other contexts are hashed one by one (two polynomials of 64
bits) and grouped in Spark, which gives the least document that holds each. A window that starts in a document of a
smaller doc_id is removed; overlapping windows merge into maximal removal intervals, and words outside stay.

Defined results: null and empty texts, and texts shorter than a window, lose nothing; copies are told by doc_id, so of
rows that share a doc_id and a text both stay or go alike, and neither removes words of the other (rows of one doc_id
should not differ in text; if they do, removal intervals of all of them apply); rows without a doc_id lose nothing and
remove nothing; an empty table gives an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import map_arrow, read_table
from ._repeats import OWNED_BITS, again, anchor_table, covered, first_windows, live_contexts

WINDOW, GRAM = 50, 16


def removal_ranges(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, starts: the ranges (start, number) of windows that also start in a document of a smaller id."""
    table, live = live_contexts(anchor_table(docs, "word", window, gram))
    mixed = (
        again(first_windows(live.filter("k > 1"), docs, "word", window).drop("n"))
        .groupBy("h", "c").agg(F.array_sort(F.collect_list(F.struct("j", "least"))).alias("leasts"))
    )
    # a window of a context that occurs again, but in no other context: the first document has it
    alone = live.filter("k > 1 and n > 1").select("h", "c", F.array(F.struct(F.lit(-1).cast("long").alias("j"), F.col("doc").alias("least"))).alias("leasts"))
    whole = live.filter("k = 1").select("h", "c", F.array(F.struct(F.lit(-1).cast("long").alias("j"), F.col("doc").alias("least"))).alias("leasts"))
    start, count = F.shiftright("pos", OWNED_BITS), F.col("pos").bitwiseAND((1 << OWNED_BITS) - 1)
    earlier = F.filter("leasts", lambda x: x["least"] < F.col("doc_id"))
    ranges = F.transform(earlier, lambda x: F.struct(F.when(x["j"] < 0, start).otherwise(start + x["j"]).alias("start"), F.when(x["j"] < 0, count).otherwise(F.lit(1)).alias("count")))
    return (
        table.hint("merge").join(whole.unionByName(alone).unionByName(mixed), ["h", "c"]).withColumn("r", ranges).filter(F.size("r") > 0)
        .groupBy("doc_id").agg(F.flatten(F.collect_list("r")).alias("starts"))
    )


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, n_removed, spans (removed word ranges) and kept (the rest, words joined
    by one space)."""
    ranges = removal_ranges(docs, window, gram)

    def make(batch: pa.RecordBatch):
        n, removed, spans, kept = [], [], [], []
        for text, starts in zip(batch.column(1), batch.column(2), strict=True):
            words = (text.as_py() or "").encode().split()
            gone = covered([(s["start"], s["count"]) for s in starts.as_py() or ()], window, len(words))
            n.append(len(words))
            removed.append(int(gone.sum()))
            if removed[-1]:
                edges = gone.astype("i1")
                up = [k for k in range(len(words)) if edges[k] and (not k or not edges[k - 1])]
                down = [k + 1 for k in range(len(words)) if edges[k] and (k + 1 == len(words) or not edges[k + 1])]
                spans.append([{"start": a, "end": b} for a, b in zip(up, down, strict=True)])
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        yield [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())]

    own = docs.select(F.col("doc_id").cast("long"), "text")
    return map_arrow(own.hint("merge").join(ranges, "doc_id", "left").select("doc_id", "text", "starts"), make, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def op4_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
