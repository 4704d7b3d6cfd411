"""What both operators on repeated passages share: finding windows (runs of W symbols of one document) that occur again,
with work in proportion to the text and little of it shuffled.

Windows are owned by content-defined anchors (``_text.anchors``), so equal windows have equal anchors at equal offsets.
An anchor's context is all its owned windows together. Anchors are grouped by their gram's hash, and the contexts of grams
that have several are counted; both aggregates combine before they shuffle, so a gram or context of very many documents is
no large group anywhere:

- a gram that occurs once has no repeated window;
- a gram with one context that occurs n times has all its windows repeated n times;
- only contexts that share a gram but differ (the ends of repeated passages) need a look at their windows.

A document emits one row for about half of ``W - gram`` symbols, over different grams, so a passage in a third of all
documents is still a small part of the rows of any key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import cut, map_arrow
from ._text import BYTE_CODE, Runs, U, Words, anchors, mix, signed, take_ranges, text_slices

HOT, SALTS = 2048, 64  # contexts of a gram whose windows are split, and into how many groups
OWNED_BITS = 12  # of the packed position: the start times 2**12, plus the number of owned windows


def symbols(unit: str, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols' 64-bit codes and the rows' first symbols."""
    if unit == "word":
        words = Words(data, offs)
        return words.hash, words.first
    return BYTE_CODE[data], offs


def anchor_table(docs: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """doc_id, h (the gram), c (the context), pos (first owned window and how many, packed)."""
    if window - gram + 1 >= 1 << OWNED_BITS:
        raise ValueError("too many windows for one anchor")

    def make(batch: pa.RecordBatch):
        for i, _, data, offs in text_slices(batch.column(1)):
            codes, bounds = symbols(unit, data, offs)
            runs = Runs(codes)
            grams = runs.fixed(gram)
            row, at, start, count = anchors(grams, bounds, window, gram)
            if not len(row):
                continue
            tag = mix((at - start).astype(np.uint64) * U(1 << OWNED_BITS) + count.astype(np.uint64))
            context = mix(runs.of(start, start + count - 1 + window) ^ tag)
            pos = ((start - bounds[row]) << OWNED_BITS) | count
            yield [batch.column(0).take(pa.array(i + row)), pa.array(signed(grams[at])), pa.array(signed(context)), pa.array(pos)]

    return map_arrow(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, h long, c long, pos long")


def live_contexts(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of grams that occur again, and their contexts: h, c, n (occurrences), k (contexts of the gram), doc and pos
    (the first occurrence)."""
    grams = cut(table.groupBy("h").agg(F.count("*").alias("times"), (F.min("c") == F.max("c")).alias("alone")).filter("times > 1").drop("times"))
    rows = cut(table.hint("merge").join(grams, "h"))
    contexts = cut(rows.groupBy("h", "c", "alone").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")))
    several = contexts.filter("not alone").groupBy("h").agg(F.count("*").alias("k"))
    counted = contexts.join(several, "h", "left").select("h", "c", "n", F.coalesce("k", F.lit(1)).alias("k"), F.col("first.doc_id").alias("doc"), F.col("first.pos").alias("pos"))
    return rows.drop("alone"), cut(counted)


def with_texts(contexts: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of the documents in which the contexts occur first, with arrays of h, c, n and pos."""
    mine = contexts.groupBy("doc").agg(F.collect_list(F.struct("h", "c", "n", "pos", "k")).alias("x"))
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return texts.hint("merge").join(mine, "doc").select("doc", "text", "x.h", "x.c", "x.n", "x.pos", "x.k")


def again(windows: DataFrame) -> DataFrame:
    """Windows with an equal one, and the least document that has it. Equal windows have one gram, so those of a gram of up
    to HOT contexts are a small group; the groups of the others are split by a salt and brought together by an aggregate.
    The windows themselves are shuffled once."""
    salted = windows.withColumn("salt", F.when(F.col("k") > HOT, F.pmod(F.xxhash64("h", "c"), F.lit(SALTS))).otherwise(-1)).drop("k").repartition("w1", "w2", "salt")
    # all columns are named in the aggregate, so that it reads the same shuffle as the join below
    every = F.struct("doc", *[c for c in windows.columns if c not in ("doc", "k", "w1", "w2")])
    local = salted.groupBy("w1", "w2", "salt").agg(F.min(every).alias("first"), F.count("*").alias("times")).select("w1", "w2", "salt", F.col("first.doc").alias("least"), "times")
    whole = local.filter("salt < 0")
    parts = cut(local.filter("salt >= 0"))
    over = parts.groupBy("w1", "w2").agg(F.min("least").alias("least"), F.sum("times").alias("times"))
    facts = whole.filter("times > 1").drop("times").unionByName(parts.select("w1", "w2", "salt").join(over.filter("times > 1").drop("times"), ["w1", "w2"]))
    return salted.hint("merge").join(facts, ["w1", "w2", "salt"])


def first_windows(contexts: DataFrame, docs: DataFrame, unit: str, window: int) -> DataFrame:
    """One row for each owned window of each context: h, c, j (its number), n, k, doc, and its hashes w1 and w2."""

    def make(batch: pa.RecordBatch):
        h, c, n, pos, k = (batch.column(i) for i in range(2, 7))
        for i, j, data, offs in text_slices(batch.column(1)):
            codes, bounds = symbols(unit, data, offs)
            w1, w2 = Runs(codes, 0).fixed(window), Runs(codes, 1).fixed(window)
            lists = pos.slice(i, j - i)
            p = lists.flatten().to_numpy()
            row = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
            count = p & ((1 << OWNED_BITS) - 1)
            start = (p >> OWNED_BITS) + bounds[row]
            count = np.where(start + count - 1 + window <= bounds[row + 1], count, 0)  # of another text with this id
            at = take_ranges(start, count)
            which = np.repeat(np.arange(len(p)), count)
            flat = [x.slice(i, j - i).flatten().take(pa.array(which)) for x in (h, c, n, k)]
            yield [flat[0], flat[1], pa.array(at - start[which]), flat[2], flat[3], batch.column(0).slice(i, j - i).take(pa.array(row[which])), pa.array(signed(w1[at])), pa.array(signed(w2[at]))]

    return map_arrow(with_texts(contexts, docs), make, "h long, c long, j long, n long, k long, doc long, w1 long, w2 long")


def covered(starts: list[tuple[int, int]], window: int, size: int) -> np.ndarray:
    """Which of ``size`` symbols are in a window that starts in one of the ranges (start, number)."""
    edge = np.zeros(size + 1, np.int32)
    for a, count in starts:
        if a < size:
            edge[a] += 1
            edge[min(a + count - 1 + window, size)] -= 1
    return np.cumsum(edge[:-1]) > 0
