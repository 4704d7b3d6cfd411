"""Dedup of repeated byte strings by suffix sorting.

A byte goes if a string of ``window`` bytes that covers it also starts anywhere else. Suffixes are sorted bucket by
bucket: a bucket holds the suffixes whose strings contain the same content-defined gram, so two that share ``window``
bytes are in one bucket. Buckets that cannot hold a repeat, and those whose contexts are all the same, are settled
before anything is sorted. Those left are sorted in blocks of bounded size, one at a time in a task:

- a difference cover modulo 64 (every distance is the difference of two of its members) gives the sample positions; they
  are ranked once for the block, by 64 bytes and then by doubling the length up to 512 bytes;
- suffixes are sorted by their first 64 bytes; longer ties are split by three-way partitions around pivots, comparing
  cover-sample ranks at the first distance at which both suffixes hit the sample;
- the common prefix of neighbours, from the same ranks and the bytes at its end, tells which strings repeat.

Memory is bounded by the block, not by the length of ties. Buckets of more contexts than ``largest`` are not brought
into one task: their strings are named by two 64-bit hashes and counted in Spark, with the same result.

Defined results: null and empty texts, and those shorter than the string length, lose nothing; repeated rows are copies
of each other, so they go as a whole if they are long enough (rows of one doc_id with different texts share their
removal intervals); matches never cross documents; rows without a doc_id lose nothing and remove nothing; an empty table
gives an empty one. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._frames import map_arrow, read_table
from ._repeats import OWNED_BITS, again, anchor_table, covered, first_windows, live_contexts, with_texts
from ._text import U, take_ranges, text_slices

WINDOW, GRAM = 400, 128
PERIOD = 64
LARGEST = 2048
BLOCK_BYTES = 2 << 20

#: A difference cover modulo 64 by rule: 0..7 and the multiples of 8.
COVER = np.array(sorted({*range(8), *range(0, PERIOD, 8)}))
IN_COVER = np.zeros(PERIOD, bool)
IN_COVER[COVER] = True
#: SHIFT[a, b]: the least s with a + s and b + s both in the cover.
SHIFT = np.array([[next(s for s in range(PERIOD) if IN_COVER[(a + s) % PERIOD] and IN_COVER[(b + s) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


class Pool:
    """A block of text with its cover-sample ranks, for comparing suffixes of at most ``depth`` bytes."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n = len(text)
        wide = np.concatenate([text, np.zeros(2 * PERIOD + 8, np.uint8)]).astype(np.uint64)
        self.word = np.zeros(self.n + 2 * PERIOD, np.uint64)  # the 8 bytes from each position, the first most significant
        for k in range(8):
            self.word |= wide[k : k + len(self.word)] << U(8 * (7 - k))
        sample = np.flatnonzero(IN_COVER[np.arange(self.n) % PERIOD])
        order, rank = self._by_bytes(sample)
        self.ranks, self.lengths = [], []
        length = PERIOD
        while True:
            full = np.zeros(self.n + 1, np.int32)  # 0: beyond the end
            full[sample] = rank + 1
            self.ranks.append(full)
            self.lengths.append(length)
            if length >= depth + PERIOD:
                break
            key = full[sample].astype(np.int64) * (len(sample) + 2) + full[np.minimum(sample + length, self.n)]
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(sample), np.int64)
            rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1])) if len(order) else 0
            length *= 2

    def _by_bytes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of positions by their first PERIOD bytes, and their dense ranks."""
        order = np.argsort(self.word[at], kind="stable")
        new = np.ones(len(at), bool)
        w = self.word[at[order]]
        new[1:] = w[1:] != w[:-1]
        for k in range(8, PERIOD, 8):
            group = np.cumsum(new) - 1
            tied = np.zeros(len(at), bool)
            tied[1:] = ~new[1:]
            tied[:-1] |= ~new[1:]
            i = np.flatnonzero(tied)
            if not len(i):
                break
            w = self.word[at[order[i]] + k]
            sub = np.lexsort((w, group[i]))
            order[i] = order[i[sub]]
            w, g = w[sub], group[i][sub]
            split = np.ones(len(i), bool)
            split[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
            new[i] = split
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new) - 1
        return order, rank

    def sort(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in suffix order, and whether each shares its first PERIOD bytes with the one before."""
        order, rank = self._by_bytes(at)
        pos, group = at[order], rank[order]
        joined = np.zeros(len(at), bool)
        joined[1:] = group[1:] == group[:-1]
        label = group.astype(np.int64)
        top = self.ranks[-1]
        done = np.zeros(len(at), bool)
        while True:
            first = np.ones(len(pos), bool)
            first[1:] = label[1:] != label[:-1]
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(pos)))
            open_ = (size > 1) & ~done[start]
            if not open_.any():
                return pos, joined
            i = take_ranges(start[open_], size[open_])
            pivot = np.repeat(pos[start[open_] + size[open_] // 2], size[open_])
            s = SHIFT[pos[i] % PERIOD, pivot % PERIOD]
            a, b = top[np.minimum(pos[i] + s, self.n)], top[np.minimum(pivot + s, self.n)]
            side = np.sign(a.astype(np.int64) - b)
            g = label[i]
            sub = np.lexsort((side, g))
            pos[i], side, g = pos[i[sub]], side[sub], g[sub]
            done[i] = side == 0
            cut = np.ones(len(i), bool)
            cut[1:] = (g[1:] != g[:-1]) | (side[1:] != side[:-1])
            # labels stay ascending: each new group is named by the place of its first member
            name = np.flatnonzero(cut)
            fresh = np.arange(len(pos))
            label = np.where(first, fresh, 0)
            label = np.maximum.accumulate(label)
            label[i] = np.repeat(i[name], np.diff(np.append(name, len(i))))

    def share(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether suffixes that share their first PERIOD bytes share ``length``."""
        at = SHIFT[a % PERIOD, b % PERIOD].astype(np.int64)
        same = np.ones(len(a), bool)
        for rank, size in zip(reversed(self.ranks), reversed(self.lengths), strict=True):
            fits = at + size <= length
            same &= ~fits | (rank[np.minimum(a + at, self.n)] == rank[np.minimum(b + at, self.n)])
            at = np.where(fits, at + size, at)
        for _ in range(PERIOD // 8 + 1):
            here = np.minimum(at, length - 8)
            same &= self.word[np.minimum(a + here, self.n + PERIOD)] == self.word[np.minimum(b + here, self.n + PERIOD)]
            at = at + 8
        return same


def repeated_starts(text: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each suffix start (``window`` bytes of text each at least), whether its string starts at another one too."""
    pool = Pool(text, window)
    pos, joined = pool.sort(np.sort(at))
    near = np.zeros(len(pos), bool)
    i = np.flatnonzero(joined)
    near[i] = pool.share(pos[i - 1], pos[i], window)
    both = near.copy()
    both[:-1] |= near[1:]
    flag = np.zeros(len(text) + 1, bool)
    flag[pos[both]] = True
    return flag[at]


def _contexts(contexts: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """h, c, n, count (owned windows) and body (the bytes of all of them) of each context."""

    def make(batch: pa.RecordBatch):
        for i, j, data, offs in text_slices(batch.column(1)):
            lists = [batch.column(k).slice(i, j - i) for k in range(2, 6)]
            p = lists[3].flatten().to_numpy()
            row = np.repeat(np.arange(j - i), np.diff(lists[3].offsets.to_numpy()))
            count = p & ((1 << OWNED_BITS) - 1)
            start = (p >> OWNED_BITS) + offs[row]
            end = start + count - 1 + window
            raw = data.tobytes()
            ok = end <= offs[row + 1]
            yield [x.flatten() for x in lists[:3]] + [pa.array(np.where(ok, count, 0)), pa.array([raw[a:b] if o else b"" for a, b, o in zip(start.tolist(), end.tolist(), ok.tolist(), strict=True)], pa.binary())]

    return map_arrow(with_texts(contexts, docs), make, "h long, c long, n long, count long, body binary")


def _sort_blocks(window: int):
    schema = to_arrow_schema(T.StructType.fromDDL("h long, c long, js array<int>"))

    def block(rows: list[tuple]) -> pa.RecordBatch | None:
        bodies = [r[4] for r in rows]
        text = np.frombuffer(b"".join(bodies), np.uint8)
        offs = np.cumsum([0, *map(len, bodies)])
        count = np.array([r[3] for r in rows])
        at = take_ranges(offs[:-1], count)
        which = np.repeat(np.arange(len(rows)), count)
        again = repeated_starts(text, at, window)
        out = [([], k) for k in range(len(rows))]
        for k in np.unique(which[again]).tolist():
            if rows[k][2] == 1:
                low, high = np.searchsorted(which, [k, k + 1])
                out[k] = (np.flatnonzero(again[low:high]).tolist(), k)
        out = [(js, k) for js, k in out if js]
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for _, k in out], pa.int64()), pa.array([rows[k][1] for _, k in out], pa.int64()), pa.array([js for js, _ in out], pa.list_(pa.int32()))], schema=schema) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for row in zip(*columns, strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    if (done := block(held)) is not None:
                        yield done
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held and (done := block(held)) is not None:
            yield done

    return run


def repeat_ranges(docs: DataFrame, window: int, gram: int, largest: int) -> DataFrame:
    """doc_id, starts: the ranges (start, number) of strings that also start elsewhere."""
    table, live = live_contexts(anchor_table(docs, "byte", window, gram))
    bodies = _contexts(live.filter(f"k > 1 and k <= {largest}"), docs, window)
    sorted_ = bodies.repartition("h").sortWithinPartitions("h", "c").mapInArrow(_sort_blocks(window), "h long, c long, js array<int>")
    hashed = (
        again(first_windows(live.filter(f"k > {largest}"), docs, "byte", window)).filter("n = 1")
        .groupBy("h", "c").agg(F.array_sort(F.collect_list(F.col("j").cast("int"))).alias("js"))
    )
    whole = live.filter("n > 1").select("h", "c", F.lit(None).cast("array<int>").alias("js"))
    start, count = F.shiftright("pos", OWNED_BITS), F.col("pos").bitwiseAND((1 << OWNED_BITS) - 1)
    single = F.transform("js", lambda j: F.struct((start + j).alias("start"), F.lit(1).cast("long").alias("count")))
    ranges = F.when(F.col("js").isNull(), F.array(F.struct(start.alias("start"), count.alias("count")))).otherwise(single)
    return table.hint("merge").join(whole.unionByName(sorted_).unionByName(hashed), ["h", "c"]).withColumn("r", ranges).groupBy("doc_id").agg(F.flatten(F.collect_list("r")).alias("starts"))


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes, n_removed, spans (removed byte ranges) and kept (the bytes that stay)."""
    ranges = repeat_ranges(docs, window, gram, largest)

    def make(batch: pa.RecordBatch):
        n, removed, spans, kept = [], [], [], []
        for text, starts in zip(batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode()
            n.append(len(raw))
            ranges = starts.as_py()
            if not ranges:
                removed.append(0)
                spans.append([])
                kept.append(raw)
                continue
            gone = covered([(s["start"], s["count"]) for s in ranges], window, len(raw))
            step = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
            removed.append(int(gone.sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        yield [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]

    own = docs.select(F.col("doc_id").cast("long"), "text")
    return map_arrow(own.hint("merge").join(ranges, "doc_id", "left").select("doc_id", "text", "starts"), make, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
