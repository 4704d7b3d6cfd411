"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH.

The CGK random walk reads a word sequence with a pointer that advances or stays as a random function of step and word
says; edit distance between sequences becomes Hamming distance between the walks' records. For every benchmark item all
windows of its number of words are compared: windows are embedded, some coordinates are sampled a number of times, and
windows that agree with an item on one sample are verified by a banded edit distance over words. Each eight samples have
a walk of their own, so that sequences that drift apart in one walk meet in another. The number of samples is set for each
length of items, by a simulation with the most edits allowed on the items themselves: samples are added until the target
recall is met, and a target that no bearable number meets is an error.

Before they are embedded, windows pass a test that loses none: with e edits at least n - g + 1 - g e of an item's word
g-grams stay, so a window must hold as many g-grams of items of its length (g is 3, or less where that would be none: 2
for items of five words at 0.8). A table of fixed size, by gram hash, tells by 64 bits for which lengths (modulo 64) a gram
occurs in the benchmark. The benchmark is the stated query set; it is gone through in blocks of bounded size, each broadcast, so documents are
scanned once per block and never shuffled.

A match has a similarity (1 - distance / n) of at least the bound, 0.8 unless told otherwise, so items of under five words
must occur exactly. Words are compared without
regard to the case of A-Z. Defined results: null and empty texts, and texts shorter than an item, have no match; items
with null text, without words or with fewer than ``fewest`` match nothing; repeated rows and repeated items match each for itself; of
overlapping windows of one item the nearest counts, then the first. Only id and text columns are read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import map_arrow, read_table
from ._text import Runs, U, Words, mix, take_ranges, text_slices

BITS = 20  # of a gram table's index
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 20_000_000
SAMPLE = 3  # coordinates in a sample
WALK = 8  # samples from one walk
MOST_SAMPLES = 2_048  # a target recall that needs more is an error
PAD = U(0x2545F4914F6CDD1D)


def allowed(n: int, similarity: float) -> int:
    """The most edits of a match of n words."""
    return math.floor((1 - similarity) * n + 1e-9)


def gram_width(n: int, edits: int) -> int:
    """Words of the longest gram, at most three, of which some are left after the edits wherever these are."""
    return next(g for g in (3, 2, 1) if n - g + 1 - g * edits >= 1)


def embed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The CGK walk over each row of word hashes, 2 n steps long, in which it reads n words on average. In later steps
    most walks only read what fills up, and samples of these would let all windows agree."""
    rows, n = x.shape
    wide = np.concatenate([x, np.full((rows, 1), PAD)], 1)
    at = np.zeros(rows, np.int64)
    out = np.empty((rows, 2 * n), np.uint64)
    every = np.arange(rows)
    for j in range(2 * n):
        now = wide[every, at]
        out[:, j] = now
        at = np.minimum(at + (mix(now ^ U((j + 1 + 100_003 * seed) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(63)).astype(np.int64), n)
    return out


def sample_keys(x: np.ndarray, samples: int, first: int = 0) -> np.ndarray:
    """One hash for each row of word hashes and sample, from the sample ``first`` on, which begins a walk."""
    n = x.shape[1]
    out = np.empty((len(x), samples), np.uint64)
    for k in range(samples):
        walk, place = divmod(first + k, WALK)
        if place == 0:
            record = embed(x, walk)
            places = np.random.default_rng((n, walk)).integers(0, 2 * n, (WALK, SAMPLE))
        h = np.full(len(x), U(first + k))
        for c in places[place]:
            h = mix(h * U(0x9E3779B97F4A7C15) + record[:, c])
        out[:, k] = h
    return out


def edited(x: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """Each row with that many random edits: half of them other words, a quarter each left out and put in."""
    out = []
    for row in x:
        y = list(row)
        for _ in range(edits):
            place, what = int(rng.integers(0, len(y))), rng.random()
            new = U(rng.integers(1, 1 << 62))
            if what < 0.5:
                y[place] = new
            elif what < 0.75:
                del y[place]
                y.append(new)
            else:
                y.insert(place, new)
                y.pop()
        out.append(y)
    return np.array(out, np.uint64)


def samples_for(items: np.ndarray, edits: int, recall: float, tries: int = 400) -> int:
    """The least number of samples that finds the wanted share of randomly edited items, all of one length."""
    if not edits:
        return 1
    rng = np.random.default_rng(7)
    x = items[rng.integers(0, len(items), tries)]
    y = edited(x, edits, rng)
    missed = np.arange(tries)
    for first in range(0, MOST_SAMPLES, WALK):
        same = sample_keys(x[missed], WALK, first) == sample_keys(y[missed], WALK, first)
        hit = np.where(same.any(1), same.argmax(1), WALK)
        for k in range(WALK):
            if (hit > k).sum() <= (1 - recall) * tries:
                return first + k + 1
        missed = missed[hit == WALK]
    raise ValueError(f"a recall of {recall} for {edits} edits in {items.shape[1]} words needs over {MOST_SAMPLES} samples")


def edit_distances(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Between rows of equal length; values over ``most`` only say that they are over it."""
    rows, n = x.shape
    band = 2 * most + 1
    far = n + most + 5
    pad = np.zeros((rows, most), np.uint64)
    wide = np.concatenate([pad, y, pad], 1)
    d = np.full((rows, band + 2), far, np.int32)
    d[:, 1 + most : 1 + band] = np.arange(most + 1)  # d[0][j], j = k - most
    for i in range(1, n + 1):
        new = np.full_like(d, far)
        for k in range(band):
            j = i + k - most
            if j < 0 or j > n:
                continue
            if j == 0:
                new[:, k + 1] = i
                continue
            cost = d[:, k + 1] + (x[:, i - 1] != wide[:, j - 1 + most])
            new[:, k + 1] = np.minimum(np.minimum(cost, d[:, k + 2] + 1), new[:, k] + 1)
        d = new
    return d[:, 1 + most]


@dataclass
class ItemBlock:
    """What one block of the benchmark sends to the tasks."""

    ids: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]  # rows, words, sorted keys and rows by sample
    lengths: dict[int, np.ndarray]  # by words of a gram: by its hash, the lengths as bits
    similarity: float

    def shape(self, n: int) -> tuple[int, int, int]:
        """For items of n words: the most edits, the words of a gram, and how many grams must stay."""
        edits = allowed(n, self.similarity)
        g = gram_width(n, edits)
        return edits, g, n - g + 1 - g * edits


def word_rows(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, data, offs in text_slices(pa.array(texts, pa.string())):
        words = Words(data, offs, lower=True)
        out += [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    return out


def make_block(ids: list[int], texts: list[str], similarity: float, recall: float, fewest: int = 1) -> ItemBlock:
    items = word_rows(texts)
    rows_of = defaultdict(list)
    for k, x in enumerate(items):
        if len(x) >= max(fewest, 1):
            rows_of[len(x)].append(k)
    block = ItemBlock(np.array(ids, np.int64), {}, {}, similarity)
    for n, rows in sorted(rows_of.items()):
        words = np.stack([items[k] for k in rows])
        edits, g, _ = block.shape(n)
        table = block.lengths.setdefault(g, np.zeros(1 << BITS, np.uint64))
        for x in words:
            table[(Runs(x).fixed(g) >> U(64 - BITS)).astype(np.int64)] |= U(1) << U(n % 64)
        keys = sample_keys(words, samples_for(words, edits, recall))
        tables = []
        for column in keys.T:
            order = np.argsort(column, kind="stable")
            tables.append((column[order], order))
        block.by_length[n] = (np.array(rows), words, tables)
    return block


def candidate_windows(words: Words, grams: dict[int, np.ndarray], block: ItemBlock):
    """By item length: the window starts that hold enough grams of items of that length."""
    hits = {}
    for g, table in block.lengths.items():
        bits = table[(grams[g] >> U(64 - BITS)).astype(np.int64)]
        hit = np.flatnonzero((bits != 0) & (words.row[: len(grams[g])] == words.row[g - 1 :]))
        hits[g] = hit, bits[hit]
    for n in block.by_length:
        _, g, need = block.shape(n)
        hit, bits = hits[g]
        h = hit[(bits >> U(n % 64)) & U(1) == 1]
        if len(h) < need:
            continue
        # windows that hold the hits k to k + need - 1
        last, first = h[need - 1 :], h[: len(h) - need + 1]
        low = np.maximum(np.maximum(last - (n - g), words.first[words.row[first]]), 0)
        high = np.minimum(first, words.first[words.row[first] + 1] - n)
        low[1:] = np.maximum(low[1:], np.maximum.accumulate(high)[:-1] + 1)
        s = take_ranges(low, np.maximum(high - low + 1, 0))
        if len(s):
            yield n, s


def shared_grams(windows: np.ndarray, items: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each pair, how many of the window's grams the item has; an edit changes as many at most as a gram has words."""
    out = np.empty(len(pairs), np.int64)
    step = max(1, 2_000_000 // windows.shape[1] ** 2)
    for k in range(0, len(pairs), step):
        w, i = pairs[k : k + step].T
        out[k : k + step] = (windows[w][:, :, None] == items[i][:, None, :]).any(2).sum(1)
    return out


def matches_of(words: Words, block: ItemBlock) -> list[tuple[int, int, int, int, int]]:
    """Row, item row, first word, word after the last, distance."""
    if not len(words) or not block.by_length:
        return []
    grams = {g: Runs(words.hash).fixed(g) for g in block.lengths}
    found = []
    for n, starts in candidate_windows(words, grams, block):
        rows, items, tables = block.by_length[n]
        most, g, need = block.shape(n)
        places = np.arange(n - g + 1)
        item_grams = Runs(items.ravel()).fixed(g)[np.arange(len(items))[:, None] * n + places]
        for k in range(0, len(starts), 20_000):
            s = starts[k : k + 20_000]
            x = words.hash[s[:, None] + np.arange(n)]
            keys = sample_keys(x, len(tables))
            pairs = []
            for t, (sorted_keys, order) in enumerate(tables):
                low, high = np.searchsorted(sorted_keys, keys[:, t], "left"), np.searchsorted(sorted_keys, keys[:, t], "right")
                pairs.append(np.repeat(np.arange(len(s)), high - low) * len(items) + order[take_ranges(low, high - low)])
            pairs = np.unique(np.concatenate(pairs))
            pairs = np.stack([pairs // len(items), pairs % len(items)], 1)
            pairs = pairs[shared_grams(grams[g][s[:, None] + places], item_grams, pairs) >= need]
            if not len(pairs):
                continue
            a, b = x[pairs[:, 0]], items[pairs[:, 1]]
            distance = np.where((a == b).all(1), 0, most + 1)
            # windows that overlap an equal one need no closer look
            clear = distance > 0
            for i in np.unique(pairs[distance == 0, 1]) if most else ():
                own = np.flatnonzero(pairs[:, 1] == i)
                at, equal = s[pairs[own, 0]], s[pairs[own[distance[own] == 0], 0]]
                nearest = np.searchsorted(equal, at)
                clear[own] &= (at - equal[np.maximum(nearest - 1, 0)] >= n) | (nearest == 0)
                clear[own] &= (equal[np.minimum(nearest, len(equal) - 1)] - at >= n) | (nearest == len(equal))
            if most and clear.any():
                distance[clear] = edit_distances(a[clear], b[clear], most)
            good = distance <= most
            found += zip(words.row[s[pairs[good, 0]]].tolist(), rows[pairs[good, 1]].tolist(), s[pairs[good, 0]].tolist(), (s[pairs[good, 0]] + n).tolist(), distance[good].tolist(), strict=True)
    kept: dict[tuple[int, int], list] = defaultdict(list)  # disjoint, by first word
    for row, item, a, b, d in sorted(found, key=lambda f: (f[0], f[1], f[4], f[2])):
        own = kept[row, item]
        k = bisect_left(own, (row, item, a))
        if (k == 0 or own[k - 1][3] <= a) and (k == len(own) or own[k][2] >= b):
            own.insert(k, (row, item, a, b, d))
    return [x for v in kept.values() for x in v]


def find_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, fewest: int = 1) -> DataFrame:
    """Returns doc_id, item_id, start_char, end_char (code points, end exclusive), n_words and distance (in words) of
    every benchmark passage found in the documents."""
    if not 0 < similarity <= 1 or not 0 < recall < 1:
        raise ValueError("similarity must be above 0 and at most 1, recall between 0 and 1")
    spark = docs.sparkSession
    usable = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    size = usable.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(1, math.ceil(size[0] / BLOCK_ITEMS), math.ceil((size[1] or 0) / BLOCK_CHARS))
    schema = "doc_id long, item_id long, start_char long, end_char long, n_words int, distance int"
    out = None
    for b in range(blocks):
        rows = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        block = spark.sparkContext.broadcast(make_block([r[0] for r in rows], [r[1] for r in rows], similarity, recall, fewest))

        def make(batch: pa.RecordBatch, block=block):
            ids = batch.column(0)
            for i, _, data, offs in text_slices(batch.column(1)):
                words = Words(data, offs, lower=True)
                found = matches_of(words, block.value)
                if found:
                    code = np.cumsum((data & 0xC0) != 0x80)
                    before = np.append(0, code)[offs]
                    yield [
                        ids.take(pa.array([i + f[0] for f in found])), pa.array(block.value.ids[[f[1] for f in found]]),
                        pa.array([int(code[words.start[f[2]]] - 1 - before[f[0]]) for f in found]), pa.array([int(code[words.end[f[3] - 1] - 1] - before[f[0]]) for f in found]),
                        pa.array([f[3] - f[2] for f in found]), pa.array([f[4] for f in found]),
                    ]

        part = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)
        out = part if out is None else out.union(part)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
