"""Jaccard join of documents by their word n-gram sets, as a blocked sparse matrix product.

1. Every text becomes the set of its distinct n-gram hashes; equal sets form one class, so copies are joined once.
2. Blocking, without loss: with a Jaccard bound t, sets of sizes s <= l differ in at most (s + l)(1 - t)/(1 + t) members.
   Members are dealt by hash to more parts than that bound, fixed per size class, so two linked sets agree on more parts
   than are spare. A document emits one hash for each part, over many different hashes, so none is hot; of copies in one
   batch only the first emits. Pairs that agree on a part of few documents are counted and must reach the number that
   linked sets have. A part of more documents makes no pairs: it counts for each of its documents, and those of which
   it and others like it can make the number are tied to its first one (``candidate_edges``).
3. Candidates fall into clusters. The rows of a cluster's document by n-gram
   matrix go to one task. If there are many, they are dealt to blocks in the order of their sizes, and each pair of
   blocks whose sizes can hold a link goes to a task; alike rows make a short block. There overlap counts are added up over
   blocks of columns (rare columns pair by pair, frequent ones as dense products), pairs and rows that can no longer
   reach the bound that follows from their sizes are dropped, and each row gives its least linked row and its number of
   links: output is linear in rows.
4. Links give components.

Overlaps are of 64-bit hashes. Defined results: null and empty texts, and those without words, have an empty set and are
linked with nothing; with fewer words than n the whole sequence is the only member; rows that share a doc_id count as
one node; rows without a doc_id are linked with nothing and have no component; repeated rows are linked with each other;
an empty table gives an empty one. Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._frames import cut, map_arrow, read_table
from ._graph import components
from ._text import Runs, U, Words, mix, signed, take_ranges, text_slices, unsigned

SPARE = 0.3  # parts beyond the bound, as a share of it: linked sets agree on more parts than these
BUCKET = 24  # up to so many documents of a part are counted in pairs
FREQUENT = 1 << 32
BLOCK_ROWS = 1024
BLOCK_MEMBERS = 500_000
LIGHT = 48  # columns of up to so many rows are added pair by pair
COLUMNS = 1024
PAIRS = 400_000  # added at a time


def gram_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each row, joined, and where each row's begin."""
    words = Words(data, offs, lower=True)
    runs = Runs(words.hash)
    grams = runs.fixed(n)
    count = np.diff(words.first)
    inside = np.maximum(count - n + 1, 0)
    at = take_ranges(words.first[:-1], inside)
    short = np.flatnonzero((count > 0) & (count < n))
    row = np.concatenate([np.repeat(np.arange(words.rows), inside), short])
    h = np.concatenate([grams[at], mix(runs.of(words.first[short], words.first[short + 1]) ^ U(n))])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[keep], h[keep]
    return h, np.searchsorted(row, np.arange(words.rows + 1))


def row_sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def size_classes(bound: Fraction, upto: int) -> np.ndarray:
    """The largest size of each class: partners of a size are in its own class or the next."""
    ends = [1]
    while ends[-1] < upto:
        ends.append(max(ends[-1] + 1, int(ends[-1] / bound)))
    return np.array(ends)


def most_differences(size: np.ndarray, bound: Fraction) -> np.ndarray:
    """Of a set of this size and any linked one that is not smaller."""
    top = (size * bound.denominator) // bound.numerator
    return ((size + top) * (bound.denominator - bound.numerator)) // (bound.denominator + bound.numerator)


def part_hashes(h: np.ndarray, bounds: np.ndarray, bound: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes that each row emits, joined, where each row's begin, and for each hash the number of agreements that a
    linked pair has at least, which is the same for all rows of a size class.

    Linked sets agree on more parts than are spare. Empty parts are not emitted, so that agreements may go unseen by the
    row's empty parts; a row with so many of them that the number would not be reached emits these as well."""
    size = np.diff(bounds)
    ends = size_classes(bound, max(int(size.max(initial=1)), 1))
    differ_of = most_differences(ends, bound)
    agree_of = np.maximum(1, np.ceil(SPARE * differ_of)).astype(np.int64) + 1
    need_of = np.maximum(1, -(-2 * agree_of // 3))
    own = np.searchsorted(ends, size)
    out_row, out, out_need = [], [], []
    mixed = mix(h)
    for back in (0, 1):
        scheme = np.maximum(own - back, 0)
        # without a difference, linked sets are equal and already one class
        use = (size > 0) & (own >= back) & (differ_of[scheme] > 0) & ((back == 0) | (size * bound.numerator <= ends[scheme] * bound.denominator))
        parts = np.where(use, differ_of[scheme] + agree_of[scheme], 0)
        base = np.cumsum(parts) - parts
        member_row = np.repeat(np.arange(len(size)), size)
        member = np.flatnonzero(use[member_row])
        rows = member_row[member]
        cell = base[rows] + ((mixed[member] >> U(11)) % parts[rows].astype(np.uint64)).astype(np.int64)
        total = int(parts.sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, cell, mixed[member])
        filled = np.bincount(cell, minlength=total) > 0
        row = np.repeat(np.arange(len(size)), parts)
        part = np.arange(total) - np.repeat(base, parts)
        seen = agree_of[scheme] - (np.bincount(row, ~filled, len(size)).astype(np.int64) if total else 0)
        emit = filled | (seen < need_of[scheme])[row]
        tag = mix((np.repeat(scheme, parts).astype(np.uint64) << U(32)) + part.astype(np.uint64))
        out_row.append(row[emit])
        out.append(mix(sums[emit] + tag[emit]))
        out_need.append(need_of[scheme][row[emit]])
    row = np.concatenate(out_row)
    order = np.argsort(row, kind="stable")
    return np.concatenate(out)[order], np.searchsorted(row[order], np.arange(len(size) + 1)), np.concatenate(out_need)[order]


def _keys(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return row_sums(mix(h ^ U(0x5851F42D4C957F2D)), bounds), row_sums(mix(h ^ U(0x14057B7EF767814F)), bounds)


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size, k1, k2 (the identity of the set)."""

    def make(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for i, j, data, offs in text_slices(batch.column(1)):
            h, bounds = gram_sets(data, offs, n)
            k1, k2 = _keys(h, bounds)
            yield [batch.column(0)[i:j], pa.array(np.diff(bounds)), pa.array(signed(k1)), pa.array(signed(k2))]

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text")), make, "doc_id long, size long, k1 long, k2 long")


def part_table(docs: DataFrame, n: int, bound: Fraction) -> DataFrame:
    """part, doc, need: the part hashes of every document, and how many agreements a linked pair has at least. Of equal sets in one slice of a batch only the first emits its hashes,
    which thins out large groups of copies before the shuffle; the others have the same class anyway."""

    def make(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for i, _, data, offs in text_slices(batch.column(1)):
            h, bounds = gram_sets(data, offs, n)
            k1, k2 = _keys(h, bounds)
            first = np.sort(np.unique(np.stack([k1, k2], 1), axis=0, return_index=True)[1])
            size = np.diff(bounds)[first]
            h = h[take_ranges(bounds[:-1][first], size)]
            p, at, need = part_hashes(h, np.append(0, np.cumsum(size)), bound)
            yield [pa.array(signed(p)), batch.column(0).take(pa.array(np.repeat(i + first, np.diff(at)))), pa.array(need, pa.int32())]

    return map_arrow(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text")), make, "part long, doc long, need int")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part and document: pairs a, b that agree on a part, with how often (n) and how often a linked pair
    does (need). A frequent part, of more than BUCKET documents, has no pairs: each of its documents, the first one too,
    is told its first one as ``a`` with an n of FREQUENT, so that output stays linear."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("need", pa.int32())])
    part, doc, need = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    frequent = False  # whether the open run has been cut to its first row

    def closed(part, doc, need, told, is_open):
        """Of whole runs; ``told``: the first one goes on a run whose first row has been told; ``is_open``: the last one
        goes on and is frequent."""
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        size = np.diff(np.append(first, len(part)))
        a, b, n, least = [], [], [], []
        star = size > BUCKET
        star[0] |= told
        star[-1] |= is_open
        for k in np.unique(size[(size > 1) & ~star]):
            at = first[(size == k) & ~star]
            i, j = np.triu_indices(int(k), 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            a.append(doc[x])
            b.append(doc[y])
            n.append(np.ones(len(x), np.int64))
            least.append(np.minimum(need[x], need[y]))
        skip = np.zeros(len(first), np.int64)
        skip[0] = told
        at = take_ranges((first + skip)[star], (size - skip)[star])
        a.append(np.repeat(doc[first[star]], (size - skip)[star]))
        b.append(doc[at])
        n.append(np.full(len(at), FREQUENT))
        least.append(need[at])
        a, b, n, least = (np.concatenate(x) for x in (a, b, n, least))
        keep = (a != b) | (n >= FREQUENT)
        a, b, n, least = a[keep], b[keep], n[keep], least[keep]
        if not len(a):
            return None
        order = np.lexsort((b, a))
        a, b, n, least = a[order], b[order], n[order], least[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.add.reduceat(n, first)), pa.array(np.minimum.reduceat(least, first), pa.int32())], schema=schema)

    for batch in batches:
        part, doc, need = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((part, doc, need)))
        if not len(part):
            continue
        last = int(np.searchsorted(part, part[-1], "left"))
        if last:
            done = closed(part[:last], doc[:last], need[:last], frequent, False)
            if done is not None:
                yield done
            part, doc, need, frequent = part[last:], doc[last:], need[last:], False
        if len(part) > BUCKET:
            done = closed(part, doc, need, frequent, True)
            if done is not None:
                yield done
            part, doc, need, frequent = part[:1], doc[:1], need[:1], True
    if len(part):
        done = closed(part, doc, need, frequent, False)
        if done is not None:
            yield done


def candidate_edges(agreeing: DataFrame) -> DataFrame:
    """agreeing: what _candidates gives. Returns a, b: a graph in which linked documents are connected.

    A linked pair agrees on ``need`` parts, each frequent or not. So it is among the pairs of parts that are not frequent,
    if its agreements there and the frequent parts that both have make the number; or it agrees on frequent parts alone,
    and then each of the two has so many of them and is tied to their first documents. A document with a few frequent
    parts, such as one of a passage that many documents share, is tied to nothing by these."""
    pairs = cut(agreeing.groupBy("a", "b").agg((F.sum("n") % FREQUENT).alias("n"), F.floor(F.sum("n") / FREQUENT).alias("times"), F.min("need").alias("need")))
    frequent = pairs.filter("times > 0").groupBy("b").agg(F.sum("times").alias("parts"), F.min("need").alias("least"))
    enough = pairs.filter("a <> b and n >= need").select("a", "b")
    in_both = (
        pairs.filter("a <> b and n between 1 and need - 1").join(frequent.select("b", F.col("parts").alias("pb")), "b")
        .join(frequent.select(F.col("b").alias("a"), F.col("parts").alias("pa")), "a").filter("n + least(pa, pb) >= need").select("a", "b")
    )
    ties = cut(
        pairs.filter("times > 0").select("a", "b").join(frequent.filter("parts >= least").select("b"), "b")
        .groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("firsts"))
    )
    # a document is tied to the least of its first ones, and these to each other: of equal lists once
    firsts = ties.groupBy("firsts").agg(F.count("*")).select(F.col("firsts")[0].alias("a"), F.explode("firsts").alias("b"))
    return enough.union(in_both).union(ties.select(F.col("firsts")[0].alias("a"), "b").filter("a <> b")).union(firsts.filter("a <> b").distinct())


def overlaps(h: np.ndarray, bounds: np.ndarray, bound: Fraction) -> np.ndarray:
    """The boolean matrix of linked rows, by adding up overlaps over blocks of columns. Members are distinct in a row."""
    size = np.diff(bounds)
    rows = len(size)
    # |A and B| >= need, from |A and B| >= t |A or B|
    top, under = bound.numerator, bound.denominator + bound.numerator
    need = -(-(top * (size[:, None] + size[None, :])) // under)
    fits = (np.minimum(size[:, None], size[None, :]) * bound.denominator >= bound.numerator * np.maximum(size[:, None], size[None, :])) & (size[:, None] > 0)
    row = np.repeat(np.arange(rows), size)
    order = np.argsort(h, kind="stable")
    hs, rs = h[order], row[order]
    first = np.flatnonzero(np.append(True, hs[1:] != hs[:-1])) if len(hs) else np.zeros(0, np.int64)
    seen = np.diff(np.append(first, len(hs)))
    count = np.zeros(rows * rows, np.int32)
    for d in np.unique(seen[(seen > 1) & (seen <= LIGHT)]):
        cols = first[seen == d]
        a, b = np.triu_indices(int(d), 1)
        step = max(1, PAIRS // len(a))
        for k in range(0, len(cols), step):
            block = rs[cols[k : k + step, None] + np.arange(d)]
            np.add.at(count, (block[:, a] * rows + block[:, b]).ravel(), 1)
    count = count.reshape(rows, rows)
    count = count + count.T
    heavy = np.flatnonzero(seen > LIGHT)
    heavy = heavy[np.argsort(seen[heavy], kind="stable")]
    where = take_ranges(first[heavy], seen[heavy])
    column = np.repeat(np.arange(len(heavy)), seen[heavy])
    left = np.bincount(rs[where], minlength=rows)
    for k in range(0, len(heavy), COLUMNS):
        alive = fits & (count + np.minimum(left[:, None], left[None, :]) >= need)
        np.fill_diagonal(alive, False)
        live = np.flatnonzero(alive.any(1))
        if not len(live):
            break
        mine = (column >= k) & (column < k + COLUMNS)
        at = np.full(rows, -1)
        at[live] = np.arange(len(live))
        r, c = at[rs[where[mine]]], column[mine] - k
        dense = np.zeros((len(live), min(COLUMNS, len(heavy) - k)), np.float32)
        dense[r[r >= 0], c[r >= 0]] = 1
        count[np.ix_(live, live)] += (dense @ dense.T).astype(np.int32)
        left -= np.bincount(rs[where[mine]], minlength=rows)
    linked = fits & (count >= need)
    np.fill_diagonal(linked, False)
    return linked


def least_linked(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id in each row's component."""
    a, b = np.nonzero(linked)
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return label
        label = new


LINKS = "node long, root long, links long"


def _links(ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], bound: Fraction, apart: np.ndarray) -> list[pa.Array]:
    """The columns of LINKS: one row for each row of a product: its id, the least id linked with it here, and its number of links. Only rows whose
    ``apart`` allows it are compared; it is given as a boolean matrix."""
    linked = overlaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), bound) & apart
    return [pa.array(ids), pa.array(least_linked(linked, ids)), pa.array((linked @ copies.astype(np.float64)).astype(np.int64))]


def _distinct_rows(batches: Iterator[pa.RecordBatch], keys: int, full) -> Iterator[tuple]:
    """Lists of rows (key columns, node, copies, members) with whole runs of equal keys; ``full(key, rows, members)`` tells
    whether a list is closed at the next new key. Rows that share doc_id and text come once for each; one is enough."""
    held: dict[tuple, tuple] = {}
    members, before = 0, None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(keys + 2)]
        for row in zip(*columns, batch.column(keys + 2), strict=True):
            key = row[:keys]
            if held and key != before and (full(key, len(held), members) or full(before, len(held), members)):
                yield list(held.values())
                held, members = {}, 0
            at = (key, row[keys])
            if at not in held:
                held[at] = (*row[:-1], np.frombuffer(row[-1].as_buffer(), np.uint64).copy())
                members += len(held[at][-1])
            before = key
    if held:
        yield list(held.values())


BLOCKS = LINKS + ", cluster long, block int, body binary"


def _first_products(bound: Fraction):
    """Rows cluster, block, node, copies, members, sorted by both. Clusters without blocks become links, several small ones
    in one product; each block of the others becomes one row cluster, block, body."""
    schema = to_arrow_schema(T.StructType.fromDDL(BLOCKS))

    def out(links: list[pa.Array] | None, cluster: int, block: int, body: bytes | None) -> pa.RecordBatch:
        columns = links if links is not None else [pa.nulls(1, pa.int64())] * 3
        if body is None:
            return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), f.type) for f in list(schema)[3:])], schema=schema)
        return pa.RecordBatch.from_arrays([*columns, pa.array([cluster], pa.int64()), pa.array([block], pa.int32()), pa.array([body], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed = lambda key, n, members: key[1] is not None or n >= BLOCK_ROWS // 4 or members > BLOCK_MEMBERS // 2
        for rows in _distinct_rows(batches, 2, closed):
            if rows[0][1] is None:
                cluster, ids, copies = (np.array([r[k] for r in rows]) for k in (0, 2, 3))
                yield out(_links(ids, copies, [r[4] for r in rows], bound, cluster[:, None] == cluster[None, :]), 0, 0, None)
            else:
                yield out(None, rows[0][0], rows[0][1], packed_block(rows))

    return run


def packed_block(rows: list[tuple]) -> bytes:
    """A block of the matrix. Its columns are numbered by falling frequency and its rows are lists of steps between their
    columns, which a codec makes short where rows are alike."""
    size = np.array([len(r[4]) for r in rows])
    names, back, seen = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True, return_counts=True)
    order = np.argsort(-seen, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    row = np.repeat(np.arange(len(rows)), size)
    column = place[back][np.lexsort((place[back], row))]
    steps = np.diff(column, prepend=0)
    start = (np.cumsum(size) - size)[size > 0]
    steps[start] = column[start]
    raw = [np.array([len(rows), len(names)]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), size, names[order].view(np.int64), steps]
    body = np.concatenate(raw).astype(np.int64).tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, copies and sets of a block."""
    x = np.frombuffer(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True), np.int64)
    n, names = int(x[0]), int(x[1])
    ids, copies, size = x[2 : 2 + n], x[2 + n : 2 + 2 * n], x[2 + 2 * n : 2 + 3 * n]
    members, steps = x[2 + 3 * n : 2 + 3 * n + names].view(np.uint64), x[2 + 3 * n + names :]
    ends = np.cumsum(size)
    return ids, copies, [members[np.cumsum(steps[b - s : b])] for b, s in zip(ends, size, strict=True)]


def _pair_products(bound: Fraction):
    """Rows cluster, i, j, block, body, sorted by the first three: the product of one block with itself or another one."""
    schema = to_arrow_schema(T.StructType.fromDDL(LINKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first = None, b""
        for batch in batches:
            for *unit, body in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if unit[1] == unit[2]:
                    ids, copies, sets = _unpacked(body)
                    yield pa.RecordBatch.from_arrays(_links(ids, copies, sets, bound, np.True_), schema=schema)
                elif unit != before:
                    before, first = unit, body
                else:
                    (ids, copies, sets), (other, more, others) = _unpacked(first), _unpacked(body)
                    side = np.repeat([0, 1], [len(ids), len(other)])
                    yield pa.RecordBatch.from_arrays(_links(np.append(ids, other), np.append(copies, more), sets + others, bound, side[:, None] != side[None, :]), schema=schema)

    return run


def block_table(cluster: DataFrame) -> DataFrame:
    """cluster, size, first, rows, share: where the rows of each size begin among the blocks of their cluster, in blocks, and
    how many and how wide they are, for clusters of more than one block. Blocks hold rows of about one size."""
    by_size = cluster.groupBy("cluster", "size").agg(F.count("*").alias("rows"))
    width = F.greatest(F.col("rows") / BLOCK_ROWS, F.col("rows") * F.col("size") / BLOCK_MEMBERS)
    upto = F.sum("share").over(Window.partitionBy("cluster").orderBy("size"))
    total = F.sum("share").over(Window.partitionBy("cluster"))
    return by_size.withColumn("share", width).withColumns({"first": upto - F.col("share"), "total": total}).filter("total > 1").drop("total")


def jaccard_classes(docs: DataFrame, n: int = 3, similarity: str = "0.9") -> DataFrame:
    """docs: doc_id, text. Returns per row doc_id, n_shingles, component_id and n_links (rows linked with it directly)."""
    bound = Fraction(similarity)
    if not 0 < bound <= 1:
        raise ValueError("the similarity is over 0 and at most 1")
    sets = cut(set_table(docs, n))
    classes = cut(sets.filter("size > 0 and doc_id is not null").groupBy("k1", "k2", "size").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")))
    node_of = sets.join(classes, ["k1", "k2", "size"]).select("doc_id", "node").distinct()
    agreeing = part_table(docs, n, bound).repartition("part").sortWithinPartitions("part", "doc").mapInArrow(_candidates, "a long, b long, n long, need int")
    edges = (
        candidate_edges(agreeing).join(node_of.select(F.col("doc_id").alias("a"), F.col("node").alias("na")), "a")
        .join(node_of.select(F.col("doc_id").alias("b"), F.col("node").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    )
    near = components(edges)
    cluster = cut(classes.join(near, "node").withColumnRenamed("component", "cluster"))
    blocks = cut(block_table(cluster))
    placed = cut(
        cluster.join(blocks, ["cluster", "size"], "left")
        .withColumn("block", F.floor(F.col("first") + F.col("share") * (F.pmod(F.xxhash64("node", "k1"), "rows") / F.col("rows"))).cast("int")).drop("first", "rows", "share")
    )
    # sizes of linked rows differ by the bound at most, so most pairs of blocks of unlike sizes are never made
    range_of = placed.filter("block is not null").groupBy("cluster", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    left, right = (range_of.select("cluster", F.col("block").alias(k), F.col("low").alias(f"{k}_low"), F.col("high").alias(f"{k}_high")) for k in "ij")
    units = left.join(right, "cluster").filter("i <= j").filter(F.col("i_high") * bound.denominator >= F.col("j_low") * bound.numerator)
    units = units.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))

    def members(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        k1, k2 = (unsigned(batch.column(k).to_numpy()) for k in (2, 3))
        for i, j, data, offs in text_slices(batch.column(5)):
            h, bounds = gram_sets(data, offs, n)
            a, b = _keys(h, bounds)
            same = np.flatnonzero((a == k1[i:j]) & (b == k2[i:j]))
            some = [batch.column(k)[i:j].take(pa.array(same)) for k in (1, 6, 0, 4)]
            yield [*some, pa.array([h[bounds[r] : bounds[r + 1]].tobytes() for r in same], pa.binary())]

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    rows = map_arrow(placed.hint("merge").join(texts, "node").select("node", "cluster", "k1", "k2", "copies", "text", "block"), members, "cluster long, block int, node long, copies long, members binary")
    first = cut(rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(_first_products(bound), BLOCKS))
    pairs = first.filter("body is not null").select("cluster", "block", "body").join(units, ["cluster", "block"]).select("cluster", "i", "j", "block", "body")
    pairs = pairs.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_pair_products(bound), LINKS)
    links = cut(first.filter("body is null").select("node", "root", "links").union(pairs))
    linked = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = (
        classes.select("k1", "k2", "size", "node", "copies")
        .join(linked, "node", "left").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .select("k1", "k2", "size", F.coalesce("component", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return (
        sets.join(facts, ["k1", "k2", "size"], "left")
        .select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"), 3, "0.9")
