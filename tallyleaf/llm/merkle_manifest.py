"""A Merkle manifest of a dataset: one digest for each language, one over all, and a proof of membership for each row.

Rows are leaves, ranked within their group by a range sort. Runs of 2**levels leaves whose first rank is a multiple of
that are subtrees of the whole tree, so each goes to a builder of its own, which appends nodes to a log in the order in which
they are completed: a leaf, then every node that this leaf completes, and at the end the nodes of incomplete runs from the
lowest level up. That is the tree's postorder. The roots of the blocks are the leaves of the next forest, and so on until
each group is one block; the groups' roots are the leaves of the last tree. The logs are written as tables; a proof is
read from them by place alone, as the place of a node follows from the sizes of the subtrees before it, and goes down
from the last tree: the path of a block continues the path of each of its leaves. Texts are read once, hashed where they
are, and never shuffled; what is shuffled are digests, a block to a task, whatever one group holds.

Digests are SHA-256; inputs are concatenated, digests as lowercase hex text. A row's leaf hashes doc_id, source, lang,
n_chars and text, each ``-`` if null, else its UTF-8 length, ``:`` and its value.

Defined results: leaves ascend by doc_id, nulls first; equal ids by their leaf, and rows that are equal throughout are
leaves of their own. A null language is a group of its own and comes first. A lone leaf is its group's root, and the only
group's root is the dataset's; the proof of a row without any sibling is the hash of nothing. Rows whose doc_id is null
are never tampered with. An empty table has no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import cut, map_arrow, read_table

BLOCK_LEVELS = 10  # a block has 2**10 leaves
DIGEST = 32


def digest(*hexes: bytes) -> bytes:
    """H of nodes: SHA-256 over their hex texts."""
    return hashlib.sha256("".join(h.hex() for h in hexes).encode()).digest()


def height(leaves: int, block: int, levels: int) -> int:
    """Levels above the leaves: a group of one block ends at its root, further blocks are as high as full ones."""
    return (leaves - 1).bit_length() if not block else levels


def position(level: int, index: int, leaves: int) -> int:
    """The place in the log of the node that covers the leaves from index * 2**level on.

    When e leaves are appended, 2 e - popcount(e) full nodes are complete. A full node ends with its last leaf, before
    the higher nodes that end there too; an incomplete one follows all full nodes and the lower incomplete ones."""
    end = (index + 1) << level
    if end <= leaves:
        higher = (end & -end).bit_length() - 1 - level
        return 2 * end - end.bit_count() - higher - 1
    lower = level - 1 - sum(1 for k in range(1, level) if leaves % (1 << k) == 0)
    return 2 * leaves - leaves.bit_count() + lower


def append_log(nodes: list[bytes], block: int, levels: int) -> bytes:
    """The log of one block: its nodes in the order of completion."""
    log: list[bytes] = []
    waiting: list[tuple[int, bytes]] = []  # complete subtrees, lower and lower
    for leaf in nodes:
        level, node = 0, leaf
        log.append(node)
        while waiting and waiting[-1][0] == level:
            level, node = level + 1, digest(waiting.pop()[1], node)
            log.append(node)
        waiting.append((level, node))
    top = height(len(nodes), block, levels)
    level, node = waiting.pop()
    while level < top:
        if waiting and waiting[-1][0] == level:
            node = digest(waiting.pop()[1], node)
        else:
            node = digest(node)
        level += 1
        log.append(node)
    return b"".join(log)


def siblings(log: bytes, leaves: int, block: int, index: int, levels: int) -> bytes:
    """The way from a leaf to its block's root: for each level 0 (none), 1 (on the right) or 2 (on the left) and the sibling."""
    out = []
    for level in range(height(leaves, block, levels)):
        at = (index >> level) ^ 1
        if at << level >= leaves:
            out.append(b"\0")
            continue
        place = DIGEST * position(level, at, leaves)
        out.append((b"\1" if at & 1 else b"\2") + log[place : place + DIGEST])
    return b"".join(out)


def fold(node: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its way lead to, and the hash of the siblings on it."""
    at, said = 0, hashlib.sha256()
    while at < len(path):
        side, other = path[at], path[at + 1 : at + 1 + DIGEST]
        at += 1 + (DIGEST if side else 0)
        if side:
            said.update(other.hex().encode())
        node = digest(node, other) if side == 1 else digest(other, node) if side == 2 else digest(node)
    return node, said.digest()


def rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds the rank from 0 within ``grp`` in an order, by a range sort over groups and order. Rows that tie throughout are
    dealt out by their place in the table."""
    keys = [F.col("grp"), *order, F.monotonically_increasing_id()]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("place", T.LongType())])

    def make() -> object:
        run: dict = {"grp": None, "next": 0}

        def columns(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
            names = np.array(batch.column(batch.schema.get_field_index("grp")).to_pylist(), object)
            n = len(names)
            if not n:
                return
            new = np.flatnonzero(names[1:] != names[:-1]) + 1
            starts = np.concatenate([[0], new])
            base = np.zeros(len(starts), np.int64)
            base[0] = run["next"] if names[0] == run["grp"] else 0
            lengths = np.diff(np.append(starts, n))
            place = np.arange(n) - np.repeat(starts - base, lengths)
            run["grp"], run["next"] = names[-1], int(place[-1]) + 1
            yield [*batch.columns, pa.array(place)]

        return columns

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            for out in columns(batch):
                yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "place"])

    placed = cut(ranged.mapInArrow(numbered, schema))
    # A partition goes on with the group that the one before ended in; no other group of it began elsewhere.
    ends = placed.groupBy("pid").agg(F.min("grp").alias("first"), F.max(F.struct("grp", "place")).alias("last")).orderBy("pid").collect()
    offsets, grp, total = [], None, 0
    for r in ends:  # one for each partition
        off = total if r["first"] == grp else 0
        offsets.append((r["pid"], r["first"], off))
        total = r["last"]["place"] + 1 + (off if r["last"]["grp"] == r["first"] else 0)
        grp = r["last"]["grp"]
    shift = F.broadcast(df.sparkSession.createDataFrame(offsets, "pid int, grp string, off long"))
    return placed.join(shift, ["pid", "grp"], "left").withColumn("rank", F.col("place") + F.coalesce("off", F.lit(0))).drop("pid", "place", "off")


def build_forest(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """The logs of all blocks of leaves (grp, rank, node), then those of the blocks' roots, until each group is one block:
    tables of grp, block, leaves, log and root."""
    forest: list[DataFrame] = []
    while True:

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            order = np.argsort(rows.column("rank").to_numpy())
            nodes = rows.column("node").take(pa.array(order)).to_pylist()
            block = key[1].as_py()
            log = append_log(nodes, block, levels)
            return pa.table({"grp": [key[0].as_py()], "block": pa.array([block], pa.int64()), "leaves": pa.array([len(nodes)], pa.int32()), "log": pa.array([log], pa.binary()), "root": pa.array([log[-DIGEST:]], pa.binary())})

        blocks = leaves.select("grp", F.shiftright("rank", levels).alias("block"), "rank", "node")
        logs = cut(blocks.groupBy("grp", "block").applyInArrow(build, "grp string, block long, leaves int, log binary, root binary"))
        forest.append(logs)
        if not logs.agg(F.max("block")).first()[0]:
            return forest
        leaves = logs.select("grp", F.col("block").alias("rank"), F.col("root").alias("node"))


def lead_down(forest: list[DataFrame], ways: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """From the groups' ways (grp, subroot, root, path) to those of the blocks of the lowest level: grp, block, subroot, root, path."""
    ways = ways.withColumn("block", F.lit(0).cast("long"))

    def spread(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for grp, block, leaves, log, subroot, root, path in zip(*(c.to_pylist() for c in batch.columns)):
            own = [siblings(log, leaves, block, k, levels) + path for k in range(leaves)]
            first = block << levels
            yield [pa.array([grp] * leaves), pa.array(range(first, first + leaves), pa.int64()), pa.array([subroot] * leaves), pa.array([root] * leaves), pa.array(own, pa.binary())]

    for logs in reversed(forest[1:]):
        ways = map_arrow(logs.drop("root").join(ways, ["grp", "block"]).select("grp", "block", "leaves", "log", "subroot", "root", "path"), spread, "grp string, block long, subroot binary, root binary, path binary")
    return ways


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hash_rows(docs: DataFrame) -> DataFrame:
    """doc_id, grp (the language as a key that sorts as asked), node (the leaf) and changed (the leaf with one character
    more in n_chars, where the row is one to tamper with)."""
    ident, more = F.col("doc_id"), F.col("n_chars").cast("decimal(20,0)") + 1
    leaf = lambda n: F.unhex(F.sha2(F.concat(_field(ident), _field(F.col("source")), _field(F.col("lang")), _field(n), _field(F.col("text"))), 256))
    chosen = F.crc32(ident.cast("string").cast("binary")) % 7 == 0
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("grp"), leaf(F.col("n_chars")).alias("node"), F.when(chosen, leaf(more)).alias("changed"))


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """A row for each document: its leaf, the roots, its proof, and where the row as it now is leads to."""
    mask = (1 << levels) - 1
    rows = rank(cut(hash_rows(docs)), [F.col("doc_id"), F.col("node")])
    forest = build_forest(rows.select("grp", "rank", "node"), levels)
    subroots = forest[-1].select(F.lit("").alias("grp"), F.col("grp").alias("lang"), F.col("root").alias("node"))
    ranked = cut(rank(subroots, [F.col("lang")]))
    crown = build_forest(ranked.select("grp", "rank", "node"), levels)
    start = crown[-1].select("grp", F.lit(b"").alias("subroot"), "root", F.lit(b"").alias("path"))
    tops = lead_down(crown, start, levels).join(crown[0].select("grp", "block", "leaves", "log"), ["grp", "block"])

    def lead(key: tuple, rows: pa.Table, top: pa.Table) -> pa.Table:
        if not len(rows) or not len(top):
            return _none(rows)
        t = {c: top.column(c)[0].as_py() for c in ("block", "leaves", "log", "root", "path")}
        paths = [siblings(t["log"], t["leaves"], t["block"], r & mask, levels) + t["path"] for r in rows.column("rank").to_pylist()]
        return pa.table({"grp": rows.column("lang"), "subroot": rows.column("node"), "root": pa.array([t["root"]] * len(paths), pa.binary()), "path": pa.array(paths, pa.binary())})

    def _none(rows: pa.Table) -> pa.Table:
        return pa.table({"grp": pa.array([], pa.string()), "subroot": pa.array([], pa.binary()), "root": pa.array([], pa.binary()), "path": pa.array([], pa.binary())})

    langs = ranked.withColumn("block", F.shiftright("rank", levels))
    ways = langs.groupBy("grp", "block").cogroup(tops.groupBy("grp", "block")).applyInArrow(lead, "grp string, subroot binary, root binary, path binary")
    below = cut(lead_down(forest, ways, levels).join(forest[0].select("grp", "block", "leaves", "log"), ["grp", "block"]))
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [T.StructField("verified", T.BooleanType())])

    def prove(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        cells: list[list] = [[] for _ in range(6)]
        if len(rows) and len(found):
            t = {c: found.column(c)[0].as_py() for c in ("block", "leaves", "log", "subroot", "root", "path")}
            for r, node, changed in zip(*(rows.column(c).to_pylist() for c in ("rank", "node", "changed"))):
                root, proof = fold(changed or node, siblings(t["log"], t["leaves"], t["block"], r & mask, levels) + t["path"])
                for cell, x in zip(cells, (node.hex(), t["subroot"].hex(), t["root"].hex(), proof.hex(), root.hex(), root == t["root"]), strict=True):
                    cell.append(x)
        ids = rows.column("doc_id") if cells[0] else rows.column("doc_id").slice(0, 0)
        return pa.table([ids, *(pa.array(c, pa.string()) for c in cells[:5]), pa.array(cells[5], pa.bool_())], names=out.names)

    leaves = rows.withColumn("block", F.shiftright("rank", levels))
    return leaves.groupBy("grp", "block").cogroup(below.groupBy("grp", "block")).applyInArrow(prove, out)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split(CAST(doc_id AS VARCHAR), '')]), lambda crc, b : list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i : xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_CELL = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_CELL.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS grp, {_LEAF.replace("{n}", "n_chars")} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.replace("{n}", "(n_chars + 1)")} END AS changed FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS size FROM leaves),
nodes (grp, level, idx, node, size) AS (
  SELECT grp, 0, idx, leaf, size FROM ranked UNION ALL
  SELECT grp, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(size) + 1) // 2 FROM nodes WHERE size > 1 GROUP BY grp, level, idx // 2),
subroots AS (SELECT grp, node, level AS height, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops (level, idx, node, size) AS (
  SELECT 0, idx, node, size FROM subroots UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(size) + 1) // 2 FROM tops WHERE size > 1 GROUP BY level, idx // 2),
ends AS (SELECT node AS root, level AS height FROM tops WHERE size = 1),
steps AS (
  SELECT grp, level, idx, node FROM nodes WHERE size > 1 UNION ALL
  SELECT s.grp, s.height + t.level, t.idx, t.node FROM subroots s, tops t WHERE t.size > 1),
ways AS (
  SELECT r.grp, r.idx AS leaf_idx, level, (r.idx >> level) % 2 AS side, xor(r.idx >> level, 1) AS other FROM ranked r JOIN subroots s USING (grp), generate_series(0, s.height - 1) g(level) UNION ALL
  SELECT r.grp, r.idx, s.height + level, (s.idx >> level) % 2, xor(s.idx >> level, 1) FROM ranked r JOIN subroots s USING (grp), ends e, generate_series(0, e.height - 1) g(level)),
found AS (SELECT w.grp, leaf_idx, w.level, side, s.node AS sibling FROM ways w LEFT JOIN steps s ON s.grp = w.grp AND s.level = w.level AND s.idx = w.other),
proofs AS (SELECT grp, leaf_idx, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM found GROUP BY grp, leaf_idx),
folds (grp, idx, level, node) AS (
  SELECT grp, idx, CAST(0 AS BIGINT), coalesce(changed, leaf) FROM ranked UNION ALL
  SELECT f.grp, f.idx, f.level + 1, sha256(CASE WHEN d.side = 0 THEN f.node || coalesce(d.sibling, '') ELSE d.sibling || f.node END)
  FROM folds f JOIN found d ON d.grp = f.grp AND d.leaf_idx = f.idx AND d.level = f.level)
SELECT r.doc_id, r.leaf, s.node AS subroot, e.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = e.root AS verified
FROM ranked r JOIN subroots s USING (grp) CROSS JOIN ends e LEFT JOIN proofs p ON p.grp = r.grp AND p.leaf_idx = r.idx
JOIN folds f ON f.grp = r.grp AND f.idx = r.idx AND f.level = s.height + e.height
"""
