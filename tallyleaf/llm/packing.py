"""Best-fit packing of tokenized documents by exact complements.

Texts are tokenized once; pieces of at most the capacity are counted by length. As there are no more lengths than the
capacity, this histogram has a fixed size whatever the data, and the packing is planned on it: from the longest length on,
gaps are filled exactly by a single length, else by the pair, else by the triple of the longest lengths that do, in bulk, as
often as the counts allow; short pieces are spared in pairs and triples, as what is left then goes into bins by best fit,
longest first. The plan is a short table of patterns (lengths and how often). Pieces get a rank among those of their length, by buckets of a hash so that no length is one group, and look up
their place by it.

Defined results: null and empty texts are the end token alone; a text is never shortened; repeated rows are packed each
for itself; ties in length go by the hash bucket, then by all columns; an empty table gives an empty one. Only the id and
text columns are read. Special tokens' strings in a text are read as the tokenizer's file says.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._frames import cut, map_arrow, read_table

_encoders: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _plain(kind: dict) -> bool:
    """Whether a tokenizer's file says no more than byte-level BPE whose merges are ranked as their results' ids."""
    split, model = kind.get("pre_tokenizer") or {}, kind["model"]
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return (
        kind.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and merged == sorted(set(merged))
    )


def encoder(path: str):
    """text -> token ids (uint32). The file's own library sets the ids. Where the file is a plain byte-level BPE (no
    normalizer, the usual split, merges in the order of their ids, so that both libraries merge alike) and a probe agrees,
    a faster library does the work, but for texts with a special token."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        kind = json.load(open(path, encoding="utf-8"))
        special = [t["content"] for t in kind.get("added_tokens", [])]
        fast = None
        try:
            import tiktoken

            if not _plain(kind):
                raise ValueError("not a plain byte-level BPE")
            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in token): k for token, k in kind["model"]["vocab"].items() if token not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            probe = "It's  a test,\n\n\tÉtait-ce 12345 ½ 字? ¿Qué?  \r\n x_y z! \U0001f600 "
            if fast.encode_ordinary(probe) != slow.encode(probe, add_special_tokens=False).ids:
                fast = None
        except (ImportError, KeyError, ValueError):
            fast = None
        _encoders[path] = slow, fast, special
    slow, fast, special = _encoders[path]

    def encode(text: str) -> np.ndarray:
        if fast is None or any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def token_pieces(docs: DataFrame, path: str, capacity: int, end_token: int) -> DataFrame:
    def make(batch: pa.RecordBatch):
        encode = encoder(path)
        ids, texts = batch.column(0), batch.column(1)
        row, piece, start, length, crc = [], [], [], [], []
        for r in range(batch.num_rows):
            text = texts[r].as_py() or ""
            tokens = np.append(encode(text), np.uint32(end_token)).astype("<u4")
            at, k = 0, 0
            size = len(tokens) % capacity or capacity
            while at < len(tokens):
                row.append(r)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(tokens[at : at + size].tobytes()))
                at, k, size = at + size, k + 1, capacity
        yield [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; every piece is used once, and no pattern exceeds the capacity. Short
    pieces that pairs and triples use up may be missed when the rest is packed, so plans are made that spare the pieces
    under a sixteenth, an eighth or none of the capacity in pairs and triples, and some without these; the one of fewest
    sequences is taken, of equal ones the first."""
    tried = [(3, capacity // 16), (3, capacity // 8), (3, 0), (2, capacity // 16), (1, 0), (0, 0)]
    return min((_plan(histogram, capacity, most, spare) for most, spare in tried), key=lambda p: sum(times for _, times in p))


def _plan(histogram: dict[int, int], capacity: int, most: int, spare: int = 0) -> list[tuple[tuple[int, ...], int]]:
    """A plan that fills the gap of each length, longest first, exactly by one, two or up to ``most`` others, the longest
    that do, as often as the counts allow; then by best fit. Pairs and triples leave pieces under ``spare`` alone."""
    left = {n: c for n, c in histogram.items() if c > 0}
    plan: list[tuple[tuple[int, ...], int]] = []

    def times(lengths: tuple[int, ...]) -> int:
        return min(left.get(n, 0) // lengths.count(n) for n in set(lengths))

    def pair(before: tuple[int, ...], total: int, longest: int) -> tuple[int, ...]:
        """Two lengths of a sum, the first as long as it can be, that are there beside those before."""
        for a in range(min(longest, total - max(spare, 1)), (total - 1) // 2, -1):
            if a >= max(spare, 1) and a in left and total - a in left and times((*before, a, total - a)):
                return a, total - a
        return ()

    def exact(n: int) -> tuple[int, ...]:
        gap = capacity - n
        if not gap or (most >= 1 and times((n, gap))):
            return (n, gap) if gap else (n,)
        found = pair((n,), gap, gap) if most >= 2 else ()
        if found or most < 3:
            return (n, *found) if found else ()
        for a in range(gap - 2 * max(spare, 1), (gap - 1) // 3, -1):
            if a in left and (found := pair((n, a), gap - a, a)):
                return n, a, *found
        return ()

    for n in sorted(left, reverse=True):
        while n in left and (lengths := exact(n)):
            count = times(lengths)
            for m in lengths:
                left[m] -= count
                if not left[m]:
                    del left[m]
            plan.append((lengths, count))
    # best fit, longest first; bins of one pattern are kept together
    gaps: list[int] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if not bins[gap]:
            insort(gaps, gap)
        bins[gap].append((pattern, times))

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                each = min(capacity // n, count)
                put((n,) * each, count // each)
                count %= each
                continue
            gap = gaps[k]
            pattern, times = bins[gap].pop()
            if not bins[gap]:
                gaps.pop(k)
            used = min(times, count)
            if times > used:
                put(pattern, times - used)
            put((*pattern, n), used)
            count -= used
    return plan + [x for some in bins.values() for x in some]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_token: int = 2) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_token))
    histogram = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    first, used, sequence = [], defaultdict(int), 0
    for pattern, times in plan_packing(histogram, capacity):
        at = 0
        for n in pattern:
            first.append((n, used[n], sequence, at))
            used[n] += times
            at += n
        sequence += times
    table = np.array(sorted(first), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((table[:, 0] * (1 << 44) + table[:, 1], table))
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranked = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = (
        ranked.groupBy("length", "bucket").count()
        .select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    )
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = ranked.withColumn("inner", inner).join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inner") - 1).alias("rank"))

    def place(batch: pa.RecordBatch):
        keys, rows = shared.value
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        hit = rows[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1]
        yield [*batch.columns[:5], pa.array(hit[:, 2] + rank - hit[:, 1]), pa.array(hit[:, 3])]

    return map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), default_tokenizer())
