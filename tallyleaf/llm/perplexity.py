"""Quality rules: plain counts of words, symbols and repeats, and bands of perplexity under a model of all documents.

The model is a modified Kneser-Ney model of byte n-grams for each language, counted over each distinct text once (so that
thousands of copies say no more than one text). An n-gram of up to seven bytes is packed into a long, a hash without
collisions. Texts are dealt into slices by their digest, copies dropped on the way; each slice lists its n-grams with
counts in arrays by bucket. Spark sums these counts, derives from the highest order the continuation counts of the lower
ones, discounts by counts of counts, and interpolates order by order with joins on prefix and suffix. The model is stored
as sorted arrays of hashes with their bits, one pair of arrays for each language and bucket; a slice's arrays meet the
model's by language and bucket, are looked up by binary search, and go back to the slice, where its texts are scored.
So neither the counts nor the model are ever held whole anywhere, and both grow with the corpus.

A text has two perplexities, in bits for each byte and for each word. Each language's centre and spread of both (median
and quartile distance over its distinct texts; of all languages together where it has under FEW_TEXTS) make a scale, wider
for short texts; a document is kept between a lower and an upper edge on both scales. Edges are fitted on all labelled rows,
clean rows counting twice: as an edge can only be one of STEPS, Spark counts the rows by the steps that they lie between, and
what is fitted on is that table, of bounded size whatever the rows. Without 50 rows of each label edges are EDGES.

Defined results: null texts are empty; texts of under 20 words fail the base rule and need no band. A null language is a
language of its own. Repeated rows and ids are judged row by row, equal texts of a language alike. Labels given more than
once count by the least. An empty table gives an empty one. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._frames import cut, give_back, hold_batches, map_arrow, read_table
from ._text import U, Runs, Words, mix, take_ranges

ORDER = 5
BUCKETS = 251
SLICE_BYTES = 32 << 20
HELD_BYTES = 16 << 20  # of texts that a task packs at a time
BATCH_BYTES = 8 << 20  # of lists of n-grams that go to a task at a time
ROW_BUCKETS = 16  # that come from a task at a time
PART_BYTES = 1 << 19
FEW_TEXTS = 100
SHORT_WORDS = 100
EDGES = (-3.0, 3.0, -3.0, 3.0)  # lower and upper for bytes, then for words
STEPS = tuple(float(x) for x in np.arange(0.5, 8.05, 0.1))
CUTS = tuple(sorted({*EDGES, *STEPS, *(-x for x in STEPS)}))

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CHUNK = "slice int, d1 array<long>, d2 array<long>, lang array<string>, size array<int>, body binary"
_SCORES = "d1 long, d2 long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double, n_bytes long"


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with their language as a key and the digest of language and text."""
    text, lang = F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    return docs.select("doc_id", lang.alias("lang"), text.alias("text"), F.xxhash64(lang, text).alias("d1"), F.xxhash64(F.lit(13), text, lang).alias("d2"))


def count_slices(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    return max(1, -(-(total or 0) // slice_bytes))


def deal_out(docs: DataFrame, slices: int) -> DataFrame:
    """Distinct texts of each task, packed by slice: a row for what a task has for a slice."""
    import zstandard

    hold_batches(docs.sparkSession)
    rows = keyed(docs).select(F.pmod("d1", F.lit(slices)).cast("int").alias("slice"), "d1", "d2", "lang", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            where, first = np.unique(np.stack([t.column(c).to_numpy() for c in ("slice", "d1", "d2")]), axis=1, return_index=True)
            t = t.take(pa.array(first))
            cuts = np.flatnonzero(np.diff(where[0], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(first))):
                texts = [x.encode() for x in t.column("text").slice(a, b - a).to_pylist()]
                cells = [[int(where[0][a])], *([t.column(c).slice(a, b - a).to_pylist()] for c in ("d1", "d2", "lang")), [[len(x) for x in texts]], [press.compress(b"".join(texts))]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cells, (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()))], names=["slice", "d1", "d2", "lang", "size", "body"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD_BYTES:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)
        held.clear()
        give_back()

    return rows.mapInArrow(pack, _CHUNK)


def _texts(chunks: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[bytes]]]:
    """The distinct texts of a slice by language, in parts of about PART_BYTES: language, digests and texts."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    seen: set[tuple[int, int]] = set()
    found: dict[str, list] = {}
    for batch in chunks:
        for d1, d2, langs, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "lang", "size", "body"))):
            raw, at = press.decompress(body, max_output_size=sum(sizes)) if any(sizes) else b"", 0
            for a, b, lang, n in zip(d1, d2, langs, sizes):
                if (a, b) not in seen:
                    seen.add((a, b))
                    found.setdefault(lang, []).append((a, b, raw[at : at + n]))
                at += n
    for lang in sorted(found):
        part, size = [], 0
        for row in found.pop(lang):
            part.append(row)
            size += len(row[2])
            if size >= PART_BYTES:
                yield lang, *_columns(part)
                part, size = [], 0
        if part:
            yield lang, *_columns(part)


def _columns(part: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], np.int64), [r[2] for r in part]


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each byte of each text and at its end (a line break, as before its start), and how
    many each text has."""
    head = b"\n" * (order - 1)
    data = np.frombuffer(b"".join(head + t + b"\n" for t in texts), np.uint8).astype(np.int64)
    counts = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    packed = np.zeros(max(0, len(data) - order + 1), np.int64)
    for k in range(order):
        packed = (packed << 8) | data[k : k + len(packed)]
    starts = np.cumsum(counts + order - 1) - (counts + order - 1)
    return packed[take_ranges(starts, counts)], counts


def _by_bucket(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted n-grams by bucket, and where each bucket begins in it."""
    bucket = (grams % BUCKETS).astype(np.uint8)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(BUCKETS + 1))


def add_grams(have: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Sorted n-grams, with or without their counts, and the sorted n-grams of a smaller part put among them."""
    g, at = more[0], np.searchsorted(have[0], more[0])
    new = np.ones(len(g), bool)
    inside = at < len(have[0])
    new[inside] = have[0][at[inside]] != g[inside]
    for n, c in zip(have[1:], more[1:]):
        n[at[~new]] += c[~new]
    return tuple(np.insert(x, at[new], y[new]) for x, y in zip(have, more))


def list_grams(chunks: DataFrame, order: int = ORDER) -> DataFrame:
    """For each slice, language and bucket the sorted n-grams of its distinct texts with their counts."""

    def listed(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, ...]] = {}
        for lang, _, _, texts in _texts(rows):
            part = np.unique(grams_of(texts, order)[0], return_counts=True)
            sums[lang] = add_grams(sums[lang], part) if lang in sums else part
        for lang in list(sums):
            g, n = sums.pop(lang)
            by, at = _by_bucket(g)
            full = np.flatnonzero(np.diff(at))
            for k in range(0, len(full), ROW_BUCKETS):
                own = full[k : k + ROW_BUCKETS]
                a, b = at[own[0]], at[own[-1] + 1]
                offs = pa.array(np.append(at[own], b) - a, pa.int32())
                lists = [pa.ListArray.from_arrays(offs, pa.array(x[by[a:b]], pa.int64())) for x in (g, n)]
                yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(own), pa.int32()), pa.array([lang] * len(own), pa.string()), pa.array(own, pa.int32()), *lists], names=["slice", "lang", "bucket", "grams", "counts"])
            del g, n, by
        give_back()

    return chunks.groupBy("slice").applyInArrow(listed, "slice int, lang string, bucket int, grams array<long>, counts array<long>")


def fit_model(listed: DataFrame, order: int = ORDER) -> DataFrame:
    """The interpolated probability of every n-gram, as sorted arrays of hashes and of bits by language and bucket."""
    top = listed.select("lang", F.explode(F.arrays_zip("grams", "counts")).alias("g")).groupBy("lang", F.col("g.grams").alias("gram")).agg(F.sum("g.counts").alias("c"))
    tables = {order: cut(top)}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << 8 * k) - 1)
        tables[k] = cut(tables[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("c")))
    every = None
    for k, t in tables.items():
        own = t.groupBy("lang").agg(*[F.count(F.when(F.col("c") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]).withColumn("k", F.lit(k))
        every = own if every is None else every.unionByName(own)
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    part = lambda i: F.greatest(F.lit(0.0), F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))).otherwise(F.lit(0.0))).alias(f"d{i}")
    discounts = cut(every.select("lang", "k", part(1), part(2), part(3)))  # a row for each language and order
    below = None
    for k in range(1, order + 1):
        context = Window.partitionBy("lang", F.shiftright("gram", 8))
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = tables[k].join(discounts.filter(F.col("k") == k), "lang").select("lang", "gram", "c", d.alias("d"))
        own = own.withColumn("total", F.sum("c").over(context)).withColumn("spare", F.sum("d").over(context) / F.col("total"))
        own = own.select("lang", "gram", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("suffix"), ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "spare")
        if below is None:
            own = own.withColumn("lower", F.lit(1 / 256))
        else:
            own = own.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        below = own.select("lang", "gram", (F.col("own") + F.col("spare") * F.col("lower")).alias("p"))
    pairs = F.array_sort(F.collect_list(F.struct("gram", (-F.log2("p")).cast("float").alias("bits"))))
    return below.groupBy("lang", F.pmod("gram", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(pairs.alias("m")).select("lang", "bucket", F.col("m.gram").alias("hashes"), F.col("m.bits").alias("bits"))


def look_up(listed: DataFrame, model: DataFrame) -> DataFrame:
    """The bits of each slice's n-grams, in the order in which the slice lists them."""

    def found(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        slices, lang, bucket, grams, hashes, bits = batch.columns
        out = []
        for g, h, b in zip(grams, hashes, bits):
            g, h, b = (x.values.to_numpy(zero_copy_only=False) for x in (g, h, b))
            at = np.searchsorted(h, g)
            if len(g) and (at[-1] >= len(h) or not np.array_equal(h[at], g)):
                raise ValueError("an n-gram of the texts is not in the model")
            out.append(b[at])
        yield [slices, lang, bucket, pa.array(out, pa.list_(pa.float32()))]
        give_back()

    both = listed.select("slice", "lang", "bucket", "grams").join(model, ["lang", "bucket"])
    return map_arrow(both.select("slice", "lang", "bucket", "grams", "hashes", "bits"), found, "slice int, lang string, bucket int, bits array<float>")


def base_counts(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = Words(data, offs)
    n_words = np.diff(words.first)
    whole = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(whole[words.end] - whole[words.start])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    repeat = np.zeros(len(words) + 1, np.int64)
    begins = take_ranges(words.first[:-1], np.maximum(n_words - 7, 0))
    if len(begins):
        runs = Runs(words.hash).of(begins, begins + 8)
        _, back, n = np.unique(runs ^ mix(words.row[begins].astype(np.uint64) + U(1)), return_inverse=True, return_counts=True)
        twice = begins[n[back] > 1]
        np.add.at(repeat, twice, 1)
        np.add.at(repeat, twice + 8, -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(repeat[:-1]) > 0)])
    dup = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        dup[k] = len(lines) - len(set(lines))
    return [n_words, np.diff(chars[words.first]), np.diff(symbols[offs]), dup, np.diff(repeated[words.first])]


def score_texts(chunks: DataFrame, answers: DataFrame, order: int = ORDER) -> DataFrame:
    """For each distinct text of a language its counts and its bits under the model."""

    def made(rows: pa.Table, bits: pa.Table) -> pa.Table:
        parts = list(_texts(rows.to_batches()))
        known: dict[str, tuple[np.ndarray, ...]] = {}
        for lang, _, _, texts in parts:
            g = (np.unique(grams_of(texts, order)[0]),)
            known[lang] = add_grams(known[lang], g) if lang in known else g
        table = {}
        for lang, (g,) in known.items():
            by, at = _by_bucket(g)
            table[lang] = at, by, np.full(len(g), np.nan, np.float32)
        for batch in bits.to_batches():
            for lang, bucket, b in zip(batch.column("lang").to_pylist(), batch.column("bucket").to_pylist(), batch.column("bits")):
                at, by, value = table[lang]
                value[by[at[bucket] : at[bucket + 1]]] = b.values.to_numpy(zero_copy_only=False)
        table = {lang: value for lang, (_, _, value) in table.items()}
        if any(np.isnan(value).any() for value in table.values()):
            raise ValueError("an n-gram of the texts has no bits")
        out: list[list] = [[] for _ in range(10)]
        for lang, d1, d2, texts in parts:
            g, n = grams_of(texts, order)
            sums = np.concatenate([[0], np.cumsum(table[lang][np.searchsorted(known[lang][0], g)], dtype=np.float64)])
            ends = np.cumsum(n)
            for cell, x in zip(out, (d1, d2, [lang] * len(texts), *base_counts(texts), sums[ends] - sums[ends - n], n)):
                cell.extend(x)
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in _SCORES.split(", ")])

    def scored(key: tuple, rows: pa.Table, bits: pa.Table) -> pa.Table:
        found = made(rows, bits)
        give_back()
        return found

    return chunks.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(scored, _SCORES)


def score(docs: DataFrame, order: int = ORDER, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Counts and bits of each distinct text of each language, under the model of all of them."""
    hold_batches(docs.sparkSession, BATCH_BYTES)
    slices = count_slices(docs, slice_bytes)
    chunks = deal_out(docs, slices)
    listed = cut(list_grams(chunks, order))
    model = cut(fit_model(listed, order))
    return cut(score_texts(chunks, look_up(listed, model), order))


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def place(scores: DataFrame) -> DataFrame:
    """Adds base_failed, bits_per_byte, bits_per_word and where both stand on their language's scale (z_byte, z_word)."""
    measured = scores.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("bits_per_byte", F.col("bits") / F.col("n_bytes")).withColumn("bits_per_word", F.when(F.col("n_words") > 0, F.col("bits") / F.col("n_words")))
    good = measured.filter("NOT base_failed")
    spread = [F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c[5:]) for c in ("bits_per_byte", "bits_per_word")]
    own = good.groupBy("lang").agg(F.count("*").alias("texts"), *spread)
    every = good.agg(*spread).first()  # one row
    chosen = [F.when(F.col("texts") >= FEW_TEXTS, F.col(c)).otherwise(F.array(*[F.lit(float(x)) for x in every[c] or (0, 0, 0)])).alias(c) for c in ("per_byte", "per_word")]
    scales = cut(own.select("lang", *chosen))
    wide = F.sqrt(1 + SHORT_WORDS / F.greatest(F.col("n_words"), F.lit(1)))
    z = [((F.col(f"bits_{c}") - F.col(c)[1]) / (F.greatest(F.col(c)[2] - F.col(c)[0], F.lit(1e-3)) * wide)).alias(f"z_{c[4:]}") for c in ("per_byte", "per_word")]
    return measured.join(scales, "lang", "left").select(*measured.columns, *z)


def cell_rows(rows: DataFrame) -> DataFrame:
    """z_byte, z_word, quality and n: how many rows lie between the same CUTS, or on one, with a value that lies there too."""

    def between(c: str) -> Column:
        below = F.size(F.filter(F.array(*[F.lit(x) for x in CUTS]), lambda x: x < F.col(c)))
        inner = [(a + b) / 2 for a, b in zip(CUTS, CUTS[1:])]
        inside = F.element_at(F.array(*[F.lit(x) for x in (CUTS[0] - 1, *inner, CUTS[-1] + 1)]), below + 1)
        return F.when(F.col(c).isNull() | F.isnan(c), None).when(F.col(c).isin(*CUTS), F.col(c)).otherwise(inside).alias(c)

    return rows.select(between("z_byte"), between("z_word"), "quality").groupBy("z_byte", "z_word", "quality").agg(F.count("*").alias("n"))


def fit_edges(rows: list[tuple]) -> tuple[float, ...]:
    """Edges of both scales that lose fewest clean rows (twice their share) and keep fewest bad ones, one edge at a time. A
    row may say after its label how many rows it stands for."""
    good, n = np.array([r[2] == 1 for r in rows], bool), np.array([r[3] if len(r) > 3 else 1 for r in rows], np.int64)
    if min(n[good].sum(), n[~good].sum()) < 50:
        return EDGES
    z = np.array([r[:2] for r in rows], float)
    edges = list(EDGES)

    def cost(e: list[float]) -> float:
        out = (z[:, 0] < e[0]) | (z[:, 0] > e[1]) | (z[:, 1] < e[2]) | (z[:, 1] > e[3])
        return 2 * (n[good & out].sum() / n[good].sum()) + n[~good & ~out].sum() / n[~good].sum()

    for _ in range(5):
        for k in range(4):
            tried = [cost([*edges[:k], s if k % 2 else -s, *edges[k + 1 :]]) for s in STEPS]
            best = STEPS[int(np.argmin(tried))]
            edges[k] = best if k % 2 else -best
    return tuple(edges)


def judge(docs: DataFrame, labels: DataFrame | None = None, order: int = ORDER, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, the counts, both perplexities in bits, base_failed and kept, a row for each document."""
    placed = cut(place(score(docs, order, slice_bytes)))
    rows = keyed(docs).select("doc_id", "d1", "d2").join(placed.drop("lang"), ["d1", "d2"])
    edges = EDGES
    if labels is not None:
        marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        known = rows.filter("NOT base_failed").join(marked.hint("shuffle_hash"), "doc_id")
        known = known.groupBy("doc_id").agg(F.min_by(F.struct("z_byte", "z_word", "quality"), F.col("d1")).alias("r")).select("r.*")
        edges = fit_edges([tuple(r) for r in cell_rows(known).collect()])  # few rows: by pairs of CUTS
    inside = F.col("z_byte").between(edges[0], edges[1]) & F.col("z_word").between(edges[2], edges[3])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "bits_per_byte", "bits_per_word")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
