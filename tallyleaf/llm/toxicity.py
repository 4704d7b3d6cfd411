"""Toxic passages by maximum-scoring segments.

Every word gets a log-odds score with an informative Dirichlet prior (the pooled frequencies), learned for words and
for their first 3 to 6 bytes from a bounded sample of labelled documents; a lower confidence bound of the score counts,
less a constant drift. A linear-time scan finds all maximal-scoring segments of a document. Segment scores are turned
into p-values with the extreme-value law for such segments (scale from the background score distribution, constant by
maximum likelihood), the significant ones are added up and a logistic curve, fitted on a fold of its own, makes the
score.

Defined results: null and empty texts have no words, thus no passage and the lowest score; repeated rows and ties are
scored alike; without labelled rows of both classes every score is the smoothed base rate, which stays below 0.5 unless
label 1 dominates; several labels of a document count as toxic if one of them is. Input columns that bear a result's
name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import add_columns, map_arrow, read_table
from ._text import BYTE_CODE_LOWER, Runs, U, Words, mix, signed, text_slices

PREFIXES = (3, 4, 5, 6)
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[:128] = True
NOT_LETTER[65:91] = NOT_LETTER[97:123] = False

RESULT = "score double, predicted int, n_passages int, passages array<struct<start:int,end:int,score:double,p_value:double>>"


@dataclass
class ToxicityModel:
    """features: sorted hashes; values: their scores; drift: cost of any word; scale, constant: of the extreme-value
    law; slope, offset: of the logistic curve; base: score without a model."""

    features: np.ndarray
    values: np.ndarray
    drift: float
    scale: float
    constant: float
    slope: float
    offset: float
    base: float | None = None
    significant: float = 0.05


def word_features(data: np.ndarray, offs: np.ndarray) -> tuple[Words, list[np.ndarray], list[np.ndarray]]:
    """The words of a slice, and for whole words and each prefix length the word indexes and hashes."""
    words = Words(data, offs, lower=True, separator=NOT_LETTER)
    runs = Runs(BYTE_CODE_LOWER[data])
    index, hashes = [np.arange(len(words))], [mix(words.hash ^ U(1))]
    for k in PREFIXES:
        long = np.flatnonzero(words.end - words.start > k)
        index.append(long)
        hashes.append(mix(runs.of(words.start[long], words.start[long] + k) ^ U(k + 7)))
    return words, index, hashes


def word_scores(words: Words, index: list[np.ndarray], hashes: list[np.ndarray], model: ToxicityModel) -> np.ndarray:
    score = np.zeros(len(words))
    if not len(model.features):
        return score
    shift = U(44)
    near = np.zeros(1 << 20, bool)
    near[model.features >> shift] = True
    for at, h in zip(index, hashes, strict=True):
        hit = np.flatnonzero(near[h >> shift])
        if len(hit):
            place = np.minimum(np.searchsorted(model.features, h[hit]), len(model.features) - 1)
            same = model.features[place] == h[hit]
            np.maximum.at(score, at[hit[same]], model.values[place[same]])
    return score


def maximal_segments(at: np.ndarray, value: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, in linear time (Ruzzo and Tompa): word indexes first, after last, and score.
    at, value: the words with a positive score; every other word costs ``drift``."""
    found: list[list[float]] = []  # left sum, right sum, first, after last
    total, last = 0.0, -1
    for i, v in zip(at.tolist(), value.tolist(), strict=True):
        total -= drift * (i - last - 1)
        gain = v - drift
        last = i
        if gain <= 0:
            total += gain
            continue
        new = [total, total + gain, i, i + 1]
        total += gain
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j -= 1
            if j < 0 or found[j][1] >= new[1]:
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
        found.append(new)
    return [(int(a), int(b), right - left) for left, right, a, b in found]


def _passages(column: pa.Array, model: ToxicityModel):
    """For each row: number of words and the segments with byte offsets in the row."""
    for i, j, data, offs in text_slices(column):
        words, index, hashes = word_features(data, offs)
        score = word_scores(words, index, hashes, model)
        hits = np.flatnonzero(score > 0)
        rows = words.row[hits]
        cuts = np.searchsorted(rows, np.arange(j - i + 1))
        for r in range(j - i):
            n = int(words.first[r + 1] - words.first[r])
            if cuts[r] == cuts[r + 1]:
                yield n, ()
                continue
            mine = hits[cuts[r] : cuts[r + 1]]
            start = data[offs[r] : offs[r + 1]]
            code = np.cumsum((start & 0xC0) != 0x80)
            yield n, [(int(code[words.start[a] - offs[r]]) - 1, int(code[words.end[b - 1] - 1 - offs[r]]), s) for a, b, s in _shifted(maximal_segments(mine - words.first[r], score[mine], model.drift), int(words.first[r]))]


def _shifted(segments, by: int):
    return [(a + by, b + by, s) for a, b, s in segments]


def p_value(score: float, n: int, model: ToxicityModel) -> float:
    return float(-np.expm1(-min(model.constant * max(n, 1) * np.exp(-model.scale * score), 700.0)))


def evidence(n: int, segments, model: ToxicityModel) -> tuple[float, list[tuple[int, int, float, float]]]:
    """-log10 p added over the significant segments (the best one alone if none is), and the significant segments."""
    scored = [(a, b, s, p_value(s, n, model)) for a, b, s in segments]
    good = [x for x in scored if x[3] <= model.significant]
    used = good or sorted(scored, key=lambda x: x[3])[:1]
    return sum(-np.log10(max(x[3], 1e-30)) for x in used), good


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds score, predicted, n_passages and passages (code points, end exclusive) to every row; no shuffle."""

    def make(column: pa.Array) -> list[pa.Array]:
        scores, passages = [], []
        for n, segments in _passages(column, model):
            x, good = evidence(n, segments, model)
            scores.append(model.base if model.base is not None else float(1 / (1 + np.exp(-np.clip(model.slope * np.log1p(x) + model.offset, -40, 40)))))
            passages.append([{"start": a, "end": b, "score": s, "p_value": p} for a, b, s, p in good])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([len(p) for p in passages], pa.int32()), pa.array(passages, kind)]

    return add_columns(docs, text, make, RESULT)


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12_000, vocabulary: int = 20_000, drift: float = 0.3, bound: float = 1.65, strength: float = 0.005) -> ToxicityModel:
    """Fits on at most ``sample`` labelled rows (those of least hash) whose fold is not 0: folds 1 to 3 give the word
    scores, fold 4 the calibration. The model holds at most ``vocabulary`` features. The sample's ids are broadcast, so
    the texts are scanned once and not shuffled."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 0))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("text").alias("__text"), "__y", fold().cast("int").alias("__f"))

    def count(batch: pa.RecordBatch):
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, offs in text_slices(batch.column(0)):
            words, index, hashes = word_features(data, offs)
            of = (y[i:j] > 0)[words.row]
            h = np.concatenate(hashes)
            one = np.concatenate([of[k] for k in index])
            # the row of a 0 hash holds the number of words
            keys, back = np.unique(h, return_inverse=True)
            n1 = np.bincount(back, one, len(keys)).astype(np.int64)
            n = np.bincount(back, None, len(keys))
            keep = np.append(signed(keys), 0)
            yield [pa.array(keep), pa.array(np.append(n1, int(of.sum()))), pa.array(np.append(n - n1, len(of) - int(of.sum())))]

    counts = map_arrow(texts.filter("__f < 4"), count, "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    totals = counts.filter("f = 0").agg(F.sum("n1"), F.sum("n0")).first()
    t1, t0 = (float(totals[0] or 0), float(totals[1] or 0))
    empty = np.zeros(0, np.uint64)
    model = ToxicityModel(empty, np.zeros(0), drift, 1.0, 0.01, 1.0, -2.0)
    seen = chosen.agg(F.count("*"), F.sum("__y")).first()
    if not t1 or not t0:
        model.base = (float(seen[1] or 0) + 0.1) / (float(seen[0] or 0) + 1)
        return model
    a = strength * (t1 + t0)
    prior = (F.col("n1") + F.col("n0")) * F.lit(a / (t1 + t0))
    low = (
        F.log((F.col("n1") + prior) / (t1 + a)) - F.log((F.col("n0") + prior) / (t0 + a))
        - bound * F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    )
    rows = counts.filter("f <> 0 and n1 >= 2").withColumn("low", low).filter(F.col("low") > drift).orderBy(F.desc("low"), "f").limit(vocabulary).select("f", "low").collect()
    found = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    model.features, model.values = found[order], np.array([r[1] for r in rows])[order]

    # background: word scores of label-0 documents of the calibration fold, in bins of 1/8
    def scores(batch: pa.RecordBatch):
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, offs in text_slices(batch.column(0)):
            words, index, hashes = word_features(data, offs)
            s = word_scores(words, index, hashes, model)[(y[i:j] == 0)[words.row]]
            bins = np.bincount((s * 8).astype(np.int64))
            yield [pa.array(np.arange(len(bins))), pa.array(bins)]

    held = texts.filter("__f = 4")
    bins = map_arrow(held, scores, "b long, n long").groupBy("b").agg(F.sum("n")).collect()
    model.scale = karlin_scale(np.array([r[0] for r in bins]) / 8, np.array([r[1] for r in bins], float), drift, float(model.values.max(initial=drift + 1)))

    def maxima(column: pa.Array):
        return [pa.array([max(n, 1) * float(np.exp(-model.scale * max((s for _, _, s in seg), default=0.0))) for n, seg in _passages(column, model)], pa.float64())]

    held_rows = held.select("__y", F.col("__text").alias("text"))
    law = add_columns(held_rows.filter("__y = 0"), "text", maxima, "__m double").agg(F.count("*"), F.sum("__m")).first()
    model.constant = float(law[0]) / float(law[1]) if law[0] and law[1] else 0.01

    def amounts(column: pa.Array):
        return [pa.array([int(round(8 * np.log1p(evidence(n, seg, model)[0]))) for n, seg in _passages(column, model)], pa.int32())]

    curve = add_columns(held_rows, "text", amounts, "__x int").groupBy("__x").agg(F.sum("__y"), F.count("*")).collect()
    model.slope, model.offset = logistic([r[0] / 8 for r in curve], [r[1] for r in curve], [r[2] for r in curve])
    return model


def karlin_scale(scores: np.ndarray, counts: np.ndarray, drift: float, top: float) -> float:
    """The positive root of sum p exp(x s) = 1 over the background scores (one pseudo-count on the top score)."""
    s = np.append(scores - drift, top - drift)
    p = np.append(counts, 1.0)
    p = p / p.sum()
    if (p * s).sum() >= 0:
        return 0.05
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        if (p * np.exp(np.minimum(mid * s, 600))).sum() > 1:
            high = mid
        else:
            low = mid
    return max(low, 1e-3)


def logistic(x, ones, n) -> tuple[float, float]:
    """A weighted logistic curve with a weak ridge, by Newton's method; the slope is not negative."""
    x, ones, n = np.array(x, float), np.array(ones, float), np.array(n, float)
    if not len(x):
        return 1.0, -2.0
    design = np.stack([x, np.ones_like(x)], 1)
    w = np.array([1.0, -1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (ones - n * p) - 0.05 * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log((ones.sum() + 0.1) / (n.sum() - ones.sum() + 0.9))))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted", "n_passages", "passages")
