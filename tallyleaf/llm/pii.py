"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field then reads the text between them: atoms (runs without white space that hold a
digit or an at sign) form clusters, and every run of up to ``LONGEST`` neighbouring atoms is a candidate segment. A
segment is scored by features of the whole span (digits, checksum, separators, leading sign, parts, length, the word
before), and a dynamic program over a cluster chooses boundaries and types together, with single atoms outside any
entity at score 0. Weights are trained by gradient ascent on the conditional likelihood (forward sums over all
segmentations), on clusters of a bounded sample of documents whose labels are the base spans, and on the same clusters
with phones written without the plus, cards and addresses broken by other separators, and numbers that are no entity. So
the field finds what the patterns are too strict for; its spans are kept where no base span overlaps.

Offsets are code points, end exclusive. Defined results: null and empty texts have no spans; repeated rows are searched
each for itself; of segmentations that tie the one with fewer and later spans wins; without any base span to learn from
the field adds nothing; an empty table gives an empty one. Input columns that bear a result's name are replaced.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import add_columns, read_table

#: The kinds in order.
KINDS = ("email", "ip", "card", "phone")
LONGEST = 5
MOST_CHARS = 80  # of a segment
GAP = 2  # most separators between atoms of a cluster

# the same languages as the fixed patterns, written so that each scan is linear
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_ATOM = re.compile(r"[0-9@][^\s,;:!?]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end by start and kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        free = 0
        for m in _EMAIL_TAIL.finditer(text):
            a = m.start()
            while a > free and text[a - 1] in _EMAIL_LETTERS:
                a -= 1
            if a < m.start():
                out.append((a, 0, m.end()))
                free = m.end()
    if _DIGITS.search(text) is None:
        return out
    # parts of many digits, beyond what int() takes, are over 255 unless zeros lead
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    out.sort()
    return out


def atoms(text: str) -> list[tuple[int, int]]:
    """Runs that hold a digit or an at sign, grown to the left over what is not a separator."""
    out: list[tuple[int, int]] = []
    at, before = 0, 0
    while (m := _ATOM.search(text, at)) is not None:
        a = m.start()
        while a > before and not (text[a - 1].isspace() or text[a - 1] in ",;:!?"):
            a -= 1
        b = m.end()
        while b > a and text[b - 1] in ".)'\"":
            b -= 1
        if b > a:
            out.append((a, b))
        at = before = max(m.end(), m.start() + 1)
    return out


def clusters(text: str) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = []
    for a, b in atoms(text):
        if out and a - out[-1][-1][1] <= GAP:
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def span_features(text: str, start: int, end: int) -> list[str]:
    """Of a whole candidate span."""
    s = text[start:end]
    digits = "".join(_DIGITS.findall(s))
    n = len(digits)
    other = sorted(set(re.sub(r"[0-9A-Za-z]", "", s)))
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", s))
    before = re.search(r"([A-Za-z]{2,12})[\s:=]*$", text[max(0, start - 16) : start])
    parts = s.split(".")
    return [
        "bias",
        f"digits={n if n < 8 else '8-11' if n < 12 else '12-15' if n < 16 else '16-19' if n < 20 else '20+'}",
        f"marks={''.join(other)[:6]}",
        f"shape={shape[:14]}",
        f"plus={s[:1] == '+'}",
        f"at={s.count('@')}",
        f"dot_after_at={'.' in s.partition('@')[2]}",
        f"checksum={12 <= n <= 19 and luhn(digits)}",
        f"octets={len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)}",
        f"groups={min(len(re.findall(r'[0-9]+', s)), 6)}",
        f"letters={bool(re.search('[A-Za-z]', s))}",
        f"phone_length={9 <= n <= 15}",
        f"before={before[1].lower() if before else ''}",
    ]


@dataclass
class SpanField:
    """Weights by feature, one for each kind."""

    weights: dict[str, np.ndarray]

    def scores(self, text: str, start: int, end: int) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in span_features(text, start, end):
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total

    def best(self, text: str, cluster: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The highest-scoring segmentation: start, kind, end of its entities."""
        n = len(cluster)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
                if cluster[j - 1][1] - cluster[i][0] > MOST_CHARS:
                    break
                s = self.scores(text, cluster[i][0], cluster[j - 1][1])
                k = int(s.argmax())
                if value[i] + s[k] > value[j] + 1e-12:
                    value[j], back[j] = value[i] + s[k], (i, k)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((cluster[i][0], k, cluster[j - 1][1]))
                j = i
        return out[::-1]


def _segments(text: str, cluster: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    return [
        (i, j, span_features(text, cluster[i][0], cluster[j - 1][1]))
        for j in range(1, len(cluster) + 1)
        for i in range(j - 1, max(-1, j - 1 - LONGEST), -1)
        if cluster[j - 1][1] - cluster[i][0] <= MOST_CHARS
    ]


def variants(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text around one entity, written in a way that the patterns do not know, or a number that is none."""
    a, kind, b = spans[rng.randrange(len(spans))]
    s, left, right = text[a:b], re.sub(r"[0-9@]", "x", text[max(0, a - 20) : a]), re.sub(r"[0-9@]", "x", text[b : b + 20])
    if kind == 3:
        s = s[1:]
        if rng.random() < 0.5:
            s = s.replace(" ", ".").replace("(", "").replace(")", "")
    elif kind == 2:
        d = "".join(_DIGITS.findall(s))
        s = rng.choice([".", " "]).join(d[k : k + 4] for k in range(0, len(d), 4))
    if rng.random() < 0.4:
        s, kind = rng.choice([str(rng.randrange(10**6)), f"{rng.randrange(100)}.{rng.randrange(100)}", f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", f"{rng.randrange(24)}:{rng.randrange(60):02}", f"v{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(9)}"]), -1
    left = left + " " if left and not left[-1].isspace() else left
    right = " " + right if right and not right[0].isspace() else right
    return left + s + right, [] if kind < 0 else [(len(left), kind, len(left) + len(s))]


def train(texts: list[str], epochs: int = 6, most: int = 1500, rate: float = 0.3, ridge: float = 1e-3, seed: int = 11) -> SpanField:
    """Stochastic gradient ascent on the conditional log-likelihood of segmentations."""
    rng = random.Random(seed)
    data = []
    for text in texts:
        spans = base_spans(text)
        if not spans:
            continue
        for part, known in [(text, spans), variants(text, spans, rng), variants(text, spans, rng)]:
            for cluster in clusters(part):
                if len(cluster) > 40:
                    continue
                gold = {}
                for a, k, b in known:
                    i = next((i for i, x in enumerate(cluster) if x[0] == a), None)
                    j = next((j for j, x in enumerate(cluster) if x[1] == b), None)
                    if i is not None and j is not None and i <= j < i + LONGEST:
                        gold[i, j + 1] = k
                data.append((len(cluster), _segments(part, cluster), gold))
    rng.shuffle(data)
    data = data[:most]
    weights: dict[str, np.ndarray] = {}
    zero = np.zeros(len(KINDS))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for n, segments, gold in data:
            score = {(i, j): sum((weights.get(f, zero) for f in fs), zero) for i, j, fs in segments}
            into, out_of = {}, {}
            for i, j in score:
                into.setdefault(j, []).append(i)
                out_of.setdefault(i, []).append(j)
            mass = {x: np.logaddexp.reduce(s) for x, s in score.items()}
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + mass[i, j] for i in into.get(j, ()))])
            for i in range(n - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + mass[i, j] for j in out_of.get(i, ()))])
            for i, j, fs in segments:
                p = np.exp(score[i, j] + ahead[i] + behind[j] - ahead[n])
                p = -p
                if (i, j) in gold:
                    p[gold[i, j]] += 1
                if np.abs(p).max() > 1e-4:
                    for f in fs:
                        weights[f] = weights.get(f, zero) * (1 - ridge * step) + step * p
    return SpanField(weights)


def fit_field(docs: DataFrame, sample: int = 1500, text: str = "text") -> SpanField:
    """On the ``sample`` documents of least hash among those that hold an at sign or nine digits in reach of another; the
    texts are cut to the neighbourhood of what is learned before they are collected."""
    likely = docs.select(F.col(text).alias("t")).filter(F.col("t").contains("@") | F.col("t").rlike(r"[0-9][0-9 ().-]{7,}[0-9]"))
    near = likely.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?s).{0,24}(?:[^\s@]{1,40}@[^\s]{1,40}|\+?[0-9][0-9 ().-]{7,30}[0-9]).{0,24}"), F.lit(0))).alias("t"))
    rows = near.orderBy(F.xxhash64("t"), "t").limit(sample).collect()
    return train([r[0] for r in rows])


def all_spans(text: str, base: list[tuple[int, int, int]], model: SpanField) -> list[tuple[int, int, int]]:
    """The base spans and the field's, where these overlap none."""
    if not model.weights or (("@" not in text) and _DIGITS.search(text) is None):
        return base
    # base spans of different kinds may overlap: merged, they are sorted by both ends
    taken: list[list[int]] = []
    for a, _, b in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    extra = []
    for cluster in clusters(text):
        for a, k, b in model.best(text, cluster):
            at = bisect_left(starts, b)
            if not at or taken[at - 1][1] <= a:
                extra.append((a, k, b))
    return sorted(base + extra)


def find_personal_data(docs: DataFrame, model: SpanField, text: str = "text") -> DataFrame:
    """Adds base_spans and all_spans (arrays of kind, start, end) to every row; no shuffle."""

    def make(column: pa.Array) -> list[pa.Array]:
        base, every = [], []
        for v in column:
            t = v.as_py() or ""
            b = base_spans(t)
            base.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in b])
            every.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in all_spans(t, b, model)])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return [pa.array(base, kind), pa.array(every, kind)]

    return add_columns(docs, text, make, "base_spans array<struct<kind:string,start:int,end:int>>, all_spans array<struct<kind:string,start:int,end:int>>")


def joined_spans(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, fit_field(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined_spans("base_spans"), 256).alias("base_sha256"), joined_spans("all_spans").alias("spans"))
