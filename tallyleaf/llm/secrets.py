"""Secrets in texts: fixed patterns, and a randomness test battery. DataFrame functions only.

Patterns (assignments, access keys, hex runs) give the base spans. The battery then looks at every other run of token
characters: its encoding is inferred (hex, base32, base64, letters and digits of one case, letters, digits, and base64
with punctuation for all that is left), and chi-squared uniformity over that
alphabet, the runs test about the alphabet's middle and the lag-1 serial correlation are computed with array functions.
Ordinary long words are the reference: mean and deviation of their uniformity, by length class and over the whole
table, give each token the probability to look so uniform without being random. These values go through the
Benjamini-Hochberg rule within each length class, on a fixed grid of bins, encodings of letters with digits apart from
the rest (so that hyphenated words and paths, of which texts hold many, do not raise the bar for keys). A token that passes and that the battery does
not reject as random is a span of kind ``random``. What the driver holds is the grid: a fixed number of rows.

Offsets are code points, end exclusive. Defined results: null and empty texts have no spans; repeated rows are scanned
each for itself; tokens tie by bin; a length class with fewer than 30 ordinary words takes the next shorter one that has
as many, its mean scaled by the length and its deviation by the root of it (as a skewed alphabet makes them grow), and
without one no span is added; an empty table gives an empty one. Input columns that bear a result's name are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import read_table

#: The kinds in order, and their patterns (group 2 of an assignment is the secret).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LONG_HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{14,}"
#: Alphabets by rank.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": "0123456789abcdef", "base32": UPPER + "234567", "lower": DIGITS + LOWER, "base64": UPPER + LOWER + DIGITS + "+/-_=",
    "upper_hex": "0123456789ABCDEF", "upper": DIGITS + UPPER, "letters": UPPER + LOWER, "capitals": UPPER, "digits": DIGITS,
    "mixed": UPPER + LOWER + DIGITS + "+/-_=",
}
REST = ("letters", "capitals", "digits", "mixed")  # the second family of the false-discovery rule

CHUNK = 256
CLASSES = 12  # length classes: by the power of two, in halves
BINS = 200
REFERENCE = 30
SHORTEST = 20  # of a token that can be a secret; shorter runs are reference only


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _ends(lengths: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` gets the running sums of an array as a function of the index. By chunks, so that an array of many
    elements takes linear time (but for the chunks' sums)."""
    add = lambda a, x: a + x
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / CHUNK).cast("int") - 1, F.lit(0)))
    sums = F.transform(chunks, lambda c: F.aggregate(F.slice(lengths, c * CHUNK + 1, CHUNK), F.lit(0), add))
    before = lambda s: F.transform(chunks, lambda c: F.aggregate(F.slice(s, F.lit(1), c), F.lit(0), add))
    return _let(sums, lambda s: _let(before(s), lambda b: body(lambda i: b[(i / CHUNK).cast("int")] + F.aggregate(F.slice(lengths, i - i % CHUNK + 1, i % CHUNK + 1), F.lit(0), add))))


def _pieces(text: Column, pattern: str) -> Column:
    r"""Each match with all text since the one before; \G keeps the search linear after the last match."""
    return F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))


def _found(df: DataFrame, name: str, pattern: str, test: str | None = None) -> DataFrame:
    """Adds an array of structs start, end, token of the pattern's matches."""
    pieces = _pieces(F.col("__t"), pattern)
    if test:
        pieces = F.when(F.contains("__t", F.lit(test)), pieces).otherwise(F.array().cast("array<string>"))

    def span(end: Column, piece: Column) -> Column:
        return _let(F.regexp_extract(piece, f"(?:{pattern})$", 0), lambda token: F.struct((end - F.length(token)).alias("start"), end.alias("end"), token.alias("token")))

    return df.withColumn(name, _let(pieces, lambda p: _let(F.transform(p, F.length), lambda n: _ends(n, lambda end: F.transform(p, lambda x, i: _let(end(i), lambda e: span(e, x)))))))


def _base(df: DataFrame) -> DataFrame:
    df = _found(_found(_found(df, "__assign", ASSIGN), "__access", ACCESS, "AKIA"), "__hex", LONG_HEX)
    df = df.withColumn("__assign", F.filter("__assign", lambda x: F.length(F.regexp_extract(x["token"], ASSIGN, 2)) >= 6))
    return df.withColumn("__access", F.filter("__access", lambda x: F.length(x["token"]) >= 20))


def _tokens(df: DataFrame) -> DataFrame:
    """Adds __tokens: all runs of token characters, with their kinds."""
    df = _found(df, "__tokens", TOKEN)
    return df.withColumn("__tokens", F.transform("__tokens", _measured))


def _measured(x: Column) -> Column:
    """The battery's figures of one token."""
    token = x["token"]
    kind = (
        F.when(token.rlike("^[A-Za-z]?[a-z]+$"), "word")
        .when(token.rlike("^[0-9a-f]+$") & token.rlike("[a-f]"), "hex")
        .when(token.rlike("^[0-9A-F]+$") & token.rlike("[A-F]") & token.rlike("[0-9]"), "upper_hex")
        .when(token.rlike("^[A-Z2-7]+$") & token.rlike("[2-7]"), "base32")
        .when(token.rlike("^[0-9A-Z]+$") & token.rlike("[A-Z]") & token.rlike("[0-9]"), "upper")
        .when(token.rlike("^[0-9a-z]+$") & token.rlike("[a-z]") & token.rlike("[0-9]"), "lower")
        .when(token.rlike("[a-z]") & token.rlike("[A-Z]") & token.rlike("[0-9]"), "base64")
        .when(token.rlike("^[A-Z]+$"), "capitals").when(token.rlike("^[A-Za-z]+$"), "letters").when(token.rlike("^[0-9]+$"), "digits")
        .otherwise("mixed")
    )
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), token.alias("token"))


def _battery(df: DataFrame, column: str) -> DataFrame:
    """Replaces an array of tokens by one with their figures: u (uniformity), and p of the runs and serial tests."""

    def letters(x: Column) -> Column:
        word = F.lower(x["token"])
        alphabet = F.when(x["kind"] == "word", LOWER)
        for k, a in ALPHABETS.items():
            alphabet = alphabet.when(x["kind"] == k, a)
        text = F.when(x["kind"] == "word", word).otherwise(x["token"])
        chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.length(alphabet).cast("double").alias("k"), F.transform(chars, lambda c: F.instr(alphabet, c) - 1).alias("r"))

    def sums(x: Column) -> Column:
        r, n = x["r"], F.size(x["r"]).cast("double")
        squares = _sum(F.transform(F.array_distinct(r), lambda v: F.pow(n - F.size(F.array_remove(r, v)), F.lit(2.0))))
        high = _sum(F.transform(r, lambda v: F.when(v >= x["k"] / 2, 1.0).otherwise(0.0)))
        return x.withField("n", n).withField("squares", squares).withField("mean", _sum(F.transform(r, lambda v: v.cast("double"))) / n).withField("high", high)

    def moments(x: Column) -> Column:
        r = x["r"]
        next_to = F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return _let(next_to, lambda pairs: x.withField("runs", 1 + _sum(F.transform(pairs, lambda v: F.when((v["a"] >= x["k"] / 2) != (v["b"] >= x["k"] / 2), 1.0).otherwise(0.0))))
                    .withField("var", _sum(F.transform(r, lambda v: (v - x["mean"]) * (v - x["mean"]))))
                    .withField("cov", _sum(F.transform(pairs, lambda v: (v["a"] - x["mean"]) * (v["b"] - x["mean"])))))

    def tests(x: Column) -> Column:
        n, k = x["n"], x["k"]
        u = (k / n * x["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1))
        low = n - x["high"]
        both = 2 * x["high"] * low
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (x["runs"] - both / n - 1) / F.sqrt(spread)).otherwise(F.lit(9.0))
        z_serial = F.when(x["var"] > 0, x["cov"] / x["var"] * F.sqrt(n)).otherwise(F.lit(9.0))
        length = F.least(F.floor(2 * F.log2(n)) - 7, F.lit(CLASSES - 1)).cast("int")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), length.alias("length"), u.alias("u"), F.abs(z_runs).alias("z_runs"), F.abs(z_serial).alias("z_serial"))

    df = df.withColumn(column, F.transform(column, letters))
    return df.withColumn(column, F.transform(column, sums)).withColumn(column, F.transform(column, moments)).withColumn(column, F.transform(column, tests))


def _bin(u: Column, mean: Column, deviation: Column) -> Column:
    """The bin of -10 log10 p, p the probability of an ordinary word to be as uniform (normal law, logistic form)."""
    z = (u - mean) / deviation
    p = 1 / (1 + F.exp(-(1.5976 * z + 0.070565776 * z * z * z)))
    return F.least(F.greatest(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-30)))), F.lit(0)), F.lit(BINS)).cast("int")


class Thresholds:
    """By length class and whether of REST: the reference's mean and deviation, and the least bin that is a discovery."""

    def __init__(self, rows: dict[tuple[int, bool], tuple[float, float, int]]):
        self.rows = rows

    def flagged(self, x: Column, uniform: float) -> Column:
        out = F.lit(False)
        for (length, rest), (mean, deviation, least) in sorted(self.rows.items()):
            out = F.when((x["length"] == length) & (x["kind"].isin(*REST) == rest), _bin(x["u"], F.lit(mean), F.lit(deviation)) >= least).otherwise(out)
        return (x["kind"] != "word") & (x["end"] - x["start"] >= SHORTEST) & out & (x["u"] < uniform) & (x["z_runs"] < uniform) & (x["z_serial"] < uniform)


def fit_thresholds(docs: DataFrame, text: str = "text", rate: float = 0.01) -> Thresholds:
    """Over the whole table. Collects a table of lengths, families and steps of u: of fixed size."""
    tokens = _battery(_tokens(docs.select(F.coalesce(F.col(text), F.lit("")).alias("__t"))), "__tokens").select(F.explode("__tokens").alias("x")).filter((F.col("x.kind") == "word") | (F.col("x.end") - F.col("x.start") >= SHORTEST)).select("x.kind", "x.length", "x.u")
    binned = tokens.withColumn("h", F.floor(F.least(F.col("u"), F.lit(500.0)) * 20).cast("int")).groupBy("length", (F.col("kind") == "word").alias("word"), F.col("kind").isin(*REST).alias("rest"), "h").count().collect()
    # u in steps of 1/20, at most 500: a table of fixed size from which both the reference and the rule follow
    words, others = defaultdict(list), defaultdict(list)
    for length, word, rest, h, n in binned:
        (words[length] if word else others[length, rest]).append(((h + 0.5) / 20, n))
    rows = {}
    for length, rest in others:
        enough = [k for k in words if k <= length and sum(c for _, c in words[k]) >= REFERENCE]
        if not enough:
            continue
        values, ratio = words[max(enough)], 2 ** ((length - max(enough)) / 2)
        n = sum(c for _, c in values)
        mean = sum(u * c for u, c in values) / n
        deviation = max(math.sqrt(sum(c * (u - mean) ** 2 for u, c in values) / n), 1e-6) * math.sqrt(ratio)
        mean *= ratio
        grid = [0] * (BINS + 1)
        for u, c in others[length, rest]:
            z = (u - mean) / deviation
            p = 1 / (1 + math.exp(min(-(1.5976 * z + 0.070565776 * z**3), 600)))
            grid[min(max(math.floor(-10 * math.log10(max(p, 1e-30))), 0), BINS)] += c
        total, seen, least = sum(grid), 0, None
        for b in range(BINS, 0, -1):
            seen += grid[b]
            if seen and 10 ** (-b / 10) * total / seen <= rate:
                least = b
        if least is not None:
            rows[length, rest] = (mean, deviation, least)
    return Thresholds(rows)


def scan_secrets(docs: DataFrame, thresholds: Thresholds, text: str = "text", uniform: float = 3.3) -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_random, base_spans and all_spans (arrays of kind, start, end) to every row."""
    new = ("n_assign", "n_access", "n_hex", "n_random", "base_spans", "all_spans")
    df = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = _battery(_tokens(_base(df)), "__tokens")

    def spans(column: str, kind: int) -> Column:
        return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("order"), x["end"].alias("end")))

    df = df.withColumn("__b", F.array_sort(F.concat(spans("__assign", 0), spans("__access", 1), spans("__hex", 2))))
    free = F.filter("__tokens", lambda x: thresholds.flagged(x, uniform) & ~F.exists("__b", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    df = df.withColumn("__tokens", free).withColumn("__all", F.array_sort(F.concat("__b", spans("__tokens", 3))))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda c: F.transform(c, lambda x: F.struct(F.element_at(kinds, x["order"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return df.select(
        *[df[f"`{c}`"] for c in docs.columns if c.lower() not in new],
        F.size("__assign").cast("long").alias("n_assign"), F.size("__access").cast("long").alias("n_access"), F.size("__hex").cast("long").alias("n_hex"), F.size("__tokens").cast("long").alias("n_random"),
        shown("__b").alias("base_spans"), shown("__all").alias("all_spans"),
    )


def mask_spans(df: DataFrame, spans: str, mark: str, text: str = "text") -> DataFrame:
    """Replaces the text under the spans (sorted by start, maybe overlapping) by ``mark``."""
    free = F.aggregate(
        F.col(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.when(x["end"] <= a["at"], a).when(
            x["start"] < a["at"], F.struct(x["end"].alias("at"), a["out"].alias("out"))
        ).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(F.substring(F.col(text), a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), a["at"] + 1, F.length(text))),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, free).otherwise(F.col(text)))


def joined_spans(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, fit_thresholds(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined_spans("base_spans"), 256).alias("base_sha256"), joined_spans("all_spans").alias("spans"), "n_random")
