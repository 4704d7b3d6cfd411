"""The few vectorised helpers, where Spark has no built-in: NFKC, open JSON trees, Python's own permutation. All work on Arrow batches; texts that need no work are left as they are."""

from __future__ import annotations

import json
import random
import unicodedata
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC of each text."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def plain(c: str | Column) -> Column:
    """NFKC, one minus and straight quotes, without emphasis, heading marks and bullets."""
    text = F.translate(nfkc(c), "’‘“”−", "''\"\"-")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*(?:#{1,6}|[-*•])\s+", ""), r"\*{1,3}|_{2,3}|`", ""))


def signature(c: str | Column) -> Column:
    """Letters and digits of a question, without brackets and its leading number, case folded."""
    text = F.regexp_replace(F.regexp_replace(nfkc(c), r"[(（\[][^)）\]]*[)）\]]", ""), r"^\s*[0-9]+[.)、]\s*", "")
    return casefold(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def one_newline(c: str | Column) -> Column:
    """A text whose lines all end alike, which is split faster."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def signatures(c: str | Column) -> Column:
    """The signature of each line of a text with one kind of newline. The text is taken whole, not line by line: NFKC and case
    folding make no newline and join nothing across one, and no pattern here crosses one. An ASCII text does not go to Python."""
    c = F.col(c) if isinstance(c, str) else c
    ascii_only = F.octet_length(c) == F.char_length(c)

    def letters(text):
        text = F.regexp_replace(text, r"[(（\[][^)）\]\n]*[)）\]]", "")
        text = F.regexp_replace(text, r"(?md)^[\s&&[^\n]]*[0-9]+[.)、]", "")
        return F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", "")

    folded = F.when(ascii_only, F.lower(letters(c))).otherwise(casefold(letters(nfkc(F.when(~ascii_only, c)))))
    return F.split(folded, "\n")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def seeded_permutation(seeds: pd.Series, sizes: pd.Series) -> pd.Series:
    """The permutation (1-based) that Python's generator gives for a seed."""

    def one(seed: int, n: int) -> list[int]:
        order = list(range(1, n + 1))
        random.Random(int(seed)).shuffle(order)
        return order

    return pd.Series([None if pd.isna(s) or pd.isna(n) else one(s, int(n)) for s, n in zip(seeds, sizes, strict=True)])


#: Fields that hold hidden reasoning.
REASONING = frozenset({"reasoning_content", "reasoning_summary", "thought", "thoughts", "thinking_content"})


@F.pandas_udf(T.StringType())
def without_reasoning(documents: pd.Series) -> pd.Series:
    """JSON documents without hidden-reasoning fields at any depth; what is no JSON passes."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k.casefold() not in REASONING}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def one(text):
        try:
            return json.dumps(clean(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return text

    return documents.map(one)


@F.pandas_udf(T.StringType())
def canonical_digest(documents: pd.Series) -> pd.Series:
    """sha256 of the canonical form of JSON documents with open keys: keys sorted, no blanks; null for what is no JSON."""

    def one(text):
        try:
            return sha256(json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return documents.map(one)
