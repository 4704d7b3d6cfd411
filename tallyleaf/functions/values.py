"""Column functions that read values from short answers: missing is always better than invented. All are built-in
expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
LITERAL = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
#: Words, in two languages.
SCORE_WORDS = r"(?i)^\s*(?:score|answer|rating|评分|答案)\s*[:=：]?\s*"
AND_SO_ON = r"\s*(?:[.;!)。]|points?|分)*\s*"
REASON = r"(?i)\s*(?:because|since|due|,? as)\b.*"
#: Wording of refusals.
REFUSAL = (
    r"(?i)\bi\s+(?:cannot|can't|can\s*not|am\s+unable\s+to|won't|will\s+not)\s+(?:provide|give|answer|rate|assign|score|offer|complete|respond|express)\b",
    r"(?i)\b(?:i\s+)?(?:must\s+decline|prefer\s+not\s+to\s+answer)\b",
    r"我无法|我不能|我不便|拒绝回答|不予回答|不提供|不作答|无法对[^\n。]*(?:评价|判断|打分|评分|给出)",
    r"作为(?:一个)?(?:人工智能|AI)[^。\n]{0,90}不对[^。\n]{0,50}(?:主观评分|价值判断|打分)",
)
YES_WORDS, NO_WORDS = ("yes", "y", "是", "对", "正确"), ("no", "n", "否", "不", "错误")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: str | Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is evaluated once in each row: where f names the column itself often, Spark evaluates it as often."""
    return F.get(F.transform(F.array(_c(c)), f), F.lit(0))


def number(c: str | Column) -> Column:
    """A whole-string signed decimal, finite, else null. 5. and .5 are decimals."""
    text = F.trim(_c(c))
    value = F.when(text.rlike(f"^{LITERAL}$"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def interval(c: str | Column) -> Column:
    """struct(lower, upper, unit) of a closed interval at the start: a-b, a to b, between a and b, from a to b, [a, b], with
    a percent sign on either end; null if there is none, or if another alternative follows."""
    text = F.trim(_c(c))
    n = rf"({NUMBER})\s*(%?)"
    shapes = [rf"^{n}\s*(?:-|–|~|to\b|到|至)\s*{n}", rf"(?i)^between\s+{n}\s+and\s+{n}", rf"(?i)^from\s+{n}\s+to\s+{n}", rf"^\[\s*{n}\s*,\s*{n}\s*\]"]
    out = F.lit(None).cast("struct<lower:double,upper:double,unit:string>")
    for shape in reversed(shapes):
        tail = F.regexp_replace(text, shape, "")
        hit = text.rlike(shape) & ~tail.rlike(r"(?i)^\s*(?:or|或|/|,)\s*[0-9]")
        get = lambda k, shape=shape: F.regexp_extract(text, shape, k)
        unit = F.when((get(2) == "%") | (get(4) == "%"), "%").otherwise("")
        out = F.when(hit, F.struct(get(1).cast("double").alias("lower"), get(3).cast("double").alias("upper"), unit.alias("unit"))).otherwise(out)
    return out


def interval_status(span: Column, minimum: Column, maximum: Column) -> Column:
    """How an interval counts for a slot: reversed is unresolved, beyond the bounds is out of range, both ends stay."""
    return (
        F.when(span.isNull(), None).when(span["lower"] > span["upper"], "range_unresolved")
        .when((span["lower"] < minimum) | (span["upper"] > maximum), "range_out_of_range").otherwise("range_response")
    )


def scalar(c: str | Column, maximum: Column | None = None) -> Column:
    """struct(value, status): the score that an answer states. A leading number counts with a harmless tail or a reason, or
    after a score word; n/max reads n; alternatives, ranges and lists are not resolved; numbers inside prose never count."""
    lead, after = rf"^({NUMBER}){AND_SO_ON}(?:$|{REASON[4:]}$)", rf"{SCORE_WORDS}({NUMBER}){AND_SO_ON}(?:$|{REASON[4:]}$)"
    fraction = rf"^({NUMBER})\s*/\s*({NUMBER}){AND_SO_ON}$"

    def stated(text: Column) -> Column:
        number_of = lambda p, k=1: F.regexp_extract(text, p, k).try_cast("double")
        is_fraction = text.rlike(fraction) & (number_of(fraction, 2) == maximum) if maximum is not None else F.lit(False)
        out = lambda status, value=None: F.struct((F.lit(None) if value is None else value).cast("double").alias("value"), F.lit(status).alias("status"))
        number = F.when(text.rlike(f"(?i){lead}"), number_of(f"(?i){lead}")).when(text.rlike(after), number_of(after))
        return (
            F.when(F.coalesce(text, F.lit("")) == "", out("missing")).when(F.coalesce(is_fraction, F.lit(False)), out("parsed", number_of(fraction)))
            .when(interval(text).isNotNull() | text.rlike(rf"(?i)^{NUMBER}\s*(?:or|或|/)\s*{NUMBER}"), out("range_unresolved"))
            .when(text.rlike(rf"^{NUMBER}\s*,\s*{NUMBER}"), out("multiple_values")).otherwise(once(number, lambda n: F.when(n.isNotNull(), out("parsed", n)).otherwise(out("unparsed"))))
        )

    return once(F.trim(_c(c)), stated)


def typed_number(value: Column, kind: Column, minimum: Column, maximum: Column) -> Column:
    """struct(score, status) of a number in a slot: a fraction in an integer slot has no score, beyond bounds keeps it."""
    status = (
        F.when(value.isNull(), "missing").when((kind == "integer") & (value != F.floor(value)), "non_integer")
        .when((value < minimum) | (value > maximum), "out_of_range").otherwise("parsed")
    )
    return F.struct(F.when(status != "non_integer", value).alias("score"), status.alias("status"))


def choice(c: str | Column, choices: Column) -> Column:
    """The listed choice that an answer names: without regard to case, 3.0 as 3; where yes and no are the only choices, also
    by their other words in two languages; else null."""
    text = F.lower(F.trim(_c(c)))
    plain = F.regexp_replace(F.regexp_replace(text, r"[.。!]+$", ""), r"^([0-9]+)\.0+$", "$1")

    def listed(plain: Column) -> Column:
        alias = F.when(plain.isin(*YES_WORDS), "yes").when(plain.isin(*NO_WORDS), "no")
        decision = F.array_sort(F.transform(choices, lambda x: F.lower(x))) == F.array(F.lit("no"), F.lit("yes"))
        said = F.when(alias.isNull(), plain).otherwise(F.coalesce(F.when(decision, alias), plain))
        return once(said, lambda said: F.get(F.filter(choices, lambda x: F.lower(x).isin(plain, said)), 0))

    return once(plain, listed)


def pair_code(c: str | Column, choices: Column) -> Column:
    """Two different digits 1 to 7 joined by a dash, a slash or "and", as low-high, if listed."""
    p = r"(?i)^\s*\(?([1-7])\s*(?:-|–|/|,|and|和)\s*([1-7])\)?\s*\.?\s*$"
    a, b = F.regexp_extract(_c(c), p, 1), F.regexp_extract(_c(c), p, 2)
    code = F.when((a != "") & (a != b), F.concat_ws("-", F.least(a, b), F.greatest(a, b)))
    return F.when(F.array_contains(choices, code), code)


def reply_class(reply: str | Column, parse_status: str | Column) -> Column:
    """empty_response, then what was parsed, then refusal wording, else unparsed."""
    text, status = _c(reply), _c(parse_status)
    straight, refused = F.translate(text, "’‘", "''"), F.lit(False)
    for pattern in REFUSAL:
        refused = refused | straight.rlike(pattern)
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_response").when(status.isin("ok", "partial"), status)
        .when(refused, "refusal").otherwise("unparsed")
    )


def parts(c: str | Column, size: int) -> Column:
    """A text in parts of at most ``size`` UTF-16 units; a character beyond the basic plane is never split. Texts without
    such characters, the usual case, are cut by position."""
    text = _c(c)
    count = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1))
    plain = F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size)))
    # two units each: cut at half the size, which always fits
    half = size // 2
    wide_count = F.greatest(F.ceil(F.length(text) / half).cast("int"), F.lit(1))
    wide = F.transform(F.sequence(F.lit(1), wide_count), lambda i: F.substring(text, (i - 1) * half + 1, F.lit(half)))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), wide).otherwise(plain)


def visible_controls(c: str | Column) -> Column:
    r"""Control characters that a sheet cannot hold as \uXXXX."""
    out = _c(c)
    for code in [*range(0, 9), 11, 12, *range(14, 32)]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return out


def safe_name(c: str | Column) -> Column:
    """A name that paths can hold."""
    text = F.translate(F.trim(_c(c)), '<>:"/\\|?*', "_" * 9)
    return F.coalesce(F.nullif(F.regexp_replace(text, r"[. ]+$", ""), F.lit("")), F.lit("unnamed"))


def utc_text(c: str | Column, fallback: Column) -> Column:
    """An ISO time with an offset as UTC text; times without an offset or that cannot be read take the fallback."""
    text = _c(c)
    stamp = F.when(text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))
    return F.date_format(F.coalesce(stamp, fallback), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shanghai_text(utc: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(F.try_to_timestamp(utc), "Asia/Shanghai"), "yyyy-MM-dd'T'HH:mm:ss'+08:00'")


def safe_endpoint(c: str | Column) -> Column:
    """Scheme, host, port and path of a URL; user info, query and fragment go; what is no URL passes trimmed."""
    text = F.trim(_c(c))
    p = r"^([a-zA-Z][a-zA-Z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"
    return F.when(text.rlike(p), F.concat(F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 3))).otherwise(text)


def proxy_identity(c: str | Column) -> Column:
    """struct(scheme, host, port, display, has_credentials, fingerprint) of a proxy's URL, without its credentials."""
    text = F.trim(_c(c))
    p = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?"
    get = lambda k: F.regexp_extract(text, p, k)
    display = F.concat(F.lower(get(1)), F.lit("://"), F.lower(get(3)), F.when(get(4) != "", F.concat(F.lit(":"), get(4))).otherwise(""))
    return F.struct(F.lower(get(1)).alias("scheme"), F.lower(get(3)).alias("host"), get(4).try_cast("int").alias("port"), display.alias("display"), (get(2) != "").alias("has_credentials"), F.sha2(display, 256).alias("fingerprint"))


#: Reply headers that may be kept.
KEPT_HEADERS = ("x-request-id", "openai-processing-ms", "openai-version", "openai-organization", "openai-project", "retry-after", "server", "date")


def kept_headers(c: str | Column) -> Column:
    return F.map_filter(F.transform_keys(_c(c), lambda k, v: F.lower(k)), lambda k, v: k.isin(*KEPT_HEADERS))


#: Fixed value: shapes of keys.
KEY_SHAPES = r"\b(?:sk-[A-Za-z0-9_-]{24,}|gh[pousr]_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_-]{30,})\b"


def credential_count(c: str | Column) -> Column:
    return F.size(F.regexp_extract_all(_c(c), F.lit(KEY_SHAPES), F.lit(0)))


def canonical_hash(*columns: str) -> Column:
    """sha256 of a canonical JSON object: names in order, nulls kept, no blanks."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def trial_seed(master: Column, *parts: Column) -> Column:
    """A reproducible seed below 2**31 - 1 from the first 16 hex digits of a digest."""
    digest = F.sha2(F.concat_ws("|", master.cast("string"), *[p.cast("string") for p in parts]), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(2147483647)).cast("long")


def numbered_items(c: str | Column) -> Column:
    """The items of a numbered list; wrapped lines stay with their item."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit(r"(?s)(?:^|\n)[0-9]+[.)] (.*?)(?=\n[0-9]+[.)] |$)"), F.lit(1)), lambda x: F.trim(x))
