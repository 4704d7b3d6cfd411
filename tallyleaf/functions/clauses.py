"""Selections in prose, clause by clause, as column expressions: what an answer chooses counts only where its own clause does
not negate it or offer another, and different selections give none."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyleaf.functions import values as v

#: Where clauses end, words of choosing, of negation and of alternatives, notes, labels of diagrams.
CLAUSE_END = r"[;。；\n!?！？]|\.(?![0-9])|,?\s*\bbut\b|但是?"
MARK = r"(?:\b(?:answer|response|choice|selected|selection|choose|select|pick)\b|选的是?|我选择|我选|选择|选项|选|答案|回答|判断)\s*(?:(?:is|为|是)\s*)?[:：=]?\s*"
NEGATION = r"(?:\b(?:not|never|don't|doesn't|didn't|cannot|can't|won't|wouldn't)\s+(?:(?:choose|select|pick)\s+)?(?:the\s+)?|不(?:是|会)?|并非|没有)\s*"
WRAPPED = r"(?:(?:option|choice|pair|diagram|编号|选项|图[片示]?)\s*)?[(\[（【*_`\"']*\s*"
OTHERS = r"\s*[)\]）】*_`\"']*\s*(?:\bor\b|\band\b|或者?|还是|和|/)"
NOTE = r"(?i)^[（(]?\s*(?:注[:：]|note\b|because\b|理由[:：]?|解释[:：]|reason(?:ing)?\b|explanation[:：]|rationale[:：])"
DIAGRAM = r"(?:\b(?:pair|figure|diagram|picture|image|option|circle|choose|select|pick|choice|answer)\b|图(?:片|示|形)?|对应|选择|选项|我选|选|答案)\s*(?:(?:is|number|no\.?|为|是|编号)\s*)?[:：=#]?\s*(?:第\s*)?"
CODE = r"\(?\s*([1-7])(?![0-9]|\.[0-9])\s*\)?"
MORE_CODES = r"\s*\(?\s*(?:or\b|and\b|或者?|和|至|到|[/,，、&—–~-])\s*\(?\s*[+-]?[0-9]"
#: Explicit wording of a logical decision.
VAGUE = (
    r"(?i)\bnot\s+(?:logically\s+)?invalid\b|(?:并非|不是)\s*(?:逻辑(?:上)?无效|不能推出)", r"(?i)\bif\b.*\b(?:logically\s+)?(?:valid|invalid)\b|\b(?:would|might|could)\s+be\s+(?:logically\s+)?(?:valid|invalid)\b|如果.*逻辑.*(?:有效|无效)",
    r"(?i)\b(?:YES|NO|VALID|INVALID)(?:\s+(?:or|and)\s+|\s*[/／|,，]\s*|\s+)(?:YES|NO|VALID|INVALID)\b|是或否|是还是否",
)
DENIES = r"(?i)\b(?:this|conclusion|it)\s+(?:does\s+not|doesn't|cannot|can't)\s+(?:logically\s+)?follow\b|\b(?:not\s+(?:logically\s+)?valid|logically\s+(?:not\s+valid|invalid)|this\s+does\s+not\s+imply)\b|(?:并非|不是|不具备|没有)\s*逻辑(?:上)?(?:的)?(?:有效|成立)|(?:结论|逻辑|推理|推导)[^。；\n]{0,12}(?:不能推出|不成立|无效|不有效)"
AFFIRMS = r"(?i)\bfollows\s+(?:logically|from\s+(?:the\s+)?premises)\b|\blogically\s+valid\b|(?:结论|逻辑|推理|推导)[^。；\n]{0,12}(?:成立|有效)"
VERDICT = r"(?i)(?:^|[。.!:：—–]\s*|\s)(YES|NO|VALID|INVALID)\s*(?=$|[.!:：,(（]|from\s+(?:the\s+)?premises)"
MARKED_VERDICT = r"(?i)(?:^|[。；]|所以|因此|(?:逻辑(?:判断|推导|判断结果)?|判断|答案|answer)\s*[:：])\s*(不能推出|能推出|可推出|是|否)(?=$|[。，,.！!（(\s])"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clauses(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(_c(c), f"(?i){CLAUSE_END}"), lambda x: F.trim(x)), lambda x: x != "")


def _quote(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), x, F.lit(r"\E(?![\w]|\.[0-9])"))


def _that(choices: Column | Sequence[str], holds: Callable[[Column], Column]) -> Column:
    """The choices for which something holds. Where they are known beforehand, patterns with them are literals, which Spark
    compiles once and not for each row."""
    if isinstance(choices, Column):
        return F.filter(choices, holds)
    return F.filter(F.array(*[F.when(holds(F.lit(x)), F.lit(x)) for x in choices]).cast("array<string>"), lambda x: x.isNotNull())


def _says(text: Column, before: str, x: Column, after: str = "") -> Column:
    """Whether a text has a choice between two patterns."""
    return F.regexp_like(text, F.concat(F.lit(f"(?i){before}"), _quote(x), F.lit(after)))


def _leads(c: Column, choices: Column | Sequence[str]) -> Column:
    """The listed choice that a text begins with, if no alternative and no other choice follows."""

    def leads(text: Column) -> Column:
        only = lambda here: F.when((F.size(here) == 1) & (F.size(_that(choices, lambda x: _says(text, r"(?<![\w])", x))) == 1), F.get(here, F.lit(0)))
        return F.when(~text.rlike(r"(?i)\bor\b|\band\b|或|还是|和"), v.once(_that(choices, lambda x: _says(text, r"^\s*" + WRAPPED, x)), only))

    return v.once(c, leads)


def selected_choice(c: str | Column, choices: Column | Sequence[str]) -> Column:
    """The one listed choice that an answer selects: alone, behind a word of choosing in a clause that neither negates it nor
    offers another, at its beginning, or behind a label and a colon. Choices that are the same for all rows come as a list."""
    listed = choices if isinstance(choices, Column) else F.array(*[F.lit(x) for x in choices]).cast("array<string>")
    marked = lambda p, x: _says(p, MARK + WRAPPED, x) & ~_says(p, MARK + WRAPPED, x, OTHERS)
    denied = lambda p, x: _says(p, NEGATION + MARK + WRAPPED, x)

    def selected(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.trim(text), rf"(?i)^{WRAPPED}", ""), r"[)\]）】\"'.。!！\s]+$", "")
        first = F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
        behind = v.once(first, lambda x: F.when(x.rlike("[:：=]"), F.regexp_replace(x, r"^[^:：=]*[:：=]\s*", "")))

        def by_clause(parts: Column) -> Column:
            denies = F.filter(parts, lambda p: p.rlike(f"(?i){NEGATION}{MARK}"))
            refused = v.once(denies, lambda some: F.when(F.size(some) > 0, F.size(_that(choices, lambda x: F.exists(some, lambda p: denied(p, x)))) > 0).otherwise(False))
            free = F.when(~refused, F.coalesce(_leads(text, choices), _leads(behind, choices)))
            picked = F.when(F.size(parts) > 0, _that(choices, lambda x: F.exists(parts, lambda p: marked(p, x) & ~denied(p, x)))).otherwise(F.array().cast("array<string>"))
            return v.once(picked, lambda found: F.when(F.size(found) > 0, F.when(F.size(found) == 1, F.get(found, F.lit(0)))).otherwise(free))

        said = F.filter(clauses(text), lambda p: p.rlike(f"(?i){MARK}"))  # no other clause picks or refuses
        return F.coalesce(v.choice(bare, listed), v.once(said, by_clause))

    return v.once(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[*_`~]", ""), selected)


def diagram_label(c: str | Column) -> Column:
    """The one diagram, 1 to 7, that an answer names: the first line that says anything decides; notes and negated labels say
    nothing, several labels or alternatives give null."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[*_`]", ""), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(NOTE))

    def outcome(line: Column) -> Column:
        kept = F.regexp_replace(line, f"(?i){NEGATION}{DIAGRAM}{CODE}", " ")
        labels = F.array_distinct(F.regexp_extract_all(kept, F.lit(f"(?i){DIAGRAM}{CODE}"), F.lit(1)))
        target = F.regexp_replace(line, r"^.*(?:[:：→]|[—–]|\s-\s)\s*", "")
        leading = F.regexp_extract(target, f"^\\s*{CODE}", 1)
        return (
            F.when(F.size(labels) > 1, "?").when(F.size(labels) == 1, F.when(kept.rlike(f"(?i){DIAGRAM}{CODE}{MORE_CODES}"), "?").otherwise(F.get(labels, F.lit(0))))
            .when(line.rlike(f"(?i){DIAGRAM}{CODE}") | (leading == ""), "").when(target.rlike(f"(?i)^\\s*{CODE}{MORE_CODES}"), "?").otherwise(leading)
        )

    return F.nullif(F.get(F.filter(F.transform(lines, outcome), lambda x: x != ""), F.lit(0)), F.lit("?"))


def logical_decision(c: str | Column) -> Column:
    """YES or NO from explicit wording on validity; double negation, conditions, both at once, and different decisions give
    null."""

    def decided(text: Column) -> Column:
        vague = F.lit(False)
        for pattern in VAGUE:
            vague = vague | text.rlike(pattern)
        plain = F.regexp_replace(text, r"(?i)\bnot\s+(?:logically\s+)?(?:valid|invalid)\b", " ")
        words = F.transform(F.regexp_extract_all(plain, F.lit(VERDICT), F.lit(1)), lambda x: F.when(F.upper(x).isin("YES", "VALID"), "YES").otherwise("NO"))
        marks = F.transform(F.regexp_extract_all(text, F.lit(MARKED_VERDICT), F.lit(1)), lambda x: F.when(x.isin("是", "能推出", "可推出"), "YES").otherwise("NO"))
        by_wording = F.when(text.rlike(DENIES), F.array(F.lit("NO"))).when(text.rlike(AFFIRMS), F.array(F.lit("YES"))).otherwise(F.array().cast("array<string>"))
        found = F.array_distinct(F.concat(by_wording, words, marks))
        return F.when(~vague, v.once(found, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)))))

    return v.once(F.coalesce(_c(c), F.lit("")), decided)
