"""One reply with its slots to typed answers, in plain Python over Arrow batches: what ``replies`` does in each row. Texts are
as Spark's columns see them: \\s and \\w are ASCII, blanks are trimmed as spaces only. What is found in a short line is kept for
other lines that say the same, up to a fixed number of them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa

from tallyleaf.functions import clauses as cl
from tallyleaf.functions import values as v

READABLE = ("parsed", "out_of_range", "text_response", "range_response", "range_out_of_range")
NEWLINE = r"\r\n|[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]"
SPACES = " \t\n\x0b\f\r"

#: Openings of items, headings and answers.
OPENER = r"^\s*\**([0-9]{1,6})\s*(?:\.(?![0-9])|[)、])\**\s*(.*)$"
SUMMARY = r"(?i)^\s*(?:[#*]+\s*)?(?:final\s+)?(?:summary|answers|scores)\s*[:：*]*\s*$|^\s*(?:[#*]+\s*)?(?:final\s+)?summary\b|^\s*(?:最终)?(?:总结|汇总)"
TOKEN = r"([0-9]{1,3}|[A-Za-z]|[IVXivx]{1,4}|[一二三四五六七八九十]{1,2})"
CONTEXT = rf"(?i)^\W{{0,4}}(scenario|episode|context|story|情境|情景|故事)\s*{TOKEN}\b?\W*?(?:[:：.、–—-].*)?\W*$"
SECTION = rf"(?i)^\W{{0,4}}(section|part|task|部分|任务)\s*{TOKEN}\b?\W*?(?:[:：.、–—-].*)?\W*$"
LETTER = r"^\s*([A-C]|I{1,3})[.)]\s*$"
TITLE = r"^\s*(?:#{1,6}\s+\S.*|\*\*[^*]+\*\*\s*[:：]?)\s*$"
ANSWER_HEAD = r"(?i)^\W*(?:(?:my|final|your)\s+)?(?:answer|score|rating|response|value|答案|评分|分数|得分|回答)s?\b?\W*(?:\(.*\))?\W*$"
FINAL = r"(?i)^\s*(?:so\s+)?(?:(?:my\s+)?final\s+(?:answer|score|rating)(?:\s+is)?|my\s+(?:score|rating|estimate)(?:\s+is)?|I(?:'d| would| will)?\s+(?:rate(?:\s+it)?|give(?:\s+it)?|choose)|最终(?:答案|分数)(?:为|是)?)\s*[:：=]?\s*(?=[+-]?\.?[0-9])"
CHOOSES = r"(?i)^\s*(?:\b(?:I\s+(?:would\s+|will\s+)?)?(?:choose|select|pick|answer|response|choice|option)(?:\s+is)?\b|我(?:选择|选)|选择|答案|回答|选项)\s*[:：=]?\s*"
BECAUSE = r"(?i)\s*(?:\b(?:because|since)\b|因为|理由[:：]|解释[:：]).*$"

#: Digits in circles; quotes, minus and full-width signs with their plain forms.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
WIDE = "’‘“”−" + "".join(chr(k + 0xFEE0) for k in range(0x21, 0x7F) if chr(k) != "：")
PLAIN = "''\"\"-" + "".join(chr(ord(c) - 0xFEE0) for c in WIDE[5:])
_PLAIN = str.maketrans(WIDE, PLAIN)

#: Lines of at most so many characters are remembered, so many of each kind, and so many slots.
SHORT, KEPT, SLOTS = 200, 16_384, 4_096


def _re(pattern: str) -> re.Pattern:
    """A pattern of Spark's columns: there classes are ASCII, and words end where Unicode's do."""
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern).replace(r"\b", r"(?u:\b)"), re.ASCII)


_newline, _opener, _summary, _context, _section, _letter, _title = map(_re, (NEWLINE, OPENER, SUMMARY, CONTEXT, SECTION, LETTER, TITLE))
_answer_head, _final, _chooses, _because = map(_re, (ANSWER_HEAD, FINAL, CHOOSES, BECAUSE))
_rule, _row_number, _digit = _re(r"^[\s|:+-]+$"), _re(r"^\W*([0-9]{1,6})[.)]?\W*$"), _re("[0-9]")
_chinese, _not_word, _brackets, _numbered = re.compile("[一-\u9fff]"), re.compile(r"[\W_]+"), _re(r"[(\[][^)\]]*[)\]]"), _re(r"^\s*[0-9]+\s*[.)、]\s*")
_breaks, _bare, _separators = re.compile("[:：→—–]"), _re(r"^[\w.+-]{1,12}$"), _re(r"[\s,;|]+")
_strong, _said_score, _codebook, _list = _re(r"\*{1,3}|_{2,3}|`"), _re(r"(?i)^\s*(?:score|answer|rating|评分|答案)\s*[:=：]\s*"), _re(r"(?<![0-9])[0-9]+(?:\.[0-9]+)?\s*="), _re(r"^\s*[+-]?[0-9]+(?:\.[0-9]+)?\s*[,;]\s*[+-]?[0-9]")
_circle, _leading_circle, _options = _re(f"[{CIRCLED}]"), _re(rf"(?:^|[:：→—–]\s*)([{CIRCLED}])"), _re(rf"([{CIRCLED}])[^\n]*?[:：=]")
_literal = _re(f"^{v.LITERAL}$")
_n = rf"({v.NUMBER})\s*(%?)"
_spans = [_re(p) for p in (rf"^{_n}\s*(?:-|–|~|to\b|到|至)\s*{_n}", rf"(?i)^between\s+{_n}\s+and\s+{_n}", rf"(?i)^from\s+{_n}\s+to\s+{_n}", rf"^\[\s*{_n}\s*,\s*{_n}\s*\]")]
_another = _re(r"(?i)^\s*(?:or|或|/|,)\s*[0-9]")
_ending = rf"{v.AND_SO_ON}(?:$|{v.REASON[4:]}$)"
_lead, _after, _fraction = _re(rf"(?i)^({v.NUMBER}){_ending}"), _re(rf"{v.SCORE_WORDS}({v.NUMBER}){_ending}"), _re(rf"^({v.NUMBER})\s*/\s*({v.NUMBER}){v.AND_SO_ON}$")
_either, _several = _re(rf"(?i)^{v.NUMBER}\s*(?:or|或|/)\s*{v.NUMBER}"), _re(rf"^{v.NUMBER}\s*,\s*{v.NUMBER}")
_refusals = [_re(p) for p in v.REFUSAL]
_mark, _denial, _clause_end, _wrapped = _re(f"(?i){cl.MARK}"), _re(f"(?i){cl.NEGATION}{cl.MARK}"), _re(f"(?i){cl.CLAUSE_END}"), _re(rf"(?i)^{cl.WRAPPED}")
_alternatives = _re(r"(?i)\bor\b|\band\b|或|还是|和")


def _short(f: Callable) -> Callable:
    """Remembers what f finds in a short text; long ones are rarely the same."""
    kept = lru_cache(KEPT)(f)

    @wraps(f)
    def found(text, *more):
        return kept(text, *more) if len(text) <= SHORT else f(text, *more)

    return found


@_short
def words_of(text: str) -> str:
    """Letters and digits, lower case: without brackets and without a leading number."""
    return _not_word.sub("", _numbered.sub("", _brackets.sub("", text))).lower()


def number(text: str | None) -> float | None:
    text = (text or "").strip(" ")
    value = float(text) if _literal.search(text) else None
    return value if value is not None and abs(value) < float("inf") else None


class Slot:
    """What a slot asks for, and what evidence needs of it."""

    __slots__ = ("slot_id", "kind", "low", "high", "choices", "labels", "source_no", "linked", "asked", "least", "opening", "context", "section", "listed")

    def __init__(self, slot_id, question, kind, low, high, choices, labels, context, section, source_no, linked):
        self.slot_id, self.kind, self.low, self.high, self.choices, self.source_no, self.linked = slot_id, kind, low, high, choices or (), source_no, linked
        self.labels = None if labels is None else [(k.lower(), x) for k, x in labels]
        self.asked = words_of((question or "").split("\n")[0])
        chinese = _chinese.search(self.asked)
        self.least, self.opening = (2 if chinese else 4), (self.asked[: 14 if chinese else 32] if len(self.asked) >= 24 else None)
        self.context, self.section = (None if x is None else _not_word.sub("", x).lower() for x in (context, section))
        self.listed = kind == "choice" and bool(self.choices)

    def takes(self, token: str) -> bool:
        """Whether a bare token is a valid answer."""
        if self.kind == "text":
            return False
        if self.listed:
            return any(x is not None and x.lower() == token.lower() for x in self.choices)
        n = number(token)
        if n is None or token.endswith(".") or (self.low is not None and n < self.low) or (self.high is not None and n > self.high):
            return False
        return n == n // 1 or self.kind not in ("integer", None)


@lru_cache(SLOTS)
def _slot(*given) -> Slot:
    return Slot(*given)


# What a line is


@_short
def _marked(line: str) -> tuple:
    """(blank, cells, rule, column of answers that a header names, summary, context, its word, section, its word, number, body)"""
    trimmed = line.strip(" ")
    if trimmed.startswith("|"):
        cells = [x.strip(" ") for x in trimmed.removeprefix("|").removesuffix("|").split("|")]
        heads = None if _digit.search(cells[0]) else next((k for k, x in enumerate(cells) if _answer_head.search(x)), None)
        return False, cells, bool(_rule.search(line)), heads, False, None, None, None, None, None, line
    opens, c, s = _opener.search(line), _context.search(line), _section.search(line)
    summary = bool(_summary.search(line))
    section = s[2].lower() if s else (x[1].lower() if (x := _letter.search(line)) else None)
    if section is None and c is None and not summary and not opens and _title.search(line):
        section = words_of(line)
    return trimmed == "", None, False, None, summary, c and c[2].lower(), c and c[1].lower(), section, s and s[1].lower(), int(opens[1]) if opens else None, opens[2] if opens else line


class Record:
    """Lines that say one thing, and where they stand."""

    __slots__ = ("number", "value", "row_words", "lines", "scope", "segment", "named", "body", "pool", "scoped", "sourced", "rung", "found", "told")


def records(lines: list[str], n_slots: int) -> list[Record]:
    """A numbered line, a table's row, or a line that stands alone opens a record; what follows belongs to it. Headings of
    contexts and sections, summaries, rules and headers belong to none."""
    marks = [_marked(x) for x in lines]
    any_number = any(m[9] is not None for m in marks)
    out: list[Record] = []
    context = context_full = section = section_full = column = None
    segment = told = 0
    opened = False
    for blank, cells, rule, heads, summary, c, cw, s, sw, n, body in marks:
        row, heading = cells is not None, summary or c is not None or s is not None
        if c is not None or summary:
            context = context_full = section = section_full = None
        if heading:
            opened, told = False, 0
        segment += summary
        if heads is not None:
            column = heads
        if c is not None:
            context, context_full = c, cw + c
        if s is not None:
            section, section_full = s, (sw or "") + s
        opened |= n is not None
        says = not heading and not row and not blank
        told += says
        if heading or rule or heads is not None:
            continue
        value = None
        if row:
            at = column if column is not None else 1 if len(cells) == 2 else None
            if at is None or at >= len(cells):
                continue
            value = cells[at]
        if n is not None or row or (says and not opened and ((n_slots > 1 and not any_number) or told == 1)):
            r = Record()
            r.number, r.value, r.row_words = n, value, None
            if row:
                m = _row_number.search(cells[0])
                r.number, r.row_words = int(m[1]) if m else None, " ".join(x for k, x in enumerate(cells) if k != (1 if column is None else column))
            r.lines, r.segment, r.scope = [body], segment, "/".join(x for x in (context, section) if x is not None)
            r.named = (context, context_full, section, section_full)
            out.append(r)
        elif out:
            out[-1].lines.append(body)
    for r in out:
        r.body = "\n".join(r.lines).rstrip(SPACES)
    return out


# What a sheet says


def _once(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a name is there twice")
    return found


def _no_number(name: str) -> None:
    raise ValueError(name)


_json, _gaps = json.JSONDecoder(object_pairs_hook=_once, parse_constant=_no_number), " \t\n\r"
_fence = re.compile(r"^```(?:json)?\s*([\[{].*[\]}])\s*```(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)", re.I | re.S | re.A)
_object_line, _odd, _whole, _index = _re(r"^\s*\{.*\}\s*$"), _re(r"^\s*(?:true|false|\[.*\])\s*$"), _re(r"^[+-]?[0-9]{1,9}$"), _re(r"^#?([0-9]{1,6})$")


def _value(text: str) -> tuple:
    """The JSON value that a text begins with, and where it ends."""
    try:
        return _json.raw_decode(text)
    except (ValueError, RecursionError):
        return None, -1


def _as_text(x) -> str | None:
    if x is None or isinstance(x, str):
        return x
    return str(x) if type(x) is int else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _entry(key: str | None, body: str | dict | None, ids: list[str], kind: str) -> tuple:
    """(position, answer, defect) of an entry of a sheet."""
    fields = body if isinstance(body, dict) else {} if body is not None and body.lstrip(SPACES).startswith("{") else None
    named, said = None, None
    if fields is not None:
        said = _as_text(fields.get("display_index"))
        said = _as_text(fields.get("index")) if said is None else said
        named = _as_text(fields.get("slot_id"))
    if said is None and key is not None:
        m = _index.search(key)
        said = m[1] if m else None
    if named is None and key is not None and not key.startswith("#") and not (key.isascii() and key.isdigit()):
        named = key
    index = int(x) if said is not None and _whole.search(x := said.strip(SPACES)) else 0
    pos = (ids.index(named) + 1 if named in ids else None) if named is not None else index if 1 <= index <= len(ids) else None
    answer = body if fields is None else _as_text(fields.get("answer"))
    defect = None
    if fields is None and key is None:
        defect = "entry_not_object"
    elif pos is None:
        defect = "invalid_display_index" if named is None else "unknown_slot_id"
    elif fields is not None and "answer" not in fields:
        defect = "missing_answer"
    elif answer is None:
        defect = "null_answer"
    elif answer.strip(" ") == "":
        defect = "empty_answer"
    elif isinstance(fields["answer"], bool | dict | list) if fields is not None else kind == "json" and _odd.search(answer):
        defect = "invalid_answer_type"
    return pos, answer, defect


def sheet_of(text: str, some: list[str], slots: list[Slot]) -> tuple | None:
    """(kind, entries, what a text that only begins as an object does gives for an answer) of a reply that is JSON without
    fractions and escapes; ``replies.sheet`` says the same of all JSON."""
    ids = [s.slot_id for s in slots]
    if some and all(_object_line.search(x) for x in some):
        values = [_value(x.lstrip(_gaps)) for x in some]
        order = lambda x: (x is None, x or "")
        if all(end > 0 for _, end in values) and sorted((_as_text(x.get("slot_id")) for x, _ in values), key=order) == sorted(ids, key=order):
            return "json_lines", [_entry(None, x, ids, "json_lines") for x, _ in values], None
    trimmed = text.strip(" ")
    bare = _fence.sub(lambda m: m[1], trimmed)
    top, end = _value(bare) if bare[:1] in ("[", "{") else (None, -1)
    if end < 0 or bare[end:].strip(_gaps):
        if text.lstrip(SPACES).startswith("{"):
            top, end = _value(trimmed.lstrip(_gaps))
            return None, [], _as_text(top.get("answer")) if end > 0 else None
        return None
    listed = top if isinstance(top, list) else top["answers"] if isinstance(top.get("answers"), list) else None
    bodies = [x if isinstance(x, dict) or x is None else _as_text(x).rstrip(SPACES) for x in (top.values() if listed is None else listed)]
    if listed is None:
        keys = list(top)
    else:
        plain = len(bodies) == len(ids) and not any(isinstance(x, dict) or (x is not None and x.lstrip(SPACES)[:1] in ("[", "{")) for x in bodies)
        keys = [f"#{k}" for k in range(1, len(bodies) + 1)] if plain else [None] * len(bodies)
    return "json", [_entry(k, x, ids, "json") for k, x in zip(keys or [None], bodies or [None], strict=True)], None


# Which slots a record means


def by_words(r: Record, asked: list[tuple]) -> None:
    """Sets the rung, the slots whose question a record says, and the text behind it. asked: (slot, words, how long they must be
    at least, how they open) of slots with a question."""
    first, _, more = r.body.partition("\n")
    broken = _breaks.search(first)
    words = words_of(first if r.row_words is None else r.row_words)
    found = [e for e in asked if e[1] in words and len(e[1]) >= e[2]]
    if len(found) > 1:
        longest = max((len(e[1]), e[1]) for e in found)[1]
        if all(e[1] in longest for e in found):
            found = [e for e in found if e[1] == longest]
    rung = "question" if 1 <= len(found) <= 2 else None
    if rung is None:
        found = [e for e in asked if (len(words) >= 8 and e[1].startswith(words)) or (e[3] is not None and e[3] in words)]
        rung = "prefix" if len(found) == 1 else None
    if rung is None and (broken or r.row_words is not None):
        label = words_of(first[: broken.start()] if r.row_words is None else r.row_words)
        if (2 if _chinese.search(label) else 8) <= len(label) <= 30:
            found = [e for e in asked if label in e[1]]
            rung = "label" if len(found) == 1 else None
    if rung is None:
        return
    r.rung, r.found = rung, [e[0] for e in found]
    after = first[broken.end() :] if broken else ""
    r.told = r.value if r.value is not None else (f"{after}\n{more}" if more else after) if after.strip(" ") else more


def claims(said: list[Record], slots: list[Slot]) -> list[tuple]:
    """(record, method, slots that it may answer, text to read) by its words, its number, the order of a complete
    unnumbered reply, or as there is one slot only."""
    pools: dict[tuple, tuple] = {}
    for r in said:
        if r.named not in pools:
            context, context_full, section, section_full = r.named
            narrow = [k for k, s in enumerate(slots) if (context is None or s.context in (context, context_full)) and (section is None or s.section in (section, section_full))]
            pool = narrow or list(range(len(slots)))
            asked = [(k, s.asked, s.least, s.opening) for k in pool if (s := slots[k]).asked]
            pools[r.named] = (pool, bool(narrow) and (context is not None or section is not None), asked, any(slots[k].source_no is not None for k in pool))
        r.pool, r.scoped, asked, r.sourced = pools[r.named]
        r.rung = r.found = r.told = None
        if asked:
            by_words(r, asked)
    scopes: dict[int, set[str]] = {}
    groups: dict[tuple, list[Record]] = {}
    source = display = False
    for r in said:
        groups.setdefault((r.scope, r.segment), []).append(r)
        if r.number is not None:
            scopes.setdefault(r.number, set()).add(r.scope)
            if r.found:
                own, shown = slots[r.found[0]].source_no == r.number, 0 < r.number <= len(r.pool) and r.pool[r.number - 1] == r.found[0]
                source, display = source or (own and not shown), display or (shown and not own)
    restarts = any(len(x) > 1 for x in scopes.values())
    numbered = {g: any(r.number is not None for r in x) for g, x in groups.items()}
    nth: dict[tuple, int] = {}
    out = []
    for at, r in enumerate(said, 1):
        group, pool = (r.scope, r.segment), r.pool
        size, place = len(groups[group]), nth.get(group, 0)
        nth[group] = place + 1
        method, meant, told = r.rung, r.found, r.told
        free = r.scoped or (r.named[0] is None and r.named[2] is None)  # of headings that name no slots
        if method is None:
            told = r.body if r.value is None else r.value
            if r.number is not None:
                if not restarts or r.scoped:
                    own, shown = [k for k in pool if slots[k].source_no == r.number], pool[r.number - 1] if 0 < r.number <= len(pool) else None
                    if 1 <= len(own) <= 2 and not display:
                        method, meant = "source_number", own
                    elif shown is not None and own == [shown]:
                        method, meant = "aligned_number", own
                    elif shown is not None and (not r.sourced or (display and not source)):
                        method, meant = "local_number", [shown]
            elif not numbered[group] and size == len(pool) > 1 and not r.sourced and free:
                method, meant = "section_order", [pool[place]]
            elif len(pool) == 1 and size == 1 and free:
                method, meant = "single", pool
        if meant:
            out.append((at, r.scope, r.segment, method, meant, told, None))
    return out


def interview(lines: list[str], slots: list[Slot]) -> list[tuple]:
    """Claims of an interview: under headings that count every slot once, or under lines that each say one slot's question
    alone, or as many blank-line blocks as there are slots; else none."""
    stories, asks, blocks = [], [], []
    block, was = 0, True
    for x in lines:
        m, words = _context.search(x), words_of(x)
        stories.append(int(m[2]) if m and m[2].isascii() and m[2].isdigit() else None)
        found = [k for k, s in enumerate(slots) if len(s.asked) >= 8 and s.asked in words]
        asks.append(found[0] if len(found) == 1 else None)
        blank = x.strip(" ") == ""
        block += was and not blank
        blocks.append(block)
        was = blank
    times: dict[int, int] = {}
    for k in asks:
        if k is not None:
            times[k] = times.get(k, 0) + 1
    asks = [k if k is not None and times[k] == 1 else None for k in asks]
    told = sorted(x for x in stories if x is not None)
    by_story, asked = told == list(range(1, len(slots) + 1)), any(k is not None for k in asks)
    method = "story" if by_story else "interview_question" if asked else "blocks"
    if not by_story and not asked and (told or block != len(slots)):
        return []
    parts: dict[int, list[str]] = {}
    at = None
    for x, story, k, b in zip(lines, stories, asks, blocks, strict=True):
        if by_story:
            at = story - 1 if story is not None else at
        elif asked:
            at = k if k is not None else at
        else:
            at = b - 1
        if at is not None and at >= 0 and (story is None or not (by_story or asked)):
            parts.setdefault(at, []).append(x)
    return [(k + 1, "", 0, method, [k], "\n".join(x).strip(SPACES), None) for k, x in sorted(parts.items())]


# What a text says for a slot


def interval(text: str) -> tuple[float, float, str] | None:
    text = text.strip(" ")
    for shape in _spans:
        m = shape.search(text)
        if m and not _another.search(text[m.end() :]):
            return float(m[1]), float(m[3]), "%" if "%" in (m[2], m[4]) else ""
    return None


def scalar(text: str, high: float | None) -> tuple[float | None, str]:
    text = text.strip(" ")
    if text == "":
        return None, "missing"
    m = _fraction.search(text)
    if m and high is not None and float(m[2]) == high:
        return float(m[1]), "parsed"
    if interval(text) is not None or _either.search(text):
        return None, "range_unresolved"
    if _several.search(text):
        return None, "multiple_values"
    m = _lead.search(text) or _after.search(text)
    return (float(m[1]), "parsed") if m else (None, "unparsed")


@_short
def _line_says(full: str, high: float | None) -> tuple:
    """(line without emphasis, nothing, a list, whether it is a final pick, value, status, interval)"""
    line = _strong.sub("", full).strip(" ")
    rest = _said_score.sub("", _final.sub("", line))
    circled = m[1] if _circle.search(line) and (m := _leading_circle.search(line)) else ""
    if circled and len(set(_circle.findall(full))) == 1:
        rest = str(CIRCLED.index(circled) + 1)
    nothing = line in ("", "---") or len(_codebook.findall(full)) >= 3
    if nothing:
        return line, True, False, bool(_final.search(line)), None, None, None
    listing = bool(_list.search(rest))
    value, status = scalar(rest, high)
    return line, False, listing, bool(_final.search(line)), value, status, None if listing else interval(rest)


def _small(text: str) -> str:
    return _chooses.sub("", _because.sub("", text))


def _numeric(told: str, kind: str | None, low: float | None, high: float | None, labels: list | None) -> tuple:
    """(status, score, lower, upper) of an answer of a numeric slot."""
    values, finals, spans = [], [], []
    opened = listed = False
    said = 0
    for full in _newline.split(told):
        line, nothing, listing, final, value, status, span = _line_says(full, high)
        if labels is not None:
            small = re.sub(r"[\s.。!]+$", "", _small(line), flags=re.ASCII).lower()
            option = next((x for k, x in labels if k == small), None)
            if option is not None:
                value, status = number(option), "parsed"
        if status == "parsed" and not listing and value is not None:
            if value not in values:
                values.append(value)
            if final and value not in finals:
                finals.append(value)
        if span is not None and span not in spans:
            spans.append(span)
        opened |= not listing and status == "range_unresolved" and span is None
        listed |= listing
        said += not nothing
    beyond = lambda n: (low is not None and n < low) or (high is not None and n > high)
    if len(set(_options.findall(told))) >= 3:
        return "option_codebook", None, None, None
    if len(values) > 1:
        return "conflicting_values", None, None, None
    if (spans or opened) and not (len(finals) == 1 and len(values) == 1):
        if values or opened or len(spans) > 1:
            return "range_unresolved", None, None, None
        lower, upper, _ = spans[0]  # reversed ones stay too
        return "range_unresolved" if lower > upper else "range_out_of_range" if beyond(lower) or beyond(upper) else "range_response", None, lower, upper
    if not values:
        return "multiple_values" if listed and said == 1 else "unparsed", None, None, None
    value = values[0]
    if kind == "integer" and value != value // 1:
        return "non_integer", None, None, None
    return "out_of_range" if beyond(value) else "parsed", value, None, None


_plain_numeric = _short(_numeric)


@lru_cache(KEPT)
def _saying(before: str, choice: str, after: str = "") -> re.Pattern:
    return _re(rf"(?i){before}{re.escape(choice)}(?![\w]|\.[0-9]){after}")


def _leads(text: str | None, choices: list[str]) -> str | None:
    if text is None or _alternatives.search(text):
        return None
    here = [x for x in choices if _saying(r"^\s*" + cl.WRAPPED, x).search(text)]
    return here[0] if len(here) == 1 and sum(bool(_saying(r"(?<![\w])", x).search(text)) for x in choices) == 1 else None


def named_choice(text: str, choices: list[str]) -> str | None:
    text = text.strip(" ").lower()
    plain = re.sub(r"^([0-9]+)\.0+$", r"\1", re.sub(r"[.。!]+$", "", text))
    alias = "yes" if plain in v.YES_WORDS else "no" if plain in v.NO_WORDS else None
    said = alias if alias and sorted(x.lower() for x in choices) == ["no", "yes"] else plain
    return next((x for x in choices if x.lower() in (plain, said)), None)


def selected_choice(text: str, choices: list[str]) -> str | None:
    """``clauses.selected_choice`` for one text."""
    text = re.sub(r"[*_`~]", "", text)
    bare = re.sub(r"[)\]）】\"'.。!！\s]+$", "", _wrapped.sub("", text.strip(" ")), flags=re.ASCII)
    if (named := named_choice(bare, choices)) is not None:
        return named
    first = next((x for x in text.split("\n") if x.strip(" ")), None)
    behind = re.sub(r"^[^:：=]*[:：=]\s*", "", first, flags=re.ASCII) if first is not None and re.search("[:：=]", first) else None
    parts = [p for x in _clause_end.split(text) if x is not None and (p := x.strip(" ")) and _mark.search(p)]
    denied = lambda p, x: _saying(cl.NEGATION + cl.MARK + cl.WRAPPED, x).search(p)
    marked = lambda p, x: _saying(cl.MARK + cl.WRAPPED, x).search(p) and not _saying(cl.MARK + cl.WRAPPED, x, cl.OTHERS).search(p)
    picked = [x for x in choices if any(marked(p, x) and not denied(p, x) for p in parts)]
    if picked:
        return picked[0] if len(picked) == 1 else None
    denies = [p for p in parts if _denial.search(p)]
    if any(denied(p, x) for p in denies for x in choices):
        return None
    lead = _leads(text, choices)
    return lead if lead is not None else _leads(behind, choices)


def read(slot: Slot, told: str | None, defect: str | None) -> tuple:
    """(answer, score, lower, upper, status): what a text says for a slot, line by line; lines that define options and lists
    of scores say nothing."""
    text = (told or "").strip(" ")
    answer = text or None
    if defect is not None:
        return answer, None, None, None, defect
    if text == "":
        return None, None, None, None, "missing"
    if slot.kind == "text":
        return answer, None, None, None, "text_response"
    if not slot.listed:
        status, score, lower, upper = (_plain_numeric if slot.labels is None else _numeric)(told, slot.kind, slot.low, slot.high, slot.labels)
        return answer, score, lower, upper, status
    labels: list = []
    if slot.labels is not None:
        said = {re.sub(r"^\s+|[\s.。!]+$", "", _small(x), flags=re.ASCII).lower() for x in _newline.split(told)}
        labels = list(dict.fromkeys(x for k, x in slot.labels if k in said))
    if len(labels) > 1:
        return answer, None, None, None, "conflicting_values"
    chosen = labels[0] if labels else None
    if chosen is None:
        chosen = selected_choice(text, [x for x in slot.choices if x is not None])
    return (answer, None, None, None, "invalid_choice") if chosen is None else (chosen, number(chosen), None, None, "parsed")


# A reply


def settle(claimed: list[tuple], slots: list[Slot]) -> tuple[dict[int, tuple], set[str]]:
    """The answer (answer, score, lower, upper, status, method) of each slot that has one, and defects. Of two candidates the
    one that can be read counts, or both if they are linked; the order of a section counts if all of it can be read; equal
    answers agree, different ones conflict, and a value in a summary settles a range before it."""
    by_slot: dict[int, list[tuple]] = {}
    defects, orders = set(), {}
    for _, scope, segment, method, meant, told, defect in claimed:
        if defect is not None:
            defects.add(defect)
        if len(meant) == 1:
            k = meant[0]
            a = (*read(slots[k], told, defect), method, segment)
            if method == "section_order":
                orders.setdefault((scope, segment), []).append((k, a))
            elif k in by_slot:
                by_slot[k].append(a)
            else:
                by_slot[k] = [a]
        elif meant:
            said = [(k, read(slots[k], told, defect)) for k in meant]
            good = [(k, a) for k, a in said if a[4] in READABLE]
            if len(said) == 2 and len(good) == 2:
                method, linked = "linked", {slots[k].slot_id for k in meant} & {slots[k].linked for k in meant} - {None}
                good = good if linked else []
            elif len(good) != 1:
                good = []
            for k, a in good:
                by_slot.setdefault(k, []).append((*a, method, segment))
    if orders:
        for said in orders.values():
            if all(a[4] in READABLE for _, a in said):
                for k, a in said:
                    by_slot.setdefault(k, []).append(a)
    return {k: every[0][:6] if len(every) == 1 else _agreed(every, slots[k], defects) for k, every in by_slot.items()}, defects


def _agreed(every: list[tuple], slot: Slot, defects: set[str]) -> tuple:
    """One answer of several, in reading order."""
    readable = [a for a in every if a[4] in READABLE]
    if any(a[4].startswith("range_") for a in every):
        readable = [a for a in every if a[6] > 0 and a[4] == "parsed"] or readable
    first = (readable or every)[0]
    if sum(a[5] == "sheet" for a in every) > 1:
        defects.add("duplicate_display_index")
        return None, None, None, None, "duplicate_display_index", first[5]
    if slot.kind == "text" and readable:
        return ("\n".join(a[0] for a in readable if a[0] is not None), *first[1:6])
    if len({(a[1], a[0].strip(" ").lower() if a[1] is None and a[2] is None and a[0] is not None else None, a[2], a[3]) for a in readable}) > 1:
        return None, None, None, None, "conflicting_values", first[5]
    return first[:6]


def read_reply(reply: str | None, slots: list[Slot], sheet: tuple | None) -> tuple[str, dict[int, tuple], str, str | None, list[str]]:
    """(status of slots without an answer, answers, parse_status, recovery, defects) of a reply. sheet: what
    ``replies.sheet`` says of it, where it was asked."""
    text = (reply or "").translate(_PLAIN)
    n = len(slots)
    if text.strip(" ") == "":
        return "missing", {}, "empty_response", None, []
    lines = _newline.split(text)
    some = [x for x in lines if x.strip(" ")]
    trimmed = {x.strip(" ") for x in some} if len(some) > n > 1 else ()
    if sheet is None and ("{" in text or "[" in text):
        sheet = sheet_of(text, some, slots)
    kind = sheet[0] if sheet is not None else None
    all_text = all(s.kind == "text" for s in slots)
    form, claimed = kind, []
    if len(trimmed) == 1 or (len(some) > max(64, 2 * n) and sum(bool(_bare.search(x.strip(" "))) for x in some) >= 0.95 * len(some)):
        form = "runaway"
    elif kind is not None:
        claimed = [(k, "", 0, "sheet", [pos - 1] if pos else [], answer, defect) for k, (pos, answer, defect) in enumerate(sheet[1], 1)]
    elif all_text and n and (not (numbered := any(_opener.search(x) for x in some)) or (n > 1 and any(_context.search(x) for x in some))):
        if n == 1:
            told = text.strip(" ").rstrip(SPACES)
            claimed = [(1, "", 0, "single", [0], sheet[2] if sheet is not None and told.lstrip(SPACES).startswith("{") else told, None)]
        else:
            form, claimed = "interview", interview(lines, slots)
    else:
        tokens = [x for x in _separators.split(text) if x] if n > 1 else []
        if n > 1 and len(tokens) == n and not any(_opener.search(x) for x in some) and all(s.takes(x) for s, x in zip(slots, tokens, strict=True)):
            form, claimed = "positional", [(k + 1, "", 0, "position", [k], x, None) for k, x in enumerate(tokens)]
        else:
            claimed = claims(records(lines, n), slots)
    answers, defects = settle(claimed, slots)
    readable = sum(a[4] in READABLE for a in answers.values())
    state = "ok" if readable == n and n and not defects else "partial" if readable else "unparsed"
    if state == "unparsed":
        straight = reply.replace("’", "'").replace("‘", "'")
        state = "refusal" if any(p.search(straight) for p in _refusals) else state
    return "unparsed" if form == "runaway" else "missing", answers, state, form, sorted(defects)


def _values(c: pa.Array) -> list:
    """An array's values, without an object of Arrow for each; lists as tuples."""
    if c.null_count == len(c):
        return [None] * len(c)
    if pa.types.is_nested(c.type):
        ends = c.offsets
        if c.null_count == 0 and ends[0].as_py() == ends[-1].as_py():
            return [()] * len(c)
        return [None if x is None else tuple(x) for x in c.to_pylist()]
    if pa.types.is_string(c.type) or c.null_count == 0:
        return c.to_numpy(zero_copy_only=False).tolist()
    there = c.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [x if ok else None for x, ok in zip(c.fill_null(0).to_numpy(zero_copy_only=False).tolist(), there, strict=True)]


def _sheets(c: pa.StructArray) -> list[tuple | None]:
    if c.null_count == len(c):
        return [None] * len(c)
    kinds, entries, braced = c.flatten()
    ends = entries.offsets.to_numpy().tolist()
    said = list(zip(*map(_values, entries.values.slice(ends[0], ends[-1] - ends[0]).flatten()), strict=True))
    asked = c.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [(kind, said[a - ends[0] : b - ends[0]], x) if ok else None for kind, a, b, x, ok in zip(_values(kinds), ends, ends[1:], _values(braced), asked)]


def read_rows(batch: pa.RecordBatch, keys: int, kinds: list[pa.DataType], fields: list[str | None]) -> Iterator[list[pa.Array]]:
    """Columns of the answers of a batch's replies, a few rows at a time. fields: where each property of a slot is found."""
    for begin in range(0, batch.num_rows, 1000):
        rows = batch.slice(begin, 1000)
        replies, nested, sheets = (rows.column(keys + k) for k in range(3))
        ends = nested.offsets.to_numpy().tolist()
        items = nested.values.slice(ends[0], ends[-1] - ends[0])
        parts = dict(zip([f.name for f in items.type], items.flatten(), strict=True))
        given = [_values(parts[f]) if f is not None else [None] * len(items) for f in fields]
        every = list(map(_slot, *given))
        answered, states, recoveries, defects = [], [], [], []
        for k, (reply, sheet) in enumerate(zip(_values(replies), _sheets(sheets), strict=True)):
            slots = every[ends[k] - ends[0] : ends[k + 1] - ends[0]]
            blank, answers, state, recovery, wrong = read_reply(reply, slots, sheet)
            none = (None, None, None, None, blank, "none")
            for i, s in enumerate(slots):
                answered.append((s.slot_id, *answers.get(i, none)))
            states.append(state)
            recoveries.append(recovery)
            defects.append(wrong)
        kind = kinds[0].value_type
        columns = zip(*answered) if answered else [()] * len(kind)
        nested_answers = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
        offsets = pa.array([e - ends[0] for e in ends], pa.int32())
        yield [*rows.columns[:keys], pa.ListArray.from_arrays(offsets, nested_answers, type=kinds[0]), pa.array(states, kinds[1]), pa.array(recoveries, kinds[2]), pa.array(defects, kinds[3])]
