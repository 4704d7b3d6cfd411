"""Whole-reply decoding of prose and bare tokens in plain Python, to compare the library's job with: one reply with its slots
in, one typed answer for each slot out."""

from __future__ import annotations

import re

_QUOTES = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "−": "-"})
_SELECT = re.compile(r"(?i)\b(?:choose|select|pick|answer(?: is)?|option)\b[:\s]*")
_NEGATED = re.compile(r"(?i)\b(?:not|never|don't|do not|wouldn't)\b[^.;]*$")


def _choice(text: str, choices: list[str]) -> str | None:
    by_name = {str(c).casefold(): c for c in choices}
    names = "|".join(sorted(map(re.escape, by_name), key=len, reverse=True))
    token = re.compile(rf"(?<!\w)({names})(?!\w)", re.I)
    bare = text.strip().strip(".。!()").casefold()
    if bare in by_name:
        return by_name[bare]
    picked = {by_name[m[1].casefold()] for s in _SELECT.finditer(text) if (m := token.match(text, s.end())) and not _NEGATED.search(text[: s.start()])}
    if picked:
        return picked.pop() if len(picked) == 1 else None
    lead = token.match(text.lstrip())
    if lead and len({m[1].casefold() for m in token.finditer(text)}) == 1 and not re.match(r"(?i)\s*(?:or|或|/)", text.lstrip()[lead.end() :]):
        return by_name[lead[1].casefold()]
    return None


READABLE = ("parsed", "out_of_range", "text_response", "range_response", "range_out_of_range")
_NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)")
_OPENER = re.compile(r"\s*(\d+)[.)、](?!\d)\s*(.*)")
_RANGE = re.compile(r"(?i)(?:between\s+|from\s+|\[)?\s*([+-]?\d+(?:\.\d+)?)\s*%?\s*(?:-|–|~|to\b|and\b|,|到|至)\s*([+-]?\d+(?:\.\d+)?)\s*%?\]?")
_TAIL = re.compile(r"(?i)\s*(?:[.;!)。]|points?|分)*\s*(?:(?:because|since|due|,? as)\b.*)?$", re.S)
_SCORE = re.compile(r"(?i)\s*(?:score|answer|rating|评分|答案)\s*[:=：]?\s*")
_FINAL = re.compile(r"(?i)^\s*(?:so\s+)?(?:(?:my\s+)?final\s+(?:answer|score|rating)(?:\s+is)?|my\s+(?:score|rating|estimate)(?:\s+is)?|I(?:'d| would| will)?\s+(?:rate(?:\s+it)?|give(?:\s+it)?|choose)|最终(?:答案|分数)(?:为|是)?)\s*[:：=]?\s*(?=[+-]?\d)")
_CODEBOOK = re.compile(r"(?<!\d)\d+(?:\.\d+)?\s*=")
_LIST = re.compile(r"\s*[+-]?\d+(?:\.\d+)?\s*[,;]\s*[+-]?\d")
_CIRCLED = re.compile(r"([①②③④⑤⑥⑦⑧⑨⑩])[^\n]*?[:：=]")
_CHOOSES = re.compile(r"(?i)^(?:\b(?:I\s+)?(?:choose|select|pick|answer|response|choice)(?:\s+is)?\b|我(?:选择|选)|选择|答案|回答|选项)\s*[:：=]?\s*")
_CHINESE = re.compile(r"[\u4e00-\u9fff]")
_BREAK = re.compile(r"[:：→]|[—–]")


def read_number(body: str, maximum: float | None = None):
    """(value, interval, status) of an answer body."""
    text = body.strip()
    if not text:
        return None, None, "missing"
    word = _SCORE.match(text)
    at = word.end() if word else 0
    m = _NUMBER.match(text, at)
    r = _RANGE.match(text, at)
    if r and not re.match(r"(?i)\s*(?:or|或|/|,)\s*\d", text[r.end() :]):
        if "," in r[0] and not r[0].lstrip().startswith("["):
            return None, None, "multiple_values"
        return None, (float(r[1]), float(r[2])), "range"
    if not m:
        return None, None, "unparsed"
    rest = text[m.end() :]
    f = re.match(r"\s*/\s*(\d+(?:\.\d+)?)", rest)
    if f and maximum is not None and float(f[1]) == maximum and _TAIL.fullmatch(rest[f.end() :]):
        return float(m[0]), None, "parsed"
    if re.match(r"(?i)\s*(?:or|或|/)\s*\d", rest):
        return None, None, "range_unresolved"
    return (float(m[0]), None, "parsed") if _TAIL.fullmatch(rest) else (None, None, "unparsed")


def source_option(slot: dict, line: str) -> str | None:
    """The value of an option whose whole label the line says. labels: label to value."""
    labels = {str(k).casefold(): v for k, v in dict(slot.get("labels") or {}).items()}
    said = _CHOOSES.sub("", re.split(r"(?i)\bbecause\b|因为|理由[:：]|解释[:：]", line, maxsplit=1)[0].strip())
    return labels.get(said.strip(" \t.。!！").casefold()) if labels else None


def read_line(slot: dict, line: str):
    """(value, interval, status, whether it is a final pick) of one line of a numeric slot."""
    option = source_option(slot, line)
    if option is not None:
        return float(option), None, "parsed", False
    final = _FINAL.match(line)
    value, span, status = read_number(line[final.end() :] if final else line, slot["maximum"])
    return value, span, status, bool(final) and status == "parsed"


def read_answer(slot: dict, body: str) -> dict:
    """One typed answer of a slot, from all lines of the body. Lines that define options, and lists of several scores, say
    nothing about one item; different values conflict; only a final pick settles a range."""
    kind, low, high = slot["response_type"], slot["minimum"], slot["maximum"]
    out = {"slot_id": slot["slot_id"], "answer": body.strip() or None, "score": None, "lower": None, "upper": None, "status": "missing"}
    if not body.strip():
        return out
    if kind == "text":
        return out | {"status": "text_response"}
    if kind == "choice" and slot["choices"]:
        c = source_option(slot, body)
        if c is None:
            said = {x for x in (source_option(slot, line) for line in body.splitlines()) if x is not None}
            if len(said) > 1:
                return out | {"status": "conflicting_values"}
            c = next(iter(said)) if said else _choice(body, list(slot["choices"]))
        number = float(c) if c is not None and _NUMBER.fullmatch(str(c)) else None
        return out | {"answer": c if c is not None else out["answer"], "score": number, "status": "parsed" if c is not None else "invalid_choice"}
    if len(set(_CIRCLED.findall(body))) >= 3:
        return out | {"status": "option_codebook"}
    lines = [x for x in body.splitlines() if x.strip() and x.strip() != "---" and len(_CODEBOOK.findall(x)) < 3]
    read = [read_line(slot, x) for x in lines if not _LIST.match(x)]
    values, final = {v for v, _, st, _ in read if st == "parsed"}, {v for v, _, _, picked in read if picked}
    spans = [span for _, span, st, _ in read if span or st == "range_unresolved"]
    if len(values) > 1:
        return out | {"status": "conflicting_values"}
    if spans and not (values and final == values):
        if values or None in spans or len(set(spans)) > 1:
            return out | {"status": "range_unresolved"}
        a, b = spans[0]
        beyond = (low is not None and a < low) or (high is not None and b > high)
        return out | {"lower": a, "upper": b, "status": "range_unresolved" if a > b else "range_out_of_range" if beyond else "range_response"}
    if not values:
        alone = read_number(lines[0], high)[2] if len(lines) == 1 else "unparsed"
        return out | {"status": alone if alone == "multiple_values" else "unparsed"}
    value = next(iter(values))
    if kind == "integer" and value != int(value):
        return out | {"status": "non_integer"}
    beyond = (low is not None and value < low) or (high is not None and value > high)
    return out | {"score": value, "status": "out_of_range" if beyond else "parsed"}


def signature(text: str) -> str:
    return "".join(c for c in re.sub(r"[(\[][^)\]]*[)\]]", "", re.sub(r"^\s*\d+[.)、]\s*", "", text)).casefold() if c.isalnum())


def records(text: str) -> list[tuple[int | None, str]]:
    """Numbered records of a reply: number and body; lines before the first opener have none."""
    out: list[list] = []
    for line in text.splitlines():
        m = _OPENER.match(line)
        if m:
            out.append([int(m[1]), m[2]])
        elif out:
            out[-1][1] += "\n" + line
        elif line.strip():
            out.append([None, line])
    return [(n, b) for n, b in out]


def by_text(body: str, slots: list[dict], signatures: list[str]) -> tuple[list[int], str, str]:
    """The slots of a record by its words, the answer's text, and the rung: the question (of nested ones the longest), its
    unique beginning, a unique short label. Linked slots of one question both count."""
    head, _, tail = body.partition("\n") if "\n" in body else (body.partition(":") if ":" in body else body.partition("："))
    said = signature(head)
    if not said:
        return [], body, "none"
    least = lambda q: 2 if _CHINESE.search(q) else 4
    whole = [k for k, s in enumerate(signatures) if s and (s == said or (len(s) >= least(s) and s in said))]
    if whole:
        longest = max((signatures[k] for k in whole), key=len)
        if all(signatures[k] in longest for k in whole):
            whole = [k for k in whole if signatures[k] == longest]
    begins = [k for k, s in enumerate(signatures) if s and ((len(said) >= 8 and s.startswith(said)) or (len(s) >= 24 and s[: 14 if _CHINESE.search(s) else 32] in said))]
    first = body.splitlines()[0]
    label = signature(_BREAK.split(first, maxsplit=1)[0]) if _BREAK.search(first) else ""
    short = [k for k, s in enumerate(signatures) if s and (2 if _CHINESE.search(label) else 8) <= len(label) <= 30 and label in s]
    for found, rung in ((whole, "question"), (begins, "prefix"), (short, "label")):
        if not found:
            continue
        said_in = tail if rung != "label" else _BREAK.split(body, maxsplit=1)[1]
        if len(found) > 1:
            typed = [k for k in found if read_answer(slots[k], said_in)["status"] in READABLE]
            if len(typed) == 1:
                return typed, said_in, rung
            if len(typed) == 2 and linked(slots, *typed):
                return typed, said_in, "linked"
            continue
        return found, said_in, rung
    return [], body, "none"


def linked(slots: list[dict], a: int, b: int) -> bool:
    return any(slots[i].get("linked_slot_id") not in (None, "") and slots[i].get("linked_slot_id") == slots[j]["slot_id"] for i, j in ((a, b), (b, a)))


def place(said: list[tuple[int | None, str]], slots: list[dict], signatures: list[str]) -> list[tuple[list[int], str, str]]:
    """Slots, answer text and rung of every record of a reply by the strongest evidence: its words, then its number (as a
    source number where slots have such, unless words show that display places are printed), then the order of a complete
    reply without numbers, then a single slot. More than one candidate on a rung gives none."""
    source: dict[int, list[int]] = {}
    for k, s in enumerate(slots):
        if s.get("source_no") is not None and s["source_no"] == s["source_no"]:
            source.setdefault(int(s["source_no"]), []).append(k)
    found = [by_text(body, slots, signatures) for _, body in said]
    votes = set()
    for (number, _), (ks, _, _) in zip(said, found, strict=True):
        if number is not None and ks:
            own, display = ks[0] in source.get(number, []), number == ks[0] + 1
            if own != display:
                votes.add("source" if own else "display")
    ordered = len(said) == len(slots) > 1 and not source and all(n is None for n, _ in said) and all(not ks or ks == [k] for k, (ks, _, _) in enumerate(found)) and all(read_answer(s, text)["status"] in READABLE for s, (_, text, _) in zip(slots, found, strict=True))
    out = []
    for at, ((number, body), (ks, text, rung)) in enumerate(zip(said, found, strict=True)):
        if not ks and number is not None:
            display = number - 1 if 1 <= number <= len(slots) else None
            own = source.get(number, [])
            if own and votes <= {"source"}:
                typed = own if len(own) == 1 else [k for k in own if read_answer(slots[k], body)["status"] in READABLE]
                if len(typed) == 1:
                    ks, rung = typed, "source_number"
                elif len(typed) == 2 and linked(slots, *typed):
                    ks, rung = typed, "linked"
            elif display is not None and own == [display]:
                ks, rung = [display], "aligned_number"
            elif display is not None and (not source or votes == {"display"}):
                ks, rung = [display], "local_number"
        if not ks and ordered:
            ks, rung = [at], "section_order"
        if not ks and number is None and len(slots) == 1 and len(said) == 1:
            ks, rung = [0], "single"
        out.append((ks, text, rung))
    return out


def runaway(text: str, slots: int) -> bool:
    some = [x.strip() for x in text.splitlines() if x.strip()]
    bare = sum(bool(re.fullmatch(r"[\w.+-]{1,12}", x)) for x in some)
    return bool(some) and ((len(some) > max(64, 2 * slots) and bare >= 0.95 * len(some)) or (slots > 1 and len(some) > slots and len(set(some)) == 1))


def decode_reply(text: str | None, slots: list[dict]) -> tuple[list[dict], str, str | None]:
    """Answers in slot order, the reply's status, and how it was recovered."""
    text = (text or "").translate(_QUOTES)
    blank = [read_answer(s, "") | {"method": "none"} for s in slots]
    if not text.strip():
        return blank, "empty_response", None
    if runaway(text, len(slots)):
        return [a | {"status": "unparsed"} for a in blank], "unparsed", "runaway"
    found: dict[int, list[dict]] = {}
    signatures = [signature(s.get("question") or "") for s in slots]
    said, recovery = records(text), None
    if not any(n is not None for n, _ in said) and len(slots) > 1:
        tokens = re.findall(r"[^\s,;|]+", text)
        if len(tokens) == len(slots) and not any(s["response_type"] == "text" for s in slots):
            read = [read_answer(s, x) for s, x in zip(slots, tokens, strict=True)]
            if all(a["status"] == "parsed" for a in read):
                found, said, recovery = {k: [a | {"method": "position"}] for k, a in enumerate(read)}, [], "positional"
        said = said and [(None, line) for line in text.splitlines() if line.strip()]
    for ks, body, method in place(said, slots, signatures):
        for k in ks:
            found.setdefault(k, []).append(read_answer(slots[k], body) | {"method": method})
    answers = []
    for k, b in enumerate(blank):
        mine = found.get(k, [])
        read = [a for a in mine if a["status"] in READABLE]
        if slots[k]["response_type"] == "text" and read:
            answers.append(read[0] | {"answer": "\n".join(a["answer"] for a in read)})
        elif len({(a["score"], a["answer"] if a["score"] is None else None, a["lower"], a["upper"]) for a in read}) > 1:
            answers.append(b | {"status": "conflicting_values", "method": read[0]["method"]})
        else:
            answers.append((read or mine or [b])[0])
    n = sum(a["status"] in READABLE for a in answers)
    return answers, "ok" if n == len(answers) else "partial" if n else "unparsed", recovery
