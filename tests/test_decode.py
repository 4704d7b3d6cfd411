"""Small replies and the answers they give, for each rule of whole-reply decoding (the plain version, with which test_replies
compares the library's job) and of the value functions."""

import pytest
from plain_reply import decode_reply
from pyspark.sql import functions as F

from tallyleaf.functions import values


def slot(k, kind="integer", low=1.0, high=7.0, choices=(), question=""):
    return {"slot_id": f"s{k}", "question": question, "response_type": kind, "minimum": low, "maximum": high, "choices": list(choices)}


def got(text, slots):
    answers, status, _ = decode_reply(text, slots)
    return [(a["score"], a["status"]) for a in answers], status


CASES = [
    ("1. 3\n2. 5", 2, [(3, "parsed"), (5, "parsed")], "ok"),
    ("1. 3-5\n2. 9", 2, [(None, "range_response"), (9, "out_of_range")], "ok"),
    ("1. 6 or 7\n2. 4/7", 2, [(None, "range_unresolved"), (4, "parsed")], "partial"),
    ("1. Score: 4 because 2 reasons\n2. maybe 3 of them", 2, [(4, "parsed"), (None, "unparsed")], "partial"),
    ("1. 3\n1. 4\n2. 2", 2, [(None, "conflicting_values"), (2, "parsed")], "partial"),
    ("1. 3\n1. 3\n2. 2", 2, [(3, "parsed"), (2, "parsed")], "ok"),
    ("1. 2.5\n2. 5-3", 2, [(None, "non_integer"), (None, "range_unresolved")], "unparsed"),
    ("3, 4", 2, [(3, "parsed"), (4, "parsed")], "ok"),
    ("3, 4, 5", 2, [(None, "missing"), (None, "missing")], "unparsed"),
    ("", 2, [(None, "missing"), (None, "missing")], "empty_response"),
    ("\n".join("5" for _ in range(9)), 2, [(None, "unparsed"), (None, "unparsed")], "unparsed"),
    ("1. 2, 3\n2. 1", 2, [(None, "multiple_values"), (1, "parsed")], "partial"),
]


@pytest.mark.parametrize("text, n, answers, status", CASES)
def test_replies(text, n, answers, status):
    assert got(text, [slot(k) for k in range(n)]) == (answers, status)


def test_question_text_beats_the_number():
    slots = [slot(1, question="I like long walks"), slot(2, question="I like short walks")]
    assert got("1. I like short walks: 6\n2. I like long walks: 2", slots)[0] == [(2, "parsed"), (6, "parsed")]


def methods(text, slots):
    return [(a["score"], a["method"]) for a in decode_reply(text, slots)[0]]


def test_rungs():
    plain = [slot(1), slot(2)]
    assert methods("3\n5 because 2", plain) == [(3, "section_order"), (5, "section_order")]
    shuffled = [slot(2) | {"source_no": 2}, slot(1) | {"source_no": 1}]
    assert methods("1. 3\n2. 5", shuffled) == [(5, "source_number"), (3, "source_number")]
    asked = [slot(3, question="I like long walks") | {"source_no": 3}, slot(2, question="I enjoy reading") | {"source_no": 2}, slot(1, question="I sleep late") | {"source_no": 1}]
    assert methods("1. I like long walks: 6\n2. 4", asked)[:2] == [(6, "question"), (4, "aligned_number")]
    assert methods("1. 4\n2. 5", [slot(1), slot(2)]) == [(4, "local_number"), (5, "local_number")]
    topics = [slot(1, question="How warm do you feel towards president Lincoln"), slot(2, question="How warm do you feel towards president Washington")]
    assert methods("Washington → 6\nLincoln2: 3", topics)[1] == (6, "label")
    nested = [slot(1, question="Do you pray"), slot(2, question="How often do you pray")]
    assert methods("1. How often do you pray: 4", nested) == [(None, "none"), (4, "question")]
    pair = [slot(1, question="All birds fly") | {"linked_slot_id": "s2"}, slot(2, question="All birds fly")]
    assert methods("1. All birds fly: 4", pair) == [(4, "linked"), (4, "linked")]


def test_bodies():
    options = slot(1) | {"labels": {"strongly agree": "7"}}
    for body, want in [
        ("1 = low, 4 = middle, 7 = high\n5", (5, "parsed")), ("2, 3, 4\n6", (6, "parsed")), ("3-5\nFinal answer: 4", (4, "parsed")), ("3-5\n4", (None, "range_unresolved")),
        ("I choose strongly agree.", (7, "parsed")), ("3\n4", (None, "conflicting_values")), ("① low: a ② mid: b ③ high: c", (None, "option_codebook")),
    ]:
        assert got("1. " + body, [options])[0] == [want], body


def test_saved_order(spark):
    from tallyleaf.plans import helpers as plans

    d = "/root/testdata/sf0.001"
    bodies = {(r.trial, r.item_no): r.body for r in plans.view(spark, d, "bodies_v").collect()}
    rows = plans._decoded(spark, d).select("trial", "shuffle_order", "answers").collect()
    assert any(r.shuffle_order != sorted(r.shuffle_order) for r in rows)
    for r in rows:
        assert [a.slot_id for a in r.answers] == [f"s{k}" for k in range(1, len(r.answers) + 1)]
        assert all(a.answer == bodies[r.trial, k] for k, a in enumerate(r.answers, 1)), r


def test_choices_and_text():
    slots = [slot(1, "choice", choices=["A", "B"]), slot(2, "text"), slot(3, "choice", choices=["A", "B"])]
    answers, status, _ = decode_reply("1. I choose B\n2. because of\nmany things\n3. A or B", slots)
    assert [a["status"] for a in answers] == ["parsed", "text_response", "invalid_choice"] and answers[0]["answer"] == "B" and answers[1]["answer"] == "because of\nmany things" and status == "partial"


def column(spark, texts, make):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("x", make(F.col("t")))
    return [r.x for r in df.orderBy("k").collect()]


def test_scalars(spark):
    found = column(spark, ["4", " 4.5 points.", "Answer: 3", "3-5", "6 or 7", "1, 2", "about 4 of them", "", None, "4/7", "4/5", "-2 because it is"], lambda c: values.scalar(c, F.lit(7.0)))
    assert [(x.value, x.status) for x in found] == [
        (4, "parsed"), (4.5, "parsed"), (3, "parsed"), (None, "range_unresolved"), (None, "range_unresolved"), (None, "multiple_values"), (None, "unparsed"), (None, "missing"), (None, "missing"),
        (4, "parsed"), (None, "range_unresolved"), (-2, "parsed"),
    ]


def test_intervals(spark):
    found = column(spark, ["3-5", "10% to 20", "between 2 and 4", "[1, 3]", "3/5", "3-5 or 6-7", "from 1 to 2 or so"], values.interval)
    assert [x and (x.lower, x.upper, x.unit) for x in found] == [(3, 5, ""), (10, 20, "%"), (2, 4, ""), (1, 3, ""), None, None, (1, 2, "")]


def test_parts_never_split_characters(spark):
    text = "😀" * 50 + "x" * 25
    parts = column(spark, [text, "", "abc"], lambda c: values.parts(c, 30))
    assert "".join(parts[0]) == text and all(len(p.encode("utf-16-le")) // 2 <= 30 for p in parts[0]) and parts[1:] == [[""], ["abc"]]


def test_times_without_offset_fall_back(spark):
    found = column(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+08:00", "2024-01-02T03:04:05", "no"], lambda c: values.utc_text(c, F.to_timestamp(F.lit("2020-01-01 00:00:00"))))
    assert found == ["2024-01-02T03:04:05Z", "2024-01-01T19:04:05Z", "2020-01-01T00:00:00Z", "2020-01-01T00:00:00Z"]
