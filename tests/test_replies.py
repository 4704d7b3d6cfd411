"""Whole-reply decoding: small replies with the answers they must give, and random replies against the plain version."""

import random

import pytest
from plain_reply import decode_reply
from pyspark.sql import functions as F
from test_decode import CASES

from tallyleaf.functions import clauses
from tallyleaf.operators.replies import decode_whole

FIELDS = "slot_id:string,question:string,response_type:string,minimum:double,maximum:double,choices:array<string>,labels:map<string,string>,context:string,section:string,source_no:int,linked_slot_id:string"


def slot(k, kind="integer", low=1.0, high=7.0, choices=(), question="", **more):
    return dict(slot_id=f"s{k}", question=question, response_type=kind, minimum=low, maximum=high, choices=list(choices), labels=None, context=None, section=None, source_no=None, linked_slot_id=None) | more


def decode(spark, cases):
    df = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(cases)], f"k int, reply string, slots array<struct<{FIELDS}>>")
    found = {r.k: r for r in decode_whole(df, ["k"]).collect()}
    assert sorted(found) == list(range(len(cases)))
    return [found[k] for k in range(len(cases))]


S3 = [slot(k) for k in (1, 2, 3)]
AB = [slot(1, section="A"), slot(2, section="A"), slot(3, section="B")]
TITLED = [slot(1, section="viewpoint"), slot(2, section="outcome"), slot(3, section="outcome")]
SCENES = [slot(1, context="scenario_1"), slot(2, context="scenario_1"), slot(3, context="scenario_2")]
TALK = [slot(1, "text", question="1. Should Heinz steal the drug?"), slot(2, "text", question="1. Is stealing wrong in this case?")]
MIXED = [slot(1, "choice", choices=["YES", "NO"]), slot(2, "number", low=-3.0, high=3.0), slot(3, "choice", choices=["A", "B", "C"])]

P, M, U = "parsed", "missing", "unparsed"
#: reply, slots, (score or answer, status) of each, parse_status, recovery, defects
WANTED = [
    # sheets
    ('{"answers": [{"display_index": 1, "answer": 3}, {"display_index": "2", "answer": "4"}, {"display_index": 3, "answer": 5.0}]}', S3, [(3, P), (4, P), (5, P)], "ok", "json", []),
    ('{"answers": [{"slot_id": "s3", "answer": 3}, {"slot_id": "s1", "answer": 4}, {"slot_id": "s2", "answer": 9}]}', S3, [(4, P), (9, "out_of_range"), (3, P)], "ok", "json", []),
    ("[3, 4, 5]", S3, [(3, P), (4, P), (5, P)], "ok", "json", []),
    ("[3, 4]", S3, [(None, M)] * 3, U, "json", ["entry_not_object"]),
    ('{"1": 3, "2": 4, "3": 5}', S3, [(3, P), (4, P), (5, P)], "ok", "json", []),
    ('```json\n{"s1": {"slot_id": "s1", "answer": 2}, "s2": "3", "s3": null}\n```', S3, [(2, P), (3, P), (None, "null_answer")], "partial", "json", ["null_answer"]),
    ('{"answers": [{"display_index": 1, "answer": 3}, {"display_index": 1, "answer": 3}, {"display_index": 9, "answer": 4}, {"display_index": 3}, 7]}', S3, [(None, "duplicate_display_index"), (None, M), (None, "missing_answer")], U, "json", ["duplicate_display_index", "entry_not_object", "invalid_display_index", "missing_answer"]),
    ('{"1": true, "2": " ", "3": "4"}', S3, [("true", "invalid_answer_type"), (None, "empty_answer"), (4, P)], "partial", "json", ["empty_answer", "invalid_answer_type"]),
    ('{"1": "about 4 of them", "2": "3-5", "3": "6 or 7"}', S3, [("about 4 of them", U), ("3-5", "range_response"), ("6 or 7", "range_unresolved")], "partial", "json", []),
    ('{"note": 1, "1": 2}', S3, [(2, P), (None, M), (None, M)], "partial", "json", ["unknown_slot_id"]),
    ('{"1": 3, "1": 4}', S3, [(None, M)] * 3, U, None, []),
    ('{"slot_id": "s1", "answer": 3}\n{"slot_id": "s3", "answer": 1}\n\n{"slot_id": "s2", "answer": 2}', S3, [(3, P), (2, P), (1, P)], "ok", "json_lines", []),
    ('{"slot_id": "s1", "answer": 3}\n{"slot_id": "s3", "answer": 1}', S3, [(None, M)] * 3, U, None, []),
    ('Sure: {"1": 3, "2": 4, "3": 5}', S3, [(None, M)] * 3, U, None, []),
    ('{"1": 3} and {"2": 4}', S3, [(None, M)] * 3, U, None, []),
    ('{"1": 3', S3, [(None, M)] * 3, U, None, []),
    # tables
    ("| No | Question | Answer |\n|---|---|---|\n| 1 | a | 3 |\n| 2 | b | 4 |\n| 3 | c | 5 |", S3, [(3, P), (4, P), (5, P)], "ok", None, []),
    ("| Item | Score (1-7) | Why |\n|:--|:-:|--|\n| 1. | 3 | 2 reasons |\n| 3. | **5** | 1 |", S3, [(3, P), (None, M), (5, P)], "partial", None, []),
    ("| 1 | 3 |\n| 2 | 4 |\n| 3 | 3-5 |", S3, [(3, P), (4, P), ("3-5", "range_response")], "ok", None, []),
    ("| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |", S3, [(None, M)] * 3, U, None, []),
    ("| Statement | Answer |\n|---|---|\n| I sleep late | 6 |\n| I enjoy reading | 2 |", [slot(1, question="I enjoy reading"), slot(2, question="I sleep late")], [(2, P), (6, P)], "ok", None, []),
    # scopes
    ("Section A\n1. 3\nSection B\n1. 4\n2. 5", S3, [(None, M)] * 3, U, None, []),
    ("Section A\n1. 3\n2. 6\nSection B\n1. 4", AB, [(3, P), (6, P), (4, P)], "ok", None, []),
    ("Section A\n1. 3\n2. 6\nSection B\n3. 4", S3, [(3, P), (6, P), (4, P)], "ok", None, []),
    ("A.\n3\n5\nB.\n4", AB, [(3, P), (5, P), (4, P)], "ok", None, []),
    ("A.\n3\nB.\n4", AB, [(None, M), (None, M), (4, P)], "partial", None, []),
    ("## Viewpoint\n1. 2\n## Outcome\n1. 3\n2. 4", TITLED, [(2, P), (3, P), (4, P)], "ok", None, []),
    ("**Scenario 1**\n1. 2\n2. 3\n**Scenario 2:** the other\n1. 4", SCENES, [(2, P), (3, P), (4, P)], "ok", None, []),
    ("Scenario 7\n1. 2\nScenario 8\n1. 3", SCENES, [(None, M)] * 3, U, None, []),
    # summaries and conflicts
    ("1. 3-5\n2. 4\n3. 1\nFinal summary:\n1. 4\n2. 4", S3, [(4, P), (4, P), (1, P)], "ok", None, []),
    ("1. 3\n2. 4\n3. 1\nSummary\n1. 5", S3, [(None, "conflicting_values"), (4, P), (1, P)], "partial", None, []),
    # interviews
    ("Story 1\nhe was right\nStory 2\nshe was not", TALK, [("he was right", "text_response"), ("she was not", "text_response")], "ok", "interview", []),
    ("Story 1\nhe was right\nStory 1\nno", TALK, [(None, M)] * 2, U, "interview", []),
    ("he was right\nreally\n\nshe was not", TALK, [("he was right\nreally", "text_response"), ("she was not", "text_response")], "ok", "interview", []),
    ("one block only", TALK, [(None, M)] * 2, U, "interview", []),
    ("Should Heinz steal the drug?\nyes,\n\nfor her\nIs stealing wrong in this case?\nno", TALK, [("Should Heinz steal the drug?\nyes,\n\nfor her", "text_response"), ("Is stealing wrong in this case?\nno", "text_response")], "ok", "interview", []),
    ("all of it\n\n1 more", [slot(1, "text")], [("all of it\n\n1 more", "text_response")], "ok", None, []),
    # choices, refusals, numbers
    ("1. Yes\n2. -2\n3. I would choose B", MIXED, [("YES", P), (-2, P), ("B", P)], "ok", None, []),
    ("1. not sure\n2. +.5\n3. A or B", MIXED, [("not sure", "invalid_choice"), (0.5, P), ("A or B", "invalid_choice")], "partial", None, []),
    ("no, 2, C", MIXED, [("NO", P), (2, P), ("C", P)], "ok", "positional", []),
    ("1、３\n2、４\n3、５。", S3, [(3, P), (4, P), (5, P)], "ok", None, []),
    ("I cannot provide scores.", S3, [(None, M)] * 3, "refusal", None, []),
    ("I cannot rate the first.\n2. 4", S3, [(None, M), (4, P), (None, M)], "partial", None, []),
    ("1. 3.5\n2. 5.\n3. .5", [slot(k, "number", low=0.0) for k in (1, 2, 3)], [(3.5, P), (5, P), (0.5, P)], "ok", None, []),
    ("1. ②\n2. Answer: ③\n3. ① or ②", S3, [(2, P), (3, P), ("① or ②", U)], "partial", None, []),
    (None, S3, [(None, M)] * 3, "empty_response", None, []),
    ("", [], [], "empty_response", None, []),
    ("1. 3", [], [], U, None, []),
    ("4\n" * 70, S3, [(None, U)] * 3, U, "runaway", []),
]


def test_replies(spark):
    bad = []
    for (text, slots, want, status, recovery, defects), r in zip(WANTED, decode(spark, [w[:2] for w in WANTED]), strict=True):
        got = [(a.answer if w[0] is not None and isinstance(w[0], str) else a.score, a.status) for a, w in zip(r.answers, want, strict=True)]
        if (got, r.parse_status, r.recovery, r.defects) != (want, status, recovery, defects) or [a.slot_id for a in r.answers] != [s["slot_id"] for s in slots]:
            bad.append((text, got, r.parse_status, r.recovery, r.defects))
    assert not bad, "\n".join(map(repr, bad))


def random_reply(r):
    n = r.randrange(1, 6)
    asked = r.random() < 0.4
    kinds = [r.choice(["integer", "number", "choice", "text"]) for _ in range(n)]
    if all(k == "text" for k in kinds):
        kinds[0] = "integer"
    topics = r.sample(["walking to work", "reading at night", "cold weather", "loud music", "early trains", "warm bread"], n)
    slots = [slot(k + 1, kind, choices=["A", "B"] if kind == "choice" else (), question=f"How much do you like {topics[k]}" if asked else "") for k, kind in enumerate(kinds)]
    if r.random() < 0.4:
        order = r.sample(range(n), n)
        for k, s in zip(order, slots):
            s["source_no"] = k + 1
    bodies = ["3", "5", "9", "2.5", "3-5", "6 or 7", "4/7", "Score: 4 because 2 reasons", "B", "I choose A", "no clear view", "between 2 and 4", "2, 3", "", "7 points", "5-3", "3-5\nFinal answer: 4", "3\n4", "1 = low, 4 = mid, 7 = high\n6"]
    lines = []
    for k in r.sample(range(n), n) if r.random() < 0.5 else range(n):
        if r.random() < 0.9:
            body = r.choice(bodies)
            lines.append(f"{r.choice([k + 1, k + 1, 1])}. {slots[k]['question']}\n{body}" if asked and r.random() < 0.7 else f"{k + 1}. {body}")
    if r.random() < 0.2:
        lines += lines[:1]
    if r.random() < 0.2:
        return r.choice([", ", " ", "\n"]).join(r.choice(["3", "5", "B", "9"]) for _ in range(n)), slots
    return "\n".join(lines), slots


def test_against_plain_version(spark):
    r = random.Random(11)
    cases = [random_reply(r) for _ in range(400)] + [(t, [slot(k) for k in range(n)]) for t, n, _, _ in CASES]
    bad = []
    for (text, slots), got in zip(cases, decode(spark, cases), strict=True):
        answers, status, _ = decode_reply(text, slots)
        want = [(a["score"], a["lower"], a["upper"], a["status"]) for a in answers]
        found = [(a.score, a.lower, a.upper, a.status) for a in got.answers]
        if want != found or status != got.parse_status:
            bad.append((text, [(s["response_type"], s["question"], s["source_no"]) for s in slots], want, found, status, got.parse_status))
    assert not bad, f"{len(bad)}\n" + "\n".join(map(repr, bad[:8]))


def test_order_and_partitions_do_not_matter(spark):
    cases = [w[:2] for w in WANTED]
    df = spark.createDataFrame([(k, t, s, "x", 1) for k, (t, s) in enumerate(cases)], f"k int, reply string, slots array<struct<{FIELDS}>>, form string, rec int")
    once = {r.k: r for r in decode_whole(df.repartition(1), ["k"]).collect()}
    again = {r.k: r for r in decode_whole(df.repartition(7), ["k"]).collect()}
    assert once == again and len(once) == len(cases)


def test_empty_table(spark):
    df = spark.createDataFrame([], f"k int, reply string, slots array<struct<{FIELDS}>>")
    assert decode_whole(df, ["k"]).count() == 0
    few = spark.createDataFrame([(1, "1. 3", [("a", "integer", 1.0, 7.0)])], "k int, reply string, slots array<struct<slot_id:string,response_type:string,minimum:double,maximum:double>>")
    assert decode_whole(few, ["k"]).first().answers[0].score == 3


@pytest.mark.parametrize("text", ["x" * 200_000, "1. " + "word " * 50_000, "\n" * 100_000, "1. 3\n" * 5_000])
def test_long_replies(spark, text):
    assert len(decode(spark, [(text, S3)])[0].answers) == 3


CHOSEN = [
    ("I would not choose A; I choose B", "B"), ("Not A.", None), ("I can't pick A, but I pick B", "B"), ("choose A. choose B", None), ("A, since B is too long", None), ("Friend: B", "B"), ("A and B", None), ("answer is (A)", "A"), ("不选A，选B", "B"), ("", None), (None, None), ("AB", None), ("pick A/B", None),
]


def test_choices_by_clause(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CHOSEN)], "k int, t string")
    got = [r.c for r in df.select("k", clauses.selected_choice("t", F.array(F.lit("A"), F.lit("B"))).alias("c")).orderBy("k").collect()]
    assert got == [w for _, w in CHOSEN]


def test_known_choices_need_no_pattern_for_each_row(spark):
    """Choices given as a list say the same as choices in a column, and the answer is taken apart once."""
    df = spark.createDataFrame([(k, t, ["A", "B"]) for k, (t, _) in enumerate(CHOSEN)], "k int, t string, c array<string>")
    both = df.select("k", clauses.selected_choice("t", ["A", "B"]).alias("a"), clauses.selected_choice("t", F.col("c")).alias("b"))
    assert [(r.a, r.b) for r in both.orderBy("k").collect()] == [(w, w) for _, w in CHOSEN]
    plan = df.select(clauses.selected_choice("t", ["A", "B"]).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[*_`~]") == 1


def test_replies_are_taken_apart_once(spark):
    """Interviews and other replies read the same shuffle of lines."""
    df = spark.createDataFrame([(1, "1. 3", S3), (2, "Story 1\nhe was right\nStory 2\nshe was not", TALK)], f"k int, reply string, slots array<struct<{FIELDS}>>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = decode_whole(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan
