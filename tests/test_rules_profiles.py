"""Configuration rules and profile layouts on small cases."""

import pytest
from pyspark.sql import functions as F

from tallyleaf.operators import profiles, rules

CAPS = [("*", "", "temperature", "supported", None, ""), ("Acme", "m", "top_p", "unsupported", None, "fixed"), ("acme", "m-big", "top_p", "ignored", None, ""), ("acme", "m-big", "effort", "supported", ["low"], "")]
NO = ["a", "b"]


def messages(spark, configs, needs=(), exclusions=()):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(configs)], "k int, provider string, model string, settings map<string,string>, strict boolean")
    caps = spark.createDataFrame(CAPS, "provider string, prefix string, field string, status string, modes array<string>, note string")
    ex = spark.createDataFrame(list(exclusions), "provider string, field string, value string, other string, allowed array<string>, message_text string")
    out = rules.check_settings(df, ["k"], caps, ex, spark.createDataFrame(list(needs), "field string, value string, provider string, prefix string"))
    return [r.messages for r in out.orderBy("k").collect()]


@pytest.fixture(params=[rules.SMALL_ROWS, 0])
def any_size(request, monkeypatch):
    """Rule tables that are broadcast, and such that are too large for it."""
    monkeypatch.setattr(rules.small, "__defaults__", (request.param,))


def test_settings(spark, any_size):
    configs = [
        ("acme", "m-1", {"temperature": "2", "top_p": None}, False), ("acme", "m-1", {"temperature": "2.1", "top_p": "1"}, False), ("ACME", "M-BIG-2", {"top_p": "1", "effort": "high"}, False),
        ("acme", "m-big", {"top_p": "1", "effort": "low", "seed": "1.5"}, True), ("other", "x", {"temperature": "1"}, True), ("other", "x", {"temperature": "1"}, False), ("acme", "m", {}, True), ("acme", "m", None, True),
        (None, None, {"temperature": "-1"}, False),
    ]
    assert messages(spark, configs) == [
        [], ["temperature must be a number from 0 to 2", "top_p is not supported by acme/m-1: fixed"], ["effort takes only low by ACME/M-BIG-2"],
        ["seed must be a whole number at least 0", "seed is not verified by acme/m-big", "top_p is ignored by acme/m-big"], ["other/x is not registered"], [], [], [], ["temperature must be a number from 0 to 2"],
    ]


def test_exclusions_and_needs(spark, any_size):
    exclusions = [(None, "effort", None, "budget", None, "effort excludes budget"), ("acme", "mode", "off", "top_p", ["1"], "top_p stays 1")]
    needs = [("mode", "off", "acme", "m-big")]
    configs = [
        ("acme", "m-big-3", {"mode": "off", "top_p": "1"}, False), ("acme", "m-big", {"mode": "off", "top_p": "0"}, False), ("acme", "m-small", {"mode": "off", "effort": "low", "budget": "1"}, False),
        ("beta", "m-big", {"mode": "off", "top_p": "0"}, False), ("acme", "m-small", {"mode": "on"}, False),
    ]
    got = messages(spark, configs, needs, exclusions)
    assert [[m for m in ms if not m.startswith("top_p is")] for ms in got] == [[], ["top_p stays 1"], ["effort excludes budget", "mode can not be off for acme/m-small"], ["mode can not be off for beta/m-big"], []]


LAYOUTS = [("two", True, [("a", 2, "integer", 1.0, 7.0, None, "within"), ("b", 1, "choice", None, None, ["X"], "fixed")]), ("none", False, [("a", 0, "text", None, None, None, "fixed")])]


def checked(spark, items):
    df = spark.createDataFrame(items, "sheet string, lang string, profile string, block_no int, number int, question string")
    return profiles.check_sheets(df, spark.createDataFrame(LAYOUTS, profiles.LAYOUT), ["sheet", "lang"])


def sheet(name, lang="en", profile="two", numbers=((1, 1), (1, 2), (2, 1))):
    return [(name, lang, profile, b, n, f"q{b}{n}") for b, n in numbers]


def test_sheets(spark):
    rows = sheet("good") + sheet("short", numbers=[(1, 1), (2, 1)]) + sheet("swapped", numbers=[(1, 2), (1, 3), (2, 1)]) + sheet("more", numbers=[(1, 1), (1, 2), (2, 1), (3, 1)]) + sheet("twice", numbers=[(1, 1), (1, 1), (2, 1)])
    rows += sheet("unknown", profile="other") + sheet("flat", profile=None) + sheet("hole", numbers=[(1, 1), (None, None)])
    got = {r.sheet: (r.found, r.expected, r.errors) for r in checked(spark, rows).collect()}
    assert got == {
        "good": (3, 3, []), "short": (2, 3, ["a: expected items 1 to 2, found 1"]), "swapped": (3, 3, ["a: expected items 1 to 2, found 2 3"]), "more": (4, 3, ["no block 3"]), "twice": (3, 3, ["a: expected items 1 to 2, found 1 1"]),
        "unknown": (3, None, ["no layout of other"]), "hole": (2, 3, ["a: expected items 1 to 2, found 1", "b: expected items 1 to 1, found none", "no block ?"]),
    }
    slots = profiles.typed_slots(checked(spark, rows), ["sheet"]).orderBy("slot_pos").collect()
    assert [(r.sheet, r.slot_id, r.item.question, r.response_type) for r in slots] == [("good", "a_001", "q11", "integer"), ("good", "a_002", "q12", "integer"), ("good", "b_001", "q21", "choice")]


def test_pairs(spark):
    rows = sheet("same") + sheet("same", "ch") + sheet("alone") + sheet("bad") + sheet("bad", "ch", numbers=[(1, 1)]) + sheet("other") + sheet("other", "ch", "none")
    got = {r.sheet: r.status for r in profiles.pair_status(checked(spark, rows), "sheet", "lang", "en", "ch").collect()}
    assert got == {"same": "ok", "bad": "a sheet differs from its profile", "other": "different profiles"}


def test_profile_names(spark):
    rows = [("Known", "", "k"), (" Known ", "x", "k"), ("known", "Inner Circle", "c"), ("Circle", "the INNER one, a dilemma", "d"), ("Circle", "", None), (None, None, None), (None, "inner circle", "c")]
    df = spark.createDataFrame(rows, "name string, title string, want string")
    chosen = profiles.profile_of(F.col("name"), F.col("title"), {"Known": "k"}, [("c", ("inner", "circle"), ("dilemma",)), ("d", ("dilemma",), ())])
    assert [(r.got, r.want) for r in df.select("want", chosen.alias("got")).collect()] == [(w, w) for *_, w in rows]


def test_empty(spark):
    assert checked(spark, []).count() == 0
    assert messages(spark, []) == []
