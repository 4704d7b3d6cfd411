"""What tasks hold and what is shuffled must not grow faster than the input: shapes of plans and of written files."""

import re
import unicodedata

import compare
from pyspark.sql import functions as F

from tallyleaf import registry
from tallyleaf.functions import clauses, helpers
from tallyleaf.operators import decode, replies, trials
from tallyleaf.sources import fixtures, records

QUERIES = registry.queries()
TRIAL = "run_id string, scale_name string, language string, provider string, model string, order_id string, condition_hash string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_items_are_dealt_out_by_number(spark, monkeypatch):
    """A task holds a bounded number of line items, and grouping by trial shuffles no more."""
    rows = spark.read.parquet(f"{compare.DATA}/lineitem.parquet").count()
    monkeypatch.setattr(fixtures.tasks, "__defaults__", (rows // 20,))
    grouped = fixtures.view(spark, compare.DATA, "lines_v").groupBy("trial").agg(F.count("*").alias("n"))
    assert plan_of(grouped).count("Exchange") == 1
    assert grouped.rdd.getNumPartitions() >= fixtures.tasks(spark, compare.DATA, "lineitem") >= 20


def test_current_rows_without_a_join(spark):
    """no join for the plan's settings; the last attempt, the greatest source, the plan's preset."""
    key = ("r", "s", "en", "p", "m", "007", None)
    plan = spark.createDataFrame([(*key, "pre", 5), ("r", "s", "en", "p", "m", "8", "c", None, None)], f"{TRIAL}, preset_id string, temperature10 int")
    attempts = spark.createDataFrame([(*key, str(a), "error", f"x{b}", "said") for a, b in ((1, 9), (2, 1), (2, 3), (2, 2))], f"{TRIAL}, attempt string, status string, source string, response_text string")
    results = spark.createDataFrame([], f"{TRIAL}, response_status string, source string, raw_response string")
    found = trials.collect_trials(plan, attempts, results)
    got = {r.order_no: (r.kind, r.attempt, r.source, r.status, r.preset_id, r.temperature10, r.n_chars) for r in found.collect()}
    assert got == {7: ("attempt", 2, "x3", "transport_error", "pre", 5, 4), 8: ("plan", 0, "plan", "not_recorded", None, None, 0)}
    assert "Join" not in plan_of(found)
    assert {c for c in trials.collect_trials(plan, attempts, results, ("status",)).columns} == {"id", *trials.TRIAL, "status"}


def test_large_folders_have_several_sheets(spark, tmp_path):
    """a folder's rows do not all meet in one task; a trial stays in one sheet."""
    from tallyleaf.operators.trial_records import ITEM_COLUMNS

    rows = spark.range(4000).select((F.col("id") / 4).cast("long").alias("trial"), F.lit("s").alias("scale_name"), F.lit("en").alias("language"), *[(F.col("id") % 4 + 1).cast("string").alias(c) for c in ITEM_COLUMNS])
    records.write_items(rows, f"{tmp_path}/a", 480)
    sheets = records.read_items(spark, f"{tmp_path}/a").withColumn("file", F.input_file_name())
    assert sheets.select("file").distinct().count() > 1 and sheets.count() == 4000
    assert sheets.groupBy("trial").agg(F.count_distinct("file").alias("n")).filter("n > 1").count() == 0


def test_documents_are_written_by_all_tasks(spark, monkeypatch):
    """F8: one file for each document, in one folder, from more tasks than four where there are more documents."""
    folders, own = [], records.scratch
    monkeypatch.setattr(records, "scratch", lambda s, name: folders.append(own(s, name)) or folders[-1])
    monkeypatch.setattr("tallyleaf.plans.stores.tasks", lambda *a: 6)
    QUERIES["s1_saved_results"](spark, compare.DATA)
    files = [r[0] for r in spark.read.format("binaryFile").load(folders[0]).select("path").collect()]
    assert all(f.rpartition("/")[0].endswith(folders[0].rpartition("/")[2]) for f in files)
    assert len({f.rpartition("/")[2].split("-")[1] for f in files}) > 4


def test_attempts_are_saved_compressed(spark, monkeypatch):
    """F23."""
    folders, own = [], records.scratch
    monkeypatch.setattr(records, "scratch", lambda s, name: folders.append(own(s, name)) or folders[-1])
    QUERIES["s2_saved_attempts"](spark, compare.DATA)
    assert spark.read.format("binaryFile").load(folders[0]).filter("path like '%.json.gz'").count() > 0


def test_marks_alone_give_the_same_segments(spark):
    """lines that mark nothing need not pass the windows."""
    text = "1. a\nmore\nScenario 2\nA.\n99999999999. x\n2) b\n  FINAL summary\nmore\nII.\n1. c\nscenario 3\n3. d\nB. no\n总结\n4. e"
    lines = decode.lines(spark.createDataFrame([(1, text), (2, "no\n" + text)], "trial long, reply string"), ["trial"], "reply")
    want = decode.segment(lines, ["trial"]).filter("opens is not null or is_heading")
    got = decode.segment(lines, ["trial"], marks_only=True)
    assert sorted(map(str, got.filter("opens is not null or is_heading").collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert got.filter("line = 'more'").count() == 0


def test_a_decision_reads_its_text_once(spark):
    """the text is made once in a row, not once for each pattern."""
    said = F.replace("t", F.lit("{x}"), F.lit("it"))
    df = spark.createDataFrame([("Yes, {x} holds",), (None,), ("not logically valid",), ("YES or NO",)], "t string").select(clauses.logical_decision(said).alias("d"))
    assert [r[0] for r in df.collect()] == ["YES", None, "NO", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("replace(t#") == 1


def test_anchors_need_one_shuffle(spark):
    """lines meet their slots inside the reply; nothing is joined, and only line items are shuffled, once."""
    for name in ("w9_anchored_rows", "w9_anchored_rows_all"):
        plan = plan_of(QUERIES[name](spark, compare.DATA))
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_anchors_inside_a_reply(spark):
    """an anchor counts if its line is there once and its slot is the only one with its signature."""
    slots = [("a", "firstone"), ("b", "ｓecond"), ("b2", "second"), ("c", "straße"), ("d", "twin"), ("e", "twin"), ("f", None), ("g", "last")]
    replies = [
        (1, "before\n1. First one (x)\nbody\r\n\r\nmore\r2) Ｓｅｃｏｎｄ\nits body\nLAST", slots),
        (2, "Second\nfirst one\nx\nfirst one\ny", slots), (3, "STRASSE\n答：好\ntwin\n7. last", slots), (4, "", slots), (5, None, slots), (6, "first one\n", slots), (7, "first one\nx", []),
    ]
    replies[2] = (3, replies[2][1], [*slots[:3], ("c", "strasse"), *slots[4:]])
    rows = decode.anchored(spark.createDataFrame(replies, "k int, t string, s array<struct<slot_id: string, signature: string>>"), ["k"], "t", "s")
    assert {(r.k, r.slot_id, r.body) for r in rows.collect()} == {(1, "a", "body\n\nmore"), (1, "b2", "its body"), (2, "b2", "first one\nx\nfirst one\ny"), (3, "c", "答：好\ntwin"), (6, "a", "")}


def test_signatures_of_lines(spark):
    """the lines of a text taken whole have the signatures that they have one by one."""
    lines = ["12. What (now\u2028) is", "(open", "] ( a ] b)", " \t\x0b\x0c3、 四 ㈠ (x", "ﬀ ①. ½", "e", "\u0301x", "İ Σς ẞ", "", "5.", "6) 7. x", "\u20281. a\x85 2. b", "【x】1.", "（全）角", "A[b]C_d-9"]
    for some in (lines, [x for x in lines if x.isascii()]):
        text = spark.createDataFrame([("\n".join(some),)], "t string").select(helpers.signatures("t")).first()[0]
        alone = spark.createDataFrame([(k, x) for k, x in enumerate(some)], "k int, t string").orderBy("k").select(helpers.signature("t")).collect()
        assert text == [r[0] for r in alone]
        for x, y in zip(some, text, strict=True):
            plain = re.sub(r"(?a)^\s*[0-9]+[.)、]", "", re.sub(r"[(（\[][^)）\]]*[)）\]]", "", unicodedata.normalize("NFKC", x)))
            assert y == "".join(c for c in plain if unicodedata.category(c)[0] in "LN").casefold()


def test_replies_are_read_in_their_rows(spark):
    """lines and slots of replies are not shuffled, sorted or grouped; only line items are shuffled, once."""
    plan = plan_of(QUERIES["ud1_reply_forms"](spark, compare.DATA))
    assert plan.count("Exchange") == 1 and "Generate posexplode_outer" not in plan


def test_shared_answers_do_not_mix(spark):
    """what is remembered of a line depends on its slot's bounds, and long lines are read as short ones are."""
    kind = "k int, t string, s array<struct<slot_id: string, response_type: string, minimum: double, maximum: double>>"
    rows = [(k, f"1. 4/{high}\n2. {3 + k}{' ' * pad}", [("a", "integer", 1.0, float(high)), ("b", "integer", 1.0, 5.0)]) for k, (high, pad) in enumerate([(7, 0), (5, 0), (7, 500), (5, 5_000)])]
    for dealt in (True, False):
        got = {r.k: [a.score for a in r.answers] for r in replies.decode_whole(spark.createDataFrame(rows, kind), ["k"], "t", "s", dealt=dealt).collect()}
        assert got == {k: [4, 3 + k] for k in range(4)}


SHEETS = [
    '{"answers": [{"display_index": 1, "answer": 3}, {"index": "2", "answer": "4"}, {"slot_id": "s3", "answer": true}, 7, null, [1]]}', "[1, 2, 3]", "[1, [2, {\"a\": 3}], 3]", '["[1", 2, " x "]', "[]", "{}", '{"answers": []}',
    '{"answers": 3}', '{"answers": null}', '[{"answers": [1, 2, 3]}]', '{"1": 3, "s2": [1, 2], "3": {"answer": {"a": 1}}, "note": " "}', '{"1": 1, "1": 2}', '{"1": NaN}', '{"1": 01}', "{'1': 1}", '{"1": "true", "2": "{x}", "s3": null}',
    '```json\n{"1": 1, "2": 2, "3": 3}\n```\r\n', '```\n[1,2,3]```', '{"1": 1} x', ' {"1": 1,\n"2": "二"} \n', '{"slot_id": "s1", "answer": 3}\n\n{"slot_id": "s3", "answer": null} \n{"slot_id": "s2"}', '{"slot_id": "s1"}', '{"1": 1}, {"2": 2}',
    '{"answers": [{"display_index": 1, "answer": 3}, {"display_index": 1, "answer": 4}, {"display_index": "+3", "answer": ""}]}', '{"answers": [{"slot_id": "s9", "answer": 1}, {"display_index": 4}, {"answer": 2}]}', "[" * 90 + "]" * 90, '{"1": 1', "",
]


def test_sheets_by_columns_and_by_rows(spark, monkeypatch):
    """plain JSON, which is read with the rest of a reply, gives what column functions give; those read what Python may write
    in another way."""
    slots = [(f"s{k}", "integer", 1.0, 7.0) for k in (1, 2, 3)]
    rows = spark.createDataFrame([(k, x, slots) for k, x in enumerate(SHEETS)], "k int, t string, s array<struct<slot_id: string, response_type: string, minimum: double, maximum: double>>")
    read = lambda **kw: sorted(map(str, replies.decode_whole(rows, ["k"], "t", "s", **kw).collect()))
    by_rows = read(dealt=True)
    assert read() == by_rows
    monkeypatch.setattr(replies, "HARD", "")
    assert read(dealt=True) == by_rows == read()
    odd = [(1, '{"1": 2.50, "2": "\\u0033", "3": 1e0}', slots)]
    got = replies.decode_whole(spark.createDataFrame(odd, rows.schema), ["k"], "t", "s", dealt=True).first()
    assert [a.status for a in got.answers][:2] == ["non_integer", "parsed"]


def test_the_archive_is_shuffled_once(spark):
    """bodies and types of items come from one view, without a join, and replies are read where they are dealt out."""
    plan = plan_of(QUERIES["g2_archive_decode"](spark, compare.DATA))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_trial_without_a_number_is_kept(spark, tmp_path):
    """the join by trial lost it."""
    items = spark.read.parquet(f"{compare.DATA}/lineitem.parquet")
    items.withColumn("l_orderkey", F.expr("nullif(l_orderkey, 3)")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["g2_archive_decode"](spark, str(tmp_path)).filter("trial is null").collect()
    assert [r["items"] for r in found] == [items.filter("l_orderkey = 3").count()]


def test_answers_of_the_archive_need_no_second_shuffle(spark):
    """F3."""
    plan = plan_of(QUERIES["f24_answer_bodies"](spark, compare.DATA))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_the_ladder_shuffles_counts_only(spark):
    """line items once, then counts by method and status."""
    plan = plan_of(QUERIES["f23_evidence_ladder"](spark, compare.DATA))
    assert plan.count("Exchange") == 2 and "Join" not in plan
