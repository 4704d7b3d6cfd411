"""Queries on decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf.functions import values as v
from tallyleaf.operators import decode as t
from tallyleaf.registry import query
from tallyleaf.sources.fixtures import view, with_views

T = ["trial"]


def _replies(spark, d, head="", tail=""):
    """One reply per trial: its numbered lines in order, between a head and a tail."""
    rows = view(spark, d, "lines_v").groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("item_no", "line_text"))).alias("l"), F.count("*").alias("n"))
    return rows.select("trial", "n", F.concat(F.lit(head), F.array_join(F.col("l.line_text"), "\nmore\n"), F.lit(tail)).alias("reply"))


@query("w5_item_segments", with_views("SELECT trial, item_no, CASE WHEN item_no = max(item_no) OVER (PARTITION BY trial) THEN body ELSE concat(body, chr(10), 'more') END AS body FROM bodies_v"))
def w5(spark, d):
    return t.item_bodies(t.segment(t.lines(_replies(spark, d), T, "reply"), T), T).select("trial", "item_no", "body")


def _scoped(spark, d):
    rows = view(spark, d, "lines_v").withColumn("story", F.ceil(F.col("item_no") / 3).cast("int"))
    head = F.when(F.col("item_no") % 3 == 1, F.concat(F.lit("Scenario "), F.col("story").cast("string"), F.lit("\n"))).when(F.col("item_no") % 3 == 2, "A.\n").otherwise("")
    text = rows.withColumn("x", F.concat(head, "line_text")).groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("item_no", "x"))).alias("l"))
    return t.segment(t.lines(text.select("trial", F.array_join(F.col("l.x"), "\n").alias("reply")), T, "reply"), T)


@query("w6_scopes", with_views("SELECT trial, item_no, CAST(CAST(ceil(item_no / 3.0) AS INT) AS VARCHAR) AS context, CASE WHEN item_no % 3 <> 1 THEN 'A' END AS section FROM lines_v"))
def w6(spark, d):
    return _scoped(spark, d).filter("opens is not null").select("trial", "item_no", "context", "section")


@query("w7_segments", with_views("SELECT trial, item_no, CAST(s AS BIGINT) AS segment, s = 1 AS in_summary FROM (SELECT trial, item_no, unnest([0, 1]) AS s FROM lines_v) x"))
def w7(spark, d):
    twice = _replies(spark, d).withColumn("reply", F.concat("reply", F.lit("\nFinal summary:\n"), "reply"))
    return t.segment(t.lines(twice, T, "reply"), T, marks_only=True).filter("opens is not null").select("trial", "item_no", "segment", "in_summary")


@query("w8_stories", with_views("""SELECT trial, CAST(ceil(item_no / 3.0) AS INT) AS story, string_agg(concat(CASE WHEN item_no % 3 = 2 THEN concat('A.', chr(10)) ELSE '' END, line_text), chr(10) ORDER BY item_no) AS body
 FROM lines_v WHERE trial IN (SELECT trial FROM lines_v GROUP BY trial HAVING max(item_no) BETWEEN 4 AND 6) GROUP BY ALL"""))  # fmt: skip
def w8(spark, d):
    return t.stories(_scoped(spark, d), T, 2)


def _said(spark, d):
    """Every slot answered twice, the second time in a summary, differently in some trials."""
    rows = view(spark, d, "bodies_v").withColumns({"in_summary": F.lit(False), "place": F.col("item_no")})
    again = rows.withColumns({"in_summary": F.lit(True), "place": F.col("item_no") + 1000, "body": F.when(F.col("trial") % 3 == 0, "2").when(F.col("trial") % 3 == 1, F.col("body")).otherwise("no idea")})
    return rows.unionByName(again).withColumn("x", v.scalar("body", F.lit(7.0))).select("trial", "item_no", "place", "in_summary", "x.value", "x.status")


@query("w11_repeated_answers", with_views("""WITH s AS (SELECT trial, item_no, CASE (line + partkey) % 7 WHEN 0 THEN (partkey % 45)::DOUBLE WHEN 2 THEN (partkey % 9)::DOUBLE WHEN 6 THEN (partkey % 8)::DOUBLE END AS v, (line + partkey) % 7 IN (1, 3) AS r, trial % 3 AS m FROM items_v)
 SELECT trial, item_no, CASE WHEN m = 0 AND v IS NOT NULL AND v <> 2 THEN 'conflicting_values' WHEN m = 0 THEN 'parsed' WHEN v IS NOT NULL THEN 'parsed' WHEN r THEN 'range_unresolved' ELSE 'unparsed' END AS status,
 CASE WHEN m = 0 AND v IS NOT NULL AND v <> 2 THEN NULL WHEN m = 0 THEN 2.0::DOUBLE ELSE v END AS value, CAST(2 AS BIGINT) AS said FROM s"""))  # fmt: skip
def w11(spark, d):
    return t.resolve_repeats(_said(spark, d), ["trial", "item_no"], "value", "status", "place", "in_summary")


@query("w12_numbering_vote", with_views("""SELECT trial, CASE WHEN trial % 4 = 0 THEN 'undecided' WHEN trial % 4 = 1 THEN 'display' WHEN trial % 4 = 2 THEN 'source' WHEN trial % 8 = 3 THEN 'source' ELSE 'undecided' END AS numbering FROM items_v GROUP BY trial"""))
def w12(spark, d):
    m = F.col("trial") % 4
    rows = view(spark, d, "items_v").withColumn("in_summary", (F.col("trial") % 8) == 7)
    first = F.col("item_no") == 1
    return t.numbering_vote(rows, T, first & m.isin(0, 2), first & m.isin(0, 1), "in_summary")


@query("f25_same_under_both", with_views("""SELECT a.trial, a.item_no AS slot_no, a.after_score FROM scored_v a JOIN (SELECT trial, count(*) AS n FROM scored_v GROUP BY trial) c USING (trial) JOIN scored_v b ON a.trial = b.trial AND b.item_no = c.n + 1 - a.item_no
 WHERE a.after_score IS NOT DISTINCT FROM b.after_score"""))  # fmt: skip
def f25(spark, d):
    rows = view(spark, d, "scored_v").select("trial", "item_no", "after_score")
    count = rows.groupBy("trial").agg(F.count("*").alias("n"))
    orders = rows.join(count, "trial").select("trial", F.col("item_no").alias("display_no"), (F.col("n") + 1 - F.col("item_no")).cast("int").alias("source_no"))
    return t.same_under_both(rows, orders, T, "item_no", "after_score")


@query("f19_table_answers", with_views("SELECT trial, item_no, CASE WHEN trial % 2 = 0 THEN body ELSE concat('q', item_no) END AS answer FROM bodies_v"))
def f19(spark, d):
    rows = view(spark, d, "bodies_v").withColumn("x", F.concat(F.lit("| "), F.col("item_no").cast("string"), F.lit(" | q"), F.col("item_no").cast("string"), F.lit(" | "), "body", F.lit(" |")))
    body = rows.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("item_no", "x"))).alias("l"))
    head = F.when(F.col("trial") % 2 == 0, "| No | Question | Answer |\n|---|:--|---|\n").otherwise("| No | Text | Words |\n|---|---|---|\n")
    return t.table_answers(t.lines(body.select("trial", F.concat(head, F.array_join(F.col("l.x"), "\n")).alias("reply")), T, "reply"), T)


def _sheets(spark, d):
    entry = F.when(F.col("partkey") % 10 == 0, F.to_json(F.struct(F.col("line").alias("index"), F.lit(" ").alias("answer")))).otherwise(F.to_json(F.struct(F.col("line").alias("index"), (F.col("partkey") % 50).alias("answer"))))
    rows = view(spark, d, "items_v").groupBy("trial").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("e"))
    text = F.concat(F.lit('{"answers": ['), "e", F.lit("]}"))
    return rows.select("trial", F.when(F.col("trial") % 2 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(F.col("trial") % 9 == 1, F.concat(F.lit("Sure: "), text)).otherwise(text).alias("reply"))


ENTRIES = """e AS (SELECT trial, CASE WHEN prose THEN NULL ELSE line END AS item_no, CASE WHEN prose THEN NULL WHEN partkey % 10 = 0 THEN ' ' ELSE CAST(partkey % 50 AS VARCHAR) END AS answer,
  CASE WHEN prose THEN 'invalid_json' WHEN c > 1 THEN 'duplicate_display_index' WHEN partkey % 10 = 0 THEN 'empty_answer' END AS defect
  FROM (SELECT *, trial % 2 <> 0 AND trial % 9 = 1 AS prose, count(*) OVER (PARTITION BY trial, line) AS c, row_number() OVER (PARTITION BY trial ORDER BY item_no) AS rn FROM items_v) x WHERE NOT prose OR rn = 1)"""


@query("f17_json_sheets", with_views(f"WITH {ENTRIES} SELECT trial, item_no, answer, defect, count(*) AS n FROM e GROUP BY ALL"))
def f17(spark, d):
    return t.json_answers(_sheets(spark, d), T, "reply").groupBy("trial", "item_no", "answer", "defect").agg(F.count("*").alias("n"))


@query("f18_typed_sheets", with_views(f"""WITH {ENTRIES} SELECT trial, item_no, coalesce(defect, CASE WHEN TRY_CAST(answer AS DOUBLE) < 1 THEN 'below_minimum' WHEN TRY_CAST(answer AS DOUBLE) > 40 THEN 'above_maximum' END) AS defect, count(*) AS n FROM e GROUP BY ALL"""))
def f18(spark, d):
    entries = t.json_answers(_sheets(spark, d), T, "reply")
    return t.typed_entries(entries, F.lit("integer"), F.lit(1.0), F.lit(40.0)).groupBy("trial", "item_no", "defect").agg(F.count("*").alias("n"))


@query("u4_exact_ids", with_views("SELECT trial, count(DISTINCT line) = count(*) AND count(*) = max(line) AND min(line) = 1 AS ids_match FROM items_v GROUP BY trial"))
def u4(spark, d):
    rows = view(spark, d, "items_v").groupBy("trial").agg(F.collect_list("line").alias("said"), F.max("line").alias("m")).withColumn("declared", F.sequence(F.lit(1), F.col("m")))
    return t.exact_ids(rows, T, "said", "declared").select("trial", "ids_match")


@query("f20_positional_answers", with_views("SELECT trial, item_no, CAST(partkey % 44 AS INT) AS value FROM items_v WHERE trial NOT IN (SELECT trial FROM items_v WHERE partkey % 44 < 1 OR partkey % 44 > 40)"))
def f20(spark, d):
    items = view(spark, d, "items_v")
    said = items.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("item_no", (F.col("partkey") % 44).cast("string").alias("s")))).alias("l")).select("trial", F.array_join(F.col("l.s"), ", ").alias("reply"))
    return t.positional(said, T, "reply", items.select("trial", "item_no", "minimum", "maximum"))


@query("f21_bare_streams", with_views("SELECT trial, CASE WHEN trial % 3 = 0 THEN true WHEN trial % 3 = 1 THEN true ELSE false END AS is_stream FROM items_v GROUP BY trial"))
def f21(spark, d):
    rows = view(spark, d, "items_v").groupBy("trial").agg(F.count("*").cast("int").alias("n"))
    m = F.col("trial") % 3
    reply = F.when(m == 0, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: (i % 7).cast("string")), "\n")).when(m == 1, F.array_join(F.array_repeat(F.lit("4"), F.col("n") + 1), "\n")).otherwise("1\n2\n3")
    rows = rows.withColumn("reply", reply)
    return rows.select("trial", t.bare_stream(rows, "reply", F.col("n")).alias("is_stream"))


@query("f22_task_tokens", with_views("""SELECT trial, CASE WHEN line % 2 = 0 THEN 'number' ELSE 'choice' END AS task, CAST(row_number() OVER (PARTITION BY trial, line % 2 ORDER BY item_no) AS INT) AS task_no, CASE WHEN line % 2 = 0 THEN CAST(line AS VARCHAR) ELSE 'Yes' END AS token
 FROM items_v WHERE concat(trial, '/', line % 2) IN (SELECT concat(trial, '/', line % 2) FROM items_v GROUP BY trial, line % 2 HAVING count(*) = 2)"""))  # fmt: skip
def f22(spark, d):
    items = view(spark, d, "items_v")
    tokens = items.select("trial", F.col("item_no").alias("line_no"), F.when(F.col("line") % 2 == 0, F.col("line").cast("string")).otherwise("Yes").alias("token"))
    tasks = items.select("trial", F.explode(F.array(F.lit("number"), F.lit("choice"))).alias("task")).distinct().withColumn("wanted", F.lit(2))
    return t.task_tokens(tokens, T, tasks)
