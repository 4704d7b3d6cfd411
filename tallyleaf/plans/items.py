"""Queries on items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf.operators import items as t
from tallyleaf.registry import query
from tallyleaf.sources.fixtures import view, with_views

READ = "('parsed', 'out_of_range', 'text_response', 'range_response', 'range_out_of_range')"


def _counted(spark, d):
    rows = view(spark, d, "scored_v").withColumn("answer", F.when(F.col("after_score").isNotNull(), F.col("after_score").cast("string")))
    return t.trial_counters(rows, "after_status", "after_score", "answer")


COUNTED = f"""c AS (SELECT trial, count(*) AS item_count, count(after_score) AS answered, sum(CASE WHEN after_status IN {READ} THEN 1 ELSE 0 END)::BIGINT AS read, count(after_score) AS scored FROM scored_v GROUP BY trial)"""


@query("a1_trial_counters", with_views(f"WITH {COUNTED} SELECT *, read = item_count AS all_items_read FROM c"))
def a1(spark, d):
    return _counted(spark, d)


@query("a2_parse_status", with_views(f"WITH {COUNTED} SELECT CASE WHEN read = item_count THEN 'ok' WHEN read > 0 THEN 'partial' ELSE 'unparsed' END AS parse_status, count(*) AS n FROM c GROUP BY 1"))
def a2(spark, d):
    return _counted(spark, d).groupBy(t.parse_status("read", "item_count").alias("parse_status")).agg(F.count("*").alias("n"))


@query("a3_item_status_histogram", with_views("SELECT after_status, count(*) AS n FROM scored_v GROUP BY 1"))
def a3(spark, d):
    return view(spark, d, "scored_v").groupBy("after_status").agg(F.count("*").alias("n"))


def _wide(prefix):
    return ", ".join(f"sum(CASE WHEN {prefix}_status = '{s}' THEN 1 ELSE 0 END)::BIGINT AS {prefix}_{s}" for s in ("missing", "out_of_range", "parsed"))


@query("a4_before_after_totals", with_views(f"SELECT scale_name, language, {_wide('before')}, {_wide('after')} FROM scored_v GROUP BY GROUPING SETS ((scale_name, language), ())"))
def a4(spark, d):
    sums = [F.count_if(F.col(f"{p}_status") == s).alias(f"{p}_{s}") for p in ("before", "after") for s in ("missing", "out_of_range", "parsed")]
    rows = view(spark, d, "scored_v").groupBy("scale_name", "language").agg(*sums)
    # totals from the few group rows, not from the items again
    total = rows.agg(*[F.sum(c).alias(c) for c in rows.columns[2:]]).select(F.lit(None).cast("string").alias("scale_name"), F.lit(None).cast("string").alias("language"), *rows.columns[2:])
    return rows.unionByName(total)


@query("a5_read_items_by_group", with_views(f"WITH {COUNTED}, s AS (SELECT DISTINCT trial, scale_name, language FROM items_v) SELECT scale_name, language, sum(item_count)::BIGINT AS items, sum(read)::BIGINT AS read FROM c JOIN s USING (trial) GROUP BY ALL"))
def a5(spark, d):
    return view(spark, d, "scored_v").groupBy("scale_name", "language").agg(F.count("*").alias("items"), F.count_if(t.is_readable("after_status")).alias("read"))


def _compared(spark, d):
    rows = view(spark, d, "scored_v")
    side = lambda p: rows.select("trial", "item_no", "scale_name", "language", F.col(f"{p}_score").alias("score"), F.col(f"{p}_status").alias("status"))
    return t.compare(side("before"), side("after"), ("trial", "item_no", "scale_name", "language"), ("score", "status"))


@query("j3_item_comparison", with_views("""SELECT trial, item_no, before_score AS old_score, after_score AS new_score, before_status AS old_status, after_status AS new_status,
 NOT (before_score IS NOT DISTINCT FROM after_score AND before_status IS NOT DISTINCT FROM after_status) AS changed FROM scored_v"""))  # fmt: skip
def j3(spark, d):
    return _compared(spark, d).select("trial", "item_no", "old_score", "new_score", "old_status", "new_status", "changed")


@query("a6_score_transitions", with_views("""SELECT scale_name, language, sum(CASE WHEN before_score IS DISTINCT FROM after_score THEN 1 ELSE 0 END)::BIGINT AS score_changed,
 sum(CASE WHEN before_score IS NULL AND after_score IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS recovered,
 sum(CASE WHEN before_score IS NOT NULL AND before_score IS DISTINCT FROM after_score THEN 1 ELSE 0 END)::BIGINT AS changed_or_removed FROM scored_v GROUP BY ALL"""))  # fmt: skip
def a6(spark, d):
    return t.transitions(_compared(spark, d), ("scale_name", "language"))


REASONS = f"""u AS (SELECT trial, string_agg(concat(after_status, '=', n), ',' ORDER BY concat(after_status, '=', n)) AS reasons FROM
 (SELECT trial, after_status, count(*) AS n FROM scored_v WHERE after_status NOT IN {READ} OR after_status IN ('out_of_range', 'range_out_of_range') GROUP BY ALL) x GROUP BY trial)"""


@query("a7_unresolved_reasons", with_views(f"WITH {REASONS} SELECT * FROM u"))
def a7(spark, d):
    return t.unresolved_reasons(view(spark, d, "scored_v"), "after_status")


@query("a8_answer_types", with_views("SELECT trial, string_agg(DISTINCT response_type, ',' ORDER BY response_type) AS answer_types FROM items_v GROUP BY trial"))
def a8(spark, d):
    return view(spark, d, "items_v").groupBy("trial").agg(F.array_join(F.array_sort(F.collect_set("response_type")), ",").alias("answer_types"))


@query("p7_review_queue", with_views(f"WITH {COUNTED}, {REASONS} SELECT c.trial, CASE WHEN read = item_count THEN 'ok' WHEN read > 0 THEN 'partial' ELSE 'unparsed' END AS parse_status, reasons FROM c LEFT JOIN u USING (trial) WHERE read <> item_count OR reasons IS NOT NULL"))
def p7(spark, d):
    rows = _counted(spark, d).withColumn("parse_status", t.parse_status("read", "item_count")).join(t.unresolved_reasons(view(spark, d, "scored_v"), "after_status"), "trial", "left")
    return rows.filter("parse_status <> 'ok' or reasons is not null").select("trial", "parse_status", "reasons")


def _state(read, n):
    return f"CASE WHEN {read} = {n} THEN 'ok' WHEN {read} > 0 THEN 'partial' ELSE 'unparsed' END"


@query("g5_trial_audit", with_views(f"""WITH {COUNTED}, {REASONS}, b AS (SELECT trial, sum(CASE WHEN before_status IN {READ} THEN 1 ELSE 0 END)::BIGINT AS before_read, string_agg(DISTINCT response_type, ',' ORDER BY response_type) AS answer_types FROM scored_v GROUP BY trial)
 SELECT c.trial, item_count, before_read, read AS after_read, {_state('before_read', 'item_count')} AS before_status, {_state('read', 'item_count')} AS after_status, scored, answer_types, coalesce(reasons, '') AS reasons FROM c JOIN b USING (trial) LEFT JOIN u USING (trial)"""))  # fmt: skip
def g5(spark, d):
    return t.trial_audit(view(spark, d, "scored_v"), ("trial",), "before_status", "after_status", "after_score", "response_type")


#: Both decodes of an item with the bounds and unit of ranges; by item and trial the upper end, the unit or nothing of it changes.
RANGES = ("CASE WHEN item_no % 5 = 0 THEN 3 END", "CASE WHEN item_no % 5 = 0 THEN 5 END", "CASE WHEN item_no % 5 = 0 THEN '' END", "CASE WHEN item_no % 5 = 0 THEN 5 + trial % 2 END", "CASE WHEN item_no % 5 = 0 THEN CASE WHEN trial % 3 = 0 THEN '%' ELSE '' END END")


@query("g6_item_changes", with_views(f"""WITH x AS (SELECT trial, item_no, before_score, after_score, before_status, after_status, {RANGES[0]} AS before_lower, {RANGES[0]} AS after_lower, {RANGES[1]} AS before_upper, {RANGES[3]} AS after_upper, {RANGES[2]} AS before_unit, {RANGES[4]} AS after_unit FROM scored_v),
 y AS (SELECT *, concat_ws(',', CASE WHEN before_score IS DISTINCT FROM after_score THEN 'score' END, CASE WHEN before_status IS DISTINCT FROM after_status THEN 'status' END, CASE WHEN before_upper IS DISTINCT FROM after_upper THEN 'upper' END, CASE WHEN before_unit IS DISTINCT FROM after_unit THEN 'unit' END) AS differs FROM x)
 SELECT trial, item_no, before_score, after_score, before_status, after_status, before_lower, after_lower, CAST(before_upper AS BIGINT) AS before_upper, CAST(after_upper AS BIGINT) AS after_upper, before_unit, after_unit, differs FROM y WHERE differs <> ''"""))  # fmt: skip
def g6(spark, d):
    side = lambda name, upper, unit: F.struct(F.col(f"{name}_score").alias("score"), F.col(f"{name}_status").alias("status"), F.expr(RANGES[0]).alias("lower"), F.expr(upper).cast("long").alias("upper"), F.expr(unit).alias("unit"))
    rows = view(spark, d, "scored_v").select("trial", "item_no", side("before", RANGES[1], RANGES[2]).alias("b"), side("after", RANGES[3], RANGES[4]).alias("a"))
    return t.changed_items(rows, "b", "a", ("score", "status", "lower", "upper", "unit")).withColumn("differs", F.array_join("differs", ","))


@query("g3_score_audit", with_views("""SELECT violation, count(*) AS n FROM (SELECT CASE WHEN after_score IS NULL THEN NULL WHEN response_type = 'text' THEN 'score on text'
 WHEN response_type = 'choice' AND NOT list_contains(CASE WHEN trial % 2 = 0 THEN ['1', '2', '3', '4', '5', '6', '7'] ELSE ['2', '4', '8', '16', '32'] END, CAST(after_score AS VARCHAR)) THEN 'no such choice' END AS violation FROM scored_v) x WHERE violation IS NOT NULL GROUP BY 1"""))  # fmt: skip
def g3(spark, d):
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    rows = view(spark, d, "scored_v").withColumn("choices", F.when(F.col("trial") % 2 == 0, listed("1234567")).otherwise(listed(("2", "4", "8", "16", "32"))))
    return rows.withColumn("violation", t.score_violations(rows, "after_score", F.col("choices"))).filter("violation is not null").groupBy("violation").agg(F.count("*").alias("n"))


@query("a11_collection_checksum", """WITH f AS (SELECT concat('doc/', doc_id, '.txt') AS path, sha256(text) AS digest, doc_id % (SELECT greatest(64, CAST(ceil(count(*) / 4096.0) AS BIGINT)) FROM documents) AS bucket FROM documents),
 b AS (SELECT bucket, sha256(string_agg(concat(path, ':', digest), chr(10) ORDER BY concat(path, ':', digest))) AS d FROM f GROUP BY bucket)
 SELECT sha256(string_agg(concat(lpad(CAST(bucket AS VARCHAR), 12, '0'), ':', d), chr(10) ORDER BY bucket)) AS checksum, count(*) AS buckets FROM b""")  # fmt: skip
def a11(spark, d):
    docs = view(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "doc_id")
    return t.checksum(docs, "path", "digest", F.col("doc_id") % max(64, -(-docs.count() // 4096)))


@query("a13_type_mix", with_views("""SELECT scale_name, language, string_agg(concat(response_type, '=', n), ',' ORDER BY response_type) AS types, sum(n)::BIGINT AS items FROM (SELECT scale_name, language, response_type, count(*) AS n FROM items_v GROUP BY ALL) x GROUP BY ALL"""))
def a13(spark, d):
    mix = view(spark, d, "items_v").groupBy("scale_name", "language", "response_type").agg(F.count("*").alias("n"))
    return mix.groupBy("scale_name", "language").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "response_type", F.col("n").cast("string")))), ",").alias("types"), F.sum("n").alias("items"))


@query("a15_nested_items", with_views("""WITH b AS (SELECT trial, response_type, min(item_no) AS f, string_agg(coalesce(CAST(after_score AS VARCHAR), '-'), ',' ORDER BY item_no) AS s FROM scored_v GROUP BY ALL),
 l AS (SELECT trial, string_agg(concat(response_type, ':', s), '|' ORDER BY f) AS blocks FROM b GROUP BY trial)
 SELECT trial, string_agg(coalesce(CAST(after_score AS VARCHAR), '-'), ',' ORDER BY item_no) AS scores, count(*) AS n, any_value(blocks) AS blocks FROM scored_v JOIN l USING (trial) GROUP BY trial"""))  # fmt: skip
def a15(spark, d):
    """Items nested in their trial, and again in its blocks (here those of one response type)."""
    rows = t.nest(view(spark, d, "scored_v"), ("trial",), "item_no", ("after_score",), "response_type")
    scores = lambda xs: F.array_join(F.transform(xs, lambda x: x["after_score"].cast("string")), ",", "-")
    blocks = F.array_join(F.transform("blocks", lambda b: F.concat(b["response_type"], F.lit(":"), scores(b["slots"]))), "|")
    return rows.select("trial", scores(F.col("items")).alias("scores"), F.size("items").cast("long").alias("n"), blocks.alias("blocks"))


@query("a17_first_of_content", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def a17(spark, d):
    return t.first_of_content(view(spark, d, "documents"), "text", "doc_id")


@query("u3_retained_sources", with_views("SELECT order_no FROM (SELECT order_no, sha256(concat_ws('|', source, raw_response)) AS a, sha256(concat_ws('|', source, CASE WHEN order_no % 50 = 1 THEN lower(concat(raw_response, ' ')) ELSE raw_response END)) AS b FROM results_v) x WHERE a <> b"))
def u3(spark, d):
    old = view(spark, d, "results_v")
    new = old.withColumn("raw_response", F.when(F.col("order_no") % 50 == 1, F.lower(F.concat("raw_response", F.lit(" ")))).otherwise(F.col("raw_response")))
    digest = lambda df: df.select("order_no", F.sha2(F.concat_ws("|", "source", "raw_response"), 256).alias("h"))
    return digest(old).exceptAll(digest(new)).select("order_no")


@query("j11_source_order", with_views("""WITH p AS (SELECT trial, item_no, after_score, row_number() OVER (PARTITION BY trial ORDER BY sha256(concat(trial, '|', item_no))) AS shown FROM scored_v)
 SELECT trial, string_agg(coalesce(CAST(after_score AS VARCHAR), '-'), ',' ORDER BY item_no) AS source_answers FROM p GROUP BY trial"""))  # fmt: skip
def j11(spark, d):
    rows = view(spark, d, "scored_v").withColumn("__h", F.sha2(F.concat(F.col("trial").cast("string"), F.lit("|"), F.col("item_no").cast("string")), 256))
    # what a reply holds: answers in shown order, and the permutation
    shown = rows.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("__h", "item_no", "after_score"))).alias("s")).select("trial", F.col("s.item_no").alias("shuffle_order"), F.col("s.after_score").alias("answers"))
    return t.remap(shown, "answers", "shuffle_order").select("trial", F.array_join(F.transform("source_answers", lambda x: x.cast("string")), ",", "-").alias("source_answers"))


@query("j12_linked_tasks", with_views("SELECT a.trial, a.item_no, a.after_score, b.after_score AS linked_after_score FROM scored_v a JOIN scored_v b ON a.trial = b.trial AND b.item_no = a.item_no - 1 WHERE a.item_no % 2 = 0"))
def j12(spark, d):
    rows = view(spark, d, "scored_v").select("trial", "item_no", "after_score", F.when(F.col("item_no") % 2 == 0, F.col("item_no") - 1).alias("linked_slot"))
    return t.linked(rows, ("trial",), "item_no", "linked_slot", "after_score").select("trial", "item_no", "after_score", "linked_after_score")


@query("w10_duplicate_ids", with_views("SELECT trial, line, count(*) AS n FROM items_v GROUP BY ALL HAVING count(*) > 1"))
def w10(spark, d):
    return t.duplicate_ids(view(spark, d, "items_v").select("trial", "line"), ("trial", "line")).filter("is_duplicate").groupBy("trial", "line").agg(F.count("*").alias("n"))
