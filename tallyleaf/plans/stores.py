"""Queries on sources, sinks and streams: views are written as records, read back and must say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf.functions import values as v
from tallyleaf.operators import trial_records
from tallyleaf.registry import query
from tallyleaf.sources import records
from tallyleaf.sources.fixtures import tasks, view, with_views
from tallyleaf.streaming import live


@query("s1_saved_results", with_views("SELECT run_id, response_status, count(*) AS n, CAST(sum(length(raw_response)) AS BIGINT) AS chars FROM results_v GROUP BY ALL"))
def s1(spark, d):
    folder = records.scratch(spark, "results")
    rows = view(spark, d, "results_v")
    # documents of several lines, 200 trials in each so that there are fewer files; two files are broken
    text = F.to_json(F.struct(*[c for c in rows.columns if c not in ("order_no", "pair_id", "source")]))
    part = F.floor(F.col("order_no") / 200).cast("string")
    files = rows.groupBy(F.concat(F.lit("order_"), part).alias("name")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(text), ",\n"), F.lit("\n]")).alias("value"))
    files = files.unionByName(spark.createDataFrame([("order_x1", "{"), ("order_x2", "[1, 2")], "name string, value string"))
    # one file for each document, in one folder, by tasks of at most 64 documents that move their files themselves
    spread = tasks(spark, d, "orders", 64 * 200)
    files.select("value").repartition(spread).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(folder)
    found = records.read_documents(spark, folder, "part-*.txt", records.RESULT)
    return found.groupBy("run_id", "response_status").agg(F.count("*").alias("n"), F.sum(F.length("raw_response")).alias("chars"))


@query("s2_saved_attempts", with_views("SELECT status, attempt, count(*) AS n FROM attempts_v GROUP BY ALL"))
def s2(spark, d):
    folder = records.scratch(spark, "attempts")
    view(spark, d, "attempts_v").drop("source", "order_no").write.option("compression", "gzip").json(folder)
    return records.read_lines(spark, folder, records.ATTEMPT).groupBy("status", "attempt").agg(F.count("*").alias("n"))


@query("s3_plans", with_views("SELECT scale_name, language, count(*) AS n, CAST(sum(order_no) AS BIGINT) AS orders FROM plan_v WHERE order_no % 11 <> 0 GROUP BY ALL"))
def s3(spark, d):
    folder = records.scratch(spark, "plan")
    plan = view(spark, d, "plan_v")
    line = F.to_json(F.struct(*plan.columns))
    plan.select(F.when(F.col("order_no") % 11 == 0, F.substring(line, 1, 60)).otherwise(line).alias("value")).write.text(folder + "/plan.jsonl")
    return records.read_lines(spark, folder, records.PLAN, "*").groupBy("scale_name", "language").agg(F.count("*").alias("n"), F.sum("order_no").alias("orders"))


@query("s5_manifest_tasks", with_views("SELECT run_id, scale_name, language, model, count(*) AS trials FROM plan_v GROUP BY ALL"))
def s5(spark, d):
    folder = records.scratch(spark, "manifests")
    tasks = view(spark, d, "plan_v").groupBy("run_id", "scale_name", "language", "model").agg(F.count("*").alias("trials"))
    tasks.groupBy("run_id").agg(F.collect_list(F.struct("scale_name", "language", "model", "trials")).alias("tasks")).write.json(folder)
    return records.read_tasks(spark, folder)


S6 = "CASE WHEN item_no % 5 = 0 THEN 'range_response' ELSE after_status END"


@query("s6_item_sheets", with_views(f"""SELECT trial, scale_name, language, CAST(item_no AS VARCHAR) AS index, concat('slot_', item_no) AS slot_id, '' AS block_id, '' AS context_id, CASE WHEN item_no % 2 = 0 THEN 'even' ELSE '' END AS section_id, response_type, '1' AS minimum, '40' AS maximum, '' AS linked_slot_id,
 concat('Is it "', item_no, '", or not?') AS question, CASE WHEN after_score IS NULL THEN '' ELSE concat('about', chr(10), after_score) END AS answer, coalesce(CAST(after_score AS VARCHAR), '') AS score, CASE WHEN item_no % 5 = 0 THEN '3-5' ELSE '' END AS range_text,
 CASE WHEN item_no % 5 = 0 THEN '3' ELSE '' END AS range_lower, CASE WHEN item_no % 5 = 0 THEN '5' ELSE '' END AS range_upper, '' AS range_unit, {S6} AS parse_status, '' AS parse_error, '' AS mapping_method, CASE WHEN after_score IS NULL THEN 'false' ELSE 'true' END AS answer_present, '' AS score_present,
 CASE WHEN trial % 3 = 0 THEN '' ELSE 'partial' END AS trial_status, CASE WHEN trial % 4 = 0 THEN 'usa' ELSE 'none' END AS cultural_identity, CASE WHEN item_no = 1 THEN concat('reply, ', trial, chr(10), 'more') ELSE '' END AS trial_raw_response FROM scored_v"""))  # fmt: skip
def s6(spark, d):
    """Item sheets of all 24 columns, written as CSV and read back by their header."""
    folder = records.scratch(spark, "items")
    n, text = F.col("item_no"), lambda c: c.cast("string")
    item = F.struct(
        n.alias("index"), F.concat(F.lit("slot_"), text(n)).alias("slot_id"), F.when(n % 2 == 0, "even").alias("section_id"), F.col("response_type"), F.col("minimum"), F.col("maximum"), F.concat(F.lit('Is it "'), text(n), F.lit('", or not?')).alias("question"),
        F.concat(F.lit("about\n"), text(F.col("after_score"))).alias("answer"), F.col("after_score").alias("score"), *[F.when(n % 5 == 0, x).alias(c) for c, x in (("range_text", "3-5"), ("range_lower", "3"), ("range_upper", "5"))],
        F.when(n % 5 == 0, "range_response").otherwise(F.col("after_status")).alias("parse_status"), F.col("after_score").isNotNull().alias("answer_present"),
    )
    trial = F.col("trial")
    payload = view(spark, d, "scored_v").groupBy("trial", "scale_name", "language").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumns({
        "response_status": F.when(trial % 3 != 0, "partial"), "cultural_identity": F.when(trial % 4 == 0, "usa"), "raw_response": F.concat(F.lit("reply, "), text(trial), F.lit("\nmore")),
    })
    records.write_items(trial_records.item_rows(payload), folder, tasks(spark, d, "lineitem", 50_000))
    return records.read_items(spark, folder)


@query("s7_trial_store", with_views("SELECT run_id, scale_name, count(*) AS n, count(DISTINCT model) AS models FROM results_v WHERE language = 'en' GROUP BY ALL"))
def s7(spark, d):
    folder = records.scratch(spark, "store")
    records.write_trials(view(spark, d, "results_v").withColumn("model", v.safe_name("model")), folder)
    back = spark.read.parquet(folder).filter("language = 'en'")  # partition pruning
    return back.groupBy("run_id", "scale_name").agg(F.count("*").alias("n"), F.countDistinct("model").alias("models"))


@query("s8_reply_export", "SELECT doc_id, CAST(greatest(ceil(length(text) / 900.0), 1) AS INT) AS n_parts, sha256(substr(text, 1, 900)) AS first_part, sha256(text) AS whole FROM documents")
def s8(spark, d):
    folder = records.scratch(spark, "export")
    rows = view(spark, d, "documents").select("doc_id", F.posexplode(v.parts("text", 900)).alias("p", "part"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    back = spark.read.schema("doc_id long, p int, part string").option("header", True).option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    whole = back.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("part", F.lit("")).alias("part")))).alias("l"))
    return whole.select("doc_id", F.size("l").alias("n_parts"), F.sha2(F.get("l.part", F.lit(0)), 256).alias("first_part"), F.sha2(F.array_join(F.col("l.part"), ""), 256).alias("whole"))


@query("s9_audit_outputs", with_views("""SELECT 'changes' AS output, count(*) AS n FROM scored_v WHERE before_score IS DISTINCT FROM after_score UNION ALL SELECT 'statuses', count(DISTINCT after_status) FROM scored_v"""))
def s9(spark, d):
    folder = records.scratch(spark, "audit")
    rows = view(spark, d, "scored_v")
    changes = rows.filter(~F.col("before_score").eqNullSafe(F.col("after_score"))).select("trial", "item_no", "before_score", "after_score")
    records.write_audit({"changes": changes, "statuses": rows.groupBy("after_status").count()}, folder, records.scratch(spark, "source"))
    count = lambda name: spark.read.option("header", True).csv(f"{folder}/{name}").agg(F.lit(name).alias("output"), F.count("*").alias("n"))
    return count("changes").unionByName(count("statuses"))


STREAM = """r AS (SELECT user_id AS id, concat('run_', CAST(user_id % 2 AS VARCHAR(9))) AS run, concat('task_', CAST(user_id % 6 AS VARCHAR(9))) AS task, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS kind_rank, event_id AS attempt, concat('event/', CAST(event_id AS VARCHAR(20))) AS source,
  CASE WHEN event_type = 'error' THEN 'transport_error' ELSE event_type END AS status FROM events)"""


def _stream(spark, d):
    """The events as files in shuffled order, with a broken line in each, and a stream over them."""
    folder = records.scratch(spark, "stream")
    e = view(spark, d, "events")
    failed = F.col("event_type") == "error"
    rows = e.select(
        F.col("user_id").alias("id"), F.concat(F.lit("run_"), (F.col("user_id") % 2).cast("string")).alias("run"), F.concat(F.lit("task_"), (F.col("user_id") % 6).cast("string")).alias("task"), F.when(failed, 1).otherwise(2).alias("kind_rank"), F.col("event_id").alias("attempt"),
        F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("source"), F.when(failed, "transport_error").otherwise(F.col("event_type")).alias("status"), F.col("ts").alias("seen_at"),
    )
    text = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), "source")
    broken = text.filter("source like '%7'").select(F.substring("value", 1, 20).alias("value"), "source")
    text.unionByName(broken).repartition(6, F.xxhash64("source")).select("value").write.text(folder + "/in")
    return live.ingest(spark, folder + "/in", files_per_batch=2), folder


@query("t1_incremental_ingest", f"WITH {STREAM} SELECT task, status, count(*) AS n FROM r GROUP BY ALL")
def t1(spark, d):
    rows, folder = _stream(spark, d)
    return live.run_once(rows, "ingest", "append", folder).groupBy("task", "status").agg(F.count("*").alias("n"))


@query("t2_live_current_trials", f"WITH {STREAM} SELECT id, kind_rank, attempt, source, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind_rank DESC, attempt DESC, source DESC) AS rn FROM r) x WHERE rn = 1")
def t2(spark, d):
    rows, folder = _stream(spark, d)
    changes = live.run_once(live.current_trials(rows, LONGEST_RUN), "current", "update", folder)
    return changes.groupBy("id").agg(F.max_by(F.struct("kind_rank", "attempt", "source", "status"), "batch").alias("r")).select("id", "r.*")


#: How long a run may last: state of trials older than that is dropped.
LONGEST_RUN = "400 days"


@query("t3_live_progress", f"""WITH {STREAM}, p AS (SELECT concat('run_', CAST(user_id % 2 AS VARCHAR)) AS run, concat('task_', CAST(user_id % 6 AS VARCHAR)) AS task, count(DISTINCT user_id) - CASE WHEN user_id % 6 = 4 THEN 1 ELSE 0 END + CASE WHEN user_id % 6 = 5 THEN 2 ELSE 0 END AS planned FROM events GROUP BY 1, 2, user_id % 6),
 q AS (SELECT run, task, planned FROM p UNION ALL SELECT run, '__all__', sum(planned) FROM p GROUP BY run), s AS (SELECT run, task, count(DISTINCT id) AS done FROM r GROUP BY ALL UNION ALL SELECT run, '__all__', count(DISTINCT id) FROM r GROUP BY ALL)
 SELECT run, task, CAST(least(done, planned) AS BIGINT) AS done, CAST(planned AS BIGINT) AS planned, CASE WHEN done >= planned THEN 'completed' ELSE 'partial' END AS state FROM s JOIN q USING (run, task)""")  # fmt: skip
def t3(spark, d):
    """Done against planned for each task of a run and for the whole run; plans are static, and some tasks save more or fewer trials than planned."""
    rows, folder = _stream(spark, d)
    m = F.col("user_id") % 6
    plan = view(spark, d, "events").groupBy(F.concat(F.lit("run_"), (F.col("user_id") % 2).cast("string")).alias("run"), F.concat(F.lit("task_"), m.cast("string")).alias("task"), m.alias("m")).agg(F.count_distinct("user_id").alias("n"))
    plan = plan.select("run", "task", (F.col("n") - F.when(F.col("m") == 4, 1).otherwise(0) + F.when(F.col("m") == 5, 2).otherwise(0)).alias("planned"))
    changes = live.run_once(live.progress(rows, plan, LONGEST_RUN), "progress", "update", folder)
    return changes.groupBy("run", "task").agg(F.max_by(F.struct("done", "planned", "state"), F.struct("batch", "done")).alias("r")).select("run", "task", "r.*")
