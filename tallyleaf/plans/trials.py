"""Queries on trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyleaf.operators import trial_records as r
from tallyleaf.operators import trials as t
from tallyleaf.registry import query
from tallyleaf.sources.fixtures import view, with_views

ID = "sha256(CAST(to_json([run_id, scale_name, language, provider, model, order_id, condition_hash]) AS VARCHAR))"

#: All records in common columns, as SQL.
ROWS = f"""
 pl AS (SELECT {ID} AS id, * FROM plan_v),
 rows_q AS (
  SELECT id, run_id, scale_name, language, provider, model, order_no, condition_hash, preset_id, temperature10, 'plan' AS kind, 0 AS kr, 0 AS attempt,
         'not_recorded' AS status, 'plan' AS source, 0 AS n_chars FROM pl
  UNION ALL
  SELECT a.id, a.run_id, a.scale_name, a.language, a.provider, a.model, a.order_no, a.condition_hash, coalesce(a.preset_id, pl.preset_id), pl.temperature10, 'attempt', 1,
         CAST(a.attempt AS INT), CASE a.status WHEN 'error' THEN 'transport_error' ELSE a.status END, a.source, length(a.response_text)
  FROM (SELECT {ID} AS id, * FROM attempts_v) a LEFT JOIN pl ON a.id = pl.id
  UNION ALL
  SELECT r.id, r.run_id, r.scale_name, r.language, r.provider, r.model, r.order_no, r.condition_hash, pl.preset_id, pl.temperature10, 'result', 2,
         0, r.response_status, r.source, length(r.raw_response)
  FROM (SELECT {ID} AS id, * FROM results_v) r LEFT JOIN pl ON r.id = pl.id),
 cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kr DESC, attempt DESC, source DESC) AS rn FROM rows_q) x WHERE rn = 1)"""


def _sql(body: str) -> str:
    return with_views(f"WITH {ROWS.strip()} {body}")


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return view(spark, d, "plan_v"), view(spark, d, "attempts_v"), view(spark, d, "results_v")


def current(spark: SparkSession, d: str, *says: str) -> DataFrame:
    """The current rows, with the columns that are asked for beside id and trial."""
    return t.collect_trials(*_three(spark, d), says)


@query("j2_current_trials", _sql("SELECT id, run_id, scale_name, language, provider, model, order_no, preset_id, temperature10, kind, attempt, status, source, n_chars FROM cur"))
def j2(spark, d):
    return current(spark, d, "preset_id", "temperature10", "kind", "attempt", "status", "source", "n_chars").select("id", "run_id", "scale_name", "language", "provider", "model", "order_no", "preset_id", "temperature10", "kind", "attempt", "status", "source", "n_chars")




@query("u1_union_of_records", _sql("SELECT kind, status, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM rows_q GROUP BY ALL"))
def u1(spark, d):
    plan, attempts, results = _three(spark, d)
    rows = t.normalise(plan, "plan").unionByName(t.normalise(attempts, "attempt")).unionByName(t.normalise(results, "result"))
    return rows.groupBy("kind", "status").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


BROKEN = """SELECT kind, order_no, CASE order_no % 6 WHEN 0 THEN '1.5' WHEN 1 THEN 'inf' WHEN 2 THEN concat('000', order_id) WHEN 3 THEN NULL ELSE order_id END AS order_id,
 CASE WHEN order_no % 5 = 0 THEN ' ' ELSE scale_name END AS scale_name, CASE WHEN order_no % 7 = 0 THEN 'de' ELSE language END AS language, order_no % 8 <> 0 AS has_text, order_no % 10 <> 1 AS has_more
 FROM (SELECT 'result' AS kind, order_no, order_id, scale_name, language FROM results_v UNION ALL SELECT 'attempt', order_no, order_id, scale_name, language FROM attempts_v UNION ALL SELECT 'plan', order_no, order_id, scale_name, language FROM plan_v) x"""


@query("p1_valid_records", with_views(f"""WITH b AS ({BROKEN}), v AS (SELECT kind, order_no, coalesce(trim(scale_name) <> '' AND language IN ('ch', 'en') AND regexp_matches(order_id, '^[0-9]+$'), false) AND (kind = 'plan' OR (has_text AND has_more)) AS valid,
 CASE WHEN regexp_matches(order_id, '^[0-9]+$') THEN CAST(order_id AS BIGINT) END AS order_id FROM b) SELECT kind, order_no, valid, order_id, count(*) AS n FROM v GROUP BY ALL"""))  # fmt: skip
def p1(spark, d):
    """Plans, attempts and results of which some have no order, scale, language, text, items or schema version."""
    m = F.col("order_no")
    out = None
    for kind, name, (body, more) in (("plan", "plan_v", ("x", "y")), ("attempt", "attempts_v", ("response_text", "attempt_schema_version")), ("result", "results_v", ("raw_response", "items"))):
        rows = view(spark, d, name).select(
            "order_no", F.when(m % 6 == 0, "1.5").when(m % 6 == 1, "inf").when(m % 6 == 2, F.concat(F.lit("000"), "order_id")).when(m % 6 == 3, None).otherwise(F.col("order_id")).alias("order_id"),
            F.when(m % 5 == 0, " ").otherwise(F.col("scale_name")).alias("scale_name"), F.when(m % 7 == 0, "de").otherwise(F.col("language")).alias("language"),
            F.when(m % 8 != 0, "said").alias(body), F.when(m % 10 != 1, F.array(F.lit("1")) if kind == "result" else F.lit("v2")).alias(more),
        )
        part = rows.select(F.lit(kind).alias("kind"), "order_no", r.is_trial(rows, kind).alias("valid"), t.whole_number("order_id").alias("order_id"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "order_no", "valid", "order_id").agg(F.count("*").alias("n"))


PRESETS = ("free_response_v1", "custom", None, "my_preset", "", "china_identity_v1")


def _whole(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plans, attempts and results with nested settings, of which each part is absent in some."""
    n = F.col("order_no")
    key = ["run_id", "scale_name", "language", "provider", "order_id", F.coalesce("condition_hash", F.lit("none")).alias("condition_hash")]
    settings = lambda a, b: F.struct(a.cast("double").alias("temperature"), b.cast("double").alias("top_p"))
    plan = view(spark, d, "plan_v").select(
        *key, F.col("model").alias("requested_model"), F.when(n % 3 != 0, F.col("model")).alias("model"), F.element_at(F.array(*[F.lit(x).cast("string") for x in PRESETS]), (n % 6 + 1).cast("int")).alias("preset_id"),
        F.when(n % 7 != 0, settings(F.col("temperature10"), n % 2)).alias("generation_config"), F.when(n % 2 == 0, 9).alias("temperature"),
        F.when(n % 5 != 0, F.struct(F.when(n % 5 == 1, "usa").alias("cultural_identity"), F.when(n % 5 == 2, "free_scores_only").alias("prompt_contract"))).alias("condition_descriptor"),
        F.when(n % 11 == 0, "china").alias("cultural_identity"), F.when(n % 13 == 0, "custom").alias("condition_mode"), (n % 40).alias("n_items"),
    )
    k = F.col("attempt").cast("int")
    attempts = view(spark, d, "attempts_v").select(
        *key, "model", "attempt", "status", "source", "response_text", F.when(n % 17 != 0, "v1").alias("attempt_schema_version"), F.when(k % 2 != 0, settings(F.lit(5), F.lit(None))).alias("generation_config"),
        F.concat(F.lit("r"), "attempt").alias("recorded_at_utc"), F.when(k == 1, F.struct(F.lit("local 1").alias("request_completed_at_local"))).alias("model_metadata"),
    )
    results = view(spark, d, "results_v").select(
        *key, "model", "source", "raw_response", F.when(n % 23 != 0, F.col("response_status")).alias("response_status"), F.when(n % 19 != 0, F.array(F.lit(1))).alias("items"), F.when(n % 2 == 0, settings(F.lit(3), F.lit(1))).alias("generation_config"),
        F.concat(F.lit("p"), n.cast("string")).alias("prompt"), (n % 9).alias("answered_item_count"), (n % 8).cast("string").alias("read_item_count"), F.when(n % 2 == 1, n % 30).alias("item_count"), (n % 40).alias("n_items"),
        F.lit("done").alias("recorded_at_utc"), F.when(n % 10 == 0, "usa").alias("cultural_identity"),
    )
    return plan, attempts, results


WHOLE = f"""
 ident AS (SELECT *, sha256(CAST(to_json([run_id, scale_name, language, provider, model, order_id, coalesce(condition_hash, 'none')]) AS VARCHAR)) AS id, ([{', '.join('NULL' if x is None else repr(x) for x in PRESETS)}])[CAST(order_no % 6 + 1 AS INT)] AS preset,
  CAST(CASE WHEN order_no % 7 <> 0 THEN temperature10 WHEN order_no % 2 = 0 THEN 9 END AS DOUBLE) AS pt, CAST(CASE WHEN order_no % 7 <> 0 THEN order_no % 2 END AS DOUBLE) AS pp FROM plan_v),
 every AS (
  SELECT id, order_no, 0 AS kr, 0 AS k, '' AS source, 'plan' AS source_kind, nullif(preset, '') AS preset_id, CASE WHEN order_no % 11 = 0 THEN 'china' WHEN order_no % 5 = 1 THEN 'usa' ELSE 'none' END AS ci, CASE WHEN order_no % 5 = 2 THEN 'free_scores_only' ELSE 'unconstrained' END AS pc,
   order_no % 13 = 0 AS custom, pt AS temperature, pp AS top_p, 'not_recorded' AS status, '' AS raw, '' AS prompt, NULL::BIGINT AS answered, NULL::BIGINT AS readn, order_no % 40 AS items, '' AS seen FROM ident
  UNION ALL SELECT id, p.order_no, 1, CAST(attempt AS INT), source, 'attempt', nullif(preset, ''), 'none', 'unconstrained', false, CASE WHEN CAST(attempt AS INT) % 2 = 1 THEN 5.0 ELSE pt END, CASE WHEN CAST(attempt AS INT) % 2 = 0 THEN pp END,
   CASE status WHEN 'error' THEN 'transport_error' ELSE status END, response_text, '', NULL, NULL, NULL, CASE attempt WHEN '1' THEN 'local 1' ELSE concat('r', attempt) END FROM attempts_v a JOIN ident p ON a.order_no = p.order_no WHERE p.order_no % 17 <> 0
  UNION ALL SELECT id, p.order_no, 2, 0, source, 'result', nullif(preset, ''), CASE WHEN p.order_no % 10 = 0 THEN 'usa' ELSE 'none' END, 'unconstrained', false, CASE WHEN p.order_no % 2 = 0 THEN 3.0 END, CASE WHEN p.order_no % 2 = 0 THEN 1.0 END,
   CASE WHEN p.order_no % 23 = 0 THEN 'legacy_saved' ELSE response_status END, raw_response, concat('p', p.order_no), p.order_no % 9, p.order_no % 8, CASE WHEN p.order_no % 2 = 1 THEN p.order_no % 30 ELSE p.order_no % 40 END, 'done' FROM results_v r JOIN ident p ON r.order_no = p.order_no WHERE p.order_no % 19 <> 0),
 top1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kr DESC, k DESC, source DESC) AS rn FROM every) x WHERE rn = 1)"""


@query("p2_normalised_trials", with_views(f"""WITH {WHOLE.strip()} SELECT t.id, p.run_id, p.scale_name, p.language, p.provider, p.model, CASE WHEN t.custom THEN concat('自定义（', name, '）') ELSE name END AS experiment, coalesce(t.preset_id, '') AS preset_id, ci AS cultural_identity, pc AS prompt_contract,
 t.temperature, t.top_p, t.order_no AS order_id, t.status, CASE t.status WHEN 'ok' THEN 'complete' WHEN 'partial' THEN 'partly read' WHEN 'unparsed' THEN 'not read' WHEN 'transport_error' THEN 'failed call' WHEN 'not_recorded' THEN 'not recorded' ELSE 'saved, old format' END AS status_label,
 raw AS raw_response, length(raw) AS answer_length, prompt, answered AS answered_item_count, readn AS read_item_count, items AS item_count, seen AS recorded_at, t.source, t.source_kind
 FROM (SELECT *, CASE WHEN coalesce(preset_id, 'custom') <> 'custom' THEN CASE preset_id WHEN 'free_response_v1' THEN '主分析' WHEN 'china_identity_v1' THEN '中国身份条件' ELSE preset_id END WHEN ci = 'china' THEN '中国身份条件' WHEN ci = 'usa' THEN '美国身份条件'
  WHEN pc = 'free_scores_only' THEN '只答分数提示' ELSE '原指导语' END AS name FROM top1) t JOIN ident p USING (id)"""))  # fmt: skip
def p2(spark, d):
    """The whole current record of every trial."""
    return r.collect_records(*_whole(spark, d))


GIVEN = ("free_response_v1", "free_response_temperature_1_v1", "free_response_scores_only_v1", "china_identity_v1", "usa_identity_v1", "my_preset", "custom", "", None)


@query("j1_plan_inheritance", with_views(f"WITH {WHOLE.strip()} SELECT source_kind, preset_id, temperature, top_p, count(*) AS n FROM every WHERE kr > 0 GROUP BY ALL"))
def j1(spark, d):
    """What attempts and results have of their plan: the preset, and attempts without settings of their own temperature and top_p."""
    plan, attempts, results = _whole(spark, d)
    rest = r.full_records(attempts, "attempt").unionByName(r.full_records(results, "result"))
    return r.inherit_plan(rest, r.full_records(plan, "plan")).groupBy("source_kind", "preset_id", "temperature", "top_p").agg(F.count("*").alias("n"))


@query("p3_experiment_label", with_views(f"""SELECT order_no, CASE WHEN mode = 'custom' THEN concat('自定义（', name, '）') ELSE name END AS experiment FROM (SELECT order_no, mode, CASE
 WHEN coalesce(preset, '') NOT IN ('', 'custom') THEN CASE preset WHEN 'free_response_v1' THEN '主分析' WHEN 'free_response_temperature_1_v1' THEN '主分析·温度 1' WHEN 'free_response_scores_only_v1' THEN '主分析·只答分数提示'
  WHEN 'china_identity_v1' THEN '中国身份条件' WHEN 'usa_identity_v1' THEN '美国身份条件' ELSE preset END
 WHEN identity = 'china' THEN '中国身份条件' WHEN identity = 'usa' THEN '美国身份条件' WHEN contract = 'free_scores_only' THEN '只答分数提示' ELSE '原指导语' END AS name
 FROM (SELECT order_no, ([{', '.join('NULL' if x is None else repr(x) for x in GIVEN)}])[CAST(order_no % 9 + 1 AS INT)] AS preset, CASE order_no % 4 WHEN 0 THEN 'china' WHEN 1 THEN 'usa' WHEN 2 THEN 'none' END AS identity,
  CASE WHEN order_no % 5 = 0 THEN 'free_scores_only' ELSE 'unconstrained' END AS contract, CASE WHEN order_no % 7 = 0 THEN 'custom' ELSE 'natural' END AS mode FROM plan_v) x) y"""))  # fmt: skip
def p3(spark, d):
    n = F.col("order_no")
    plan = view(spark, d, "plan_v").select(
        "order_no", F.element_at(F.array(*[F.lit(x).cast("string") for x in GIVEN]), (n % 9 + 1).cast("int")).alias("preset"), F.when(n % 4 == 0, "china").when(n % 4 == 1, "usa").when(n % 4 == 2, "none").alias("identity"),
        F.when(n % 5 == 0, "free_scores_only").otherwise("unconstrained").alias("contract"), F.when(n % 7 == 0, "custom").otherwise("natural").alias("mode"),
    )
    return plan.select("order_no", t.experiment_label("preset", "identity", "contract", "mode").alias("experiment"))


@query("p4_status_labels", _sql("""SELECT CASE status WHEN 'ok' THEN 'complete' WHEN 'partial' THEN 'partly read' WHEN 'unparsed' THEN 'not read' WHEN 'transport_error' THEN 'failed call' WHEN 'not_recorded' THEN 'not recorded' ELSE status END AS status_label,
 count(*) AS n FROM cur GROUP BY 1"""))  # fmt: skip
def p4(spark, d):
    return current(spark, d, "status").groupBy(t.label("status", t.STATUS_LABELS).alias("status_label")).agg(F.count("*").alias("n"))


@query("p5_trial_listing", _sql("SELECT id, scale_name, language, order_no, status, CAST(n_chars AS BIGINT) AS n_chars FROM cur WHERE kind = 'result'"))
def p5(spark, d):
    return current(spark, d, "kind", "status", "n_chars").filter("kind = 'result'").select("id", "scale_name", "language", "order_no", "status", F.col("n_chars").cast("long").alias("n_chars"))


@query("p6_facets", _sql("SELECT scale_name, language, count(*) AS trials FROM cur GROUP BY ALL"))
def p6(spark, d):
    return current(spark, d).groupBy("scale_name", "language").agg(F.count("*").alias("trials"))


@query("p8_enumeration_aliases", with_views("""SELECT raw, CASE WHEN lower(trim(raw)) IN ('planned', 'valid', 'u-planned') THEN 'planned' WHEN lower(trim(raw)) IN ('free', 'strict', '1-urgent') THEN 'free' WHEN lower(trim(raw)) = '2-high' THEN 'score_only' END AS value, count(*) AS n
 FROM (SELECT CASE WHEN order_no % 4 = 0 THEN ' Valid ' WHEN order_no % 4 = 1 THEN 'STRICT' ELSE preset_id END AS raw FROM plan_v) x GROUP BY ALL"""))  # fmt: skip
def p8(spark, d):
    m = F.col("order_no") % 4
    raw = view(spark, d, "plan_v").select(F.when(m == 0, " Valid ").when(m == 1, "STRICT").otherwise(F.col("preset_id")).alias("raw"))
    return raw.groupBy("raw", t.alias_or_reject("raw", {"planned": ["valid", "u-planned"], "free": ["strict", "1-urgent"], "score_only": ["2-high"]}).alias("value")).agg(F.count("*").alias("n"))


@query("j7_outcomes", _sql(f"""SELECT CASE WHEN r.id IS NOT NULL THEN 'saved' WHEN a.id IS NOT NULL THEN 'failed' ELSE 'pending' END AS outcome, count(*) AS n
 FROM pl LEFT JOIN (SELECT DISTINCT {ID} AS id FROM results_v) r ON pl.id = r.id LEFT JOIN (SELECT DISTINCT {ID} AS id FROM attempts_v) a ON pl.id = a.id GROUP BY 1"""))  # fmt: skip
def j7(spark, d):
    plan, attempts, results = _three(spark, d)
    return t.outcome(t.normalise(plan, "plan"), t.normalise(attempts, "attempt"), t.normalise(results, "result")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("j7_pending_trials", _sql(f"SELECT id, order_no FROM pl WHERE {ID} NOT IN (SELECT {ID} FROM results_v) AND {ID} NOT IN (SELECT {ID} FROM attempts_v)"))
def j7_pending(spark, d):
    plan, attempts, results = _three(spark, d)
    seen = t.normalise(attempts, "attempt").select("id").unionByName(t.normalise(results, "result").select("id"))
    return t.normalise(plan, "plan").join(seen, "id", "left_anti").select("id", "order_no")


@query("w1_latest_attempts", _sql("SELECT id, attempt, source, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt DESC, source DESC) AS rn FROM rows_q WHERE kind = 'attempt') x WHERE rn = 1"))
def w1(spark, d):
    return t.latest_attempts(t.normalise(view(spark, d, "attempts_v"), "attempt")).select("id", "attempt", "source", "status")


@query("w2_next_free_number", with_views("""WITH n AS (SELECT scale_name, language, number, row_number() OVER (PARTITION BY scale_name, language ORDER BY number) AS rn
 FROM (SELECT DISTINCT scale_name, language, CAST(order_no % 97 AS BIGINT) AS number FROM results_v) x WHERE number > 0)
 SELECT scale_name, language, CAST(coalesce(min(CASE WHEN number <> rn THEN rn END), max(rn) + 1) AS INT) AS next_number FROM n GROUP BY ALL"""))  # fmt: skip
def w2(spark, d):
    return t.next_free(view(spark, d, "results_v").withColumn("number", F.col("order_no") % 97), ["scale_name", "language"], "number")


LIMIT = "CASE WHEN scale_name IN ('scale_1', 'scale_7') THEN 5 WHEN scale_name = 'scale_2' THEN 0 WHEN scale_name = 'scale_3' THEN 100000 END"


@query("a9_attempt_budget", _sql(f"""SELECT c.scale_name, c.language, trials, coalesce(attempts, 0) AS attempts, CAST(coalesce(retries, 0) AS BIGINT) AS retries, last_status, last_error, greatest(trials, CASE WHEN lim > 0 THEN lim ELSE trials * 3 END) AS budget,
 coalesce(attempts, 0) > greatest(trials, CASE WHEN lim > 0 THEN lim ELSE trials * 3 END) AS over_budget FROM (SELECT scale_name, language, count(*) AS trials, CAST({LIMIT} AS BIGINT) AS lim FROM plan_v GROUP BY ALL) c LEFT JOIN
 (SELECT scale_name, language, count(*) AS attempts, sum(CASE WHEN CAST(attempt AS INT) > 1 THEN 1 ELSE 0 END) AS retries, arg_max(CASE status WHEN 'error' THEN 'transport_error' ELSE status END, (recorded_at, source)) AS last_status,
  arg_max(concat('no reply to ', source), (recorded_at, source)) FILTER (status = 'error') AS last_error FROM attempts_v GROUP BY ALL) a USING (scale_name, language)"""))  # fmt: skip
def a9(spark, d):
    plan, attempts, _ = _three(spark, d)
    tried = t.normalise(attempts, "attempt").withColumn("error", F.when(F.col("status") == "transport_error", F.concat(F.lit("no reply to "), "source")))
    limits = plan.select("scale_name", "language", F.expr(LIMIT).cast("long").alias("limit")).filter("limit is not null").distinct()
    return t.attempt_budget(tried, t.normalise(plan, "plan"), ["scale_name", "language"], 3, limits)


@query("a10_completion", with_views("""SELECT scale_name, language, planned, coalesce(saved, 0) AS saved, CASE WHEN coalesce(saved, 0) >= planned THEN 'completed' ELSE 'partial' END AS state
 FROM (SELECT scale_name, language, count(*) AS planned FROM plan_v GROUP BY ALL) p LEFT JOIN (SELECT scale_name, language, count(DISTINCT order_no) AS saved FROM results_v GROUP BY ALL) r USING (scale_name, language)"""))  # fmt: skip
def a10(spark, d):
    plan, _, results = _three(spark, d)
    return t.completion(t.normalise(plan, "plan"), t.normalise(results, "result"), ["scale_name", "language"])


@query("a18_recent_runs", _sql("SELECT run_id, count(*) AS trials, max(recorded_at) AS last_recorded FROM results_v GROUP BY run_id"))
def a18(spark, d):
    return t.normalise(view(spark, d, "results_v"), "result").groupBy("run_id").agg(F.count("*").alias("trials"), F.max("recorded_at").alias("last_recorded")).orderBy(F.desc("last_recorded"))


@query("o1_ordered_trials", _sql("""SELECT id, CAST(row_number() OVER (PARTITION BY run_id, scale_name ORDER BY language, provider, model, order_no) AS INT) AS place FROM cur"""))
def o1(spark, d):
    """A place is the rows of all groups before its own, from a small table of counts, and its place in its group."""
    scale, fine = ["run_id", "scale_name"], ["language", "provider", "model", "slice"]
    rows = current(spark, d).select("id", *scale, *fine[:3], "order_no").withColumn("slice", F.floor(F.col("order_no") / 4096))
    before = F.sum("n").over(Window.partitionBy(*scale).orderBy(*fine)) - F.col("n")
    counts = rows.groupBy(*scale, *fine).agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    inside = F.row_number().over(Window.partitionBy(*scale, *fine).orderBy("order_no"))
    return rows.withColumn("inside", inside).join(counts, [*scale, *fine]).select("id", (F.col("before") + F.col("inside")).cast("int").alias("place"))


SIDES = """SELECT scale_name, pair_id, language, order_no, provider, CAST(pair_id * 7 + CASE WHEN order_no % 10 = 3 THEN 1 ELSE 0 END AS BIGINT) AS order_seed, CASE WHEN order_no % 14 = 1 THEN '2,1,3' ELSE '1,2,3' END AS shown, response_status, CAST(order_no % 9 AS INT) AS read_items FROM results_v"""


@query("j4_language_pairs", with_views(f"""WITH s AS ({SIDES}) SELECT e.scale_name, e.pair_id, e.order_no AS en_order, c.order_no AS ch_order, e.provider = c.provider AS same_provider, e.order_seed = c.order_seed AS same_seed, e.shown = c.shown AS same_order,
 e.response_status AS en_status, c.response_status AS ch_status, e.read_items AS en_read, c.read_items AS ch_read FROM s e JOIN s c ON e.scale_name = c.scale_name AND e.pair_id = c.pair_id WHERE e.language = 'en' AND c.language = 'ch'"""))  # fmt: skip
def j4(spark, d):
    n = F.col("order_no")
    saved = view(spark, d, "results_v").select(
        "scale_name", "pair_id", "language", "order_no", "provider", (F.col("pair_id") * 7 + F.when(n % 10 == 3, 1).otherwise(0)).alias("order_seed"),
        F.when(n % 14 == 1, F.array(F.lit(2), F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("shuffle_order"), F.col("response_status").alias("status"), (n % 9).cast("int").alias("read"),
    )
    return t.language_pairs(saved, ["scale_name", "pair_id"], "en", "ch")


CELLS = "SELECT scale_name, language, provider, model, order_no % 40 AS trial_key, condition_hash, max(response_status) AS status, max(CAST(order_no % 9 AS INT)) AS read_items FROM results_v WHERE condition_hash IS NOT NULL GROUP BY ALL"


@query("j5_condition_pairs", with_views(f"""WITH c AS ({CELLS}) SELECT a.scale_name, a.language, a.provider, a.model, a.trial_key, a.condition_hash AS left_condition, b.condition_hash AS right_condition, a.status AS left_status, b.status AS right_status, a.read_items AS left_read, b.read_items AS right_read
 FROM c a JOIN c b ON a.scale_name = b.scale_name AND a.language = b.language AND a.provider = b.provider AND a.model = b.model AND a.trial_key = b.trial_key AND a.condition_hash < b.condition_hash"""))  # fmt: skip
def j5(spark, d):
    n = F.col("order_no")
    rows = view(spark, d, "results_v").select("scale_name", "language", "provider", "model", (n % 40).alias("trial_key"), "condition_hash", F.col("response_status").alias("status"), (n % 9).cast("int").alias("read"))
    return t.condition_pairs(rows, ["scale_name", "language", "provider", "model", "trial_key"])


@query("a16_condition_overlap", with_views("""SELECT coalesce(condition_hash, '-') AS condition_hash, count(DISTINCT language) AS modes, string_agg(DISTINCT language, ',' ORDER BY language) AS mode_list FROM plan_v GROUP BY 1 HAVING count(DISTINCT language) > 1"""))
def a16(spark, d):
    rows = view(spark, d, "plan_v").groupBy(F.coalesce("condition_hash", F.lit("-")).alias("condition_hash")).agg(F.array_sort(F.collect_set("language")).alias("m"))
    return rows.filter(F.size("m") > 1).select("condition_hash", F.size("m").cast("long").alias("modes"), F.array_join("m", ",").alias("mode_list"))
