"""Queries on value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf.functions import clauses
from tallyleaf.functions import values as v
from tallyleaf.registry import query
from tallyleaf.sources.fixtures import view, with_views

N = r"[+-]?[0-9]+(?:\.[0-9]+)?"


REFUSED = " OR ".join("regexp_matches(said, '{}')".format(x.replace("'", "''")) for x in v.REFUSAL)


@query("f3_reply_class", with_views(f"""SELECT conv_id, turn, CASE WHEN trim(reply) = '' THEN 'empty_response' WHEN parse_status IN ('ok', 'partial') THEN parse_status
 WHEN {REFUSED} THEN 'refusal' ELSE 'unparsed' END AS reply_class FROM (SELECT *, translate(reply, '’‘', '\'\'\'\'') AS said FROM refusal_v) x"""))  # fmt: skip
def f3(spark, d):
    return view(spark, d, "refusal_v").select("conv_id", "turn", v.reply_class("reply", "parse_status").alias("reply_class"))


LITERALS = ("{}", "{}.", ".{}", "+{}", "-{}.5", " {} ", "{}.25.1", "{},5", "{}e3", "--{}", ".", "+", "{} 2", "0{}", "{}/7", "-.{}", "x{}", "{}%", "+{}.", "NaN")


@query("f4_numeric_literal", with_views(f"""SELECT trial, item_no, CASE WHEN regexp_matches(trim(said), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$') THEN CAST(ltrim(trim(said), '+') AS DOUBLE) END AS value
 FROM (SELECT trial, item_no, replace(([{', '.join(repr(x) for x in LITERALS)}])[CAST((trial + item_no) % {len(LITERALS)} + 1 AS INT)], '{{}}', CAST(partkey AS VARCHAR)) AS said FROM items_v) x"""))  # fmt: skip
def f4(spark, d):
    shape = F.element_at(F.array(*[F.lit(x) for x in LITERALS]), ((F.col("trial") + F.col("item_no")) % len(LITERALS) + 1).cast("int"))
    said = F.replace(shape, F.lit("{}"), F.col("partkey").cast("string"))
    return view(spark, d, "items_v").select("trial", "item_no", v.number(said).alias("value"))


TAIL, WHY = r"\s*(?:[.;!)。]|points?|分)*\s*", r"\s*(?:because|since|due|,? as)\b.*"
LEAD, AFTER = f"(?i)^({N}){TAIL}(?:$|{WHY}$)", rf"(?i)^\s*(?:score|answer|rating|评分|答案)\s*[:=：]?\s*({N}){TAIL}(?:$|{WHY}$)"
FRACTION, RANGE = rf"^({N})\s*/\s*({N}){TAIL}$", rf"^({N})\s*(%?)\s*(?:-|–|~|to\b|到|至)\s*({N})\s*(%?)"
SCALAR = f"""s AS (SELECT trial, item_no, body, CASE WHEN regexp_matches(body, '{FRACTION}') AND regexp_extract(body, '{FRACTION}', 2)::DOUBLE = 7 THEN 'parsed'
  WHEN regexp_matches(body, '{RANGE}') OR regexp_matches(body, '(?i)^{N}\\s*(?:or|或|/)\\s*{N}') THEN 'range_unresolved' WHEN regexp_matches(body, '{LEAD}') OR regexp_matches(body, '{AFTER}') THEN 'parsed' ELSE 'unparsed' END AS status FROM bodies_v),
 w AS (SELECT trial, item_no, body, status, CASE WHEN status <> 'parsed' THEN NULL WHEN regexp_matches(body, '{FRACTION}') THEN regexp_extract(body, '{FRACTION}', 1)::DOUBLE
  WHEN regexp_matches(body, '{LEAD}') THEN regexp_extract(body, '{LEAD}', 1)::DOUBLE ELSE regexp_extract(body, '{AFTER}', 1)::DOUBLE END AS value FROM s)"""


def _scalars(spark, d):
    return view(spark, d, "bodies_v").withColumn("x", v.scalar("body", F.lit(7.0)))


@query("f5_stated_score", with_views(f"WITH {SCALAR} SELECT trial, item_no, value, status FROM w"))
def f5(spark, d):
    return _scalars(spark, d).select("trial", "item_no", "x.value", "x.status")


@query("f6_intervals", with_views(f"SELECT trial, item_no, regexp_extract(body, '{RANGE}', 1)::DOUBLE AS lower_end, regexp_extract(body, '{RANGE}', 3)::DOUBLE AS upper_end FROM bodies_v WHERE regexp_matches(body, '{RANGE}')"))
def f6(spark, d):
    return view(spark, d, "bodies_v").withColumn("i", v.interval("body")).filter("i is not null").select("trial", "item_no", F.col("i.lower").alias("lower_end"), F.col("i.upper").alias("upper_end"))


@query("f7_interval_status", with_views(f"""SELECT trial, item_no, CASE WHEN a > b THEN 'range_unresolved' WHEN a < 1 OR b > line THEN 'range_out_of_range' ELSE 'range_response' END AS status
 FROM (SELECT trial, item_no, line, regexp_extract(body, '{RANGE}', 1)::DOUBLE AS a, regexp_extract(body, '{RANGE}', 3)::DOUBLE AS b FROM bodies_v WHERE regexp_matches(body, '{RANGE}')) x"""))  # fmt: skip
def f7(spark, d):
    rows = view(spark, d, "bodies_v").withColumn("i", v.interval("body")).filter("i is not null")
    return rows.select("trial", "item_no", v.interval_status(F.col("i"), F.lit(1.0), F.col("line").cast("double")).alias("status"))


@query("f8_typed_numbers", with_views(f"""WITH {SCALAR}, k AS (SELECT w.trial, w.item_no, value / 2 AS value, response_type FROM w JOIN items_v i ON w.trial = i.trial AND w.item_no = i.item_no WHERE value IS NOT NULL)
 SELECT trial, item_no, CASE WHEN response_type = 'integer' AND value <> floor(value) THEN NULL ELSE value END AS score,
 CASE WHEN response_type = 'integer' AND value <> floor(value) THEN 'non_integer' WHEN value < 1 OR value > 20 THEN 'out_of_range' ELSE 'parsed' END AS status FROM k"""))  # fmt: skip
def f8(spark, d):
    types = view(spark, d, "items_v").select("trial", "item_no", "response_type")
    rows = _scalars(spark, d).filter("x.value is not null").join(types, ["trial", "item_no"])
    return rows.withColumn("t", v.typed_number(F.col("x.value") / 2, F.col("response_type"), F.lit(1.0), F.lit(20.0))).select("trial", "item_no", "t.score", "t.status")


NAMES = ("是", "正确", "Y", "n", "NO.", "错误", "不", "b.", "3.0", "yes!", "对。", "maybe", "3.5", " B ")


@query("f9_choices", with_views(f"""SELECT trial, item_no, CASE WHEN trial % 2 = 0 THEN CASE WHEN s IN ('是', '正确', 'y', 'yes', '对') THEN 'YES' WHEN s IN ('n', 'no', '错误', '不') THEN 'NO' END WHEN s = 'yes' THEN 'Yes' WHEN s = 'b' THEN 'B' WHEN regexp_matches(s, '^3([.]0+)?$') THEN '3' END AS choice
 FROM (SELECT trial, item_no, regexp_replace(lower(trim(CASE WHEN partkey % 3 = 0 THEN body ELSE ([{', '.join(repr(x) for x in NAMES)}])[CAST(partkey % {len(NAMES)} + 1 AS INT)] END)), '[.。!]+$', '') AS s FROM bodies_v JOIN items_v USING (trial, item_no)) x"""))  # fmt: skip
def f9(spark, d):
    k = F.col("partkey")
    rows = view(spark, d, "bodies_v").join(view(spark, d, "items_v").select("trial", "item_no", "partkey"), ["trial", "item_no"])
    said = F.when(k % 3 == 0, F.col("body")).otherwise(F.element_at(F.array(*[F.lit(x) for x in NAMES]), (k % len(NAMES) + 1).cast("int")))
    listed = F.when(F.col("trial") % 2 == 0, F.array(F.lit("YES"), F.lit("NO"))).otherwise(F.array(F.lit("B"), F.lit("Yes"), F.lit("3")))
    return rows.select("trial", "item_no", v.choice(said, listed).alias("choice"))


@query("f11_pair_codes", with_views("""SELECT trial, item_no, CASE WHEN a <> b AND concat(least(a, b), '-', greatest(a, b)) <> '1-7' THEN concat(least(a, b), '-', greatest(a, b)) END AS pair
 FROM (SELECT trial, item_no, CAST(partkey % 7 + 1 AS VARCHAR) AS a, CAST(line AS VARCHAR) AS b FROM items_v) x"""))  # fmt: skip
def f11(spark, d):
    listed = F.array(*[F.lit(f"{a}-{b}") for a in range(1, 8) for b in range(a + 1, 8) if (a, b) != (1, 7)])
    said = F.concat(F.lit("("), (F.col("partkey") % 7 + 1).cast("string"), F.lit(" and "), F.col("line").cast("string"), F.lit(")."))
    return view(spark, d, "items_v").select("trial", "item_no", v.pair_code(said, listed).alias("pair"))


#: Wording of logical decisions: what is decided. {x} is any name.
DECIDING = (
    ("Yes, it holds", "YES"), ("No.", "NO"), ("The argument is invalid", "NO"), ("YES or NO depends", ""), ("it would be valid if {x}", ""), ("The argument is valid", "YES"), ("This does not follow", "NO"), ("The conclusion follows logically from the premises, {x}", "YES"),
    ("It is not invalid", ""), ("not logically valid", "NO"), ("If {x} holds it is logically valid", ""), ("logically valid, says {x}", "YES"), ("是。", "YES"), ("否", "NO"), ("结论不成立", "NO"), ("推理有效", "YES"), ("是或否", ""), ("答案：能推出", "YES"), ("所以不能推出。", "NO"), ("No {x} is a bird", ""),
    ("definitely true", ""), ("Answer: YES (by {x})", "YES"), ("Yes. But no.", ""), ("", ""),
)


@query("f13_logical_decision", with_views(f"""SELECT trial, item_no, nullif(([{', '.join(repr(w) for _, w in DECIDING)}])[CAST((trial * 5 + item_no) % {len(DECIDING)} + 1 AS INT)], '') AS decision FROM items_v"""))
def f13(spark, d):
    says = F.element_at(F.array(*[F.lit(t) for t, _ in DECIDING]), ((F.col("trial") * 5 + F.col("item_no")) % len(DECIDING) + 1).cast("int"))
    named = F.replace(says, F.lit("{x}"), F.concat(F.lit("case "), F.col("partkey").cast("string")))
    return view(spark, d, "items_v").select("trial", "item_no", clauses.logical_decision(named).alias("decision"))


@query("f15_text_parts", """SELECT doc_id, CAST(n AS INT) AS part_no, sha256(substr(text, CAST((n - 1) * 700 + 1 AS BIGINT), 700)) AS digest FROM
 (SELECT doc_id, text, unnest(range(1, CAST(greatest(ceil(length(text) / 700.0), 1) AS BIGINT) + 1)) AS n FROM documents) x""")  # fmt: skip
def f15(spark, d):
    rows = view(spark, d, "documents").select("doc_id", F.posexplode(v.parts("text", 700)).alias("p", "part"))
    return rows.select("doc_id", (F.col("p") + 1).alias("part_no"), F.sha2(F.col("part").cast("binary"), 256).alias("digest"))


@query("f16_visible_controls", """SELECT doc_id, sha256(replace(replace(text, ' ', chr(7)), chr(7), '\\u0007')) AS digest FROM documents""")
def f16(spark, d):
    belled = F.replace("text", F.lit(" "), F.lit("\x07"))
    return view(spark, d, "documents").select("doc_id", F.sha2(v.visible_controls(belled), 256).alias("digest"))


@query("f26_recorded_times", """SELECT event_id, strftime(CASE WHEN event_id % 3 = 2 THEN TIMESTAMP '2020-01-01 00:00:00' WHEN event_id % 3 = 1 THEN s - INTERVAL 8 HOUR ELSE s END, '%Y-%m-%dT%H:%M:%SZ') AS utc,
 strftime(CASE WHEN event_id % 3 = 2 THEN TIMESTAMP '2020-01-01 00:00:00' WHEN event_id % 3 = 1 THEN s - INTERVAL 8 HOUR ELSE s END + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') AS shanghai
 FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events) x""")  # fmt: skip
def f26(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    m = F.col("event_id") % 3
    text = F.concat(stamp, F.when(m == 0, "Z").when(m == 1, "+08:00").otherwise(""))
    rows = view(spark, d, "events").select("event_id", v.utc_text(text, F.to_timestamp(F.lit("2020-01-01 00:00:00"))).alias("utc"))
    return rows.withColumn("shanghai", v.shanghai_text(F.col("utc")))


@query("f27_canonical_hash", with_views("""SELECT order_no, sha256(concat('{"condition_hash":', CASE WHEN condition_hash IS NULL THEN 'null' ELSE concat('"', condition_hash, '"') END, ',"model":"', model, '","order_no":', order_no, '}')) AS digest FROM plan_v"""))
def f27(spark, d):
    return view(spark, d, "plan_v").select("order_no", v.canonical_hash("model", "order_no", "condition_hash").alias("digest"))


@query("f28_condition_hash", with_views("""SELECT digest, count(*) AS trials, count(DISTINCT run_id) AS runs FROM (SELECT run_id, sha256(concat('{"model":"', model, '","preset_id":"', preset_id, '","scale_name":"', scale_name, '","temperature10":', temperature10, '}')) AS digest FROM plan_v) x GROUP BY 1"""))
def f28(spark, d):
    rows = view(spark, d, "plan_v").select("run_id", v.canonical_hash("scale_name", "model", "preset_id", "temperature10").alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("trials"), F.countDistinct("run_id").alias("runs"))


@query("f29_trial_seeds", with_views("""SELECT order_no, CASE WHEN order_no % 10 <> 0 THEN CAST((('0x' || substr(sha256(concat_ws('|', '42', scale_name, CASE WHEN order_no % 2 = 0 THEN '' ELSE language END, order_no, 'order')), 1, 16))::UBIGINT) % 2147483647 AS BIGINT) END AS seed FROM plan_v"""))
def f29(spark, d):
    language = F.when(F.col("order_no") % 2 == 0, "").otherwise(F.col("language"))  # paired runs leave it out
    seed = v.trial_seed(F.lit(42), F.col("scale_name"), language, F.col("order_no"), F.lit("order"))
    return view(spark, d, "plan_v").select("order_no", F.when(F.col("order_no") % 10 != 0, seed).alias("seed"))


@query("f33_safe_endpoints", r"""SELECT page_id, regexp_replace(concat(regexp_extract(u, '^([a-z]+://)', 1), regexp_extract(u, '^[a-z]+://(?:[^/?#@]*@)?([^/?#]+)', 1), regexp_extract(u, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '^$', '') AS endpoint
 FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '://', '://user:pw@') ELSE url END AS u FROM pages) x""")  # fmt: skip
def f33(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("://"), F.lit("://user:pw@"))).otherwise(F.col("url"))
    return view(spark, d, "pages").select("page_id", v.safe_endpoint(url).alias("endpoint"))


@query("f34_proxy_identity", r"""SELECT page_id, h AS host, CASE WHEN page_id % 2 = 0 THEN 8080 END AS port, page_id % 3 = 0 AS has_credentials, sha256(concat(s, '://', h, CASE WHEN page_id % 2 = 0 THEN ':8080' ELSE '' END)) AS fingerprint
 FROM (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS h FROM pages) x""")  # fmt: skip
def f34(spark, d):
    m = F.col("page_id")
    p = r"^([a-z]+://)([^/?#:]+)"
    url = F.concat(F.regexp_extract("url", p, 1), F.when(m % 3 == 0, "u:p@").otherwise(""), F.regexp_extract("url", p, 2), F.when(m % 2 == 0, ":8080").otherwise(""))
    return view(spark, d, "pages").withColumn("x", v.proxy_identity(url)).select("page_id", "x.host", "x.port", "x.has_credentials", "x.fingerprint")


HEADERS = ("X-Request-Id", "OpenAI-Processing-Ms", "openai-version", "Openai-Organization", "openai-project", "Retry-After", "SERVER", "Date", "Set-Cookie", "Content-Type", "Authorization", "x-ratelimit-limit", "request-id", "X-Api-Key")


@query("f35_kept_headers", f"""SELECT event_id, CASE WHEN lower(n) IN ('x-request-id', 'openai-processing-ms', 'openai-version', 'openai-organization', 'openai-project', 'retry-after', 'server', 'date') THEN concat(lower(n), '=', event_type) ELSE '' END AS headers
 FROM (SELECT *, ([{', '.join(repr(x) for x in HEADERS)}])[CAST(event_id % {len(HEADERS)} + 1 AS INT)] AS n FROM events) x""")  # fmt: skip
def f35(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in HEADERS]), (F.col("event_id") % len(HEADERS) + 1).cast("int"))
    headers = F.map_from_arrays(F.array(name, F.lit("X-Other")), F.array(F.col("event_type"), F.col("user_id").cast("string")))
    kept = F.array_sort(F.map_entries(v.kept_headers(headers)))
    return view(spark, d, "events").select("event_id", F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("headers"))


#: Openings, letters and counts of planted keys: some are keys, some are too short or stand inside a word.
KEYS = (("sk-", "aB3_", 6), ("sk-", "aB3-", 5), ("ghp_", "Zz9", 8), ("gho_", "Q1", 12), ("ghu_", "x", 23), ("ghs_", "Ab", 13), ("ghr_", "7", 24), ("ghx_", "7", 30), ("AIza", "k_9", 10), ("AIza", "k", 29), ("xsk-", "a", 40), ("AKIA", "A1", 10))


@query("f37_credential_scan", rf"""SELECT doc_id, CAST(len(regexp_extract_all(said, '\b(?:sk-[A-Za-z0-9_-]{{24,}}|gh[pousr]_[A-Za-z0-9]{{24,}}|AIza[A-Za-z0-9_-]{{30,}})\b')) AS INT) AS hits
 FROM (SELECT doc_id, concat(text, ' ', ([{', '.join(repr(a + b * n) for a, b, n in KEYS)}])[CAST(doc_id % {len(KEYS)} + 1 AS INT)]) AS said FROM documents) x""")  # fmt: skip
def f37(spark, d):
    planted = F.element_at(F.array(*[F.concat(F.lit(a), F.repeat(F.lit(b), F.lit(n))) for a, b, n in KEYS]), (F.col("doc_id") % len(KEYS) + 1).cast("int"))
    return view(spark, d, "documents").select("doc_id", v.credential_count(F.concat("text", F.lit(" "), planted)).alias("hits"))


@query("f38_safe_names", r"""SELECT page_id, coalesce(nullif(regexp_replace(translate(trim(n), '<>:"/\|?*', '_________'), '[. ]+$', ''), ''), 'unnamed') AS name FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN ' .. ' ELSE url END AS n FROM pages) x""")
def f38(spark, d):
    return view(spark, d, "pages").select("page_id", v.safe_name(F.when(F.col("page_id") % 9 == 0, " .. ").otherwise(F.col("url"))).alias("name"))


@query("f32_snapshot_changes", with_views("""SELECT event_id, CASE WHEN k IS NULL OR pk IS NULL THEN 'unknown' WHEN k <> pk AND event_type <> pt THEN 'event_type,k' WHEN k <> pk THEN 'k' WHEN event_type <> pt THEN 'event_type' ELSE 'stable' END AS changed
 FROM (SELECT *, lag(k) OVER w AS pk, lag(event_type) OVER w AS pt FROM snapshots_v WINDOW w AS (PARTITION BY subject ORDER BY ts, event_id)) x"""))  # fmt: skip
def f32(spark, d):
    from tallyleaf.operators.design import snapshot_changes

    return snapshot_changes(view(spark, d, "snapshots_v"), "subject", ["ts", "event_id"], ["event_type", "k"]).select("event_id", "changed")
