"""Trial-shaped views over the driver's tables. The text of each view is SQL that Spark and DuckDB both run, so that a
query and its SQL start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PAIR = "CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT)"

#: Endings of replies: refusals, and what only sounds like one.
SAID = (
    "I cannot provide a score.", "I can’t answer that.", "I can not rate it", "I am unable to give one.", "I won't respond", "I will not complete this.", "I must decline.", "Prefer not to answer",
    "我无法回答", "我不能打分", "我不便评价", "不予回答。", "无法对此进行评价", "作为AI，我不对此给出主观评分", "I cannot see it.", "I can't wait", "As an AI I rate it 4", "unable to answer", "无法", "我可以回答",
    "I do not decline", "Well, I  will  not  score it", "cannot answer", "作为一个人工智能，我来打分",
)

VIEWS: dict[str, str] = {
    "plan_v": f"""
        SELECT concat('run_', CAST({PAIR} % 5 AS VARCHAR(9))) AS run_id, concat('scale_', CAST({PAIR} % 24 AS VARCHAR(9))) AS scale_name,
               CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'ch' END AS language, concat('prov_', CAST(o_custkey % 4 AS VARCHAR(9))) AS provider,
               concat('model_', CAST(o_custkey % 12 AS VARCHAR(9))) AS model, CAST(o_orderkey AS VARCHAR(20)) AS order_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE lower(o_orderpriority) END AS condition_hash,
               o_orderpriority AS preset_id, CAST(o_custkey % 20 AS INT) AS temperature10, {PAIR} AS pair_id, o_orderdate AS planned_at, o_orderkey AS order_no
        FROM orders""",
    "attempts_v": """
        SELECT p.run_id, p.scale_name, p.language, p.provider, p.model, p.order_id, p.condition_hash, p.preset_id, p.order_no,
               CAST(l_linenumber AS VARCHAR(9)) AS attempt, CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'unparsed' ELSE 'ok' END AS status,
               concat('attempt/', CAST(l_orderkey AS VARCHAR(20)), '/', CAST(l_linenumber AS VARCHAR(9)), '/', CAST(l_partkey AS VARCHAR(20)), '/', CAST(l_suppkey AS VARCHAR(20))) AS source,
               concat('reply ', CAST(l_partkey AS VARCHAR(20))) AS response_text, l_shipdate AS recorded_at
        FROM lineitem JOIN plan_v p ON l_orderkey = p.order_no""",
    "results_v": """
        SELECT p.run_id, p.scale_name, p.language, p.provider, p.model, p.order_id, p.condition_hash, p.order_no, p.pair_id,
               CASE o_orderstatus WHEN 'F' THEN 'ok' ELSE 'partial' END AS response_status, concat('order/', CAST(o_orderkey AS VARCHAR(20))) AS source,
               concat('answer ', CAST(o_custkey AS VARCHAR(20))) AS raw_response, o_orderdate AS recorded_at
        FROM orders JOIN plan_v p ON o_orderkey = p.order_no WHERE o_orderstatus <> 'P'""",
    "items_v": """
        SELECT l_orderkey AS trial, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS item_no,
               l_linenumber AS line, l_partkey AS partkey, concat('scale_', CAST(CAST((l_orderkey - l_orderkey % 2) / 2 AS BIGINT) % 24 AS VARCHAR(9))) AS scale_name,
               CASE WHEN l_orderkey % 2 = 0 THEN 'en' ELSE 'ch' END AS language,
               CASE l_linenumber % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'choice' ELSE 'text' END AS response_type,
               1 AS minimum, 40 AS maximum,
               CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_quantity AS INT) END AS before_score,
               CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN CAST(l_quantity AS INT) + 1 ELSE CAST(l_quantity AS INT) END AS after_score
        FROM lineitem""",
    "scored_v": """
        SELECT *, CASE WHEN before_score IS NULL THEN 'missing' WHEN before_score > maximum THEN 'out_of_range' ELSE 'parsed' END AS before_status,
               CASE WHEN after_score IS NULL THEN 'missing' WHEN after_score > maximum THEN 'out_of_range' ELSE 'parsed' END AS after_status
        FROM items_v""",
    "bodies_v": """
        SELECT trial, item_no, line, scale_name, language, CASE (line + partkey) % 7
               WHEN 0 THEN CAST(partkey % 45 AS VARCHAR(9)) WHEN 1 THEN '3-5' WHEN 2 THEN concat('Score: ', CAST(partkey % 9 AS VARCHAR(9)), ' because 2 reasons')
               WHEN 3 THEN '6 or 7' WHEN 4 THEN 'B' WHEN 5 THEN 'no clear view' ELSE concat(CAST(partkey % 8 AS VARCHAR(9)), '/7') END AS body
        FROM items_v""",
    "lines_v": "SELECT trial, item_no, concat(CAST(item_no AS VARCHAR(9)), '. ', body) AS line_text, body FROM bodies_v",
    "refusal_v": f"""
        SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '  ' ELSE concat(text, ' ', split_part('{"~".join(SAID).replace("'", "''")}', '~', CAST((conv_id + turn) % {len(SAID)} + 1 AS INT))) END AS reply,
               CASE WHEN turn % 3 = 0 THEN 'ok' WHEN turn % 3 = 1 THEN 'unparsed' ELSE 'partial' END AS parse_status
        FROM conversations""",
    "slots_v": """
        SELECT concat('scale_', CAST(CAST((p_partkey - p_partkey % 20) / 20 AS BIGINT) AS VARCHAR(20))) AS scale_name, CAST(p_partkey % 20 + 1 AS INT) AS slot_pos,
               concat('slot_', CAST(p_partkey AS VARCHAR(20))) AS slot_id, p_name AS question, p_type AS block_id,
               CASE p_size % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'within' ELSE 'block' END AS size_policy,
               CASE p_type WHEN 'ECONOMY' THEN 'fixed' WHEN 'STANDARD' THEN 'within' ELSE 'block' END AS shuffle_policy, p_size AS maximum
        FROM part""",
    "sheets_v": """
        SELECT trial, pair, CASE WHEN trial % 2 = 0 THEN 'en' ELSE 'ch' END AS language, CASE pair % 4 WHEN 0 THEN 'Scale of pairs' WHEN 1 THEN 'Circle study' WHEN 2 THEN 'DILEMMA study of circles' ELSE 'Plain list' END AS sheet_name,
               CASE WHEN trial % 7 = 0 THEN 'no title' ELSE 'Inclusion of the Other' END AS title, item_no, CASE WHEN item_no <= 1 + pair % 2 THEN 1 WHEN item_no = 9 THEN 3 ELSE 2 END AS block_no,
               CAST(item_no - CASE WHEN item_no <= 1 + pair % 2 THEN 0 ELSE 1 + pair % 2 END + CASE WHEN trial % 11 = 0 AND item_no = 2 THEN 1 ELSE 0 END AS INT) AS number
        FROM (SELECT trial, CAST((trial - trial % 2) / 2 AS BIGINT) AS pair, item_no FROM items_v) x""",
    "cells_v": """
        SELECT doc_id, lang, text FROM documents""",
    "snapshots_v": "SELECT user_id AS subject, ts, event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(value * 100 AS BIGINT) AS cents FROM events",
}


def needs(text: str) -> list[str]:
    """The views that a statement uses, in an order in which they can be defined."""
    found: list[str] = []

    def visit(t: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", t) and name not in found:
                visit(body)
                found.append(name)

    visit(text)
    return found


def with_views(sql: str) -> str:
    """A statement with the views it uses as common table expressions."""
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needs(sql))
    sql = sql.strip()
    if not head:
        return sql
    return f"WITH {head}, {sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {head} {sql}"


#: Line items that a task holds at a time where they are brought together by order.
TASK_ROWS = 200_000


def tasks(spark: SparkSession, sf_dir: str, table: str, rows: int = TASK_ROWS) -> int:
    """Tasks for a table, so that what one holds does not grow with it. The count is read from the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/{table}.parquet").count() // rows))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the driver. Line items, which views join and number by order, are dealt out by order into tasks
    of at most about TASK_ROWS; what follows by order or trial needs no other shuffle."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = with_views(f"SELECT * FROM {name}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    if "lineitem" in tables:
        tables["lineitem"] = tables["lineitem"].repartition(tasks(spark, sf_dir, "lineitem"), "l_orderkey")
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **tables)
