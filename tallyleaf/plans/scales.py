"""Queries on scales and study design."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyleaf.functions import values as v
from tallyleaf.operators import design, profiles, rules, scales
from tallyleaf.registry import query
from tallyleaf.sources.fixtures import view, with_views

#: What row 3 of a sheet opens with, by doc_id: markers of context, and words that are none.
OPENINGS = ("Instruction: ", "[CONTEXT] ", "【情境】：", "Task setup ", "Context: ", "【任务设定】 - ", "作答说明 ", "[instruction]", "Note: ", "任务设定：", "")
MARKED = f"CASE WHEN row_no = 3 THEN concat(([{', '.join(repr(x) for x in OPENINGS)}])[CAST(doc_id % {len(OPENINGS)} + 1 AS INT)], line) ELSE line END"
BARE = r"(?i)^(?:\[context\]|\[instruction\]|【情境】|【说明】|【任务设定】)[ ：:\-\n]*"
CELLS = f"""cell AS (SELECT doc_id, row_no, {MARKED} AS cell FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS row_no, unnest(string_split(text, chr(10))) AS line FROM documents) x),
 kept AS (SELECT c.* FROM cell c JOIN (SELECT doc_id FROM cell WHERE trim(cell) <> '' GROUP BY doc_id HAVING max(row_no) >= 3) k USING (doc_id) WHERE trim(cell) <> ''),
 kind AS (SELECT *, CASE WHEN row_no = 1 THEN 'title' WHEN row_no = 2 OR regexp_matches(trim(cell), '{BARE}') OR regexp_matches(trim(cell), '(?i)^(?:任务设定|任务说明|作答说明|task setting|task setup|instruction)') THEN 'instruction' ELSE 'item' END AS cell_kind FROM kept),
 said AS (SELECT *, CASE WHEN row_no > 2 AND cell_kind = 'instruction' THEN regexp_replace(trim(cell), '{BARE}', '') ELSE trim(cell) END AS cell_text FROM kind)"""


def _cells(spark, d):
    docs = view(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    row = F.col("p") + 1
    return docs.select("doc_id", row.cast("long").alias("row_no"), F.when(row == 3, F.concat(F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), (F.col("doc_id") % len(OPENINGS) + 1).cast("int")), "line")).otherwise(F.col("line")).alias("cell"))


@query("s4_sheet_cells", f"""WITH {CELLS} SELECT doc_id, row_no, cell_kind, sha256(cell_text) AS digest, CASE WHEN cell_kind = 'item' THEN CAST(row_number() OVER (PARTITION BY doc_id, cell_kind ORDER BY row_no) AS INT) END AS item_no FROM said""")
def s4(spark, d):
    return scales.sheets(_cells(spark, d), ["doc_id"], "row_no", "cell").select("doc_id", "row_no", "cell_kind", "item_no", F.sha2("cell_text", 256).alias("digest"))


@query("f39_context_cells", f"""WITH {CELLS} SELECT doc_id, sha256(string_agg(cell_text, chr(10) ORDER BY row_no)) AS instruction_digest, count(*) AS cells FROM said WHERE cell_kind = 'instruction' GROUP BY doc_id""")
def f39(spark, d):
    rows = scales.sheets(_cells(spark, d), ["doc_id"], "row_no", "cell").filter("cell_kind = 'instruction'")
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "cell_text"))).alias("c"), F.count("*").alias("cells"))
    return joined.select("doc_id", F.sha2(F.array_join(F.col("c.cell_text"), "\n"), 256).alias("instruction_digest"), "cells")


@query("f40_numbered_lists", with_views("""SELECT trial, count(*) AS items, string_agg(body, '~' ORDER BY item_no) AS joined FROM lines_v GROUP BY trial"""))
def f40(spark, d):
    replies = view(spark, d, "lines_v").groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("item_no", "line_text"))).alias("l")).select("trial", F.array_join(F.col("l.line_text"), "\n").alias("reply"))
    found = replies.withColumn("i", v.numbered_items("reply"))
    return found.select("trial", F.size("i").cast("long").alias("items"), F.array_join("i", "~").alias("joined"))


@query("f41_sections", """SELECT conv_id, turn, sha256(trim(concat(role, ' a'))) AS a, sha256(trim(text)) AS b FROM conversations WHERE turn % 3 <> 0""")
def f41(spark, d):
    conv = view(spark, d, "conversations")
    scenario = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("Scenario\nA. "), "role", F.lit(" a\nB. "), "text")).otherwise(F.concat(F.lit("B. first\nA. "), "role"))
    rows = conv.withColumn("s", scales.sections(scenario, ("A", "B"))).filter("s is not null")
    return rows.select("conv_id", "turn", F.sha2(F.get("s", F.lit(0)), 256).alias("a"), F.sha2(F.get("s", F.lit(1)), 256).alias("b"))


@query("f14_option_labels", with_views("""SELECT slot_id, lower(split_part(question, ' ', 2)) AS label, CAST(maximum % 7 AS VARCHAR) AS code FROM slots_v WHERE lower(split_part(question, ' ', 1)) <> lower(split_part(question, ' ', 2))
 UNION ALL SELECT slot_id, lower(split_part(question, ' ', 1)) AS label, CAST(maximum % 7 + 1 AS VARCHAR) AS code FROM slots_v WHERE lower(split_part(question, ' ', 1)) <> lower(split_part(question, ' ', 2))"""))  # fmt: skip
def f14(spark, d):
    s = view(spark, d, "slots_v")
    text = F.concat((F.col("maximum") % 7).cast("string"), F.lit(" = "), F.substring_index("question", " ", -1), F.lit(", "), (F.col("maximum") % 7 + 1).cast("string"), F.lit("="), F.substring_index("question", " ", 1))
    return scales.option_labels(s.withColumn("t", text), "slot_id", "t").select("slot_id", "label", "code")


#: Profiles of the sheets below: exact names, then rules (all words, no words), then blocks of each layout.
NAMED = {"Scale of pairs": "pair"}
RULES = [("triple", ("circle", "inclusion"), ("dilemma",)), ("five", ("dilemma", "circle"), ())]
LAYOUTS = [
    ("pair", True, [("first", 1, "choice", None, None, ["A", "B"], "fixed"), ("rest", 1, "integer", 1.0, 7.0, None, "within")]),
    ("triple", True, [("first", 2, "integer", 1.0, 5.0, None, "block"), ("rest", 1, "number", 0.0, 100.0, None, "block")]),
    ("five", False, [("first", 1, "choice", None, None, ["YES", "NO"], "fixed"), ("rest", 4, "integer", -3.0, 3.0, None, "fixed")]),
]
SHEETS = """named AS (SELECT *, CASE WHEN sheet_name = 'Scale of pairs' THEN 'pair' WHEN sheet_name = 'Circle study' AND title <> 'no title' THEN 'triple' WHEN sheet_name = 'DILEMMA study of circles' THEN 'five' END AS profile FROM sheets_v),
 lay (profile, block_no, block_id, slots, response_type, minimum, maximum, choices, policy, shuffled) AS (VALUES ('pair', 1, 'first', 1, 'choice', NULL, NULL, 'A,B', 'fixed', true), ('pair', 2, 'rest', 1, 'integer', 1, 7, NULL, 'within', true), ('triple', 1, 'first', 2, 'integer', 1, 5, NULL, 'block', true),
  ('triple', 2, 'rest', 1, 'number', 0, 100, NULL, 'block', true), ('five', 1, 'first', 1, 'choice', NULL, NULL, 'YES,NO', 'fixed', false), ('five', 2, 'rest', 4, 'integer', -3, 3, NULL, 'fixed', false)),
 sheet AS (SELECT DISTINCT trial, pair, language, profile FROM named WHERE profile IS NOT NULL),
 block AS (SELECT s.trial, l.block_no, l.block_id, l.slots, (SELECT string_agg(number, ' ' ORDER BY number) FROM named n WHERE n.trial = s.trial AND n.block_no = l.block_no) AS numbers, (SELECT string_agg(i, ' ' ORDER BY i) FROM range(1, l.slots + 1) r(i)) AS want FROM sheet s JOIN lay l USING (profile)),
 error AS (SELECT trial, block_no, concat(block_id, ': expected items 1 to ', slots, ', found ', coalesce(numbers, 'none')) AS m FROM block WHERE numbers IS DISTINCT FROM want UNION ALL SELECT DISTINCT trial, 9, concat('no block ', block_no) FROM named WHERE profile IS NOT NULL AND block_no > 2),
 checked AS (SELECT s.*, (SELECT count(*) FROM named n WHERE n.trial = s.trial)::INT AS found, (SELECT sum(slots) FROM lay WHERE lay.profile = s.profile)::INT AS expected, coalesce((SELECT string_agg(m, '; ' ORDER BY block_no) FROM error e WHERE e.trial = s.trial), '') AS errors FROM sheet s)"""


def _sheets(spark, d):
    return view(spark, d, "sheets_v").withColumn("profile", profiles.profile_of(F.col("sheet_name"), F.col("title"), NAMED, RULES))


def _checked(spark, d):
    return profiles.check_sheets(_sheets(spark, d).drop("sheet_name", "title", "item_no"), spark.createDataFrame(LAYOUTS, profiles.LAYOUT), ["trial", "pair", "language"])


@query("j10_profiles", with_views(f"WITH {SHEETS} SELECT trial, sheet_name, title, max(profile) AS profile FROM named GROUP BY ALL"))
def j10(spark, d):
    return _sheets(spark, d).select("trial", "sheet_name", "title", "profile").distinct()


@query("j9_typed_slots", with_views(f"""WITH {SHEETS} SELECT trial, CAST(row_number() OVER (PARTITION BY trial ORDER BY n.block_no, number) AS INT) AS slot_pos, concat(block_id, '_', lpad(CAST(number AS VARCHAR), 3, '0')) AS slot_id, response_type,
 CAST(minimum AS DOUBLE) AS minimum, CAST(maximum AS DOUBLE) AS maximum, choices, policy AS shuffle_policy FROM named n JOIN lay l ON n.profile = l.profile AND n.block_no = l.block_no WHERE trial IN (SELECT trial FROM checked WHERE errors = '')"""))  # fmt: skip
def j9(spark, d):
    return profiles.typed_slots(_checked(spark, d), ["trial"]).select("trial", "slot_pos", "slot_id", "response_type", "minimum", "maximum", F.when(F.col("choices").isNotNull(), F.array_join("choices", ",")).alias("choices"), "shuffle_policy")


@query("a12_structure", with_views(f"WITH {SHEETS} SELECT trial, profile, found, expected, errors AS profile_error FROM checked"))
def a12(spark, d):
    return _checked(spark, d).select("trial", "profile", "found", "expected", F.array_join("errors", "; ").alias("profile_error"))


@query("j6_layout_compatibility", with_views(f"""WITH {SHEETS} SELECT a.pair, a.profile, CASE WHEN a.profile <> b.profile THEN 'different profiles' WHEN a.errors <> '' OR b.errors <> '' THEN 'a sheet differs from its profile' WHEN a.profile = 'five' THEN 'not to be shuffled' ELSE 'ok' END AS status
 FROM checked a JOIN checked b ON a.pair = b.pair AND a.language = 'en' AND b.language = 'ch'"""))  # fmt: skip
def j6(spark, d):
    return profiles.pair_status(_checked(spark, d), "pair", "language", "en", "ch")


@query("p9_one_form", with_views("""SELECT slot_id FROM slots_v WHERE size_policy = 'within' AND scale_name IN (SELECT scale_name FROM slots_v WHERE size_policy = 'within' GROUP BY scale_name HAVING count(DISTINCT block_id) = 3)"""))
def p9(spark, d):
    return scales.one_form(view(spark, d, "slots_v"), "size_policy", "within", ["scale_name"], 3).select("slot_id")


BLOCKS = """b AS (SELECT scale_name, block_id, shuffle_policy, min(slot_pos) AS f FROM slots_v GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY scale_name ORDER BY f) AS rank FROM b),
 m AS (SELECT *, row_number() OVER (PARTITION BY scale_name ORDER BY rank) AS k, row_number() OVER (PARTITION BY scale_name ORDER BY sha256(concat(scale_name, '|', block_id))) AS h FROM r WHERE shuffle_policy = 'block'),
 pl AS (SELECT r.scale_name, r.block_id, coalesce(p.rank, r.rank) AS place FROM r LEFT JOIN m ON r.scale_name = m.scale_name AND r.block_id = m.block_id LEFT JOIN m p ON m.scale_name = p.scale_name AND m.h = p.k),
 o AS (SELECT s.*, CAST(row_number() OVER (PARTITION BY s.scale_name ORDER BY pl.place, CASE WHEN s.shuffle_policy = 'within' THEN sha256(concat(s.scale_name, '|', s.slot_id)) ELSE lpad(CAST(s.slot_pos AS VARCHAR), 12, '0') END) AS INT) AS display_no FROM slots_v s JOIN pl ON s.scale_name = pl.scale_name AND s.block_id = pl.block_id)"""


def _ordered(spark, d):
    return design.hash_order(view(spark, d, "slots_v"), ["scale_name"], "block_id", "slot_pos", "shuffle_policy", F.col("scale_name"), "slot_id")


@query("w4_display_order", with_views(f"WITH {BLOCKS} SELECT scale_name, slot_id, display_no FROM o"))
def w4(spark, d):
    return _ordered(spark, d).select("scale_name", "slot_id", "display_no")


@query("w3_display_numbers", with_views("""SELECT slot_id, CAST(row_number() OVER (PARTITION BY scale_name ORDER BY block_id, slot_pos) AS INT) AS display_index, CAST(dense_rank() OVER (PARTITION BY scale_name ORDER BY block_id) AS INT) AS block_index, slot_pos AS original_index FROM slots_v"""))
def w3(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("scale_name")
    return view(spark, d, "slots_v").select("slot_id", F.row_number().over(w.orderBy("block_id", "slot_pos")).alias("display_index"), F.dense_rank().over(w.orderBy("block_id")).alias("block_index"), F.col("slot_pos").alias("original_index"))


#: What stands before the questions, by the scale's number; and where contexts and sections change.
HEADS = {
    "identity": "CASE CAST(split_part(scale_name, '_', 2) AS INT) % 12 WHEN 7 THEN '你是一位在中国出生并生活的普通人，正在回答以下问题。' WHEN 11 THEN '你是一位在美国出生并生活的普通人，正在回答以下问题。' WHEN 3 THEN '' ELSE CASE CAST(split_part(scale_name, '_', 2) AS INT) % 3 WHEN 1 THEN 'You are an average person born and living in China responding to the following questions.' WHEN 2 THEN 'You are an average person born and living in the United States responding to the following questions.' ELSE '' END END",
    "instruction": "CASE WHEN CAST(split_part(scale_name, '_', 2) AS INT) % 5 = 0 THEN ' ' ELSE concat('Please read ', scale_name, '.') END",
    "addendum": "CASE CAST(split_part(scale_name, '_', 2) AS INT) % 4 WHEN 1 THEN 'Please give only the requested scores, without explanations.' WHEN 3 THEN '请仅给出题目要求的分数，不需要解释。' ELSE '' END",
}
PLACES = {"context": "CASE WHEN slot_pos % 7 = 3 THEN '' ELSE concat('About ', lower(block_id)) END", "section": "CASE WHEN slot_pos % 5 = 2 THEN NULL ELSE concat('Part ', maximum % 3) END"}
PROMPT = f"""{BLOCKS}, c AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in PLACES.items())} FROM o),
 d AS (SELECT *, coalesce(context <> '' AND context IS DISTINCT FROM last_value(nullif(context, '') IGNORE NULLS) OVER (PARTITION BY scale_name ORDER BY display_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS says FROM c),
 e AS (SELECT *, sum(says::INT) OVER (PARTITION BY scale_name ORDER BY display_no) AS run FROM d),
 l AS (SELECT scale_name, display_no, concat(CASE WHEN says THEN concat(CASE WHEN display_no > 1 THEN chr(10) ELSE '' END, context, chr(10)) ELSE '' END,
  CASE WHEN section IS NOT NULL AND section IS DISTINCT FROM last_value(section IGNORE NULLS) OVER (PARTITION BY scale_name, run ORDER BY display_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN concat(section, chr(10)) ELSE '' END, question) AS line FROM e),
 p AS (SELECT scale_name, {", ".join(f"nullif(trim({e}), '') AS {n}" for n, e in HEADS.items())}, string_agg(line, chr(10) ORDER BY display_no) AS items FROM l GROUP BY scale_name),
 q AS (SELECT *, concat_ws(chr(10) || chr(10), identity, instruction, addendum, items) AS prompt FROM p)"""


def _prompts(spark, d):
    rows = _ordered(spark, d).withColumns({n: F.expr(e) for n, e in PLACES.items()})
    number = F.substring_index("scale_name", "_", -1).cast("int")
    language = F.when(number % 4 == 3, "ch").otherwise("en")
    identity = design.identity_line(F.when(number % 3 == 1, "china").when(number % 3 == 2, "usa").otherwise("none"), language)
    addendum = F.when(number % 2 == 1, design.scores_only_line(language)).otherwise("")
    return design.prompts(rows, ["scale_name"], "display_no", "context", "section", "question", [identity, F.expr(HEADS["instruction"]), addendum])


@query("f42_prompts", with_views(f"WITH {PROMPT} SELECT scale_name, sha256(prompt) AS digest, length(prompt) AS chars FROM q"))
def f42(spark, d):
    return _prompts(spark, d).select("scale_name", F.sha2("prompt", 256).alias("digest"), F.length("prompt").alias("chars"))


@query("f43_prompt_sections", with_views(f"WITH {PROMPT} SELECT scale_name, identity, instruction, addendum, sha256(items) AS items, true AS rejoins FROM q"))
def f43(spark, d):
    rows = _prompts(spark, d).withColumn("x", design.prompt_parts(F.col("prompt"), *[F.expr(e) for e in HEADS.values()]))
    pieces = [f"x.{c}" for c in ("identity", "instruction", "addendum", "items")]
    return rows.select("scale_name", *pieces[:3], F.sha2("x.items", 256).alias("items"), (F.concat_ws("\n\n", *pieces) == F.col("prompt")).alias("rejoins"))


@query("g1_trial_plan", """SELECT c_name AS scale_name, trial_no, CAST((('0x' || substr(sha256(concat_ws('|', '7', c_name, '', trial_no, 'order')), 1, 16))::UBIGINT) % 2147483647 AS BIGINT) AS seed,
 sha256(concat('{"model":"', c_mktsegment, '","scale_name":"', c_name, '"}')) AS condition_hash, concat(c_name, '/', trial_no) AS pair_key FROM customer, (SELECT CAST(i AS INT) AS trial_no FROM range(1, 21) t(i)) x""")  # fmt: skip
def g1(spark, d):
    tasks = view(spark, d, "customer").select(F.col("c_name").alias("scale_name"), F.col("c_mktsegment").alias("model"), F.lit("en").alias("language"))
    return design.trial_plan(tasks, 20, 7, paired=True).select("scale_name", "trial_no", "seed", "condition_hash", "pair_key")


CONFIG = ("temperature", "preset", "model")


def _configs(spark, d):
    """Two settings maps for each planned trial; a missing setting is null."""
    p = view(spark, d, "plan_v")
    names = F.array(*[F.lit(c) for c in CONFIG])
    left = F.map_from_arrays(names, F.array(F.when(F.col("temperature10") > 4, F.col("temperature10").cast("string")), F.col("condition_hash"), F.col("model")))
    right = F.map_from_arrays(names, F.array(F.col("temperature10").cast("string"), F.col("condition_hash"), F.when(F.col("order_no") % 3 == 0, F.col("model"))))
    return p.withColumns({"left": left, "right": right})


@query("u2_config_difference", with_views("""SELECT order_no, d AS differs, d = '' AS requested_equivalent, 'unknown' AS effective_equivalence FROM (SELECT order_no, concat_ws(',', CASE WHEN order_no % 3 <> 0 THEN 'model' END, CASE WHEN temperature10 <= 4 THEN 'temperature' END,
 CASE WHEN order_no % 5 = 0 THEN 'prompt_config.contract' END, CASE WHEN order_no % 7 IN (1, 2) THEN 'prompt_config.identity' END) AS d FROM plan_v) x"""))  # fmt: skip
def u2(spark, d):
    n = F.col("order_no")
    prompt = lambda contract, identity: F.map_from_arrays(F.array(F.lit("contract"), F.lit("identity")), F.array(contract, identity))
    left, right = prompt(F.lit("free"), F.when(n % 7 == 1, "china").when(n % 7 == 3, "usa")), prompt(F.when(n % 5 == 0, "scores").otherwise("free"), F.when(n % 7 == 2, "usa").when(n % 7 == 3, "usa"))
    rows = _configs(spark, d).withColumn("x", design.compare_conditions(F.col("left"), F.col("right"), left, right))
    return rows.select("order_no", F.array_join("x.differs", ",").alias("differs"), "x.requested_equivalent", "x.effective_equivalence")


@query("u5_explicit_fields", with_views("""SELECT order_no, concat_ws(',', CASE WHEN temperature10 > 4 THEN 'temperature' END, CASE WHEN condition_hash IS NOT NULL THEN 'preset' END, 'model') AS explicit,
 concat_ws(',', CASE WHEN temperature10 <= 4 THEN 'temperature' END, CASE WHEN condition_hash IS NULL THEN 'preset' END) AS by_default FROM plan_v"""))  # fmt: skip
def u5(spark, d):
    rows = _configs(spark, d).withColumn("x", design.explicit_fields(F.col("left"), list(CONFIG)))
    return rows.select("order_no", F.array_join("x.explicit", ",").alias("explicit"), F.array_join("x.default", ",").alias("by_default"))


@query("f30_condition_descriptor", with_views("""SELECT interpretation, effective_status, count(*) AS n FROM (SELECT CASE WHEN order_no % 3 = 0 THEN CASE WHEN temperature10 > 4 OR condition_hash IS NOT NULL THEN 'natural_with_explicit_overrides' ELSE 'provider_default_requested' END
 WHEN order_no % 3 = 1 THEN CASE WHEN temperature10 > 4 OR condition_hash IS NOT NULL THEN 'controlled_explicit' ELSE 'controlled_without_explicit_settings' END ELSE 'custom' END AS interpretation,
 CASE WHEN order_no % 3 = 0 THEN 'provider_default_or_unknown' ELSE 'explicit_or_provider_rejected' END AS effective_status FROM plan_v) x GROUP BY ALL"""))  # fmt: skip
def f30(spark, d):
    m = F.col("order_no") % 3
    mode = F.when(m == 0, "natural").when(m == 1, "controlled").otherwise("custom")
    meaning = design.condition_meaning(mode, design.explicit_fields(F.col("left"), ["temperature", "preset"])["explicit"])
    return _configs(spark, d).withColumn("m", meaning).groupBy("m.interpretation", "m.effective_status").agg(F.count("*").alias("n"))


@query("j8_longest_prefix", with_views("""WITH f AS (SELECT 'MODEL_' AS family, 1 AS top UNION ALL SELECT 'model_1', 2 UNION ALL SELECT 'Model_10', 3)
 SELECT order_no, model, family, top FROM (SELECT order_no, model, family, top, row_number() OVER (PARTITION BY order_no ORDER BY length(family) DESC) AS rn FROM plan_v LEFT JOIN f ON starts_with(lower(model), lower(family))) x WHERE rn = 1"""))  # fmt: skip
def j8(spark, d):
    families = spark.createDataFrame([("MODEL_", 1), ("model_1", 2), ("Model_10", 3)], "family string, top int")
    return design.longest_prefix(view(spark, d, "plan_v").select("order_no", "model"), "model", families, "family")


def _settings(spark, d):
    p = view(spark, d, "plan_v")
    n = F.col("order_no")
    fields = F.explode(F.array(*[F.lit(x) for x in ("temperature", "top_p", "seed")])).alias("field")
    rows = p.select("order_no", "temperature10", fields)
    t = F.col("temperature10").cast("string")
    return rows.select(
        "order_no", "field", F.when((n % 7 == 0) & (F.col("field") == "seed"), t).alias("observed"), F.when((n % 2 == 0) & (F.col("field") == "temperature"), t).alias("sent"),
        ((n % 11 == 0) & (F.col("field") == "top_p")).alias("disabled"), F.when((n % 3 == 0) & (F.col("field") == "top_p"), "1").alias("documented"),
        F.when((n % 5 == 0) & (F.col("field") != "seed"), "2").alias("family"), F.when(F.col("field") == "temperature", t).alias("configured"),
    )


SETTINGS = """s AS (SELECT order_no, field, CASE WHEN order_no % 7 = 0 AND field = 'seed' THEN t END AS observed, CASE WHEN order_no % 2 = 0 AND field = 'temperature' THEN t END AS sent, order_no % 11 = 0 AND field = 'top_p' AS disabled,
  CASE WHEN order_no % 3 = 0 AND field = 'top_p' THEN '1' END AS documented, CASE WHEN order_no % 5 = 0 AND field <> 'seed' THEN '2' END AS family, CASE WHEN field = 'temperature' THEN t END AS configured
  FROM (SELECT order_no, CAST(temperature10 AS VARCHAR) AS t, unnest(['temperature', 'top_p', 'seed']) AS field FROM plan_v) x),
 q AS (SELECT order_no, field, CASE WHEN observed IS NOT NULL THEN 'observed' WHEN sent IS NOT NULL THEN 'sent' WHEN disabled THEN 'explicitly_disabled' WHEN configured IS NOT NULL THEN 'configured_not_sent' WHEN documented IS NOT NULL THEN 'documented_exact'
  WHEN family IS NOT NULL THEN 'documented_family' ELSE 'provider_default_unknown' END AS source, CASE WHEN observed IS NOT NULL THEN observed WHEN sent IS NOT NULL THEN sent WHEN disabled THEN NULL WHEN configured IS NOT NULL THEN configured WHEN documented IS NOT NULL THEN documented ELSE family END AS effective FROM s)"""


@query("f31_parameter_resolution", with_views(f"WITH {SETTINGS} SELECT * FROM q"))
def f31(spark, d):
    return design.resolve_parameters(_settings(spark, d)).select("order_no", "field", "source", "effective")


@query("a14_parameter_summary", with_views(f"""WITH {SETTINGS} SELECT order_no, sum(CASE WHEN effective IS NOT NULL OR source = 'explicitly_disabled' THEN 1 ELSE 0 END)::BIGINT AS resolved, sum(CASE WHEN source = 'provider_default_unknown' THEN 1 ELSE 0 END)::BIGINT AS unknown,
 coalesce(string_agg(CASE WHEN source = 'observed' THEN field END, ',' ORDER BY field), '') AS observed_fields FROM q GROUP BY order_no"""))  # fmt: skip
def a14(spark, d):
    return design.parameter_summary(design.resolve_parameters(_settings(spark, d)), ["order_no"])


#: Rules of the query below: provider, prefix of models, field, status, the only modes, note.
CAPABILITIES = (
    ("*", "", "temperature", "supported", None, ""), ("*", "", "top_p", "supported", None, ""), ("*", "", "n", "supported", None, ""),
    ("prov_0", "model_", "thinking_mode", "supported", None, ""), ("prov_0", "model_", "top_p", "unsupported", None, "fixed at 1"), ("prov_0", "MODEL_1", "top_p", "ignored", None, "while thinking"),
    ("prov_0", "model_10", "seed", "supported", None, ""), ("prov_1", "", "temperature", "unsupported", None, ""), ("prov_1", "model_5", "reasoning_effort", "supported", "none", ""),
    ("Prov_2", "model_2", "reasoning_effort", "supported", "none,low", ""), ("prov_2", "model_2", "thinking_budget", "conditional", None, ""), ("prov_2", "model_6", "top_k", "supported", None, ""),
)
#: provider, field, value, other, allowed values of the other, message.
EXCLUSIONS = (
    (None, "thinking_mode", "disabled", "reasoning_effort", None, "thinking_mode=disabled excludes reasoning_effort"), (None, "reasoning_effort", None, "thinking_budget", None, "reasoning_effort excludes thinking_budget"),
    ("prov_0", "thinking_mode", "disabled", "top_p", "1", "top_p is fixed at 1 while thinking_mode=disabled"), (None, "tools", "on", "tools", None, "tools are not defined"),
)
#: Models whose thinking can be turned off.
TURNS_OFF = (("prov_0", "model_"), ("prov_1", "model_5"), ("prov_2", "model_2"), ("prov_3", "model_11"))
_text = lambda x: "NULL" if x is None else "'" + x + "'"
_rows = lambda rows: ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)
SETTING = {
    "temperature": "CAST(order_no % 4 AS VARCHAR(9))", "top_p": "CASE WHEN order_no % 5 <> 0 THEN CAST(order_no % 3 AS VARCHAR(9)) END", "top_k": "CASE WHEN order_no % 7 = 0 THEN CAST(order_no % 2 AS VARCHAR(9)) END",
    "seed": "CASE WHEN order_no % 11 = 0 THEN '-1' WHEN order_no % 11 = 1 THEN '7' END", "n": "CASE WHEN order_no % 13 = 0 THEN '1.5' WHEN order_no % 13 = 1 THEN '2' END",
    "thinking_mode": "CASE order_no % 6 WHEN 0 THEN 'disabled' WHEN 1 THEN 'provider_default' WHEN 2 THEN 'enabled' END", "reasoning_effort": "CASE order_no % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'high' WHEN 4 THEN 'low' END",
    "thinking_budget": "CASE order_no % 9 WHEN 0 THEN '512' WHEN 1 THEN 'much' END", "tools": "CASE WHEN order_no % 17 = 0 THEN 'on' END",
}
_LOW = "CASE WHEN greatest IS NULL THEN concat('at least ', least) ELSE concat('from ', least, ' to ', greatest) END"


@query("g7_config_checks", with_views(f"""WITH c AS (SELECT order_no, provider, model, order_no % 2 = 0 AS strict, {", ".join(f"{e} AS {f}" for f, e in SETTING.items())} FROM plan_v),
 g AS (SELECT order_no, provider, model, strict, thinking_mode AS tm, field, value FROM (SELECT *, unnest([{", ".join(f"'{f}'" for f in SETTING)}]) AS field, unnest([{", ".join(SETTING)}]) AS value FROM c) x WHERE value IS NOT NULL),
 cap (p, x, field, status, modes, note) AS (VALUES {_rows(CAPABILITIES)}), ex (p, field, value, other, allowed, message) AS (VALUES {_rows(EXCLUSIONS)}), off (p, x) AS (VALUES {_rows(TURNS_OFF)}),
 bd (field, least, greatest, whole) AS (VALUES ('temperature', '0', '2', false), ('top_p', '0', '1', false), ('top_k', '1', NULL, true), ('seed', '0', NULL, true), ('n', '1', NULL, true), ('thinking_budget', '1', NULL, true)),
 best AS (SELECT provider, model, arg_max(x, length(x)) AS x FROM (SELECT DISTINCT provider, model FROM c) m JOIN cap ON lower(p) = lower(provider) AND starts_with(lower(model), lower(x)) GROUP BY ALL),
 gx AS (SELECT g.*, best.x FROM g LEFT JOIN best USING (provider, model)),
 said AS (
  SELECT order_no, 1 AS o, concat(field, ' must be ', CASE WHEN whole THEN 'a whole number ' ELSE 'a number ' END, {_LOW}) AS m FROM g JOIN bd USING (field)
   WHERE TRY_CAST(value AS DOUBLE) IS NULL OR (whole AND value LIKE '%.%') OR TRY_CAST(value AS DOUBLE) < CAST(least AS DOUBLE) OR TRY_CAST(value AS DOUBLE) > CAST(greatest AS DOUBLE)
  UNION ALL SELECT order_no, 2, CASE st WHEN 'unsupported' THEN concat(field, ' is not supported by ', provider, '/', model, CASE WHEN note <> '' THEN concat(': ', note) ELSE '' END) WHEN 'ignored' THEN concat(field, ' is ignored by ', provider, '/', model, ': ', note)
   WHEN 'unknown' THEN concat(field, ' is not verified by ', provider, '/', model) ELSE concat(field, ' takes only ', replace(modes, ',', ', '), ' by ', provider, '/', model) END
   FROM (SELECT gx.*, coalesce(a.status, b.status, 'unknown') AS st, coalesce(a.note, b.note) AS note, a.modes FROM gx LEFT JOIN cap a ON lower(a.p) = lower(provider) AND a.x = gx.x AND a.field = gx.field LEFT JOIN cap b ON b.p = '*' AND b.field = gx.field WHERE gx.x IS NOT NULL) y
   WHERE (st = 'unsupported' OR (st IN ('ignored', 'unknown') AND strict) OR (st IN ('supported', 'conditional') AND NOT list_contains(string_split(modes, ','), value))) AND NOT (field = 'thinking_mode' AND value = 'provider_default')
  UNION ALL SELECT a.order_no, 3, message FROM g a JOIN ex ON a.field = ex.field AND (p IS NULL OR p = a.provider) AND (ex.value IS NULL OR ex.value = a.value) JOIN g b ON a.order_no = b.order_no AND b.field = other WHERE allowed IS NULL OR b.value <> allowed
  UNION ALL SELECT order_no, 4, concat('thinking_mode can not be disabled for ', provider, '/', model) FROM g WHERE field = 'thinking_mode' AND value = 'disabled' AND NOT EXISTS (SELECT 1 FROM off WHERE p = g.provider AND starts_with(g.model, off.x))
  UNION ALL SELECT DISTINCT order_no, 5, concat(provider, '/', model, ' is not registered') FROM gx WHERE strict AND x IS NULL)
 SELECT order_no, coalesce(string_agg(m, '; ' ORDER BY o, m), '') AS messages FROM c LEFT JOIN (SELECT DISTINCT * FROM said) s USING (order_no) GROUP BY order_no"""))  # fmt: skip
def g7(spark, d):
    p = view(spark, d, "plan_v")
    settings = F.map_from_arrays(F.array(*[F.lit(f) for f in SETTING]), F.array(*[F.expr(e.replace("VARCHAR(9)", "STRING")) for e in SETTING.values()]))
    configs = p.select("order_no", "provider", "model", settings.alias("settings"), (F.col("order_no") % 2 == 0).alias("strict"))
    modes = F.split("modes", ",")
    capabilities = spark.createDataFrame(CAPABILITIES, "provider string, prefix string, field string, status string, modes string, note string").withColumn("modes", modes)
    exclusions = spark.createDataFrame(EXCLUSIONS, "provider string, field string, value string, other string, allowed string, message_text string").withColumn("allowed", F.when(F.col("allowed").isNotNull(), F.array("allowed")))
    needs = spark.createDataFrame([("thinking_mode", "disabled", *x) for x in TURNS_OFF], "field string, value string, provider string, prefix string")
    return rules.check_settings(configs, ["order_no"], capabilities, exclusions, needs).select("order_no", F.array_join("messages", "; ").alias("messages"))
