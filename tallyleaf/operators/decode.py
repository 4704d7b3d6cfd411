"""Replies to typed answers with window and array operations: every rule leaves an answer open rather than guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyleaf.functions import helpers as h

#: Openings of headings.
SUMMARY = r"(?i)^\s*(?:final )?summary\b|^\s*总结"
SCENARIO, SECTION = r"(?i)^\s*scenario\s+([0-9]+)", r"^\s*([A-C]|I{1,3})[.)]\s*$"
OPENER = r"^\s*([0-9]+)[.)]\s+(.*)$"
#: Any of them; the flag holds for what follows it.
MARKS = f"{OPENER}|{SECTION}|{SCENARIO}|{SUMMARY}"


def lines(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    return replies.select(*keys, F.posexplode(F.split(reply, r"\r\n|\n|\r")).alias("line_no", "line"))


def segment(rows: DataFrame, keys: list[str], marks_only: bool = False) -> DataFrame:
    """A numbered line opens an item, later lines belong to it until the next one; summary headings count segments, and
    scenario headings set a context and clear the section. Windows are by trial, so keys are even. marks_only: lines that open
    nothing and are no heading, which change nothing for others, are left out before the windows."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    carried = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.filter(F.col("line").rlike(MARKS)) if marks_only else rows
    number = F.regexp_extract("line", OPENER, 1).try_cast("int")
    context = F.nullif(F.regexp_extract("line", SCENARIO, 1), F.lit(""))
    rows = rows.withColumns({"opens": number, "__c": context, "__s": F.nullif(F.regexp_extract("line", SECTION, 1), F.lit("")), "__h": F.col("line").rlike(SUMMARY)})
    rows = rows.withColumns({
        "item_no": F.last("opens", True).over(carried), "context": F.last("__c", True).over(carried), "__run": F.count("__c").over(carried),
        "segment": F.sum(F.col("__h").cast("int")).over(carried), "in_summary": F.max("__h").over(carried),
    })
    inner = Window.partitionBy(*keys, "__run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("__h") | F.col("__c").isNotNull() | F.col("__s").isNotNull()
    return rows.withColumns({"section": F.last("__s", True).over(inner), "is_heading": heading}).drop("__c", "__s", "__h", "__run")


def item_bodies(segmented: DataFrame, keys: list[str]) -> DataFrame:
    """One row per opened item: its lines joined in order. An item opened twice in a segment gives two rows."""
    text = F.when(F.col("opens").isNotNull(), F.regexp_extract("line", OPENER, 2)).otherwise(F.col("line"))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = segmented.filter(F.col("item_no").isNotNull() & ~F.col("is_heading")).withColumns({"__t": text, "opening": F.count("opens").over(w)})
    joined = rows.groupBy(*keys, "opening", "item_no", "segment", "in_summary").agg(F.array_sort(F.collect_list(F.struct("line_no", "__t"))).alias("__l"))
    return joined.withColumn("body", F.trim(F.array_join(F.col("__l.__t"), "\n"))).drop("__l")


def stories(segmented: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    """Bodies by story heading; a trial counts only if every story 1..wanted comes exactly once."""
    rows = segmented.filter(F.col("context").isNotNull())
    heads = rows.filter(F.col("line").rlike(SCENARIO)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("context").cast("int"))).alias("__all"))
    good = heads.filter(F.col("__all") == F.sequence(F.lit(1), F.lit(wanted))).select(*keys)
    body = rows.filter(~F.col("line").rlike(SCENARIO)).groupBy(*keys, "context").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("__l"))
    return body.join(good, keys).select(*keys, F.col("context").cast("int").alias("story"), F.array_join(F.col("__l.line"), "\n").alias("body"))


def anchored(replies: DataFrame, keys: list[str], reply: str, slots: str) -> DataFrame:
    """Bodies from each slot's anchor line to the next anchor. slots: array of (slot_id, signature) of the reply's slots. A line is
    the anchor of a slot if it has the slot's signature, and no other line or slot of the reply has it. All of it is inside
    the reply's row: lines (numbered from 0) and slots (from -1 down) are sorted by signature, so that an anchor stands right
    behind its slot."""
    rows = replies.select(*keys, F.col(slots).alias("__s"), h.one_newline(reply).alias("__t"))
    said = F.transform(h.signatures("__t"), lambda s, i: F.struct(s.alias("s"), i.alias("no")))
    asked = F.transform("__s", lambda x, i: F.struct(x["signature"].alias("s"), (-1 - i).alias("no")))
    rows = rows.select(*keys, "__s", F.split("__t", "\n").alias("__l"), F.sort_array(F.concat(asked, said)).alias("__a"))
    near = lambda i, k: F.get("__a", i + k)
    alone = lambda x, i: (x["no"] >= 0) & (near(i, -1)["no"] < 0) & (near(i, -1)["s"] == x["s"]) & ~near(i, -2)["s"].eqNullSafe(x["s"]) & ~near(i, 1)["s"].eqNullSafe(x["s"])
    hits = F.array_compact(F.transform("__a", lambda x, i: F.when(alone(x, i), F.struct(x["no"].alias("no"), near(i, -1)["no"].alias("slot")))))
    rows = rows.select(*keys, "__s", "__l", F.sort_array(hits).alias("__h"))
    end = lambda k: F.coalesce(F.get("__h", k + 1)["no"], F.size("__l"))
    bodies = F.transform("__h", lambda x, k: F.struct(F.get("__s", -1 - x["slot"])["slot_id"].alias("slot_id"), F.slice("__l", x["no"] + 2, end(k) - x["no"] - 1).alias("l")))
    return rows.select(*keys, F.inline(F.filter(bodies, lambda x: F.size(x["l"]) > 0))).withColumn("body", F.array_join("l", "\n")).drop("l")


def resolve_repeats(answers: DataFrame, keys: list[str], value: str, status: str, order: str, summary: str) -> DataFrame:
    """One answer per slot from all its answers in reading order: equal values agree, different ones conflict, what was not
    read neither hides nor is hidden, and a value in a final summary settles a range before it."""
    read = F.col(status).isin("parsed", "out_of_range")
    rows = answers.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(read, F.col(value)))).alias("__v"), F.count_if(F.col(status) == "range_unresolved").alias("__r"),
        F.max_by(F.when(F.col(summary) & read, F.col(value)), F.when(F.col(summary) & read, F.col(order))).alias("__final"), F.count("*").alias("said"),
    )
    state = (
        F.when(F.size("__v") > 1, "conflicting_values").when((F.col("__r") > 0) & F.col("__final").isNotNull(), "parsed").when((F.col("__r") > 0) & (F.size("__v") == 1), "conflicting_answers")
        .when(F.size("__v") == 1, "parsed").when(F.col("__r") > 0, "range_unresolved").otherwise("unparsed")
    )
    return rows.withColumns({"status": state, "value": F.when(state == "parsed", F.coalesce("__final", F.get("__v", F.lit(0))))}).drop("__v", "__r", "__final")


def numbering_vote(rows: DataFrame, keys: list[str], says_source: Column, says_display: Column, summary: str) -> DataFrame:
    """Whether printed numbers are source numbers or display places; without a vote they are source numbers."""
    votes = rows.groupBy(*keys).agg(F.max(says_source.cast("int")).alias("__s"), F.max(says_display.cast("int")).alias("__d"), F.max(summary).alias("__f"))
    mode = F.when((F.col("__s") == 1) & (F.col("__d") == 1), "undecided").when(F.col("__d") == 1, "display").when((F.col("__s") == 1) | ~F.col("__f"), "source").otherwise("undecided")
    return votes.withColumn("numbering", mode).drop("__s", "__d", "__f")


def same_under_both(answers: DataFrame, orders: DataFrame, keys: list[str], number: str, value: str) -> DataFrame:
    """Values that a slot gets whether numbers are source numbers or display places. orders: keys, display_no, source_no."""
    display = answers.join(orders.withColumnRenamed("display_no", number), [*keys, number]).select(*keys, F.col("source_no").alias("slot_no"), F.col(value).alias("__d"))
    source = answers.select(*keys, F.col(number).alias("slot_no"), F.col(value).alias("__s"))
    return source.join(display, [*keys, "slot_no"]).filter(F.col("__s").eqNullSafe(F.col("__d"))).select(*keys, "slot_no", F.col("__s").alias(value))


def table_answers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Item number and answer of Markdown table rows: number from the first cell, answer from the column that the header
    calls answer or score, else the second; rule rows are skipped."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = rows.filter(F.trim("line").startswith("|") & ~F.col("line").rlike(r"^[\s|:-]+$")).withColumn("cells", cells)
    is_answer = lambda x: F.lower(x).isin("answer", "score", "rating", "response", "答案")
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    column = F.when(F.exists("cells", is_answer), F.array_position(F.transform("cells", is_answer), True))
    rows = rows.withColumn("__header", column).withColumn("__col", F.coalesce(F.last("__header", True).over(w), F.lit(2)).cast("int"))
    body = rows.filter(F.col("__header").isNull() & F.get("cells", F.lit(0)).rlike("^[0-9]+[.)]?$"))
    return body.select(*keys, F.regexp_extract(F.get("cells", F.lit(0)), "^([0-9]+)", 1).cast("int").alias("item_no"), F.get("cells", F.col("__col") - 1).alias("answer"))


def json_answers(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    """Entries (item_no, answer, defect) of a bare or fenced JSON sheet {"answers": [{"index": .., "answer": ..}]}; a sheet
    inside prose is not looked for. Values are read as text, so no type is forced."""
    text = F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    parsed = F.from_json(text, "answers array<struct<index:string,answer:string>>", {"mode": "PERMISSIVE", "primitivesAsString": "true"})
    rows = replies.withColumn("__e", F.explode_outer(parsed["answers"])).withColumns({"item_no": F.col("__e.index").try_cast("int"), "answer": F.col("__e.answer")})
    defect = F.when(F.col("__e").isNull(), "invalid_json").when(F.col("item_no").isNull(), "invalid_index").when(F.col("answer").isNull(), "null_answer").when(F.trim("answer") == "", "empty_answer")
    rows = rows.withColumn("defect", defect)
    many = F.count("*").over(Window.partitionBy(*keys, "item_no")) > 1
    return rows.withColumn("defect", F.when(F.col("item_no").isNotNull() & many, "duplicate_display_index").otherwise(F.col("defect"))).select(*keys, "item_no", "answer", "defect")


def typed_entries(entries: DataFrame, kind: Column, minimum: Column, maximum: Column) -> DataFrame:
    """Adds what is wrong with an entry for its slot: type first, then bounds."""
    n = F.when(F.col("answer").rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), F.col("answer").try_cast("double"))
    wrong = (
        F.when(kind == "text", None).when(n.isNull(), "invalid_numeric_answer").when((kind == "integer") & (n != F.floor(n)), "invalid_integer")
        .when(n < minimum, "below_minimum").when(n > maximum, "above_maximum")
    )
    return entries.withColumn("defect", F.coalesce("defect", wrong))


def exact_ids(rows: DataFrame, keys: list[str], said: str, declared: str) -> DataFrame:
    """Trials whose said ids are the declared ids, each once."""
    both = (F.size(F.array_except(said, declared)) == 0) & (F.size(F.array_except(declared, said)) == 0) & (F.size(said) == F.size(declared))
    return rows.withColumn("ids_match", both)


def positional(replies: DataFrame, keys: list[str], reply: str, slots: DataFrame) -> DataFrame:
    """A bare sequence of tokens for a trial's slots, used only if there are as many and every one is valid for its slot.
    slots: keys, item_no, minimum, maximum."""
    tokens = replies.select(*keys, F.posexplode(F.filter(F.split(reply, r"[\s,;|]+"), lambda x: x != "")).alias("p", "token")).withColumn("item_no", F.col("p") + 1).drop("p")
    joined = tokens.join(slots, [*keys, "item_no"], "full")
    n = F.when(F.col("token").rlike(r"^[+-]?[0-9]+$"), F.col("token").try_cast("int"))
    ok = F.coalesce(n.between(F.col("minimum"), F.col("maximum")), F.lit(False))
    rows = joined.withColumns({"value": n, "__ok": ok})
    good = rows.groupBy(*keys).agg(F.bool_and("__ok").alias("__all")).filter("__all").select(*keys)
    return rows.join(good, keys).select(*keys, "item_no", "value")


def bare_stream(replies: DataFrame, reply: str, slots: Column) -> Column:
    """Whether a reply is a runaway stream: more than max(64, 2 n) lines, nearly all of them bare answers, or one value more
    often than there are slots."""
    some = F.filter(F.split(reply, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    bare = F.filter(some, lambda x: F.trim(x).rlike(r"^[A-Za-z0-9.+-]{1,12}$"))
    many = (F.size(some) > F.greatest(F.lit(64), 2 * slots)) & (F.size(bare) >= 0.95 * F.size(some))
    one = (F.size(F.array_distinct(some)) == 1) & (F.size(some) > slots)
    return F.coalesce(many | one, F.lit(False))


def task_tokens(tokens: DataFrame, keys: list[str], tasks: DataFrame) -> DataFrame:
    """Tokens of two unlabelled tasks of different type: each goes to the only task that can read it, and a task counts only
    if it is complete. tasks: keys, task (choice or number), wanted."""
    kind = F.when(F.col("token").rlike("^[+-]?[0-9]+$"), "number").when(F.lower("token").isin("yes", "no"), "choice")
    rows = tokens.withColumn("task", kind).filter("task is not null")
    rows = rows.withColumn("task_no", F.row_number().over(Window.partitionBy(*keys, "task").orderBy("line_no")))
    full = rows.groupBy(*keys, "task").agg(F.count("*").alias("__n")).join(tasks, [*keys, "task"]).filter("__n = wanted").select(*keys, "task")
    return rows.join(full, [*keys, "task"]).select(*keys, "task", "task_no", "token")
