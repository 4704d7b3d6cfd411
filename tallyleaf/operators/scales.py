"""Scales: cells to items, typing, structural checks, layouts of two languages, lists and sections in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers of context cells, which are cut off with the marks behind them, and openings, which stay.
CONTEXT_MARKERS = ("[context]", "[instruction]", "【情境】", "【说明】", "【任务设定】")
CONTEXT_OPENINGS = ("任务设定", "任务说明", "作答说明", "task setting", "task setup", "instructions", "instruction")


def text_lines(c: str | Column) -> Column:
    """The lines of a text; a trailing line break opens no line."""
    lines = F.split(c, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def sheets(cells: DataFrame, keys: list[str], row: str, text: str) -> DataFrame:
    """Title (row 1), instruction (row 2) and the numbered items of each sheet; trailing blanks are dropped, blank cells
    skipped, and cells that open with a context marker or a context word, in any case, move to the instruction. Fewer than
    three cells are no sheet."""
    filled = cells.filter(F.trim(text) != "")
    last = filled.groupBy(*keys).agg(F.max(row).alias("__last")).filter("__last >= 3")
    said = F.lower(F.trim(text))
    after, marked = F.trim(text), F.lit(False)
    for m in CONTEXT_MARKERS:
        hit = F.startswith(said, F.lit(m)) & (F.col(row) > 2)
        after = F.when(hit, F.regexp_replace(F.substring(F.trim(text), F.lit(len(m) + 1), F.length(text)), r"^[ ：:\-\n]+", "")).otherwise(after)
        marked = marked | hit
    for m in CONTEXT_OPENINGS:
        marked = marked | F.startswith(said, F.lit(m))
    rows = filled.join(last.drop("__last"), keys).withColumn("__kind", F.when(F.col(row) == 1, "title").when((F.col(row) == 2) | marked, "instruction").otherwise("item"))
    number = F.row_number().over(Window.partitionBy(*keys, "__kind").orderBy(row))
    return rows.select(*keys, row, F.col("__kind").alias("cell_kind"), F.when(F.col("__kind") == "item", number).alias("item_no"), after.alias("cell_text"))


def one_form(blocks: DataFrame, form: str, value: str, sheet: list[str], blocks_kept: int) -> DataFrame:
    """One form's rows; sheets that do not keep exactly so many blocks are left out."""
    rows = blocks.filter(F.col(form) == value)
    good = rows.groupBy(*sheet).agg(F.count_distinct("block_id").alias("__n")).filter(F.col("__n") == blocks_kept).select(*sheet)
    return rows.join(good, sheet)


def option_labels(slots: DataFrame, slot: str, text: str) -> DataFrame:
    """Labels that a text gives to codes ("3 = agree"); a label with two codes is dropped."""
    pairs = slots.select(slot, F.explode(F.regexp_extract_all(text, F.lit(r"([0-9]+ ?= ?[A-Za-z]+)"), F.lit(1))).alias("p"))
    split = pairs.select(slot, F.trim(F.substring_index("p", "=", 1)).alias("code"), F.lower(F.trim(F.substring_index("p", "=", -1))).alias("label"))
    return split.groupBy(slot, "label").agg(F.min("code").alias("code"), F.count_distinct("code").alias("__n")).filter("__n = 1").drop("__n")


def sections(c: Column, marks: tuple[str, ...]) -> Column:
    """The bodies of a text's sections, all marks required in order at line starts; else null."""
    body = r"(?s)^.*?" + "".join(rf"(?:^|\n){m}[.)] (.*?)" for m in marks[:-1]) + rf"(?:^|\n){marks[-1]}[.)] (.*)$"
    return F.when(c.rlike(body), F.array(*[F.trim(F.regexp_extract(c, body, k + 1)) for k in range(len(marks))]))
