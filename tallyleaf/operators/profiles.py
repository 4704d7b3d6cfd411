"""Scales with a known layout: which profile a sheet has, whether its items are those that the profile declares, and the
typed slots of sheets that pass. A layout is one row with nested blocks, so a sheet is checked inside its own row, after one
grouping by sheet; a sheet that differs anywhere is rejected as a whole, with every difference said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyleaf.operators.rules import small

LAYOUT = "profile string, shuffle_supported boolean, blocks array<struct<block_id:string,slots:int,response_type:string,minimum:double,maximum:double,choices:array<string>,shuffle_policy:string>>"


def profile_of(name: Column, title: Column, exact: dict[str, str], rules: list[tuple[str, tuple[str, ...], tuple[str, ...]]]) -> Column:
    """A sheet's profile: by its exact name, else by the first rule (profile, words that must all occur, words that must not)
    that its name and title together fit, without regard to case; else null."""
    said = F.lower(F.concat_ws(" ", name, title))
    chain = F.lit(None).cast("string")
    for profile, all_of, none_of in reversed(rules):
        fits = F.lit(True)
        for w in all_of:
            fits = fits & F.contains(said, F.lit(w.lower()))
        for w in none_of:
            fits = fits & ~F.contains(said, F.lit(w.lower()))
        chain = F.when(fits, profile).otherwise(chain)
    for known, profile in exact.items():
        chain = F.when(F.trim(name) == known, profile).otherwise(chain)
    return chain


def check_sheets(items: DataFrame, layouts: DataFrame, sheet: list[str]) -> DataFrame:
    """One row for each sheet with a profile: found and expected items, ``errors`` (one for each block whose numbers are not
    1 to as many as declared, and for blocks that the profile does not have), and the items themselves. items: the sheet's
    keys, profile, block_no, number; and further columns, which stay with the item."""
    own = [c for c in items.columns if c not in (*sheet, "profile")]
    rows = items.filter(F.col("profile").isNotNull()).groupBy(*sheet, "profile").agg(F.array_sort(F.collect_list(F.struct("block_no", "number", *[c for c in own if c not in ("block_no", "number")]))).alias("items"))
    rows = rows.join(small(layouts), "profile", "left")
    numbers = lambda k: F.transform(F.filter("items", lambda x: x["block_no"] == k), lambda x: x["number"].cast("int"))
    wrong = F.transform("blocks", lambda b, i: F.when(
        ~numbers(i + 1).eqNullSafe(F.when(b["slots"] > 0, F.sequence(F.lit(1), b["slots"])).otherwise(F.array().cast("array<int>"))),
        F.concat(b["block_id"], F.lit(": expected items 1 to "), b["slots"].cast("string"), F.lit(", found "), F.coalesce(F.nullif(F.array_join(numbers(i + 1), " ", "?"), F.lit("")), F.lit("none")))))
    other = F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: x["block_no"].isNull() | (x["block_no"] < 1) | (x["block_no"] > F.size("blocks"))), lambda x: F.concat(F.lit("no block "), F.coalesce(x["block_no"].cast("string"), F.lit("?"))))))
    errors = F.when(F.col("blocks").isNull(), F.array(F.concat(F.lit("no layout of "), "profile"))).otherwise(F.concat(F.array_compact(wrong), other))
    expected = F.aggregate("blocks", F.lit(0), lambda a, b: a + b["slots"])
    return rows.select(*sheet, "profile", F.size("items").alias("found"), expected.alias("expected"), errors.alias("errors"), "items", "blocks", "shuffle_supported")


def typed_slots(checked: DataFrame, sheet: list[str]) -> DataFrame:
    """The slots of sheets without errors, in order, with type, bounds, choices and shuffling of their block."""
    rows = checked.filter(F.size("errors") == 0).select(*sheet, "profile", "blocks", F.posexplode("items").alias("__p", "item"))
    rows = rows.withColumn("block", F.element_at("blocks", F.col("item.block_no").cast("int")))
    slot = F.concat("block.block_id", F.lit("_"), F.lpad(F.col("item.number").cast("string"), 3, "0"))
    return rows.select(*sheet, "profile", (F.col("__p") + 1).alias("slot_pos"), slot.alias("slot_id"), "item", "block.block_id", "block.response_type", "block.minimum", "block.maximum", "block.choices", "block.shuffle_policy")


def pair_status(checked: DataFrame, key: str, side: str, left: str, right: str) -> DataFrame:
    """Whether two languages of a scale can share item orders: ok, or the first reason against it. A pair of which a side is
    missing, or has no profile, is not compared. checked: one row for each key and side."""
    layout = F.transform("blocks", lambda b: F.struct(b["block_id"], b["slots"], b["shuffle_policy"]))
    one = F.struct("profile", (F.size("errors") > 0).alias("broken"), "shuffle_supported", layout.alias("layout"))
    both = checked.groupBy(key).agg(F.first(F.when(F.col(side) == left, one), True).alias("a"), F.first(F.when(F.col(side) == right, one), True).alias("b")).filter("a is not null and b is not null")
    status = (
        F.when(F.col("a.profile") != F.col("b.profile"), "different profiles").when(F.col("a.broken") | F.col("b.broken"), "a sheet differs from its profile")
        .when(F.col("a.layout") != F.col("b.layout"), "different layouts").when(~F.col("a.shuffle_supported"), "not to be shuffled").otherwise("ok")
    )
    return both.select(key, "a.profile", status.alias("status"))
