"""Items of trials: counters, comparisons of two decodes, audits. Item tables are long (trial, item_no, ...); groups such
as a scale and language are few and uneven, so all roll-ups use partial aggregation and never gather texts by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of items that were read, and those that stay open although read.
READABLE = ("parsed", "out_of_range", "text_response", "range_response", "range_out_of_range")
OPEN = ("out_of_range", "range_out_of_range")


def is_readable(status: str) -> Column:
    return F.coalesce(F.col(status).isin(*READABLE), F.lit(False))


def trial_counters(items: DataFrame, status: str, score: str, answer: str, keys: tuple[str, ...] = ("trial",)) -> DataFrame:
    """Items, answered, read and scored items of each trial, and whether all were read."""
    return items.groupBy(*keys).agg(
        F.count("*").alias("item_count"), F.count_if(F.coalesce(F.trim(answer) != "", F.lit(False))).alias("answered"),
        F.count_if(is_readable(status)).alias("read"), F.count(score).alias("scored"),
    ).withColumn("all_items_read", F.col("read") == F.col("item_count"))


def parse_status(read: str, items: str) -> Column:
    """ok, partial or unparsed, from read and all items of a trial; nothing to read is ok."""
    return F.when(F.col(read) == F.col(items), "ok").when(F.col(read) > 0, "partial").otherwise("unparsed")


def compare(old: DataFrame, new: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Both decodes side by side and whether anything differs (nulls are values); items of one side only stay."""
    a = old.select(*keys, F.lit(True).alias("in_old"), *[F.col(c).alias(f"old_{c}") for c in columns])
    b = new.select(*keys, F.lit(True).alias("in_new"), *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = a.join(b, list(keys), "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return joined.withColumn("changed", ~same)


def transitions(joined: DataFrame, keys: tuple[str, ...], score: str = "score") -> DataFrame:
    """How scores moved between two decodes: changed, recovered, changed or removed."""
    old, new = F.col(f"old_{score}"), F.col(f"new_{score}")
    return joined.groupBy(*keys).agg(
        F.count_if(~old.eqNullSafe(new)).alias("score_changed"), F.count_if(old.isNull() & new.isNotNull()).alias("recovered"),
        F.count_if(old.isNotNull() & ~old.eqNullSafe(new)).alias("changed_or_removed"),
    )


def unresolved_reasons(items: DataFrame, status: str, keys: tuple[str, ...] = ("trial",)) -> DataFrame:
    """Per trial the statuses that need a look, with counts, as sorted text; out-of-range items count though read."""
    open_ = items.filter(~is_readable(status) | F.col(status).isin(*OPEN)).groupBy(*keys, status).agg(F.count("*").alias("n"))
    return open_.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", status, F.col("n").cast("string")))), ",").alias("reasons"))


def nest(items: DataFrame, keys: tuple[str, ...], order: str, columns: tuple[str, ...], block: str | None = None) -> DataFrame:
    """Item rows back to one row per trial with an array in item order; a trial is bounded by its scale's size. With a block
    column also ``blocks``: each block, in the order of its first item, with its own items, made from the same array."""
    every = (order, *([block] if block else []), *columns)
    rows = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*every))).alias("items"))
    if not block:
        return rows
    own = lambda b: F.filter("items", lambda x: x[block].eqNullSafe(b))
    return rows.withColumn("blocks", F.transform(F.array_distinct(F.transform("items", lambda x: x[block])), lambda b: F.struct(b.alias(block), own(b).alias("slots"))))


def changed_items(rows: DataFrame, before: str, after: str, fields: tuple[str, ...]) -> DataFrame:
    """Of rows with both decodes of an item as structs those of which any field differs (nulls are values): a projection, as
    both are in one row. Adds both values of each field and the names of those that differ."""
    differs = F.array_compact(F.array(*[F.when(~F.col(f"{before}.{c}").eqNullSafe(F.col(f"{after}.{c}")), F.lit(c)) for c in fields]))
    both = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for c in fields for side, name in ((before, "before"), (after, "after"))]
    kept = [c for c in rows.columns if c not in (before, after)]
    return rows.select(*kept, *both, differs.alias("differs")).filter(F.size("differs") > 0)


def trial_audit(rows: DataFrame, keys: tuple[str, ...], before: str, after: str, score: str, kind: str) -> DataFrame:
    """One row for each trial: items, both statuses and read counts, scored items, answer types, and what is still open.
    Statuses of items are counted in the one grouping by trial."""
    opened = F.when(~is_readable(after) | F.col(after).isin(*OPEN), F.col(after))
    said = rows.groupBy(*keys).agg(
        F.count("*").alias("item_count"), F.count_if(is_readable(before)).alias("before_read"), F.count_if(is_readable(after)).alias("after_read"), F.count(score).alias("scored"),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("answer_types"), F.array_sort(F.collect_list(opened)).alias("__open"),
    )
    reasons = F.transform(F.array_distinct("__open"), lambda r: F.concat_ws("=", r, F.size(F.filter("__open", lambda x: x == r)).cast("string")))
    return said.withColumns({"before_status": parse_status("before_read", "item_count"), "after_status": parse_status("after_read", "item_count"), "reasons": F.array_join(reasons, ",")}).drop("__open")


def score_violations(items: DataFrame, score: str, choices: Column) -> Column:
    """Why a typed score is not allowed, or null: on text, not whole on an integer slot, not finite, not a listed choice."""
    s = F.col(score).cast("double")
    written = F.when(s == F.floor(s), s.cast("long").cast("string")).otherwise(s.cast("string"))
    return (
        F.when(s.isNull(), None).when(F.isnan(s) | (F.abs(s) == float("inf")), "not finite").when(F.col("response_type") == "text", "score on text")
        .when((F.col("response_type") == "integer") & (s != F.floor(s)), "not whole").when((F.col("response_type") == "choice") & ~F.coalesce(F.array_contains(choices, written), F.lit(False)), "no such choice")
    )


def checksum(rows: DataFrame, path: str, digest: str, bucket: Column) -> DataFrame:
    """One digest over all files, in two levels so that no task orders everything: a digest for each bucket of paths, then
    one over the buckets in order. The caller lets the number of buckets grow with the rows."""
    first = rows.groupBy(bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", path, digest))), "\n"), 256).alias("d"))
    return first.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("bucket").cast("string"), 12, "0"), "d"))), "\n"), 256).alias("checksum"), F.count("*").alias("buckets"))


def first_of_content(rows: DataFrame, content: str, anchor: str) -> DataFrame:
    """One row for each content, the one of the least anchor. Digests are shuffled, not contents, and reduced before."""
    return rows.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256)).groupBy("digest").agg(F.min(anchor).alias(anchor), F.count("*").alias("copies"))


def remap(orders: DataFrame, answers: str, order: str) -> DataFrame:
    """Answers in shown order back to source order by a 1-based permutation, inside the row. A short list leaves nulls; an
    incomplete permutation gives null."""
    n = F.size(order)
    complete = F.array_sort(order) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    back = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(F.col(answers), (F.array_position(order, i) - 1).cast("int")))
    return orders.withColumn("source_answers", F.when(complete & (n > 0), back))


def linked(items: DataFrame, keys: tuple[str, ...], slot: str, link: str, value: str) -> DataFrame:
    """Each answer together with the answer that its slot points to in the same trial."""
    other = items.select(*keys, F.col(slot).alias(link), F.col(value).alias(f"linked_{value}"))
    return items.filter(F.col(link).isNotNull()).join(other, [*keys, link])


def duplicate_ids(entries: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Marks entries whose id occurs more than once in a trial; such slots are void."""
    return entries.withColumn("is_duplicate", F.count("*").over(Window.partitionBy(*keys)) > 1)
