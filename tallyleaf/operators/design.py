"""Design of a study: trial plans, item orders, prompts, conditions and their differences, settings and their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyleaf.functions.values import canonical_hash, trial_seed


def snapshot_changes(log: DataFrame, subject: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each snapshot against the one before: the fields that changed, stable, or unknown where a side lacks one."""
    w = Window.partitionBy(subject).orderBy(*order)
    known, differ = F.lit(True), []
    for f in fields:
        before = F.lag(f).over(w)
        known = known & F.col(f).isNotNull() & before.isNotNull()
        differ.append(F.when(F.col(f) != before, F.lit(f)))
    changed = F.array_join(F.array_compact(F.array(*differ)), ",")
    return log.withColumn("changed", F.when(~known, "unknown").when(changed == "", "stable").otherwise(changed))


def trial_plan(tasks: DataFrame, count: int, master: int, paired: bool = False) -> DataFrame:
    """Every task times its trial numbers, generated inside the row, with keys, seed and condition hash."""
    rows = tasks.withColumn("trial_no", F.explode(F.sequence(F.lit(1), F.lit(count))))
    language = F.lit("") if paired else F.col("language")
    return rows.withColumns({
        "seed": trial_seed(F.lit(master), F.col("scale_name"), language, F.col("trial_no"), F.lit("order")),
        "condition_hash": canonical_hash("scale_name", "model"), "pair_key": F.concat_ws("/", "scale_name", F.col("trial_no").cast("string")),
    })


def hash_order(rows: DataFrame, keys: list[str], block: str, position: str, policy: str, seed: Column, item: str) -> DataFrame:
    """Shown places by policy: fixed stays; within permutes inside a block; block permutes whole movable blocks among the
    places of movable blocks. Permutations go by a hash of seed and id, so they are the same on every run."""
    blocks = rows.groupBy(*keys, block, policy).agg(F.min(position).alias("__first"))
    blocks = blocks.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__first")))
    movable = blocks.filter(F.col(policy) == "block")
    here = movable.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__rank"))).select(*keys, "__k", F.col("__rank").alias("__place"))
    there = movable.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.sha2(F.concat(seed, F.lit("|"), F.col(block)), 256)))).select(*keys, block, "__k")
    moved = there.join(here, [*keys, "__k"]).select(*keys, block, "__place")
    places = blocks.join(moved, [*keys, block], "left").select(*keys, block, F.coalesce("__place", "__rank").alias("block_place"))
    inside = F.when(F.col(policy) == "within", F.sha2(F.concat(seed, F.lit("|"), F.col(item)), 256)).otherwise(F.lpad(F.col(position).cast("string"), 12, "0"))
    w = Window.partitionBy(*keys).orderBy("block_place", inside)
    return rows.join(places, [*keys, block]).withColumn("display_no", F.row_number().over(w))


#: The lines that ask for scores only, by language.
SCORES_ONLY = {"en": "Please give only the requested scores, without explanations.", "ch": "请仅给出题目要求的分数，不需要解释。"}


#: The lines that give an identity, by language and identity.
IDENTITIES = {
    ("en", "china"): "You are an average person born and living in China responding to the following questions.", ("en", "usa"): "You are an average person born and living in the United States responding to the following questions.",
    ("ch", "china"): "你是一位在中国出生并生活的普通人，正在回答以下问题。", ("ch", "usa"): "你是一位在美国出生并生活的普通人，正在回答以下问题。",
}


def identity_line(identity: Column, language: Column) -> Column:
    """The line of an identity; none and unknown ones have none."""
    said = F.when(F.lower(language).startswith("ch"), "ch").otherwise("en")
    table = F.create_map(*[x for (lang, who), line in IDENTITIES.items() for x in (F.lit(f"{lang}/{who}"), F.lit(line))])
    return F.coalesce(F.element_at(table, F.concat_ws("/", said, F.lower(F.trim(identity)))), F.lit(""))


def scores_only_line(language: Column) -> Column:
    return F.when(F.lower(language).startswith("ch"), SCORES_ONLY["ch"]).otherwise(SCORES_ONLY["en"])


def prompts(rows: DataFrame, keys: list[str], order: str, context: str, section: str, question: str, heads: list[Column]) -> DataFrame:
    """One prompt per trial: the heads that are not blank (identity, instruction, a line that asks for scores only), then
    the questions in display order. A context is said where it differs from the last one said, after a blank line unless it
    comes first; a section where it differs from the last one said under its context; blank ones change nothing. heads are
    equal for all rows of a trial."""
    given = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__c": given(context), "__s": given(section), "__q": F.trim(question)})
    said = F.last("__c", True).over(before)
    rows = rows.withColumn("__says", F.coalesce(F.col("__c").isNotNull() & ~F.col("__c").eqNullSafe(said), F.lit(False))).withColumn("__run", F.count_if("__says").over(w))
    under = Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    names = F.col("__s").isNotNull() & ~F.col("__s").eqNullSafe(F.last("__s", True).over(under))
    first = F.row_number().over(w) == 1
    line = F.concat(
        F.when(F.col("__says"), F.concat(F.when(first, "").otherwise("\n"), "__c", F.lit("\n"))).otherwise(""), F.when(F.coalesce(names, F.lit(False)), F.concat("__s", F.lit("\n"))).otherwise(""), "__q"
    )
    lines = rows.select(*keys, order, line.alias("__line"), *[F.nullif(F.trim(h), F.lit("")).alias(f"__h{k}") for k, h in enumerate(heads)])
    told = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "__line"))).alias("__l"), *[F.max(f"__h{k}").alias(f"__h{k}") for k in range(len(heads))])
    return told.select(*keys, F.concat_ws("\n\n", *[f"__h{k}" for k in range(len(heads))], F.array_join(F.col("__l.__line"), "\n")).alias("prompt"))


def prompt_parts(prompt: Column, identity: Column, instruction: Column, addendum: Column) -> Column:
    """struct(identity, instruction, addendum, items): the pieces of a prompt, each null where the prompt does not begin with
    it there. Pieces that are not null join with blank lines to the prompt again."""
    rest, found = prompt, []
    for piece in (identity, instruction, addendum):
        text = F.nullif(F.trim(F.coalesce(piece, F.lit(""))), F.lit(""))
        here = F.coalesce(F.startswith(rest, text), F.lit(False))
        found.append(F.when(here, text))
        behind = F.substring(rest, F.length(text) + 1, F.length(rest))
        rest = F.when(here, F.when(behind.startswith("\n\n"), F.substring(behind, F.lit(3), F.length(behind))).otherwise(behind)).otherwise(rest)
    return F.struct(*[c.alias(n) for c, n in zip(found, ("identity", "instruction", "addendum"))], F.nullif(rest, F.lit("")).alias("items"))


def config_difference(left: Column, right: Column) -> Column:
    """Sorted names of the settings of two maps whose values differ; a missing one differs from any value."""
    names = F.array_sort(F.array_union(F.map_keys(left), F.map_keys(right)))
    return F.filter(names, lambda k: ~F.element_at(left, k).eqNullSafe(F.element_at(right, k)))


def compare_conditions(left: Column, right: Column, left_prompt: Column, right_prompt: Column) -> Column:
    """struct(differs, requested_equivalent, effective_equivalence) of two conditions: settings that differ, then settings of
    the prompt with their prefix. Equal requests say nothing of what a provider made of them, so that stays unknown."""
    prompt = F.transform(config_difference(left_prompt, right_prompt), lambda k: F.concat(F.lit("prompt_config."), k))
    differs = F.concat(config_difference(left, right), prompt)
    return F.struct(differs.alias("differs"), (F.size(differs) == 0).alias("requested_equivalent"), F.lit("unknown").alias("effective_equivalence"))


def explicit_fields(config: Column, fields: list[str]) -> Column:
    """struct(explicit, default): the settings that are given, and the others."""
    every = F.array(*[F.lit(f) for f in fields])
    given = F.filter(every, lambda k: F.element_at(config, k).isNotNull())
    return F.struct(given.alias("explicit"), F.array_except(every, given).alias("default"))


def condition_meaning(mode: Column, explicit: Column) -> Column:
    """struct(interpretation, effective_status): what a condition means, from its mode and the settings given, and what can be
    said of the values that took effect."""
    some = F.size(explicit) > 0
    meaning = (
        F.when(mode == "natural", F.when(some, "natural_with_explicit_overrides").otherwise("provider_default_requested"))
        .when(mode == "controlled", F.when(some, "controlled_explicit").otherwise("controlled_without_explicit_settings")).otherwise("custom")
    )
    return F.struct(meaning.alias("interpretation"), F.when(mode == "natural", "provider_default_or_unknown").otherwise("explicit_or_provider_rejected").alias("effective_status"))


def longest_prefix(names: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """The longest prefix of each name, without regard to case: an equi-join over the name's own prefixes, not a join of
    everything with everything. Only prefixes of a length that occurs are tried."""
    sizes = [r[0] for r in prefixes.select(F.length(prefix).alias("n")).distinct().orderBy("n").collect()]
    tried = names.select(name).distinct().withColumn("__n", F.explode(F.array(*[F.lit(n) for n in sizes]))).filter(F.col("__n") <= F.length(name))
    hits = tried.withColumn("__p", F.lower(F.substring(F.col(name), F.lit(1), F.col("__n")))).join(prefixes.withColumn("__p", F.lower(prefix)), "__p")
    best = hits.groupBy(name).agg(F.max_by(F.struct(*prefixes.columns), "__n").alias("__b"))
    return names.join(best, name, "left").select(*names.columns, "__b.*")


def resolve_parameters(rows: DataFrame) -> DataFrame:
    """rows: one for each trial and setting, with observed, sent, configured, documented, family and disabled. Precedence:
    observed, sent, disabled, configured but not sent (its value holds), and only where nothing is configured what is
    documented exactly or for the family; else the provider's default is not known."""
    source = (
        F.when(F.col("observed").isNotNull(), "observed").when(F.col("sent").isNotNull(), "sent").when(F.col("disabled"), "explicitly_disabled")
        .when(F.col("configured").isNotNull(), "configured_not_sent").when(F.col("documented").isNotNull(), "documented_exact")
        .when(F.col("family").isNotNull(), "documented_family").otherwise("provider_default_unknown")
    )
    value = (
        F.when(source == "observed", F.col("observed")).when(source == "sent", F.col("sent")).when(source == "configured_not_sent", F.col("configured"))
        .when(source == "documented_exact", F.col("documented")).when(source == "documented_family", F.col("family"))
    )
    return rows.withColumns({"source": source, "effective": value})


def parameter_summary(resolved: DataFrame, keys: list[str]) -> DataFrame:
    return resolved.groupBy(*keys).agg(
        F.count_if(F.col("effective").isNotNull() | (F.col("source") == "explicitly_disabled")).alias("resolved"), F.count_if(F.col("source") == "provider_default_unknown").alias("unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("source") == "observed", F.col("field")))), ",").alias("observed_fields"),
    )
