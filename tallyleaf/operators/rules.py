"""Settings checked against tables of rules. A setting is a row, a rule is a row, and every broken rule gives a message: bounds
of a field, what a model does with a field, and fields that exclude each other. Models find their profile by the longest
prefix that their provider has, an equi-join over a model's own prefixes. Rule tables are broadcast only if a count has
shown that they are small; else the same joins shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 50_000

#: Field, least, greatest, whether it is a whole number.
BOUNDS = (
    ("temperature", 0, 2, False), ("top_p", 0, 1, False), ("min_p", 0, 1, False), ("typical_p", 0, 1, False), ("top_k", 1, None, True), ("seed", 0, None, True), ("n", 1, None, True),
    ("candidate_count", 1, None, True), ("best_of", 1, None, True), ("top_logprobs", 0, 20, True), ("max_output_tokens", 1, None, True), ("thinking_budget", 1, None, True),
)


def small(rules: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A rule table as a broadcast if it has at most so many rows; beyond that as it is."""
    return F.broadcast(rules) if rules.limit(most + 1).count() <= most else rules


def bound_rules(spark) -> DataFrame:
    return spark.createDataFrame([(f, None if a is None else float(a), None if b is None else float(b), w) for f, a, b, w in BOUNDS], "field string, least double, greatest double, whole boolean")


def find_profile(configs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``prefix``: of the prefixes that the provider has in ``profiles`` (provider, prefix) the longest that the model
    begins with, without regard to case; null where there is none. Names are compared once for each distinct model."""
    models = configs.select("provider", "model").distinct()
    said = F.lower(F.coalesce("model", F.lit("")))
    tried = models.withColumn("__n", F.explode(F.sequence(F.lit(0), F.length(said)))).withColumn("__p", F.substring(said, F.lit(1), F.col("__n")))
    known = profiles.select(F.lower("provider").alias("__provider"), F.lower("prefix").alias("__p"), "prefix").distinct()
    hits = tried.withColumn("__provider", F.lower("provider")).join(small(known), ["__provider", "__p"])
    best = hits.groupBy(F.col("provider").alias("__bp"), F.col("model").alias("__bm")).agg(F.max_by("prefix", "__n").alias("prefix"))
    same = F.col("provider").eqNullSafe(F.col("__bp")) & F.col("model").eqNullSafe(F.col("__bm"))
    return configs.join(best, same, "left").drop("__bp", "__bm")


def given_settings(configs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each setting that is given."""
    rows = configs.select(*keys, "provider", "model", "prefix", "strict", "settings", F.explode("settings").alias("field", "value"))
    return rows.filter(F.col("value").isNotNull())


def _message(order: int, text: Column) -> Column:
    return F.struct(F.lit(order).alias("order"), text.alias("text"))


def broken_bounds(given: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values that are no number, not whole or out of bounds."""
    n = F.col("value").try_cast("double")
    wrong = n.isNull() | (F.col("whole") & (n != F.floor(n))) | F.coalesce(n < F.col("least"), F.lit(False)) | F.coalesce(n > F.col("greatest"), F.lit(False))
    number = lambda c: F.format_string("%.0f", F.col(c))
    span = F.when(F.col("greatest").isNull(), F.concat(F.lit("at least "), number("least"))).otherwise(F.concat(F.lit("from "), number("least"), F.lit(" to "), number("greatest")))
    kind = F.when(F.col("whole"), "a whole number ").otherwise("a number ")
    return given.join(small(bounds), "field").filter(wrong).withColumn("message", _message(1, F.concat("field", F.lit(" must be "), kind, span)))


def broken_capabilities(given: DataFrame, capabilities: DataFrame) -> DataFrame:
    """What a model does not do with a setting. capabilities: provider, prefix, field, status (supported, conditional,
    unsupported, ignored, unknown), modes, note; the provider '*' is for fields that a profile says nothing of. Ignored and
    unknown settings are messages for strict runs only."""
    rules = capabilities.select(F.lower("provider").alias("__provider"), "prefix", "field", F.struct("status", "modes", "note").alias("own"))
    base = rules.filter("__provider = '*'").select("field", F.col("own").alias("base"))
    rows = given.filter("prefix is not null").withColumn("__provider", F.lower("provider")).join(small(rules.filter("__provider <> '*'")), ["__provider", "prefix", "field"], "left").join(small(base), "field", "left")
    rows = rows.withColumn("rule", F.coalesce("own", "base"))
    status = F.coalesce("rule.status", F.lit("unknown"))
    who = F.concat(F.lit(" by "), "provider", F.lit("/"), "model")
    noted = F.when(F.coalesce("rule.note", F.lit("")) != "", F.concat(F.lit(": "), "rule.note")).otherwise("")
    text = (
        F.when(status == "unsupported", F.concat("field", F.lit(" is not supported"), who, noted)).when((status == "ignored") & F.col("strict"), F.concat("field", F.lit(" is ignored"), who, noted))
        .when((status == "unknown") & F.col("strict"), F.concat("field", F.lit(" is not verified"), who))
        .when((F.coalesce(F.size("rule.modes"), F.lit(0)) > 0) & ~F.array_contains(F.coalesce("rule.modes", F.array()), F.col("value")), F.concat("field", F.lit(" takes only "), F.array_join("rule.modes", ", "), who))
    )
    skipped = (F.col("field") == "thinking_mode") & (F.col("value") == "provider_default")
    return rows.filter(text.isNotNull() & ~skipped).withColumn("message", _message(2, text))


def broken_exclusions(given: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Settings that another one excludes. exclusions: provider (null: any), field, value (null: any), other, allowed: the
    other setting may be absent or one of ``allowed``."""
    rules = exclusions.select(F.lower("provider").alias("__rp"), "field", F.col("value").alias("__rv"), "other", "allowed", "message_text")
    there = F.element_at("settings", F.col("other"))
    hit = (F.col("__rp").isNull() | (F.col("__rp") == F.lower("provider"))) & (F.col("__rv").isNull() | (F.col("__rv") == F.col("value")))
    bad = there.isNotNull() & ~F.array_contains(F.coalesce("allowed", F.array()), there)
    return given.join(small(rules), "field").filter(F.coalesce(hit, F.lit(False)) & bad).withColumn("message", _message(3, F.col("message_text")))


def broken_needs(given: DataFrame, needs: DataFrame) -> DataFrame:
    """Values that only some models can be given. needs: field, value, provider, prefix; a model that no prefix of its
    provider fits can not be given this value."""
    asked = given.join(small(needs.select("field", "value").distinct()), ["field", "value"])
    said = F.lower("model")
    able = asked.select("provider", "model", "field", "value").distinct().withColumn("__p", F.explode(F.transform(F.sequence(F.lit(0), F.length(said)), lambda n: F.substring(said, F.lit(1), n)))).withColumn("__provider", F.lower("provider"))
    able = able.join(small(needs.select(F.lower("provider").alias("__provider"), F.lower("prefix").alias("__p"), "field", "value")), ["__provider", "__p", "field", "value"]).select("provider", "model", "field", "value").distinct()
    return asked.join(able, ["provider", "model", "field", "value"], "left_anti").withColumn("message", _message(4, F.concat("field", F.lit(" can not be "), "value", F.lit(" for "), "provider", F.lit("/"), "model")))


def check_settings(configs: DataFrame, keys: list[str], capabilities: DataFrame, exclusions: DataFrame, needs: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """keys and ``messages``: all broken rules of each configuration, bounds first, then what its model does not do, then
    exclusions and needs, and last whether a strict run names a model without a profile; empty where all is well. configs:
    keys (unique), provider, model, settings (map), strict."""
    spark = configs.sparkSession
    found = find_profile(configs, capabilities.filter("provider <> '*'"))
    given = given_settings(found, keys)
    broken = [broken_bounds(given, bounds or bound_rules(spark)), broken_capabilities(given, capabilities), broken_exclusions(given, exclusions), broken_needs(given, needs)]
    unknown = given.filter("strict AND prefix IS NULL").withColumn("message", _message(5, F.concat("provider", F.lit("/"), "model", F.lit(" is not registered"))))
    rows = None
    for b in [*broken, unknown]:
        part = b.select(*keys, "message")
        rows = part if rows is None else rows.unionByName(part)
    said = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("message")).alias("__m"))
    return configs.select(*keys).join(said, keys, "left").select(*keys, F.coalesce(F.col("__m.text"), F.array().cast("array<string>")).alias("messages"))
