"""The whole record of a trial: 24 columns from records whose fields may be nested, named differently or absent. What a field
is taken from is stated once, as a list of places in order of precedence; places that a table does not have are left out, so
one definition serves plans, attempts and results of any age. An absent field and a null are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyleaf.operators.trials import KIND_RANK, STATUS_LABELS, experiment_label, label, whole_number

#: The record's columns.
COLUMNS = (
    "id", "run_id", "scale_name", "language", "provider", "model", "experiment", "preset_id", "cultural_identity", "prompt_contract", "temperature", "top_p", "order_id", "status", "status_label",
    "raw_response", "answer_length", "prompt", "answered_item_count", "read_item_count", "item_count", "recorded_at", "source", "source_kind",
)
#: The columns of an item's row.
ITEM_COLUMNS = (
    "index", "slot_id", "block_id", "context_id", "section_id", "response_type", "minimum", "maximum", "linked_slot_id", "question", "answer", "score", "range_text", "range_lower", "range_upper", "range_unit",
    "parse_status", "parse_error", "mapping_method", "answer_present", "score_present", "trial_status", "cultural_identity", "trial_raw_response",
)


def has(schema: T.StructType, path: str) -> bool:
    """Whether a table has a field at a path of names."""
    kind: T.DataType = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def first_of(records: DataFrame, kind: str, *paths: str) -> Column:
    """The first value that is not null at the places of a field that the table has; of texts, the first not blank one."""
    there = [F.col(p).cast(kind) for p in paths if has(records.schema, p)]
    if kind == "string":
        there = [F.when(F.trim(c) != "", c) for c in there]
    return F.coalesce(*there, F.lit(None).cast(kind))


def is_trial(records: DataFrame, kind: str) -> Column:
    """Whether a record names a trial and is whole: a result needs its reply and items, an attempt its schema's version and
    its text."""
    order = first_of(records, "string", "order_id")
    ok = first_of(records, "string", "scale_name").isNotNull() & first_of(records, "string", "language").isin("ch", "en") & whole_number(order).isNotNull()
    needs = {"plan": (), "result": ("raw_response", "items"), "attempt": ("attempt_schema_version", "response_text")}[kind]
    for name in needs:
        ok = ok & (F.col(name).isNotNull() if has(records.schema, name) else F.lit(False))
    return F.coalesce(ok, F.lit(False))


def full_records(records: DataFrame, kind: str) -> DataFrame:
    """Valid records of a kind as the 24 columns, and attempt and kind_rank, by which the current one is chosen."""
    r = records.filter(is_trial(records, kind))
    text = lambda *p: first_of(r, "string", *p)
    blank = lambda c: F.coalesce(c, F.lit(""))
    identity, contract = F.coalesce(text("cultural_identity", "condition_descriptor.cultural_identity"), F.lit("none")), F.coalesce(text("prompt_contract", "condition_descriptor.prompt_contract"), F.lit("unconstrained"))
    temperature = first_of(r, "double", "generation_config.temperature", "temperature")
    state = F.coalesce(text("response_status", "status"), F.lit("legacy_saved" if kind == "result" else "not_recorded"))
    if kind == "attempt":
        state = F.when(state == "error", "transport_error").otherwise(state)
    raw = first_of(r, "string", "raw_response") if kind == "result" else first_of(r, "string", "response_text")
    rows = r.select(
        blank(text("run_id")).alias("run_id"), F.col("scale_name"), F.col("language"), blank(text("provider")).alias("provider"), blank(text("model", "requested_model")).alias("model"), text("condition_hash").alias("__hash"),
        text("prompt_contract").alias("__contract"), text("cultural_identity").alias("__identity"), text("condition_mode").alias("__mode"), text("preset_id").alias("preset_id"), identity.alias("cultural_identity"), contract.alias("prompt_contract"),
        temperature.alias("temperature"), first_of(r, "double", "generation_config.top_p").alias("top_p"), (F.col("generation_config").isNotNull() if has(r.schema, "generation_config") else F.lit(False)).alias("__own"),
        whole_number(text("order_id")).alias("order_id"), state.alias("status"), blank(raw).alias("raw_response"), blank(text("prompt")).alias("prompt"),
        *[first_of(r, "long", c).alias(c) for c in ("answered_item_count", "read_item_count")], first_of(r, "long", "item_count", "n_items").alias("item_count"),
        blank(text("model_identity.request_completed_at_local", "model_metadata.request_completed_at_local", "recorded_at_utc")).alias("recorded_at"), blank(text("source")).alias("source"),
        F.lit(kind).alias("source_kind"), F.lit(KIND_RANK[kind]).alias("kind_rank"), F.coalesce(text("attempt").try_cast("int"), F.lit(0)).alias("attempt"),
    )
    other = F.to_json(F.struct(F.col("__identity").alias("cultural_identity"), F.col("__contract").alias("prompt_contract"), "temperature"), {"ignoreNullFields": "false"})
    key = F.array("run_id", "scale_name", "language", "provider", "model", F.col("order_id").cast("string"), F.coalesce("__hash", other))
    return rows.withColumn("id", F.sha2(F.to_json(key), 256)).drop("__hash", "__contract", "__identity")


def inherit_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows without a preset take their plan's; attempts without settings of their own take its temperature and top_p too."""
    base = plan.select("id", F.col("preset_id").alias("__preset"), F.col("temperature").alias("__temperature"), F.col("top_p").alias("__top_p"))
    takes = (F.col("source_kind") == "attempt") & ~F.col("__own")
    return rows.join(base, "id", "left").withColumns({
        "preset_id": F.coalesce("preset_id", "__preset"), "temperature": F.when(takes, F.coalesce("__temperature", "temperature")).otherwise(F.col("temperature")),
        "top_p": F.when(takes, F.col("__top_p")).otherwise(F.col("top_p")),
    }).drop("__preset", "__temperature", "__top_p")


def finish(rows: DataFrame) -> DataFrame:
    """The columns that follow from others, and all 24 in their order."""
    rows = rows.withColumns({
        "experiment": experiment_label("preset_id", "cultural_identity", "prompt_contract", "__mode"), "preset_id": F.coalesce("preset_id", F.lit("")),
        "status_label": label("status", STATUS_LABELS), "answer_length": F.length("raw_response"),
    })
    return rows.select(*COLUMNS)


def collect_records(plan: DataFrame, attempts: DataFrame, results: DataFrame) -> DataFrame:
    """One whole record for each trial: its result, else its last attempt, else its plan. The choice is made on the rank
    alone, with map-side combine; texts move once."""
    planned = full_records(plan, "plan")
    planned = planned.groupBy("id").agg(F.max_by(F.struct(*[c for c in planned.columns if c != "id"]), F.struct("source", "recorded_at")).alias("r")).select("id", "r.*")
    rest = full_records(attempts, "attempt").unionByName(full_records(results, "result"))
    rows = planned.unionByName(inherit_plan(rest, planned))
    best = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct("kind_rank", "attempt", "source")).alias("r"))
    return finish(best.select("id", "r.*"))


def item_rows(trials: DataFrame, items: str = "items") -> DataFrame:
    """The 24 columns of each item of a trial, as text: what an item does not have is blank, the trial's status and identity
    are on every row, its whole reply on the first only. Other columns of the trial stay in front."""
    kept = [c for c in trials.columns if c not in (items, "response_status", "cultural_identity", "raw_response")]
    rows = trials.select(*kept, *[first_of(trials, "string", c).alias(f"__{c}") for c in ("response_status", "cultural_identity", "raw_response")], F.posexplode(items).alias("__p", "item"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    own = {c: blank(first_of(rows, "string", f"item.{c}")) for c in ITEM_COLUMNS[:-3]}
    own |= {"trial_status": blank(F.col("__response_status")), "cultural_identity": F.coalesce("__cultural_identity", F.lit("none")), "trial_raw_response": F.when(F.col("__p") == 0, blank(F.col("__raw_response"))).otherwise("")}
    return rows.select(*kept, *[own[c].alias(c) for c in ITEM_COLUMNS])
