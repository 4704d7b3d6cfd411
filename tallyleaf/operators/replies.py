"""Whole replies to typed answers, as one job over replies: each is read with its slots inside its row.

A reply is first taken for what it is: a JSON sheet (nothing but JSON, bare or fenced), JSON lines that name every slot, an
interview (all slots are open texts), a bare sequence of as many valid tokens as slots, or prose with numbered lines,
headings and tables. Its entries or lines become records; a record claims a slot by the strongest evidence that it has:
its slot id, the question's words, its number, the order of a complete unnumbered reply, or that there is one slot only.
Headings narrow the slots that a record can claim, and numbers count within them; where numbers begin again under headings
that name no slots, they claim nothing. Claims are read line by line, and answers that differ conflict. Nothing is guessed:
more than one candidate gives none, and what a sheet does wrong is listed with the reply. Replies are read in Arrow batches
(``reply_rows``), JSON with fractions or escapes by column functions before; no lines are shuffled, and nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyleaf.functions import values as v
from tallyleaf.operators.reply_rows import NEWLINE, PLAIN, READABLE, WIDE, read_rows

__all__ = ["READABLE", "decode_whole"]

#: Properties of a slot; those that are not given are null.
_SLOT = {
    "slot_id": "string", "question": "string", "response_type": "string", "minimum": "double", "maximum": "double", "choices": "array<string>", "labels": "map<string,string>",
    "context": "string", "section": "string", "source_no": "int", "linked_slot_id": "string",
}

_ANSWERS = "answers array<struct<slot_id: string, answer: string, score: double, lower: double, upper: double, status: string, method: string>>, parse_status string, recovery string, defects array<string>"
_SHEET = "struct<kind: string, entries: array<struct<pos: int, answer: string, defect: string>>, braced: string>"


#: How JSON begins, also behind a fence and in full-width signs; what of it Python may write in another way than Spark does.
OPENS = r"^[\s\x{85}\x{2028}\x{2029}]*(?:[`｀]{3}[a-zA-Zａ-ｚＡ-Ｚ]{0,4}\s*)?[\[{［｛]"
HARD, LONG = r"[\\！-～]|[0-9][.eE]|-0|[0-9]{400}", 1_000_000


def sheet_claim(body: Column, key: Column, x: Column) -> Column:
    """struct(pos, answer, defect) of an entry of a JSON sheet. x: the slots' ids and the sheet's kind."""
    n = F.size(x["ids"])
    is_object = F.coalesce(body.rlike(r"^\s*\{"), F.lit(False))
    keyed = key.isNotNull() & ~key.startswith("#")
    index = F.coalesce(F.when(is_object, F.coalesce(F.get_json_object(body, "$.display_index"), F.get_json_object(body, "$.index"))), F.regexp_extract(key, r"^#?([0-9]{1,6})$", 1)).try_cast("int")
    named = F.coalesce(F.when(is_object, F.get_json_object(body, "$.slot_id")), F.when(keyed & ~key.rlike("^[0-9]+$"), key))
    given = F.when(is_object, F.schema_of_variant(F.variant_get(F.try_parse_json(body), "$.answer", "variant")))
    found = F.struct(is_object.alias("is_object"), index.alias("index"), named.alias("named"), given.alias("given"), F.when(is_object, F.get_json_object(body, "$.answer")).otherwise(body).alias("answer"))

    def placed(e: Column) -> Column:
        place = F.when(e["named"].isNotNull(), F.nullif(F.array_position(x["ids"], e["named"]), F.lit(0)).cast("int")).when(e["index"].between(1, n), e["index"])
        return F.struct(e["is_object"].alias("is_object"), e["named"].alias("named"), e["given"].alias("given"), e["answer"].alias("answer"), place.alias("pos"))

    def told(e: Column) -> Column:
        wrong = F.when(e["is_object"], e["given"].rlike("^(?:BOOLEAN|OBJECT|ARRAY)")).otherwise(body.rlike(r"^\s*(?:true|false|\[.*\])\s*$") & (x["kind"] == "json"))
        defect = (
            F.when(~e["is_object"] & key.isNull(), "entry_not_object").when(e["pos"].isNull() & e["named"].isNotNull(), "unknown_slot_id").when(e["pos"].isNull(), "invalid_display_index")
            .when(e["is_object"] & e["given"].isNull(), "missing_answer").when(e["answer"].isNull(), "null_answer").when(F.trim(e["answer"]) == "", "empty_answer").when(wrong, "invalid_answer_type")
        )
        return F.struct(e["pos"].alias("pos"), e["answer"].alias("answer"), defect.alias("defect"))

    return v.once(v.once(found, placed), told)


def sheet(reply: Column, slots: Column) -> Column:
    """What a reply says as JSON: struct(kind, entries, braced). kind is json, json_lines or null; braced is for texts that only
    begin as an object does."""
    unit = lambda key, value: F.struct(key.cast("string").alias("key"), F.regexp_replace(value, r"\s+$", "").alias("said"))

    def of(text: Column) -> Column:
        some = F.filter(F.split(text, NEWLINE), lambda x: F.trim(x) != "")
        bare = F.regexp_replace(F.trim(text), r"(?is)^```(?:json)?\s*([\[{].*[\]}])\s*```$", "$1")
        return F.struct(text.alias("text"), some.alias("some"), bare.alias("bare"), F.transform(slots, lambda s: s["slot_id"]).alias("ids"))

    def kind(x: Column) -> Column:
        alone = F.try_parse_json(F.concat(F.lit("["), x["bare"], F.lit("]")))  # in brackets, as what follows a value is not looked at
        is_json = x["bare"].rlike(r"^[\[{]") & v.once(alone, lambda a: a.isNotNull() & F.variant_get(a, "$[1]", "variant").isNull())
        said = F.array_sort(F.transform(x["some"], lambda y: F.get_json_object(y, "$.slot_id")))
        lines = F.forall(x["some"], lambda y: y.rlike(r"^\s*\{.*\}\s*$") & F.try_parse_json(y).isNotNull()) & (said == F.array_sort(x["ids"]))
        return F.struct(*[x[c].alias(c) for c in ("text", "some", "bare", "ids")], F.when(lines, "json_lines").when(is_json, "json").alias("kind"))

    def listed(x: Column) -> Column:
        some = F.coalesce(F.from_json(x["bare"], "answers array<string>")["answers"], F.when(x["bare"].startswith("["), F.from_json(x["bare"], "array<string>")))

        def numbered(some: Column) -> Column:
            scalars = ~F.exists(some, lambda e: F.coalesce(e.rlike(r"^\s*[\[{]"), F.lit(False))) & (F.size(some) == F.size(x["ids"]))
            return v.once(scalars, lambda plain: F.transform(some, lambda e, i: unit(F.when(plain, F.concat(F.lit("#"), (i + 1).cast("string"))), e)))

        return F.coalesce(v.once(some, numbered), F.transform(F.map_entries(F.from_json(x["bare"], "map<string,string>")), lambda e: unit(e["key"], e["value"])))

    def read(x: Column) -> Column:
        nothing = F.array(unit(F.lit(None), F.lit(None).cast("string")))
        units = F.when(x["kind"] == "json", listed(x)).when(x["kind"] == "json_lines", F.transform(x["some"], lambda y: unit(F.lit(None), y)))
        entries = v.once(units, lambda u: F.transform(F.when(F.size(u) > 0, u).otherwise(nothing), lambda e: sheet_claim(e["said"], e["key"], x)))
        braced = F.when(x["kind"].isNull() & x["text"].rlike(r"^\s*\{"), F.get_json_object(F.trim(x["text"]), "$.answer"))
        return F.struct(x["kind"].alias("kind"), F.when(x["kind"].isNotNull(), entries).alias("entries"), braced.alias("braced"))

    return v.once(v.once(v.once(F.translate(reply, WIDE, PLAIN), of), kind), read).cast(_SHEET)


def _read(rows: DataFrame, keys: list[str], fields: list[str | None]) -> DataFrame:
    """Answers of replies with their slots and sheets, in Arrow batches."""
    schema = T.StructType([rows.schema[k] for k in keys] + T.StructType.fromDDL(_ANSWERS).fields)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        kinds = [f.type for f in arrow][n:]
        for batch in batches:
            for columns in read_rows(batch, n, kinds, fields):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def decode_whole(replies: DataFrame, keys: list[str], reply: str = "reply", slots: str = "slots", dealt: bool = False) -> DataFrame:
    """keys (unique and not null for each reply), answers in display order, parse_status (ok, partial, refusal, unparsed,
    empty_response), recovery and defects. slots: an array of structs with slot_id, question, response_type (integer, number,
    choice, text), minimum, maximum, choices and, where there are such, labels, context, section, source_no, linked_slot_id.
    dealt: tasks hold bounded numbers of replies already, which are read where they are; else replies are shuffled once by their keys,
    and those whose JSON column functions read, and all others, read that one shuffle."""
    given = {f.name for f in replies.schema[slots].dataType.elementType.fields}
    has = [k for k in _SLOT if k in given]
    fields = [k if k in given else None for k in _SLOT]
    rows = replies.select(*keys, F.col(reply).alias("__reply"), F.transform(slots, lambda s: F.struct(*[s[k].cast(_SLOT[k]).alias(k) for k in has])).alias("__slots"))
    by_columns = F.coalesce(F.col("__reply").rlike(OPENS) & (F.col("__reply").rlike(HARD) | (F.length("__reply") > LONG)), F.lit(False))
    found = sheet(F.col("__reply"), F.col("__slots"))
    if dealt:
        return _read(rows.withColumn("__sheet", F.when(by_columns, found)), keys, fields)
    rows = rows.repartition(*keys)
    here = F.when(F.spark_partition_id() >= 0, by_columns)  # known only in a task, so not pushed below the shuffle
    plain = _read(rows.filter(~here).withColumn("__sheet", F.lit(None).cast(_SHEET)), keys, fields)
    return _read(rows.filter(here).withColumn("__sheet", found), keys, fields).unionByName(plain)
