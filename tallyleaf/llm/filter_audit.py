"""How five document filters interact: what each would remove in every order in which they can be applied.

Each document's five failures are bits of a mask, and all that the audit needs is how many documents of a part have which
mask: at most 32 cells a part. A recursive query starts from the masks that occur and an empty prefix, and extends every
prefix by each letter that it does not hold yet, carrying the bits applied so far; each level of the recursion says for
each mask whether that step removes it, finds it removed already, or keeps it. These 325 prefixes times at most 32 masks
do not depend on the data's size, so they go to the cells as a broadcast, and counts are sums over cells.

Whether a text repeats one of a smaller id is settled by partial aggregates alone: of each text's digest the rows of the
smallest id stay, all others fail. No join and no group brings the rows of one text together, however often it occurs.

Defined results: null texts are empty and equal to empty ones; an empty text fails A only (and E where it repeats); a null
source is the part of the empty string, as an empty source is. Rows without an id neither are repeats nor make others
repeats, and have no labels. Rows that share an id and text are no repeats of each other; labels given more than once
count if any row says 1. An empty table has no parts. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import cut, read_table

LETTERS = "ABCDE"
REPEATS = 1 << LETTERS.index("E")


def failures(text: Column) -> list[Column]:
    """The conditions A to D of a text, as booleans."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    few = F.size(words) < 200
    alike = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    loud = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text)
    return [few, alike, loud, text.rlike("[#$%&*|]")]


def _mask(conditions: list[Column]) -> Column:
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0)).cast("int")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and mask: n, and how many of them are labelled good (quality = 1) and toxic (toxic = 1)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), _mask(failures(F.col("text"))).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("doc_id", "part", "mask", "digest", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    each = known.groupBy("doc_id", "digest", "mask", "good", "toxic", "part").agg(F.count("*").alias("n"))
    each = cut(each)
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    # Parts of one id and text are few: a list of them, and of each text the list of the smallest id.
    shared = each.groupBy("digest", "mask", "doc_id", "good", "toxic").agg(F.collect_list(F.struct("part", "n")).alias("parts"))
    first = shared.groupBy("digest", "mask").agg(F.min_by(F.struct("good", "toxic", "parts"), "doc_id").alias("f"))
    kept = first.select("mask", "f.good", "f.toxic", F.explode("f.parts").alias("p")).select("p.part", "mask", "p.n", "good", "toxic").groupBy("part", "mask").agg(*sums)
    nameless = rows.filter("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    minus = kept.select("part", (F.col("mask") + REPEATS).alias("mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    repeats = each.groupBy("part", (F.col("mask") + REPEATS).alias("mask")).agg(*sums).unionByName(minus)
    whole = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    return kept.unionByName(nameless).unionByName(repeats).groupBy("part", "mask").agg(*whole).filter("n > 0")


def prefix_steps(spark: SparkSession, masks: DataFrame) -> DataFrame:
    """The recursion: for each prefix of distinct letters and each mask, what the prefix's last filter does to it."""
    unused = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << k})" for k, c in enumerate(LETTERS))
    return spark.sql(
        f"""WITH RECURSIVE steps (prefix, step, letter, applied, mask, removed, redundant) AS (
          SELECT '', 0, '', 0, mask, false, false FROM {{masks}}
          UNION ALL
          SELECT concat(prefix, f.letter), step + 1, f.letter, applied | f.bit, mask,
                 mask & f.bit <> 0 AND mask & applied = 0, mask & f.bit <> 0 AND mask & applied <> 0
          FROM steps LATERAL VIEW explode(filter(array({unused}), x -> applied & x.bit = 0)) l AS f
        ) SELECT prefix, step, letter, mask, removed, redundant, mask & applied = 0 AS kept, removed AND mask & ~applied = 0 AND step = 1 AS only
          FROM steps WHERE step > 0""",
        masks=masks,
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of all filters and step in it."""
    spark = docs.sparkSession
    cells = cut(mask_cells(docs, labels))
    steps = F.broadcast(prefix_steps(spark, cells.select("mask").distinct()))  # at most 325 * 32 rows
    counted = cells.join(steps, "mask").groupBy("part", "prefix", "step", "letter").agg(
        *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("kept", "removed", "redundant", "only")],
        *[F.sum(F.when(F.col("removed"), F.col(c)).otherwise(0)).alias(f"{c}_lost") for c in ("good", "toxic")],
    )
    counted = cut(counted)
    orders = F.when(F.col("step") >= 4, 1).otherwise(F.when(F.col("step") == 3, 2).otherwise(F.when(F.col("step") == 2, 6).otherwise(24)))  # of all, that begin so
    filters = counted.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"), F.sum("only").alias("unique_fails"))
    ends = counted.filter("step = 5").select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    ends = ends.withColumn("prefix", F.col("filter_order").substr(F.lit(1), F.col("step")))
    return ends.join(counted, ["part", "prefix", "step"]).join(filters, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM words LEFT JOIN marks USING (doc_id)),
letters (letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders (o) AS (SELECT letter FROM letters UNION ALL SELECT o || letter FROM orders, letters WHERE length(o) < 5 AND NOT contains(o, letter)),
steps AS (
  SELECT o AS filter_order, CAST(s.step AS INT) AS step, substr(o, s.step, 1) AS letter, list_sum([CAST(1 << (ascii(c) - 65) AS INT) for c in string_split(substr(o, 1, s.step), '')]) AS applied
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s WHERE length(o) = 5),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
counted AS (
  SELECT part, filter_order, step, s.letter,
         sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & (applied - bit) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & (applied - bit) <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & (applied - bit) = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & (applied - bit) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, (SELECT steps.*, CAST(bit AS BIGINT) AS bit FROM steps JOIN letters USING (letter)) s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
