"""URL filters: host and path rules, and a path-template tree that judges the rest. DataFrame functions only.

Every path is a branch of its host's tree, of any depth. A place of a branch is a wildcard where most segments there are
different (at least 16 of them, more than half of the visits); what lies below it is one branch from then on, and the next
level is counted on that. Digits alone prove nothing. Pages that a rule decides are the labels. A branch's purity is its
smoothed share of blocked labels: a branch that does not differ from its parent by more than two standard errors is merged
with it, otherwise its share is pulled towards the parent's by two pseudo-labels; a branch without labels is its parent. A
page's purity comes from all labels down its template's branches on any host, then down its own host's branches. Templates
of purity over a half are rejected. Hot hosts and pages are counted before they meet; only figures of branches are joined
back, and adaptive execution splits what is left.

Only depths at which some host has 16 different segments are looked at, one round each, so long chains of the same
segments cost no rounds. A template's branches are spelled out once each, so its cost grows with the square of its depth.

Defined results: null urls and those without ``://`` have an empty host and path, no rule, and are judged by the empty
template; ties of equally long rules go by the rule's text; repeated rows are judged each for itself; without labels
nothing is rejected; an empty table gives an empty one. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import checkpoint_ready, read_table

#: Verdict and rule, host before the first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DISTINCT, PSEUDO = 16, 2.0


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return pages.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumns({
        "host": F.translate(F.regexp_extract("__rest", "^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract("__rest", "^[^/?#]*([^?#]*)", 1),
    }).drop("__rest")


def longest_rule(rules: tuple[tuple[str, str], ...]) -> Column:
    """A struct of rule and verdict, or null."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain


def with_template(paths: DataFrame) -> DataFrame:
    """paths: distinct host and path, with visits. Adds template, of the path's own depth, one round for each depth that can
    hold a wildcard."""
    checkpoint_ready(paths.sparkSession)
    rows = paths.withColumn("__s", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(path, 2)"), "/"))).checkpoint()
    places = rows.select("host", F.posexplode("__s").alias("__k", "__at")).distinct().groupBy("host", "__k").count()
    depths = places.filter(F.col("count") >= DISTINCT).select("__k").distinct().collect()
    for k in sorted(r[0] for r in depths):
        rows = rows.withColumn("__branch", F.array_join(F.slice("__s", 1, k), "/") if k else F.lit(""))
        seen = rows.filter(F.size("__s") > k).groupBy("host", "__branch", F.get("__s", F.lit(k)).alias("__at")).agg(F.sum("visits").alias("__c"))
        wide = seen.groupBy("host", "__branch").agg(F.count("*").alias("__d"), F.sum("__c").alias("__v")).filter((F.col("__d") >= DISTINCT) & (F.col("__d") * 2 > F.col("__v")))
        widened = F.concat(F.slice("__s", 1, k), F.array(F.lit("*")), F.slice("__s", F.lit(k + 2), F.size("__s")))
        rows = rows.join(wide.select("host", "__branch", F.lit(True).alias("__w")), ["host", "__branch"], "left")
        rows = rows.withColumn("__s", F.when(F.col("__w") & (F.size("__s") > k), widened).otherwise(F.col("__s"))).drop("__w", "__branch").checkpoint()
    return rows.withColumn("template", F.when(F.size("__s") == 0, "").otherwise(F.concat(F.lit("/"), F.array_join("__s", "/")))).drop("__s")


def template_purity(leaf: DataFrame) -> DataFrame:
    """Of rows host, template, n, bad: the purity of each host's template, from all labels down the branches on any host, and
    then down the host's own branches. Branches without labels say nothing."""
    total = leaf.agg(F.sum("n"), F.sum("bad")).first()
    root = ((total[1] or 0) + 0.5) / ((total[0] or 0) + 1)
    segments = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(template, 2)"), "/"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("__s")), lambda i: F.when(i == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice("__s", F.lit(1), i), "/"))))
    spread = leaf.withColumn("__s", segments).select("host", "template", "n", "bad", F.posexplode(prefixes).alias("depth", "branch"))
    own = spread.groupBy("host", "depth", "branch").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    anywhere = own.groupBy("depth", "branch").agg(F.sum("n").alias("__n"), F.sum("bad").alias("__bad"))
    figures = F.struct("depth", F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad"), F.col("__n").cast("double").alias("all_n"), F.col("__bad").cast("double").alias("all_bad"))
    lines = spread.drop("n", "bad").join(own.join(anywhere, ["depth", "branch"]), ["host", "depth", "branch"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(figures)).alias("line"))

    def down(start: Column, n: str, bad: str) -> Column:
        def step(r: Column, x: Column) -> Column:
            near = F.abs(x[bad] - x[n] * r) <= 2.0 * F.sqrt(x[n] * r * (1.0 - r))
            return F.when((x[n] == 0) | near, r).otherwise((x[bad] + PSEUDO * r) / (x[n] + PSEUDO))

        return F.aggregate("line", start, step)

    return lines.withColumn("__any", down(F.lit(float(root)), "all_n", "all_bad")).select("host", "template", down(F.col("__any"), "n", "bad").alias("purity"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages: page_id, url. Returns page_id, host, path, rule, verdict, template and purity."""
    df = with_host_and_path(pages.select("page_id", "url")).withColumn("__rule", longest_rule(rules)).drop("url")
    label = F.when(F.col("__rule.verdict") == "block", 1).when(F.col("__rule.verdict") == "allow", 0)
    paths = with_template(df.groupBy("host", "path").agg(F.count("*").alias("visits"), F.count(label).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("bad")))
    purity = template_purity(paths.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    judged = paths.select("host", "path", "template").join(purity, ["host", "template"])
    return df.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), F.when(F.col("purity") > 0.5, "block").otherwise("allow")).alias("verdict"), "template", "purity"
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages")).drop("purity")


SQL = """
WITH RECURSIVE p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
), l AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS label FROM r
), walk AS (
  SELECT host, path, count(*) AS visits, count(label)::DOUBLE AS n, coalesce(sum(label), 0)::DOUBLE AS bad,
         CASE WHEN path = '' THEN []::VARCHAR[] ELSE string_split(substr(path, 2), '/') END AS s, 0 AS k, '' AS template
  FROM l GROUP BY host, path
  UNION ALL
  SELECT host, path, visits, n, bad, s, k + 1, concat(template, '/', CASE WHEN d >= 16 AND d * 2 > v THEN '*' ELSE s[k + 1] END)
  FROM (SELECT *, count(DISTINCT s[k + 1]) OVER (PARTITION BY host, template) AS d, sum(visits) OVER (PARTITION BY host, template) AS v
        FROM walk WHERE len(s) > k) x
), t AS (
  SELECT host, path, n, bad, template FROM walk WHERE k = len(s)
), leaf AS (
  SELECT host, template, sum(n) AS n, sum(bad) AS bad,
         CASE WHEN template = '' THEN []::VARCHAR[] ELSE string_split(substr(template, 2), '/') END AS b FROM t GROUP BY host, template
), spread AS (
  SELECT host, template, n, bad, depth, CASE WHEN depth = 0 THEN '' ELSE concat('/', array_to_string(b[1:depth], '/')) END AS branch
  FROM (SELECT *, unnest(range(0, len(b) + 1)) AS depth FROM leaf) y
), own AS (
  SELECT host, depth, branch, sum(n) AS n, sum(bad) AS bad FROM spread GROUP BY ALL
), anywhere AS (
  SELECT depth, branch, sum(n) AS n, sum(bad) AS bad FROM own GROUP BY ALL
), lines AS (
  SELECT s.host, s.template, s.depth, o.n, o.bad, a.n AS all_n, a.bad AS all_bad
  FROM spread s JOIN own o USING (host, depth, branch) JOIN anywhere a USING (depth, branch)
), down AS (
  SELECT host, template, 0 AS depth, (coalesce(sum(bad) OVER (), 0) + 0.5::DOUBLE) / (coalesce(sum(n) OVER (), 0) + 1) AS q, len(b) + 1 AS levels FROM leaf
  UNION ALL
  SELECT d.host, d.template, d.depth + 1,
    CASE WHEN m.n = 0 OR abs(m.bad - m.n * q) <= 2.0::DOUBLE * sqrt(m.n * q * (1.0::DOUBLE - q)) THEN q
         ELSE (m.bad + 2.0::DOUBLE * q) / (m.n + 2.0::DOUBLE) END, levels
  FROM down d JOIN (
    SELECT host, template, 0 AS part, depth, all_n AS n, all_bad AS bad FROM lines
    UNION ALL SELECT host, template, 1, depth, n, bad FROM lines
  ) m ON m.host = d.host AND m.template = d.template AND m.part * levels + m.depth = d.depth
)
SELECT l.page_id, l.host, l.path, l.rule,
  CASE WHEN l.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN l.rule IS NOT NULL THEN 'allow' WHEN q > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  t.template
FROM l JOIN t USING (host, path) JOIN down ON down.host = t.host AND down.template = t.template AND down.depth = 2 * levels
"""
