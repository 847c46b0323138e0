"""URL filters as a sort-merge range join, in DataFrame functions alone.

A rule (host, path) covers its host and all subdomains where the url's path
starts with the rule's path.  Reversing the host's labels gives a canonical key:
a url is probed at each suffix of its host (a url has few labels), and there a
rule's path is a *prefix*, hence an interval of the sorted keys; intervals of
prefixes are either nested or disjoint.

Plan: rules and probes of a host are sorted together by key, and the sweep
carries the stack of the rules that enclose the last rule start, itself last.
Every rule that covers a probe is on that stack: it begins at or before the last
rule start, and whatever sorts between a prefix and one of its extensions
extends it too.  The innermost stack entry that is a prefix of the probe wins on
that suffix; the longest rule over the suffixes wins for the url.

Probes of hosts without rules go before the sort.  A host's probes are dealt, by
a hash of (id, url), to groups of about ROWS or as many as it has rules, each
with a copy of these; so a hot host is spread over many tasks, no row is dropped,
and the copies are never more than the probes and the rules together.

Defined results: a null url or one without "://" has an empty host and path and
gets the default verdict with a null rule; very long urls are judged whole;
repeated rows give repeated results; an empty url table gives no rows, no rules
give the default for all; of duplicate rules "block" wins, of
equally long ones that which sorts last; other columns of the
table are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
#: Probes of a sweep.
ROWS = 512
SALTS = 64
#: Repeats of a row that are made at a time.
REPEATS = 1024


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """A few rules as a table; many come as a table of their own."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).selectExpr("'' AS verdict", "'' AS host", "'' AS path")


def _at(labels: Column) -> Column:
    return F.array_join(labels, ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule (at, path) with the array of the host's rules that enclose it, outermost first, itself last."""
    keyed = (
        rules.select(_at(_reversed(F.translate("host", UPPER, LOWER))).alias("at"), "path", F.concat("host", "path").alias("rule"), "verdict")
        .groupBy("at", "path", "rule").agg(F.max("verdict").alias("verdict"))
    )
    # Only prefixes as long as some path of the host can be rules; there are no more of these than characters in a path.
    lengths = keyed.groupBy("at").agg(F.collect_set(F.length("path")).alias("lengths"))
    prefixes = keyed.select("at", F.col("path").alias("inner")).join(lengths, "at").select("at", "inner", F.explode(F.filter("lengths", lambda n: n <= F.length("inner"))).alias("n"))
    prefixes = prefixes.select("at", "inner", F.substring("inner", F.lit(1), F.col("n")).alias("path"))
    entry = F.struct(F.length("path").alias("n"), "path", "rule", "verdict")
    return prefixes.join(keyed, ["at", "path"]).groupBy("at", F.col("inner").alias("path")).agg(F.sort_array(F.collect_list(entry)).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each input row; see the module's text."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("id", "url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = _reversed(F.col("host"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _at(F.slice(labels, F.lit(1), n)))
    probes = rows.select("id", "url", "path", F.explode(suffixes).alias("at"))
    stacks = _stacks(rules)
    # How many sweeps each host with rules takes.
    many = stacks.groupBy("at").agg(F.count(F.lit(1)).alias("rules")).join(probes.groupBy("at").agg(F.count(F.lit(1)).alias("probes")), "at")
    many = many.select("at", F.ceil(F.col("probes") / F.greatest(F.col("rules"), F.lit(ROWS))).cast("int").alias("sweeps"))
    # A hot host's probes learn that in SALTS tasks.
    salted = probes.withColumn("salt", F.pmod(F.xxhash64("url", "id"), F.lit(SALTS)).cast("int"))
    told = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = salted.join(told, ["at", "salt"]).select("at", F.pmod(F.xxhash64("id", "url"), F.col("sweeps")).cast("int").alias("sweep"), "path", F.lit(1).alias("is_probe"), "id", "url")
    copied = stacks.join(many, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)).alias("sweep"), "path", F.lit(0).alias("is_probe"), "stack")
    # Dealt by both columns: rows that come sorted by host alone must not stay together.
    both = dealt.unionByName(copied, allowMissingColumns=True).repartition("at", "sweep")
    order = W.partitionBy("at", "sweep").orderBy("path", "is_probe").rowsBetween(W.unboundedPreceding, 0)
    active = F.filter(F.last("stack", ignorenulls=True).over(order), lambda r: F.startswith(F.col("path"), r["path"]))
    inner = F.try_element_at(F.col("active"), F.lit(-1))
    # The longest over all suffixes: by characters of host and path.
    won = both.withColumn("active", active).filter("is_probe = 1").select("id", "url", inner.alias("won")).filter("won IS NOT NULL")
    best = won.groupBy("id", "url").agg(F.max(F.struct(F.length("won.rule").alias("n"), "won.rule", "won.verdict")).alias("best"))
    best = best.select(F.col("id").alias("best_id"), F.col("url").alias("best_url"), "best.rule", "best.verdict")
    found = rows.join(best, rows["id"].eqNullSafe(best["best_id"]) & rows["url"].eqNullSafe(best["best_url"]), "left")
    # Repeats in two steps: no long array, however often a row occurs.
    blocks = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / REPEATS))).alias("block"))
    each = blocks.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS), F.col("copies") - F.col("block") * REPEATS))).alias("repeat"))
    return each.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'allow'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'block'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'allow'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'block'
       ELSE 'allow' END AS verdict
FROM u
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))
