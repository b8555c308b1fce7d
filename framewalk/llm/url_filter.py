"""URL filter: a blocked Bloom filter before an exact hash join.

Listed entries are canonical URL heads: a host and the start of a path.  A URL's
candidates are its host and parent domains, each with its path cut to the
lengths that occur in the list.  The filter's blocks are words of 64 bits, a row
each, so that the filter grows with the list; a candidate meets the one block that its
hash names, and passes if all its bits are set.  Only candidates that pass
are joined with the list, which removes the false positives.  All of it is
built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table
from framewalk.llm.lines import LOWER, UPPER

#: Bits that an entry sets in its block.
BITS = 5
#: Entries for each block of 64 bits.
LOAD = 4

#: The rules of the query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_rules(listed: DataFrame) -> DataFrame:
    """(verdict, host, path) of listed(verdict, url): the host in lower case, the path / where there is none."""
    path = path_of(F.col("url"))
    return listed.select("verdict", host_of(F.col("url")).alias("host"), F.when(path == "", "/").otherwise(path).alias("path"))


def _block(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry), F.lit(blocks)).cast("long")


def _mask(entry: Column) -> Column:
    h = F.xxhash64(entry, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """(b, w): the filter's words that have bits set, made by a grouped bit_or over column entry."""
    return entries.groupBy(_block(F.col("entry"), blocks).alias("b")).agg(F.bit_or(_mask(F.col("entry"))).alias("w"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: (page_id, host, path, rule, verdict).

    rules has (verdict, host, path); a rule fits its host and all subdomains if
    the URL's path starts with its path.  The rule with the longest host and path
    wins, then the one with the longer host, then "block" over "allow" if an entry
    is listed with both.  A null URL or one without "://" has an empty host and
    path, fits no rule and gets the default, as does an empty host.  Rules with a null are ignored;
    A-Z in their hosts count as lower case.

    The filter (two numbers a block) and the list (three an entry) are broadcast while they are
    small enough, else shuffled; the same rows pass either way.
    """
    work = Workspace(pages.sparkSession, "urls")
    rules = rules.where("verdict is not null and host is not null and path is not null and host <> ''").withColumn("host", F.translate("host", UPPER, LOWER))
    rules = work.keep(rules.groupBy(F.concat("host", "path").alias("entry")).agg(F.max("verdict").alias("verdict"), F.max(F.length("host")).alias("hosts")), "rules")
    blocks = max(64, -(-rules.count() // LOAD))
    lengths = sorted(r[0] for r in rules.select(F.length("entry") - F.col("hosts")).distinct().collect())
    labels = F.split("host", r"\.", -1)
    parents = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    heads = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    candidates = F.flatten(F.transform(parents, lambda h: F.transform(heads, lambda p: F.concat(h, p))))
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = work.keep(parts.withColumn("row", F.monotonically_increasing_id()), "rows")
    asked = rows.select("row", F.explode(candidates).alias("entry")).select("row", "entry", _block(F.col("entry"), blocks).alias("b"), _mask(F.col("entry")).alias("mask"))
    passed = asked.join(work.side(bloom_blocks(rules, blocks), "bloom", F.lit(2)), "b").where(F.col("w").bitwiseAND(F.col("mask")) == F.col("mask")).select("row", "entry")
    found = passed.join(work.side(rules, "list", F.lit(3)), "entry")
    best = found.groupBy("row").agg(F.max(F.struct(F.length("entry").alias("n"), "hosts", "entry", "verdict")).alias("best"))
    judged = rows.join(best, "row", "left")
    return judged.select("page_id", "host", "path", F.col("best.entry").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


OP7_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
parts AS (
  SELECT row_number() OVER () AS row_, page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT p.row_, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.row_)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.row_ = b.row_"""
