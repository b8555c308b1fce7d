"""Quality rules: counts of each text, and cross-document line frequency.

Normalised lines are hashed and counted over the distinct documents of a host.
Lines above the limit are taken away; a document that is left with too few of
its words is rejected.  Copies of a text are read once and weigh by their number.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table
from framewalk.llm.lines import NORMALISED_SQL, lines_of, normalised

#: A line goes if it is in more documents of its host than this, and than this share of them.
MIN_DOCS, MAX_SHARE = 20, 0.01
#: A document is depleted if more than this share of its words goes.
DEPLETED = 0.5

_word = re.compile(r"[^\x20\x09-\x0D]+")
_blank = " \t\n\x0b\x0c\r"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    words = _word.findall(text)
    lines = [x for x in text.split("\n") if x.strip(_blank)]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        often, until = Counter(grams), 0
        for i, g in enumerate(grams):
            if often[g] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated


def counts():
    """A column function: text -> struct of the base counts."""

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([base_counts(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")

    return of


def _key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def counted_lines(docs: DataFrame, text_col: str, host_col: str, work: Workspace) -> DataFrame:
    """(host, key, h, w): the hashes of a text's normalised lines and the words of the line; key is the text's hash."""
    line = F.explode(F.transform(lines_of(F.col(text_col)), normalised)).alias("line")
    rows = docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), _key(text_col).alias("key"), line).where("line <> ''")
    rows = rows.select("host", "key", F.xxhash64("line").alias("h"), F.size(F.split("line", " ")).cast("long").alias("w"))
    return work.keep(rows.groupBy("host", "key", "h").agg(F.sum("w").alias("w")), "lines")


def documents_of_texts(docs: DataFrame, id_col: str, text_col: str, host_col: str, copies: bool, work: Workspace) -> DataFrame:
    """(host, key, docs, filled): the distinct documents with a text, and whether it has a line that is not blank.

    Without copies each text counts as one document.  Rows without an id are a document each.
    """
    filled = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), _key(text_col).alias("key"), F.col(id_col).alias("id"), filled.alias("filled"))
    if not copies:
        return work.keep(rows.groupBy("host", "key").agg(F.lit(1).cast("long").alias("docs"), F.max("filled").alias("filled")), "texts")
    ids = rows.groupBy("host", "key", "id").agg(F.count("*").alias("n"), F.max("filled").alias("filled"))
    each = F.when(F.col("id").isNull(), F.col("n")).otherwise(1)
    return work.keep(ids.groupBy("host", "key").agg(F.sum(each).alias("docs"), F.max("filled").alias("filled")), "texts")


def common_lines(lines: DataFrame, texts: DataFrame, min_docs: int, max_share: float, work: Workspace) -> DataFrame:
    """(host, h) of the lines in more than min_docs documents and more than the share max_share of the host's.

    A host's documents are those with a line that is not blank.  Most texts are of one
    document: only the others are joined with the lines, by a size-checked broadcast.
    """
    hosts = texts.where("filled").groupBy("host").agg(F.sum("docs").alias("docs"))
    several = work.side(texts.where("docs > 1").select("host", "key", "docs"), "several", F.lit(3))
    weighed = lines.join(several, ["host", "key"], "left")
    often = weighed.groupBy("host", "h").agg(F.sum(F.coalesce("docs", F.lit(1))).alias("n")).where(F.col("n") > min_docs).join(hosts, "host").where(F.col("n") > max_share * F.col("docs"))
    return work.side(often.select("host", "h", F.lit(1).alias("common")), "common", F.lit(3))


def depleted_texts(lines: DataFrame, common: DataFrame, depleted: float) -> DataFrame:
    """(host, key) of the texts that lose more than the share `depleted` of their words with the common lines."""
    lost = lines.join(common, ["host", "h"], "left").groupBy("host", "key").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("common") == 1, F.col("w")).otherwise(0)).alias("lost"))
    return lost.where(F.col("lost") > depleted * F.col("all")).select("host", "key")


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, copies: bool = True) -> DataFrame:
    """All rows and columns of docs, the texts without their host's common lines; texts that have none stay as they are."""
    work = Workspace(docs.sparkSession, "rules")
    texts = documents_of_texts(docs, id_col, text_col, host_col, copies, work)
    common = common_lines(counted_lines(docs, text_col, host_col, work), texts, min_docs, max_share, work)
    host = F.coalesce(F.col(host_col), F.lit(""))
    line = F.posexplode(F.transform(lines_of(F.col(text_col)), lambda x: F.xxhash64(normalised(x)))).alias("pos", "h")
    found = docs.select(host.alias("host"), _key(text_col).alias("key"), line).join(common, ["host", "h"], "left_semi")
    gone = work.side(found.groupBy("host", "key").agg(F.collect_set("pos").alias("gone")), "gone", 2 + F.size("gone"))
    work.drop("lines", "texts", "several", "common")
    rows = docs.select(F.struct("*").alias("row"), host.alias("own_host"), _key(text_col).alias("own_key"))
    joined = rows.join(gone, (F.col("own_host") == F.col("host")) & (F.col("own_key") == F.col("key")), "left")
    was = F.col(f"row.`{text_col}`")
    rest = F.array_join(F.filter(lines_of(was), lambda _, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), was).otherwise(rest)
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat: int = 50, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, depleted: float = DEPLETED, copies: bool = True) -> DataFrame:
    """One row per row of docs: (doc_id, the counts, base_failed, depleted, kept).

    base_failed: fewer than min_words words, or more than max_repeat per cent of
    the words in repeated windows of three.  A null text counts as empty (and
    fails), null hosts count as one host.  Repeated rows (the same id and text) are one document and
    are judged alike; copies under other ids are documents of their own, unless copies is false.
    """
    work = Workspace(docs.sparkSession, "rules")
    lines = counted_lines(docs, text_col, host_col, work)
    texts = documents_of_texts(docs, id_col, text_col, host_col, copies, work)
    gone = depleted_texts(lines, common_lines(lines, texts, min_docs, max_share, work), depleted).withColumn("depleted", F.lit(True))
    gone = work.side(gone, "depleted", F.lit(3))  # copies of one text are many rows of base
    work.drop("lines", "texts", "several", "common")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), _key(text_col).alias("key"), counts()(F.col(text_col)).alias("c"))
    base = base.select("doc_id", "host", "key", "c.*").withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    judged = base.join(gone, ["host", "key"], "left").withColumn("depleted", F.coalesce("depleted", F.lit(False)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "depleted", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
often AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT g.doc_id, unnest([g.i, g.i + 1, g.i + 2]) AS p FROM grams g JOIN often o ON g.doc_id = o.doc_id AND g.g = o.g)
  GROUP BY doc_id),
rows_ AS (SELECT doc_id, host, text, {NORMALISED_SQL.format("line")} AS line FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM w)),
every AS (SELECT doc_id, host, text, line, len(string_split(line, ' ')) AS n FROM rows_ WHERE line <> ''),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM every GROUP BY host),
common AS (
  SELECT f.host, f.line FROM every f JOIN hosts h ON f.host = h.host GROUP BY f.host, f.line, h.docs
  HAVING count(DISTINCT f.doc_id) > {MIN_DOCS} AND count(DISTINCT f.doc_id) > {MAX_SHARE} * h.docs),
filled AS (SELECT e.host, e.text, e.line, e.n FROM every e JOIN (SELECT min(doc_id) AS d FROM w GROUP BY host, text) u ON e.doc_id = u.d),
gone AS (
  SELECT f.host, f.text FROM filled f LEFT JOIN common c ON f.host = c.host AND f.line = c.line
  GROUP BY f.host, f.text HAVING sum(CASE WHEN c.line IS NOT NULL THEN f.n ELSE 0 END) > {DEPLETED} * sum(f.n)),
base AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, g.host IS NOT NULL AS depleted
  FROM w LEFT JOIN repeats r ON w.doc_id = r.doc_id LEFT JOIN gone g ON w.host = g.host AND w.text = g.text)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR depleted) AS kept
FROM base"""
