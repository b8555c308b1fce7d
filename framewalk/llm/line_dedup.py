"""Line dedup by distinct-site spread.

Each normalised line's hash gets a HyperLogLog sketch of its sites, task by task; sketches
merge in the aggregation.  Lines estimated well above the threshold are
boilerplate, lines well below are not, and lines near it get an exact distinct
count.  Of each boilerplate line its first occurrence stays, all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table
from framewalk.llm.lines import NORMALISED_SQL, lines_of, normalised

#: Sites from which on a line is boilerplate.
MIN_SITES = 8
#: log2 of a sketch's buckets; the standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 8


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def spread_lines(lines: DataFrame, min_sites: int, work: Workspace, lg_k: int = LG_K) -> DataFrame:
    """Hashes h of lines(h, site) seen at min_sites sites or more.  A null site is no site.

    Tasks sketch the lines that they read, and the sketches are merged after the shuffle: a line's rows are never dealt out
    by its hash.  Only lines near the threshold are read again, for the distinct (line, site).
    """
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    estimated = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites")).where(F.col("sites") >= low)
    estimated = work.keep(estimated, "estimated")
    sure, near = estimated.where(F.col("sites") > high).select("h"), work.side(estimated.where(F.col("sites") <= high).select("h"), "near")
    exact = lines.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select("h")
    return sure.unionByName(exact)


def removals(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, lg_k: int, work: Workspace) -> DataFrame:
    """(id, key, gone): for each text that loses lines, the positions of the lines that go.

    key is the text's hash, so that rows that share an id keep apart; a null id matches a null id.
    """
    line = F.posexplode(F.transform(lines_of(F.col(text_col)), normalised)).alias("pos", "line")
    rows = docs.select(F.col(id_col).alias("id"), _text_key(F.col(text_col)).alias("key"), F.col(site_col).alias("site"), line)
    rows = rows.where("line <> ''").select("id", "key", "site", "pos", F.xxhash64("line").alias("h"))
    rows = work.keep(rows, "lines")
    spread = work.side(spread_lines(rows.select("h", "site"), min_sites, work, lg_k), "spread")
    found = work.keep(rows.join(spread, "h", "left_semi"), "found")
    first = work.side(found.groupBy("h").agg(F.min(F.struct("id", "key", "pos")).alias("first")), "first", F.lit(4))
    here = F.struct("id", "key", "pos")
    gone = found.join(first, "h").where(~here.eqNullSafe(F.col("first")))
    return gone.groupBy("id", "key").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """All rows and columns of docs, the text without the boilerplate lines that go.

    A line counts by its normalised form; empty ones never go.  The first
    occurrence by (id, text hash, position) stays, a null id being the least.
    Rows alike in id and text are treated alike: both keep the first occurrence.  A text that loses
    nothing is returned as it was (null stays null); one that loses all its lines
    becomes empty.
    """
    work = Workspace(docs.sparkSession, "linededup")
    gone = removals(docs, id_col, text_col, site_col, min_sites, lg_k, work)
    gone = work.side(gone, "gone", 2 + F.size("gone"))
    work.drop("lines", "estimated", "near", "spread", "found", "first")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), _text_key(F.col(text_col)).alias("own_key"))
    joined = rows.join(gone, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    was = F.col(f"row.`{text_col}`")
    rest = F.array_join(F.filter(lines_of(was), lambda _, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), was).otherwise(rest)
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.size(lines_of(F.col("text"))).alias("n_lines"))
    clean = dedup_lines(docs)
    kept = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(lines_of(F.col("text"))))
    return clean.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), kept.cast("long").alias("n_lines_kept"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: Rows of documents with their text after line dedup, for the queries below.
CLEAN_SQL = f"""
fw_lines AS (
  SELECT doc_id, source, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM {{documents}}),
fw_normal AS (SELECT doc_id, source, pos, line, {NORMALISED_SQL.format("line")} AS norm FROM fw_lines),
fw_spread AS (SELECT norm FROM fw_normal WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT source) >= {MIN_SITES}),
fw_first AS (
  SELECT n.norm, min(struct_pack(d := doc_id, p := pos)) AS first
  FROM fw_normal n SEMI JOIN fw_spread s ON n.norm = s.norm GROUP BY n.norm),
fw_kept AS (
  SELECT n.doc_id, n.pos, n.line FROM fw_normal n LEFT JOIN fw_first f ON n.norm = f.norm
  WHERE f.norm IS NULL OR (n.doc_id = f.first.d AND n.pos = f.first.p)),
fw_texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM fw_kept GROUP BY doc_id)"""

OP8_SQL = f"""
WITH {CLEAN_SQL.format(documents="documents")}
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines,
       CAST(CASE WHEN coalesce(t.text, '') = '' THEN 0 ELSE t.n END AS BIGINT) AS n_lines_kept,
       CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars_kept, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents d LEFT JOIN fw_texts t ON d.doc_id = t.doc_id"""
