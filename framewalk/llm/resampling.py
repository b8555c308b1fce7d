"""Importance resampling towards a target's distribution of hashed word n-grams.

A text's n-grams fall into buckets by hash.  The counts of all documents and of the
target's texts give each bucket a gain; a document's weight is the mean gain of
its n-grams.  A long text is split at word boundaries into chunks that overlap by n - 1
words: a chunk owns the n-grams that start in its own words, so that every n-gram is
counted once.  The chunks of one text are dealt out to many tasks, and their counts and
weights are summed by document.  Noise from the document's id makes the draw of
the highest scores a sample without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table
from framewalk.llm.merkle import CRC32_SQL
from framewalk.llm.ordering import placed

#: Words that a chunk owns; texts of no more bytes than this are a chunk by themselves.
CHUNK = 1 << 16
#: N-grams whose buckets a task remembers.
REMEMBERED = 1 << 18

_word = re.compile(rb"[0-9a-z\x80-\xff]+")  # of a text in UTF-8, A-Z in lower case
_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def chunks_of(text: str | None, n: int, owned: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(bytes, words owned) of a text's chunks: each begins with its own words, and carries n - 1 words of the next ones.

    A text without words is one empty chunk.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _is_word[np.frombuffer(data, np.uint8)]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        yield b"", 0
    for k in range(0, len(starts), owned):
        last = min(k + owned + n - 1, len(starts)) - 1
        yield data[starts[k] : ends[last]], min(owned, len(starts) - k)


def features(chunk: bytes, owned: int | None, n: int) -> list[bytes]:
    """The runs of 1 to n words that start in the chunk's first `owned` words (all, if None)."""
    words = _word.findall(chunk)
    if n == 1:
        return words
    owned = len(words) if owned is None else owned
    return [b" ".join(words[k : k + g]) for g in range(1, n + 1) for k in range(min(owned, len(words) - g + 1))]


class Buckets:
    """The buckets of n-grams by crc32, remembered while they are few."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, grams: list[bytes]) -> np.ndarray:
        known, crc, n = self.known, zlib.crc32, self.buckets
        if len(known) > REMEMBERED:
            known.clear()
        for g in set(grams).difference(known):
            known[g] = crc(g) % n
        return np.fromiter(map(known.__getitem__, grams), np.int64, len(grams))


def _chunks(rows: DataFrame, n: int) -> DataFrame:
    """(row, doc_id, chunk, owned) of rows(doc_id, text): short texts as they are, long ones in chunks dealt out to all tasks."""
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= CHUNK
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    whole = rows.where(short).select((-1 - F.col("row")).alias("row"), "doc_id", F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary").alias("chunk"), F.lit(None).cast("int").alias("owned"))
    kind = rows.schema["doc_id"].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch["text"]):
                own = batch.slice(k, 1)
                for chunk, owned in chunks_of(text.as_py(), n):
                    yield pa.RecordBatch.from_arrays([own["row"], own["doc_id"], pa.array([chunk], pa.binary()), pa.array([owned], pa.int32())], names=["row", "doc_id", "chunk", "owned"])

    long = rows.where(~short).select("row", "doc_id", "text").mapInArrow(split, f"row long, doc_id {kind.simpleString()}, chunk binary, owned int")
    return whole.unionByName(long.repartition(F.xxhash64("row", "chunk")))


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n): the n-grams of all texts(doc_id, text) by bucket; a task gives out one row a bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk, owned in zip(batch["chunk"], batch["owned"]):
                held += np.bincount(found.of(features(chunk.as_py(), owned.as_py(), n)), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    return _chunks(texts, n).select("chunk", "owned").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Each bucket's log ratio of its smoothed shares of the target and of the source, in thousandths, rounded down."""
    s, t = sum(source.values()), sum(target.values())
    each = ((target.get(b, 0), source.get(b, 0)) for b in range(buckets))
    return np.array([math.floor(1000 * math.log((x + 1.0) * (s + buckets) / ((y + 1.0) * (t + buckets)))) for x, y in each], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row for each row of docs(doc_id, text)."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Buckets(len(gains))
        for batch in batches:
            words, held, sums = [], [], []
            for chunk, owned in zip(batch["chunk"].to_pylist(), batch["owned"].to_pylist()):
                grams = features(chunk, owned, n)
                words.append(owned if owned is not None else len(grams) if n == 1 else len(_word.findall(chunk)))
                held.append(len(grams))
                sums.append(int(gains[found.of(grams)].sum()))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], *(pa.array(x, pa.int64()) for x in (words, held, sums))], names=["row", "doc_id", "n_words", "n_features", "gain"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = _chunks(docs, n).mapInArrow(weighed, f"row long, doc_id {kind}, n_words long, n_features long, gain long")
    # the row's number is of the scan that made the parts; a short text has one part, which is aggregated before the shuffle
    summed = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    weight = F.expr("CASE WHEN n_features = 0 THEN 0 ELSE (gain - pmod(gain, n_features)) div n_features END")
    return summed.select("doc_id", "n_words", "n_features", weight.cast("long").alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of the id in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per row of docs: (doc_id, n_features, weight, score, rank).

    The `percent` of the documents of at least least_words words that have the highest scores are drawn; equal scores
    go by the smaller id, null first.  rank is a drawn row's place from 1, else null.  A null or empty text has no
    features and weight 0; a null id's noise is that of the empty id.  Repeated rows are rows of their own, and are
    ranked one after the other.  Without target texts every bucket has a gain all the same.
    """
    work = Workspace(docs.sparkSession, "resampling")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = {}
    for name, texts in (("source", rows), ("target", target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")))):
        counts[name] = {r["bucket"]: r["n"] for r in bucket_counts(texts, n, buckets).collect()}  # at most `buckets` rows
    made = weights(rows, gains_of(counts["source"], counts["target"], buckets), n)
    made = made.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).select("*", (F.col("n_words") < least_words).alias("short"), (-F.col("score")).alias("down"))
    made = work.keep(made, "scores")
    drawn = made.where(~F.col("short")).count() * percent // 100
    place = placed(made, [], ["short", "down", "doc_id", "n_features"], work, "order")
    return place.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows and columns of docs that are drawn; rows that share an id with a drawn one, too, rows without an id never."""
    drawn = scored(docs, target, id_col=id_col, **options).where("rank is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(Workspace(docs.sparkSession, "resampling").side(drawn, "drawn"), id_col, "left_semi").select(*docs.columns)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, least_words=20, percent=10, seed=2024)


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_BYTES = "list_transform(range(CAST(strlen(w) AS BIGINT)), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT))"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
f AS (SELECT r, unnest(words) AS w FROM d),
b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
counts AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, 1 AS s, 0 AS t FROM f UNION ALL SELECT w, 0, 1 FROM b) GROUP BY w),
bucketed AS (SELECT w, s, t, {CRC32_SQL.format(_BYTES)} % 10000 AS bucket FROM counts),
gains AS (
  SELECT w, CAST(floor(1000 * ln((bt + 1.0::DOUBLE) * (sum(s) OVER () + 10000) / ((bs + 1.0::DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
  FROM (SELECT w, s, t, sum(s) OVER (PARTITION BY bucket) AS bs, sum(t) OVER (PARTITION BY bucket) AS bt FROM bucketed)),
weights AS (SELECT r, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN gains USING (w) GROUP BY r),
scores AS (
  SELECT d.r, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights ON d.r = weights.r),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank
FROM placed"""
