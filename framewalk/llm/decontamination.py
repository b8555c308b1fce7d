"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the test items are seeds.  One pass counts the documents that hold each; what is rare is seen
against the rarest seeds of the same item, so that an item that many documents hold whole is as rare as any.  A
stretch of a few words whose seeds are all far more frequent than that is a common phrase, and its words weigh
little.  A second pass joins documents to items by their seeds and cuts out the passage around them.  Where what a passage and an
item have in common could reach the score at all, local alignment tells whether it does: through
rare seeds, edited copies are found; a common phrase alone never reaches it.  An alignment holds
two rows of its table at a time, so that its memory goes with the passage, whatever the item's length.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table

#: Words of a seed, and the fewest words of an item that is looked for anywhere; shorter ones are in texts that have nothing to do
#: with them, and can be looked for as whole lines.
SEED, MIN_WORDS = 5, 5
#: A common phrase: fewer words than this, in more than so many times the documents of the item's rarest seeds.
PHRASE, COMMON = 10, 8
#: Alignment score, as a share of the item's own, from which on a document is contaminated.
SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of test items that are looked up in one pass; more items mean more passes.
BLOCK_WORDS = 1_000_000
#: Words of a document whose n-grams are made at a time.
PART = 1 << 16

_token = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _token.findall((text or "").lower())


def line_index(items: list[tuple[int, str | None]], least_words: int = MIN_WORDS) -> dict[tuple[str, ...], list[int]]:
    """The items of fewer words, by their words."""
    out: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for k, text in items:
        if 0 < len(w := words_of(text)) < least_words:
            out[tuple(w)].append(k)
    return dict(out)


def whole_lines(text: str | None, lines: dict[tuple[str, ...], list[int]]) -> Iterator[tuple[int, int, int]]:
    """(item, first word, end) where a line of the text is an item."""
    at = 0
    for line in (text or "").split("\n") if lines else []:
        w = tuple(words_of(line))
        for k in lines.get(w, ()):
            yield k, at, at + len(w)
        at += len(w)


def word_weights(item: list[str], counts: dict[tuple[str, ...], int], n: int = SEED) -> np.ndarray:
    """Each word's weight in an item, by the documents that hold its seeds: 1, but less in common phrases, the more so the commoner."""
    weights = np.ones(len(item))
    held = np.array([counts.get(tuple(item[i : i + n]), 0) + 1.0 for i in range(max(0, len(item) - n + 1))])
    if len(held) < 2:
        return weights
    often = held / held.min()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (often > COMMON).astype(np.int8), [0]])))
    for low, high in zip(edges[::2], edges[1::2]):
        if high - low + n - 1 < PHRASE:
            for i in range(low, high):
                weights[i : i + n] = np.minimum(weights[i : i + n], 1 / (1 + np.log2(often[i])))
    return weights


def seed_index(items: list[tuple[int, str | None]], n: int = SEED, least_words: int = MIN_WORDS) -> tuple[dict[int, dict[tuple[str, ...], list[int]]], dict[int, int]]:
    """By length, each seed's items; and the items' lengths.  An item of fewer words than a seed is one seed as a whole."""
    index: dict[int, dict[tuple[str, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    lengths = {}
    for k, text in items:
        w = words_of(text)
        if len(w) < max(1, least_words):
            continue
        lengths[k] = len(w)
        size = min(n, len(w))
        for gram in {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}:
            index[size][gram].append(k)
    return {s: dict(x) for s, x in index.items()}, lengths


def passages(text: str | None, index: dict, lengths: dict[int, int]) -> Iterator[tuple[int, int, list[str]]]:
    """(item, first word, words) of each passage that shares seeds with an item."""
    w = words_of(text)
    found: dict[int, list[int]] = defaultdict(list)
    for size, seeds in index.items():
        for start in range(0, len(w), PART):
            grams = list(zip(*(w[start + i : start + i + PART] for i in range(size))))
            hits = seeds.keys() & set(grams)
            if hits:
                for at, g in enumerate(grams, start):
                    if g in hits:
                        for item in seeds[g]:
                            found[item].append(at)
    for item, hits in found.items():
        hits.sort()
        reach = lengths[item]
        start = 0
        for k in range(1, len(hits) + 1):
            if k == len(hits) or hits[k] - hits[k - 1] > 2 * reach:
                low, high = max(0, hits[start] - reach), hits[k - 1] + 2 * reach
                yield item, low, w[low:high]
                start = k


def _codes(passage: list[str], item: list[str]) -> tuple[np.ndarray, list[int]]:
    codes = {x: i for i, x in enumerate(dict.fromkeys(item))}
    return np.array([codes.get(x, -1) for x in passage], np.int32), [codes[x] for x in item]


def _best_end(p: np.ndarray, item: list[int], weights: np.ndarray, gap: float) -> tuple[float, int, int]:
    """(score, item words, passage words) up to the end of the best local alignment, the first of equals."""
    steps = np.arange(len(p) + 1) * (-GAP * gap)
    row, top, at, end = np.zeros(len(p) + 1), 0.0, 0, 0
    for i, (x, w) in enumerate(zip(item, weights), 1):
        best = np.zeros(len(p) + 1)
        np.maximum(row[1:] + GAP * w, row[:-1] + np.where(p == x, MATCH * w, MISMATCH * w), out=best[1:])
        np.maximum(best, 0, out=best)
        row = np.maximum.accumulate(best + steps) - steps
        if (high := float(row.max())) > top + 1e-9:
            top, at, end = high, i, int(row.argmax())
    return top, at, end


def _reach(p: np.ndarray, item: list[int], weights: np.ndarray, gap: float, score: float) -> int:
    """The fewest passage words in which an alignment that begins with both has the score."""
    steps = np.arange(len(p) + 1) * (-GAP * gap)
    row, fewest, fallen = -steps, len(p) + 1, 0.0
    for x, w in zip(item, weights):
        fallen += GAP * w
        best = np.empty(len(p) + 1)
        best[0] = fallen
        np.maximum(row[1:] + GAP * w, row[:-1] + np.where(p == x, MATCH * w, MISMATCH * w), out=best[1:])
        row = np.maximum.accumulate(best + steps) - steps
        there = np.flatnonzero(row[:fewest] >= score - 1e-6)
        fewest = int(there[0]) if there.size else fewest
    return fewest


def align(passage: list[str], item: list[str], least: float = 0.0, weights: np.ndarray | None = None) -> tuple[float, int, int]:
    """Smith-Waterman over words: score as a share of the item's own, and the passage's words (first, end) it covers.

    A word of the item counts by its weight (1 unless given), for a match or against one; a word that only the passage has, by the mean
    weight.  The end is that of the first best alignment, the start is found by aligning backwards from there.  Below the
    share `least` the words are not looked for: (score, 0, 0).
    """
    if not passage or not item:
        return 0.0, 0, 0
    weights = np.ones(len(item)) if weights is None else weights
    gap = float(weights.mean())
    p, codes = _codes(passage, item)
    top, at, end = _best_end(p, codes, weights, gap)
    share = top / (MATCH * float(weights.sum()))
    if not top or share < least:
        return share, 0, 0
    longest = at + int(MATCH * float(weights[:at].sum()) / (-GAP * gap)) + 1  # each word beyond the item's costs a gap
    back = p[max(0, end - longest) : end][::-1]
    return share, end - _reach(back, codes[:at][::-1], weights[:at][::-1], gap, top), end


def seed_counts(docs: DataFrame, items: list[tuple[int, str | None]], n: int = SEED, least_words: int = MIN_WORDS) -> dict[tuple[str, ...], int]:
    """How many rows of docs(text) hold each seed of the items: one pass, a task gives out one row a seed; as many rows as there are seeds."""
    seeds = sorted({g for grams in seed_index(items, n, least_words)[0].values() for g in grams})
    if not seeds:
        return {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {g: k for k, g in enumerate(seeds)}
        sizes = sorted({len(g) for g in seeds})
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                w = words_of(text)
                found: set[tuple[str, ...]] = set()
                for size in sizes:
                    for start in range(0, len(w), PART):
                        found |= number.keys() & set(zip(*(w[start + i : start + i + PART] for i in range(size))))
                held.update(map(number.__getitem__, found))
        yield pd.DataFrame({"seed": list(held.keys()), "n": list(held.values())}, dtype="int64")

    summed = docs.select("text").mapInPandas(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return {seeds[r["seed"]]: r["n"] for r in summed.collect()}


def _block(docs: DataFrame, items: list[tuple[int, object, str | None]], item_type: str, n: int, least: float, least_words: int, short_lines: bool) -> DataFrame:
    spark = docs.sparkSession
    texts_of = [(k, text) for k, _, text in items]
    counts = seed_counts(docs, texts_of, n, least_words)
    weights_of = {k: word_weights(words_of(text), counts, n) for k, text in texts_of}
    held = spark.sparkContext.broadcast((texts_of, weights_of))  # at most BLOCK_WORDS words and weights, or one item

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts_, weights_ = held.value
        index, lengths = seed_index(texts_, n, least_words)
        lines, texts = line_index(texts_, least_words) if short_lines else {}, dict(texts_)

        @cache
        def item_words(k: int) -> tuple[list[str], np.ndarray, float]:
            return words_of(texts[k]), weights_[k], float(weights_[k].sum())

        def scored(text: str | None) -> Iterator[tuple[int, float, int, int]]:
            for k, start, end in whole_lines(text, lines):
                yield k, 1.0, start, end
            for k, low, passage in passages(text, index, lengths):
                item, weights, whole = item_words(k)
                common = Counter(passage)
                could = 0.0
                for x, w in zip(item, weights):  # no alignment scores more than the words that both have
                    if common[x] > 0:
                        common[x] -= 1
                        could += w
                if could / whole >= least:
                    score, start, end = align(passage, item, least, weights)
                    if score >= least:
                        yield k, score, low + start, low + end

        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch["doc_id"], batch["text"]) for x in scored(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item", "score", "start_word", "end_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInPandas(look, f"doc_id {kind}, item int, score double, start_word int, end_word int")
    ids = spark.createDataFrame([(k, i) for k, i, _ in items], f"item int, item_id {item_type}")
    return rows.join(F.broadcast(ids), "item").select("doc_id", "item_id", "score", "start_word", "end_word")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = SEED, score: float = SCORE, min_words: int = MIN_WORDS, short_lines: bool = False) -> DataFrame:
    """A row for each pair of document and test item that align: (doc_id, item_id, score, start_word, end_word).

    The words are runs of \\w in lower case; the span is the best one of the
    document, counted in its words, the end not included.  Null and empty texts
    and items give no rows; an item of fewer than min_words words is looked for with short_lines only, as a whole line (score 1).  Documents that share an id are taken as one.
    """
    Workspace(docs.sparkSession, "leaks")  # sets the session up
    item_type = benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    words = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\W+")))).first()[0] or 0
    blocks = -(-words // BLOCK_WORDS) or 1
    out = None
    for b in range(blocks):
        block = [(k, *r) for k, r in enumerate(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect())]
        found = _block(rows, block, item_type, seed, score, min_words, short_lines)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("start_word"), -F.col("end_word"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("start_word"), (-F.col("b.col3")).alias("end_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows and columns of docs whose id no test item aligns with; rows without an id stay."""
    found = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    found = Workspace(docs.sparkSession, "leaks").side(found, "found")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
