"""Toxicity: boosted trees over dense features, with isotonic calibration.

The lexicon (words and word beginnings much more frequent in toxic texts) is learnt
from a sample of labelled rows.  The rows that trees and calibration are fitted on
are read with a lexicon of the other half of the sample, so that no row meets
entries that it gave rise to; new texts are read with that of all of it.  Features
are densities in the whole text, written once as a table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table
from framewalk.llm.labelled import TRAIN_ROWS, held_out, labelled_sample

#: Fewest toxic texts with an entry, least ratio of the rates in the two classes, least log-likelihood ratio.
MIN_TOXIC, MIN_RATIO, MIN_G = 4, 6.0, 16.0
#: Share of the sample that the trees are fitted on; the rest is for the calibration.
TREES = 0.7
#: Lengths of word beginnings.
STEMS = (4, 5, 6)
#: Words on either side in which a second person is near.
NEAR = 3
#: Tokens that a task remembers.
TOKENS = 150_000

# Pronouns of the second person.
SECOND_PERSON = frozenset("you your yours yourself u ur thou du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vos".split())

# Signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})

EDGES = ".,;:!?\"'()[]{}<>|«»“”„…*#%&$-–—/\\"
_mixed = re.compile(r"[^\W\d_][\d@$!*._-]+[^\W\d_]")

FEATURES = ("log_words", "lexicon", "stems", "log_hits", "log_distinct", "densest", "second", "second_near", "capitals", "capital_words", "exclaims", "questions", "punctuation", "obfuscated", "obfuscated_hits", "digits", "word_length")
LEX, STEM, YOU, CAPS, OBF, OBF_LEX = 1, 2, 4, 8, 16, 32


def entries_of(text: str | None) -> set[str]:
    """Words, and beginnings of words marked with "-" at the end."""
    words = {t.strip(EDGES).lower() for t in (text or "").split()}
    out = {w for w in words if len(w) > 2}
    for n in STEMS:
        out |= {w[:n] + "-" for w in words if len(w) > n}
    return out


class Reader:
    """Features of texts, given a lexicon."""

    def __init__(self, lexicon: frozenset[str]):
        self.lexicon, self.known = lexicon, {}

    def flags(self, token: str) -> int:
        word = token.strip(EDGES)
        low = word.lower()
        out = LEX * (low in self.lexicon) | STEM * any(low[:n] + "-" in self.lexicon for n in STEMS if len(low) > n)
        out |= YOU * (low in SECOND_PERSON) | CAPS * (len(word) > 1 and word.isupper())
        if not word.isalpha() and _mixed.search(word):
            plain = low.translate(SIGNS)
            out |= OBF | OBF_LEX * (plain in self.lexicon or any(plain[:n] + "-" in self.lexicon for n in STEMS if len(plain) > n))
        if len(token) <= 48:
            if len(self.known) > TOKENS:
                self.known.clear()
            self.known[token] = out
        return out

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = text.split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        known = self.known
        f = np.array([known[t] if t in known else self.flags(t) for t in tokens], np.uint8)
        hit = np.flatnonzero(f & (LEX | STEM | OBF_LEX))
        you = (f & YOU) > 0
        near = densest = distinct = 0.0
        if hit.size:
            upto = np.concatenate([[0], np.cumsum(you)])
            near = np.count_nonzero(upto[np.minimum(n, hit + NEAR + 1)] - upto[np.maximum(0, hit - NEAR)]) / n
            densest = float(np.max(np.searchsorted(hit, hit + 20) - np.arange(hit.size)))
            distinct = len({tokens[i].strip(EDGES).lower() for i in hit})
        chars = len(text)
        count = text.count
        signs = sum(map(count, EDGES))
        rate = lambda bit: np.count_nonzero(f & bit) / n
        capitals = sum(map(len, re.findall(r"[A-Z]+", text)))
        digits = sum(map(count, "0123456789"))
        return [math.log1p(n), rate(LEX), rate(STEM), math.log1p(hit.size), math.log1p(distinct), densest, rate(YOU), near, capitals / chars, rate(CAPS), count("!") / n, count("?") / n, signs / chars, rate(OBF), rate(OBF_LEX), digits / chars, chars / n]


def learn_lexicons(sample: DataFrame, work: Workspace) -> list[frozenset[str]]:
    """Entries of sample(text, y, half) that mark toxic texts: those of half 0, of half 1, and of both; all that pass the tests."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each: dict[tuple[int, int], Counter] = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}  # of a part of the bounded sample
        for b in batches:
            for t, h, y in zip(b["text"], b["half"], b["y"]):
                each[h, y].update(entries_of(t))
        rows = [(e, h, n if y else 0, 0 if y else n) for (h, y), c in each.items() for e, n in c.items()]
        for s in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[s : s + 50_000], columns=["e", "half", "a", "b"])

    counted = work.keep(sample.select("text", "half", "y").mapInPandas(counts, "e string, half int, a long, b long").groupBy("e", "half").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "entries")
    sizes = {(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    out = []
    for halves in ((0,), (1,), (0, 1)):
        toxic, clean = (sum(sizes.get((h, y), 0) for h in halves) for y in (1, 0))
        if not toxic or not clean:
            out.append(frozenset())
            continue
        a, b = F.col("a"), F.col("b")
        rows = counted.where(F.col("half").isin(*halves)).groupBy("e").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(a >= MIN_TOXIC)
        ratio = ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))
        share = (a + b) / (toxic + clean)
        g = F.lit(0.0)
        for seen, of in ((a, toxic), (b, clean)):
            for n, p in ((seen, share), (of - seen, 1 - share)):
                g = g + F.when(n > 0, 2 * n * F.log(n / (of * p))).otherwise(0.0)
        best = rows.withColumn("g", g).where((ratio >= MIN_RATIO) & (F.col("g") >= MIN_G)).select("e")
        out.append(frozenset(best.toArrow()["e"].to_pylist()))  # of the bounded sample
    work.drop("entries")
    return out


def featured(rows: DataFrame, lexicons: list[frozenset[str]], keep: list[str]) -> DataFrame:
    """The columns keep of rows, and features made of the column text with the lexicon whose number is in the column lexicon."""

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        readers = [Reader(x) for x in lexicons]
        for texts, which in batches:
            yield pd.Series([readers[k].features(t) for t, k in zip(texts, which)], dtype="object")

    return rows.select(*keep, features("text", "lexicon").alias("features"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = 0.5, bound: int = TRAIN_ROWS, trees: int = 20, depth: int = 4) -> DataFrame:
    """One row per row of docs: (doc_id, held_out, score, predicted).

    docs has doc_id and text, labels has doc_id and the target.  A null text counts
    as empty: all its features are 0.  Without labelled rows of both classes in
    each part of the sample, every score is the smoothed share of label 1.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    work = Workspace(docs.sparkSession, "toxicity")
    sample = labelled_sample(docs, labels, target, bound).withColumn("half", (F.col("u") * 1000).cast("int") % 2)
    sample = work.keep(sample, "sample")
    lexicons = learn_lexicons(sample, work)
    rest = work.keep(featured(sample.withColumn("lexicon", 1 - F.col("half")), lexicons, ["y", "u"]).coalesce(8), "fitting")
    table_ = work.keep(featured(docs.withColumn("lexicon", F.lit(2)), lexicons, ["doc_id"]), "features")
    known = table_.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "features")
    parts = {(r["part"], r["y"]): r["count"] for r in rest.groupBy((F.col("u") < TREES).alias("part"), "y").count().collect()}
    if not all(parts.get((p, y)) for p in (True, False) for y in (0, 1)):
        by = sample.agg(F.sum("y"), F.count("*")).first()
        scored = known.withColumn("score", F.lit(((by[0] or 0) + 1) / (by[1] + 2)))
    else:
        fit = rest.select(F.col("y").cast("double").alias("label"), "u", array_to_vector("features").alias("vector")).coalesce(4)
        model = GBTClassifier(featuresCol="vector", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(fit.where(F.col("u") < TREES))
        raw = lambda rows: model.transform(rows).withColumn("raw", vector_to_array("probability")[1])
        curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw(fit.where(F.col("u") >= TREES)).select("label", "raw"))
        vectors = known.select("doc_id", "held_out", array_to_vector("features").alias("vector"))
        scored = curve.transform(raw(vectors).select("doc_id", "held_out", "raw"))
    return scored.select("doc_id", "held_out", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows and columns of docs that are not predicted toxic; rows without an id stay, rows with one id go together."""
    toxic = toxicity_scores(docs, labels, **options).where("predicted = 1").select("doc_id").distinct()
    toxic = Workspace(docs.sparkSession, "toxicity").side(toxic, "toxic")
    return docs.join(toxic, "doc_id", "left_anti").select(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
