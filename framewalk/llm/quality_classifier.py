"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (words, and the shapes of words) are scaled by the log
ratio of their smoothed counts in the two classes; a linear hinge-loss model over
them is fitted by dual coordinate descent.  Margins of rows that the fit has not
seen give the logistic curve that makes a score of a margin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table
from framewalk.llm.labelled import TRAIN_ROWS, held_out, labelled_sample

#: Fewest sample documents with an n-gram in the model.
MIN_DOCS = 5
#: Most n-grams of all sample rows together (in expectation); a sample of longer texts has fewer rows.
TRAIN_NGRAMS = 30_000_000
#: Share of the sample that only the curve is fitted on.
CURVE = 0.25
SEP = "\x1f"
#: Tokens whose shape a task remembers.
TOKENS = 150_000

_token = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[0]
    if token.isdigit():
        return "0"
    if token.islower():
        return "x"
    if token.isupper():
        return "XX" if len(token) > 1 else "X"
    return "Xx" if token[0].isupper() else "xX"


class Shapes(dict):
    """Shapes of tokens seen, or their numbers (-1 for one without), emptied when many."""

    def __init__(self, number: dict[str, int] | None = None):
        self.number = number

    def __missing__(self, token: str):
        if len(self) > TOKENS:
            self.clear()
        made = self[token] = shape(token) if self.number is None else self.number.get(shape(token), -1)
        return made


def repetition(tokens: list[str]) -> str | None:
    """Whether tokens equal to the one before are many of all, some or none."""
    repeats = {a for a, b in zip(tokens, tokens[1:]) if a == b}
    return None if not repeats else "many" if sum(t in repeats for t in tokens) * 2 > len(tokens) else "some"


def ngrams(text: str | None, shapes: Shapes) -> set:
    """Words, pairs of words, and runs of three shapes ("=" around a word for repetition, "" around "empty")."""
    tokens = _token.findall(text or "")
    s = list(map(shapes.__getitem__, tokens))
    out = {*tokens, *pairwise(tokens), *zip(s, s[1:], s[2:])}
    if said := repetition(tokens):
        out.add(("=", said, "="))
    if not tokens:
        out.add(("", "empty", ""))
    return out


def key(gram) -> str:
    return gram if isinstance(gram, str) else SEP.join(gram)


def gram(key: str):
    parts = tuple(key.split(SEP))
    return key if len(parts) == 1 else parts


class Numbers:
    """The numbers of a model's n-grams, from 0: words first, then pairs, then runs of three shapes.

    Words and shapes are dictionaries; a pair or run is a 64-bit key made of its parts' numbers, in a sorted array, so
    that it takes 8 bytes.  The words of a pair in MIN_DOCS rows are in as many, so that they have numbers.
    """

    def __init__(self, grams: pa.Array):
        parts = pc.split_pattern(grams, SEP)
        size = pc.list_value_length(parts).to_numpy(zero_copy_only=False)

        def of(n: int) -> tuple[np.ndarray, pa.Array]:
            at = np.flatnonzero(size == n)
            return at, pc.list_flatten(parts.take(pa.array(at)))

        (at1, words), (at2, pairs), (at3, runs) = of(1), of(2), of(3)
        shapes = runs.unique()
        self.words, self.shapes = ({w: i for i, w in enumerate(x.to_pylist())} for x in (words, shapes))
        first, second = pc.index_in(pairs, words).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2).T
        a, b, c = pc.index_in(runs, shapes).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 3).T
        pair, run = first << 32 | second, a << 42 | b << 21 | c
        by_pair, by_run = np.argsort(pair), np.argsort(run)
        self.pairs, self.runs = pair[by_pair], run[by_run]
        #: Place in grams by number.
        self.order = np.concatenate([at1, at2[by_pair], at3[by_run]])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "order"}

    def of(self, text: str | None, shapes: Shapes) -> np.ndarray:
        """The numbers of a text's n-grams that have one, in order; shapes is Shapes(self.shapes), which remembers those of tokens."""
        shapes = shapes if shapes.number is self.shapes else Shapes(self.shapes)
        tokens = _token.findall(text or "")
        w = np.fromiter(map(self.words.get, tokens, repeat(-1)), np.int64, len(tokens))
        s = np.fromiter(map(shapes.__getitem__, tokens), np.int64, len(tokens))
        few = s[:-2] << 42 | s[1:-1] << 21 | s[2:]
        few = few[(s[:-2] >= 0) & (s[1:-1] >= 0) & (s[2:] >= 0)]
        for triple in ([("=", said, "=")] if (said := repetition(tokens)) else []) + ([("", "empty", "")] if not tokens else []):
            x, y, z = (self.shapes.get(p, -1) for p in triple)
            if min(x, y, z) >= 0:
                few = np.append(few, x << 42 | y << 21 | z)
        two = (w[:-1] << 32 | w[1:])[(w[:-1] >= 0) & (w[1:] >= 0)]
        start = len(self.words)
        return np.concatenate([np.unique(w[w >= 0]), start + among(self.pairs, two), start + len(self.pairs) + among(self.runs, few)])


    def grams(self) -> list:
        """The n-grams by number."""
        words, shapes = list(self.words), list(self.shapes)
        pairs = [(words[k >> 32], words[k & 0xFFFFFFFF]) for k in self.pairs.tolist()]
        return words + pairs + [tuple(shapes[k >> b & 0x1FFFFF] for b in (42, 21, 0)) for k in self.runs.tolist()]


def among(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in the sorted keys of those asked for that are there, each once, in order."""
    if not len(keys):
        return np.zeros(0, np.int64)
    asked = np.unique(asked)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at[keys[at] == asked]


def log_ratios(counts: np.ndarray, positive: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = positive + alpha, counts - positive + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (a bias last) of the hinge-loss model; classes weigh alike.

    A row's dual variable lies between 0 and its cost; each step sets one to where its own slope is 0, or to the nearer end.
    """
    w = np.zeros(size + 1)
    a = np.zeros(len(rows))
    most = cost / (2 * np.where(y > 0, (y > 0).mean(), (y < 0).mean()))
    norm = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            moved = min(most[i], max(0.0, a[i] - slope / norm[i]))
            if step := (moved - a[i]) * y[i]:
                w[rows[i]] += step * values[i]
                w[-1] += step
                a[i] = moved
    return w


def logistic_curve(margins: np.ndarray, y01: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with slightly softened labels (Platt)."""
    n1, n0 = y01.sum(), (1 - y01).sum()
    t = np.where(y01 > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (t - p))
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


class Model:
    """The numbers of n-grams, and by number the log-count ratio and that times its weight; a score is the curve's value at the margin.

    A dictionary of n-grams with other numbers is taken as well.
    """

    def __init__(self, numbers: Numbers | dict, ratio: np.ndarray, weighed: np.ndarray, bias: float, slope: float, offset: float):
        if isinstance(numbers, dict):
            given, numbers = np.fromiter(numbers.values(), np.int64, len(numbers)), Numbers(pa.array(map(key, numbers), pa.string()))
            ratio, weighed = (x[given][numbers.order] for x in (ratio, weighed))
        self.numbers, self.ratio, self.weighed, self.bias, self.slope, self.offset = numbers, ratio, weighed, bias, slope, offset

    @property
    def number(self) -> dict:
        """The number of each n-gram."""
        return {g: i for i, g in enumerate(self.numbers.grams())}

    def score(self, text: str | None, shapes: Shapes) -> float:
        at = self.numbers.of(text, shapes)
        margin = self.bias + self.weighed[at].sum() / np.sqrt((self.ratio[at] ** 2).sum() or 1.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, target: str, bound: int = TRAIN_ROWS, work: Workspace | None = None, most_ngrams: int = TRAIN_NGRAMS) -> Model:
    """The model, from about `bound` labelled rows with about `most_ngrams` n-grams in all.

    Only the n-grams in MIN_DOCS rows or more with their counts (at most most_ngrams / MIN_DOCS, in Arrow arrays) and the rows' n-gram
    numbers come to the driver (4 bytes each there, 12 in the fit); the bounds of the sample bound both.  Without rows of both classes the score is
    the smoothed share of label 1.
    """
    work = work or Workspace(docs.sparkSession, "nbsvm")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes()
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "u": b["u"], "v": b["v"], "text": b["text"], "grams": [sorted(map(key, ngrams(t, shapes))) for t in b["text"]]})

    sample = labelled_sample(docs, labels, target, bound).withColumn("v", F.pmod(F.xxhash64("text", F.lit("size")), F.lit(1_000_000)) / 1_000_000)
    rows = work.keep(sample.mapInPandas(grams, "y int, u double, v double, text string, grams array<string>"), "grams")
    total = rows.agg(F.sum(F.size("grams"))).first()[0] or 0
    rows = rows.where(F.col("v") < most_ngrams / max(total, most_ngrams))
    counted = rows.where(F.col("u") >= CURVE).select("y", F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("p")).where(F.col("n") >= MIN_DOCS)
    vocabulary = counted.orderBy(F.desc("n"), "g").toArrow().combine_chunks()
    numbers = Numbers(vocabulary["g"].chunk(0) if len(vocabulary) else pa.array([], pa.string()))
    n, p = (vocabulary[c].to_numpy().astype(float)[numbers.order] for c in ("n", "p"))
    by = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not len(n) or not by.get(0) or not by.get(1):
        share = (by.get(1, 0) + 1) / (sum(by.values()) + 2)
        return Model(Numbers(pa.array([], pa.string())), np.zeros(0), np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    ratio = log_ratios(n, p)
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, shapes = sent.value, Shapes(sent.value.shapes)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "u": b["u"], "ids": [made.of(t, shapes).astype(np.int32) for t in b["text"]]})

    sample = rows.select("y", "u", "text").mapInPandas(numbered, "y int, u double, ids array<int>").orderBy("u", "ids").toArrow().combine_chunks()
    work.drop("grams")
    sent.unpersist()
    held = sample["ids"].chunk(0)
    ends, flat = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False)
    ids = [flat[s:e] for s, e in zip(ends, ends[1:])]
    values = [ratio[i] / (np.linalg.norm(ratio[i]) or 1.0) for i in ids]
    u, y = sample["u"].to_numpy(), sample["y"].to_numpy()
    fitting = u >= CURVE
    part = np.flatnonzero(fitting)
    w = dual_descent([ids[i] for i in part], [values[i] for i in part], np.where(y[part] == 1, 1.0, -1.0), len(n))
    margins = np.array([w[i] @ v + w[-1] for i, v in zip(ids, values)])
    curve = ~fitting if len(set(y[~fitting])) == 2 else fitting
    slope, offset = logistic_curve(margins[curve], y[curve].astype(float))
    return Model(numbers, ratio, ratio * w[:-1], float(w[-1]), slope, offset)


def quality_scores(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3, bound: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: (doc_id, held_out, score, predicted).

    docs has doc_id and text, labels has doc_id and the target.  A null text counts
    as empty and gets a score like any other.  The model is every
    n-gram in MIN_DOCS sample rows or more and goes to the tasks as a broadcast of 24 bytes
    an n-gram, and a dictionary of its words: at most TRAIN_NGRAMS / MIN_DOCS n-grams.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "nbsvm")
    held = spark.sparkContext.broadcast(fit(docs, labels, target, bound, work))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held.value
        shapes = Shapes(model.numbers.shapes)
        for batch in texts:
            yield pd.Series([model.score(t, shapes) for t in batch], dtype="float64")

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
